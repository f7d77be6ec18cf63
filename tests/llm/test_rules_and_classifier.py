"""Quality rules (SQL twin, order, odd cases) and the weak-label classifier."""

import numpy as np
import pytest

from tests.compare import compare, connection
from tests.llm.helpers import PROSE, WORD, documents, odd_documents
from visitweave.llm import quality_rules as Q, weak_labels as W


def test_cascade_same_as_sql(spark, sf):
    assert compare(Q.op6_quality_cascade(spark, sf), connection(sf), Q.OP6_SQL) is None


def plain_repeats(text):
    words = WORD.findall(text or "")
    seen = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, x in enumerate(seen) if seen.count(x) > 1 for k in range(3)})


@pytest.mark.parametrize("text", ["", "a b c", "a b c a b c", "a a a a a", "x y z w x y z q x y", "a b " * 20, "A a A a"])
def test_repeated_words_by_brute_force(spark, text):
    df = documents(spark, [(1, text)])
    assert Q.with_stats(df).first().n_repeat_words == plain_repeats(text)


def test_repeated_words_of_a_very_long_text(spark):
    one = spark.range(1).selectExpr("0L as doc_id", "array_join(transform(sequence(1, 6000000), x -> hex(x)), ' ') as text")
    row = Q.with_stats(one).first()
    assert row.n_words == 6_000_000 and row.n_repeat_words == 0
    twice = one.selectExpr("doc_id", "concat(text, ' 5 6 7 8') as text")
    assert Q.with_stats(twice).first().n_repeat_words == 8


def test_repeats_when_all_window_hashes_collide(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(Q.F, "xxhash64", lambda *columns: F.lit(1 << 40).cast("long"))
    for text in ("a b c x a b c", "a b c d e f g", "x y z q x y z w q x y", "a a a a a"):
        assert documents(spark, [(1, text)]).select(Q.n_repeat_words(Q.words_of(F.col("text"))).alias("n")).first().n == plain_repeats(text)


def test_counts_of_odd_documents(spark):
    df = odd_documents(spark)
    for row in Q.with_stats(df).collect():
        words = WORD.findall(row.text)
        assert row.n_words == len(words) and row.word_chars == sum(map(len, words))
        assert row.n_symbols == sum(c in "#*$%&|<>" for c in row.text)
    assert Q.keep(df).columns == df.columns and Q.keep(df.limit(0)).count() == 0


def test_text_rules_agree_with_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in Q.op6_quality_cascade(spark, sf).filter("kept").collect()}
    assert {r.doc_id for r in Q.keep(docs).select("doc_id").collect()} == kept


def test_order_is_rejections_per_cost_and_does_not_change_the_verdict(spark):
    rules = Q.stat_rules()[:3]
    found = [Q.Estimate("few_words", 1.0, 10, 99), Q.Estimate("repeated_words", 0.1, 10, 99), Q.Estimate("symbols", 0.1, 1, 99)]
    assert [r.name for r in Q.ordered(rules, found)] == ["repeated_words", "few_words", "symbols"]
    df = Q.with_stats(odd_documents(spark))
    one, other = (df.select(Q.rejected(x).alias("x")).collect() for x in (rules, rules[::-1]))
    assert one == other


def test_later_rules_are_not_evaluated(spark):
    from pyspark.sql import functions as F
    df = documents(spark, [(1, "x")])
    rules = [Q.Rule("first", F.lit(1) == F.col("doc_id")), Q.Rule("fails", F.raise_error(F.col("text")).cast("boolean"))]
    assert df.select(Q.rejected(rules).alias("x")).first().x


def test_rules_over_texts_are_asked_only_where_earlier_ones_let_through(spark, sf):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    order = Q.ordered(Q.text_rules(), Q.estimate(docs, Q.text_rules(), ["doc_id"], shared=Q.shared_words()))
    verdict = Q.let(Q.shared_words(), lambda w: Q.rejected([r._replace(rejects=r.of(w)) for r in order]))
    alone = docs.select("doc_id", verdict.alias("x"), *[
        Q.let(Q.shared_words(), r.of).alias(r.name) for r in order]).collect()
    assert all(r.x == any(r[k.name] for k in order) for r in alone) and any(r.x for r in alone)

    def strict(k):
        """The rule, which fails where an earlier one rejects."""
        def rejects(w):
            earlier = Q.reduce(lambda a, b: a | b, [r.of(w) for r in order[:k]], F.lit(False))
            return F.when(earlier, F.raise_error(F.lit("asked in vain")).cast("boolean")).otherwise(order[k].of(w))
        return Q.Rule(order[k].name, rejects)
    checked = [strict(k) for k in range(len(order))]
    got = docs.select("doc_id", Q.let(Q.shared_words(), lambda w: Q.rejected([r._replace(rejects=r.of(w)) for r in checked])).alias("x"))
    assert {(r.doc_id, r.x) for r in got.collect()} == {(r.doc_id, r.x) for r in alone}


def test_the_sample_is_bounded_when_all_rows_are_alike(spark):
    df = documents(spark, [(1, "x y z")] * 500)
    assert Q.estimate(df, Q.text_rules(), ["doc_id", "text"], 20, Q.shared_words())[0].rows <= 40


def test_expectation_maximisation_finds_accuracies():
    draw = np.random.default_rng(3)
    good = draw.random(20_000) < 0.8
    right = np.linspace(0.7, 0.95, len(W.LABELLERS))
    votes = np.where(draw.random((20_000, len(right))) < right, good[:, None], ~good[:, None]) + 1
    votes[draw.random(votes.shape) < 0.3] = W.NOTHING
    patterns, counts = np.unique(votes @ 3 ** np.arange(len(right))[::-1], return_counts=True)
    model = W.expectation_maximisation(patterns, counts)
    assert abs(model.prior - 0.8) < 0.03
    assert np.abs(model.chances[:, 1, W.GOOD] - right).max() < 0.05
    assert np.abs(model.chances[:, 0, W.BAD] - right).max() < 0.06


def test_classifier_against_labels_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    got = W.op3_weak_label_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.05


def test_classifier_on_odd_documents(spark):
    df = odd_documents(spark)
    got = W.score(df, *W.fit(df)).collect()
    assert len(got) == df.count()
    assert all(r.score == 0 and not r.kept for r in got if r.doc_id in (1, 2, 3))
    assert W.keep(df).columns == df.columns
    empty = df.limit(0)
    assert W.score(empty, *W.fit(empty)).count() == 0 and W.keep(empty).count() == 0


def test_scores_by_brute_force(spark):
    df = documents(spark, [(1, PROSE), (2, "%%% ### " * 9), (3, PROSE + "a a a")])
    model, scorer = W.fit(df)
    for row in W.score(df, model, scorer).join(df.select("doc_id", "text"), "doc_id").collect():
        at, share = W.features(row.text)
        assert abs(row.score - 1 / (1 + np.exp(-(scorer.weights[at] @ share + scorer.bias)))) < 1e-5


def test_the_training_sample_is_bounded_when_texts_are_alike(spark):
    df = documents(spark, [(i, PROSE if i % 2 else PROSE + f" number {i}") for i in range(3000)])
    model = W.label_model(df)
    assert 50 <= len(W.training_rows(df, model, rows=100)) <= 200
    same = documents(spark, [(1, PROSE)] * 900)
    assert len(W.training_rows(same, W.label_model(same), rows=100)) <= 200
