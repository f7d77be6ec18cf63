"""Sources, embeddings, feed, classifier and the two jobs from end to end."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from queries import fixture as X, jobs
from queries.labelling import payloads
from tests.suffix_extract import SUFFIXES
from tests.test_storage import shared_names
from visitweave.config import NO_DOMAIN
from visitweave.operators import classifier, cooccurrence, domains, embeddings, evaluate, sequences, split, urls
from visitweave.plans import prepare as P, train as T
from visitweave.sources import combined, events as E, models, suffixes, visits as V

LINE = "\t".join(["1.5", *[""] * 9, "http://r.com/", "", "http://www.q.com/a"])


@pytest.fixture(scope="module")
def history(spark, sf):
    """Fixture events and visits, written once."""
    ev = X.events(spark, sf).cache()
    return ev, X.visits(spark, sf).cache()


def _payload(spark, *lines):
    return spark.createDataFrame([("u", "\n".join(lines))], "user_id string, payload string")


def test_parse_and_standardise(spark):
    parsed = E.parse_events(_payload(spark, LINE, "x\ty", "", LINE.replace("1.5", "abc"), "\t".join(["2", *[""] * 12])))
    rows = E.standardised(parsed, suffixes.suffixes(spark, SUFFIXES)).collect()
    assert [(r.event_id, r.timestamp, r.ts_ms, r.request_url, r.referrer_url, r.prev_url) for r in rows] == [
        (0, 1.5, 1500, "q.com/a", "r.com", "")]
    bad = E.reject_count(_payload(spark, LINE, "x\ty", LINE)).first()
    assert (bad.n_lines, bad.n_rejected) == (3, 1)


def test_failfast(spark):
    assert E.parse_events(_payload(spark, LINE), "failfast").count() == 1
    with pytest.raises(Exception, match="malformed event line"):
        E.parse_events(_payload(spark, LINE, "x\ty"), "failfast").collect()
    with pytest.raises(ValueError):
        E.parse_events(_payload(spark, LINE), "other")


def test_parse_is_streamable(spark, tmp_path):
    _payload(spark, LINE, LINE).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id string, payload string").parquet(str(tmp_path / "in"))
    run = E.parse_events(stream).writeStream.format("memory").queryName("parsed").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("parsed").count() == 2


def test_user_filters(spark):
    ev = spark.createDataFrame([("a", "-"), ("a", "x.com"), ("b", "y.com")], "user_id string, request_url string")
    assert {r.user_id for r in E.keep_users(ev).collect()} == {"a"} and E.keep_users(ev).count() == 2
    assert {r.user_id for r in E.keep_users(ev, "clean").collect()} == {"b"}
    assert {r.user_id for r in E.limit_users(ev, 2).collect()} == {"b"}


def test_dictionary_is_stable(spark):
    ev = spark.createDataFrame([("b.com",), ("a.com",), ("b.com",)], "domain string")
    want = {NO_DOMAIN: 0, "a.com": 1, "b.com": 2}
    assert {r.domain: r.domain_id for r in domains.dictionary(ev).collect()} == want
    from visitweave.operators.grouped import find_hot
    names = ev.select("domain").union(spark.createDataFrame([(NO_DOMAIN,)], "domain string")).distinct()
    split_up = domains.dictionary(ev, find_hot(names, [], 1))
    assert {r.domain: r.domain_id for r in split_up.collect()} == want


def test_long_chain_continues(spark):
    ev = spark.createDataFrame([("u", i, i, f"d{i}") for i in range(7)], "user_id string, ts_ms long, event_id long, domain string")
    got = sorted((r.part, r.chain) for r in domains.chains(ev, size=3).collect())
    assert got == [(0, ["d0", "d1", "d2"]), (1, ["d3", "d4", "d5"]), (2, ["d6"])]


def test_embeddings(spark):
    words = [(["a", "b", "c"],)] * 5 + [(["a", "rare"],)]
    df = spark.createDataFrame(words, "words array<string>")
    one, two = (embeddings.vector_table(embeddings.fit(df, seed=4, partitions=1)).collect() for _ in range(2))
    assert {r.token for r in one} == {"a", "b", "c"} and all(len(r.vector) == 100 for r in one)
    assert sorted(one) == sorted(two)


def test_vocabulary_must_fit(spark):
    tokens = spark.createDataFrame([(t,) for t in "aaaaabbbbcccdd"], "token string")
    embeddings.check_vocabulary(tokens, 2, 4)
    embeddings.check_vocabulary(tokens.limit(0), 2, 4)
    with pytest.raises(ValueError, match="4 tokens, but at most 2 fit: set min_count to 4 or more"):
        embeddings.check_vocabulary(tokens, 2, 2)
    embeddings.check_vocabulary(tokens, 4, 2)


def test_url_vectors(spark):
    rng = np.random.default_rng(0)
    vecs = {t: rng.random(100, dtype=np.float32) for t in ["x.com", "", "a", NO_DOMAIN, "y.com"]}
    table = spark.createDataFrame([(t, v.tolist()) for t, v in vecs.items()], "token string, vector array<float>")
    rules = suffixes.suffixes(spark, SUFFIXES)
    df = spark.createDataFrame([("x.com/a/zz", "", "y.com/a?==&a=1")], "request_url string, referrer_url string, prev_url string")
    dim = urls.url_dimension(df, E.URL_COLUMNS, rules)
    ids = spark.createDataFrame([("x.com", 7), (NO_DOMAIN, 0)], "domain string, domain_id long")
    got = {r.url: np.array(r.features, dtype=np.float32)
           for r in embeddings.url_features(dim, table, table, ids).collect()}
    tenth = np.float32(0.1)
    want = {"x.com/a/zz": ((vecs["x.com"] + vecs[""] + vecs["a"]) * tenth, vecs["x.com"], 7),
            "": (np.zeros(100, np.float32), vecs[NO_DOMAIN], 0),
            "y.com/a?==&a=1": ((vecs["y.com"] + vecs[""] + vecs["a"]) * tenth, vecs["y.com"], -1)}
    assert set(got) == set(want)
    for u, (mean, dom, number) in want.items():
        assert np.allclose(got[u], np.concatenate([mean, dom, [number]]), rtol=1e-6)


def test_planted_neighbours_are_near_each_other(spark):
    draw = np.random.default_rng(2)
    topics = [[f"{t}{i}" for i in range(12)] for t in "abc"]
    rows = [([str(x) for x in draw.choice(topics[i % 3], 15)] + ["often"] * (i % 2),) for i in range(240)] + [(["lonely"],)] * 6
    df = spark.createDataFrame(rows, "words array<string>")
    vectors = embeddings.fit(df, seed=3, size=8, method="cooccurrence")
    found = {r.token: np.array(r.vector) for r in vectors.collect()}
    assert set(found) == {x for t in topics for x in t} | {"often", "lonely"} and not found["lonely"].any()
    names = [x for t in topics for x in t]
    m = np.array([found[x] / np.linalg.norm(found[x]) for x in names])
    near = m @ m.T - 2 * np.eye(len(names))
    assert np.mean([names[i][0] == names[j][0] for i, j in enumerate(near.argmax(1))]) > 0.95
    again = embeddings.fit(df, seed=3, size=8, method="cooccurrence").collect()
    assert all(np.allclose(found[r.token], r.vector, atol=1e-3) for r in again)


def test_pair_counts_by_brute_force(spark):
    rows = [["a", "b", "a", None, "c"], [], ["a"], list("abcabcabc")]
    want: dict = {}
    for words in rows:
        for i, x in enumerate(words):
            for j, y in enumerate(words):
                if i != j and abs(i - j) <= 2 and x and y:
                    want[x, y] = want.get((x, y), 0) + 1
    got = cooccurrence.pair_counts(spark.createDataFrame([(x,) for x in rows], "w array<string>"), "w", 2).collect()
    assert {(r.token, r.context): r.n for r in got} == want


def test_a_vocabulary_too_large_for_one_matrix_is_factorised(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(["a", "b", "c"],)] * 6, "words array<string>")
    monkeypatch.setattr(embeddings, "DRIVER_WEIGHTS", 10)
    vectors = embeddings.fit(df, size=4)
    models.save_embedding(vectors, str(tmp_path / "v"))
    assert {r.token for r in models.load_vectors(spark, str(tmp_path / "v")).collect()} == {"a", "b", "c"}
    with pytest.raises(ValueError):
        embeddings.fit(df, method="other")


def test_unknown_domain_without_fallback_vector(spark):
    dim = spark.createDataFrame([("q.com",)], "domain string")
    empty = spark.createDataFrame([], "token string, vector array<float>")
    assert embeddings.with_domain_vector(dim, empty, "domain").first().domain_vec == [0.0] * 100


def test_event_features_and_dense(spark):
    width = 201
    feats = spark.createDataFrame([(u, [float(i)] * width) for i, u in enumerate(["a", "b", ""])],
                                  "url string, features array<float>")
    ev = spark.createDataFrame([("u", 1, "a", "", "b"), ("u", 2, "b", "a", "a")],
                               "user_id string, event_id long, request_url string, referrer_url string, prev_url string")
    wide = embeddings.event_features(ev, feats)
    got = {r.event_id: (r.request_vec[0], r.href_vec[0], r.prev_vec[0]) for r in wide.collect()}
    assert got == {1: (0.0, 2.0, 1.0), 2: (1.0, 0.0, 0.0)}
    rows = embeddings.model_rows(wide.withColumn("rel_time", F.lit(3.5)).withColumn("label", F.lit(4)))
    seq = spark.createDataFrame([("u", 2, [(-1, -1), (1, 5), (2, -1)])],
                                "user_id string, event_id long, sequence array<struct<event_id:long,label:int>>")
    x = np.array(embeddings.dense(seq, rows, 3).first().x)
    assert x.shape == (3, 404) and (x[0] == -1).all()
    assert (x[1, 0], x[1, 201], x[1, 402], x[1, 403]) == (0.0, 2.0, 3.5, 5.0) and x[2, 403] == -1


def test_split_and_feed(spark):
    users = spark.createDataFrame([(f"u{i}", i % 7 + 1) for i in range(300)], "user_id string, n_rows long")
    parts = split.with_split(users).groupBy("split").count().collect()
    assert sum(r["count"] for r in parts) == 300 and 10 < {r.split: r["count"] for r in parts}["test"] < 60
    drawn = split.with_split(users, method="rand", seed=3)
    assert drawn.collect() == drawn.collect()
    rows = split.batches(users, 20, 3, 1).collect()
    lit = split.batches(users, 20, 3, 1, literal=True).collect()
    assert len(rows) == len(lit) == 300
    for got, greedy in ((rows, False), (lit, True)):
        for shard in range(3):
            batch = filled = before = 0
            for r in sorted((r for r in got if r.shard == shard), key=lambda r: r.feed_rank):
                assert r.batch_id == (batch if greedy else before // 20)
                before += r.n_rows
                filled += r.n_rows
                if filled > 20:
                    batch, filled = batch + 1, 0
    assert split.sample(users, 1.0).count() == 300
    assert split.epochs(users, 2, 0.5, 1, ["user_id"]).select("epoch").distinct().count() == 2


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(4000).select(F.concat(F.lit("u"), F.col("id") % 40).alias("user_id"), F.col("id").alias("event_id"))
    one, four, seven = (sorted(split.sample(df.repartition(n), 0.3, 5).collect()) for n in (1, 4, 7))
    assert one == four == seven and 1050 < len(one) < 1350 and len(set(one)) < len(one)
    epochs = split.epochs(df, 3, 0.3, 5).collect()
    assert sorted((r.user_id, r.event_id) for r in epochs if r.epoch == 0) == [tuple(r) for r in one]
    assert len({tuple(sorted(r.event_id for r in epochs if r.epoch == e)) for e in range(3)}) == 3


def test_events_of_several_records_have_keys_of_their_own(spark, tmp_path):
    lines = ["\t".join([str(i % 290), *[""] * 10, "", f"http://q.com/{i % 7}"]) for i in range(600)]
    src = spark.createDataFrame([("u", "\n".join(lines[:300])), ("u", "\n".join(lines[300:])), ("u", "\n".join(lines[:10])),
                                 ("v", lines[0] + "\nbad")], "user_id string, payload string")
    rows = P.prepare_events(spark, src, suffixes.suffixes(spark, SUFFIXES), str(tmp_path), keep="clean").collect()
    assert {r.user_id: sorted(e.event_id for e in r.events) for r in rows} == {"u": list(range(610)), "v": [0]}
    for r in rows:
        times = [e.ts_ms for e in sorted(r.events, key=lambda e: e.event_id)]
        assert times == sorted(times)
    counts = spark.read.parquet(f"{tmp_path}/line_counts").first()
    assert (counts.n_lines, counts.n_rejected) == (612, 1)


def test_events_with_one_key_are_refused(spark):
    feats = spark.createDataFrame([("a", [1.0])], "url string, features array<float>")
    ev = spark.createDataFrame([("u", 1, "a", "", "b"), ("u", 1, "b", "a", "a")],
                               "user_id string, event_id long, request_url string, referrer_url string, prev_url string")
    with pytest.raises(Exception, match="more than one event has the key u 1"):
        embeddings.event_features(ev, feats).collect()


def test_training_reads_no_vectors(spark, tmp_path):
    event = "struct<event_id:long,ts_ms:long,timestamp:double,request_url:string,request_vec:array<float>>"
    df = spark.createDataFrame([("u", 0, [(1, 2, 3.0, "a", [1.0])]), ("u", 1, None)], f"user_id string, part int, events array<{event}>")
    df.write.parquet(str(tmp_path / "r"))
    got = combined.events_of(spark.read.parquet(str(tmp_path / "r")), ["event_id", "ts_ms", "timestamp", "request_url"])
    assert [tuple(r) for r in got.collect()] == [("u", 1, 2, 3.0, "a")]
    scan = got._jdf.queryExecution().executedPlan().collectLeaves().head().requiredSchema().json()
    assert "request_url" in scan and "request_vec" not in scan


def test_votes_and_matrix(spark):
    pred = spark.createDataFrame([("u", 1, 3, 2), ("u", 1, 2, 2), ("u", 1, 2, 2), ("u", 1, 3, 2), ("u", 2, 0, 0)],
                                 "user_id string, visit_rank int, predicted int, actual int")
    assert {(r.visit_rank, r.referral) for r in evaluate.referral_votes(pred).collect()} == {(1, 2), (2, 0)}
    cells = evaluate.confusion(pred)
    assert cells.count() == 64 and cells.agg(F.sum("n")).first()[0] == 5
    assert math.isclose(evaluate.confusion_share(cells).agg(F.sum("share")).first()[0], 1.0)
    a = evaluate.accuracy(pred).first()
    assert (a.accuracy, a.n_samples) == (0.6, 5)
    assert evaluate.confusion_share(evaluate.confusion(pred.limit(0))).agg(F.sum("share")).first()[0] == 0
    votes = spark.createDataFrame([("u", 1, 2, 0), ("u", 1, 2, 0), ("u", 1, 1, 0), ("u", 2, 1, 1), ("u", 3, 2, 0), ("u", 3, 1, 0)],
                                  "user_id string, event_id long, visit_rank int, predicted int")
    assert {(r.event_id, r.voted_visit) for r in evaluate.visit_votes(votes).collect()} == {(1, 2), (2, 0), (3, 1)}
    scores = spark.createDataFrame([([0.1, 0.5, 0.5],)], "scores array<double>")
    assert evaluate.predicted_class(scores).first().predicted == 1


def test_fixture_is_the_same_for_hot_users(spark, sf):
    hot = X.hot_users(spark, sf, 10)
    assert hot.rows
    plain, cut = X.visits(spark, sf), X.visits(spark, sf, hot)
    assert plain.exceptAll(cut).count() == 0 and plain.count() == cut.count()


def test_jobs(spark, history, tmp_path):
    ev, vs = history
    root = str(tmp_path)
    rules = X.rules(spark)
    src = payloads(spark, "/root/testdata/sf0.001")
    done = P.prepare(spark, src, vs, rules, root, keep="clean")
    assert {f"split={s}" for s in ("train", "test")} == {p.name for p in (tmp_path / "combined").glob("split=*")}
    row = done.select(F.explode("events").alias("e")).select("e.*").first()
    assert len(row.request_vec) == len(row.href_vec) == len(row.prev_vec) == 201
    assert done.select("user_id").distinct().count() == ev.select("user_id").distinct().count()
    # The records give the same labels as the flat tables they came from.
    back = sequences.multi_visit(combined.events_of(done), combined.visits_of(done))
    flat = sequences.multi_visit(ev, V.visit_rows(vs))
    counts = lambda df: sorted((r.user_id, r.ts_ms, r.label) for r in df.collect())
    assert counts(back) == counts(flat)
    test, learn = (combined.read_combined(spark, f"{root}/combined", s) for s in ("test", "train"))
    model = T.train(spark, learn, test, "multi-visit", f"{root}/model", f"{root}/log", n_epochs=2, fraction=0.9, iterations=3)
    log = models.read_metrics(spark, f"{root}/log").collect()
    assert sorted(r.type for r in log) == ["batch", "batch", "epoch", "epoch"] and all(r.loss > 0 for r in log)
    cells, total = T.evaluate_model(test, "multi-visit", model)
    n = cells.agg(F.sum("n")).first()[0]
    assert n == total.first().n_samples > 0
    again = T.train(spark, learn, test, "multi-visit", f"{root}/model", f"{root}/log", fraction=1.0, iterations=3)
    assert len(again.weights) == len(model.weights)


@pytest.mark.parametrize("mode", ["visit", "multi-transfer"])
def test_other_modes_train(spark, history, mode):
    ev, vs = history
    samples = classifier.window_summary(sequences.learning_set(mode)(ev, V.visit_rows(vs))).cache()
    scored = classifier.score(samples, classifier.fit(samples, mode, iterations=2))
    assert scored.filter(F.size("scores") != 8).count() == 0 and classifier.losses(scored).first().loss > 0


def test_shown_rows_and_schema(spark):
    df = spark.createDataFrame([(2, [1], {"a": 1}, ([("x", 1)],)), (1, [], None, ([],))],
                               "k int, l array<int>, m map<string,int>, s struct<inner: array<struct<p: string, q: int>>>")
    got = combined.shown(df, ["k"], 1).orderBy("kind", "place").collect()
    assert [r.text for r in got] == ['{"k":1,"l":[],"s":{"inner":[]}}', "k int", "l array", "l[] int", "m map<string,int>",
                                     "s struct", "s.inner array", "s.inner[].p string", "s.inner[].q int"]
    assert [r.kind for r in combined.shown(df.limit(0), ["k"]).collect()] == ["schema"] * 8


def test_jobs_leave_a_preview_and_no_intermediate_results(spark, monkeypatch):
    stored, job = [], P.job

    def watched(*args, **options):
        stored.append(shared_names(spark))
        out = job(*args, **options)
        stored.append(shared_names(spark))
        return out

    monkeypatch.setattr(P, "job", watched)
    root, done = jobs._prepared(spark, "/root/testdata/sf0.001")
    place = (f"{root}/combined", "multi-transfer", f"{root}/model", f"{root}/log")
    T.train_job(spark, *place, iterations=2)
    assert T.evaluate_job(spark, *place).first().n_samples > 0
    assert stored == [shared_names(spark)] * 2
    first = spark.read.parquet(f"{root}/preview")
    rows = [json.loads(r.text) for r in first.filter("kind = 'row'").orderBy("place").collect()]
    want = [r.user_id for r in done.select("user_id", "part").orderBy("user_id", "part").limit(20).collect()]
    assert [r["user_id"] for r in rows] == want and all(r["visits"] for r in rows)
    assert first.filter("kind = 'schema' and text = 'visits[].timestamps[] double'").count() == 1


def _double_first():
    return lambda x: np.stack([x[:, 0], 2 * x[:, 0], np.zeros(len(x))], axis=1)


def test_external_model(spark):
    df = spark.createDataFrame([([0.5, 1.0],), ([0.0, 3.0],)], "inputs array<double>")
    got = {tuple(r.scores): r.predicted for r in classifier.score_external(df, _double_first).collect()}
    assert got == {(0.5, 1.0, 0.0): 1, (0.0, 0.0, 0.0): 0}


def test_page_links_cover_the_table(spark, sf):
    from visitweave.operators import links
    pages = X.table(spark, sf, "pages")
    edges = links.link_edges(pages, X.rules(spark))
    assert edges.count() == links.page_links(pages).count() > 0 and edges.filter("link_url is null").count() == 0


def test_other_time_zone(spark, sf):
    before = X.page_views(spark, sf).agg(F.sum("ts_ms")).first()[0]
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        assert X.page_views(spark, sf).agg(F.sum("ts_ms")).first()[0] == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_counted_sentences_are_those_of_every_occurrence(spark):
    rows = [("u", i, u, v, None) for i, (u, v) in enumerate([("http://x.com/a/b", ""), ("http://x.com/a/b", "http://y.com/c"), ("-", "http://x.com/a/b")])]
    ev = spark.createDataFrame(rows, "user_id string, event_id long, request_url string, referrer_url string, prev_url string")
    rules = suffixes.suffixes(spark, SUFFIXES)
    want = sorted(tuple(r.words) for r in embeddings.url_sentences(ev, rules).collect())
    counted = embeddings.counted_sentences(ev, rules).collect()
    assert len(counted) == 2 and sorted(tuple(r.words) for r in counted for _ in range(r.times)) == want


def test_sentences_that_count_are_like_so_many(spark):
    some = spark.createDataFrame([(["a", "b", "c"], 4), (["b", "a", "b"], 1), (["d"], 9)], "words array<string>, times long")
    all_ = some.select("words", F.explode(F.sequence(F.lit(1), "times")).alias("t")).select("words")
    pairs = lambda df, **k: sorted(map(tuple, cooccurrence.pair_counts(df, "words", **k).collect()))
    assert pairs(some, times="times") == pairs(all_)
    for method in ("word2vec", "cooccurrence"):
        found = embeddings.vector_table(embeddings.fit(some, size=4, times="times", method=method)).collect()
        assert {r.token for r in found} == {"a", "b", "d"}


def test_more_sightings_than_can_be_trained_on_are_counted_instead(spark, monkeypatch):
    df = spark.createDataFrame([(["a", "b", "c"], 1000)], "words array<string>, times long")
    assert embeddings.suits_word2vec(df, "words", 5, 8, 4, "times")
    monkeypatch.setattr(embeddings, "TRAINING_MOVES", 3000 * 8 * 4 - 1)
    assert not embeddings.suits_word2vec(df, "words", 5, 8, 4, "times")
    assert {r.token for r in embeddings.fit(df, size=4, times="times").collect()} == {"a", "b", "c"}


def test_vectors_of_a_user_are_shuffled_once(spark):
    feats = spark.createDataFrame([("a", [1.0]), ("", [0.0])], "url string, features array<float>")
    ev = spark.createDataFrame([("u", 1, "a", "", "a"), ("u", 2, "a", "a", None)],
                               "user_id string, event_id long, request_url string, referrer_url string, prev_url string")
    bags = lambda **k: embeddings.event_features(ev, feats, **k).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "request_vec", "href_vec", "prev_vec"))).alias("e"))
    plans = [bags(**k)._jdf.queryExecution().executedPlan().toString() for k in ({}, {"near": "user_id"})]
    assert plans[1].count("Exchange hashpartitioning(user_id") == 1 < plans[0].count("Exchange hashpartitioning(user_id")
    assert bags(near="user_id").collect() == bags().collect()


def test_an_embedding_without_a_model_is_loaded_as_its_table(spark, tmp_path):
    df = spark.createDataFrame([(["a", "b", "c"],)] * 6, "words array<string>")
    path, known = str(tmp_path / "v"), {"a", "b", "c"}
    for method in ("cooccurrence", "word2vec", "cooccurrence"):
        models.save_embedding(embeddings.fit(df, size=4, method=method), path)
        back = models.load_embedding(path)
        assert isinstance(back, embeddings.DataFrame) == (method == "cooccurrence")
        assert {r.token for r in embeddings.vector_table(back).collect()} == known
        assert {r.token for r in models.load_vectors(spark, path).collect()} == known


def test_a_vector_travels_once_for_all_events_of_a_user(spark):
    feats = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("c", None), ("", [0.0])], "url string, features array<float>")
    names, urls_ = ("u", "v", None), ("a", "b", "c", "x", "", None)
    rows = [(n, i, i / 2, urls_[i % 6], urls_[i * 5 % 6], urls_[(i + 2) % 3]) for n in names for i in range(60)]
    ev = spark.createDataFrame(rows, "user_id string, event_id long, timestamp double, request_url string, referrer_url string, prev_url string")
    near, plain = (embeddings.event_features(ev, feats, **k) for k in ({"near": "user_id"}, {}))
    assert near.columns == plain.columns and sorted(map(str, near.collect())) == sorted(map(str, plain.collect()))
    assert near.count() == len(rows)
    bags = near.groupBy("user_id").agg(F.collect_list(F.struct("event_id", "request_vec")).alias("e"))
    assert bags._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(user_id") == 1
    assert embeddings.event_features(spark.createDataFrame([], ev.schema), feats, "user_id").collect() == []
    for key in (("u", 7), (None, 7)):
        twice = ev.union(spark.createDataFrame([(*key, 0.0, "a", "", "b")], ev.schema))
        with pytest.raises(Exception, match="more than one event has the key"):
            embeddings.event_features(twice, feats, "user_id").collect()


def test_vectors_are_told_apart_by_user_before_they_are_shuffled(spark):
    feats = spark.createDataFrame([("a", [1.0]), ("", [0.0])], "url string, features array<float>")
    ev = spark.createDataFrame([("u", i, "a", "a", "a") for i in range(50)],
                               "user_id string, event_id long, request_url string, referrer_url string, prev_url string")
    plan = embeddings.event_features(ev, feats, "user_id")._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join"):]
    assert "Aggregate [url" in joined and "collect_list" not in joined
