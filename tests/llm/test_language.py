"""Language identification: frozen code lengths by brute force, held-out accuracy, odd cases."""

from collections import Counter, defaultdict
from math import log2

import numpy as np

from tests.llm.helpers import documents, odd_documents
from visitweave.llm import language_id as L

TEXTS = [("en", "the cat and the hat"), ("en", "that was then"), ("fr", "le chat et la hache"), ("fr", "été passé")]


def plain_length(training, text):
    """Bits of ``text`` by walking the context tree symbol by symbol."""
    alphabet = sorted({b for _, t in TEXTS for b in t.encode()})
    counts = [defaultdict(Counter) for _ in range(4)]
    for t in training:
        s = [None] * 3 + list(t.encode())
        for i in range(3, len(s)):
            for k in range(4):
                counts[k][tuple(s[i - k:i])][s[i]] += 1

    def chances(context):
        k = len(context)
        size = len(alphabet) + 1
        if k == 0 and not counts[0][()]:
            known, shorter = Counter(), None
        known = counts[k][context]
        shorter = chances(context[1:]) if k else {b: 1 / (size + 255) for b in alphabet} | {"new": 1 - len(alphabet) / (size + 255)}
        n, d = sum(known.values()), len(known)
        left = {b: p for b, p in shorter.items() if b not in known}
        if not known:
            return shorter
        return {b: c / (n + d) for b, c in known.items()} | {b: d / (n + d) * p / sum(left.values()) for b, p in left.items()}
    s = [None] * 3 + [b if b in alphabet else "new" for b in text.encode()]
    return -sum(log2(chances(tuple(None if x == "new" else x for x in s[i - 3:i]))[s[i]]) for i in range(3, len(s)))


def test_code_lengths_by_brute_force(spark):
    df = documents(spark, [(i, t, lang) for i, (lang, t) in enumerate(TEXTS)]).select("text", "lang")
    model = L.fit(df)
    n = len(model.short)
    assert model.languages == ["en", "fr"]
    for before in ("the", "xyz", "ét", "ha", ""):
        # Costs of all symbols after one history: their chances add up to one.
        start = np.concatenate([[0] * L.ORDER, model.symbol[np.frombuffer(before.encode(), np.uint8)]])[-L.ORDER:]
        every = [model.cost(np.append(start, x).astype(np.int64)) for x in range(n)]
        assert np.allclose(np.exp2(-np.array(every)).sum(0), 1)
    for text in ("the chat", "été", "zebra", "x", "the hat the hat été passé quickly"):
        want = [plain_length([t for lang, t in TEXTS if lang == x], text) for x in model.languages]
        assert np.abs(model.lengths([text])[0] - want).max() < 1e-2


def test_lengths_do_not_depend_on_the_batch(spark):
    model = L.fit(documents(spark, [(i, t, lang) for i, (lang, t) in enumerate(TEXTS)]).select("text", "lang"))
    texts = ["the", "", "été le chat", "x" * 5000]
    assert np.allclose(model.lengths(texts), np.concatenate([model.lengths([t]) for t in texts]))


def test_long_texts_are_coded_in_parts(spark, monkeypatch):
    model = L.fit(documents(spark, [(i, t, lang) for i, (lang, t) in enumerate(TEXTS)]).select("text", "lang"))
    text = "the chat été " * 40
    whole = model.lengths([text])
    monkeypatch.setattr(L, "CODED", 7)
    assert np.allclose(model.lengths([text]), whole)


def test_training_texts_are_those_with_the_smallest_hashes(spark):
    df = documents(spark, [(i, f"text {i % 700}", "en" if i % 3 else "fr") for i in range(2100)]).select("text", "lang")
    rows = df.distinct().selectExpr("lang", "text", "xxhash64(text) as h").collect()
    want = {(lang, r.text) for lang in ("en", "fr") for r in sorted((r for r in rows if r.lang == lang), key=lambda r: r.h)[:50]}
    assert {(r.lang, r.text) for r in L.training_texts(df, 50).collect()} == want


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = L.op1_ppm_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 1000 and 0.2 < got.held_out.mean() < 0.3
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.99


def test_odd_documents(spark):
    model = L.fit(documents(spark, [(i, t, lang) for i, (lang, t) in enumerate(TEXTS)]).select("text", "lang"))
    df = odd_documents(spark).withColumn("held_out", L.held_out())
    got = L.predict(df, model).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert all(r.lang_pred in ("en", "fr") for r in got if r.doc_id not in (1, 2, 3))
    assert {r.lang_pred for r in L.predict(df, None).collect()} == {"und"}
    assert L.fit(df.limit(0).select("text", "lang")) is None and L.predict(df.limit(0), model).count() == 0


def test_nothing_is_learnt_from_rows_without_language(spark):
    assert L.fit(documents(spark, [(1, "abc", None)]).select("text", "lang")) is None
