"""WARC round trips with traps in payloads, and the pipeline stage by stage."""

import os
import random
from base64 import b32encode
from hashlib import sha1
from zlib import crc32

import numpy as np
import pytest

import corpus_pipeline as C
from tests.llm.helpers import PROSE, documents, odd_documents, shingle_set, smallest_reachable
from tests.llm.test_tokens import LIBRARY, plain_ids
from visitweave.llm import packing as P, quality_rules as Q, warc as W, weak_labels as L
from visitweave.llm.common import fresh_path, shared_dir

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: {}\r\n\r\n"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "s", 1) for i, u, h in rows],
                                 "page_id long, url string, html string, sha string, first int")


def trapped():
    # The last fake record ends where its host ends, so its successor is a true record.
    return [(1, "http://a\r\nb", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""),
            (5, "u", FAKE.format(0) + "\r\n\r\n tail"), (6, "u", "a" + FAKE.format(4) + "abcd"), (7, "u", "é😀" * 5000),
            *[(100 + i, "u", "y" * (i * 700) + "WARC/1.1\r\n" * i) for i in range(40)]]


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("split_bytes", [700, 1 << 20])
def test_round_trip(spark, compress, split_bytes):
    rows = trapped()
    manifest = W.write_archives(pages(spark, rows), fresh_path(spark, "warc"), compress=compress, archive_bytes=60_000)
    got = {r.page_id: r for r in W.read_archives(manifest, split_bytes).collect()}
    first = {}
    for i, _, html in rows:
        first.setdefault(html or "", i)
    assert sorted(got) == [i for i, _, _ in rows]
    for i, _, html in rows:
        data, r = (html or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), b32encode(sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[html or ""] == i else ("revisit", first[html or ""]))
    if not compress:   # the traps were candidates
        assert W.candidates(manifest, split_bytes).count() > len(rows) + manifest.count()


@pytest.mark.parametrize("compress, n", [(True, 70_000), (False, 65_500), (False, 400_000)])
def test_heads_of_any_length(spark, compress, n):
    df = pages(spark, [(1, "http://x.com/" + "a" * n, "one"), (2, "http://x.com/b", "two"), (3, None, "WARC/1.0\r\nno: head " * 9)])
    got = W.read_archives(W.write_archives(df, fresh_path(spark, "warc"), compress=compress), 50_000).collect()
    assert {(r.page_id, r.payload_bytes) for r in got} == {(1, 3), (2, 3), (3, 9 * len("WARC/1.0\r\nno: head "))}


def test_small_payloads_are_never_revisits(spark):
    manifest = W.write_archives(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]),
                                fresh_path(spark, "warc"), least=3)
    assert {r.page_id for r in W.read_archives(manifest).filter("record_type = 'revisit'").collect()} == {4}


def test_a_torn_archive_is_an_error(spark):
    manifest = W.write_archives(pages(spark, trapped()), fresh_path(spark, "warc"), compress=False)
    longer = manifest.withColumn("bytes", manifest["bytes"] + 1)
    with pytest.raises(ValueError, match="breaks off"):
        W.read_archives(longer)


def test_no_pages(spark):
    assert W.read_archives(W.write_archives(pages(spark, []), fresh_path(spark, "warc"))).count() == 0


def test_stages_against_brute_force(spark):
    """Each stage on what the one before kept, by plain Python."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [name for name, _ in C.STAGES]
    assert names == ["quality rules", "quality classifier", "near duplicates", "packing"]

    def texts(df):
        return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    stage = {n: f(spark, docs, sf) if n == names[0] else None for n, f in C.STAGES}
    kept = stage[names[0]]
    assert kept.schema == docs.schema
    verdict = {r.doc_id: r.kept for r in Q.op6_quality_cascade(spark, sf).collect()}   # equal to SQL, tested elsewhere
    assert set(texts(kept)) == {i for i, k in verdict.items() if k}

    good = C.classifier_stage(spark, kept, sf)
    assert good.schema == docs.schema
    _, scorer = L.fit(kept)
    plain = {i for i, t in texts(kept).items()
             if 1 / (1 + np.exp(-(sum(scorer.weights[a] * s for a, s in zip(*L.features(t))) + scorer.bias))) >= 0.5}
    assert set(texts(good)) == plain

    single = C.dedup_stage(spark, good, sf)
    assert single.schema == docs.schema
    groups = smallest_reachable({i: shingle_set(t, 5) for i, t in texts(good).items()}, 80)
    assert set(texts(single)) == {i for i, c in groups.items() if i == c}

    packed = C.packing_stage(spark, single, sf).collect()
    want = {i: plain_ids(LIBRARY, t, P.END_ID) for i, t in texts(single).items()}
    assert sum(p.length for p in packed) == sum(map(len, want.values()))
    assert all(p.ids_crc32 == crc32(want[p.doc_id][p.start:p.start + p.length].tobytes()) for p in packed)


def test_run_is_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, sf)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    assert sorted(C.run(spark, sf).select(*key).collect()) == sorted(docs.select(*key).collect())
    left = set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before
    assert len(left) == len(C.STAGES) and all(name.startswith("stage-") for name in left)


def test_stages_on_odd_and_no_documents(spark):
    for df in (odd_documents(spark), odd_documents(spark).limit(0), documents(spark, [(1, PROSE * 3), (2, PROSE * 3)])):
        for name, stage in C.STAGES:
            out = stage(spark, df, "")
            assert out.count() <= max(df.count(), 60) and (name == "packing" or out.columns == df.columns)


def test_classifier_removes_what_the_rules_leave(spark):
    """Strings of made-up words pass every rule; the scorer learns from the labellers that they are bad."""
    draw = random.Random(5)
    made_up = lambda: "".join(draw.choice("bcdfgklmnprst") + draw.choice("aeiou") for _ in range(draw.randint(2, 5)))
    junk = [(1_000_000 + i, " ".join(made_up() for _ in range(draw.randint(80, 200)))) for i in range(200)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = docs.unionByName(documents(spark, junk), allowMissingColumns=True).select(docs.columns)
    left = C.quality_stage(spark, both, "")
    assert left.filter("doc_id >= 1000000").count() == 200
    kept = C.classifier_stage(spark, left, "")
    assert kept.filter("doc_id >= 1000000").count() == 0
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1").select("doc_id")
    clean = left.join(labels, "doc_id", "left_semi")
    assert clean.count() > 0 and clean.join(kept, "doc_id", "left_anti").count() == 0


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    failed = Q.op6_quality_cascade(spark, sf).filter("base_failed").select("doc_id")
    clean = docs.join(labels.filter("quality = 1"), "doc_id", "left_semi").join(failed, "doc_id", "left_anti").select("doc_id")
    kept = C.classifier_stage(spark, C.quality_stage(spark, docs, sf), sf)
    assert clean.join(kept, "doc_id", "left_anti").count() == 0
