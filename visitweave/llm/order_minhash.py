"""Document fingerprints that feel edits: order MinHash.

A text's k-mers are numbered by occurrence, so a repeated one counts each time.  Each of many
hash functions picks the few smallest of them; the picked k-mers, in the order of the text,
are hashed to one entry of the fingerprint.  Two fingerprints agree in an entry when the same
k-mers were picked in the same order, so moving text about lowers their likeness as well as
changing it.

Defined results: a null text counts as empty; a text shorter than a k-mer is one; equal texts
(and two empty ones) have equal fingerprints; rows that share a doc_id follow one another in the
order of a hash of their text; a single document is its own next one; an empty table gives an
empty result; further columns are left alone.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitweave.llm.common import RANGE_BYTES, durable, range_numbers, ranges_for, small_batches, table
from visitweave.llm.registry import query

K, PICKED, ENTRIES = 8, 2, 64     # k is a power of two
BLOCK = 4_096

_draw = np.random.default_rng(20240717)
_FACTORS = (_draw.integers(0, 1 << 32, ENTRIES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_BASE = int(_draw.integers(1 << 40, 1 << 62)) | 1
_TURN = np.uint64(int(_draw.integers(1 << 40, 1 << 62)) | 1)
_LAST = np.uint32(0xFFFFFFFF)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def kmers(text: str) -> np.ndarray:
    """Hash of every k-mer of code points, in text order."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if 0 < len(h) < K:
        h = np.concatenate([h, np.zeros(K - len(h), np.uint64)])   # zeros stand for no character
    size = 1
    while size < K and len(h):   # twice the length from two halves
        h = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
    return _spread(h)


def occurrences(h: np.ndarray) -> np.ndarray:
    """How many equal values came before each."""
    low = np.uint64((1 << len(h).bit_length()) - 1)
    sorted_ = np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64))   # equal values by place
    fresh = np.concatenate([[True], (sorted_[1:] ^ sorted_[:-1]) > low])
    n = np.arange(len(h))
    out = np.empty(len(h), np.uint64)
    out[(sorted_ & low).astype(np.int64)] = n - np.maximum.accumulate(np.where(fresh, n, 0))
    return out


def picked(numbered: np.ndarray) -> np.ndarray:
    """Places of the smallest numbered k-mers under every hash function, in text order."""
    x = (numbered >> np.uint64(32)).astype(np.uint32)
    rows, values, places = np.arange(ENTRIES), [], []
    for at in range(0, len(x), BLOCK):   # a block of all hash functions fits the cache
        v = x[at:at + BLOCK] * _FACTORS
        for _ in range(min(PICKED, v.shape[1])):
            j = v.argmin(1)
            values.append(v[rows, j])
            places.append(j + at)
            v[rows, j] = _LAST
    values, places = np.stack(values, 1), np.stack(places, 1)
    best = np.lexsort((places, values), axis=1)[:, :PICKED]
    return np.sort(np.take_along_axis(places, best, 1), axis=1)


def fingerprint(text: str | None) -> np.ndarray:
    """One 16-bit entry per hash function."""
    h = kmers(text or "")
    total = np.full(ENTRIES, np.uint64(len(h) < PICKED))
    if len(h):
        at = picked(_spread(h + occurrences(h) * _TURN))
        for i in range(at.shape[1]):
            total = _spread(total * _TURN + h[at[:, i]])
    return (total >> np.uint64(48)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries."""
    return float((a == b).mean())


def in_order(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``doc_id, text, _range, _next`` sorted within partitions, a range of doc_id in each.

    After its documents every range holds the first one of the next range once more, marked
    ``_next`` (after the last range, that of the first).
    """
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    parts = ranges_for(own, range_bytes)
    dealt = range_numbers(own, "doc_id", parts).withColumn("_h", F.xxhash64("text")).withColumn("_null", F.col("doc_id").isNull())
    firsts = dealt.groupBy("_range").agg(F.min(F.struct("_null", "doc_id", "_h")).alias("first"))
    # One row per range, of which there are a few thousand at most.
    every, up = Window.partitionBy(), Window.orderBy("_range")
    firsts = durable(firsts.select(
        F.col("_range").alias("_at"), "first",
        F.coalesce(F.lag("_range").over(up), F.max("_range").over(every)).alias("_before")))
    tails = dealt.join(firsts, (dealt["_range"] == firsts["_at"]) & F.struct("_null", "doc_id", "_h").eqNullSafe(F.col("first")))
    both = dealt.withColumn("_next", F.lit(False)).unionByName(
        tails.select("doc_id", "text", F.col("_before").alias("_range"), "_h", "_null", F.lit(True).alias("_next")))
    return (both.repartitionById(parts + 1, F.col("_range"))
            .sortWithinPartitions("_range", "_next", "_null", "doc_id", "_h").select("doc_id", "text", "_range", "_next"))


def fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to the next document's."""
    small_batches(docs.sparkSession)

    def run(batches):
        held = None
        for batch in batches:
            rows = []
            for doc_id, text, _, tail in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None and tail:
                    continue          # the first one of the next range may be repeated
                mark = fingerprint(text)
                if held is not None:
                    rows.append(_row(*held, text, mark))
                held = None if tail else (doc_id, text, mark)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
              " near_edited double, near_next double")
    return in_order(docs, range_bytes).mapInArrow(run, schema)


def _row(doc_id, text, mark, next_text, next_mark):
    n, cut = len(text), len(text) // 4
    edited = text[:n - cut] + next_text[:cut]
    other = fingerprint(edited)
    return (doc_id, n, sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark.tobytes().hex(),
            other.tobytes().hex(), likeness(mark, other), likeness(mark, next_mark))


@query("op5_order_minhash")
def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of all documents and of their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
