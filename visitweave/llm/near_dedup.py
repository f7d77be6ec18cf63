"""Near-duplicate documents by MinHash, with odd sketches to sift the candidates.

A document's set holds its distinct shingles of three (or ``width``) words, as 64-bit hashes.  MinHash samples of
the set are cut into bands; documents that share a band are candidates.  The samples are also
folded into a parity bitmap (odd sketch): the bits in which two bitmaps differ tell how many
samples differ, which estimates high similarities well, so that most false candidates go
before full sets are compared.  Every link is confirmed on full sets.

Copies with equal sets stand as one.  Within a band's bucket each member is first compared with
one hub; only members that are then still in another component than their bucket, and that have
enough shingles in common with others at all, are compared with the other members.  So a large
group of near copies never gives all its pairs.

Defined results: a null or blank text has an empty set and is linked with nothing; fewer words
than a shingle has are one shingle; every row is a document, so texts that share a doc_id are told apart and
repeated rows are copies; a document without doc_id is linked like others, but names no component while
another of the group has one (a group of such documents only has a null ``component_id``); an empty table gives
an empty result; further columns are left alone.
"""

from __future__ import annotations

from math import exp, floor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitweave.llm.common import attach, durable, sift, small_batches, table
from visitweave.llm.components import components
from visitweave.llm.registry import query

SAMPLES = 512                     # all go into the odd sketch
BANDED = 256                      # the first ones go into bands
ROWS = 8                          # samples a band: a pair at 0.85 is missed once in 26,000
LOOSE_ROWS = 6                    # for lower similarities: a pair at 0.8 is missed once in 300,000
SKETCH_BITS = 1024
#: Links have at least this similarity, in hundredths.
LINK = 85
#: Candidates whose estimate is lower by more than this share of the distance to 1 are not compared
#: (over four standard errors).
MARGIN = 0.5
#: Word hashes a worker remembers.
KNOWN_WORDS = 100_000

_draw = np.random.default_rng(20240501)
_FACTORS = _draw.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SHIFTS = _draw.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_PLACES = _draw.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLOTS = _draw.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers over the result."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Hashes(dict):
    def __missing__(self, word):
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KNOWN_WORDS:
            self[word] = value
        return value


def shingles(text: str | None, known: dict | None = None, width: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()   # bytes: A-Z and ASCII spaces only
    known = _Hashes() if known is None else known
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(w) - width + 1
    if n > 0:
        return np.unique(mix(sum(w[i:i + n] * _PLACES[i] for i in range(width))))
    return mix((w * _PLACES[:len(w)]).sum(keepdims=True) + np.uint64(len(w))) if len(w) else w


def samples(found: np.ndarray) -> np.ndarray:
    """MinHash samples of a set of 64-bit hashes."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):   # a block fits the cache
        np.minimum(least, (x[at:at + 512, None] * _FACTORS + _SHIFTS).min(0), out=least)
    return least


def bands(least: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A bucket number per band of ``rows`` samples."""
    n = BANDED // rows * rows
    whole = mix((least[:n].astype(np.uint64) + np.uint64(1)) * _SLOTS[:n]).reshape(-1, rows)
    return mix(np.bitwise_xor.reduce(whole, axis=1)).view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as 64-bit numbers."""
    bits = mix((least.astype(np.uint64) + np.uint64(7)) * _SLOTS) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def estimate(differing: float) -> float:
    """Similarity that so many differing bits stand for."""
    return 1 + SKETCH_BITS / (4 * SAMPLES) * float(np.log(max(1e-9, 1 - 2 * differing / SKETCH_BITS)))


def most_bits(similarity: float) -> int:
    """The number of differing bits at which the estimate falls below ``similarity``."""
    return floor(SKETCH_BITS / 2 * (1 - exp((similarity - 1) * 4 * SAMPLES / SKETCH_BITS)))


def _column(rows, kind):
    return pa.array([x.tolist() for x in rows], pa.list_(kind))


#: What tells rows apart, besides doc_id: two hashes of the text.
TEXT = ["text1", "text2"]
#: The doc_id of a row, which orders null last.
KEYS = ["unnamed", "doc_id", *TEXT]


def named(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the hashes of the text and whether there is no doc_id."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select("*", *[F.xxhash64(F.lit(i + 1), whole).alias(c) for i, c in enumerate(TEXT)],
                       F.col("doc_id").isNull().alias("unnamed"))


def sketches(docs: DataFrame, rows: int = ROWS, width: int = 3) -> DataFrame:
    """``doc_id, text1, text2, n_shingles, key, bands, odd``; the key stands for the whole set, null for an empty one."""
    small_batches(docs.sparkSession)

    def sketch(batches):
        known = _Hashes()
        for batch in batches:
            sets = [shingles(x, known, width) for x in batch.column(4).to_pylist()]
            least = [samples(x) for x in sets]
            keys = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary()),
                 _column((bands(x, rows) for x in least), pa.int64()), _column(map(odd_sketch, least), pa.int64())],
                [*KEYS, "n_shingles", "key", "bands", "odd"])
    return named(docs.select(F.col("doc_id").cast("long"), "text")).select(*KEYS, "text").mapInArrow(
        sketch, "unnamed boolean, doc_id long, text1 long, text2 long, n_shingles long, key binary, bands array<long>, "
                "odd array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int = 3) -> DataFrame:
    """``wanted(node, doc, text1, text2, key)`` with the full set of each ``node`` as ``items``.

    Rows that are not wanted leave before any text is shuffled; of equal rows one task sends one.
    """
    of_row = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), *TEXT, "text"]
    near = sift(named(docs.select("doc_id", "text")).select(*of_row), wanted, ["doc", *TEXT])
    texts = near.groupBy("doc", *TEXT).agg(F.first("text").alias("text")).join(
        wanted.select("node", "key", "doc", *TEXT), ["doc", *TEXT]).select("node", "text", "key")

    def sets(batches):
        known = _Hashes()
        for batch in batches:
            found = [shingles(x, known, width) for x in batch.column(1).to_pylist()]
            own = [len(x) > 0 and xxhash.xxh3_128_digest(x.tobytes()) == k
                   for x, k in zip(found, batch.column(2).to_pylist())]
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), _column((x.view(np.int64) for x in found), pa.int64())], ["node", "items"])
            yield out.filter(pa.array(own, pa.bool_()))
    return texts.mapInArrow(sets, "node long, items array<long>")


def differing_bits(a: str, b: str) -> Column:
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0))


def _close(a: str, b: str, link: int) -> Column:
    """Sizes and sketches allow a link."""
    na, nb = F.col(f"{a}_n"), F.col(f"{b}_n")
    return ((100 * F.least(na, nb) >= link * F.greatest(na, nb))
            & (differing_bits(f"{a}_odd", f"{b}_odd") <= most_bits(link / 100 - MARGIN * (1 - link / 100))))


def confirmed(pairs: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias(f"{x}_items"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("a_items", "b_items"))
    return both.filter(100 * common >= link * (F.size("a_items") + F.size("b_items") - common)).select("a", "b")


def _sided(x: str, *columns: str) -> list[Column]:
    return [F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in columns]]


def _with_most(open_: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """Add ``most``, how many shingles of a document another of ``open_`` can have, and leave out hopeless rows.

    A shingle that no other of these documents has can't be common to two of them.  Whoever has
    too few others for a link with the smallest set that could match goes.
    """
    items = sets.join(open_.select("node").distinct(), "node").select("node", F.explode("items").alias("item"))
    alone = (items.groupBy("item").agg(F.count(F.lit(1)).alias("holders"), F.max("node").alias("node"))
             .filter("holders = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone")))
    known = open_.join(alone, "node", "left").withColumn("most", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    return known.filter(100 * F.col("most") >= link * F.col("n"))


def links(docs: DataFrame, nodes: DataFrame, link: int = LINK, width: int = 3) -> tuple[DataFrame, DataFrame | None]:
    """Confirmed links between ``nodes(node, key, doc, text1, text2, n, bands, odd)`` and, if there are any, their components."""
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = durable(spread.join(shared, "bucket"))
    # Who shares most buckets with most others is the likeliest to be linked with them.
    reach = durable(members.groupBy("node").agg(F.sum("size").alias("reach"))
                    .join(nodes.select("node", "key", "doc", *TEXT, "n", "odd", "bands"), "node"))
    sets = durable(full_sets(docs, reach, width))
    placed = members.join(reach.select("node", "reach"), "node")
    top = F.max(F.struct("reach", (-F.col("node")).alias("minus")))
    hubs = placed.groupBy("bucket").agg(top.alias("top")).select(
        "bucket", (-F.col("top.minus")).alias("hub"), F.col("top.reach").alias("hub_reach"))
    tried = (placed.join(hubs, "bucket").filter(F.col("node") != F.col("hub"))
             .groupBy("node").agg(F.max(F.struct("hub_reach", (-F.col("hub")).alias("minus"))).alias("best"))
             .select(F.col("node").alias("a"), (-F.col("best.minus")).alias("b")))
    sifted = (tried.join(reach.select(*_sided("a", "n", "odd")), "a")
              .join(reach.select(*_sided("b", "n", "odd")), "b").filter(_close("a", "b", link)))
    first = durable(confirmed(sifted, sets, link))
    found = components(first)
    # Buckets whose members are not all in one component by now.
    known = (members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
             .join(hubs, "bucket"))
    mixed = known.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                        F.max(F.when(F.col("node") == F.col("hub"), F.col("component"))).alias("main"))
    open_ = durable(known.join(mixed.filter("low < high").select("bucket", "main"), "bucket")
                    .select("bucket", "node", "component", (F.col("component") == F.col("main")).alias("in_main"))
                    .join(reach.select("node", "n", "odd", "bands"), "node"))
    open_ = durable(_with_most(open_, sets, link))
    left = open_.filter("not in_main").select("bucket", *_sided("a", "component", "n", "odd", "most", "bands"))
    right = open_.select("bucket", "in_main", *_sided("b", "component", "n", "odd", "most", "bands"))
    enough = (100 + link) * F.least("a_most", "b_most") >= link * (F.col("a_n") + F.col("b_n"))
    # Of the buckets that a pair shares, the first one gives it.
    once = F.get(F.array_intersect("a_bands", "b_bands"), F.lit(0)) == left["bucket"]
    rest = left.join(right, (left["bucket"] == right["bucket"]) & (F.col("a_component") != F.col("b_component"))
                     & (F.col("in_main") | (F.col("a") < F.col("b"))) & enough & _close("a", "b", link) & once
                     ).select("a", "b").distinct()
    second = durable(confirmed(rest, sets, link))
    if second.isEmpty():
        return first, found
    every = first.union(second)
    return every, components(every)


def grouped(docs: DataFrame, link: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Documents ``doc_id, text1, text2, n_shingles, key``, and per key ``head``, the first document of its group."""
    drawn = durable(sketches(docs, ROWS if link >= LINK else LOOSE_ROWS, width))
    nodes = durable(drawn.filter("key is not null").groupBy("key").agg(
        F.min(F.struct(*KEYS, "n_shingles", "bands", "odd")).alias("x"), F.count(F.lit(1)).alias("copies")).select(
        F.monotonically_increasing_id().alias("node"), "key", "copies", F.struct(*[f"x.{c}" for c in KEYS]).alias("row"),
        F.coalesce("x.doc_id", F.lit(-(1 << 63))).alias("doc"), "x.text1", "x.text2", F.col("x.n_shingles").alias("n"),
        F.col("x.bands").alias("bands"), F.col("x.odd").alias("odd")))
    _, found = links(docs, nodes, link, width)
    linked = durable(nodes.select("node", "key", "copies", "row").join(found, "node"))
    heads = linked.groupBy("component").agg(F.min("row").alias("head"), F.count(F.lit(1)).alias("size"))
    grouped_ = attach(linked, durable(heads), ["component"], "size", linked.count()).select("key", "copies", "head")
    alone = nodes.join(found, "node", "left_anti").select("key", "copies", F.col("row").alias("head"))
    return drawn.drop("bands", "odd"), durable(grouped_.union(alone))


def duplicates(docs: DataFrame, link: int = LINK, width: int = 3) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document, by shingles of ``width`` words."""
    drawn, heads = grouped(docs, link, width)
    placed = attach(drawn.filter("key is not null"), heads, ["key"], "copies", drawn.count())
    out = ["doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept")]
    return (placed.withColumn("component_id", F.col("head.doc_id")).select(*out)
            .union(drawn.filter("key is null").withColumn("component_id", F.col("doc_id")).select(*out)))


def keep(docs: DataFrame, link: int = LINK, width: int = 3) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest doc_id; columns unchanged.

    All rows without words stay.  Only rows that leave are looked up, so the others are not shuffled.
    """
    drawn, heads = grouped(docs, link, width)
    row = [F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_doc"), F.col("text1").alias("_text1"), F.col("text2").alias("_text2")]
    names = ["_doc", "_text1", "_text2"]
    placed = attach(drawn.filter("key is not null"), heads, ["key"], "copies", drawn.count())
    first = F.struct(*KEYS) == F.col("head")
    left = durable(placed.withColumn("first", first).select(*row, "first").groupBy(*names).agg(
        F.first("first").alias("first"), F.count(F.lit(1)).alias("times")).filter("not first or times > 1"))
    marked = docs.select(
        "*", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_doc"),
        *[F.xxhash64(F.lit(i + 1), F.coalesce("text", F.lit(""))).alias(f"_{c}") for i, c in enumerate(TEXT)])
    stay = sift(marked, left, names, inside=False)
    # What the sift could not tell: rows that share a place in its bitmap, and the one row to stay of repeated ones.
    rest = sift(marked, left, names).join(left, names, "left")
    again = rest.filter("first").dropDuplicates(names)
    return stay.unionByName(rest.filter("first is null").drop("first", "times")).unionByName(
        again.drop("first", "times")).select(*docs.columns)


OP9_SQL = """
with recursive d as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
s as (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end) as x
  from d),
n as (select doc_id, count(*) as n from s group by doc_id),
e as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
t as (
  select a, b from e join n p on p.doc_id = a join n q on q.doc_id = b where 100 * k >= 85 * (p.n + q.n - k)),
r as (select doc_id, doc_id as c from documents union select t.b, r.c from r join t on t.a = r.doc_id),
z as (select doc_id, min(c) as c from r group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, z.c as component_id, z.c = d.doc_id as kept
from d left join n using (doc_id) join z using (doc_id)
"""


@query("op9_odd_sketches", OP9_SQL)
def op9_odd_sketches(spark, sf_dir):
    """Near-duplicate components of all documents."""
    return duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
