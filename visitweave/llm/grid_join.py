"""Near-duplicate vectors by an epsilon grid order join.

Vectors of unit length with a cosine of c or more lie within eps = sqrt(2 - 2c) of each other, and
so do their coordinates on the leading principal axes.  Vectors are sorted by label and by
the cells of a grid of side eps on those axes.  The sorted sequence is cut into blocks, each with a
bounding box.  Pairs of intervals of blocks are joined from the whole sequence downwards: a pair whose boxes
are more than eps apart is dropped with all that is in it, any other is replaced by the pairs of its parts.
Tasks go on in the same way inside the remaining pairs of blocks, down to runs of ``LEAF`` vectors, whose
cosines are computed in double precision.

Equal vectors stand as one with a weight.  A pair of blocks gives a count of links per vector and the few
links that join its components, never all its links, so a large group of near copies stays small; what is
compared is only what boxes can't tell apart.  The axes are fitted on a bounded sample (``AXES_ROWS``);
they decide the speed, not the result.

Defined results: a vector without vec_id or label, a null or empty one, one of zeros only or with a
null or non-finite component is linked with nothing and its own component; vectors of different length
are not linked; repeated rows are vectors of their own, linked with each other; an empty table gives an
empty result; further columns are left alone.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitweave.llm.common import attach, durable, hash_share, numbered, table
from visitweave.llm.components import components
from visitweave.llm.registry import query

LIMIT = 0.98
#: Principal axes on which cells and boxes are taken.
AXES = 16
#: Vectors, and numbers in them, from which the axes are fitted.
AXES_ROWS, AXES_VALUES = 20_000, 2_000_000
#: Vectors, and numbers in them, of a block.
BLOCK_ROWS, BLOCK_VALUES = 4_096, 1 << 19
#: Vectors of the smallest interval.
LEAF = 128
#: Parts of an interval of blocks.
FAN = 16
#: Numbers of one batch that are turned at once.
TURNED = 1 << 21
#: Cosines as near to the limit as this are computed again by the plain formula.
CLOSE = 1e-9
PLACED = "label string, dims int, node long, weight long, vec binary, cells array<int>, along double"
BLOCK = ("block long, label string, dims int, low array<double>, high array<double>, nodes binary, weights binary, "
         "vecs binary, parts binary, counts binary, links binary")
FOUND = "node long, n_links long, other long"


def usable(vec: Column) -> Column:
    """A vector that has a direction."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vec, finite) & F.exists(vec, lambda x: x != 0), F.lit(False))


def unit(vecs: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, whatever their size."""
    scaled = vecs / np.abs(vecs).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def principal_axes(vecs: DataFrame, rows: int, dims: int) -> np.ndarray:
    """Orthonormal rows: the directions along which a sample of the vectors differs most."""
    wanted = max(2, min(AXES_ROWS, AXES_VALUES // dims))
    drawn = vecs.filter(hash_share(max(1, rows // wanted), "node") == 0).select("vec").limit(2 * wanted).collect()
    sample = np.zeros((max(1, len(drawn)), dims))
    for i, r in enumerate(drawn):
        sample[i, :len(r.vec)] = r.vec
    kept = unit(sample[np.abs(sample).max(1) > 0]) if len(drawn) else np.eye(1, dims)
    return np.linalg.svd(kept - kept.mean(0), full_matrices=False)[2][:AXES]


def apart(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Least squared distance between the points of boxes."""
    gap = np.maximum(0, np.maximum(low_b - high_a, low_a - high_b))
    return (gap * gap).sum(-1)


class Block:
    """Consecutive vectors of the sequence with the boxes of their intervals."""

    def __init__(self, nodes, weights, vecs, axes, parts=None):
        self.nodes, self.weights, self.vecs = nodes, weights, vecs
        self.units = unit(vecs)
        self.parts = np.arange(len(nodes)) if parts is None else parts
        along = self.units @ axes[:, :vecs.shape[1]].T
        starts = np.arange(0, len(nodes), LEAF)
        self.low = [np.minimum.reduceat(along, starts, axis=0)]
        self.high = [np.maximum.reduceat(along, starts, axis=0)]

    def level(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Boxes of the intervals of 2**j leaves."""
        while len(self.low) <= j:
            at = np.arange(0, len(self.low[-1]), 2)
            self.low.append(np.minimum.reduceat(self.low[-1], at, axis=0))
            self.high.append(np.maximum.reduceat(self.high[-1], at, axis=0))
        return self.low[j], self.high[j]


def leaf_pairs(a: Block, b: Block, reach: float) -> np.ndarray:
    """Pairs of leaves that boxes do not keep apart, by halving intervals from the whole blocks down."""
    height = max(len(a.low[0]), len(b.low[0])).bit_length()
    pairs = np.zeros((1, 2), np.int64)
    for j in range(height, -1, -1):
        if j < height:
            halves = np.array([[0, 0], [0, 1], [1, 0], [1, 1]])
            pairs = (2 * pairs[:, None, :] + halves).reshape(-1, 2)
        (low_a, high_a), (low_b, high_b) = a.level(j), b.level(j)
        pairs = pairs[(pairs[:, 0] < len(low_a)) & (pairs[:, 1] < len(low_b))]
        if a is b:
            pairs = pairs[pairs[:, 0] <= pairs[:, 1]]
        x, y = pairs.T
        pairs = pairs[apart(low_a[x], high_a[x], low_b[y], high_b[y]) <= reach]
    return pairs


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    return float(x @ y) / (sqrt(float(x @ x)) * sqrt(float(y @ y)))


def join(a: Block, b: Block, limit: float, reach: float) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
    """Links of every row of ``a`` and of ``b`` (the same block, or another), links that join components, components."""
    same = a is b
    n = 0 if same else len(a.nodes)
    part = a.parts.copy() if same else np.concatenate([a.parts, b.parts + n])
    part_a, part_b = part[:len(a.nodes)], part[n:]
    counts_a = np.zeros(len(a.nodes), np.int64)
    counts_b = counts_a if same else np.zeros(len(b.nodes), np.int64)
    joined = []
    for i, j in leaf_pairs(a, b, reach).tolist():
        rows, columns = slice(i * LEAF, (i + 1) * LEAF), slice(j * LEAF, (j + 1) * LEAF)
        found = a.units[rows] @ b.units[columns].T
        linked = found >= limit
        for r, c in np.argwhere(np.abs(found - limit) < CLOSE).tolist():
            linked[r, c] = cosine(a.vecs[i * LEAF + r], b.vecs[j * LEAF + c]) >= limit
        if same and i == j:
            np.fill_diagonal(linked, False)
        if not linked.any():
            continue
        counts_a[rows] += linked @ b.weights[columns]
        if not (same and i == j):
            counts_b[columns] += a.weights[rows] @ linked
        for r in np.flatnonzero((linked & (part_a[rows, None] != part_b[None, columns])).any(1)).tolist():
            at = i * LEAF + r
            others = j * LEAF + np.flatnonzero(linked[r] & (part_b[columns] != part_a[at]))
            if len(others):
                kinds, first = np.unique(part_b[others], return_index=True)
                joined += [(int(a.nodes[at]), int(b.nodes[x])) for x in others[first]]
                merged = np.append(kinds, part_a[at])
                part[np.isin(part, merged)] = merged.min()
    return counts_a, counts_b, joined, part


def sequence(vecs: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """Vectors with their cells, in the order of the grid."""
    dims = axes.shape[1]

    def place(batches):
        for batch in batches:
            step = max(1, TURNED // dims)
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                lists = part.column(3)
                sizes = lists.value_lengths().to_numpy().astype(np.int64)
                flat = lists.flatten().to_numpy()
                owner = np.repeat(np.arange(len(sizes)), sizes)
                starts = np.cumsum(sizes) - sizes
                padded = np.zeros((len(sizes), dims))
                padded[owner, np.arange(len(flat)) - starts[owner]] = flat
                along = unit(padded) @ axes.T
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int32()), part.column(1), part.column(2),
                     pa.array([flat[s:s + n].tobytes() for s, n in zip(starts, sizes)], pa.binary()),
                     pa.array(np.floor(along / eps).astype(np.int32).tolist(), pa.list_(pa.int32())),
                     pa.array(along[:, 0])], [f.split()[0] for f in PLACED.split(", ")])
    placed = vecs.select("label", "node", "weight", "vec").mapInArrow(place, PLACED)
    order = ["label", "dims", "cells", "along", "node"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order)


def blocks(ordered: DataFrame, axes: np.ndarray, limit: float, block_rows: int) -> DataFrame:
    """The sequence in blocks, each joined with itself."""
    reach = 2 - 2 * limit + CLOSE

    def build(label, dims, rows, number):
        vecs = np.frombuffer(b"".join(r[2] for r in rows), np.float64).reshape(-1, dims)
        block = Block(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), vecs, axes)
        counts, _, joined, parts = join(block, block, limit, reach)
        fields = [(TaskContext.get().partitionId() << 24) + number, label, dims, block.low[0].min(0).tolist(),
                  block.high[0].max(0).tolist(), block.nodes.astype(np.int64).tobytes(), block.weights.astype(np.int64).tobytes(),
                  vecs.tobytes(), parts.astype(np.int64).tobytes(), counts.tobytes(), np.array(joined, np.int64).tobytes()]
        types = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(fields, types)],
                                          [f.split()[0] for f in BLOCK.split(", ")])

    def cut(batches):
        held, now, number = [], None, 0
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("label", "dims", "node", "weight", "vec")]
            for label, dims, *row in zip(*columns):
                if held and (now != (label, dims) or len(held) >= min(block_rows, max(1, BLOCK_VALUES // dims))):
                    yield build(*now, held, number)
                    held, number = [], number + 1
                now = (label, dims)
                held.append(row)
        if held:
            yield build(*now, held, number)
    return durable(ordered.select("label", "dims", "node", "weight", "vec").mapInArrow(cut, BLOCK))


def near_blocks(stored: DataFrame, limit: float, axes: int) -> DataFrame | None:
    """Pairs ``a, b`` of blocks whose boxes are near, by joining intervals from the whole sequence down."""
    group = ["label", "dims"]
    spread = F.shiftright("block", 24)
    buckets = stored.agg(F.coalesce(F.max(spread), F.lit(0))).first()[0] + 1
    placed = durable(numbered(stored.select(*group, "block", "low", "high"), group, ["block"], "place", spread, buckets))
    most = placed.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0] + 1
    height = 0
    while FAN ** height < most:
        height += 1
    if not height:
        return None
    reach = F.lit(2 - 2 * limit + CLOSE)

    def boxes(level):
        each = lambda of, c: F.array(*[of(F.get(c, F.lit(i))) for i in range(axes)]).alias(c)
        cell = F.floor(F.col("place") / FAN ** level).alias("cell")
        return placed.groupBy(*group, cell).agg(each(F.min, "low"), each(F.max, "high"), F.min("block").alias("block"))
    pairs = placed.select(*group, F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).distinct()
    for level in range(height - 1, -1, -1):
        children = boxes(level)
        side = lambda x: children.select(*group, F.floor(F.col("cell") / FAN).alias(x), F.col("cell").alias(f"{x}_cell"),
                                         *[F.col(c).alias(f"{x}_{c}") for c in ("low", "high", "block")])
        both = pairs.join(side("a"), [*group, "a"]).join(side("b"), [*group, "b"])
        gaps = [F.greatest(F.lit(0.0), F.get("b_low", F.lit(i)) - F.get("a_high", F.lit(i)),
                           F.get("a_low", F.lit(i)) - F.get("b_high", F.lit(i))) for i in range(axes)]
        order = F.col("a_cell") <= F.col("b_cell") if level else F.col("a_cell") < F.col("b_cell")
        close = both.filter(order & (sum((g * g for g in gaps), F.lit(0.0)) <= reach))
        pairs = durable(close.select(*group, F.col("a_cell").alias("a"), F.col("b_cell").alias("b"), "a_block", "b_block"))
        if level:
            pairs = pairs.drop("a_block", "b_block")
    return pairs.select(F.col("a_block").alias("a"), F.col("b_block").alias("b"))


def found_inside(stored: DataFrame) -> DataFrame:
    """What the blocks' joins with themselves found, as rows."""
    def spread(batches):
        for batch in batches:
            for nodes, counts, links in zip(*(c.to_pylist() for c in batch.columns)):
                nodes, counts = np.frombuffer(nodes, np.int64), np.frombuffer(counts, np.int64)
                yield _found(nodes, counts, np.frombuffer(links, np.int64).reshape(-1, 2))
    return stored.select("nodes", "counts", "links").mapInArrow(spread, FOUND)


def _found(nodes: np.ndarray, counts: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    some = counts > 0
    n = int(some.sum())
    other = np.concatenate([np.zeros(n, np.int64), links[:, 1]])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([nodes[some], links[:, 0]]), pa.int64()),
         pa.array(np.concatenate([counts[some], np.zeros(len(links), np.int64)]), pa.int64()),
         pa.array(other, pa.int64(), mask=np.arange(len(other)) < n)], ["node", "n_links", "other"])


def found_between(stored: DataFrame, pairs: DataFrame, axes: np.ndarray, limit: float) -> DataFrame:
    """What the pairs of blocks found; both blocks of a pair travel to its task, in one row each."""
    reach = 2 - 2 * limit + CLOSE
    needs = pairs.select(F.col("a").alias("block"), "a", "b").union(pairs.select(F.col("b").alias("block"), "a", "b"))
    shipped = needs.join(stored.select("block", "dims", "nodes", "weights", "vecs", "parts"), "block")

    def compare(two: pa.Table) -> pa.Table:
        ints = lambda x: np.frombuffer(x, np.int64)
        one, other = (Block(ints(r["nodes"]), ints(r["weights"]), np.frombuffer(r["vecs"], np.float64).reshape(-1, r["dims"]),
                            axes, ints(r["parts"])) for r in sorted(two.to_pylist(), key=lambda r: r["block"]))
        counts_a, counts_b, joined, _ = join(one, other, limit, reach)
        links = np.array(joined, np.int64).reshape(-1, 2)
        return pa.Table.from_batches([_found(one.nodes, counts_a, links), _found(other.nodes, counts_b, links[:0])])
    return shipped.groupBy("a", "b").applyInArrow(compare, FOUND)


def linked(vectors: DataFrame, limit: float = LIMIT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding, label)``."""
    vec = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vec.alias("vec"))
    rows = rows.withColumn("takes_part", usable(F.col("vec")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    keys = [F.xxhash64(F.lit(i), "vec").alias(f"key{i}") for i in (1, 2)]
    narrow = durable(rows.select("vec_id", "label", "takes_part", *keys))
    same = ["label", "key1", "key2"]
    one = durable(rows.filter("takes_part").select("*", *keys).groupBy(*same).agg(
        F.first("vec").alias("vec"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first"))
        .withColumn("node", F.monotonically_increasing_id()))
    n, dims = one.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    axes = principal_axes(one, n, dims)
    stored = blocks(sequence(one, axes, sqrt(2 - 2 * limit)), axes, limit, block_rows)
    pairs = near_blocks(stored, limit, len(axes))
    found = found_inside(stored)
    found = durable(found if pairs is None else found.union(found_between(stored, pairs, axes, limit)))
    degree = found.groupBy("node").agg(F.sum("n_links").alias("links"))
    graph = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    nodes = durable(one.drop("vec").join(degree, "node", "left").join(graph, "node", "left").withColumn(
        "component", F.coalesce("component", "node")))
    smallest = durable(nodes.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("size")))
    known = durable(attach(nodes, smallest, ["component"], "size", n).select(
        *same, "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"))
    taking = narrow.filter("takes_part")
    placed = attach(taking, known, same, "weight", taking.count()).select("vec_id", "n_links", "component_id")
    alone = narrow.filter("not takes_part").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


OP11_SQL = """
with recursive e as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
n as (select *, sqrt(list_dot_product(v, v)) as norm from e),
l as (
  select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id
  where len(a.v) = len(b.v) and list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
r as (select vec_id, vec_id as c from embeddings union select l.b, r.c from r join l on l.a = r.vec_id),
z as (select vec_id, min(c) as c from r group by vec_id),
k as (select a, count(*) as n from l group by a)
select e.vec_id, coalesce(k.n, 0) as n_links, z.c as component_id, z.c = e.vec_id as kept
from embeddings e join z using (vec_id) left join k on k.a = e.vec_id
"""


@query("op11_grid_order", OP11_SQL)
def op11_grid_order(spark, sf_dir):
    """Links and components of all vectors."""
    return linked(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
