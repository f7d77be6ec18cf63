"""Prefix trie of conversations from range minima over sorted common prefixes.

Conversations are sorted by their turns; next to each stands how many turns it has in common with
the one before it.  A prefix of d turns is held by the run of neighbours around a conversation
in which no such number is below d, and every prefix of every conversation finds both ends of its
run by itself, with a binary search in a sparse table of range minima: no stack, no walk along the table.

* A turn stands as two 64-bit hashes, a prefix as the running exclusive-or of its turns' hashes mixed with
  their places, so equal prefixes are equal 128-bit numbers.  Texts are read once and not shuffled.
* A conversation of any length is cut into stretches of ``STRETCH`` turns, sorted by the prefix
  before them, so that a sort key is bounded.  Totals of later stretches are added to the earlier
  ones by pointer doubling over stretches; without long conversations there is none.
* The sorted table is cut into blocks, one a task.  A run that reaches the edge of its block
  goes on in a sparse table over blocks; how far it enters the last of them is known from that
  block's summary, which has bounded size, as has the number of blocks (``MAX_BLOCKS``).
* A subtree is a run, so its sums are differences of running sums.

Defined results: rows without a conv_id belong to no conversation; a null role or text counts as
empty; a null turn comes first; turns with one number stand in the order of their hashes; repeated
rows are turns of their own; a base that is missing gives no turns; an empty table gives an empty
result; further columns are left alone.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitweave.llm.common import attach, blocks_for, durable, table, words_of
from visitweave.llm.registry import query
from visitweave.operators.grouped import Running, position, running

#: Turns of a conversation that are sorted together.
STRETCH = 128
#: Stretches in a block, and the number of blocks beyond which blocks grow instead.
BLOCK_UNITS = 65_536
MAX_BLOCKS = 16_384
#: Prefixes that search at once.
SEARCHED = 500_000
#: Conversations that share a base, and the number of different head lengths.
FAMILY, HEADS = 20, 4
BLOCK = ("block int, n long, k binary, conv binary, size binary, offsets binary, keys binary, words binary, leaves binary, "
         "saved binary, low long, before binary, after binary, edge binary, first binary, last binary, last_size long")
NODE = ("depth long, a long, b long, up_a long, up_b long, conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, stretch_leaves long, stretch_saved long")


def rebuild(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, ``conv, place (from 1), a, b, words, length``, and all ``(conv, length)``.

    A conversation takes its first h turns from the first of its family, h drawn by a hash of its number.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = durable(turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"), F.size(words_of(text)).cast("long").alias("words")))
    placed = durable(position(own, ["conv"], ["turn", "a", "b"], "place").drop("turn"))
    sizes = durable(placed.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
                    .withColumn("head", F.crc32(F.col("conv").cast("string").cast("binary")) % heads)
                    .withColumn("base", F.col("conv") - F.col("conv") % family))
    bases = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("head", F.coalesce("base_n", F.lit(0)))
    convs = durable(sizes.join(bases, "base", "left").withColumn("taken", taken).withColumn(
        "length", F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))))
    out = ["conv", "place", "a", "b", "words", "length"]
    # A base gives at most heads - 1 turns to each of its family.
    first = placed.filter(F.col("place") < heads).withColumnRenamed("conv", "base")
    taken_over = convs.select("conv", "base", "taken", "length").join(first, "base").filter("place <= taken").select(*out)
    tails = attach(placed, convs.select("conv", "n", "head", "taken", "length"), ["conv"], "n", placed.count())
    kept = tails.filter("place > head").withColumn("place", F.col("place") - F.col("head") + F.col("taken")).select(*out)
    return durable(taken_over.unionByName(kept)), convs.select("conv", "length")


def stretches(turns: DataFrame, convs: DataFrame, size: int = STRETCH) -> DataFrame:
    """``k, conv, size, keys, words``: the prefixes at the places k * size to (k + 1) * size of a conversation.

    The first one is what stands before the stretch; ``size`` counts the turns that follow, one more if
    there are more than fit.
    """
    mixed = turns.select("conv", "place", "words", "length", F.xxhash64("place", "a").alias("a"), F.xxhash64("place", "b").alias("b"))
    run = running(mixed, ["conv"], ["place"], {"x": Running("xor", F.col("a")), "y": Running("xor", F.col("b"))})
    zero = F.lit(0).cast("long")
    start = convs.select("conv", zero.alias("place"), zero.alias("words"), "length", zero.alias("x"), zero.alias("y"))
    every = run.select("conv", "place", "words", "length", "x", "y").unionByName(start)
    k = F.floor(F.col("place") / size)
    also = F.when(F.col("place") == 0, F.array(k)).when(F.col("place") % size > 0, F.array(k)).when(
        F.col("place") < F.col("length"), F.array(k - 1, k)).otherwise(F.array(k - 1))
    dealt = every.withColumn("k", F.explode(also))
    rows = F.array_sort(F.collect_list(F.struct("place", "x", "y", "words")))
    grouped = dealt.groupBy("conv", "k").agg(rows.alias("rows"), F.max("length").alias("length"))
    return grouped.select(
        "k", "conv", F.least(F.col("length") - F.col("k") * size, F.lit(size + 1)).alias("size"),
        F.flatten(F.transform("rows", lambda r: F.array(r["x"], r["y"]))).alias("keys"),
        F.transform("rows", lambda r: r["words"]).alias("words"))


class Minima:
    """Sparse table: level j holds the minimum of every 2**j neighbours."""

    def __init__(self, values: np.ndarray):
        self.levels = [np.asarray(values)]
        step = 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest p for which all values from p to at - 1 are ``least`` or more."""
        p = at.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            q = p - (1 << j)
            p = np.where((q >= 0) & (self.levels[j][np.maximum(q, 0)] >= least), q, p)
        return p

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The largest p for which all values from at + 1 to p are ``least`` or more."""
        p = at.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            level = self.levels[j]
            inside = p + 1 < len(level)
            p = np.where(inside & (level[np.minimum(p + 1, len(level) - 1)] >= least), p + (1 << j), p)
        return p

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum from ``low`` to ``high``."""
        j = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.empty(len(low), self.levels[0].dtype)
        for level in np.unique(j):
            own = j == level
            out[own] = np.minimum(self.levels[level][low[own]], self.levels[level][high[own] - (1 << int(level)) + 1])
        return out


def common(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Prefixes that each row has in common with the row before it (-1 for none, not even the start); -2 first."""
    sizes = np.diff(offsets)
    both = np.minimum(sizes[1:], sizes[:-1])
    owner = np.repeat(np.arange(len(both)), both)
    t = np.arange(len(owner)) - np.repeat(np.cumsum(both) - both, both)
    differs = (keys[offsets[1:-1][owner] + t] != keys[offsets[:-2][owner] + t]).any(1)
    same = both.copy()
    np.minimum.at(same, owner[differs], t[differs])
    return np.concatenate([[-2], same - 1])


def _summary(lcp: np.ndarray, size: np.ndarray, stretch: int) -> dict:
    """How far runs of each depth reach into the block from either side, and the size where they end."""
    depths = np.arange(stretch + 1)
    inner = lcp[1:]
    down = lambda values: 1 + np.searchsorted(-np.minimum.accumulate(values), -depths, side="right")
    before = down(inner) if len(inner) else np.ones(stretch + 1, np.int64)
    after = down(inner[::-1]) if len(inner) else before
    return {"low": int(inner.min()) if len(inner) else 1 << 30, "before": before, "after": after, "edge": size[before - 1]}


def blocks(units: DataFrame, stretch: int = STRETCH, block_units: int = BLOCK_UNITS) -> DataFrame:
    """The sorted stretches, one row per block, with the block's summary."""
    number = min(MAX_BLOCKS, blocks_for(units.count(), block_units))
    order = ["k", "keys", "size", "conv"]

    def collect(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts).combine_chunks()
        plain = lambda name: whole[name].to_numpy().astype(np.int64)
        lists, words = whole["keys"].combine_chunks(), whole["words"].combine_chunks()
        counts = pc.list_value_length(words).to_numpy().astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        keys = lists.flatten().to_numpy().reshape(-1, 2)
        k, size = plain("k"), plain("size")
        lcp = common(keys, offsets)
        lcp[1:][k[1:] != k[:-1]] = -1
        found = _summary(lcp, size, stretch)
        name = lambda i: np.concatenate([[k[i]], keys[offsets[i]:offsets[i + 1]].ravel()]).astype(np.int64)
        fields = {"block": TaskContext.get().partitionId(), "n": len(k), "k": k, "conv": plain("conv"), "size": size,
                  "offsets": offsets, "keys": keys, "words": words.flatten().to_numpy().astype(np.int64),
                  "leaves": plain("leaves"), "saved": plain("saved"), **found, "first": name(0), "last": name(len(k) - 1),
                  "last_size": int(size[-1])}
        row = {n: v.astype(np.int64).tobytes() if isinstance(v, np.ndarray) else v for n, v in fields.items()}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema(
            [(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in
             (f.split() for f in BLOCK.split(", "))]))
    ranged = units.select("k", "keys", "size", "conv", "words", "leaves", "saved").repartitionByRange(number, *order)
    return durable(ranged.sortWithinPartitions(*order).mapInArrow(collect, BLOCK))


class _Top:
    """What runs need to know of other blocks."""

    def __init__(self, rows: list, stretch: int):
        ints = lambda x: np.frombuffer(x, np.int64)
        rows = sorted(rows, key=lambda r: r["block"])
        self.place = {r["block"]: i for i, r in enumerate(rows)}
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        self.before, self.after, self.edge = (
            np.array([ints(r[c]) for r in rows]).reshape(len(rows), stretch + 1) for c in ("before", "after", "edge"))
        self.last_size = [r["last_size"] for r in rows]
        joint = [-1]
        for one, two in zip(rows, rows[1:]):
            a, b = ints(one["last"]), ints(two["first"])
            n = min(len(a), len(b))
            pairs = (a[1:n] == b[1:n]).reshape(-1, 2).all(1)
            joint.append(-1 if a[0] != b[0] else (int(pairs.argmin()) if not pairs.all() else len(pairs)) - 1)
        self.joint = np.array([*joint, -1], np.int64)          # common prefixes with the block before
        low = np.array([r["low"] for r in rows], np.int64)
        self.to_left, self.to_right = Minima(np.minimum(low, self.joint[:-1])), Minima(np.minimum(low, self.joint[1:]))

    def beyond_left(self, b: int, depth: np.ndarray) -> np.ndarray:
        """Rows before block ``b`` in runs that reach its start."""
        t = self.to_left.left(np.full(len(depth), b), depth) - 1
        return self.start[b] - self.start[t + 1] + self.after[t, depth]

    def beyond_right(self, b: int, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows after block ``b`` in runs that reach its end, and the size of the last of them."""
        t = self.to_right.right(np.full(len(depth), b), depth) + 1
        return self.start[t] - self.start[b + 1] + self.before[t, depth], self.edge[t, depth]


def _solve(row: dict, top: _Top, stretch: int):
    """Prefixes of a block: their runs, and sums over the part of each run that lies in the block."""
    k, conv, size, offsets, words, leaves, saved = (np.frombuffer(row[c], np.int64) for c in (
        "k", "conv", "size", "offsets", "words", "leaves", "saved"))
    keys = np.frombuffer(row["keys"], np.int64).reshape(-1, 2)
    b, n = top.place[row["block"]], len(k)
    counts = np.diff(offsets)
    lcp = common(keys, offsets)
    lcp[1:][k[1:] != k[:-1]] = -1
    minima, convs = Minima(lcp), Minima(conv)
    joined = lcp.copy()
    joined[0] = top.joint[b]
    # Runs of all prefixes, some at a time.
    runs = []
    cuts = np.minimum(n, np.searchsorted(offsets, np.arange(0, offsets[-1] + SEARCHED, SEARCHED)))
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            unit = np.repeat(np.arange(lo, hi), counts[lo:hi])
            depth = np.arange(offsets[lo], offsets[hi]) - offsets[unit]
            left = minima.left(unit + 1, depth) - 1
            right = minima.right(unit, depth)
            own = left == unit                   # one of a run speaks for its part of the block
            runs.append((unit[own], depth[own], right[own]))
    unit, depth, right = (np.concatenate(x) for x in zip(*runs))
    total, last = right - unit + 1, size[right]
    goes = np.flatnonzero((unit == 0) & (joined[unit] >= depth))
    total[goes] += top.beyond_left(b, depth[goes])
    goes = np.flatnonzero((right == n - 1) & (top.joint[b + 1] >= depth))
    more, ends = top.beyond_right(b, depth[goes])
    total[goes] += more
    last[goes] = ends
    # Who starts a run gives its value to all runs around it.
    at = offsets[unit] + depth
    node = (depth > 0) | (k[unit] == 0)
    owned = node & (depth > joined[unit])
    leaf = owned & (size[unit] == depth) & (last == depth)
    value = [leaf.astype(np.int64), np.where(owned, (total - 1) * words[at], 0)]
    previous = np.concatenate([[top.last_size[b - 1] if b else 0], size[:-1]])
    opens = (size > stretch) & ((joined < stretch) | (previous <= stretch))
    sums = []
    for v, further in zip(value, (leaves, saved)):
        of_unit = np.zeros(n, np.int64)
        np.add.at(of_unit, unit, v)
        upto = np.concatenate([[0], np.cumsum(of_unit + np.where(opens, further, 0))])
        earlier = np.cumsum(v) - v               # of shallower prefixes of the same row
        first = np.concatenate([[True], unit[1:] != unit[:-1]])
        earlier -= np.repeat(earlier[first], np.diff(np.append(np.flatnonzero(first), len(unit))))
        sums.append(upto[right + 1] - upto[unit] - earlier)
    far = np.int64(1 << 32)
    branches = np.sort((np.maximum(joined, -1) * far + np.arange(n))[np.minimum(size, stretch) > joined])
    children = (np.searchsorted(branches, depth * far + right, "right") - np.searchsorted(branches, depth * far + unit, "right")
                + ((np.minimum(size[unit], stretch) > depth) & (joined[unit] <= depth)))
    up = np.maximum(at - 1, 0)
    inside = depth > 0
    column = lambda values, valid=None: pa.array(values, pa.int64(), mask=None if valid is None else ~valid)
    zero = lambda v: np.where(node, v, 0)
    return pa.RecordBatch.from_arrays([
        column(k[unit] * stretch + depth), column(keys[at, 0]), column(keys[at, 1]), column(keys[up, 0], inside),
        column(keys[up, 1], inside), column(convs.between(unit, right), node), column(zero(right - unit + 1)), column(children),
        column(zero(sums[0])), column(zero(sums[1])), column(np.where(node, 0, sums[0])), column(np.where(node, 0, sums[1]))],
        [f.split()[0] for f in NODE.split(", ")])


def prefixes(units: DataFrame, stretch: int = STRETCH, block_units: int = BLOCK_UNITS) -> DataFrame:
    """A row per prefix and block: sums over the part of its run that lies in the block."""
    stored = blocks(units, stretch, block_units)
    top = _Top(stored.select("block", "n", "low", "before", "after", "edge", "first", "last", "last_size").collect(), stretch)

    def solve(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield _solve(row, top, stretch)
    return durable(stored.select("block", "k", "conv", "size", "offsets", "keys", "words", "leaves", "saved")
                   .mapInArrow(solve, NODE))


def later_stretches(parts: DataFrame, units: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Totals of all that follows the end of a stretch, ``depth, a, b, leaves, saved``, by pointer doubling."""
    own = parts.filter("n_convs = 0").groupBy("depth", "a", "b").agg(
        F.sum("stretch_leaves").alias("leaves"), F.sum("stretch_saved").alias("saved"))
    last = lambda i: F.element_at("keys", F.lit(i))
    links = units.filter(F.col("size") > stretch).select(
        ((F.col("k") + 1) * stretch).alias("depth"), last(-2).alias("a"), last(-1).alias("b"),
        F.when(F.col("k") > 0, F.struct((F.col("k") * stretch).alias("depth"), last(1).alias("a"), last(2).alias("b"))).alias("up"))
    state = durable(own.join(links.distinct(), ["depth", "a", "b"]))
    while not state.filter("up is not null").isEmpty():
        below = state.filter("up is not null").groupBy("up").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        here = F.struct("depth", "a", "b")
        further = state.select(here.alias("up"), F.col("up").alias("further"))
        state = durable(
            state.withColumn("here", here).join(below.withColumnRenamed("up", "here"), "here", "left")
            .join(further, "up", "left").select(
                "depth", "a", "b", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), F.col("further").alias("up")))
    return state.select("depth", "a", "b", "leaves", "saved")


def ends(units: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``depth, a, b, ends_sha256``: the conversations that end at a prefix, hashed one after another in order."""
    done = units.filter(F.col("size") <= stretch).select(
        (F.col("k") * stretch + F.col("size")).alias("depth"), F.element_at("keys", F.lit(-2)).alias("a"),
        F.element_at("keys", F.lit(-1)).alias("b"), "conv")
    schema = "depth long, a long, b long, ends_sha256 string"

    def digest(batches):
        now, state, out = None, None, []
        names = [x.split()[0] for x in schema.split(", ")]
        batch_of = lambda rows: pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema(
            [(n, pa.string() if n == "ends_sha256" else pa.int64()) for n in names]))
        for batch in batches:
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if key == now:
                    state.update(b",%d" % conv)
                else:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = key, sha256(b"%d" % conv)
            yield batch_of(out)
            out = []
        if now:
            yield batch_of([(*now, state.hexdigest())])
    keys = ["depth", "a", "b"]
    return done.repartition(*keys).sortWithinPartitions(*keys, "conv").mapInArrow(digest, schema)


def trie(turns: DataFrame, convs: DataFrame, stretch: int = STRETCH, block_units: int = BLOCK_UNITS) -> DataFrame:
    """The nodes of the prefix trie of conversations given as ``rebuild`` gives them."""
    none = F.lit(0).cast("long")
    units = durable(stretches(turns, convs, stretch))
    bare = units.withColumn("leaves", none).withColumn("saved", none)
    parts = prefixes(bare, stretch, block_units)
    if not units.filter("k > 0").isEmpty():
        totals = later_stretches(parts, units, stretch).withColumnRenamed("depth", "after")
        after = F.when(F.col("size") > stretch, (F.col("k") + 1) * stretch)
        keyed = units.withColumn("after", after).withColumn("a", F.element_at("keys", F.lit(-2))).withColumn(
            "b", F.element_at("keys", F.lit(-1)))
        known = keyed.filter("after is not null").join(totals, ["after", "a", "b"]).select(*units.columns, "leaves", "saved")
        parts = prefixes(bare.filter(F.col("size") <= stretch).unionByName(known), stretch, block_units)
    total = lambda c: F.sum(c).alias(c)
    nodes = durable(parts.groupBy("depth", "a", "b").agg(
        F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"), F.min("conv_id").alias("conv_id"), total("n_convs"),
        total("n_children"), total("n_leaves"), total("saved_tokens")))
    parents = nodes.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"),
        F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    placed = attach(nodes.filter("depth > 0"), parents, ["depth", "up_a", "up_b"], "siblings", nodes.count())
    whole = placed.drop("siblings").unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    empty = F.lit(sha256(b"").hexdigest())
    return whole.join(ends(units, stretch), ["depth", "a", "b"], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", empty))


OP12_SQL = """
with t as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first) as p
  from conversations where conv_id is not null),
o as (select c, list({'r': role, 't': text} order by p) as own from t group by c),
h as (
  select c, own, c - c % 20 as base,
    xor(list_reduce(flatten(list_transform(range(1, length(c::varchar) + 1),
      lambda i: [ascii(substr(c::varchar, i, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda s, x: case when x >= 0 then xor(s, x) when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end,
      4294967295::bigint), 4294967295::bigint) % 4 as h
  from o),
r as (
  select h.c, coalesce(b.own[1:h.h], []) || h.own[h.h + 1:] as turns
  from h left join o b on b.c = h.base),
p as (select c, turns, d, turns[1:d] as prefix from (select c, turns, unnest(range(0, len(turns) + 1)) as d from r)),
n as (
  select d, prefix, min(c) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (len(turns) = d), '')) as ends_sha256,
    case when d = 0 then 0 else (count(*) - 1) * len(regexp_extract_all(prefix[d]['t'], '[^\\x20\\x09-\\x0D]+')) end as saved
  from p group by d, prefix),
k as (select d - 1 as d, prefix[1:d - 1] as prefix, count(*) as n_children from n where d > 0 group by all),
v as (select n.*, coalesce(k.n_children, 0) as n_children from n left join k on k.d = n.d and k.prefix = n.prefix)
select a.conv_id, a.d::bigint as depth, any_value(u.conv_id) as parent_conv_id, any_value(a.n_convs) as n_convs,
  any_value(a.n_children) as n_children, count(*) filter (b.n_children = 0) as n_leaves,
  sum(b.saved)::bigint as saved_tokens, any_value(a.ends_sha256) as ends_sha256
from v a join v b on b.d >= a.d and b.prefix[1:a.d] = a.prefix left join v u on u.d = a.d - 1 and u.prefix = a.prefix[1:a.d - 1]
group by a.d, a.prefix, a.conv_id
"""


@query("op12_prefix_ranges", OP12_SQL)
def op12_prefix_ranges(spark, sf_dir):
    """The prefix trie of all rebuilt conversations."""
    return trie(*rebuild(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
