"""Shards by balanced label propagation.

Documents that share a key (equal texts) are linked.  Each starts in a shard drawn by a hash;
the copies of a key in one shard move together, as a unit.  In every round each unit asks for
the shard with room where its key has most copies, and as many units move as quotas allow:
shards admit them in order of gain until they are full.  Rounds end when no unit can move any more.  Documents without links then even out the counts,
so that shards differ by one document at most.

Only counts per key and shard take part in the rounds, so a key with a third of all documents
is a few rows.  Everything is DataFrame operations.

Defined results: a null text has no bytes and no links; equal empty texts are linked; repeated
rows are documents of their own; an empty table gives an empty result; further columns are left
alone; with fewer documents than shards some shards stay empty.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitweave.llm.common import blocks_for, durable, hash_share, numbered, table
from visitweave.llm.registry import query

SHARDS = 24
#: Steps of the histograms by which a shard's quota is shared out.
STEPS = 4_096
#: Documents numbered by one task, about.
BUCKET_ROWS = 100_000


def propagate(units: DataFrame, capacity: float) -> DataFrame:
    """``units(key, start, weight)`` with the ``shard`` each ends in; ``start`` is where it begins.

    A shard's quota in a round is its capacity less what it holds.  Requests are admitted by
    gain (copies it joins over copies it leaves), in the steps of a histogram, so no task ever
    sorts all requests; a step that would pass the quota waits for a later round.  If no step fits
    anywhere, each shard admits its first unit, for which it has room.

    A unit only moves to where its key has at least as many copies, so every move raises the sum of
    squared copies per key and shard, and the rounds come to an end: then no shard with room has
    more copies of a key than the shard of any of its units.
    """
    state = durable(units.withColumn("shard", F.col("start")))
    # A shard is worth asking if it has room for any unit of the key.
    largest = durable(units.groupBy("key").agg(F.max("weight").alias("largest")))
    for number in count():
        held = state.groupBy("key", "shard").agg(F.sum("weight").alias("held"))
        held = held.withColumn("rank", F.struct("held", F.xxhash64("key", "shard", F.lit(number)).alias("tie")))
        room = state.groupBy(F.col("shard").alias("to")).agg(F.sum("weight").alias("full"))
        wanted = (held.join(room, held["shard"] == room["to"]).join(largest, "key")
                  .filter(F.col("full") + F.col("largest") <= capacity)
                  .groupBy("key").agg(F.max(F.struct("rank", "to")).alias("best"))
                  .select("key", F.col("best.to").alias("to"), F.col("best.rank").alias("there")))
        asked = durable(state.join(held, ["key", "shard"]).join(wanted, "key").filter("shard <> to and there > rank")
                        .select("key", "start", "weight", "to", _step(F.col("there.held") / F.col("held"), number).alias("step")))
        if asked.isEmpty():
            return state
        up_to = Window.partitionBy("to").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        # At most STEPS rows for each shard; totals grow with the step, so a shard admits all steps up to one.
        steps = asked.groupBy("to", "step").agg(F.sum("weight").alias("weight"))
        last = (steps.withColumn("total", F.sum("weight").over(up_to)).join(room, "to", "left")
                .filter(F.col("total") + F.coalesce("full", F.lit(0)) <= capacity)
                .groupBy("to").agg(F.max("step").alias("last")).collect())   # one row for each shard at most
        if last:
            admitted = F.try_element_at(F.create_map(*[F.lit(v) for r in last for v in r]), F.col("to"))
            moves = asked.filter(F.col("step") <= admitted).select("key", "start", "to")
        else:
            moves = asked.groupBy("to").agg(F.min(F.struct("step", "key", "start")).alias("one")).select(
                "one.key", "one.start", "to")
        state = durable(state.join(moves, ["key", "start"], "left").select(
            "key", "start", "weight", F.coalesce("to", "shard").alias("shard")))


def _step(gain: Column, number: int) -> Column:
    """Place in the histogram: greater gains first, equal ones in the order of a hash."""
    grade = F.least(F.lit(15), F.greatest(F.lit(0), F.round(F.log2(gain) * 2).cast("int")))
    return ((15 - grade) * (STEPS // 16) + hash_share(STEPS // 16, "key", "start", F.lit(number))).cast("int")


def balanced(rows: DataFrame, shards: int = SHARDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Even out ``rows(doc_id, shard, copies, ...)`` to counts at most one apart and number each shard's documents.

    Documents are numbered within their shard, those with most copies first; whoever lies
    beyond the shard's share goes to a shard with gaps.  One count per shard is gathered.
    """
    counts = {r.shard: r["count"] for r in rows.groupBy("shard").count().collect()}
    total = sum(counts.values())
    fullest = sorted(range(shards), key=lambda s: (-counts.get(s, 0), s))
    share = {s: total // shards + (i < total % shards) for i, s in enumerate(fullest)}
    over = {s: max(0, counts.get(s, 0) - share[s]) for s in share}
    gaps, ends, starts, at = [s for s in share if counts.get(s, 0) < share[s]], [], [], 0
    for s in gaps:
        starts.append(at - counts.get(s, 0))
        at += share[s] - counts.get(s, 0)
        ends.append(at)
    before, at = {}, 0
    for s in range(shards):
        before[s], at = at, at + over[s]
    buckets = blocks_for(total, shards * bucket_rows)
    of = lambda values: F.get(F.array(*[F.lit(values[s]).cast("long") for s in range(shards)]), "shard")
    listed = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    spread = F.when(F.col("copies") > 1, 0).otherwise(buckets) + hash_share(buckets, "doc_id")
    order = [F.desc("copies"), F.col("key"), F.col("doc_id")]
    placed = numbered(rows, ["shard"], order, "_place", spread, 2 * buckets)
    beyond = F.col("_place") - of(share)
    if not gaps:
        return placed.withColumnRenamed("_place", "slot")
    moved = placed.withColumn("_moved", F.when(beyond >= 0, of(before) + beyond))
    gap = F.size(F.filter(listed(ends), lambda e: e <= F.col("_moved")))
    return moved.withColumn("_gap", gap).select(
        *[F.when(F.col("_moved").isNull(), F.col("shard")).otherwise(F.get(listed(gaps), "_gap")).cast("int").alias(c)
          if c == "shard" else F.col(c) for c in rows.columns],
        F.when(F.col("_moved").isNull(), F.col("_place")).otherwise(
            F.col("_moved") - F.get(listed(starts), "_gap")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document (law ``rows``)."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = durable(docs.select(
        F.col("doc_id").cast("long"), (F.length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        F.md5(F.col("text").cast("binary")).alias("key"), hash_share(shards, "doc_id", F.lit("start")).cast("int").alias("start")))
    linked = rows.filter("key is not null").groupBy("key", "start").agg(F.count(F.lit(1)).alias("weight"))
    whole = linked.groupBy("key").agg(F.sum("weight").alias("copies")).filter("copies > 1")
    units = linked.join(whole, "key")
    state = propagate(units.select("key", "start", "weight"), rows.count() / shards)
    found = state.join(whole, "key").select("key", "start", "copies", "shard")
    placed = rows.join(found, ["key", "start"], "left").select(
        "doc_id", "size", "text_crc32", "key", F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce("shard", "start").alias("shard"))
    return balanced(durable(placed), shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"))


@query("op4_label_propagation")
def op4_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards, copies of a text together."""
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
