"""Ordered computations inside groups of any size.

Ordinary groups use a plain Spark window.  A group with more than ``HOT_ROWS`` rows
(one user with a third of the log, say) is range-partitioned on its sort order so
that many tasks share it; each task works on its slice and adds what the slices
before it carried over.  Both ways give the same rows.
"""

from __future__ import annotations

from functools import reduce
from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitweave.config import BROADCAST_KEYS, HOT_PART, HOT_ROWS, TASK_ROWS
from visitweave.storage import durable


class HotGroups(NamedTuple):
    """Groups too large for one task: their keys (a DataFrame), number and row total."""

    keys: list[str]
    frame: DataFrame | None
    groups: int
    rows: int
    limit: int
    #: Rows of all groups.
    total: int = 0


class Running(NamedTuple):
    """One running value: ``agg`` is ``count``, ``sum``, ``max`` or ``xor``."""

    agg: str
    value: Column | None = None
    inclusive: bool = True


_AGG = {"count": F.count, "sum": F.sum, "max": F.max, "xor": F.bit_xor}
#: How totals of slices add up.
_TOTAL = {"count": F.sum, "sum": F.sum, "max": F.max, "xor": F.bit_xor}


def find_hot(df: DataFrame, keys: list[str], limit: int = HOT_ROWS) -> HotGroups:
    """Count rows per group (combined map-side) and keep the groups over ``limit``.

    At most rows/limit groups can qualify, so the result is small; it is written out
    only when there is one.  With no keys the whole table is the group.
    """
    if not keys:
        rows = df.count()
        return HotGroups([], None, int(rows > limit), rows if rows > limit else 0, limit, rows)
    counts, over = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), F.col("_rows") > limit
    groups, rows, total = counts.agg(F.count_if(over), F.sum(F.when(over, F.col("_rows"))), F.sum("_rows")).first()
    if not groups:
        return HotGroups(list(keys), None, 0, 0, limit, total or 0)
    frame = durable(counts.filter(over).select(*[F.col(k).alias(f"_h_{k}") for k in keys]))
    return HotGroups(list(keys), frame, groups, rows, limit, total)


def split_hot(df: DataFrame, hot: HotGroups) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of ordinary groups, rows of hot groups); ``None`` for an empty side."""
    if not hot.rows:
        return df, None
    if not hot.keys:
        return None, df
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in hot.keys])
    side = F.broadcast(hot.frame) if hot.groups <= BROADCAST_KEYS else hot.frame
    return df.join(side, cond, "left_anti"), df.join(side, cond, "left_semi")


def _dealt(cold: DataFrame, hot: HotGroups) -> DataFrame:
    """Ordinary groups in as many tasks as their rows need.

    Spark joins partitions by their compressed bytes, which say little about the memory that sorting the rows takes.
    Frames dealt already by the same ``hot`` stay as they are, since Spark leaves out a shuffle that changes nothing.
    """
    tasks = ceil((hot.total - hot.rows) / max(hot.limit // HOT_PART, TASK_ROWS))
    if not hot.keys or tasks <= cold.sparkSession.sparkContext.defaultParallelism:
        return cold
    return cold.repartition(max(tasks, int(cold.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *hot.keys)


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Running],
            hot: HotGroups | None = None) -> DataFrame:
    """Add running values per group, in ascending ``order`` (which must be unique).

    ``hot`` can be shared between calls whose ``keys`` include the keys it was found on.
    """
    if hot is None:
        hot = find_hot(df, keys)
    cold, large = split_hot(df, hot)
    parts = []
    if cold is not None:
        parts.append(_running_window(_dealt(cold, hot), keys, order, values))
    if large is not None:
        parts.append(_running_sliced(large, keys, order, values, hot))
    return reduce(DataFrame.unionByName, parts)


def _over(keys, order, run: Running) -> Column:
    w = Window.partitionBy(*keys).orderBy(*order)
    if run.agg == "count" and run.inclusive:
        return F.row_number().over(w).cast("long")
    w = w.rowsBetween(Window.unboundedPreceding, 0 if run.inclusive else -1)
    value = F.lit(1) if run.agg == "count" else run.value
    return _AGG[run.agg](value).over(w)


def _running_window(df, keys, order, values):
    return df.select("*", *[_over(keys, order, r).alias(n) for n, r in values.items()])


def _running_sliced(df, keys, order, values, hot):
    slices = ceil(hot.rows / hot.limit) + 1
    named = df.select("*", *[(F.lit(1) if r.agg == "count" else r.value).alias(f"_v_{n}")
                             for n, r in values.items()])
    # Slice numbers are kept in the durable copy: a lost task cannot re-draw the ranges.
    ranged = durable(named.repartitionByRange(slices, *keys, *order)
                     .withColumn("_slice", F.spark_partition_id()))
    totals = ranged.groupBy("_slice", *keys).agg(
        *[_AGG[r.agg](f"_v_{n}").alias(f"_t_{n}") for n, r in values.items()])
    before = (Window.partitionBy(*keys).orderBy("_slice")
              .rowsBetween(Window.unboundedPreceding, -1))
    # One row per slice of a group, so this window stays small.
    carry = totals.select(
        F.col("_slice").alias("_c_slice"), *[F.col(k).alias(f"_c_{k}") for k in keys],
        *[_TOTAL[r.agg](f"_t_{n}").over(before).alias(f"_t_{n}")
          for n, r in values.items()])
    local = ranged.select("*", *[
        _over(["_slice", *keys], order, r._replace(value=F.col(f"_v_{n}"))).alias(f"_l_{n}")
        for n, r in values.items()])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys],
                  F.col("_slice") == F.col("_c_slice"))
    return local.join(carry, cond, "left").select(
        *df.columns, *[_combine(r, f"_l_{n}", f"_t_{n}").alias(n) for n, r in values.items()])


def _combine(run, local, carried):
    if run.agg == "max":
        return F.greatest(local, carried)
    if run.agg == "xor":
        return F.coalesce(F.col(local).bitwiseXOR(F.col(carried)), F.col(local), F.col(carried))
    both = F.coalesce(F.col(local), F.lit(0)) + F.coalesce(F.col(carried), F.lit(0))
    if run.agg == "sum":   # a sum over nothing is null, as in a window
        both = F.when(F.col(local).isNotNull() | F.col(carried).isNotNull(), both)
    return both


def position(df, keys, order, name="position", hot=None) -> DataFrame:
    """1-based place of every row in its group."""
    return running(df, keys, order, {name: Running("count")}, hot)


def previous(df, keys, order, columns: dict[str, str], hot=None) -> DataFrame:
    """Values of the preceding row in the group: ``{new name: column}``."""
    last = F.struct(*order, *[F.col(c).alias(f"_p_{n}") for n, c in columns.items()])
    out = running(df, keys, order, {"_last": Running("max", last, inclusive=False)}, hot)
    return out.select("*", *[F.col(f"_last._p_{n}").alias(n) for n in columns]).drop("_last")


def trailing(df: DataFrame, keys: list[str], order: list[str], size: int, item: Column,
             name: str = "window", hot: HotGroups | None = None) -> DataFrame:
    """The last ``size`` items of the group up to and including each row, oldest first.

    ``item`` must not be null.  Hot groups are cut into blocks of consecutive rows; each
    block also receives the ``size - 1`` rows before it.
    """
    if hot is None:
        hot = find_hot(df, keys)
    cold, large = split_hot(df, hot)
    back = size - 1
    parts = []
    if cold is not None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-back, 0)
        parts.append(_dealt(cold, hot).select("*", F.collect_list(item).over(w).alias(name)))
    if large is not None:
        block = max(hot.limit, size)
        # Positions are consecutive, so a row's block and the block it spills into follow
        # from its place alone.
        placed = _running_sliced(large.withColumn("_tw_item", item), keys, order,
                                 {"_tw_pos": Running("count")}, hot)
        first = F.floor((F.col("_tw_pos") - 1) / block)
        spread = placed.withColumn("_tw_home", first).withColumn(
            "_tw_block", F.explode(F.sequence(first, F.floor((F.col("_tw_pos") - 1 + back) / block))))
        w = Window.partitionBy(*keys, "_tw_block").orderBy("_tw_pos").rowsBetween(-back, 0)
        parts.append(spread.withColumn(name, F.collect_list("_tw_item").over(w))
                     .filter("_tw_block = _tw_home").select(*df.columns, name))
    return reduce(DataFrame.unionByName, parts)


def strided(df: DataFrame, keys: list[str], order: list[str], size: int, step: int | None,
            item: Column, hot: HotGroups | None = None) -> DataFrame:
    """Full windows of ``size`` rows starting every ``step`` rows (default ``size``).

    One output row per window: keys, ``window_no`` (from 0) and ``items``.  A group of n rows
    gives (n - size) div step + 1 windows, none when n < size.
    """
    step = step or size
    at = F.col("_pos") - 1
    low = F.greatest(F.lit(0), F.ceil((at - (size - 1)) / step)).cast("long")
    high = F.floor(at / step).cast("long")
    placed = position(df.select(*keys, *[c for c in order if c not in keys], item.alias("_item")),
                      keys, order, "_pos", hot)
    return (placed.filter(low <= high)
            .select(*keys, F.explode(F.sequence(low, high)).alias("window_no"), "_pos", "_item")
            .groupBy(*keys, "window_no")
            .agg(F.array_sort(F.collect_list(F.struct("_pos", "_item"))).alias("_rows"))
            .filter(F.size("_rows") == size)
            .select(*keys, "window_no", F.col("_rows._item").alias("items")))
