"""Where a user's visits lie in vector space so far, and how near an event is to each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitweave.config import MAX_VISITS
from visitweave.operators import grouped
from visitweave.operators.grouped import HotGroups, Running

ORDER = ["ts_ms", "event_id"]


def running_centroids(events: DataFrame, size: int, vector: str = "vector", hot: HotGroups | None = None) -> DataFrame:
    """A row per event and visit: number and mean vector of the visit's events before this one.

    ``events`` have a ``visit_rank`` (up to ``MAX_VISITS``) and a vector of ``size`` numbers, summed up along
    the history; ``centroid`` is null before the visit's first event.  A user of any length is
    summed in slices.  Columns ``of_visit, n_before, centroid`` are added.
    """
    pairs = events.withColumn("of_visit", F.explode(F.sequence(F.lit(1), F.lit(MAX_VISITS))))
    mine = F.col("visit_rank") == F.col("of_visit")
    part = lambda i: F.when(mine, F.get(vector, F.lit(i)).cast("double"))
    sums = {f"_s{i}": Running("sum", part(i), inclusive=False) for i in range(size)}
    count = {"_n": Running("sum", mine.cast("long"), inclusive=False)}
    out = grouped.running(pairs, ["user_id", "of_visit"], ORDER, sums | count, hot)
    mean = F.array(*[F.col(f"_s{i}") / F.col("_n") for i in range(size)])
    return out.select(*events.columns, "of_visit", F.coalesce("_n", F.lit(0)).alias("n_before"),
                      F.when(F.col("_n") > 0, mean).alias("centroid"))


def _cosine(size: int, vector: str = "vector") -> Column:
    """Cosine of an event's vector to the ``centroid`` in the same row, 0 where one has no direction."""
    a = [F.get(vector, F.lit(i)).cast("double") for i in range(size)]
    b = [F.get("centroid", F.lit(i)) for i in range(size)]
    dot = lambda x, y: sum((p * q for p, q in zip(x, y)), F.lit(0.0))
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norms > 0, dot(a, b) / norms), F.lit(0.0))


def cosines(centroids: DataFrame, size: int, vector: str = "vector") -> DataFrame:
    """``user_id, event_id, cosines``: an event's cosine to the centroid of each visit."""
    near = _cosine(size, vector)
    # Eight rows per event.
    return centroids.groupBy("user_id", "event_id").agg(
        F.array_sort(F.collect_list(F.struct("of_visit", near.alias("near"))))["near"].alias("cosines"))


def with_cosines(centroids: DataFrame, size: int, vector: str = "vector") -> DataFrame:
    """``user_id, event_id, of_visit, n_before, centroid, cosine``: the event's entry of ``cosines`` at the place of the visit.

    The rows of an event are put together once and taken apart again, so nothing is stored or joined.
    """
    item = F.struct("of_visit", _cosine(size, vector).alias("near"), "n_before", "centroid")
    lists = centroids.filter("user_id is not null and event_id is not null").groupBy("user_id", "event_id").agg(
        F.array_sort(F.collect_list(item)).alias("_items"))
    rows = lists.select("user_id", "event_id", F.col("_items.near").alias("_near"), F.inline("_items"))
    return rows.select("user_id", "event_id", "of_visit", "n_before", "centroid",
                       F.element_at("_near", F.col("of_visit")).alias("cosine"))
