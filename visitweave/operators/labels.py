"""Which visit an event belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitweave.sources import visits as V


def hit_times(ranked: DataFrame, match: str = "ms", carry: tuple[str, ...] = ()) -> DataFrame:
    """Highest-ranked visit per user and hit time (and page, for ``ts_url``).

    ``carry`` names further visit columns to bring along.
    """
    hits = V.hits(ranked, "visit_rank", *carry, pages=match == "ts_url")
    keys = {"ms": ["ts_ms"], "exact": ["timestamp"], "ts_url": ["ts_ms", "page"]}[match]
    if match == "exact":
        hits = hits.withColumn("timestamp", F.col("ts_ms") / F.lit(1000.0))
    if not carry:
        return hits.groupBy("user_id", *keys).agg(F.max("visit_rank").alias("visit_rank"))
    best = F.max(F.struct("visit_rank", *carry))
    return hits.groupBy("user_id", *keys).agg(best.alias("_visit")).select("user_id", *keys, "_visit.*")


def label_events(events: DataFrame, ranked: DataFrame, match: str = "ms", matched_only: bool = True,
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """Add ``visit_rank`` to events hit by a visit of the same user; the later visit wins.

    ``match``: ``ms`` compares whole milliseconds, ``exact`` the doubles in seconds, and
    ``ts_url`` also the page.  The visit side has one row per key before the join, so the
    join never multiplies events.  Unmatched events are dropped, or get rank 0.
    """
    times = hit_times(ranked, match, carry)
    if match == "ts_url":
        times = times.withColumnRenamed("page", "request_url")
    keys = [c for c in times.columns if c not in ("visit_rank", *carry)]
    joined = events.join(times, keys, "inner" if matched_only else "left")
    return joined.select(*events.columns, F.coalesce("visit_rank", F.lit(0)).cast("int").alias("visit_rank"), *carry)


def visit_labels(events: DataFrame, visit_rows: DataFrame, match: str = "ms") -> DataFrame:
    """Events caught by one of the user's first eight visits, with its rank."""
    return label_events(events, V.first_visits(visit_rows), match)
