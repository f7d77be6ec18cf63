"""Domain counts, dictionary and per-user domain chains.

Inputs are events that carry a ``domain`` column (see ``operators.urls.domains``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitweave.config import LIST_ROWS, MIN_COUNT, NO_DOMAIN
from visitweave.operators import grouped
from visitweave.operators.grouped import HotGroups
from visitweave.storage import durable


def domain_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("domain").agg(F.count(F.lit(1)).alias("n_events"))


def frequent(counts: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    return counts.filter(F.col("n_events") >= min_count)


def dictionary(events: DataFrame, hot: HotGroups | None = None) -> DataFrame:
    """``(domain, domain_id)``: distinct domains and the no-domain mark, numbered by name from 0."""
    spark = events.sparkSession
    mark = spark.range(1).select(F.lit(NO_DOMAIN).alias("domain"))
    names = durable(events.select("domain").union(mark).distinct())   # counted, then numbered
    ranked = grouped.position(names, [], ["domain"], "_rank", hot)
    return ranked.select("domain", (F.col("_rank") - 1).alias("domain_id"))


def grown(old: DataFrame, events: DataFrame, hot: HotGroups | None = None) -> DataFrame:
    """``old`` (``domain, domain_id``) with the new domains of ``events``, by name behind the last id.

    Ids never change, so what was stored with them stays right.  ``old`` should be stored.
    """
    names = durable(events.select("domain").filter("domain is not null").distinct().join(old, "domain", "left_anti"))
    last = old.agg(F.coalesce(F.max("domain_id"), F.lit(-1))).first()[0]
    ranked = grouped.position(names, [], ["domain"], "_rank", hot)
    return old.select("domain", "domain_id").unionByName(ranked.select("domain", (F.col("_rank") + last).alias("domain_id")))


def with_domain_id(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Add ``domain_id``, -1 for a domain that is not in the dictionary."""
    return df.join(ids, "domain", "left").select(
        *df.columns, F.coalesce("domain_id", F.lit(-1)).alias("domain_id"))


def replace_rare(events: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Put the no-domain mark in place of domains seen fewer than ``min_count`` times."""
    good = frequent(domain_counts(events), min_count).select("domain", F.lit(True).alias("_good"))
    return events.join(good, "domain", "left").select(*[
        F.when(F.col("_good"), F.col("domain")).otherwise(NO_DOMAIN).alias("domain") if c == "domain" else c
        for c in events.columns])


def chains(events: DataFrame, size: int = LIST_ROWS, hot: HotGroups | None = None) -> DataFrame:
    """Domains of a user in event order: ``(user_id, part, chain)``.

    A chain holds at most ``size`` domains, the length at which Word2Vec would cut a
    sentence anyway; longer histories continue in the next part.
    """
    placed = grouped.position(events.select("user_id", "ts_ms", "event_id", "domain"), ["user_id"],
                              ["ts_ms", "event_id"], "_pos", hot)
    return (placed.groupBy("user_id", F.floor((F.col("_pos") - 1) / size).alias("part"))
            .agg(F.array_sort(F.collect_list(F.struct("_pos", "domain")))["domain"].alias("chain")))
