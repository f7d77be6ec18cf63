"""Visits: reading, filters, ranks and the flat page-hit layout.

Source layout: ``user, site, timestamps array<long> (ms), sendingpage, landingpage, pages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitweave.config import LIST_ROWS, MAX_VISITS
from visitweave.functions.urls import strip_key
from visitweave.operators import grouped

SCHEMA = ("user string, site string, timestamps array<bigint>, sendingpage string, "
          "landingpage string, specialref string, pages array<string>")
RANK_ORDER = ["first_ts", "site", "visit_key"]


def read_visits(spark: SparkSession, path: str) -> DataFrame:
    columns = ["user", "site", "timestamps", "sendingpage", "landingpage", "pages"]
    return spark.read.parquet(path).select(*columns)


def first_level_sites(visits: DataFrame) -> DataFrame:
    """Visits aggregated at first-level domain (site ends with ``*``)."""
    return visits.filter(F.col("site").endswith("*"))


def visit_structs(visits: DataFrame) -> DataFrame:
    """``(user_id, site, visit struct)`` with times in seconds."""
    return visits.select(
        F.col("user").alias("user_id"), "site",
        F.struct(F.col("sendingpage").alias("sending_page"), F.col("landingpage").alias("landing_page"),
                 F.transform("timestamps", lambda x: x / F.lit(1000.0)).alias("timestamps"),
                 "pages").alias("visit"))


def visit_rows(visits: DataFrame) -> DataFrame:
    """Flat visit columns plus ``first_ts`` and a key that tells visits of a user apart."""
    named = visits.select(
        F.col("user").alias("user_id"), "site", F.element_at("timestamps", 1).alias("first_ts"),
        F.col("sendingpage").alias("sending_page"), F.col("landingpage").alias("landing_page"),
        "timestamps", "pages")
    key = F.xxhash64("site", "timestamps", "sending_page", "landing_page", "pages")
    return named.withColumn("visit_key", key)


def rank_visits(rows: DataFrame, hot: grouped.HotGroups | None = None) -> DataFrame:
    """1-based ``visit_rank`` of each visit of a user by its first timestamp."""
    return grouped.position(rows, ["user_id"], RANK_ORDER, "visit_rank", hot)


def first_visits(rows: DataFrame, n: int = MAX_VISITS) -> DataFrame:
    """The first ``n`` visits of each user, ranked.

    Written as a plain rank filter: Spark keeps only the best ``n`` rows of a user per input
    task before the shuffle, so a user of any size stays small here.
    """
    w = Window.partitionBy("user_id").orderBy(*RANK_ORDER)
    return rows.withColumn("visit_rank", F.row_number().over(w)).filter(
        F.col("visit_rank") <= n).withColumn("visit_rank", F.col("visit_rank").cast("long"))


def with_sender(rows: DataFrame) -> DataFrame:
    """Visits that can be transfers: those with a non-empty sending page."""
    return rows.filter(F.coalesce("sending_page", F.lit("")) != "")


def hits(rows: DataFrame, *keep: str, pages: bool = False) -> DataFrame:
    """One row per timestamp of a visit; with ``pages`` also its page, null past the page list."""
    if not pages:
        return rows.select("user_id", *keep, F.posexplode("timestamps").alias("pos", "ts_ms"))
    both = rows.select("user_id", *keep, F.posexplode(F.arrays_zip("timestamps", "pages")).alias("pos", "hit"))
    return both.select("user_id", *keep, "pos", F.col("hit.timestamps").alias("ts_ms"),
                       F.col("hit.pages").alias("page")).filter("ts_ms is not null")


def user_visit_lists(rows: DataFrame, size: int = LIST_ROWS, hot=None) -> DataFrame:
    """Visits of a user as a list in rank order: ``(user_id, part, visits)``.

    A list holds at most ``size`` visits; a user with more has several parts, and every
    visit carries its rank.
    """
    ranked = rank_visits(rows, hot)
    item = F.struct("visit_rank", "site", "sending_page", "landing_page",
                    F.transform("timestamps", lambda x: x / F.lit(1000.0)).alias("timestamps"), "pages")
    return (ranked.select("user_id", F.floor((F.col("visit_rank") - 1) / size).alias("part"), item.alias("v"))
            .groupBy("user_id", "part").agg(F.array_sort(F.collect_list("v")).alias("visits")))


def site_keys(df: DataFrame, first_level: str, second_level: str) -> DataFrame:
    """Aggregation keys of both domain levels, and the domains back from the keys."""
    return df.selectExpr("*", f"concat({first_level}, '*') as first_key", f"concat({second_level}, '#') as second_key",
                         f"{strip_key('first_key')} as first_back", f"{strip_key('second_key')} as second_back")
