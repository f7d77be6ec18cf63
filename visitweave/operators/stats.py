"""Dataset statistics of the split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _per_split(values: DataFrame, value: str, name: str) -> DataFrame:
    """Distinct counts of ``value`` for train, test and overall, counting every value once."""
    flags = values.groupBy(value).agg(F.bool_or(F.col("split") == "train").alias("tr"),
                                      F.bool_or(F.col("split") == "test").alias("te"))
    row = flags.agg(F.count_if("tr").alias("train"), F.count_if("te").alias("test"),
                    F.count(F.lit(1)).alias("overall"))
    return row.unpivot([], ["train", "test", "overall"], "part", name)


def _totals(df: DataFrame, name: str) -> DataFrame:
    row = df.agg(F.count_if(F.col("split") == "train").alias("train"),
                 F.count_if(F.col("split") == "test").alias("test"), F.count(F.lit(1)).alias("overall"))
    return row.unpivot([], ["train", "test", "overall"], "part", name)


def dataset_statistics(events: DataFrame, visits: DataFrame) -> DataFrame:
    """Visits, page views, unique domains and unique users for train, test and overall.

    ``events`` needs ``user_id, domain, split``, ``visits`` needs ``split``.
    """
    tables = [_totals(visits, "n_visits"), _totals(events, "n_page_views"),
              _per_split(events.select("domain", "split"), "domain", "n_domains"),
              _per_split(events.select("user_id", "split"), "user_id", "n_users")]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    names = ["n_visits", "n_page_views", "n_domains", "n_users"]
    return rows.groupBy("part").agg(*[F.max(n).alias(n) for n in names])


def domain_overlap(events: DataFrame) -> DataFrame:
    """Domains in both splits and the share of test domains unseen in training."""
    flags = events.groupBy("domain").agg(F.bool_or(F.col("split") == "train").alias("tr"),
                                         F.bool_or(F.col("split") == "test").alias("te"))
    both = F.count_if(F.col("tr") & F.col("te"))
    return flags.agg(both.alias("n_both"), F.count_if("te").alias("n_test")).select(
        "n_both", "n_test", F.when(F.col("n_test") > 0, 1 - F.col("n_both") / F.col("n_test")).alias("unseen_share"))


def daily_bitmaps(values: DataFrame, kind: str) -> DataFrame:
    """``kind, day, split, bucket, bits``: which ids (``day, split, id`` rows, small numbers) a day has.

    Exact, a bit per id.  A day's rows are made from that day alone; older ones are not read.
    """
    return values.filter("id is not null").groupBy(F.lit(kind).alias("kind"), "day", "split", F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def merged_counts(bitmaps: DataFrame) -> DataFrame:
    """``kind, train, test, overall, both``: distinct ids of any number of days, from their bitmaps."""
    sides = bitmaps.groupBy("kind", "bucket", "split").agg(F.bitmap_or_agg("bits").alias("bits"))
    part = lambda s: F.coalesce(F.bitmap_count(F.max(F.when(F.col("split") == s, F.col("bits")))), F.lit(0))
    buckets = sides.groupBy("kind", "bucket").agg(part("train").alias("train"), part("test").alias("test"),
                                                  F.bitmap_count(F.bitmap_or_agg("bits")).alias("overall"))
    total = [F.sum(c).alias(c) for c in ("train", "test", "overall")]
    return buckets.groupBy("kind").agg(*total).withColumn("both", F.col("train") + F.col("test") - F.col("overall"))
