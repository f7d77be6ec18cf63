"""Records kept by day and user, so that a day is replaced alone and joins need no shuffle.

A table has a folder per day; in it rows are dealt to buckets and sorted by ``user_day``, a user on a day.
Tables with as many buckets join on that column bucket by bucket.  The catalogue of a session forgets its
tables; ``attach`` makes them known again from their folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
KEY = "user_day"
#: An option of the table: overwriting replaces the days that are written.
MODE = {"partitionOverwriteMode": "dynamic"}


def with_key(df: DataFrame, user: str = "user_id", ts_ms: str = "ts_ms") -> DataFrame:
    """Add ``day`` (UTC) and ``user_day``."""
    day = F.date_format(F.timestamp_millis(F.floor(F.col(ts_ms) / 86_400_000) * 86_400_000).cast("timestamp_ntz"), "yyyy-MM-dd")
    return df.withColumn("day", day).withColumn(KEY, F.concat(F.col(user).cast("string"), F.lit("|"), F.col("day")))


def create(df: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> None:
    """A new table for rows like those of ``df``, which stays empty."""
    columns = [c for c in df.columns if c != "day"]
    (df.select(*columns, "day").limit(0).write.format("parquet").options(**MODE).option("path", path).partitionBy("day")
     .bucketBy(buckets, KEY).sortBy(KEY).saveAsTable(name))


def attach(spark: SparkSession, schema: str, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Make a folder written by another session known as a table; ``schema`` has ``day`` last."""
    spark.sql(f"create table {name} ({schema}) using parquet options (partitionOverwriteMode 'dynamic') partitioned by (day) "
              f"clustered by ({KEY}) sorted by ({KEY}) into {buckets} buckets location '{path}'")
    spark.catalog.recoverPartitions(name)


def write(df: DataFrame, name: str, buckets: int = BUCKETS) -> None:
    """Put the days of ``df`` in place of what the table has of them; other days stay as they are.

    Rows are dealt to their buckets first, so a day has one file per bucket.
    """
    columns = [c for c in df.sparkSession.table(name).columns]
    dealt = df.select(*columns).repartition(buckets, KEY).sortWithinPartitions("day", KEY)
    dealt.write.insertInto(name, overwrite=True)


def records(spark: SparkSession, events: str, visits: str) -> DataFrame:
    """Events with the visits of their user and day; ``visits`` has one row for each."""
    right = spark.table(visits).drop("day", "user_id")
    return spark.table(events).join(right, KEY)
