"""Combined user records: ``user_id, part, events, visits, split``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def combine(bags: DataFrame, visit_lists: DataFrame) -> DataFrame:
    """Join the event list of a user with the visit lists of the same user.

    Lists are bounded, and the event side has one row per user.  Only part 0 of a user carries
    the events.
    """
    return bags.join(visit_lists, "user_id").select(
        "user_id", "part", F.when(F.col("part") == 0, F.col("events")).alias("events"), "visits")


def write_combined(df: DataFrame, path: str, row_group_bytes: int = 1 << 20) -> None:
    """Parquet, gzip, small row groups, one folder per split."""
    (df.write.mode("overwrite").option("compression", "gzip")
     .option("parquet.block.size", row_group_bytes).partitionBy("split").parquet(path))


def read_combined(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


def events_of(combined: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Flat events, from the first part of a user; only ``columns`` are read from the file."""
    first = combined.filter("part = 0")
    if columns is None:
        return first.select("user_id", F.inline("events"))
    # Zipped by name, so the scan leaves the other fields of the array out.
    return first.select("user_id", F.inline(F.arrays_zip(*[F.col(f"events.{c}").alias(c) for c in columns]))).toDF(
        "user_id", *columns)


def visits_of(combined: DataFrame) -> DataFrame:
    """Flat visits with their stored rank; times back in milliseconds."""
    v = combined.select("user_id", F.explode("visits").alias("v")).select("user_id", "v.*")
    ms = F.transform("timestamps", lambda t: F.round(t * 1000).cast("long"))
    return v.withColumn("timestamps", ms).withColumn("first_ts", F.element_at("timestamps", 1)).withColumn(
        "visit_key", F.col("visit_rank"))


def schema_rows(df: DataFrame) -> list[str]:
    """A line for every column and every field inside it: path and type."""
    def lines(path, kind):
        yield f"{path} {kind.simpleString() if not isinstance(kind, (StructType, ArrayType)) else kind.typeName()}"
        if isinstance(kind, ArrayType):
            path, kind = f"{path}[]", kind.elementType
            if not isinstance(kind, StructType):
                yield from lines(path, kind)
        if isinstance(kind, StructType):
            for field in kind.fields:
                yield from lines(f"{path}.{field.name}", field.dataType)
    return [line for field in df.schema.fields for line in lines(field.name, field.dataType)]


def shown(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """``(kind, place, text)``: the lines of the schema, then the first ``n`` rows as JSON."""
    columns = df.sparkSession.createDataFrame(
        [("schema", i, line) for i, line in enumerate(schema_rows(df))], "kind string, place long, text string")
    first = df.orderBy(*order).limit(n).select(*order, F.to_json(F.struct(*df.columns)).alias("text"))
    place = F.row_number().over(Window.orderBy(*order)) - 1      # n rows
    return columns.unionByName(first.select(F.lit("row").alias("kind"), place.cast("long").alias("place"), "text"))


def preview(df: DataFrame) -> DataFrame:
    """First row as JSON."""
    return df.limit(1).select(F.to_json(F.struct("*")).alias("json"))
