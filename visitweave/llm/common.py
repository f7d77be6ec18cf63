"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitweave.storage import durable, fresh_path, shared_dir  # noqa: F401  (used by the operators)

#: Documents handed to a Python worker at once.
BATCH_ROWS = 256
#: Bytes after which such a batch ends; a longer text is a batch of its own.
BATCH_BYTES = 1 << 22
#: Keys that are broadcast as they are, and bits of the bitmap that stands for more of them.
LISTED, BITMAP_BITS = 200_000, 1 << 28
#: Text in a range of documents, and ranges at most: with more text than fits these, ranges grow and a task sorts more.
RANGE_BYTES, MOST_RANGES = 1 << 24, 8_192
#: Fixed value: the characters that separate words (space, tab to carriage return).
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Keep Arrow batches small, in rows and bytes: a row holds a whole text, which may be very long.

    These are session settings and stay set, since a plan reads them when it runs; they only bound memory.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, none for a null or blank one."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def hash_share(parts: int, *columns) -> Column:
    """Number from 0 to ``parts - 1`` drawn from a hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(parts).cast("long"))


def blocks_for(rows: int, size: int) -> int:
    """How many blocks of about ``size`` rows ``rows`` rows make."""
    return max(1, -(-rows // size))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, spread: Column, buckets: int) -> DataFrame:
    """Add a gapless 0-based number per group, for groups of any size.

    Rows of a group are dealt to ``buckets`` buckets by ``spread`` (0 to buckets - 1); a bucket's
    first number is the count of rows in the buckets before it, so a task sorts one bucket only.
    Buckets come in the order of ``spread``.
    """
    from pyspark.sql import Window

    dealt = df.withColumn("_bucket", spread.cast("int"))
    keys = [*group, "_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
              .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    own = Window.partitionBy(*keys).orderBy(*order)
    return (dealt.withColumn("_own", F.row_number().over(own) - 1).join(starts, keys)
            .withColumn(name, F.col("_start") + F.col("_own")).drop("_bucket", "_own", "_start"))


def ranges_for(docs: DataFrame, size: int = RANGE_BYTES, most: int = MOST_RANGES) -> int:
    """How many ranges of about ``size`` bytes of text ``docs`` make, ``most`` at most."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0]   # rows without text count too
    return min(most, blocks_for(total or 0, size))


def range_numbers(df: DataFrame, column: str, parts: int) -> DataFrame:
    """Add ``_range``, 0 to ``parts - 1`` at most: rows with smaller values get smaller numbers.

    Bounds are approximate quantiles and explicit, so every job that uses the result deals rows
    alike; equal values share a range, and nulls come after all others.
    """
    from pyspark.ml.feature import Bucketizer

    if parts > 1:
        at = [i / parts for i in range(1, parts)]
        bounds = sorted(set(df.select(F.col(column).cast("double").alias("v")).approxQuantile("v", at, 0.1 / parts)))
        if bounds:
            splits = [float("-inf"), *bounds, float("inf")]
            ranged = Bucketizer(splits=splits, inputCol="_value", outputCol="_range", handleInvalid="keep")
            return (ranged.transform(df.withColumn("_value", F.col(column).cast("double")))
                    .withColumn("_range", F.coalesce(F.col("_range").cast("int"), F.lit(len(splits) - 1))).drop("_value"))
    return df.withColumn("_range", F.col(column).isNull().cast("int"))


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row per key), nulls where there is none.

    ``weight`` is the number of ``rows`` with that key and ``total`` that of all rows.  Keys with
    more than a thousandth of all rows, of which there are under a thousand, are broadcast; the
    others meet in an ordinary join, so no task gets all rows of a hot key.  Both should be stored.
    """
    hot = facts.filter(F.col(weight) * 1000 > total)
    hit = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rest.join(facts.filter(F.col(weight) * 1000 <= total), keys, "left").unionByName(hit)


def sift(rows: DataFrame, wanted: DataFrame, keys: list[str], inside: bool = True) -> DataFrame:
    """Rows that may be among ``wanted`` by ``keys`` (all that are, and few others), or those that surely are not.

    Nothing is shuffled.  Up to ``LISTED`` keys are broadcast; more are marked in a bitmap by their hash, which has
    16 bits for each of them and ``BITMAP_BITS`` (32 MB) at most, so beyond that it lets more through.
    """
    number = wanted.count()
    if number <= LISTED:
        return rows.join(F.broadcast(wanted.select(*keys)), keys, "left_semi" if inside else "left_anti")
    bits = min(BITMAP_BITS, 1 << (16 * number - 1).bit_length())
    place = hash_share(bits, *keys)
    bitmap = wanted.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_bits"))
    at = F.bitmap_bit_position(place)
    marked = rows.join(F.broadcast(bitmap), F.bitmap_bucket_number(place) == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return marked.filter(hit if inside else ~hit).select(*rows.columns)
