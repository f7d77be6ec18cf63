"""Reproducible train/test split, sampling and the training feed."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitweave.config import BATCH_ROWS, TRAIN_FRACTION
from visitweave.operators import grouped
from visitweave.operators.grouped import HotGroups, Running


def md5_bucket(text: Column, buckets: int) -> Column:
    """Stable bucket of a text, the same in every run and engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % buckets


def with_split(df: DataFrame, user: str = "user_id", method: str = "hash", seed: int = 0) -> DataFrame:
    """Add ``split``: about a tenth of the users is ``test``, the rest ``train``.

    ``hash`` depends on the user only.  ``rand`` draws per row, as in the published
    program, and so belongs on one-row-per-user data.
    """
    if method == "hash":
        test = md5_bucket(F.col(user), 10) == 0
    elif method == "rand":
        test = F.rand(seed) < 0.1
    else:
        raise ValueError("method is 'hash' or 'rand'")
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def draws(fraction: float, *parts) -> Column:
    """How often a row is drawn: a Poisson number with mean ``fraction``, from an md5 of ``parts``.

    A 32-bit share of the md5 is held against the cumulative chances of 0, 1, 2, ... draws.
    """
    text = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return sum((F.when(md5_bucket(text, 1 << 32) >= b, 1).otherwise(0) for b in poisson_bounds(fraction)), F.lit(0))


def poisson_bounds(mean: float) -> list[int]:
    """Cumulative Poisson chances in units of 2**-32, up to the last that is below 1."""
    out, term, total, k = [], exp(-mean), exp(-mean), 0
    while total * (1 << 32) < (1 << 32) - 1 and k < 1000:
        out.append(round(total * (1 << 32)))
        k += 1
        term *= mean / k
        total += term
    return out


def sample(df: DataFrame, fraction: float = TRAIN_FRACTION, seed: int = 0,
           keys: Sequence[str] = ("user_id", "event_id")) -> DataFrame:
    """Sample with replacement; a fraction of 1 or more returns everything.

    The draw depends on the seed and the row's ``keys`` only, not on how rows are dealt to tasks.
    """
    if fraction >= 1.0:
        return df
    times = df.withColumn("_times", draws(fraction, F.lit(seed), *keys)).filter("_times > 0")
    return times.select(*df.columns, F.explode(F.sequence(F.lit(1), "_times")).alias("_time")).drop("_time")


def epochs(df: DataFrame, n: int, fraction: float = TRAIN_FRACTION, seed: int = 0,
           keys: Sequence[str] = ("user_id", "event_id")) -> DataFrame:
    """A fresh sample per epoch, told apart by ``epoch``, from one pass over ``df``."""
    each = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if fraction >= 1.0:
        return each
    times = each.withColumn("_times", draws(fraction, F.col("epoch") + seed, *keys)).filter("_times > 0")
    return times.select(*each.columns, F.explode(F.sequence(F.lit(1), "_times")).alias("_time")).drop("_time")


def feed_order(user_rows: DataFrame, shards: int = 64, seed: int = 0, hot: HotGroups | None = None) -> DataFrame:
    """Shuffled reading order of ``(user_id, n_rows)``: shard and rank within it."""
    keyed = user_rows.select("user_id", "n_rows", md5_bucket(F.col("user_id"), shards).alias("shard"),
                             F.md5(F.concat(F.lit(f"{seed}|"), "user_id")).alias("_key"))
    return grouped.position(keyed, ["shard"], ["_key", "user_id"], "feed_rank", hot).drop("_key")


def batches(user_rows: DataFrame, batch_size: int = BATCH_ROWS, shards: int = 64, seed: int = 0,
            literal: bool = False) -> DataFrame:
    """Batches of whole users along the feed order: adds ``batch_id`` per shard.

    Default: the rows of earlier users in the shard, divided by the batch size.
    ``literal`` closes a batch once its rows exceed the size, which has to walk a shard in
    order: a task walks its sorted shards in a stream, holding one batch of rows at a time.
    """
    keyed = user_rows.select("user_id", "n_rows", md5_bucket(F.col("user_id"), shards).alias("shard"),
                             F.md5(F.concat(F.lit(f"{seed}|"), "user_id")).alias("_key"))
    out = grouped.running(keyed, ["shard"], ["_key", "user_id"], {
        "feed_rank": Running("count"), "_before": Running("sum", F.col("n_rows"), inclusive=False)}).drop("_key")
    if not literal:
        return out.withColumn("batch_id", F.floor(F.coalesce("_before", F.lit(0)) / batch_size)).drop("_before")

    def close_when_over(frames):
        shard, batch, filled = None, 0, 0
        for pdf in frames:
            ids = []
            for own, rows in zip(pdf["shard"], pdf["n_rows"]):
                if own != shard:
                    shard, batch, filled = own, 0, 0
                ids.append(batch)
                filled += rows
                if filled > batch_size:
                    batch, filled = batch + 1, 0
            yield pdf.assign(batch_id=ids)
    return out.drop("_before").repartition(shards, "shard").sortWithinPartitions("shard", "feed_rank").mapInPandas(
        close_when_over, "user_id string, n_rows long, shard long, feed_rank long, batch_id long")
