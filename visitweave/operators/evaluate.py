"""Scores, confusion matrix, accuracy and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitweave.config import MAX_VISITS
from visitweave.functions.arrays import arg_max


def predicted_class(df: DataFrame, scores: str = "scores", out: str = "predicted") -> DataFrame:
    return df.withColumn(out, arg_max(F.col(scores)))


def confusion(predictions: DataFrame, classes: int = MAX_VISITS) -> DataFrame:
    """``(predicted, actual, n)`` for every pair of classes, zero cells included."""
    counts = predictions.groupBy("predicted", "actual").agg(F.count(F.lit(1)).alias("n"))
    ids = F.sequence(F.lit(0), F.lit(classes - 1))
    grid = (predictions.sparkSession.range(1).select(F.explode(ids).alias("predicted"))
            .select("predicted", F.explode(ids).alias("actual")))
    return grid.join(counts, ["predicted", "actual"], "left").select(
        "predicted", "actual", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_wide(predictions: DataFrame, classes: int = MAX_VISITS) -> DataFrame:
    """One row per predicted class, one column ``actual_i`` per actual class."""
    cells = confusion(predictions, classes)
    return cells.groupBy("predicted").agg(*[
        F.sum(F.when(F.col("actual") == i, F.col("n"))).alias(f"actual_{i}") for i in range(classes)])


def confusion_share(cells: DataFrame) -> DataFrame:
    """Cells of a confusion matrix as shares of its total (0 for an empty matrix)."""
    total = cells.agg(F.sum("n")).scalar()
    return cells.select("predicted", "actual", F.coalesce(
        F.try_divide(F.col("n"), total), F.lit(0.0)).alias("share"))


def accuracy(predictions: DataFrame) -> DataFrame:
    """``(accuracy, n_samples)``."""
    hit = (F.col("predicted") == F.col("actual")).cast("int")
    return predictions.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n_samples"))


def referral_votes(predictions: DataFrame, classes: int = MAX_VISITS) -> DataFrame:
    """Referral of a visit: the commonest non-zero prediction of its events.

    The lowest class wins a tie; 0 without any vote.  ``predictions`` needs ``user_id,
    visit_rank, predicted``.
    """
    votes = predictions.groupBy("user_id", "visit_rank").agg(
        F.array(*[F.count_if(F.col("predicted") == c) for c in range(1, classes)]).alias("votes"))
    return votes.select("user_id", "visit_rank", F.when(
        F.array_max("votes") > 0, arg_max(F.col("votes")) + 1).otherwise(0).alias("referral"))


def visit_votes(predictions: DataFrame, visits: int = MAX_VISITS) -> DataFrame:
    """Visit of an event: the one with most ``belongs`` (class 0) predictions.

    The lowest rank wins a tie; 0 without any.  ``predictions`` needs ``user_id, event_id,
    visit_rank`` (up to ``visits``) and ``predicted``.
    """
    said = F.col("predicted") == 0
    votes = predictions.groupBy("user_id", "event_id").agg(
        F.array(*[F.count_if(said & (F.col("visit_rank") == v)) for v in range(1, visits + 1)]).alias("votes"))
    return votes.select("user_id", "event_id", F.when(
        F.array_max("votes") > 0, arg_max(F.col("votes")) + 1).otherwise(0).alias("voted_visit"))
