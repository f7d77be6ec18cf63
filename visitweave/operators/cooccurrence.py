"""Embeddings of vocabularies of any size: co-occurrence counts, positive PMI, implicit ALS.

Counts are a grouping, the association of two tokens a join with their totals, and the factors come out
of Spark's alternating least squares as a table, so that nothing as large as the vocabulary is ever in one place.
"""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitweave.config import MIN_COUNT, VECTOR_SIZE, W2V_ITERATIONS
from visitweave.functions.arrays import zeros
from visitweave.operators import grouped
from visitweave.storage import durable

#: Tokens on either side that count as context.
WINDOW = 5


def _times(times: str | None) -> Column:
    return (F.lit(1) if times is None else F.col(times)).cast("long").alias("_times")


def vocabulary(sentences: DataFrame, column: str, min_count: int = MIN_COUNT, times: str | None = None) -> DataFrame:
    """``token, n_tokens`` of the tokens seen ``min_count`` times or more."""
    return (sentences.select(F.explode(column).alias("token"), _times(times)).filter("token is not null")
            .groupBy("token").agg(F.sum("_times").alias("n_tokens")).filter(F.col("n_tokens") >= min_count))


def pair_counts(sentences: DataFrame, column: str, window: int = WINDOW, times: str | None = None) -> DataFrame:
    """``token, context, n``: how often two tokens stand at most ``window`` places apart, both ways round.

    Column ``times`` says how often a sentence stands there, which is once without it.
    """
    words = F.col(column)
    after = F.transform(words, lambda w, i: F.transform(F.slice(words, i + 2, F.lit(window)), lambda c: F.struct(
        w.alias("token"), c.alias("context"))))
    one = sentences.select(F.inline(F.flatten(after)), _times(times)).filter("token is not null and context is not null")
    both = one.select("_times", F.inline(F.array(F.struct("token", "context"), F.struct(
        F.col("context").alias("token"), F.col("token").alias("context")))))
    return both.groupBy("token", "context").agg(F.sum("_times").alias("n"))


def positive_pmi(counts: DataFrame) -> DataFrame:
    """``counts`` of pairs that stand together more often than their totals explain, with their ``pmi``."""
    total = counts.agg(F.sum("n")).scalar()
    alone = counts.groupBy("token").agg(F.sum("n").alias("n_token"))
    other = alone.select(F.col("token").alias("context"), F.col("n_token").alias("n_context"))
    pmi = F.log(F.col("n").cast("double") * total / (F.col("n_token").cast("double") * F.col("n_context")))
    return counts.join(alone, "token").join(other, "context").select("token", "context", "n", pmi.alias("pmi")).filter("pmi > 0")


def fit(sentences: DataFrame, column: str = "words", seed: int = 0, min_count: int = MIN_COUNT,
        iterations: int = W2V_ITERATIONS, size: int = VECTOR_SIZE, window: int = WINDOW, times: str | None = None) -> DataFrame:
    """``token, vector array<float>`` of every token seen ``min_count`` times; zeros for one without neighbours."""
    tokens = durable(vocabulary(sentences, column, min_count, times).select("token"))
    ids = durable(grouped.position(tokens, [], ["token"], "_rank").select("token", (F.col("_rank") - 1).cast("int").alias("id")))
    context = tokens.withColumnRenamed("token", "context")
    counts = durable(pair_counts(sentences, column, window, times).join(tokens, "token", "left_semi").join(context, "context", "left_semi"))
    other = ids.select(F.col("token").alias("context"), F.col("id").alias("context_id"))
    rated = durable(positive_pmi(counts).join(ids, "token").join(other, "context").select("id", "context_id", "pmi"))
    if rated.isEmpty():
        return tokens.select("token", zeros(size).alias("vector"))
    blocks = sentences.sparkSession.sparkContext.defaultParallelism
    model = ALS(rank=size, maxIter=iterations, regParam=0.05, implicitPrefs=True, alpha=4.0, seed=seed, userCol="id",
                itemCol="context_id", ratingCol="pmi", numUserBlocks=blocks, numItemBlocks=blocks).fit(rated)
    return durable(ids.join(model.userFactors, "id", "left").select(
        "token", F.coalesce(F.col("features").cast("array<float>"), zeros(size)).alias("vector")))
