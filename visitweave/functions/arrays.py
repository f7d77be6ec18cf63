"""Array expressions: vectors, one-hot labels, padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitweave.config import VECTOR_SIZE


def zeros(size: int = VECTOR_SIZE) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), size)


def vector_sum(vectors: Column, size: int = VECTOR_SIZE) -> Column:
    """Element-wise float sum of an array of equally long vectors, in array order."""
    return F.aggregate(vectors, zeros(size), lambda acc, v: F.zip_with(
        acc, v, lambda a, b: (a + b).cast("float")))


def scale(vector: Column, factor: float) -> Column:
    return F.transform(vector, lambda x: (x * F.lit(factor).cast("float")).cast("float"))


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)),
                       lambda i: (i == label).cast("int"))


def arg_max(scores: Column) -> Column:
    """0-based place of the largest score; the first one wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def pad_left(values: Column, size: int, fill: Column) -> Column:
    return F.concat(F.array_repeat(fill, F.greatest(F.lit(0), F.lit(size) - F.size(values))), values)

