"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [0, 1]; 0 when either vector has no length."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    length = norm(a) * norm(b)
    return F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / length))).otherwise(0.0)


def with_unit(df: DataFrame, vector: str, out: str) -> DataFrame:
    """Add ``out``: the vector scaled to length one, all zeros when it has no length."""
    df = df.withColumn("__v", F.col(vector).cast("array<double>")).withColumn("__n", norm(F.col("__v")))
    n = F.col("__n")
    # Two references keep the norm a column of its own instead of one evaluation per element.
    return df.withColumn(out, F.when(n > 0, F.transform("__v", lambda x: x / n)).otherwise(F.col("__v"))).drop("__v", "__n")
