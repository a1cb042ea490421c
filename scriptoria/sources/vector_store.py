"""Vectors kept as a Parquet table: write, look up, add and remove."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_vectors(vectors: DataFrame, path: str, mode: str = "append") -> None:
    """Append (id, vector, metadata columns) to the store."""
    vectors.write.mode(mode).parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def zip_ids(rows: DataFrame, ids: str, vectors: str) -> DataFrame:
    """Rows of parallel id and vector arrays as one vector per row; unequal lengths are an error."""
    checked = F.when(
        F.size(ids) != F.size(vectors), F.raise_error(F.lit("number of ids and vectors differ"))
    ).otherwise(F.arrays_zip(F.col(ids).alias("id"), F.col(vectors).alias("vector")))
    return rows.select(F.inline(checked))


def lookup(ids: DataFrame, store: DataFrame, on: str) -> DataFrame:
    """Every requested id with its vector, null where the store has none."""
    return ids.join(store, on, "left")


def add_missing(store: DataFrame, batch: DataFrame, on: str) -> DataFrame:
    """Rows of ``batch`` to append: ids the store does not hold, first of a repeated id."""
    return batch.dropDuplicates([on]).join(store.select(on), on, "left_anti")


def remove(store: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return store.join(ids.select(on), on, "left_anti")
