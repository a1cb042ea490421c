"""A Parquet table in buckets of a key's hash, of which an update reads and writes only those that its keys fall into."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, stage

#: Buckets of a new table; each is a folder, and the least that an update rewrites.
BUCKETS = 64
BUCKET = "bucket"


def _bucketed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Write a new table; every bucket's rows come from one task."""
    _bucketed(rows, keys, buckets).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def _sums(rows: DataFrame) -> DataFrame:
    """A count and sum of row hashes for each bucket, which tell whether its rows changed."""
    columns = sorted(c for c in rows.columns if c != BUCKET)
    row = F.xxhash64(*(F.struct(F.col(c).isNull(), c) for c in columns)).cast("decimal(38,0)")
    return rows.groupBy(BUCKET).agg(F.count("*").alias("n"), F.sum(row).alias("sum"))


def update(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> list[int]:
    """Put ``merge(stored, changes)`` in the place of the stored rows; returns the buckets that were written.

    ``merge`` sees the stored rows of the buckets of the changes' keys and may only make rows of those keys' buckets. Its
    result is written beside the table first, buckets whose rows stay the same are left alone, and the others are replaced by
    Spark's dynamic partition overwrite, so the same update again changes nothing. One writer at a time; a reader of the same moment may see some
    buckets before and some after.
    """
    touched = [r[0] for r in _bucketed(changes, keys, buckets).select(BUCKET).distinct().collect()]
    stored = spark.read.parquet(path).filter(F.col(BUCKET).isin(touched)) if touched else None
    if stored is None:
        return []
    with scratch(spark):
        merged = stage(_bucketed(merge(stored.drop(BUCKET), changes), keys, buckets), "merged")
        old, new = _sums(stored.withColumn(BUCKET, F.col(BUCKET).cast("int"))), _sums(merged)
        both = old.withColumnsRenamed({"n": "n0", "sum": "sum0"}).join(new, BUCKET, "full")
        changed = both.filter(~(F.col("n").eqNullSafe(F.col("n0")) & F.col("sum").eqNullSafe(F.col("sum0")))).select(BUCKET, "n").collect()
        filled, empty = [r[0] for r in changed if r.n], [r[0] for r in changed if not r.n]
        if filled:
            rows = merged.filter(F.col(BUCKET).isin(filled)).select(*stored.drop(BUCKET).columns, BUCKET).repartition(BUCKET)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
        for bucket in empty:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{BUCKET}={bucket}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return sorted(filled + empty)


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Merge: the changes' rows in the place of stored ones of their keys."""
    return stored.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*stored.columns))
