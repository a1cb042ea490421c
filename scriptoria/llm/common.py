"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch, stage, unstage

__all__ = ["bounded", "ensure_checkpoint_dir", "fresh", "let", "load", "running_sums", "scratch", "stage", "unstage"]

#: Rows that are sent to every executor at most; of keys and hashes, some 100 bytes each.
BROADCAST_ROWS = 100_000


def bounded(df: DataFrame) -> DataFrame:
    """``df``, a staged table of short rows, marked for broadcast if it has at most `BROADCAST_ROWS` rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no frame has a column of that name in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is used.

    The optimizer may otherwise copy the expression into a lambda, where it runs for every element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column) -> Column:
    none = F.array().cast("array<bigint>")
    return F.aggregate(
        values, none, lambda done, v: F.concat(done, F.array(F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)) + v))
    )


def running_sums(values: Column, chunk: int = 256) -> Column:
    """Sums of the first 1, 2, ... values; in chunks, so that the copying of arrays stays linear."""
    def of(v: Column) -> Column:
        return let(
            F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int")), lambda c: F.slice(v, c * chunk + 1, F.lit(chunk))),
            lambda parts: let(
                _running(F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + x))),
                lambda totals: F.flatten(F.transform(
                    parts, lambda p, c: let(F.coalesce(F.get(totals, c - 1), F.lit(0)), lambda base: F.transform(_running(p), lambda s: s + base))
                )),
            ),
        )

    longs = values.cast("array<bigint>")
    return F.when(F.size(longs) > 0, let(longs, of)).otherwise(F.array().cast("array<bigint>"))
