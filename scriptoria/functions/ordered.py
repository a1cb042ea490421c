"""Ordered operations over keys that may hold a large part of the rows.

A plain window over one key sorts all its rows in one task. These helpers cut a key's history
into buckets (days, hours), work inside the buckets in parallel, and pass only one row per bucket
on to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage


def with_previous(df: DataFrame, keys: list[str], order: list[str], bucket: Column, columns: list[str]) -> DataFrame:
    """Add ``prev_<column>``: the value in the key's preceding row by ``order`` (a total order).

    ``bucket`` must not decrease along ``order``.
    """
    rows = df.withColumn("__b", bucket)
    inside = W.partitionBy(*keys, "__b").orderBy(*order)
    local = rows.withColumns(
        {f"prev_{c}": F.lag(c).over(inside) for c in columns} | {"__first": F.row_number().over(inside) == 1}
    )
    last = rows.groupBy(*keys, "__b").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__last"))
    carried = last.withColumn("__carried", F.lag("__last").over(W.partitionBy(*keys).orderBy("__b"))).drop("__last")
    out = local.join(carried, [*keys, "__b"])
    return out.withColumns(
        {
            f"prev_{c}": F.when(F.col("__first"), F.col(f"__carried.{c}")).otherwise(F.col(f"prev_{c}"))
            for c in columns
        }
    ).drop("__b", "__first", "__carried")


def _pieces(rows: DataFrame, keys: list[str], ts: str, tie: str, extra: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``__local`` run numbers per bucket, and one row per piece of a run inside a bucket.

    ``rows`` has the bucket ``__day`` and the flag ``__opens``.
    """
    inside = W.partitionBy(*keys, "__day").orderBy(ts, tie)
    rows = rows.withColumn("__local", F.sum(F.col("__opens").cast("int")).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    pieces = rows.groupBy(*keys, "__day", "__local").agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"), F.max("__opens").alias("opens"),
        *[F.sum(c).alias(n) for n, c in extra.items()],
    )
    latest = F.max("__local").over(W.partitionBy(*keys, "__day"))
    return rows, pieces.withColumn("__border", (F.col("__local") == latest) | ~F.col("opens"))


def _chained(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces at a bucket border, numbered by the run they belong to; at most two per bucket."""
    chain = W.partitionBy(*keys).orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    return pieces.filter("__border").withColumn("__group", F.sum(F.col("opens").cast("int")).over(chain))


def runs(
    df: DataFrame, keys: list[str], ts: str, tie: str, opens: Column, bucket: Column, previous: list[str],
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """(keys, start, end, n): stretches of rows, a new one wherever ``opens`` holds.

    ``opens`` may read ``prev_<column>`` of the ``previous`` columns and must hold in a key's first
    row. ``extra`` adds sums per run. Runs inside one bucket are final; only the pieces that touch
    a bucket border are put together in a second step.
    """
    extra = extra or {}
    rows = with_previous(df.withColumn("__day", bucket), keys, [ts, tie], F.col("__day"), previous).withColumn("__opens", opens)
    _, pieces = _pieces(rows, keys, ts, tie, extra)
    names = [*keys, "start", "end", "n", *extra]
    merged = _chained(pieces, keys).groupBy(*keys, "__group").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in extra]
    )
    return pieces.filter(~F.col("__border")).select(*names).unionByName(merged.select(*names))


def gap_opens(ts: str, gap_seconds: int) -> Column:
    """A row more than the gap after the preceding one."""
    return F.col(f"prev_{ts}").isNull() | (F.col(ts) > F.col(f"prev_{ts}") + F.make_dt_interval(secs=F.lit(gap_seconds)))


def sessions(
    df: DataFrame, keys: list[str], ts: str, tie: str, gap_seconds: int, bucket: Column, extra: dict[str, Column] | None = None
) -> DataFrame:
    """(keys, start, end, n): runs of rows no further apart than the gap."""
    return runs(df, keys, ts, tie, gap_opens(ts, gap_seconds), bucket, [ts], extra)


def with_session(df: DataFrame, keys: list[str], ts: str, tie: str, gap_seconds: int, bucket: Column) -> DataFrame:
    """Add ``session_start`` to every row."""
    rows = with_previous(df.withColumn("__day", bucket), keys, [ts, tie], F.col("__day"), [ts])
    rows, pieces = _pieces(rows.withColumn("__opens", gap_opens(ts, gap_seconds)), keys, ts, tie, {})
    at = [*keys, "__day", "__local"]
    first = F.min("start").over(W.partitionBy(*keys, "__group"))
    border = _chained(pieces, keys).select(*at, first.alias("session_start"))
    closed = pieces.filter(~F.col("__border")).select(*at, F.col("start").alias("session_start"))
    return rows.join(closed.unionByName(border), at).select(*df.columns, "session_start")


def newest(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per key by ``order``; each task keeps k rows per key before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= k).withColumnRenamed("__rank", "rank")


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> list[float | None]:
    """Exact values at 0-based ranks of the sorted column, without sorting it in one task; None beyond its end.

    Values are counted, the counts dealt out by ranges of the value and summed per range; the sums before each
    range are a row per range, and only within a range is a running sum taken. The counts are made once for all ranks.
    """
    counts = df.select(F.col(column).alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    dealt = stage(counts.repartitionByRange("v").withColumn("range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("range").agg(F.sum("n").alias("total"))
    before = totals.select("range", (F.sum("total").over(W.orderBy("range")) - F.col("total")).alias("before"), "total")
    wanted = F.array(*(F.lit(r).cast("long") for r in ranks))
    inside = F.filter(wanted, lambda r: (F.col("before") <= r) & (F.col("before") + F.col("total") > r))
    hit = before.withColumn("inside", inside).filter(F.size("inside") > 0)
    running = F.sum("n").over(W.partitionBy("range").orderBy("v")) + F.col("before")
    rows = dealt.join(hit, "range").withColumn("c", running).withColumn("r", F.explode("inside")).filter(F.col("c") > F.col("r"))
    found = {r.r: r.v for r in rows.groupBy("r").agg(F.min("v").alias("v")).collect()}
    return [found.get(r) for r in ranks]


def order_statistic(df: DataFrame, column: str, rank: int) -> float | None:
    """Exact value at a 0-based rank of the sorted column."""
    return order_statistics(df, column, [rank])[0]
