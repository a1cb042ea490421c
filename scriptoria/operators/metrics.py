"""Request metrics: counters, histograms, rates, quantiles and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions import text as tx

# Upper bounds of the latency buckets in seconds.
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def request_counts(requests: DataFrame) -> DataFrame:
    """Requests by method, normalised endpoint and status."""
    rows = requests.withColumn("endpoint", tx.normalize_path(F.col("path")))
    return rows.groupBy("method", "endpoint", "status").agg(F.count("*").alias("n"))


def latency_histogram(requests: DataFrame, keys: list[str], seconds: str, buckets: list[float] | None = None) -> DataFrame:
    """(keys, le, n): cumulative counts per bucket; one aggregation, buckets unfolded afterwards."""
    buckets = buckets or LATENCY_BUCKETS
    counts = requests.groupBy(*keys).agg(
        *[F.count_if(F.col(seconds) <= b).alias(f"__b{i}") for i, b in enumerate(buckets)], F.count("*").alias("__all")
    )
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"__b{i}").alias("n")) for i, b in enumerate(buckets)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("__all").alias("n")))
    return counts.select(*keys, F.inline(F.array(*rows)))


def rate_series(requests: DataFrame, ts: str, status: str, span: int = 300, step: int = 60) -> DataFrame:
    """(at, total, client_errors, server_errors): requests per second over a sliding span.

    Requests are counted per step first; only those counts are repeated for the overlapping spans.
    """
    code = F.col(status)
    slot = F.floor(F.unix_timestamp(ts) / step) * step
    per_step = requests.groupBy(slot.alias("slot")).agg(
        F.count("*").alias("n"), F.count_if(code.between(400, 499)).alias("c"), F.count_if(code >= 500).alias("s")
    )
    ends = F.explode(F.sequence(F.col("slot") + step, F.col("slot") + span, F.lit(step)))
    spread = per_step.select(ends.alias("at"), "n", "c", "s")
    rate = lambda c: (F.sum(c) / span)
    return spread.groupBy("at").agg(rate("n").alias("total"), rate("c").alias("client_errors"), rate("s").alias("server_errors"))


def quantile_series(requests: DataFrame, keys: list[str], seconds: str, quantiles: dict[str, float], buckets: list[float] | None = None) -> DataFrame:
    """Quantiles per key by linear interpolation inside histogram buckets.

    A rank in the last, unbounded bucket gives the largest finite bound.
    """
    buckets = [float(b) for b in (buckets or LATENCY_BUCKETS)]
    counts = requests.groupBy(*keys).agg(
        F.array(*[F.count_if(F.col(seconds) <= b) for b in buckets], F.count("*")).alias("c")
    )
    uppers, c, last = F.array(*[F.lit(b) for b in buckets]), F.col("c"), len(buckets)
    for name, quantile in quantiles.items():
        rank = F.lit(quantile) * F.get(c, F.lit(last))
        at = F.size(F.filter(c, lambda n: n < rank))
        low = F.when(at == 0, F.lit(0.0)).otherwise(F.get(uppers, at - 1))
        below = F.when(at == 0, F.lit(0)).otherwise(F.get(c, at - 1))
        inside = F.get(c, at) - below
        value = low + (F.get(uppers, at) - low) * (rank - below) / inside
        counts = counts.withColumn(name, F.when(at >= last, F.lit(buckets[-1])).otherwise(value))
    return counts.drop("c")


def quantile_sketches(requests: DataFrame, keys: list[str], ts: str, seconds: str, window: str = "1 hour") -> DataFrame:
    """(keys, start, sketch): a KLL sketch of a duration for each key and window, to be kept as a table.

    A sketch has a few kB whatever it has seen, and sketches of shorter windows merge into those of longer ones.
    """
    rows = requests.groupBy(*keys, F.window(ts, window).alias("w")).agg(F.kll_sketch_agg_double(F.col(seconds).cast("double")).alias("sketch"))
    return rows.select(*keys, F.col("w.start").alias("start"), "sketch")


def merged_quantiles(sketches: DataFrame, by: list[Column], quantiles: dict[str, float]) -> DataFrame:
    """(by, n, quantiles) from the merged sketches of each group; the rank of a quantile is off by under 2 % of the rows."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for name, q in quantiles.items()]
    return merged.select(*[c for c in merged.columns if c != "sketch"], F.kll_sketch_get_n_double("sketch").alias("n"), *found)


def sustained(points: DataFrame, keys: list[str], at: str, condition: Column, step_seconds: int, hold_seconds: int, bucket: Column) -> DataFrame:
    """(keys, start, end, n): stretches in which the condition held at every step for at least the hold time."""
    true_points = points.filter(condition)
    runs = ordered.sessions(true_points, keys, at, at, step_seconds, bucket)
    return runs.filter(F.unix_timestamp("end") - F.unix_timestamp("start") >= hold_seconds)


def load_summary(requests: DataFrame, seconds: str, status: Column, ts: str) -> DataFrame:
    """One row: totals, latency statistics, p95 and p99 by rank, requests per second, success rate."""
    n = requests.filter(F.col(seconds).isNotNull()).count()
    p95, p99 = ordered.order_statistics(requests, seconds, [int(n * q) for q in (0.95, 0.99)]) if n else (0.0, 0.0)
    ok = F.count_if(status.between(200, 299))
    span = F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))
    return requests.agg(
        F.count("*").alias("total"), ok.alias("successful"), (F.count("*") - ok).alias("failed"),
        F.avg(seconds).alias("mean"), F.min(seconds).alias("fastest"), F.max(seconds).alias("slowest"),
        F.when(span > 0, F.count("*") / (span / 1e6)).otherwise(0.0).alias("per_second"), (ok / F.count("*")).alias("success_rate"),
    ).withColumns({"p95": F.lit(p95), "p99": F.lit(p99)})


def variability(requests: DataFrame, keys: list[str], seconds: str, limit: float = 0.5, at_least: int = 10) -> DataFrame:
    """Coefficient of variation per key with at least ten samples, and whether it is below the limit."""
    out = requests.groupBy(*keys).agg(F.count("*").alias("n"), (F.stddev_samp(seconds) / F.avg(seconds)).alias("variation"))
    return out.filter(F.col("n") >= at_least).withColumn("stable", F.col("variation") < limit)
