"""Institution dashboards over submission and outlier records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ["low", "medium", "high"]


def submission_trend(rows: DataFrame, ts: str, passed: Column) -> DataFrame:
    """Per day: submissions, pass rate and fail rate in percent."""
    daily = rows.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), (F.avg(passed.cast("int")) * 100).alias("pass_rate"))
    return daily.withColumn("fail_rate", 100 - F.col("pass_rate"))


def ai_usage_trend(rows: DataFrame, ts: str, ai_percent: Column, flag_above: float = 70) -> DataFrame:
    """Per day: mean AI percentage, flagged submissions and its complement."""
    daily = rows.groupBy(F.to_date(ts).alias("day")).agg(
        F.avg(ai_percent).alias("ai_probability"), F.count_if(ai_percent > flag_above).alias("flagged")
    )
    return daily.withColumn("human_probability", 100 - F.col("ai_probability"))


def shares(rows: DataFrame, kind: str) -> DataFrame:
    """Count and percentage by kind; the total is taken from the few grouped rows."""
    counts = rows.groupBy(kind).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*")).scalar()
    return counts.withColumn("percentage", F.col("n") * 100 / total)


def outliers_by_type(outliers: DataFrame, kind: str) -> DataFrame:
    return outliers.groupBy(kind).agg(F.count("*").alias("n"))


def outliers_by_severity(outliers: DataFrame, severity: str) -> DataFrame:
    """Count per severity, zero rows included."""
    counts = outliers.agg(*[F.count_if(F.col(severity) == s).alias(s) for s in SEVERITIES])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in SEVERITIES])))


def trend_direction(points: DataFrame, at: str, value: str, k: int = 3) -> DataFrame:
    """Change of the mean of the last k points against the first k, in percent, with a direction.

    Both ends are read as top-k, so the series is never sorted as a whole.
    """
    first = points.orderBy(F.asc(at)).limit(k).agg(F.avg(value).alias("older"))
    last = points.orderBy(F.desc(at)).limit(k).agg(F.avg(value).alias("recent"))
    n = points.agg(F.count("*").alias("points"))
    row = n.select(
        "points", first.select("older").scalar().alias("older"), last.select("recent").scalar().alias("recent")
    )
    change = F.when((F.col("points") >= 2) & (F.col("older") != 0), (F.col("recent") - F.col("older")) / F.col("older") * 100)
    return row.select(
        F.when(change > 5, "increasing").when(change < -5, "decreasing").otherwise("stable").alias("direction"),
        F.coalesce(F.abs(change), F.lit(0.0)).alias("percentage"),
    )


def kpis(stats: DataFrame) -> DataFrame:
    """Rounded rates from `admin_totals` rows."""
    n = F.col("submissions")
    rate = lambda c: F.round(c * 100 / n).cast("long")
    return stats.select(
        rate(F.col("attestations")).alias("verification_success_rate"),
        rate(n - F.col("flagged")).alias("integrity_rate"),
        rate(F.col("duplicates")).alias("duplicate_rate"),
        F.round("mean_authorship").cast("long").alias("mean_authorship"),
    )


def top_outliers(outliers: DataFrame, severity: str, order: list[Column], k: int = 5) -> DataFrame:
    """First k outliers of high severity in a stable order."""
    return outliers.filter(F.col(severity) == "high").orderBy(*order).limit(k)


def summary(submission_trend_rows: DataFrame, ai_rows: DataFrame, outliers: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row: mean daily pass rate, mean daily AI percentage, outliers, duplicate cases."""
    return submission_trend_rows.agg(F.round(F.avg("pass_rate")).cast("long").alias("mean_pass_rate")).select(
        "mean_pass_rate",
        ai_rows.agg(F.round(F.avg("ai_probability")).cast("long")).scalar().alias("mean_ai"),
        outliers.agg(F.count("*")).scalar().alias("outliers"),
        duplicates.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar().alias("duplicate_cases"),
    )


def recommendations(stats: DataFrame, high_outliers: Column, submissions: Column, pass_rate: Column, ai: Column) -> DataFrame:
    """Strengths, improvements and trend notes of a stats row; trends are direction columns."""
    n, mean = F.col("submissions"), F.col("mean_authorship")
    notes = lambda *rules: F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))
    return stats.select(
        notes(
            (mean >= 80, "High average authorship verification scores"),
            (F.col("flagged") / n < 0.1, "Low academic integrity violation rate"),
            (F.col("attestations") / n >= 0.9, "Excellent attestation success rate"),
            (high_outliers == 0, "No high-severity outliers detected"),
        ).alias("strengths"),
        notes(
            (mean < 70, "Consider additional writing profile training"),
            (F.col("flagged") / n > 0.15, "Implement additional academic integrity education"),
            (F.col("pending") > n * 0.1, "Review queue requires attention"),
            (high_outliers > 0, "Address high-priority outlier detections promptly"),
        ).alias("improvements"),
        notes(
            (submissions == "increasing", "Submission volume is trending upward"),
            (pass_rate == "decreasing", "Pass rates are declining"),
            (ai == "increasing", "AI usage appears to be increasing"),
            (high_outliers > 0, "High-severity outliers detected"),
        ).alias("trends"),
    )


def admin_totals(rows: DataFrame) -> DataFrame:
    """One row of totals over (owner, status, authorship_score, ai_probability, duplicates, attested)."""
    return rows.agg(
        F.countDistinct("owner").alias("owners"),
        F.count("*").alias("submissions"),
        F.count_if(F.col("status").isin("UPLOADED", "PROCESSING")).alias("pending"),
        F.count_if(F.col("status") == "FLAGGED").alias("flagged"),
        F.avg("authorship_score").alias("mean_authorship"),
        F.avg("ai_probability").alias("mean_ai"),
        F.count_if(F.col("duplicates") > 0).alias("duplicates"),
        F.count_if("attested").alias("attestations"),
    )
