"""Learning-platform feeds: grades, intake, routing, retries and sync reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grade(status: Column, authorship: Column, ai: Column) -> Column:
    """Score out of 100 from status and percentages, never below 0."""
    base = F.when(status == "FAIL", 0.0).when(status == "REVIEW", 50.0).otherwise(100.0)
    return F.greatest(
        F.lit(0.0), base - F.greatest(F.lit(0.0), (70 - authorship) * 0.5) - F.greatest(F.lit(0.0), ai * 0.3)
    )


def grade_comment(status: Column, authorship: Column, ai: Column, duplicates: Column) -> Column:
    one = lambda label, c: F.concat(F.lit(label), F.format_string("%.1f", F.round(c, 1)), F.lit("%"))
    return F.concat_ws(
        "; ", one("Authorship Score: ", authorship), one("AI Detection: ", ai), F.concat(F.lit("Status: "), status),
        F.when(duplicates > 0, F.concat(F.lit("Duplicate matches found: "), duplicates.cast("string"))),
    )


def intake(feed: DataFrame, users: DataFrame, existing: DataFrame, user: str, assignment: str, order: list[str]) -> DataFrame:
    """New submissions: known users, unseen (assignment, user), first arrival of each."""
    known = feed.join(users.select(user).distinct(), user, "left_semi")
    fresh = known.join(existing.select(assignment, user).distinct(), [assignment, user], "left_anti")
    rest = [c for c in feed.columns if c not in (user, assignment)]
    return fresh.groupBy(assignment, user).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(assignment, user, "r.*")


def route(events: DataFrame, handlers: dict[str, str], event_type: str) -> DataFrame:
    """Add ``handler``; types without one go to ``unhandled``."""
    table = F.create_map(*[F.lit(x) for kv in handlers.items() for x in kv])
    return events.withColumn("handler", F.coalesce(F.try_element_at(table, F.col(event_type)), F.lit("unhandled")))


def retry_plan(attempts: DataFrame, event: str, attempt: str, max_retries: int = 3) -> DataFrame:
    """Per event: highest failed attempt, retry delay of 2^n seconds, or the dead-letter queue."""
    last = attempts.groupBy(event).agg(F.max(attempt).alias("attempts"))
    again = F.col("attempts") <= max_retries
    return last.withColumns(
        {
            "action": F.when(again, "retry").otherwise("dead_letter"),
            "delay_seconds": F.when(again, F.pow(F.lit(2), F.col("attempts"))),
        }
    )


def integration_status(institutions: DataFrame, courses: DataFrame, submissions: DataFrame, key: str, course: str, synced: str) -> DataFrame:
    """Courses, submissions and last sync per institution; each side is counted before it is joined."""
    c = courses.groupBy(key).agg(F.countDistinct(course).alias("courses"))
    s = submissions.join(courses.select(key, course).distinct(), course).groupBy(key).agg(
        F.count("*").alias("submissions"), F.max(synced).alias("last_sync")
    )
    out = institutions.select(key).join(c, key, "left").join(s, key, "left")
    return out.withColumns({"courses": F.coalesce("courses", F.lit(0)), "submissions": F.coalesce("submissions", F.lit(0))})


def newest_per_key(stored: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Stored rows with the batch's newest payload per key in their place."""
    rest = [c for c in batch.columns if c != key]
    best = batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")
    return stored.join(best.select(key), key, "left_anti").unionByName(best)


def sync_rollup(logs: DataFrame, kind: str) -> DataFrame:
    return logs.groupBy(kind).agg(
        F.count("*").alias("runs"), F.sum("processed").alias("processed"), F.sum("failed").alias("failed"),
        F.avg("seconds").alias("mean_seconds"),
    )


def delivery_outcomes(deliveries: DataFrame, subscription: str, ts: str, failed: Column) -> DataFrame:
    return deliveries.groupBy(subscription).agg(
        F.count("*").alias("deliveries"), F.count_if(failed).alias("failures"), F.max(ts).alias("last_delivery")
    )
