"""Submission records on the driver's relational tables, written alike in Spark and SQL.

An order is a submission, its returned items (flag A) are its verification, its first item
(line number 1) is its ledger record. Outliers are error events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table

# Submission status by order priority.
STATUS = {"1-URGENT": "FLAGGED", "2-HIGH": "VERIFIED", "3-MEDIUM": "REJECTED", "4-NOT SPECIFIED": "PROCESSING", "5-LOW": "UPLOADED"}


def submissions(spark, d):
    o = table(spark, d, "orders")
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return o.select(
        F.col("o_orderkey").alias("submission_id"), F.col("o_custkey").alias("owner"), status[F.col("o_orderpriority")].alias("status"),
        F.col("o_orderdate").alias("submitted_at"), F.col("o_totalprice").alias("amount"))


def verification(spark, d):
    li = table(spark, d, "lineitem").filter("l_returnflag = 'A'")
    return li.groupBy(F.col("l_orderkey").alias("submission_id")).agg(
        F.round(F.avg("l_quantity") * 2, 4).alias("authorship_score"), F.round(F.avg(F.col("l_discount") * 1000), 2).alias("ai_probability"),
        (F.count("*") - 1).alias("duplicates"))


def ledger(spark, d):
    li = table(spark, d, "lineitem").filter("l_linenumber = 1")
    return li.groupBy(F.col("l_orderkey").alias("submission_id")).agg(
        F.when(F.min("l_linestatus") == "F", "CONFIRMED").otherwise("PENDING").alias("ledger_status"),
        F.min("l_partkey").alias("token_id"), F.max("l_shipdate").alias("recorded_at"))


def joined(spark, d):
    """Submissions with verification and ledger columns, defaults filled in."""
    from ..operators.submissions import enriched
    rows = enriched(submissions(spark, d), verification(spark, d), ledger(spark, d), "submission_id")
    return rows.withColumns({"duplicates": F.coalesce("duplicates", F.lit(0)), "attested": F.col("ledger_status") == "CONFIRMED"})


def outliers(spark, d):
    """Error events as outliers; severity by value."""
    severity = F.when(F.col("value") > 90, "high").when(F.col("value") > 40, "medium").otherwise("low")
    return table(spark, d, "events").filter("event_type = 'error'").select(
        "event_id", "user_id", "ts", "value", severity.alias("severity"), (F.col("user_id") % 4).alias("kind"))


SUBMISSIONS = "subs AS (SELECT o_orderkey AS submission_id, o_custkey AS owner, CASE o_orderpriority " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()
) + " END AS status, o_orderdate AS submitted_at, o_totalprice AS amount FROM orders)"
VERIFICATION = """verif AS (SELECT l_orderkey AS submission_id, round(avg(l_quantity) * 2, 4) AS authorship_score, round(avg(l_discount * 1000), 2) AS ai_probability,
  count(*) - 1 AS duplicates FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)"""
LEDGER = """ledg AS (SELECT l_orderkey AS submission_id, CASE WHEN min(l_linestatus) = 'F' THEN 'CONFIRMED' ELSE 'PENDING' END AS ledger_status,
  min(l_partkey) AS token_id, max(l_shipdate) AS recorded_at FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)"""
RECORDS = f"""{SUBMISSIONS}, {VERIFICATION}, {LEDGER},
recs AS (SELECT s.*, coalesce(authorship_score, 0.65) AS authorship_score, coalesce(ai_probability, 0.0) AS ai_probability, coalesce(duplicates, 0) AS duplicates,
  coalesce(ledger_status, 'PENDING') AS ledger_status, token_id, recorded_at, coalesce(ledger_status, 'PENDING') = 'CONFIRMED' AS attested
  FROM subs s LEFT JOIN verif USING (submission_id) LEFT JOIN ledg USING (submission_id))"""
OUTLIERS = """outl AS (SELECT event_id, user_id, ts, value, CASE WHEN value > 90 THEN 'high' WHEN value > 40 THEN 'medium' ELSE 'low' END AS severity, user_id % 4 AS kind
  FROM events WHERE event_type = 'error')"""
