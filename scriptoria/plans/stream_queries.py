"""Group Q on the driver's tables: the streams, and the same rules on tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import event_log
from ..sources.tables import table
from ..streaming import monitors as mo
from ..streaming import sources as so
from ..streaming.verification import verify_stream
from . import ailike_queries as aq
from .event_queries import REQUESTS, at, at_sql
from . import authorship_queries  # noqa: F401  the SQL of the whole job
from .registry import ORACLES, query
from .text_queries import event_ip


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream(spark, d):
    return so.stream_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("Q1_verification_stream", f"SELECT doc_id, source, result, risks, authorship_score FROM ({ORACLES['G11_verify_submissions']})")
def verification_stream(spark, d):
    arrivals = so.stream_table(spark, d, "documents").select("doc_id", "source", "text")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    out = verify_stream(arrivals, vectors, lexicons=aq.LEXICONS)
    return out.select("doc_id", "source", "result", "risks", F.round("authorship_score", 6).alias("authorship_score"))


PER_MINUTE = f"WITH {REQUESTS} SELECT ip, {at_sql('date_trunc(' + chr(39) + 'minute' + chr(39) + ', ts)')} AS minute, count(*) AS n FROM reqs GROUP BY 1, 2"


@query("Q2_requests_per_minute", PER_MINUTE)
def requests_per_minute(spark, d):
    rows = events(spark, d).withColumn("ip", event_ip())
    return mo.requests_per_minute(rows, "ip", "ts").withColumn("minute", at("minute"))


@query("Q2_requests_per_minute_stream", PER_MINUTE)
def requests_per_minute_stream(spark, d):
    counts = mo.requests_per_minute(stream(spark, d).withColumn("ip", event_ip()), "ip", "ts")
    out = so.newest_state(so.drain(counts, "per_minute", "update"), ["ip", "minute"])
    return out.withColumn("minute", at("minute"))


SESSIONS = """o AS (SELECT user_id, event_id, event_type, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM o)"""


@query("Q3_rate_limit_sessions", f"WITH {SESSIONS} SELECT user_id, {at_sql('min(ts)')} AS start, count(*) AS n, count(*) >= 4 AS limited FROM s GROUP BY user_id, sid")
def rate_limit_sessions(spark, d):
    out = mo.rate_limit_sessions_table(events(spark, d), "user_id", "ts", "event_id", 6 * 3600, 4)
    return out.select("user_id", at("start").alias("start"), "n", "limited")


@query("Q3_rate_limit_sessions_stream", f"WITH {SESSIONS} SELECT user_id, {at_sql('min(ts)')} AS start, count(*) AS n, count(*) >= 4 AS limited FROM s GROUP BY user_id, sid")
def rate_limit_sessions_stream(spark, d):
    sessions = mo.rate_limit_sessions(stream(spark, d), "user_id", "ts", "6 hours", 4)
    rows = so.drain(sessions, "sessions", "complete")
    last = rows.agg(F.max("batch_id")).scalar()
    return rows.filter(F.col("batch_id") == last).select("user_id", at("start").alias("start"), "n", "limited")


# Sessions that the watermark, two minutes behind the latest row, has closed.
CLOSED = "HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 MINUTE"


@query("Q3_closed_sessions_stream", f"WITH {SESSIONS} SELECT user_id, {at_sql('min(ts)')} AS start, count(*) AS n, count(*) >= 4 AS limited FROM s GROUP BY user_id, sid {CLOSED}")
def closed_sessions_stream(spark, d):
    """Every session once, when it is closed; the state holds open sessions alone."""
    sessions = mo.rate_limit_sessions(stream(spark, d), "user_id", "ts", "6 hours", 4)
    return so.drain(sessions, "closed_sessions", "append").select("user_id", at("start").alias("start"), "n", "limited")


@query("Q4_distinct_paths_stream", f"WITH {SESSIONS} SELECT user_id, {at_sql('min(ts)')} AS start, count(DISTINCT event_type) AS paths FROM s GROUP BY user_id, sid {CLOSED}")
def distinct_paths_stream(spark, d):
    """Closed sessions with their number of paths from a sketch in the state; it is exact for as few as there are here."""
    sessions = mo.distinct_paths(stream(spark, d), "user_id", "event_type", "ts", "6 hours")
    return so.drain(sessions, "paths", "append").select("user_id", at("start").alias("start"), "paths")


@query("Q4_distinct_paths", f"WITH {SESSIONS} SELECT user_id, {at_sql('min(ts)')} AS start, count(DISTINCT event_type) AS paths FROM s GROUP BY user_id, sid")
def distinct_paths(spark, d):
    out = mo.distinct_paths_table(events(spark, d), "user_id", "event_type", "ts", "event_id", 6 * 3600)
    return out.withColumn("start", at("start"))


LOCKS = """l AS (SELECT user_id, event_id, ts, event_type = 'signup' AS ok FROM events WHERE event_type IN ('error', 'signup')),
o AS (SELECT *, CASE WHEN ok OR coalesce(lag(ok) OVER w, true) OR ts > lag(ts) OVER w + INTERVAL 3 DAY THEN 1 ELSE 0 END AS opens FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM o),
locks AS (SELECT user_id, min(ts) AS first_failure, count(*) AS failures, max(ts) + INTERVAL 3 DAY AS locked_until FROM s GROUP BY user_id, sid HAVING NOT bool_or(ok) AND count(*) >= 3)"""


def logins(rows):
    return rows.filter(F.col("event_type").isin("error", "signup")).withColumn("success", F.col("event_type") == "signup")


@query("Q5_login_lockout", f"WITH {LOCKS} SELECT user_id, {at_sql('first_failure')} AS first_failure, failures, {at_sql('locked_until')} AS locked_until FROM locks")
def login_lockout(spark, d):
    out = mo.lockouts_table(logins(events(spark, d)), "user_id", "ts", "event_id", "success", 3, 3 * 1440)
    return out.select("user_id", at("first_failure").alias("first_failure"), "failures", at("locked_until").alias("locked_until"))


@query("Q5_login_lockout_stream", f"WITH {LOCKS} SELECT user_id, max(failures) AS failures, {at_sql('max(locked_until)')} AS locked_until FROM locks GROUP BY user_id")
def login_lockout_stream(spark, d):
    """Longest run and last lock of each user, from every lock the stream reports."""
    locks = mo.lockouts(logins(stream(spark, d)), "user_id", "ts", "success", 3, 3 * 1440)
    rows = so.drain(locks, "lockouts", "append")
    return rows.groupBy(F.col("user").alias("user_id")).agg(F.max("failures").alias("failures"), at(F.max("locked_until")).alias("locked_until"))


@query("Q6_slow_requests", f"SELECT event_id, user_id, {at_sql('ts')} AS at FROM events WHERE value / 100 > 1.5 ORDER BY ts DESC, event_id DESC LIMIT 100")
def slow_requests(spark, d):
    slow = mo.slow_requests(events(spark, d).withColumn("seconds", F.col("value") / 100), "seconds", 1.5)
    return mo.newest_requests(slow, "ts", "event_id").select("event_id", "user_id", at("ts").alias("at"))


@query("Q6_slow_requests_stream", "SELECT event_id, user_id FROM events WHERE value / 100 > 1.5")
def slow_requests_stream(spark, d):
    slow = mo.slow_requests(stream(spark, d).withColumn("seconds", F.col("value") / 100), "seconds", 1.5)
    return so.drain(slow.select("event_id", "user_id"), "slow", "append").drop("batch_id")


# Status of a transaction by event type.
STATUS = {"view": "PENDING", "click": "PENDING", "signup": "SUBMITTED", "purchase": "CONFIRMED", "error": "FAILED"}
STATUS_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END"
CHANGES = f"""u AS (SELECT user_id, event_id, ts, {STATUS_CASE} AS status FROM events),
e AS (SELECT user_id, min(ts) AS first, min(struct_pack(a := ts, b := event_id)) FILTER (status IN ('CONFIRMED', 'FAILED')) AS fin FROM u GROUP BY user_id),
c AS (SELECT u.user_id, ts, status, lag(status) OVER (PARTITION BY u.user_id ORDER BY ts, event_id) AS prev, first, fin, event_id FROM u JOIN e USING (user_id)),
changes AS (SELECT user_id, ts, status FROM c WHERE (prev IS NULL OR prev <> status) AND ts <= first + INTERVAL 10 DAY AND (fin IS NULL OR struct_pack(a := ts, b := event_id) <= fin))"""


def updates(rows):
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return rows.withColumn("status", status[F.col("event_type")])


@query("Q7_status_changes", f"WITH {CHANGES} SELECT user_id, {at_sql('ts')} AS at, status FROM changes")
def status_changes(spark, d):
    out = mo.status_changes_table(updates(events(spark, d)), "user_id", "ts", "event_id", "status", 10 * 86400)
    return out.withColumn("at", at("at"))


@query("Q7_status_changes_stream", f"WITH {CHANGES} SELECT user_id, {at_sql('ts')} AS at, status FROM changes")
def status_changes_stream(spark, d):
    rows = so.drain(mo.status_changes(updates(stream(spark, d)), "user_id", "ts", "status", 10 * 86400), "changes", "append")
    return rows.select(F.col("key").alias("user_id"), at("at").alias("at"), "status")


def attestations(rows):
    """Signups as pending records, purchases and errors of the same user as their outcome."""
    done = updates(rows).select("user_id", F.col("ts").alias("updated_at"), "status")
    return rows.filter("event_type = 'signup'").select("user_id", "ts"), done


@query("Q8_attestation_monitor", f"""
WITH u AS (SELECT user_id, ts, {STATUS_CASE} AS status FROM events)
SELECT p.user_id, {at_sql('p.ts')} AS at, {at_sql('u.ts')} AS updated_at, u.status
FROM events p LEFT JOIN u ON u.user_id = p.user_id AND u.status IN ('CONFIRMED', 'FAILED') AND u.ts >= p.ts AND u.ts <= p.ts + INTERVAL 600 MINUTE
WHERE p.event_type = 'signup'""")
def attestation_monitor(spark, d):
    rows = mo.attestation_table(*attestations(events(spark, d)), "user_id", "ts", 600)
    return rows.select("user_id", at("ts").alias("at"), at("updated_at").alias("updated_at"), "status")


@query("Q8_attestation_monitor_stream")
def attestation_monitor_stream(spark, d):
    """The stream; records behind its last watermark that nothing has matched are still pending and stay in its state."""
    pending, _ = attestations(stream(spark, d))
    _, done = attestations(stream(spark, d))
    rows = so.drain(mo.attestation_monitor(pending, done, "user_id", "ts", 600), "attestations", "append")
    return rows.select("user_id", at("ts").alias("at"), at("updated_at").alias("updated_at"), "status")


@query("Q9_contract_tail", """
SELECT CASE event_type WHEN 'signup' THEN 'SubmissionMinted' WHEN 'click' THEN 'SubmissionUpdated' WHEN 'purchase' THEN 'SubmissionVerified' ELSE 'Paused' END AS "eventType", count(*) AS n
FROM events WHERE event_type <> 'view' GROUP BY 1""")
def contract_tail(spark, d):
    """Events written as a JSON log, tailed as a stream; views become an event that is not followed."""
    names = {"signup": "SubmissionMinted", "click": "SubmissionUpdated", "purchase": "SubmissionVerified", "error": "Paused", "view": "Transfer"}
    name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    log = events(spark, d).select(
        name[F.col("event_type")].alias("eventType"), F.col("ts").alias("timestamp"), F.col("event_id").alias("blockNumber"),
        F.md5(F.col("event_id").cast("string")).alias("transactionHash"), F.col("user_id").alias("tokenId"))
    path = f"{ensure_checkpoint_dir(spark)}/event-log-{uuid.uuid4().hex}"
    event_log.append_events(log, path)
    event_log.append_events(log.filter("blockNumber % 10 = 0"), path)
    tail = mo.contract_tail(event_log.stream_events(spark, path), late="60 days")
    return so.drain(tail, "contract", "append").groupBy("eventType").agg(F.count("*").alias("n"))
