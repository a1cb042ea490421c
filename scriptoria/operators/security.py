"""Audit and security analytics over request and login records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import ladders
from ..functions import text as tx


def since(ts: str, ref_ts: Column, **span: int) -> Column:
    """Rows of the span before ``ref_ts`` (days, hours, mins, secs)."""
    return F.col(ts) >= ref_ts - F.make_dt_interval(**{k: F.lit(v) for k, v in span.items()})


def high_risk_feed(audit: DataFrame, ts: str, risk: str, ref_ts: Column, hours: int = 1) -> DataFrame:
    return audit.filter(F.col(risk).isin("HIGH", "CRITICAL") & since(ts, ref_ts, hours=hours))


def suspicious_activity(
    events: DataFrame, key: str, ts: str, failed: Column, ref_ts: Column, minutes: int = 15, failures: int = 5, requests: int = 100
) -> DataFrame:
    """Risk per key in the window: 30 for many failed logins, 20 for many requests."""
    recent = events.filter(since(ts, ref_ts, mins=minutes))
    counts = recent.groupBy(key).agg(F.count_if(failed).alias("failed"), F.count("*").alias("requests"))
    score = F.when(F.col("failed") >= failures, 30).otherwise(0) + F.when(F.col("requests") > requests, 20).otherwise(0)
    return counts.withColumn("risk_score", score).withColumn("suspicious", F.col("risk_score") > 0)


def locked_accounts(locks: DataFrame, expiry: str, ref_ts: Column) -> DataFrame:
    """Locks still in force."""
    return locks.filter(F.col(expiry) >= ref_ts)


def ip_reputation(requests: DataFrame, indicators: DataFrame, ip: str, ceiling: int = 50) -> DataFrame:
    """Add ``ip_risk``: the confidence of an active indicator for the address, at most ``ceiling``; null without one.

    One row per address is taken from the indicators, the most confident, so requests are never multiplied.
    """
    active = indicators.filter((F.col("indicator_type") == "ip") & F.col("is_active"))
    best = active.groupBy(F.col("indicator_value").alias(ip)).agg(F.max("confidence").alias("__confidence"))
    return requests.join(best, ip, "left").withColumn(
        "ip_risk", F.when(F.col("__confidence").isNotNull(), F.least("__confidence", F.lit(ceiling)))
    ).drop("__confidence")


def user_agent_risk(agent: Column) -> Column:
    """30 for automation marks, else 20 for strings shorter than 10 characters; patterns come first."""
    pattern = "(?i)" + "|".join(fixed.AUTOMATION_MARKS)
    given = F.coalesce(agent, F.lit("")) != ""
    return F.when(given & agent.rlike(pattern), 30).when(given & (F.length(F.trim(agent)) < 10), 20).otherwise(0)


def login_risk(failures: Column) -> Column:
    return F.when(failures >= 3, F.least(20 + failures * 5, F.lit(40))).otherwise(0)


def private_range_risk(ip: Column, reputation: Column) -> Column:
    """15 for addresses containing a private prefix anywhere, only where no indicator matched."""
    private = F.lit(False)
    for part in ("10.", "192.168.", "172."):  # Fixed values: private prefixes.
        private = private | F.contains(ip, F.lit(part))
    return F.when(reputation.isNull() & private, 15).otherwise(0)


def rapid_request_risk(per_minute: Column, limit: int = 50) -> Column:
    return F.when(per_minute > limit, F.least(40 + per_minute - limit, F.lit(60))).otherwise(0)


def screen(
    requests: DataFrame, indicators: DataFrame, ip: str, agent: str, user: str, ts: str, failed: Column,
    window: str = "1 minute", limit: int = 50, failure_window: str = "15 minutes",
) -> DataFrame:
    """Every request with the risk of each rule, their sum and the action.

    Request and failure counts are grouped by window before they are joined back, so that a busy
    address adds one row per window to the join.
    """
    df = requests.withColumns({"__w": F.window(ts, window)["start"], "__fw": F.window(ts, failure_window)["start"]})
    rapid = df.groupBy(ip, "__w").agg(F.count("*").alias("per_window")).filter(F.col("per_window") > limit)
    failures = df.filter(failed).groupBy(user, "__fw").agg(F.count("*").alias("failures")).filter("failures >= 3")
    df = df.join(rapid, [ip, "__w"], "left").join(failures, [user, "__fw"], "left").drop("__w", "__fw")
    df = ip_reputation(df, indicators, ip)
    zero = lambda c: F.coalesce(c, F.lit(0))
    df = df.withColumns(
        {
            "private_risk": private_range_risk(F.col(ip), F.col("ip_risk")),
            "reputation_risk": zero("ip_risk"),
            "agent_risk": user_agent_risk(F.col(agent)),
            "login_risk": login_risk(zero("failures")),
            "rapid_risk": rapid_request_risk(zero("per_window"), limit),
        }
    ).drop("ip_risk", "failures", "per_window")
    total = sum((F.col(r) for r in RISKS[1:]), F.col(RISKS[0]))
    return df.withColumn("total_risk", total).withColumns(
        {
            "risk_score": F.least("total_risk", F.lit(100)),
            "action_required": F.col("total_risk") >= 70,
            "block": F.least("total_risk", F.lit(100)) >= 80,
        }
    )


RISKS = ["reputation_risk", "private_risk", "agent_risk", "login_risk", "rapid_risk"]


def incidents(screened: DataFrame, ip: str, threshold: int = 70) -> DataFrame:
    """One incident per request whose total risk reaches the threshold."""
    threats = F.filter(
        F.array(*[F.struct(F.lit(r.removesuffix("_risk")).alias("type"), F.col(r).cast("long").alias("risk_score")) for r in RISKS]),
        lambda t: t["risk_score"] > 0,
    )
    hit = screened.filter(F.col("total_risk") >= threshold)
    return hit.withColumns(
        {
            "severity": ladders.at_least(F.col("total_risk"), [(90, "CRITICAL"), (70, "HIGH"), (50, "MEDIUM")], "LOW"),
            "title": F.concat(F.lit("Intrusion attempt detected from "), tx.mask_ip(F.col(ip))),
            "threats": F.to_json(threats),
        }
    )


def upsert_indicators(store: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Store with the batch's rows added; per key the newest row stays."""
    both = store.unionByName(batch, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def new_indicators(rows: DataFrame, ref_ts: Column, expires_days: int | None) -> DataFrame:
    """Stamp indicators with creation and optional expiry."""
    expiry = ref_ts + F.make_dt_interval(F.lit(expires_days)) if expires_days else F.lit(None).cast("timestamp")
    return rows.withColumns({"created_at": ref_ts, "expires_at": expiry, "is_active": F.lit(True)})


def recent_incidents(rows: DataFrame, ts: str, key: str, ref_ts: Column, days: int = 7, k: int = 10) -> DataFrame:
    return rows.filter(since(ts, ref_ts, days=days)).orderBy(F.desc(ts), F.desc(key)).limit(k)


def dashboard(incident_rows: DataFrame, indicators: DataFrame, logins: DataFrame, ts: str, failed: Column, ref_ts: Column) -> DataFrame:
    """One row: incidents of 7 days, active indicators, failures of 24 hours."""
    return incident_rows.agg(F.count_if(since(ts, ref_ts, days=7)).alias("incidents_7d")).select(
        "incidents_7d",
        indicators.agg(F.count_if("is_active")).scalar().alias("active_indicators"),
        logins.agg(F.count_if(failed & since(ts, ref_ts, hours=24))).scalar().alias("failures_24h"),
    )


def active_keys(keys: DataFrame, key_type: str, created: str, expires: str, ref_ts: Column) -> DataFrame:
    """Newest active unexpired key per type."""
    usable = keys.filter(F.col("is_active") & (F.col(expires).isNull() | (F.col(expires) > ref_ts)))
    rest = [c for c in keys.columns if c != key_type]
    return usable.groupBy(key_type).agg(F.max_by(F.struct(*rest), F.struct(created, "key_id")).alias("r")).select(key_type, "r.*")


def expiring_keys(keys: DataFrame, expires: str, ref_ts: Column, days: int = 30) -> DataFrame:
    soon = (F.col(expires) > ref_ts) & (F.col(expires) <= ref_ts + F.make_dt_interval(F.lit(days)))
    return keys.filter(F.col("is_active") & soon).withColumn("days_left", F.date_diff(expires, ref_ts))


def key_statistics(keys: DataFrame, key_type: str, expires: str, ref_ts: Column) -> DataFrame:
    """Active keys by type beside the totals of all keys and of expiring ones."""
    return keys.groupBy(key_type).agg(F.count_if("is_active").alias("active")).select(
        key_type, "active", keys.agg(F.count("*")).scalar().alias("total"),
        expiring_keys(keys, expires, ref_ts).agg(F.count("*")).scalar().alias("expiring"),
    )
