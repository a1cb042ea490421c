"""Groups L to P on the driver's tables: security, compliance, ledger, metrics and feeds.

An event is a request or login (error = failed, signup = success), its value a latency or score.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text as tx
from ..operators import compliance as co
from ..operators import feeds as fd
from ..operators import ledger as lg
from ..operators import metrics as mt
from ..operators import security as se
from ..session import ensure_checkpoint_dir, stage
from ..sources import exports, keyed_table
from ..sources.tables import table
from . import records as rec
from . import sqltext as q
from .registry import ORACLES, query
from .text_queries import EVENT_AGENT_SQL, EVENT_IP_SQL, event_agent, event_ip


def at(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def at_sql(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def events(spark, d):
    return table(spark, d, "events")


def latest(df, ts="ts"):
    return df.agg(F.max(ts)).scalar()


RISK_SQL = "CASE WHEN value > 150 THEN 'CRITICAL' WHEN value > 100 THEN 'HIGH' WHEN value > 50 THEN 'MEDIUM' ELSE 'LOW' END"
REF = "ref AS (SELECT max(ts) AS r FROM events)"


def failed():
    return F.col("event_type") == "error"


# -- L ------------------------------------------------------------------------------------

@query("L1_high_risk_feed", f"WITH {REF} SELECT event_id, user_id, {RISK_SQL} AS risk FROM events CROSS JOIN ref WHERE value > 100 AND ts >= r - INTERVAL 24 HOUR")
def high_risk_feed(spark, d):
    e = events(spark, d)
    v = F.col("value")
    audit = e.withColumn("risk", F.when(v > 150, "CRITICAL").when(v > 100, "HIGH").when(v > 50, "MEDIUM").otherwise("LOW"))
    return se.high_risk_feed(audit, "ts", "risk", latest(e), 24).select("event_id", "user_id", "risk")


@query("L2_suspicious_activity", f"""
WITH {REF}, c AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS failed, count(*) AS requests FROM events CROSS JOIN ref WHERE ts >= r - INTERVAL 10 DAY GROUP BY 1)
SELECT *, (CASE WHEN failed >= 5 THEN 30 ELSE 0 END + CASE WHEN requests > 25 THEN 20 ELSE 0 END)::BIGINT AS risk_score, failed >= 5 OR requests > 25 AS suspicious FROM c""")
def suspicious_activity(spark, d):
    e = events(spark, d)
    out = se.suspicious_activity(e, "user_id", "ts", failed(), latest(e), 14400, 5, 25)
    return out.withColumn("risk_score", F.col("risk_score").cast("long"))


@query("L3_locked_accounts", f"WITH {REF}, l AS (SELECT user_id, max(ts) + INTERVAL 6 HOUR AS expires FROM events WHERE event_type = 'error' GROUP BY 1) SELECT user_id, {at_sql('expires')} AS expires FROM l CROSS JOIN ref WHERE expires >= r")
def locked_accounts(spark, d):
    e = events(spark, d)
    locks = e.filter(failed()).groupBy("user_id").agg((F.max("ts") + F.expr("INTERVAL 6 HOURS")).alias("expires"))
    return se.locked_accounts(locks, "expires", latest(e)).select("user_id", at("expires").alias("expires"))


def requests(spark, d):
    return events(spark, d).withColumns({"ip": event_ip(), "agent": event_agent()})


def indicators(spark, d):
    """Addresses with very slow failures, as threat indicators."""
    r = requests(spark, d).filter(failed() & (F.col("value") > 100))
    return r.groupBy(F.col("ip").alias("indicator_value")).agg(
        F.least(F.max("value"), F.lit(100.0)).cast("int").alias("confidence"), F.max("ts").alias("created_at"),
        (F.count("*") % 2 == 1).alias("is_active")).withColumn("indicator_type", F.lit("ip"))


REQUESTS = f"reqs AS (SELECT *, {EVENT_IP_SQL} AS ip, {EVENT_AGENT_SQL} AS agent FROM events)"
INDICATORS = """ind AS (SELECT ip AS indicator_value, trunc(least(max(value), 100.0))::INT AS confidence, max(ts) AS created_at, count(*) % 2 = 1 AS is_active FROM reqs
  WHERE event_type = 'error' AND value > 100 GROUP BY 1)"""


@query("L4_ip_reputation", f"WITH {REQUESTS}, {INDICATORS} SELECT event_id, CASE WHEN confidence IS NOT NULL THEN least(confidence, 50) END::BIGINT AS ip_risk FROM reqs LEFT JOIN ind ON indicator_value = ip AND is_active")
def ip_reputation(spark, d):
    out = se.ip_reputation(requests(spark, d), indicators(spark, d), "ip")
    return out.select("event_id", F.col("ip_risk").cast("long").alias("ip_risk"))


AGENT_RISK = "CASE WHEN agent <> '' AND regexp_matches(agent, '(?i)" + "|".join(fixed.AUTOMATION_MARKS) + "') THEN 30 WHEN agent <> '' AND length(trim(agent)) < 10 THEN 20 ELSE 0 END"


@query("L5_user_agent_risk", f"WITH {REQUESTS} SELECT ({AGENT_RISK})::BIGINT AS risk, count(*) AS n FROM reqs GROUP BY 1")
def user_agent_risk(spark, d):
    risk = se.user_agent_risk(F.col("agent")).cast("long").alias("risk")
    return requests(spark, d).groupBy(risk).agg(F.count("*").alias("n"))


@query("L6_login_risk", "WITH f AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) SELECT user_id, CASE WHEN n >= 3 THEN least(20 + n * 5, 40) ELSE 0 END::BIGINT AS risk FROM f")
def login_risk(spark, d):
    f = events(spark, d).filter(failed()).groupBy("user_id").agg(F.count("*").alias("n"))
    return f.select("user_id", se.login_risk(F.col("n")).cast("long").alias("risk"))


PRIVATE = "CASE WHEN confidence IS NULL AND (contains(ip, '10.') OR contains(ip, '192.168.') OR contains(ip, '172.')) THEN 15 ELSE 0 END"


@query("L7_private_range", f"WITH {REQUESTS}, {INDICATORS} SELECT event_id, ({PRIVATE})::BIGINT AS risk FROM reqs LEFT JOIN ind ON indicator_value = ip AND is_active")
def private_range(spark, d):
    out = se.ip_reputation(requests(spark, d), indicators(spark, d), "ip")
    return out.select("event_id", se.private_range_risk(F.col("ip"), F.col("ip_risk")).cast("long").alias("risk"))


@query("L8_rapid_requests", f"""
WITH {REQUESTS}, c AS (SELECT ip, time_bucket(INTERVAL 1 DAY, ts) AS w, count(*) AS n FROM reqs GROUP BY 1, 2) SELECT ip, {at_sql('w')} AS day, CASE WHEN n > 2 THEN least(40 + n - 2, 60) ELSE 0 END::BIGINT AS risk FROM c""")
def rapid_requests(spark, d):
    c = requests(spark, d).groupBy("ip", F.window("ts", "1 day")["start"].alias("w")).agg(F.count("*").alias("n"))
    return c.select("ip", at("w").alias("day"), se.rapid_request_risk(F.col("n"), 2).cast("long").alias("risk"))


SCREEN = f"""{REQUESTS}, {INDICATORS},
rapid AS (SELECT ip, CAST(ts AS DATE) AS w, count(*) AS per_window FROM reqs GROUP BY 1, 2 HAVING count(*) > 2),
fails AS (SELECT user_id, CAST(ts AS DATE) AS w, count(*) AS failures FROM reqs WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 3),
risks AS (SELECT event_id, reqs.ip, CASE WHEN confidence IS NOT NULL THEN least(confidence, 50) ELSE 0 END AS reputation_risk, {PRIVATE.replace('ip,', 'reqs.ip,')} AS private_risk, {AGENT_RISK} AS agent_risk,
  CASE WHEN failures >= 3 THEN least(20 + failures * 5, 40) ELSE 0 END AS login_risk, CASE WHEN per_window > 2 THEN least(40 + per_window - 2, 60) ELSE 0 END AS rapid_risk
  FROM reqs LEFT JOIN ind ON indicator_value = reqs.ip AND is_active LEFT JOIN rapid ON rapid.ip = reqs.ip AND rapid.w = CAST(ts AS DATE)
  LEFT JOIN fails ON fails.user_id = reqs.user_id AND fails.w = CAST(ts AS DATE)),
screened AS (SELECT *, reputation_risk + private_risk + agent_risk + login_risk + rapid_risk AS total_risk FROM risks)"""


def screened(spark, d):
    return se.screen(requests(spark, d), indicators(spark, d), "ip", "agent", "user_id", "ts", failed(), "1 day", 2, "1 day")


@query("L9_intrusion_score", f"WITH {SCREEN} SELECT event_id, total_risk::BIGINT AS total_risk, least(total_risk, 100)::BIGINT AS risk_score, total_risk >= 70 AS action_required, least(total_risk, 100) >= 80 AS block FROM screened")
def intrusion_score(spark, d):
    return screened(spark, d).select("event_id", F.col("total_risk").cast("long").alias("total_risk"), F.col("risk_score").cast("long").alias("risk_score"), "action_required", "block")


MASKED_IP = "CASE WHEN contains(ip, ':') THEN array_to_string(list_slice(string_split(ip, ':'), 1, 4), ':') || '::0' WHEN contains(ip, '.') THEN array_to_string(list_slice(string_split(ip, '.'), 1, 3), '.') || '.0' ELSE '0.0.0.0' END"


@query("L10_incidents", f"""WITH {SCREEN}
SELECT event_id, CASE WHEN total_risk >= 90 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, 'Intrusion attempt detected from ' || {MASKED_IP} AS title,
  '[' || concat_ws(',', {', '.join(f"CASE WHEN {r} > 0 THEN '{{\"type\":\"{r.removesuffix('_risk')}\",\"risk_score\":' || {r} || '}}' END" for r in se.RISKS)}) || ']' AS threats
FROM screened WHERE total_risk >= 70""")
def incidents(spark, d):
    return se.incidents(screened(spark, d), "ip").select("event_id", "severity", "title", "threats")


@query("L11_indicator_upsert", f"""WITH {REF}, {REQUESTS}, {INDICATORS},
batch AS (SELECT DISTINCT ip AS indicator_value FROM reqs WHERE event_type = 'purchase' AND value > 200)
SELECT indicator_value, CASE WHEN b.indicator_value IS NOT NULL THEN 90 ELSE confidence END::BIGINT AS confidence,
  CASE WHEN b.indicator_value IS NOT NULL THEN {at_sql('r + INTERVAL 30 DAY')} END AS expires_at
FROM ind FULL JOIN batch b USING (indicator_value) CROSS JOIN ref""")
def indicator_upsert(spark, d):
    e = events(spark, d)
    batch = requests(spark, d).filter("event_type = 'purchase' and value > 200").select(F.col("ip").alias("indicator_value")).distinct()
    # Stamped a second later than the newest stored row, as an import that runs after the log ends.
    stamped = se.new_indicators(batch.withColumns({"indicator_type": F.lit("ip"), "confidence": F.lit(90)}), latest(e), 30)
    stamped = stamped.withColumn("seen", F.col("created_at") + F.expr("INTERVAL 1 SECOND"))
    stored = indicators(spark, d).withColumn("seen", F.col("created_at"))
    out = se.upsert_indicators(stored, stamped, ["indicator_type", "indicator_value"], "seen")
    return out.select("indicator_value", F.col("confidence").cast("long").alias("confidence"), at("expires_at").alias("expires_at"))


@query("L11_stored_indicators", ORACLES["L11_indicator_upsert"])
def stored_indicators(spark, d):
    """The same upsert on a stored table of indicators."""
    e, keys = events(spark, d), ["indicator_type", "indicator_value"]
    batch = requests(spark, d).filter("event_type = 'purchase' and value > 200").select(F.col("ip").alias("indicator_value")).distinct()
    stamped = se.new_indicators(batch.withColumns({"indicator_type": F.lit("ip"), "confidence": F.lit(90)}), latest(e), 30)
    stamped = stamped.withColumn("seen", F.col("created_at") + F.expr("INTERVAL 1 SECOND"))
    path = f"{ensure_checkpoint_dir(spark)}/indicators-{uuid.uuid4().hex}"
    keyed_table.create(indicators(spark, d).withColumns({"seen": F.col("created_at"), "expires_at": F.lit(None).cast("timestamp")}), path, keys)
    keyed_table.update(spark, path, stamped, keys, lambda old, new: se.upsert_indicators(old, new, keys, "seen"))
    return keyed_table.read(spark, path).select("indicator_value", F.col("confidence").cast("long").alias("confidence"), at("expires_at").alias("expires_at"))


@query("L12_recent_incidents", f"WITH {REF}, {SCREEN} SELECT event_id, {at_sql('ts')} AS at FROM screened JOIN events USING (event_id) CROSS JOIN ref WHERE total_risk >= 70 AND ts >= r - INTERVAL 7 DAY ORDER BY ts DESC, event_id DESC LIMIT 10")
def recent_incidents(spark, d):
    rows = se.recent_incidents(se.incidents(screened(spark, d), "ip"), "ts", "event_id", latest(events(spark, d)))
    return rows.select("event_id", at("ts").alias("at"))


@query("L12_security_dashboard", f"""WITH {REF}, {SCREEN} SELECT (SELECT count(*) FROM screened JOIN events USING (event_id) WHERE total_risk >= 70 AND ts >= r - INTERVAL 7 DAY) AS incidents_7d,
  (SELECT count(*) FROM ind WHERE is_active) AS active_indicators, (SELECT count(*) FROM events WHERE event_type = 'error' AND ts >= r - INTERVAL 24 HOUR) AS failures_24h FROM ref""")
def security_dashboard(spark, d):
    e = events(spark, d)
    return se.dashboard(se.incidents(screened(spark, d), "ip"), indicators(spark, d), e, "ts", failed(), latest(e))


KEYS = """okeys AS (SELECT o_orderkey AS key_id, o_orderpriority AS key_type, o_orderdate AS created_at, o_orderdate + INTERVAL 365 DAY AS expires_at, o_orderstatus <> 'F' AS is_active FROM orders),
kref AS (SELECT max(o_orderdate) - INTERVAL 200 DAY AS r FROM orders)"""


def keys(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("key_id"), F.col("o_orderpriority").alias("key_type"), F.col("o_orderdate").alias("created_at"),
                    (F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")).alias("expires_at"), (F.col("o_orderstatus") != "F").alias("is_active"))
    return rows, o.agg(F.max(F.col("o_orderdate") - F.expr("INTERVAL 200 DAYS"))).scalar()


@query("L13_active_keys", f"WITH {KEYS}, r AS (SELECT *, row_number() OVER (PARTITION BY key_type ORDER BY created_at DESC, key_id DESC) AS k FROM okeys CROSS JOIN kref WHERE is_active AND expires_at > r) SELECT key_type, key_id FROM r WHERE k = 1")
def active_keys(spark, d):
    rows, ref = keys(spark, d)
    return se.active_keys(rows, "key_type", "created_at", "expires_at", ref).select("key_type", "key_id")


@query("L14_expiring_keys", f"WITH {KEYS} SELECT key_id, date_diff('day', CAST(r AS DATE), CAST(expires_at AS DATE)) AS days_left FROM okeys CROSS JOIN kref WHERE is_active AND expires_at > r AND expires_at <= r + INTERVAL 30 DAY")
def expiring_keys(spark, d):
    rows, ref = keys(spark, d)
    return se.expiring_keys(rows, "expires_at", ref).select("key_id", F.col("days_left").cast("long").alias("days_left"))


@query("L15_key_statistics", f"WITH {KEYS} SELECT key_type, count(*) FILTER (is_active) AS active, (SELECT count(*) FROM okeys) AS total, (SELECT count(*) FROM okeys CROSS JOIN kref WHERE is_active AND expires_at > r AND expires_at <= r + INTERVAL 30 DAY) AS expiring FROM okeys GROUP BY key_type")
def key_statistics(spark, d):
    rows, ref = keys(spark, d)
    return se.key_statistics(rows, "key_type", "expires_at", ref)


# -- M ------------------------------------------------------------------------------------

KINDS = {"view": "session_data", "error": "audit_logs", "click": "session_data", "purchase": "academic_records", "signup": "personal_data"}
RETENTION = f"""kinds AS (SELECT *, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} END AS data_type FROM events),
pol AS (SELECT * FROM {q.values(fixed.RETENTION_POLICIES, 'data_type, days, act')}), mref AS (SELECT max(ts) + INTERVAL 745 DAY AS r FROM events),
due AS (SELECT kinds.*, CASE WHEN ts < r - to_days(days) THEN act END AS action FROM kinds LEFT JOIN pol USING (data_type) CROSS JOIN mref)"""


def due(spark, d):
    e = events(spark, d)
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    ref = e.agg(F.max(F.col("ts") + F.expr("INTERVAL 745 DAYS"))).scalar()
    return co.due_for_retention(e.withColumn("data_type", kind[F.col("event_type")]), co.default_policies(spark), "ts", ref)


@query("M1_retention_counts", f"WITH {RETENTION} SELECT data_type, action, count(*) AS n FROM due WHERE action IS NOT NULL GROUP BY 1, 2")
def retention_counts(spark, d):
    return co.retention_counts(due(spark, d))


@query("M1_retention_kept", f"WITH {RETENTION} SELECT event_id, CASE WHEN action = 'ANONYMIZE' THEN 'User_' || left(sha256('salt' || user_id), 8) ELSE user_id::VARCHAR END AS subject FROM due WHERE action IS NULL OR action = 'ANONYMIZE'")
def retention_kept(spark, d):
    rows = due(spark, d).withColumn("subject", F.col("user_id").cast("string"))
    kept, _ = co.apply_retention(rows, {"subject": tx.pseudonym(F.col("user_id"), "salt")})
    return kept.select("event_id", "subject")


CONSENTS = """cons AS (SELECT c_custkey, c_mktsegment, c_acctbal > 0 AS given, CASE WHEN c_custkey % 10 = 0 THEN TIMESTAMP '2001-01-01' END AS withdrawn_at FROM customer)"""


def consents(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", "c_mktsegment", (F.col("c_acctbal") > 0).alias("given"),
        F.when(F.col("c_custkey") % 10 == 0, F.to_timestamp(F.lit("2001-01-01"))).alias("withdrawn_at"))


@query("M2_consent_withdrawal", f"WITH {CONSENTS} SELECT c_custkey, {at_sql('CASE WHEN given AND withdrawn_at IS NULL AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000) THEN TIMESTAMP ' + chr(39) + '2002-02-02' + chr(39) + ' ELSE withdrawn_at END')} AS withdrawn_at FROM cons")
def consent_withdrawal(spark, d):
    asked = table(spark, d, "orders").filter("o_totalprice > 480000").select(F.col("o_custkey").alias("c_custkey"))
    out = co.withdraw_consent(consents(spark, d), asked, ["c_custkey"], F.to_timestamp(F.lit("2002-02-02")))
    return out.select("c_custkey", at("withdrawn_at").alias("withdrawn_at"))


@query("M2_stored_consents", ORACLES["M2_consent_withdrawal"])
def stored_consents(spark, d):
    """The same withdrawals on a stored table of consents."""
    asked = table(spark, d, "orders").filter("o_totalprice > 480000").select(F.col("o_custkey").alias("c_custkey"))
    path = f"{ensure_checkpoint_dir(spark)}/consents-{uuid.uuid4().hex}"
    keyed_table.create(consents(spark, d), path, ["c_custkey"])
    when = F.to_timestamp(F.lit("2002-02-02"))
    keyed_table.update(spark, path, asked, ["c_custkey"], lambda old, new: co.withdraw_consent(old, new, ["c_custkey"], when))
    return keyed_table.read(spark, path).select("c_custkey", at("withdrawn_at").alias("withdrawn_at"))


@query("M3_consent_statistics", f"WITH {CONSENTS} SELECT c_mktsegment, count(*) AS total, count(*) FILTER (given) AS given, count(withdrawn_at) AS withdrawn FROM cons GROUP BY 1")
def consent_statistics(spark, d):
    return co.consent_statistics(consents(spark, d), "c_mktsegment")


@query("M4_request_queue", """
WITH r AS (SELECT CAST(max(o_orderdate) AS DATE) - 20 AS r FROM orders)
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS deadline, date_diff('day', r, CAST(o_orderdate AS DATE) + 30) AS days_left, date_diff('day', r, CAST(o_orderdate AS DATE) + 30) < 0 AS overdue
FROM orders CROSS JOIN r WHERE o_orderstatus = 'P'""")
def request_queue(spark, d):
    out = queue(spark, d)
    return out.select("o_orderkey", F.col("deadline").cast("string").alias("deadline"), F.col("days_left").cast("long").alias("days_left"), "overdue")


def queue(spark, d):
    o = table(spark, d, "orders")
    rows = o.withColumn("status", F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise("DONE"))
    ref = o.agg(F.max(F.col("o_orderdate") - F.expr("INTERVAL 20 DAYS"))).scalar()
    return co.request_queue(rows, "o_orderdate", "o_orderkey", ref)


@query("M3_compliance_report", f"""
WITH {CONSENTS}, req AS ({ORACLES["M4_request_queue"]}), c AS ({ORACLES["M3_consent_statistics"]})
SELECT 'requests' AS section, 'pending' AS name, count(*) AS value FROM req
UNION ALL SELECT 'requests', 'overdue', count(*) FILTER (overdue) FROM req
UNION ALL SELECT 'consents', c_mktsegment || ':total', total FROM c
UNION ALL SELECT 'consents', c_mktsegment || ':given', given FROM c
UNION ALL SELECT 'consents', c_mktsegment || ':withdrawn', withdrawn FROM c
UNION ALL SELECT 'policies', 'active', {len(fixed.RETENTION_POLICIES)}""")
def compliance_report(spark, d):
    return co.compliance_report(queue(spark, d), consents(spark, d), co.default_policies(spark), "c_mktsegment")


@query("M5_subject_access", """
WITH u AS (SELECT c_custkey FROM customer WHERE c_acctbal > 5000),
r AS (SELECT c_custkey, 'account:' || lpad(c_custkey::VARCHAR, 20, '0') AS record_id, 'account' AS kind, '{"segment":"' || c_mktsegment || '","account_id":' || c_custkey || '}' AS record FROM customer JOIN u USING (c_custkey)
 UNION ALL SELECT o_custkey, 'order:' || lpad(o_orderkey::VARCHAR, 20, '0'), 'order', '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' FROM orders WHERE o_custkey IN (SELECT c_custkey FROM u))
SELECT c_custkey, 0::BIGINT AS part, count(*) AS records, sum(length(record))::BIGINT AS chars FROM r GROUP BY c_custkey""")
def subject_access(spark, d):
    customers = table(spark, d, "customer")
    accounts = customers.select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("account_id"))
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    rows = co.subject_records({"account": (accounts, "c_custkey", "account_id"), "order": (orders, "o_custkey", "o_orderkey")},
                              customers.filter("c_acctbal > 5000"), "c_custkey")
    documents = exports.chunked_documents(rows, "c_custkey", "record_id", ["kind", "record"], {})
    records = F.from_json("document", "records array<struct<kind:string,record:string>>")["records"]
    return documents.select("c_custkey", "part", F.size(records).cast("long").alias("records"),
                            F.aggregate(records, F.lit(0).cast("long"), lambda a, r: a + F.length(r["record"])).alias("chars"))


@query("M6_erasure", """
SELECT event_id, event_type, CASE WHEN user_id IN (SELECT user_id FROM events WHERE value > 300) THEN 'User_' || left(sha256('salt' || user_id), 8) ELSE user_id::VARCHAR END AS user_id FROM events""")
def erasure(spark, d):
    e = events(spark, d).select("event_id", "event_type", "user_id")
    users = events(spark, d).filter("value > 300")
    return co.erase(e, users, "user_id", {"user_id": tx.pseudonym(F.col("user_id"), "salt")})


@query("M7_unreferenced_items", """
SELECT o_orderkey FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def unreferenced_items(spark, d):
    o = table(spark, d, "orders")
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return co.unreferenced(o, refs, "o_orderkey", "o_orderdate", latest(o, "o_orderdate")).select("o_orderkey")


# -- N ------------------------------------------------------------------------------------

NAMES = {"signup": "Minted", "click": "Updated", "purchase": "Verified", "view": "RoleGranted", "error": "Paused"}


def contract_events(spark, d):
    name = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    e = events(spark, d)
    return e.select("event_id", name[F.col("event_type")].alias("name"), F.col("event_id").alias("block"), F.col("user_id").alias("token_id"),
                    (F.col("user_id") % 50).alias("owner"), (F.col("user_id") % 7).alias("institution"),
                    F.md5(F.concat_ws(":", F.col("user_id").cast("string"), (F.col("event_id") % 3).cast("string"))).alias("content_hash"),
                    F.col("value").alias("score"))


CONTRACT = f"""ce AS (SELECT event_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items())} END AS name, event_id AS block, user_id AS token_id,
  user_id % 50 AS owner, user_id % 7 AS institution, md5(user_id || ':' || (event_id % 3)) AS content_hash, value AS score FROM events)"""


@query("N1_event_summary", f"WITH {CONTRACT} SELECT name, count(*) AS n FROM ce WHERE block BETWEEN 100 AND 800 GROUP BY name")
def event_summary(spark, d):
    return lg.event_summary(contract_events(spark, d), 100, 800)


@query("N2_activity_rate", f"WITH {CONTRACT} SELECT count(*) AS events, round(count(*) / 1000.0::DOUBLE, 4) AS per_block FROM ce WHERE block >= (SELECT max(block) FROM ce) - 1000")
def activity_rate(spark, d):
    return lg.activity_rate(contract_events(spark, d))


@query("N3_activity_health", f"WITH {CONTRACT}, h AS (SELECT max(block) AS head FROM ce), c AS (SELECT count(*) FILTER (block >= head - 100 AND name = 'Minted') AS recent, count(*) FILTER (block = head AND name = 'Paused') > 0 AS paused FROM ce CROSS JOIN h) SELECT recent, concat_ws('; ', CASE WHEN paused THEN 'Contract is paused' END, CASE WHEN recent = 0 THEN 'No recent activity (last 100 blocks)' END) AS issues, CASE WHEN paused OR recent = 0 THEN 'warning' ELSE 'healthy' END AS status FROM c")
def activity_health(spark, d):
    e = contract_events(spark, d)
    head = e.agg(F.max("block")).scalar()
    last = e.agg(F.max_by("name", "block") == "Paused").scalar()
    out = lg.health(e.filter("name = 'Minted'"), head, last)
    return out.select("recent", F.array_join("issues", "; ").alias("issues"), "status")


STATE = f"""{CONTRACT}, st AS (SELECT token_id, arg_max(owner, block) FILTER (name = 'Minted') AS owner, arg_max(content_hash, block) FILTER (name IN ('Minted', 'Updated')) AS content_hash,
  arg_max(score, block) FILTER (name IN ('Minted', 'Updated')) AS score, count(*) FILTER (name = 'Updated') AS updates, count(*) FILTER (name = 'Verified') > 0 AS verified, min(institution) AS institution
  FROM ce GROUP BY token_id HAVING count(*) FILTER (name = 'Minted') > 0)"""


@query("N4_token_state", f"WITH {STATE} SELECT token_id, owner, content_hash, score, updates, verified FROM st")
def token_state(spark, d):
    return lg.token_state(contract_events(spark, d), ["block", "event_id"])


@query("N5_token_lookups", f"""WITH {STATE} SELECT kind, key, count(*) AS tokens, min(token_id) AS first_token, max(token_id) AS last_token FROM (
  SELECT token_id, 'owner' AS kind, owner::VARCHAR AS key FROM st UNION ALL SELECT token_id, 'content_hash', content_hash FROM st) GROUP BY 1, 2""")
def token_lookups(spark, d):
    state = lg.token_state(contract_events(spark, d), ["block", "event_id"])
    return lg.lookup_counts(lg.lookup_index(state, ["owner", "content_hash"]))


@query("N6_portfolio", f"""WITH {rec.RECORDS} SELECT owner, count(token_id) AS verified, least(95, 60 + count(token_id) * 5) AS credibility, least(100, 70 + count(token_id) * 3) AS uniqueness,
  least(100, 65 + count(token_id) * 4) AS consistency FROM recs WHERE ledger_status = 'CONFIRMED' GROUP BY owner""")
def portfolio(spark, d):
    return lg.portfolio(rec.joined(spark, d), "owner")


@query("N6_recent_activity", f"WITH {rec.RECORDS}, r AS (SELECT owner, submission_id, row_number() OVER (PARTITION BY owner ORDER BY recorded_at DESC, submission_id DESC) AS k FROM recs WHERE ledger_status = 'CONFIRMED') SELECT owner, submission_id FROM r WHERE k <= 5")
def recent_activity(spark, d):
    return lg.recent_activity(rec.joined(spark, d), "owner", [F.desc("recorded_at"), F.desc("submission_id")]).select("owner", "submission_id")


@query("N7_portfolio_averages", f"""WITH {rec.RECORDS} SELECT owner, round(avg(authorship_score))::BIGINT AS mean_authorship, round(avg(ai_probability))::BIGINT AS mean_ai, count(*) FILTER (duplicates = 0) AS unique_tokens,
  count(*) FILTER (authorship_score >= 70) AS matches, count(*) AS tokens FROM recs WHERE ledger_status = 'CONFIRMED' GROUP BY owner""")
def portfolio_averages(spark, d):
    return lg.portfolio_averages(rec.joined(spark, d).filter("ledger_status = 'CONFIRMED'"), "owner")


@query("N8_receipts", """
WITH r AS (SELECT l_orderkey, max(l_shipdate) AS m, CASE min(l_returnflag) WHEN 'A' THEN 'FAILED' ELSE 'CONFIRMED' END AS rs, count(*) AS block_number FROM lineitem GROUP BY 1),
t AS (SELECT o_orderkey, o_custkey % 5 AS retry_count, rs, block_number, CASE WHEN rs IS NOT NULL THEN rs ELSE 'SENT' END AS s FROM orders LEFT JOIN r ON l_orderkey = o_orderkey)
SELECT o_orderkey, CASE WHEN s = 'FAILED' AND retry_count < 3 THEN 'PENDING' ELSE s END AS status, CASE WHEN s = 'FAILED' AND retry_count < 3 THEN retry_count + 1 ELSE retry_count END AS retry_count,
  CASE WHEN rs = 'CONFIRMED' THEN block_number END AS block_number, CASE WHEN rs = 'FAILED' THEN 'Transaction failed' END AS error_message FROM t""")
def receipts(spark, d):
    records = table(spark, d, "orders").select("o_orderkey", F.lit("SENT").alias("status"), (F.col("o_custkey") % 5).alias("retry_count"), F.lit(3).alias("max_retries"))
    got = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.when(F.min("l_returnflag") == "A", "FAILED").otherwise("CONFIRMED").alias("receipt_status"), F.count("*").alias("block_number"))
    out = lg.apply_receipts(records, got, "o_orderkey", F.to_timestamp(F.lit("2002-01-01")))
    return out.select("o_orderkey", "status", "retry_count", "block_number", "error_message")


@query("N9_unsynced_events", f"WITH {CONTRACT} SELECT event_id, name FROM ce WHERE block >= (SELECT max(block) FROM ce) - 700 AND name <> 'RoleGranted'")
def unsynced_events(spark, d):
    e = contract_events(spark, d)
    return lg.unsynced(e, e.filter("name = 'RoleGranted'"), ["event_id"], 700).select("event_id", "name")


@query("N10_token_metadata", f"""WITH {rec.SUBMISSIONS}, {rec.LEDGER}, {rec.VERIFICATION}
SELECT submission_id, 'Authorship record - Essay ' || submission_id AS name, round(coalesce(authorship_score, 85), 6) AS score, round(greatest(0.0, 100 - coalesce(authorship_score, 85)), 6) AS ai,
  strftime(recorded_at, '%Y-%m-%d') AS verified_on FROM ledg LEFT JOIN verif USING (submission_id) WHERE ledger_status = 'CONFIRMED'""")
def token_metadata(spark, d):
    rows = rec.ledger(spark, d).join(rec.verification(spark, d), "submission_id", "left").withColumn(
        "title", F.concat(F.lit("Essay "), F.col("submission_id").cast("string")))
    out = lg.token_metadata(rows, "Institution", "Authorship record - ")
    return out.select("submission_id", F.col("metadata.name").alias("name"), F.round("proof.authorship_score", 6).alias("score"),
                      F.round("proof.ai_probability", 6).alias("ai"), F.get("metadata.attributes", F.lit(2))["value"].alias("verified_on"))


# -- O ------------------------------------------------------------------------------------

def http(spark, d):
    e = events(spark, d)
    kind = F.col("event_type")
    return e.select(
        "event_id", "ts", F.when(kind.isin("view", "error"), "GET").otherwise("POST").alias("method"),
        F.concat(F.lit("/api/items/"), F.col("user_id").cast("string"), F.lit("/"), kind).alias("path"),
        F.when(kind == "error", 500).when(kind == "signup", 404).otherwise(200).alias("status"), (F.col("value") / 100).alias("seconds"))


HTTP = """http AS (SELECT event_id, ts, CASE WHEN event_type IN ('view', 'error') THEN 'GET' ELSE 'POST' END AS method, event_type AS endpoint_kind,
  CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END AS status, value / 100 AS seconds FROM events)"""
BUCKETS_SQL = ", ".join(f"({b}::DOUBLE)" for b in mt.LATENCY_BUCKETS) + ", ('inf'::DOUBLE)"


@query("O1_request_counts", f"WITH {HTTP} SELECT method, '/api/items/{{id}}/' || endpoint_kind AS endpoint, status::BIGINT AS status, count(*) AS n FROM http GROUP BY ALL")
def request_counts(spark, d):
    return mt.request_counts(http(spark, d)).withColumn("status", F.col("status").cast("long"))


@query("O2_latency_histogram", f"WITH {HTTP}, b(le) AS (VALUES {BUCKETS_SQL}) SELECT method, le::VARCHAR AS le, count(*) FILTER (seconds <= le) AS n FROM http CROSS JOIN b GROUP BY method, le")
def latency_histogram(spark, d):
    out = mt.latency_histogram(http(spark, d), ["method"], "seconds")
    return out.withColumn("le", F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string")))


RATES = f"""{HTTP}, slots AS (SELECT (floor(epoch(ts) / 60) * 60)::BIGINT AS slot, count(*) AS n, count(*) FILTER (status BETWEEN 400 AND 499) AS c, count(*) FILTER (status >= 500) AS s FROM http GROUP BY 1),
rates AS (SELECT "at", sum(n) / 300.0::DOUBLE AS total, sum(c) / 300.0::DOUBLE AS client_errors, sum(s) / 300.0::DOUBLE AS server_errors
  FROM (SELECT slot + 60 * unnest([1, 2, 3, 4, 5]) AS "at", n, c, s FROM slots) GROUP BY "at")"""


@query("O3_rate_series", f'''WITH {RATES} SELECT "at"::BIGINT AS "at", round(total, 8) AS total, round(client_errors, 8) AS client_errors, round(server_errors, 8) AS server_errors FROM rates''')
def rate_series(spark, d):
    out = mt.rate_series(http(spark, d), "ts", "status")
    return out.select("at", *[F.round(c, 8).alias(c) for c in ("total", "client_errors", "server_errors")])


@query("O4_quantile_series", f"""WITH {HTTP}, b AS (SELECT * FROM (VALUES {BUCKETS_SQL}) AS b(le)),
h AS (SELECT CAST(ts AS DATE) AS day, le, count(*) FILTER (seconds <= le)::DOUBLE AS n FROM http CROSS JOIN b GROUP BY 1, 2),
l AS (SELECT *, lag(n, 1, 0.0::DOUBLE) OVER w AS below, lag(le, 1, 0.0::DOUBLE) OVER w AS low, max(n) OVER (PARTITION BY day) AS total FROM h WINDOW w AS (PARTITION BY day ORDER BY le)),
r AS (SELECT day, q, min_by(CASE WHEN le = 'inf'::DOUBLE THEN 10.0 ELSE low + (le - low) * (q * total - below) / (n - below) END, le) AS v FROM l CROSS JOIN (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) AS qs(q) WHERE n >= q * total AND n > below GROUP BY 1, 2)
SELECT CAST(day AS VARCHAR) AS day, round(max(v) FILTER (q = 0.5), 6) AS p50, round(max(v) FILTER (q = 0.95), 6) AS p95 FROM r GROUP BY day""")
def quantile_series(spark, d):
    rows = http(spark, d).withColumn("day", F.to_date("ts").cast("string"))
    out = mt.quantile_series(rows, ["day"], "seconds", {"p50": 0.5, "p95": 0.95})
    return out.select("day", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("O4_merged_sketches", f"""WITH {HTTP} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, true AS p50_within, true AS p95_within FROM http GROUP BY 1""")
def merged_sketches(spark, d):
    """Days from hourly sketches; whether the ranks of their quantiles among all of a day's durations are within 2 % of those asked for."""
    rows = http(spark, d).select("ts", "seconds", F.to_date("ts").cast("string").alias("day"))
    hourly = stage(mt.quantile_sketches(rows, [], "ts", "seconds"), "sketches")
    daily = mt.merged_quantiles(hourly, [F.to_date("start").cast("string").alias("day")], {"p50": 0.5, "p95": 0.95})
    ranked = rows.join(daily, "day").groupBy("day", "n")
    near = lambda name, q: (F.count_if(F.col("seconds") < F.col(name)) / F.col("n") <= q + 0.02) & (F.count_if(F.col("seconds") <= F.col(name)) / F.col("n") >= q - 0.02)
    return ranked.agg(near("p50", 0.5).alias("p50_within"), near("p95", 0.95).alias("p95_within"))


@query("O5_sustained_alerts", f"""WITH {RATES}, t AS (SELECT "at" AS x FROM rates WHERE server_errors > 0), f AS (SELECT x, CASE WHEN x - lag(x) OVER (ORDER BY x) <= 60 THEN 0 ELSE 1 END AS o FROM t),
g AS (SELECT x, sum(o) OVER (ORDER BY x) AS grp FROM f)
SELECT min(x)::BIGINT AS start_at, max(x)::BIGINT AS end_at, count(*) AS n FROM g GROUP BY grp HAVING max(x) - min(x) >= 300""")
def sustained_alerts(spark, d):
    points = mt.rate_series(http(spark, d), "ts", "status").withColumns(
        {"time": F.timestamp_seconds("at"), "series": F.lit("server_errors")})
    out = mt.sustained(points, ["series"], "time", F.col("server_errors") > 0, 60, 300, F.to_date("time"))
    return out.select(F.unix_timestamp("start").alias("start_at"), F.unix_timestamp("end").alias("end_at"), "n")


@query("O6_load_summary", f"""WITH {HTTP}, s AS (SELECT *, row_number() OVER (ORDER BY seconds) - 1 AS k, count(*) OVER () AS c FROM http)
SELECT count(*) AS total, count(*) FILTER (status BETWEEN 200 AND 299) AS successful, count(*) FILTER (status NOT BETWEEN 200 AND 299) AS failed, round(avg(seconds), 6) AS mean, min(seconds) AS fastest, max(seconds) AS slowest,
  max(seconds) FILTER (k = floor(c * 0.95::DOUBLE)::BIGINT) AS p95, max(seconds) FILTER (k = floor(c * 0.99::DOUBLE)::BIGINT) AS p99, round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 6) AS per_second,
  round(count(*) FILTER (status BETWEEN 200 AND 299) / count(*), 6) AS success_rate FROM s""")
def load_summary(spark, d):
    out = mt.load_summary(http(spark, d), "seconds", F.col("status"), "ts")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "per_second", "success_rate")})


@query("O7_variability", f"WITH {HTTP} SELECT method, count(*) AS n, round(stddev_samp(seconds) / avg(seconds), 6) AS variation, stddev_samp(seconds) / avg(seconds) < 0.5 AS stable FROM http GROUP BY method HAVING count(*) >= 10")
def variability(spark, d):
    return mt.variability(http(spark, d), ["method"], "seconds").withColumn("variation", F.round("variation", 6))


# -- P ------------------------------------------------------------------------------------

RESULT_SQL = "CASE status WHEN 'FLAGGED' THEN 'REVIEW' WHEN 'REJECTED' THEN 'FAIL' ELSE 'PASS' END"


@query("P1_grades", f"""WITH {rec.RECORDS}, g AS (SELECT submission_id, {RESULT_SQL} AS result, authorship_score, ai_probability, duplicates FROM recs)
SELECT submission_id, round(greatest(0.0, CASE result WHEN 'FAIL' THEN 0.0 WHEN 'REVIEW' THEN 50.0 ELSE 100.0 END::DOUBLE - greatest(0.0, (70 - authorship_score) * 0.5::DOUBLE) - greatest(0.0, ai_probability * 0.3::DOUBLE)), 5) AS grade,
  'Authorship Score: ' || printf('%.1f', round(authorship_score, 1)) || '%; AI Detection: ' || printf('%.1f', round(ai_probability, 1)) || '%; Status: ' || result || CASE WHEN duplicates > 0 THEN '; Duplicate matches found: ' || duplicates ELSE '' END AS comment FROM g""")
def grades(spark, d):
    rows = rec.joined(spark, d).withColumn("result", F.when(F.col("status") == "FLAGGED", "REVIEW").when(F.col("status") == "REJECTED", "FAIL").otherwise("PASS"))
    a, p = F.col("authorship_score"), F.col("ai_probability")
    return rows.select("submission_id", F.round(fd.grade(F.col("result"), a, p), 5).alias("grade"),
                       fd.grade_comment(F.col("result"), a, p, F.col("duplicates")).alias("comment"))


@query("P2_submission_intake", """
SELECT l_partkey AS assignment, l_suppkey AS user_id, min(struct_pack(a := l_orderkey, b := l_linenumber)).a AS l_orderkey FROM lineitem
WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_partkey = lineitem.l_partkey AND x.l_suppkey = lineitem.l_suppkey AND x.l_returnflag = 'R')
GROUP BY 1, 2""")
def submission_intake(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("assignment"), F.col("l_suppkey").alias("user_id"), "l_orderkey", "l_linenumber", "l_returnflag")
    users = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("user_id"))
    out = fd.intake(li, users, li.filter("l_returnflag = 'R'"), "user_id", "assignment", ["l_orderkey", "l_linenumber"])
    return out.select("assignment", "user_id", "l_orderkey")


HANDLERS = {"signup": "user_created", "purchase": "submission_created", "click": "assignment_updated"}


@query("P3_event_routing", f"SELECT CASE event_type {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in HANDLERS.items())} ELSE 'unhandled' END AS handler, count(*) AS n FROM events GROUP BY 1")
def event_routing(spark, d):
    return fd.route(events(spark, d), HANDLERS, "event_type").groupBy("handler").agg(F.count("*").alias("n"))


@query("P4_retry_plan", """
WITH a AS (SELECT user_id, max(event_id % 6) AS attempts FROM events WHERE event_type = 'error' AND value > 60 GROUP BY 1)
SELECT user_id, attempts, CASE WHEN attempts <= 3 THEN 'retry' ELSE 'dead_letter' END AS action, CASE WHEN attempts <= 3 THEN pow(2, attempts) END AS delay_seconds FROM a""")
def retry_plan(spark, d):
    attempts = events(spark, d).filter(failed() & (F.col("value") > 60)).select("user_id", (F.col("event_id") % 6).alias("attempt"))
    return fd.retry_plan(attempts, "user_id", "attempt")


@query("P5_integration_status", """
WITH c AS (SELECT DISTINCT c_nationkey AS nation, c_custkey FROM customer)
SELECT n_nationkey AS nation, (SELECT count(*) FROM c WHERE nation = n_nationkey) AS courses, count(o_orderkey) AS submissions, strftime(max(o_orderdate), '%Y-%m-%d') AS last_sync
FROM nation LEFT JOIN c ON nation = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey""")
def integration_status(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"))
    courses = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("course"))
    subs = table(spark, d, "orders").select(F.col("o_custkey").alias("course"), "o_orderdate")
    out = fd.integration_status(nations, courses, subs, "nation", "course", "o_orderdate")
    return out.select("nation", "courses", "submissions", F.date_format("last_sync", "yyyy-MM-dd").alias("last_sync"))


@query("P6_assignment_upsert", """
WITH b AS (SELECT l_partkey, l_orderkey, l_shipdate, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC) AS k FROM lineitem WHERE l_returnflag = 'A')
SELECT p_partkey AS part, coalesce(b.l_orderkey, -1) AS l_orderkey FROM part LEFT JOIN b ON b.l_partkey = p_partkey AND k = 1""")
def assignment_upsert(spark, d):
    stored = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.lit(-1).cast("long").alias("l_orderkey"), F.lit(None).cast("timestamp_ntz").alias("l_shipdate"))
    batch = table(spark, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("part"), "l_orderkey", F.col("l_shipdate").cast("timestamp_ntz").alias("l_shipdate"))
    return fd.newest_per_key(stored, batch, "part", ["l_shipdate", "l_orderkey"]).select("part", "l_orderkey")


@query("P6_stored_assignments", ORACLES["P6_assignment_upsert"])
def stored_assignments(spark, d):
    """The same upsert on a stored table, of which only the buckets of changed assignments are written."""
    stored = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.lit(-1).cast("long").alias("l_orderkey"), F.lit(None).cast("timestamp").alias("l_shipdate"))
    batch = table(spark, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("part"), "l_orderkey", F.col("l_shipdate").cast("timestamp").alias("l_shipdate"))
    path = f"{ensure_checkpoint_dir(spark)}/assignments-{uuid.uuid4().hex}"
    keyed_table.create(stored, path, ["part"])
    keyed_table.update(spark, path, batch, ["part"], lambda old, new: fd.newest_per_key(old, new, "part", ["l_shipdate", "l_orderkey"]))
    return keyed_table.read(spark, path).select("part", "l_orderkey")


@query("P7_sync_rollup", "SELECT event_type, count(*) AS runs, sum(user_id)::BIGINT AS processed, count(*) FILTER (value > 100) AS failed, round(avg(value), 6) AS mean_seconds FROM events GROUP BY 1")
def sync_rollup(spark, d):
    logs = events(spark, d).select("event_type", F.col("user_id").alias("processed"), (F.col("value") > 100).cast("int").alias("failed"), F.col("value").alias("seconds"))
    return fd.sync_rollup(logs, "event_type").withColumn("mean_seconds", F.round("mean_seconds", 6))


@query("P8_delivery_outcomes", f"SELECT user_id, count(*) AS deliveries, count(*) FILTER (event_type = 'error') AS failures, {at_sql('max(ts)')} AS last_delivery FROM events GROUP BY 1")
def delivery_outcomes(spark, d):
    out = fd.delivery_outcomes(events(spark, d), "user_id", "ts", failed())
    return out.withColumn("last_delivery", at("last_delivery"))
