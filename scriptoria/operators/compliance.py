"""Retention, consent and data-subject requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed


def default_policies(spark: SparkSession) -> DataFrame:
    """Active retention policies: (data_type, retention_days, action)."""
    rows = [(*p, True) for p in fixed.RETENTION_POLICIES]
    return spark.createDataFrame(rows, "data_type string, retention_days int, action string, is_active boolean")


def due_for_retention(rows: DataFrame, policies: DataFrame, ts: str, ref_ts: Column) -> DataFrame:
    """Rows with ``action`` where an active policy's cut-off has passed, null otherwise."""
    active = policies.filter("is_active").select("data_type", "retention_days", "action")
    out = rows.join(active, "data_type", "left")
    past = F.col(ts) < ref_ts - F.make_dt_interval(F.col("retention_days"))
    return out.withColumn("action", F.when(past, F.col("action"))).drop("retention_days")


def retention_counts(due: DataFrame) -> DataFrame:
    return due.filter("action is not null").groupBy("data_type", "action").agg(F.count("*").alias("n"))


def apply_retention(due: DataFrame, masks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): deleted rows are gone, anonymised ones masked, archived ones set apart."""
    masked = F.col("action").eqNullSafe(F.lit("ANONYMIZE"))
    kept = due.filter(F.col("action").isNull() | masked)
    kept = kept.withColumns({c: F.when(masked, m).otherwise(F.col(c)) for c, m in masks.items()}).drop("action")
    return kept, due.filter("action = 'ARCHIVE'").drop("action")


def withdraw_consent(consents: DataFrame, withdrawals: DataFrame, keys: list[str], ref_ts: Column) -> DataFrame:
    """Stamp given, unwithdrawn consents of the listed (user, type) pairs."""
    hits = withdrawals.select(*keys).distinct().withColumn("__hit", F.lit(True))
    out = consents.join(hits, keys, "left")
    now = F.coalesce("__hit", F.lit(False)) & F.col("given") & F.col("withdrawn_at").isNull()
    return out.withColumn("withdrawn_at", F.when(now, ref_ts).otherwise(F.col("withdrawn_at"))).drop("__hit")


def consent_statistics(consents: DataFrame, consent_type: str) -> DataFrame:
    return consents.groupBy(consent_type).agg(
        F.count("*").alias("total"), F.count_if("given").alias("given"), F.count("withdrawn_at").alias("withdrawn")
    )


def request_queue(requests: DataFrame, created: str, key: str, ref_ts: Column, days: int = 30) -> DataFrame:
    """Pending requests by deadline with days left and an overdue flag."""
    pending = requests.filter("status = 'PENDING'").withColumn("deadline", F.date_add(F.to_date(created), days))
    out = pending.withColumn("days_left", F.date_diff("deadline", F.to_date(ref_ts)))
    return out.withColumn("overdue", F.col("days_left") < 0).orderBy("deadline", key)


def compliance_report(queue: DataFrame, consents: DataFrame, policies: DataFrame, consent_type: str) -> DataFrame:
    """(section, name, value): pending and overdue requests of `request_queue`, consents by type, number of active policies.

    A null type is a type of its own, named without a prefix; empty tables give zeros, and no rows for consents.
    """
    requests = queue.agg(F.count("*").alias("pending"), F.count_if("overdue").alias("overdue"))
    requests = requests.select(F.lit("requests").alias("section"), F.inline(_named(["pending", "overdue"])))
    given = consent_statistics(consents, consent_type)
    kinds = [F.struct(F.concat_ws(":", F.col(consent_type).cast("string"), F.lit(c)).alias("name"), F.col(c).alias("value")) for c in ("total", "given", "withdrawn")]
    given = given.select(F.lit("consents").alias("section"), F.inline(F.array(*kinds)))
    active = policies.agg(F.count_if("is_active").alias("active")).select(F.lit("policies").alias("section"), F.inline(_named(["active"])))
    return requests.unionByName(given).unionByName(active)


def _named(columns: list[str]) -> Column:
    return F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns])


def subject_records(user_tables: dict[str, tuple[DataFrame, str, str]], users: DataFrame, user: str) -> DataFrame:
    """(user, record_id, kind, record): rows of the requesting users from every table as JSON.

    ``user_tables`` maps a kind to (table, user column, id column). Feed the result to
    `sources.exports.chunked_documents`, which bounds the size of each document.
    """
    wanted = users.select(user).distinct()
    parts = []
    for kind, (df, owner, id_col) in user_tables.items():
        rows = df.withColumnRenamed(owner, user).join(wanted, user, "left_semi")
        record = F.to_json(F.struct(*[c for c in rows.columns if c != user]))
        record_id = F.concat_ws(":", F.lit(kind), F.lpad(F.col(id_col).cast("string"), 20, "0"))
        parts.append(rows.select(user, record_id.alias("record_id"), F.lit(kind).alias("kind"), record.alias("record")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def erase(rows: DataFrame, users: DataFrame, user: str, masks: dict[str, Column]) -> DataFrame:
    """Mask the identifiers of the erased users; their rows stay."""
    hit = users.select(user).distinct().withColumn("__hit", F.lit(True))
    out = rows.join(hit, user, "left")
    gone = F.coalesce("__hit", F.lit(False))
    return out.select(
        *[F.when(gone, masks[c]).otherwise(F.col(c).cast("string")).alias(c) if c in masks else F.col(c) for c in rows.columns]
    )


def unreferenced(items: DataFrame, references: DataFrame, key: str, pinned: str, ref_ts: Column, days: int = 30) -> DataFrame:
    """Items pinned longer than ``days`` ago that nothing refers to."""
    old = items.filter(F.col(pinned) < ref_ts - F.make_dt_interval(F.lit(days)))
    return old.join(references.select(key), key, "left_anti")
