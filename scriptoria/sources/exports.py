"""Exports: nested JSON documents, metric/value rows and date-range extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Export ranges in days.
RANGE_DAYS = {"7d": 7, "30d": 30, "90d": 90, "1y": 365}


def chunked_documents(
    records: DataFrame, key: str, record_id: str, fields: list[str], header: dict[str, Column], per_document: int = 10_000
) -> DataFrame:
    """JSON documents of a key's records, split so that no document grows without bound.

    A key with at most ``per_document`` records gives one document. A larger one gives several,
    numbered by ``part``; records are spread over the parts by the hash of their id.
    """
    parts = records.groupBy(key).agg(F.ceil(F.count("*") / per_document).alias("parts"))
    body = F.struct(*fields)
    rows = records.join(parts, key).withColumn(
        "part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64(record_id), F.col("parts"))).otherwise(0).cast("long")
    )
    grouped = rows.groupBy(key, "parts", "part").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(record_id).alias("k"), body.alias("v")))), lambda x: x["v"]
        ).alias("records")
    )
    document = F.to_json(F.struct(F.col(key), *[c.alias(n) for n, c in header.items()], "records"))
    return grouped.select(key, "part", document.alias("document"))


def metric_rows(profiles: DataFrame, key: str, counters: dict[str, str], features: list[str]) -> DataFrame:
    """(key, metric, value) rows: named counters first, then every lexical feature."""
    pairs = [F.struct(F.lit(label).alias("metric"), F.col(c).cast("double").alias("value")) for label, c in counters.items()]
    pairs += [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in features]
    return profiles.select(key, F.explode(F.array(*pairs)).alias("p")).select(key, "p.metric", "p.value")


def profile_documents(profiles: DataFrame, key: str) -> DataFrame:
    """One JSON document per profile row."""
    return profiles.select(key, F.to_json(F.struct(*profiles.columns)).alias("document"))


def in_range(rows: DataFrame, ts: str, range_: str, ref_ts: Column) -> DataFrame:
    """Rows of the last 7d/30d/90d/1y before ``ref_ts``; ``all`` keeps everything."""
    if range_ == "all":
        return rows
    return rows.filter(F.col(ts) >= ref_ts - F.make_dt_interval(F.lit(RANGE_DAYS[range_])))


def bulk_export(
    rows: DataFrame, ts: str, range_: str, ref_ts: Column, content: str | None = None,
    verification: DataFrame | None = None, on: str | None = None,
) -> DataFrame:
    """Extract for a range, without ``content`` when named, with verification columns when given."""
    out = in_range(rows, ts, range_, ref_ts)
    if content is not None:
        out = out.drop(content)
    return out if verification is None else out.join(verification, on, "left")


def write_export(rows: DataFrame, path: str, fmt: str) -> None:
    """Write as ``csv`` (with header) or ``json``, one file per partition."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"unsupported export format {fmt!r}")
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)
