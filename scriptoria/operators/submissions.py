"""Submission queries and maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def search(rows: DataFrame, needle: str, columns: tuple[str, ...] = ("title", "content")) -> DataFrame:
    """Rows with the needle in any of the columns, ignoring case."""
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.contains(F.lower(name), F.lit(needle.lower()))
    return rows.filter(hit)


# -- an index of substrings -----------------------------------------------------------------------

def three_grams(text: Column) -> Column:
    """Distinct runs of three characters of a lower-cased text; none of shorter texts."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def build_substring_index(rows: DataFrame, path: str, key: str, columns: list[str], buckets: int = 64) -> None:
    """Write postings (gram, key) in folders by the gram's hash and sorted by gram, so that a search opens few of them."""
    grams = rows.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.flatten(F.array(*(F.coalesce(three_grams(F.col(c)), F.array().cast("array<string>")) for c in columns))))).alias("gram"))
    dealt = grams.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    dealt.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("bucket", "gram", "key").write.mode("overwrite").partitionBy("bucket").parquet(path)


def index_candidates(spark: SparkSession, path: str, needle: str, buckets: int = 64) -> DataFrame | None:
    """(key): rows that hold every run of three characters of the needle; None for a needle of fewer."""
    wanted = list(dict.fromkeys(needle.lower()[i : i + 3] for i in range(len(needle) - 2)))
    if not wanted:
        return None
    places = spark.createDataFrame([(w,) for w in wanted], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")).distinct()
    held = spark.read.parquet(path).filter(F.col("bucket").isin([r[0] for r in places.collect()]) & F.col("gram").isin(wanted))
    return held.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("key")


def indexed_search(rows: DataFrame, path: str, key: str, needle: str, columns: tuple[str, ...] = ("title", "content"), buckets: int = 64) -> DataFrame:
    """`search` over the rows that the index leaves; short needles are searched for in all rows."""
    found = index_candidates(rows.sparkSession, path, needle, buckets)
    return search(rows if found is None else rows.join(found.withColumnRenamed("key", key), key, "left_semi"), needle, columns)


# -- pages by range -------------------------------------------------------------------------------

def build_pages(rows: DataFrame, path: str, order: list[str], descending: bool = True, ranges: int = 200) -> None:
    """Write a listing in ranges of its order, and the number of rows before each range.

    ``order`` has to be total. The ranges' sizes are a small table beside the rows, so that any page is found without sorting or skipping others.
    """
    by = [F.desc(c) if descending else F.asc(c) for c in order]
    dealt = rows.repartitionByRange(ranges, *by).withColumn("range", F.spark_partition_id())
    dealt.sortWithinPartitions(*by).write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
    sizes = rows.sparkSession.read.parquet(f"{path}/rows").groupBy("range").agg(F.count("*").alias("n"))
    sizes.withColumn("before", F.sum("n").over(W.orderBy("range")) - F.col("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")


def ranges_of_page(spark: SparkSession, path: str, number: int, size: int) -> list[int]:
    """The ranges that hold rows of a page, mostly one."""
    first, last = (number - 1) * size, number * size
    sizes = spark.read.parquet(f"{path}/sizes").filter((F.col("before") < last) & (F.col("before") + F.col("n") > first))
    return sorted(r.range for r in sizes.collect())


def ranged_page(spark: SparkSession, path: str, order: list[str], number: int = 1, size: int = 20, descending: bool = True) -> DataFrame:
    """A page of the listing of `build_pages`; reads the ranges of `ranges_of_page` alone."""
    by = [F.desc(c) if descending else F.asc(c) for c in order]
    wanted = ranges_of_page(spark, path, number, size)
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("range").isin(wanted) if wanted else F.lit(False))
    placed = rows.join(F.broadcast(spark.read.parquet(f"{path}/sizes").select("range", "before")), "range")
    place = placed["before"] + F.row_number().over(W.partitionBy("range").orderBy(*by))
    return placed.withColumn("place", place).filter(F.col("place").between((number - 1) * size + 1, number * size)).drop("range", "before", "place")


def page(
    rows: DataFrame, order: list[Column], number: int = 1, size: int = 20, owner: tuple[str, object] | None = None,
    status: tuple[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """One page of a filtered listing, and a row with its total and page count.

    Filters are (column, value). The total follows the filters.
    """
    for condition in (owner, status):
        if condition is not None:
            rows = rows.filter(F.col(condition[0]) == condition[1])
    total = rows.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).alias("pages"))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size), total


def enriched(submissions: DataFrame, verification: DataFrame, ledger: DataFrame, key: str, content: str | None = None) -> DataFrame:
    """Listing with verification and ledger columns, defaults where there is none.

    ``verification`` has authorship_score and ai_probability, ``ledger`` has ledger_status. The
    content becomes a preview of 500 characters.
    """
    out = submissions.join(verification, key, "left").join(ledger, key, "left").withColumns(
        {
            "authorship_score": F.coalesce("authorship_score", F.lit(0.65)),
            "ai_probability": F.coalesce("ai_probability", F.lit(0.0)),
            "ledger_status": F.coalesce("ledger_status", F.lit("PENDING")),
        }
    )
    return out.withColumn(content, F.left(content, F.lit(500))) if content else out


# Stage and progress by submission status.
PROGRESS = {
    "UPLOADED": ("UPLOADING", 10),
    "PROCESSING": ("PROCESSING", 50),
    "VERIFIED": ("COMPLETED", 100),
    "FLAGGED": ("COMPLETED", 100),
    "REJECTED": ("COMPLETED", 100),
    "ERROR": ("ERROR", 0),
}


def with_progress(rows: DataFrame, status: str = "status") -> DataFrame:
    """Add ``stage`` and ``progress``; UNKNOWN and 0 for other statuses."""
    table = F.create_map(
        *[x for s, (st, p) in PROGRESS.items() for x in (F.lit(s), F.struct(F.lit(st).alias("stage"), F.lit(p).alias("progress")))]
    )
    hit = F.try_element_at(table, F.col(status))
    return rows.withColumns({"stage": F.coalesce(hit["stage"], F.lit("UNKNOWN")), "progress": F.coalesce(hit["progress"], F.lit(0))})


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    s = F.col(status)
    return rows.agg(
        F.count_if(s.isin("VERIFIED", "FLAGGED", "REJECTED")).alias("completed"),
        F.count_if(s.isin("UPLOADED", "PROCESSING")).alias("processing"),
        F.count_if(s == "ERROR").alias("failed"),
        F.count("*").alias("total"),
    )


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the given submissions."""
    gone = ids.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def bulk_review(rows: DataFrame, ids: DataFrame, key: str, action: str, notes: str, status: str = "status") -> DataFrame:
    """Apply approve/reject to the listed submissions."""
    decision = {"approve": "VERIFIED", "reject": "REJECTED"}[action]
    marked = rows.join(ids.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    hit = F.coalesce("__hit", F.lit(False))
    return marked.withColumns(
        {status: F.when(hit, decision).otherwise(F.col(status)), "review_notes": F.when(hit, notes)}
    ).drop("__hit")


def bulk_verify(rows: DataFrame, ids: DataFrame, key: str, force: bool = False, status: str = "status") -> DataFrame:
    """Set listed submissions back to PROCESSING; finished ones only when forced."""
    marked = rows.join(ids.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    again = F.coalesce("__hit", F.lit(False)) & (F.lit(force) | ~F.col(status).isin("VERIFIED", "FLAGGED", "REJECTED"))
    return marked.withColumn(status, F.when(again, "PROCESSING").otherwise(F.col(status))).drop("__hit")


def awaiting_verification(
    submissions: DataFrame, verification: DataFrame, key: str, content_length: Column, status: str = "status", longer_than: int = 50
) -> DataFrame:
    """Submissions without a result that are not being processed and have enough content."""
    rows = submissions.filter((F.col(status) != "PROCESSING") & (content_length > longer_than))
    return rows.join(verification.select(key), key, "left_anti")


def severity(score: Column, ai: Column, duplicates: Column) -> Column:
    """HIGH, MEDIUM or LOW from percentages and the number of duplicates."""
    return (
        F.when((score < 50) | (ai > 80) | (duplicates > 2), "HIGH")
        .when((score < 70) | (ai > 50) | (duplicates > 0), "MEDIUM")
        .otherwise("LOW")
    )


def flagged_queue(
    rows: DataFrame, sort_by: str, key: str, status: str | None = None, date: str = "submitted_at", name: str = "owner"
) -> DataFrame:
    """Rows with ``severity``, filtered by status and sorted by date, severity or name."""
    out = rows.withColumn("severity", severity(F.col("authorship_score"), F.col("ai_probability"), F.col("duplicates")))
    if status is not None:
        out = out.filter(F.col("status") == status)
    rank = F.when(F.col("severity") == "HIGH", 3).when(F.col("severity") == "MEDIUM", 2).otherwise(1)
    order = {"date": F.desc(date), "severity": rank.desc(), "name": F.asc(name)}[sort_by]
    return out.orderBy(order, key)
