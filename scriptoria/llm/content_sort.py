"""Operator 12: exact duplicates by sorting the normalised texts themselves. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

#: Fixed value: what one space replaces.
SPACE = r"[\x20\x09-\x0D]+"
#: Characters of a text that take part in the splitters, so that these stay small however long texts are.
HEAD = 24
#: A text whose copies weigh more than a quarter of a partition's even share is split; no split under this number of bytes.
SHARES, LEAST_SPLIT = 4, 1 << 20


def normalised(text: Column) -> Column:
    """Whole text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _hot(rows: DataFrame) -> DataFrame:
    """(h, parts): hashes of the texts that are too heavy for one partition, and into how many parts they go.

    At most `SHARES` times the number of shuffle partitions, as each weighs more than that share of the whole.
    """
    spark = rows.sparkSession
    weights = stage(rows.groupBy("h").agg(F.sum(F.octet_length("body") + 64).alias("w")), "content-weights")
    whole = weights.agg(F.sum("w")).first()[0] or 0
    limit = max(LEAST_SPLIT, whole // (SHARES * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return weights.filter(F.col("w") > limit).select("h", F.ceil(F.col("w") / limit).cast("int").alias("parts"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep, group_size, kept, text_sha256) of every row: the groups of equal normalised texts.

    Rows are dealt by ranges of (head of the text, hash, part) whose splitters Spark samples, and sorted externally within
    each range, then by the whole text and the key. A row begins a group if its whole text differs from its neighbour's; hashes only
    balance the ranges. The parts of a text that is too heavy for one range (`_hot`) are joined by comparing one whole
    text for each part. ``keep`` is the smallest key of the group and ``kept`` true for one row that has it. Texts are shuffled once.

    Null texts count as empty ones. A null key comes after all others, and is kept only where the group has no other.
    Rows with equal keys each count; of equal rows with the smallest key one is kept. Texts of any length; an empty
    table gives no rows. Other columns are not read.
    """
    body = normalised(F.col(text))
    rows = docs.select(F.col(key).alias("key"), body.alias("body")).withColumn("h", F.xxhash64("body"))
    dealt = rows.join(F.broadcast(_hot(rows)), "h", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).withColumn("head", F.substring("body", 1, HEAD))
    place = ["head", "h", "part"]
    order = W.partitionBy(*place).orderBy("body", F.col("key").asc_nulls_last())
    sorted_rows = dealt.repartitionByRange(*place).withColumn("first", ~F.col("body").eqNullSafe(F.lag("body").over(order)))
    runs = sorted_rows.withColumn("run", F.sum(F.col("first").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    told = runs.select(
        "key", *place, "parts", "run", "first", F.sha2("body", 256).alias("text_sha256"), F.when(F.col("first") & (F.col("parts") > 1), F.col("body")).alias("body")
    )
    whole = W.partitionBy(*place, "run")
    told = told.withColumn("keep", F.max(F.when(F.col("first"), F.col("key"))).over(whole)).withColumn("n", F.count("*").over(whole))
    told = stage(told.drop("head"), "content-runs")

    cold = told.filter("parts = 1").select("key", "keep", F.col("n").alias("group_size"), F.col("first").alias("kept"), "text_sha256")
    pieces = told.filter(F.col("body").isNotNull()).select("h", "part", "run", "body", "keep", "n")
    best = F.min(F.struct(F.col("keep").isNull().alias("none"), "keep", "part", "run")).alias("best")
    joined = pieces.select("h", "part", "run", "body").join(pieces.groupBy("h", "body").agg(best, F.sum("n").alias("group_size")), ["h", "body"]).drop("body")
    hot = told.filter("parts > 1").select("key", "h", "part", "run", "first", "text_sha256").join(F.broadcast(joined), ["h", "part", "run"])
    kept = F.col("first") & (F.col("part") == F.col("best.part")) & (F.col("run") == F.col("best.run"))
    return cold.unionByName(hot.select("key", F.col("best.keep").alias("keep"), "group_size", kept.alias("kept"), "text_sha256"))

