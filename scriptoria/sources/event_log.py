"""JSON-lines event log: append, read, and parse in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("eventType", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("blockNumber", T.LongType()),
        T.StructField("transactionHash", T.StringType()),
        T.StructField("tokenId", T.LongType()),
        T.StructField("owner", T.StringType()),
        T.StructField("contentHash", T.StringType()),
        T.StructField("authorshipScore", T.DoubleType()),
        T.StructField("aiProbability", T.DoubleType()),
    ]
)


def append_events(events: DataFrame, path: str) -> None:
    """Append one JSON object per line; files are added, never rewritten."""
    events.write.mode("append").json(path)


def read_events(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """The log with an explicit schema, so that no pass over the data infers one."""
    return spark.read.schema(schema).json(path)


def stream_events(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def parse_lines(lines: DataFrame, schema: T.StructType = EVENT_SCHEMA, column: str = "value") -> DataFrame:
    """Rows of a text column holding JSON objects; unreadable lines are left out."""
    parsed = lines.select(F.from_json(column, schema).alias("event"))
    return parsed.filter(F.col("event.eventType").isNotNull()).select("event.*")


def unreadable_lines(lines: DataFrame, schema: T.StructType = EVENT_SCHEMA, column: str = "value") -> DataFrame:
    """The rows that `parse_lines` leaves out, as they came; null lines are among them."""
    return lines.filter(F.from_json(column, schema)["eventType"].isNull())
