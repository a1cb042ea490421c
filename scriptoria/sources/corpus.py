"""Document sources: submissions, uploaded text files and labelled CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

MAX_FILE_BYTES = 10 * 1024 * 1024
MIN_WORDS, MAX_WORDS = 50, 10_000


def submissions(
    documents: DataFrame, id_col: str = "doc_id", owner_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """One row per essay: id, owner, title, whole content, word count and content hash."""
    content = F.col(text_col)
    return documents.select(
        F.col(id_col).alias("submission_id"),
        F.col(owner_col).alias("owner"),
        F.concat(F.col(owner_col), F.lit(" essay "), F.col(id_col).cast("string")).alias("title"),
        content.alias("content"),
        F.size(tx.raw_words(content)).cast("long").alias("word_count"),
        tx.fingerprint(content).alias("file_hash"),
    )


def decode_text(content: Column) -> Column:
    """UTF-8 where the bytes are valid UTF-8, Latin-1 otherwise."""
    as_text = content.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(content, "ISO-8859-1"))


def judged_text_files(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, text, word_count, reason) of every file, decoded and trimmed; ``reason`` is null for accepted ones.

    ``files`` has the columns of Spark's ``binaryFile`` source (path, length, content). Files of another suffix or above the
    size are not decoded: their text is null.
    """
    wrong = F.when(~F.lower("path").endswith(".txt"), "suffix").when(F.col("length") > max_bytes, "size")
    text = F.when(wrong.isNull(), F.regexp_replace(decode_text(F.col("content")), f"^[{tx.WS}]+|[{tx.WS}]+$", ""))
    rows = files.select("path", text.alias("text"), wrong.alias("wrong"))
    rows = rows.withColumn("word_count", F.when(F.col("text").isNotNull(), F.size(tx.raw_words(F.col("text"))).cast("long")))
    n = F.col("word_count")
    reason = F.when(n < MIN_WORDS, "too few words").when(n > MAX_WORDS, "too many words").when(n.isNull(), "no content")
    return rows.select("path", "text", "word_count", F.coalesce("wrong", reason).alias("reason"))


def accept_text_files(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Accepted files of `judged_text_files`; the suffix and size conditions stand before the decoding."""
    fit = files.filter(F.lower("path").endswith(".txt") & (F.col("length") <= max_bytes))
    return judged_text_files(fit, max_bytes).filter("reason IS NULL").drop("reason")


def ingest_text(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Text files under ``path``; size and suffix filters reach the file listing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][xX][tT]").load(path)
    return accept_text_files(files, max_bytes)


def load_training_csv(
    spark: SparkSession, path: str, text_col: str = "text", author_col: str = "author", label_col: str | None = None
) -> DataFrame:
    """Labelled or per-author texts from CSV with a header (see `training_rows`)."""
    rows = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    )
    return training_rows(rows, text_col, author_col, label_col)


def training_rows(
    rows: DataFrame, text_col: str = "text", author_col: str = "author", label_col: str | None = None
) -> DataFrame:
    """(kind, author, text): kind is human/ai by label, or ``author`` when there is no label.

    The rows stay in long form: texts are never collected into one list per author.
    """
    text = F.col(text_col).alias("text")
    if label_col is None:
        return rows.select(F.lit("author").alias("kind"), F.col(author_col).alias("author"), text)
    label = F.col(label_col).try_cast("int")
    kind = F.when(label == 0, "human").when(label == 1, "ai")
    author = F.col(author_col) if author_col in rows.columns else F.lit(None).cast("string")
    return rows.select(kind.alias("kind"), author.alias("author"), text).filter(F.col("kind").isNotNull())
