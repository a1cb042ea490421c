"""A training-data pipeline over ``documents``: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm import language, lines, packing, similar, tiling
from scriptoria.llm.common import fresh, load, scratch, unstage
from scriptoria.llm.queries import SEQUENCE_TOKENS, tokenizer_path

#: No SQL for run(): language models, fingerprints, tiles and packing have none. The tests hold it against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents without a language: null texts, those without letters and those far from every labelled language.

    Columns are kept, also those named like the results of the language models. An empty table stays empty.
    """
    with scratch(spark):
        models = language.train(docs)
    return language.keep_identified(docs, models)


def remove_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Take out later occurrences of three equal lines in a row; ``n_chars``, where there is one, follows the text.

    Null texts stay null, and texts of which all lines go become empty. Columns are kept, whatever their names. An empty table stays empty.
    """
    removed = fresh("n_removed", docs)
    cleaned = lines.remove_repeated_lines(docs)
    if "n_chars" in docs.columns:
        length = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
        cleaned = cleaned.withColumn("n_chars", length)
    return cleaned.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five-word shingles, similarity 0.8): the smallest doc_id.

    A null id comes first; null texts and texts without words are one group; of rows of one id and text one stays. Columns are
    kept, whatever their names. An empty table stays empty.
    """
    return similar.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents that hold a benchmark item, in order or not.

    Null texts hold none; null and repeated ids are told apart by their texts. Columns are kept, whatever their names. Without
    documents or items nothing is dropped.
    """
    with scratch(spark) as keep:
        found = keep(tiling.contaminated(docs, load(spark, folder, "benchmark")), "contaminated")
    return tiling.remove_contaminated(docs, found)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens: a row for each piece.

    A null text is packed as an empty one, its end id alone; null and repeated ids keep a row for each piece. Other columns are not
    read. An empty table gives no rows.
    """
    with scratch(spark) as keep:
        pieces = packing.cut(docs, tokenizer_path(), 0, SEQUENCE_TOKENS)
        return keep(packing.pack(pieces, SEQUENCE_TOKENS).withColumnRenamed("key", "doc_id"), "packed")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages in turn; what each returns is written to the checkpoint folder and read again, and deleted when the next one has read it."""
    docs = load(spark, folder, "documents")
    for name, function in STAGES:
        with scratch(spark) as keep:
            kept = keep(function(spark, docs, folder), name)
        unstage(docs)
        docs = kept
    return docs
