"""Search over stored vectors: filters, top-k, similar pairs, duplicates and embeddings."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..session import small, stage
from . import vector_join as vj


def pooled(token_rows: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """Mean of the token vectors whose mask is set, per key; the denominator is at least 1e-9."""
    entries = token_rows.select(key, F.col(mask).cast("double").alias("m"), F.posexplode(vector).alias("dim", "x"))
    sums = entries.groupBy(key, "dim").agg(
        (F.sum(F.col("x") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-9))).alias("x")
    )
    ordered = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return sums.groupBy(key).agg(F.transform(ordered, lambda e: e["x"]).alias("vector"))


def pair_similarity(pairs: DataFrame, left: str, right: str, threshold: float = 0.80) -> DataFrame:
    """Cosine of two vector columns with a duplicate flag."""
    return pairs.withColumn("score", vx.cosine(F.col(left), F.col(right))).withColumn(
        "is_duplicate", F.col("score") >= threshold
    )


def metadata_filter(conditions: dict) -> Column:
    """Predicate of a filter: scalar equality, list membership, ``{"not": value}``; a missing key fails."""
    out = F.lit(True)
    for name, wanted in conditions.items():
        c = F.col(name)
        if isinstance(wanted, dict):
            test = c != wanted["not"]
        elif isinstance(wanted, (list, tuple, set)):
            test = c.isin(list(wanted))
        else:
            test = c == wanted
        out = out & F.coalesce(test, F.lit(False))
    return out


def by_metadata(store: DataFrame, conditions: dict) -> DataFrame:
    return store.filter(metadata_filter(conditions))


def search(
    store: DataFrame, key: str, vector: str, query: list[float], k: int = 10, threshold: float = 0.0,
    conditions: dict | None = None,
) -> DataFrame:
    """The k most similar rows to one query vector; the filter runs before the ranking."""
    rows = by_metadata(store, conditions) if conditions else store
    scored = rows.withColumn("score", vx.cosine(F.col(vector), F.lit([float(x) for x in query]))).filter(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), key).limit(k)


def batch_search(store: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, threshold: float = 0.0) -> DataFrame:
    """The k most similar store rows of every query row: (query, neighbour, score, rank)."""
    return vj.nearest(vj.unit_rows(store, key, vector), vj.unit_rows(queries, key, vector), k, threshold)


def similar_pairs(store: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """(a, b, copies_a, copies_b, score) for distinct vectors with cosine >= threshold.

    Equal vectors are one entry with a count; a vector stored more than once is paired with itself.
    """
    groups, _ = vj.distinct_vectors(store, key, vector)
    pairs = vj.pairs_above(vj.unit_rows(groups, "rep", "vector"), threshold)
    repeated = groups.filter("copies > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("score"))
    return (
        pairs.unionByName(repeated)
        .join(small(groups.select(F.col("rep").alias("a"), F.col("copies").alias("copies_a"))), "a")
        .join(small(groups.select(F.col("rep").alias("b"), F.col("copies").alias("copies_b"))), "b")
    )


def similarity_matrix(store: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """Sparse symmetric similarity matrix of the stored vectors: entries >= threshold and the diagonal.

    The dense matrix grows with the square of the table, so only entries that can be used are kept. Equal vectors are compared
    once; every two keys that hold them have an entry.
    """
    groups, members = vj.distinct_vectors(store.filter(F.col(vector).isNotNull()), key, vector)
    units = vj.unit_rows(groups, "rep", "vector")
    expanded = vj.for_every_key(groups, members)
    upper = expanded(vj.pairs_above(units, threshold))
    # One pass over the upper triangle gives both halves.
    both = upper.select(
        F.inline(F.array(F.struct(F.col("i"), F.col("j"), "score"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "score")))
    )
    equal = groups.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("score"))
    return both.unionByName(expanded(equal))


def statistics(store: DataFrame, vector: str, by: str) -> DataFrame:
    """Vector count and dimension per value of a metadata column."""
    return store.groupBy(by).agg(F.count("*").alias("vectors"), F.max(F.size(vector)).cast("long").alias("dimension"))


def duplicate_vectors(
    store: DataFrame, key: str, vector: str, threshold: float = 0.85, exclude_same: str | None = None
) -> DataFrame:
    """(a, b, copies_a, copies_b, score) of every pair of distinct vectors, a < b, and of a vector held more than once with itself.

    ``exclude_same`` leaves out pairs that agree in a metadata column; equal vectors then count as distinct where that differs,
    and null differs from everything.
    """
    meta = F.col(exclude_same) if exclude_same else F.lit(1)
    v = store.select(F.col(key).alias("key"), F.col(vector).alias("vector"), meta.alias("meta"))
    groups = stage(v.groupBy("vector", "meta").agg(F.min("key").alias("rep"), F.count("*").alias("copies")), "vector_groups")
    side = lambda n: small(groups.select(F.col("rep").alias(n), F.col("meta").alias(f"meta_{n}"), F.col("copies").alias(f"copies_{n}")))
    met = vj.pairs_above(vj.unit_rows(groups, "rep", "vector"), threshold).join(side("a"), "a").join(side("b"), "b")
    own = groups.filter("copies > 1").select(
        F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("score"), F.col("meta").alias("meta_a"), F.col("copies").alias("copies_a"),
        F.col("meta").alias("meta_b"), F.col("copies").alias("copies_b"),
    )
    pairs = met.unionByName(own)
    if exclude_same is not None:
        pairs = pairs.filter(F.coalesce(F.col("meta_a") != F.col("meta_b"), F.lit(True)))
    return pairs.select("a", "b", "copies_a", "copies_b", "score")


# -- embeddings of texts --------------------------------------------------------------------

def fit_embedding(docs: DataFrame, text: str = "text", dimension: int = 1024) -> PipelineModel:
    """Hashed TF-IDF embedding of length one, fitted on a corpus."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="__tokens", pattern=r"[\p{L}\p{N}_]+", gaps=False, minTokenLength=2),
            HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=dimension),
            IDF(inputCol="__tf", outputCol="__tfidf"),
            Normalizer(inputCol="__tfidf", outputCol="__unit"),
        ]
    ).fit(docs)


def embed(model: PipelineModel, docs: DataFrame) -> DataFrame:
    """Add ``embedding`` (array of double); one pass, no shuffle."""
    scored = model.transform(docs).withColumn("embedding", vector_to_array("__unit"))
    return scored.drop("__tokens", "__tf", "__tfidf", "__unit")


def search_text(
    model: PipelineModel, docs: DataFrame, key: str, query: DataFrame, owner: str, text: str = "text",
    k: int = 10, threshold: float = 0.7, exclude_owner: str | None = None,
) -> DataFrame:
    """Documents most similar to one query text, optionally leaving out an owner's own."""
    vector = embed(model, query.select(text)).select("embedding").head().embedding
    conditions = {owner: {"not": exclude_owner}} if exclude_owner is not None else None
    return search(embed(model, docs), key, "embedding", vector, k, threshold, conditions)
