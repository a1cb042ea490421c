"""Group H on the driver's tables: training pairs, classifiers and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ordered
from ..operators import ailike as ai
from ..operators import authorship as au
from ..operators import ml
from ..operators import stylometry as st
from ..session import spread
from ..sources.tables import table
from . import ailike_queries as aq
from . import sqltext as q
from .registry import query
from .similarity_queries import COS


def embeddings(spark, d):
    return table(spark, d, "embeddings")


PAIRS = """anchor AS (SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) WHERE k <= 2),
authors AS (SELECT label, row_number() OVER (ORDER BY md5(label::VARCHAR)) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT label FROM embeddings)),
nxt AS (SELECT x.label AS author, y.label AS next_author FROM authors x JOIN authors y ON y.i = (x.i + 1) % x.n WHERE x.label <> y.label),
pairs AS (SELECT x.vec_id AS a, y.vec_id AS b, 1 AS label FROM anchor x JOIN embeddings y USING (label) WHERE x.vec_id < y.vec_id
  UNION ALL SELECT x.vec_id, y.vec_id, 0 FROM nxt JOIN anchor x ON x.label = author JOIN anchor y ON y.label = next_author)"""


@query("H1_author_pairs", f"WITH {PAIRS} SELECT a, b, label::BIGINT AS label FROM pairs")
def author_pairs(spark, d):
    return ml.author_pairs(embeddings(spark, d), "vec_id", "label").withColumn("label", F.col("label").cast("long"))


@query("H2_pair_classifier")
def pair_classifier(spark, d):
    e = embeddings(spark, d)
    features = ml.pair_features(ml.author_pairs(e, "vec_id", "label"), e, "vec_id", "embedding")
    scored = ml.fit_pair_classifier(features).transform(features)
    return scored.select("a", "b", "label", F.round(ml.positive_probability(scored), 6).alias("p"))


@query("H2_pair_network", f"""
WITH {PAIRS} SELECT label::BIGINT AS label, count(*) AS n, true AS probabilities, count(*) AS predicted FROM pairs GROUP BY 1""")
def pair_network(spark, d):
    """The pairs by label, whether all have a probability, and how many were scored."""
    e = embeddings(spark, d)
    features = ml.pair_interactions(ml.author_pairs(e, "vec_id", "label"), e, "vec_id", "embedding")
    scored = ml.fit_pair_network(features, iterations=30).transform(features)
    p = ml.positive_probability(scored)
    return scored.groupBy(F.col("label").cast("long").alias("label")).agg(
        F.count("*").alias("n"), F.min(p.between(0, 1)).alias("probabilities"), F.count("prediction").alias("predicted"))


@query("H3_training_set", """
SELECT doc_id, text, 0::BIGINT AS label FROM documents JOIN labels USING (doc_id) WHERE quality = 1
UNION ALL SELECT doc_id, text, 1 FROM documents JOIN labels USING (doc_id) WHERE quality = 0""")
def training_set(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id")
    out = ml.labelled_set(rows.filter("quality = 1"), rows.filter("quality = 0"), "text")
    return out.select("doc_id", "text", F.col("label").cast("long").alias("label"))


@query("H3_authorship_set", "SELECT doc_id, source, label FROM documents JOIN embeddings ON vec_id = doc_id")
def authorship_set(spark, d):
    vectors = embeddings(spark, d).withColumnRenamed("vec_id", "doc_id")
    return ml.authorship_set(table(spark, d, "documents").select("doc_id", "source"), vectors, "doc_id").select("doc_id", "source", "label")


@query("H4_stratified_split", """
SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) <= round(0.8 * count(*) OVER (PARTITION BY quality)) AS is_train
FROM labels""")
def stratified_split(spark, d):
    return ml.split(table(spark, d, "labels"), "doc_id", "quality").select("doc_id", "quality", "is_train")


def labelled_features(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).join(table(spark, d, "labels"), "doc_id")
    vectors = embeddings(spark, d).select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = st.extract_features(docs).join(vectors, "doc_id").withColumn("label", 1 - F.col("quality"))
    return ml.split(rows, "doc_id", "label")


def trained(spark, d):
    from ..session import stage
    rows = stage(labelled_features(spark, d), "labelled")
    return rows, ml.fit_soft_vote(rows.filter("is_train"), st.FEATURES, "embedding")


@query("H5_soft_vote")
def soft_vote(spark, d):
    rows, model = trained(spark, d)
    out = ml.predict_soft_vote(model, rows, "embedding")
    return out.select("doc_id", "label", "is_train", F.round("p", 6).alias("p"), F.round("confidence", 6).alias("confidence"), "prediction")


@query("H5_soft_vote_shares", """
SELECT 1 - quality AS label, count(*) AS total, round(0.8 * count(*))::BIGINT AS trained, true AS bounded, true AS consistent FROM labels JOIN documents USING (doc_id)
JOIN embeddings ON vec_id = doc_id GROUP BY 1""")
def soft_vote_shares(spark, d):
    """Rows and training rows by class; probabilities within 0 and 1, predictions and confidence that follow from them."""
    out = ml.predict_soft_vote(*reversed(trained(spark, d)), "embedding")
    follows = (F.col("prediction") == (F.col("p") > 0.5).cast("int")) & (F.abs(F.col("confidence") - F.abs(2 * F.col("p") - 1)) < 1e-9)
    return out.groupBy(F.col("label").cast("long").alias("label")).agg(
        F.count("*").alias("total"), F.count_if("is_train").alias("trained"), F.min(F.col("p").between(0, 1)).alias("bounded"), F.min(follows).alias("consistent"))


@query("H6_importance_shares", f"""
SELECT feature, true AS bounded, true AS whole FROM {q.values([(n,) for n in st.FEATURES], 'feature')}""")
def importance_shares(spark, d):
    """Every feature once, with a share between 0 and 1, and the shares add up to 1."""
    rows, model = trained(spark, d)
    shares = ml.feature_importance(model, rows)
    total = shares.agg(F.abs(F.sum("importance") - 1) < 1e-6).scalar()
    return shares.select("feature", F.col("importance").between(0, 1).alias("bounded"), total.alias("whole"))


@query("H6_feature_importance")
def feature_importance(spark, d):
    rows, model = trained(spark, d)
    return ml.feature_importance(model, rows)


@query("H7_accuracy", f"""
WITH {aq.SCORES} SELECT round(avg(CASE WHEN (ai_probability > 0.5) = (quality = 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  count(*) FILTER ((ai_probability > 0.5) = (quality = 0)) AS correct, count(*) AS total FROM ens JOIN labels USING (doc_id)""")
def accuracy(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    rows = ai.detect(docs, **aq.LEXICONS).join(table(spark, d, "labels"), "doc_id")
    out = ml.accuracy(rows, (F.col("ai_probability") > 0.5).cast("int"), 1 - F.col("quality"))
    return out.withColumn("accuracy", F.round("accuracy", 6))


AUTHORSHIP = f"""{PAIRS}, refs AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rank FROM embeddings),
claims AS (SELECT DISTINCT label AS author, label AS claimed FROM embeddings UNION ALL SELECT author, next_author FROM nxt),
sims AS (SELECT x.vec_id, c.author, c.claimed, avg({COS}) AS s FROM embeddings x JOIN claims c ON c.author = x.label
   LEFT JOIN refs y ON y.label = c.claimed AND y.rank <= 3 AND y.vec_id <> x.vec_id GROUP BY ALL),
told AS (SELECT claimed, author = claimed AS truth, coalesce(s >= 0.01, false) AS said FROM sims)"""


@query("H7_authorship_accuracy", f"""
WITH {AUTHORSHIP} SELECT claimed, round(avg((truth = said)::INT), 6) AS accuracy, count(*) FILTER (truth = said) AS correct, count(*) AS total FROM told GROUP BY claimed""")
def authorship_accuracy(spark, d):
    """Every text under its own author's name and under the next author's, by the claimed author."""
    e = embeddings(spark, d)
    own = e.select("label", F.col("label").alias("claimed")).distinct()
    others = ml.ring(e, "label").filter("label <> next_author").withColumnRenamed("next_author", "claimed")
    references = ordered.newest(e, ["label"], [F.desc("vec_id")], 3).drop("rank")
    told = au.benchmark(e, own.unionByName(others), "vec_id", "label", "embedding", references, 0.01)
    hit = F.col("prediction") == F.col("label")
    return told.groupBy("claimed").agg(
        F.round(F.avg(hit.cast("int")), 6).alias("accuracy"), F.count_if(hit).alias("correct"), F.count("*").alias("total"))


@query("H8_run_metrics", """
SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, round(avg(value), 6) AS mean_seconds FROM events GROUP BY 1""")
def run_metrics(spark, d):
    out = ml.run_metrics(table(spark, d, "events"), F.col("event_type") != "error", "value", ["user_id"])
    return out.withColumn("mean_seconds", F.round("mean_seconds", 6))
