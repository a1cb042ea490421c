"""Training pairs, splits, classifiers and their evaluation with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import (
    LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier,
    RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ordered


# -- pairs ------------------------------------------------------------------------------------

def ring(authors: DataFrame, author: str) -> DataFrame:
    """(author, next_author): authors in the order of the MD5 of their name, the last followed by the first.

    Authors are numbered inside 256 hash buckets in parallel; bucket sizes, 256 rows, give the offsets.
    """
    rows = authors.select(author).distinct().withColumn("__h", F.md5(F.col(author).cast("string")))
    rows = rows.withColumn("__b", F.left("__h", F.lit(2)))
    sizes = rows.groupBy("__b").agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("__off", F.sum("n").over(W.orderBy("__b")) - F.col("n")).drop("n")
    number = F.row_number().over(W.partitionBy("__b").orderBy("__h")) - 1
    numbered = rows.withColumn("__k", number).join(offsets, "__b").select(author, (F.col("__k") + F.col("__off")).alias("__i"))
    total = rows.agg(F.count("*")).scalar()
    following = numbered.select(F.col(author).alias("next_author"), F.pmod(F.col("__i") - 1 + total, total).alias("__i"))
    return numbered.join(following, "__i").select(author, "next_author")


def author_pairs(rows: DataFrame, key: str, author: str, anchors: int = 2) -> DataFrame:
    """(a, b, label): training pairs, 1 for the same author.

    Positive pairs join every text to its author's first texts, the anchors; negative pairs join
    an author's anchors to those of the next author in `ring`. All pairs of an author's texts
    and of all authors would grow with the square of both; these grow with the texts.
    """
    first = ordered.newest(rows.select(key, author), [author], [F.asc(key)], anchors)
    left = first.select(author, F.col(key).alias("a"))
    positive = left.join(rows.select(author, F.col(key).alias("b")), author).filter("a < b").select("a", "b", F.lit(1).alias("label"))
    other = first.select(F.col(author).alias("next_author"), F.col(key).alias("b"))
    negative = (
        ring(rows, author).filter(F.col(author) != F.col("next_author")).join(left, author).join(other, "next_author")
        .select("a", "b", F.lit(0).alias("label"))
    )
    return positive.unionByName(negative)


def pair_features(pairs: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Add ``features``: the absolute difference of the two vectors."""
    side = lambda n: vectors.select(F.col(key).alias(n), F.col(vector).cast("array<double>").alias(f"v{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.withColumn("features", array_to_vector(F.zip_with("va", "vb", lambda x, y: F.abs(x - y)))).drop("va", "vb")


def fit_pair_classifier(features: DataFrame, iterations: int = 50) -> LogisticRegressionModel:
    """Probability that two vectors belong to one author."""
    weighted = with_class_weight(features, "label")
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=iterations, regParam=0.01).fit(weighted)


def pair_interactions(pairs: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Add ``features``: differences and products of the two vectors' components, the same whichever comes first."""
    side = lambda n: vectors.select(F.col(key).alias(n), F.col(vector).cast("array<double>").alias(f"v{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    apart, together = F.zip_with("va", "vb", lambda x, y: F.abs(x - y)), F.zip_with("va", "vb", lambda x, y: x * y)
    return both.withColumn("features", array_to_vector(F.concat(apart, together))).drop("va", "vb")


def fit_pair_network(features: DataFrame, hidden: int = 32, iterations: int = 100, seed: int = 42) -> MultilayerPerceptronClassificationModel:
    """A network with one hidden layer, shared by all of a pair's components, on `pair_interactions`.

    It takes no weights, so the smaller class is repeated by whole copies to about the size of the larger.
    """
    counts = {r.label: r["count"] for r in features.groupBy("label").count().collect()}
    most = max(counts.values())
    times = F.coalesce(F.create_map(*(F.lit(v) for label, n in counts.items() for v in (label, round(most / n))))[F.col("label")], F.lit(1))
    balanced = features.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("copy")
    size = len(features.select("features").first().features)
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=[size, hidden, 2], maxIter=iterations, seed=seed).fit(balanced)


def area_under_curve(scored: DataFrame, label: str = "label") -> float:
    """Area under the receiver's curve of rows with ``rawPrediction``."""
    return BinaryClassificationEvaluator(labelCol=label).evaluate(scored)


def positive_probability(scored: DataFrame) -> Column:
    return F.get(vector_to_array(scored["probability"]), F.lit(1))


# -- training sets ------------------------------------------------------------------------------

def labelled_set(human: DataFrame, machine: DataFrame, text: str) -> DataFrame:
    """(text, label): 0 for human, 1 for machine texts, with the other shared columns."""
    return human.withColumn("label", F.lit(0)).unionByName(machine.withColumn("label", F.lit(1)), allowMissingColumns=True)


def authorship_set(texts: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Texts by author with their embedding."""
    return texts.join(vectors, key)


def split(rows: DataFrame, key: str, label: str, train: float = 0.8, seed: int = 42, buckets: int = 4096) -> DataFrame:
    """Add ``is_train``: in every class the rounded share of rows with the smallest hashes of the key, ties to the smaller key.

    A row's rank in its class is the count of the hash buckets before its own, from counts per class and
    bucket, and its rank within the bucket, so no class is sorted in one task. ``buckets`` only sets the size of
    what a task sorts. Null labels are a class. Keys have to be unique for a split that can be repeated.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    bucket = F.floor(F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long") * buckets / 2**32)
    rows = rows.withColumn("__digest", digest).withColumn("__bucket", bucket)
    counts = rows.groupBy(F.col(label).alias("__label"), F.col("__bucket").alias("__at")).agg(F.count("*").alias("__n"))
    by_class = W.partitionBy("__label")
    before = F.sum("__n").over(by_class.orderBy("__at").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__n")
    counts = counts.withColumn("__before", before).withColumn("__most", F.round(train * F.sum("__n").over(by_class)))
    ranked = rows.withColumn("__rank", F.row_number().over(W.partitionBy(label, "__bucket").orderBy("__digest", key)))
    joined = ranked.join(counts, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__bucket") == F.col("__at")))
    return joined.withColumn("is_train", F.col("__before") + F.col("__rank") <= F.col("__most")).select(*ranked.drop("__digest", "__bucket", "__rank").columns, "is_train")


def with_class_weight(rows: DataFrame, label: str) -> DataFrame:
    """Add ``weight``: rows / (classes * rows of the class); the class counts are a handful of rows."""
    counts = rows.groupBy(label).agg(F.count("*").alias("__n"))
    total, classes = rows.agg(F.count("*")).scalar(), counts.agg(F.count("*")).scalar()
    return rows.join(counts, label).withColumn("weight", total / (classes * F.col("__n"))).drop("__n")


# -- soft vote ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class SoftVote:
    """A forest on style features and a regression on embeddings."""

    forest: RandomForestClassificationModel
    regression: LogisticRegressionModel
    names: list[str]


def _assembled(rows: DataFrame, names: list[str], vector: str) -> DataFrame:
    assembler = VectorAssembler(inputCols=names, outputCol="style", handleInvalid="keep")
    return assembler.transform(rows).withColumn("vec", array_to_vector(F.col(vector).cast("array<double>")))


def fit_soft_vote(rows: DataFrame, names: list[str], vector: str, label: str = "label", trees: int = 100, depth: int = 5, seed: int = 42) -> SoftVote:
    """Train both models with balanced class weights."""
    data = with_class_weight(_assembled(rows, names, vector), label)
    forest = RandomForestClassifier(featuresCol="style", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed).fit(data)
    regression = LogisticRegression(featuresCol="vec", labelCol=label, weightCol="weight", maxIter=100, regParam=0.01).fit(data)
    return SoftVote(forest, regression, names)


def predict_soft_vote(model: SoftVote, rows: DataFrame, vector: str) -> DataFrame:
    """Add ``p`` (mean probability of class 1), ``confidence`` and ``prediction``."""
    df = _assembled(rows, model.names, vector)
    df = model.forest.setProbabilityCol("p_forest").setRawPredictionCol("r_forest").setPredictionCol("y_forest").transform(df)
    df = model.regression.setProbabilityCol("p_reg").setRawPredictionCol("r_reg").setPredictionCol("y_reg").transform(df)
    one = lambda c: F.get(vector_to_array(c), F.lit(1))
    df = df.withColumn("p", (one("p_forest") + one("p_reg")) / 2).withColumn("confidence", F.abs(2 * F.col("p") - 1))
    return df.withColumn("prediction", (F.col("p") > 0.5).cast("int")).drop(
        "style", "vec", "p_forest", "r_forest", "y_forest", "p_reg", "r_reg", "y_reg"
    )


def feature_importance(model: SoftVote, rows: DataFrame) -> DataFrame:
    """(feature, importance) of the forest, one row per feature name."""
    pairs = list(zip(model.names, (float(v) for v in model.forest.featureImportances.toArray())))
    return rows.sparkSession.createDataFrame(pairs, "feature string, importance double")


# -- evaluation -------------------------------------------------------------------------------------

def accuracy(rows: DataFrame, prediction: Column, label: Column) -> DataFrame:
    """One row: accuracy, correct and total."""
    return rows.agg(
        F.avg((prediction == label).cast("int")).alias("accuracy"), F.count_if(prediction == label).alias("correct"), F.count("*").alias("total")
    )


def run_metrics(runs: DataFrame, success: Column, seconds: str, by: list[str]) -> DataFrame:
    """Runs, successes, failures and mean processing time."""
    return runs.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(success).alias("succeeded"), F.count_if(~success).alias("failed"), F.avg(seconds).alias("mean_seconds")
    )
