"""Grams counted by 64-bit hashes, and sorted without a comparison function."""

from pyspark.sql import functions as F

from scriptoria.functions import arrays as ar
from scriptoria.operators import ailike as ai
from scriptoria.operators import bigrams as bg
from scriptoria.operators import lexical as lx

TEXTS = ["a b a b a", "a b c", "a", "", "x y z x y z x y z", None]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gram_hashes_are_as_distinct_as_the_grams(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    words = ai.prepare(docs).withColumn("h", F.transform("rw", lambda w: F.xxhash64(w)))
    for n in (2, 3):
        grams, hashes = ar.ngrams(F.col("rw"), n), ar.ngram_hashes(F.col("h"), n)
        rows = words.select(F.size(grams).alias("n"), F.size(F.array_distinct(grams)).alias("d"), F.size(hashes).alias("hn"), F.size(F.array_distinct(hashes)).alias("hd")).collect()
        assert all((r.n, r.d) == (r.hn, r.hd) for r in rows) and any(r.d < r.n for r in rows)


def test_features_make_no_strings_of_grams(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    repeated = ai.with_repetition(ai.prepare(docs))
    assert "concat_ws" not in plan(repeated)
    rows = {r.doc_id: r for r in repeated.collect()}
    assert abs(rows[0].bigram_repetition - 0.5) < 1e-12 and abs(rows[0].trigram_repetition - 1 / 3) < 1e-12
    assert abs(rows[4].bigram_repetition - 5 / 8) < 1e-12 and rows[1].bigram_repetition == rows[2].bigram_repetition == 0.0


def test_grams_and_pairs_are_sorted_by_their_value(spark):
    """A comparison function is called for every two elements; hashes have an order of their own."""
    docs = spark.createDataFrame([r for r in enumerate(TEXTS) if r[1] is not None], "doc_id long, text string")
    texts = docs.select(F.col("doc_id").alias("rep"), lx.content_tokens(F.col("text"), []).alias("tokens"))
    for rows in (bg.pair_rows(docs, "doc_id", "text"), bg.word_rows(docs, "doc_id", "text"), lx.gram_vectors(texts.filter("false")), lx._grams(texts)):
        assert "array_sort" not in plan(rows)
    got = {(r.doc_id, r.n) for r in bg.pair_rows(docs, "doc_id", "text").collect()}
    assert got == {(0, 2), (1, 1), (4, 3), (4, 2)}
