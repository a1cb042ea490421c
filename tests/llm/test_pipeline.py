"""The pipeline's stages in turn on a small table with planted cases."""

import os

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import prose


def test_stages(spark, tmp_path):
    source = "/root/testdata/sf0.01"
    leak = spark.read.parquet(f"{source}/benchmark.parquet").orderBy("item_id").first().text
    table = spark.read.parquet(f"{source}/documents.parquet").filter("doc_id < 300")
    clean = "\n".join(prose(i, 30) for i in range(4))
    rows = [(9001, clean, "en"), (9002, clean.replace(" ", "  "), "en"), (9003, "Some words. " + leak, "en"), (9004, "1234 5678", "en"), (9005, None, "en"), (None, prose(70, 60), None)]
    extra = spark.createDataFrame([(i, t, x, "s", 5) for i, t, x in rows], table.schema)
    docs = table.unionByName(extra)
    languages, lines, near, clean_docs, packed = (f for _, f in corpus_pipeline.STAGES)
    one = languages(spark, docs, source)
    assert one.columns == docs.columns and not {9004, 9005} & {r.doc_id for r in one.collect()}
    two = lines(spark, one, source)
    assert two.columns == docs.columns and two.count() == one.count()
    assert two.filter("text IS NOT NULL").filter(F.length("text") > F.lit(10**9)).count() == 0
    three = near(spark, two, source)
    ids = {r.doc_id for r in three.collect()}
    assert three.columns == docs.columns and 9001 in ids and 9002 not in ids and None in ids
    four = clean_docs(spark, three, source)
    assert 9003 in ids and 9003 not in {r.doc_id for r in four.collect()} and 9001 in {r.doc_id for r in four.collect()}
    five = packed(spark, four, source)
    assert five.select("doc_id").distinct().count() == four.select("doc_id").distinct().count()
    assert five.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    folder = tmp_path / "tables"
    folder.mkdir()
    docs.write.parquet(str(folder / "documents.parquet"))
    os.symlink(f"{source}/benchmark.parquet", folder / "benchmark.parquet")
    again = corpus_pipeline.run(spark, str(folder))
    key = lambda df: sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(again) == key(five)
