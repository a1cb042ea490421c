"""Tables that are updated in place, and indexes that are read in part."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptoria.operators import metrics as mt
from scriptoria.operators import ml
from scriptoria.operators import submissions as sb
from scriptoria.sources import keyed_table as kt


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_an_update_writes_only_buckets_of_changed_keys(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(2000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.array(F.lit(1.0)).alias("x"))
    kt.create(rows, path, ["k"], 32)
    before = files(path)
    changes = spark.createDataFrame([(5, "new", [2.0]), (77, "new", None), (5000, "added", [3.0]), (9, "old", [1.0])], "k long, v string, x array<double>")
    put = lambda old, new: kt.upsert(old, new, ["k"])
    written = kt.update(spark, path, changes, ["k"], put, 32)
    assert 1 <= len(written) <= 3
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in written}
    assert kept and kept <= files(path)
    got = {r.k: (r.v, r.x) for r in kt.read(spark, path).collect()}
    assert len(got) == 2001 and got[5] == ("new", [2.0]) and got[77] == ("new", None) and got[5000] == ("added", [3.0]) and got[6] == ("old", [1.0])

    after = files(path)
    assert kt.update(spark, path, changes, ["k"], put, 32) == [] and files(path) == after
    assert kt.update(spark, path, changes.limit(0), ["k"], put, 32) == []

    gone = kt.read(spark, path).select("k").filter("k <> 6")
    kt.update(spark, path, gone, ["k"], lambda old, new: old.join(new, "k", "left_anti"), 32)
    assert [r.k for r in kt.read(spark, path).collect()] == [6]


def test_substring_index_reads_few_texts(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = ["rivers", "silver", "essay", "plains", "crossing", "mountain", "théâtre", "Übung", "a\nb", "𝔘𝔫𝔦"]
    rows = [(i, " ".join(rng.choice(words, 6)), None if i % 10 else "Special needle here") for i in range(300)] + [(300, None, None), (301, "", "x")]
    docs = spark.createDataFrame(rows, "id long, content string, title string")
    path = str(tmp_path / "index")
    sb.build_substring_index(docs, path, "id", ["title", "content"])
    for needle in ("NEEDLE", "silver riv", "théâ", "b a", "𝔘𝔫𝔦", "absent words", "es", "", "al need"):
        want = {r.id for r in sb.search(docs, needle).collect()}
        assert {r.id for r in sb.indexed_search(docs, path, "id", needle).collect()} == want, needle
    assert sb.index_candidates(spark, path, "needle").count() == 30
    assert sb.index_candidates(spark, path, "es") is None


@pytest.mark.parametrize("descending", [True, False])
def test_a_page_reads_one_range(spark, tmp_path, descending):
    rows = spark.range(5000).select((F.col("id") % 100).alias("day"), "id", F.concat(F.lit("s"), F.col("id")).alias("name"))
    path, order = str(tmp_path / "pages"), ["day", "id"]
    sb.build_pages(rows, path, order, descending, ranges=20)
    whole = rows.orderBy(*[F.desc(c) if descending else F.asc(c) for c in order]).collect()
    for number, size in ((1, 20), (2, 25), (200, 25), (17, 300), (201, 25)):
        got = sorted(sb.ranged_page(spark, path, order, number, size, descending).collect(), key=lambda r: (r.day, r.id), reverse=descending)
        assert [r.id for r in got] == [r.id for r in whole[(number - 1) * size : number * size]]
    assert len(sb.ranges_of_page(spark, path, 150, 25)) <= 2 and sb.ranges_of_page(spark, path, 10_000, 25) == []


def test_sketches_of_hours_make_those_of_days(spark):
    rows = spark.range(48_000).select(F.timestamp_seconds(F.col("id") * 3.6).alias("ts"), ((F.col("id") * 7919) % 48_000 / 100.0).alias("s"))
    hourly = mt.quantile_sketches(rows, [], "ts", "s")
    assert hourly.count() == 48
    day = mt.merged_quantiles(hourly, [F.to_date("start").alias("day")], {"p10": 0.1, "p50": 0.5, "p95": 0.95}).orderBy("day").collect()
    assert [r.n for r in day] == [24_000, 24_000]
    exact = {r.day: r.e for r in rows.groupBy(F.to_date("ts").alias("day")).agg(F.percentile("s", F.array(*map(F.lit, (0.1, 0.5, 0.95)))).alias("e")).collect()}
    for r in day:
        assert all(abs(a - b) <= 0.02 * 480 for a, b in zip((r.p10, r.p50, r.p95), exact[r.day]))


def test_pair_network_beats_differences_on_planted_authors(spark):
    """An author is the sign of a product of two components, which differences alone hardly show."""
    rng = np.random.default_rng(3)
    rows, pairs = [], []
    for i in range(600):
        rows.append((i, [float(x) for x in rng.choice([-1.0, 1.0], 6) * rng.uniform(0.5, 1.5, 6)]))
    for _ in range(1500):
        a, b = (int(x) for x in rng.choice(600, 2, replace=False))
        pairs.append((a, b, int(rows[a][1][0] * rows[b][1][0] * rows[a][1][1] * rows[b][1][1] > 0)))
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    told = spark.createDataFrame(pairs, "a long, b long, label int")
    train, test = told.filter("(a + b) % 3 <> 0"), told.filter("(a + b) % 3 = 0")
    plain = lambda p: ml.pair_features(p, vectors, "id", "v")
    both = lambda p: ml.pair_interactions(p, vectors, "id", "v")
    by_differences = ml.area_under_curve(ml.fit_pair_classifier(plain(train)).transform(plain(test)))
    by_network = ml.area_under_curve(ml.fit_pair_network(both(train), hidden=16).transform(both(test)))
    assert by_network > 0.85 and by_network > by_differences + 0.1
