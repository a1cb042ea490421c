"""Exact joins against brute force, with copies and hot groups."""

import math
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare
from scriptoria.functions import ordered
from scriptoria.operators import lexical as lx
from scriptoria.operators import metrics as mt
from scriptoria.operators import plagiarism as pl
from scriptoria.operators import vector_index as vi
from scriptoria.operators import vector_join as vj
from scriptoria.operators import vectors as vs


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors in tight clusters, one of them holding a third of all rows."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    which = np.where(rng.random(600) < 0.33, 0, rng.integers(1, 12, 600))
    m = centres[which] + 0.35 * rng.normal(size=(600, 16))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>")
    return m, df


@pytest.mark.parametrize("threshold", [0.3, 0.8, 0.95])
def test_pairs_above_equal_brute_force(clustered, monkeypatch, threshold):
    m, df = clustered
    monkeypatch.setattr(vj, "BLOCK_ROWS", 64)
    units = vj.unit_rows(df, "id", "v")
    got = {(r.a, r.b) for r in vj.pairs_above(units, threshold, vj.build_cells(units, 9)).collect()}
    s = m @ m.T
    assert got == {(i, j) for i in range(600) for j in range(i + 1, 600) if s[i, j] >= threshold}


def test_nearest_equals_brute_force(clustered, monkeypatch):
    m, df = clustered
    monkeypatch.setattr(vj, "BLOCK_ROWS", 64)
    got = {}
    for r in vs.batch_search(df, df, "id", "v", 5, 0.2).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r.neighbour
    s = m @ m.T
    for i in range(600):
        best = [j for j in sorted(range(600), key=lambda j: (-s[i, j], j)) if s[i, j] >= 0.2][:5]
        assert [got[i][k] for k in sorted(got[i])] == best


def test_cells_prune_far_vectors(spark):
    """Tight clusters: at a high threshold a vector visits few of the cells."""
    rng = np.random.default_rng(8)
    m = rng.normal(size=(12, 16))[rng.integers(0, 12, 600)] + 0.05 * rng.normal(size=(600, 16))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>")
    units = vj.unit_rows(df, "id", "v")
    cells = vj.build_cells(units, 12, group_rows=1)
    everywhere = vj.visits(units.withColumn("reach", F.lit(math.pi)), cells, False).count()
    near = vj.visits(units.withColumn("reach", F.lit(math.acos(0.95))), cells, False).count()
    assert near < everywhere / 3


def test_vectors_without_clusters_are_sent_once_per_block(spark, monkeypatch):
    """Nothing is pruned here; a vector goes to blocks of rows, not to each of the 40 cells, and far fewer rows are sent than compared."""
    monkeypatch.setattr(vj, "BLOCK_ROWS", 200)
    rng = np.random.default_rng(9)
    m = rng.normal(size=(1000, 32))
    units = vj.unit_rows(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>"), "id", "v")
    cells = vj.build_cells(units, 40)
    assert sum(cells.rows.values()) == 1000 and 5 <= len(cells.rows) <= 10
    sent = vj.visits(units.withColumn("reach", F.lit(math.acos(0.3))), cells, True).count()
    assert sent <= 1000 * (len(cells.rows) + 1) / 2 * 1.2 < 1000 * 999 / 2 / 50
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    got = {(r.a, r.b) for r in vj.pairs_above(units, 0.3, cells).collect()}
    assert got == {(i, j) for i in range(1000) for j in range(i + 1, 1000) if s[i, j] >= 0.3}


def test_copied_vectors_are_one_entry(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)] + [(50, [0.9, 0.1]), (51, [0.0, 1.0])], "id long, v array<double>")
    rows = {(r.a, r.b): (r.copies_a, r.copies_b) for r in vs.similar_pairs(df, "id", "v", 0.9).collect()}
    assert rows == {(0, 0): (50, 50), (0, 50): (50, 1)}


def test_matrix_has_an_entry_for_every_key_of_equal_vectors(spark, tmp_path, monkeypatch):
    """Copies, some of them beyond a row of keys, and vectors of one direction, as the query's SQL has them; none for a row without a vector."""
    monkeypatch.setattr(vj, "PART_KEYS", 4)
    rng = np.random.default_rng(12)
    m = rng.normal(size=(12, 4))
    which = [0] * 11 + [1] * 3 + list(range(2, 12)) + [0, 5]
    rows = [(1000 - 7 * i, [float(x) for x in m[w]], 1) for i, w in enumerate(which)]
    rows.append((5000, [2.0 * float(x) for x in m[3]], 1))
    folder = str(tmp_path / "embeddings.parquet")
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    table.write.parquet(folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/*.parquet'")
    assert compare(spark, con, str(tmp_path), entry.queries()["E5_similarity_matrix"], entry.oracle_sql()["E5_similarity_matrix"]) == ""
    missing = table.unionByName(spark.createDataFrame([(6000, None, 1)], table.schema))
    assert vs.similarity_matrix(missing, "vec_id", "embedding", 0.3).count() == vs.similarity_matrix(table, "vec_id", "embedding", 0.3).count()


def brute_lexical(a, b):
    def grams(text):
        t = [w for w in text.split() if len(w) > 1 and w not in lx.fixed.STOP_WORDS]
        return Counter(t + [" ".join(t[i:i + 2]) for i in range(len(t) - 1)] + [" ".join(t[i:i + 3]) for i in range(len(t) - 2)])
    x, y = grams(a), grams(b)
    w = {g: (1.0 if g in x and g in y else math.log(1.5) + 1) for g in x | y}
    dot = sum(x[g] * y[g] * w[g] ** 2 for g in x & y)
    norm = lambda c: math.sqrt(sum((n * w[g]) ** 2 for g, n in c.items()))
    return dot / (norm(x) * norm(y)) if x and y else 0.0


@pytest.fixture(scope="module")
def texts(spark):
    """Short texts over a small vocabulary, a third of them copies of one text, some edited copies."""
    rng = random.Random(3)
    vocabulary = [f"wo{i}" for i in range(60)]
    base = [" ".join(rng.choice(vocabulary[: 10 + i]) for _ in range(25)) for i in range(40)]
    rows = base + [base[0]] * 30
    for i in range(20):
        words = base[i].split()
        words[3] = "changed"
        rows.append(" ".join(words))
    return rows, spark.createDataFrame([(i, t, f"o{i % 4}") for i, t in enumerate(rows)], "doc_id long, text string, source string")


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.75])
def test_lexical_pairs_equal_brute_force(texts, monkeypatch, threshold):
    rows, df = texts
    monkeypatch.setattr(lx, "BLOCK_TEXTS", 16)
    _, distinct = lx.collapse(df, "doc_id", "text")
    got = {(r.a, r.b): r.lexical for r in lx.pairs_above(lx.gram_vectors(distinct), threshold).collect()}
    first = [i for i, t in enumerate(rows) if rows.index(t) == i]
    want = {(i, j): brute_lexical(rows[i], rows[j]) for i in first for j in first if i < j}
    want = {k: v for k, v in want.items() if v >= threshold}
    assert set(got) == set(want)
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_report_counts_every_copy(texts):
    rows, df = texts
    pairs, members = pl.detect(df, "doc_id", "text")
    report = {r.doc_id: r for r in pl.analysis_report(df, "doc_id", "source", members, pairs).collect()}
    score = {}
    for i, a in enumerate(rows):
        matches = []
        for j, b in enumerate(rows):
            if i % 4 != j % 4:
                key = (a, b) if a <= b else (b, a)
                score.setdefault(key, 1.0 if a == b else brute_lexical(a, b))
                matches.append(score[key])
        assert report[i].duplicates_found == sum(s >= 0.75 for s in matches)
        assert report[i].potential_duplicates == sum(0.5 <= s < 0.75 for s in matches)
        assert report[i].total_comparisons == len(matches)


def test_combined_case(spark):
    """A query, an identical candidate, a near one and an unrelated one."""
    rows = [(0, "alpha beta gamma delta", [1.0, 0, 0, 0]), (1, "alpha beta gamma epsilon", [1.0, 0, 0, 0]),
            (2, "other words entirely here", [0.8, 0.2, 0, 0]), (3, "nothing in common now", [0, 0, 1.0, 0])]
    df = spark.createDataFrame([(i, t, [float(x) for x in v]) for i, t, v in rows], "doc_id long, text string, v array<double>")
    t = pl.Thresholds(duplicate=0.9, potential=0.6, semantic=0.85, lexical=0.8)
    pairs, _ = pl.detect(df, "doc_id", "text", df.select("doc_id", "v"), t)
    # 0 and 1 have one embedding, so the pair of them is a row of their class, and (0, 2) and (1, 2) are one row of classes
    flagged = {(r.kind, r.a, r.b): (r.is_duplicate, r.n_texts) for r in pairs.collect()}
    assert flagged == {("vector", 0, 0): (True, 1), ("vector", 0, 2): (True, 2)}


def test_sessions_across_buckets(spark):
    rng = random.Random(5)
    rows, t = [], 0
    for i in range(800):
        t += rng.choice([60, 600, 4000, 90000])
        rows.append((i, 0 if rng.random() < 0.6 else rng.randrange(1, 4), t))
    df = spark.createDataFrame(rows, "id long, u long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.u, r.s0, r.n) for r in ordered.sessions(df, ["u"], "ts", "id", 3600, F.to_date("ts")).select("u", F.unix_timestamp("start").alias("s0"), "n").collect()}
    want = set()
    for u in range(4):
        times = [s for _, k, s in rows if k == u]
        start, n, last = None, 0, None
        for s in times:
            if last is not None and s - last <= 3600:
                n += 1
            else:
                if start is not None:
                    want.add((u, start, n))
                start, n = s, 1
            last = s
        want.add((u, start, n))
    assert got == want


def test_order_statistic_is_exact(spark):
    df = spark.range(50_000).select(((F.col("id") * 7919) % 50_000 / 7.0).alias("v")).unionByName(
        spark.range(20_000).select(F.lit(11.0).alias("v")))
    values = sorted(r.v for r in df.collect())
    for rank in (0, 100, 35_000, 69_299, 69_999):
        assert ordered.order_statistic(df, "v", rank) == values[rank]
    assert ordered.order_statistics(df, "v", [69_999, 3, 3, 70_000]) == [values[69_999], values[3], values[3], None]
    assert ordered.order_statistics(df.limit(0), "v", [0, 1]) == [None, None]


def test_quantiles_from_buckets(spark):
    df = spark.createDataFrame([("k", x / 10) for x in range(1, 41)], "k string, s double")
    row = mt.quantile_series(df, ["k"], "s", {"p50": 0.5}, [1.0, 2.0, 4.0]).head()
    assert math.isclose(row.p50, 2.0)


def test_embeddings_of_copies_are_compared(spark):
    """Texts 4 and 5 agree in their words and not in their vectors; 6 has the vector of 5."""
    docs = spark.createDataFrame([(4, "silver rivers cross plains"), (5, "silver rivers cross plains"), (6, "quite another essay entirely")], "id long, text string")
    vectors = spark.createDataFrame([(4, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [0.0, 1.0])], "id long, v array<double>")
    pairs, _ = pl.detect(docs, "id", "text", vectors)
    got = {(r.kind, r.a, r.b): (r.lexical, r.semantic, r.n_texts) for r in pairs.collect()}
    assert got == {("text", 4, 5): (1.0, 0.0, 1), ("vector", 5, 5): (None, 1.0, 1)}


def test_texts_of_one_embedding_are_a_class(spark):
    """n texts of one embedding and other words make rows that do not grow with n squared."""
    rng = random.Random(11)
    counts = []
    for n in (100, 200):
        rows = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(12)), [1.0, 2.0], f"o{i % 3}") for i in range(n)]
        docs = spark.createDataFrame(rows, "id long, text string, v array<double>, owner string")
        pairs, members = pl.detect(docs.select("id", "text"), "id", "text", docs.select("id", "v"))
        counts.append(pairs.count())
        assert pairs.agg(F.sum("n_texts")).first()[0] == n * (n - 1) // 2
        report = pl.analysis_report(docs, "id", "owner", members, pairs)
        assert {r.duplicates_found for r in report.collect()} == {n - sum(i % 3 == o for i in range(n)) for o in range(3)}
        found = pl.matches(docs, "id", "owner", members, pairs)
        assert found.agg(F.sum("doc_pairs")).first()[0] == sum(i % 3 != j % 3 for i in range(n) for j in range(n))
    assert counts[1] <= 2 * counts[0] + 2


def test_detection_equals_brute_force_per_document(spark):
    """Copies, edited copies and shared embeddings, each in every combination."""
    rng = random.Random(13)
    base = [" ".join(f"term{rng.randrange(300)}" for _ in range(14)) for _ in range(12)]
    vectors = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(5)]
    rows = []
    for i in range(90):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            words[rng.randrange(14)] = rng.choice(["edit", "other", "more"])
        rows.append((i, " ".join(words), rng.choice(vectors) if rng.random() < 0.8 else None, f"o{rng.randrange(4)}"))
    rows += [(90, "the and of", vectors[0], "o1"), (91, "", vectors[0], "o2"), (92, None, None, "o3")]
    docs = spark.createDataFrame(rows, "id long, text string, v array<double>, owner string")
    t = pl.Thresholds(duplicate=0.85, potential=0.55, semantic=0.9, lexical=0.7)
    pairs, members = pl.detect(docs.select("id", "text"), "id", "text", docs.select("id", "v").filter("v IS NOT NULL"), t)
    report = {r.id: r for r in pl.analysis_report(docs, "id", "owner", members, pairs).collect()}
    summed = {(r.owner, r.is_duplicate): r.n for r in pl.matches(docs, "id", "owner", members, pairs).groupBy("owner", "is_duplicate").agg(F.sum("doc_pairs").alias("n")).collect()}
    cosine = lambda x, y: 1.0 if x == y else max(0.0, min(1.0, sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))))
    expected = Counter()
    for i, a, u, o in rows:
        duplicates, potentials, best = 0, 0, []
        for j, b, v, p in rows:
            if p == o:
                continue
            same = lx_tokens(a) == lx_tokens(b) and lx_tokens(a)
            lexical = 1.0 if same else brute_lexical(a or "", b or "")
            semantic = cosine(u, v) if u and v else None
            score = max(lexical, semantic or 0.0)
            duplicate = lexical >= t.lexical or (semantic or 0) >= t.semantic or score >= t.duplicate
            potential = not duplicate and score >= t.potential
            duplicates, potentials = duplicates + duplicate, potentials + potential
            if duplicate or potential:
                best.append((duplicate, score))
                expected[o, duplicate] += 1
        r = report[i]
        assert (r.duplicates_found, r.potential_duplicates) == (duplicates, potentials), i
        assert math.isclose(r.highest_similarity, max(best)[1] if best else 0.0, abs_tol=1e-9)
    assert summed == dict(expected)


def lx_tokens(text):
    return [w for w in (text or "").split() if len(w) > 1 and w not in lx.fixed.STOP_WORDS]


def test_a_hot_gram_is_split(spark, monkeypatch):
    """Candidates of a gram that all texts hold are the same in one part and in many."""
    rng = random.Random(17)
    rows = [(i, "shared " * 5 + " ".join(f"q{rng.randrange(30)}" for _ in range(4))) for i in range(60)]
    _, distinct = lx.collapse(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    grams = lx.gram_vectors(distinct)
    whole = {(r.a, r.b) for r in lx.candidates(grams, 0.5).collect()}
    monkeypatch.setattr(lx, "HOT_GRAM", 7)
    assert whole and {(r.a, r.b) for r in lx.candidates(grams, 0.5).collect()} == whole


def test_blank_texts_match_nothing(spark):
    docs = spark.createDataFrame([(1, "the and of"), (2, "I a !!"), (3, ""), (4, None)], "id long, text string")
    vectors = spark.createDataFrame([(9, [1.0])], "id long, v array<double>")
    assert pl.detect(docs, "id", "text", vectors)[0].count() == 0
    assert pl.detect(docs, "id", "text")[0].count() == 0


def test_duplicate_vectors_have_no_limit(spark):
    rows = [(i, [1.0, i * 1e-4], i % 2) for i in range(60)]
    store = spark.createDataFrame(rows, "id long, v array<double>, owner int")
    pairs = vs.duplicate_vectors(store, "id", "v", 0.9, exclude_same="owner")
    assert pairs.count() == 900
    twice = store.unionByName(store)
    assert vs.duplicate_vectors(twice, "id", "v", 0.9, exclude_same="owner").filter("copies_a = 2 AND copies_b = 2").count() == 900


def test_hash_index_finds_neighbours_and_compares_less(clustered, spark, tmp_path, monkeypatch):
    """Nine of ten exact neighbours from a fraction of all pairs; vectors added later are found, others stay as they are."""
    m, df = clustered
    monkeypatch.setattr(vi, "HOT_BUCKET", 30)
    index = vi.HashIndex.create(df.filter("id < 400"), str(tmp_path / "index"), "id", "v", tables=20, projections=8, width=0.5)
    before = {f for f in os.listdir(tmp_path / "index" / "units")}
    index.add(df, "id", "v")
    index.add(df, "id", "v")
    assert index.units().count() == 600 and before <= set(os.listdir(tmp_path / "index" / "units"))
    exact = vs.batch_search(df, df, "id", "v", 5, 0.2)
    found = index.search(df, "id", "v", 5, 0.2)
    assert vi.recall(found, exact).first()["recall"] >= 0.9
    assert index.candidates(vj.unit_rows(df, "id", "v")).count() < 0.3 * 600 * 600
    s = m @ m.T
    assert all(abs(r.score - s[r["query"], r.neighbour]) < 1e-9 for r in found.collect())
    late = found.filter("query < 400 AND neighbour >= 400")
    assert late.count() > 0
    assert index.search(df.limit(0), "id", "v").count() == 0
