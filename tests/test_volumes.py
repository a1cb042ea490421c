"""What is sent between tasks: plans without the shuffles that the results do not need."""

import math
import re
from collections import Counter

import numpy as np

from scriptoria.operators import ailike as ai
from scriptoria.operators import bigrams as bg
from scriptoria.operators import plagiarism as pl
from scriptoria.operators import vector_index as vi
from scriptoria.operators import vector_join as vj

TEXTS = ["a b a b c", "a b d", "c a b", "x", None, "d d d d"]


def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_text(df):
    """Shuffles of rows per text and word."""
    return re.findall(r"hashpartitioning\(doc_id#\d+L?, (?:w|pair)", plan(df))


def test_leave_one_out_sends_no_pairs_by_text(spark):
    docs = corpus(spark)
    model = bg.fit(docs)
    scored = bg.perplexity(docs, model, leave_out=True)
    assert not by_text(scored) and not by_text(bg.perplexity(docs, model))
    pairs = {i: list(zip(t.split(), t.split()[1:])) for i, t in enumerate(TEXTS) if t and " " in t}
    rest = {i: Counter(p for j, ps in pairs.items() if j != i for p in ps) for i in pairs}
    vocabulary = len({w for ps in pairs.values() for _, w in ps})
    got = {r.doc_id: r.perplexity for r in scored.collect()}
    for i, ps in pairs.items():
        total = 0.0
        for x, y in ps:
            word = (sum(c for (_, b), c in rest[i].items() if b == y) + 1) / (sum(rest[i].values()) + vocabulary + 1)
            c1, kinds = sum(c for (a, _), c in rest[i].items() if a == x), sum(a == x for a, _ in rest[i])
            total += math.log((max(rest[i][x, y] - 0.5, 0) + 0.5 * kinds * word) / c1 if c1 else word)
        assert math.isclose(got[i], math.exp(-total / len(ps)))
    assert got[3] == got[4] == 50.0


def test_perplexity_sends_no_pairs_by_text(spark):
    docs = corpus(spark)
    scored = ai.perplexity(docs)
    text = plan(scored)
    assert not by_text(scored) and not re.search(r"hashpartitioning\(w1#\d+L?, w2", text) and "pair#" in text
    pairs = {i: list(zip(t.split(), t.split()[1:])) for i, t in enumerate(TEXTS) if t and " " in t}
    every = Counter(p for ps in pairs.values() for p in ps)
    vocabulary = len({y for _, y in every})
    got = {r.doc_id: r.perplexity for r in scored.collect()}
    for i, ps in pairs.items():
        logs = [math.log((every[p] + 1) / (sum(c for (a, _), c in every.items() if a == p[0]) + vocabulary)) for p in ps]
        assert math.isclose(got[i], math.exp(-sum(logs) / len(ps)))


def vectors_without_clusters(spark, n=900):
    m = np.random.default_rng(5).normal(size=(n, 24))
    return spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(m)], "id long, v array<double>, label int"), m / np.linalg.norm(m, axis=1, keepdims=True)


def test_vector_pairs_send_a_vector_once(spark, monkeypatch):
    """Every block meets every other; the vectors are dealt into blocks once and then read."""
    monkeypatch.setattr(vj, "BLOCK_ROWS", 100)
    df, unit = vectors_without_clusters(spark)
    pairs = vj.pairs_above(vj.unit_rows(df, "id", "v"), 0.4)
    assert "CoGroups" not in plan(pairs) and re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(pairs))
    scores = unit @ unit.T
    assert {(r.a, r.b) for r in pairs.collect()} == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(scores, 1) >= 0.4))}


def test_nearest_hands_on_the_best_of_a_task(spark, monkeypatch):
    """The ranking gets a query's best of a task, not of every block."""
    monkeypatch.setattr(vj, "BLOCK_ROWS", 50)
    df, unit = vectors_without_clusters(spark)
    units = vj.unit_rows(df, "id", "v")
    near = vj.nearest(units, units, 3, -1.0, exclude_self=True)
    assert "CoGroups" not in plan(near)
    scores = unit @ unit.T
    np.fill_diagonal(scores, -np.inf)
    best = np.argsort(-scores, axis=1)[:, :3]
    assert {(r["query"], r.neighbour, r["rank"]) for r in near.collect()} == {(q, int(i), k + 1) for q in range(len(unit)) for k, i in enumerate(best[q])}


def test_owners_of_pairs_are_looked_up_without_a_shuffle_of_pairs(spark):
    df, _ = vectors_without_clusters(spark, 300)
    found = pl.cross_owner_vectors(df, "id", "v", "label", 0.4)
    assert "SortMergeJoin" not in plan(found) and "hashpartitioning" not in plan(found).split("mapInPandas")[0].split("MapInPandas")[0]
    assert found.count() > 0


def test_membership_names_every_pair_of_documents(spark):
    """Class rows and text rows, expanded by the membership, give each pair of flagged documents."""
    rows = [(0, "red fox runs"), (1, "red fox runs"), (2, "blue whale sings"), (3, "old stone bridge")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in (0, 1, 2)], "vec_id long, embedding array<double>")
    pairs, members = pl.detect(docs, "doc_id", "text", vectors)
    held = pl.membership(members, "doc_id").collect()
    text = {r.a: r.b for r in held if r.kind == "member"}
    kind = {r.a: r.b for r in held if r.kind == "class"}
    assert text == {0: 0, 1: 0, 2: 2, 3: 3} and kind == {0: 0, 2: 0}
    named = set()
    for p in pairs.collect():
        side = lambda x: [i for i in text if (text[i] if p.kind == "text" else kind.get(text[i])) == x]  # noqa: B023, E731
        named |= {(i, j) for i in side(p.a) for j in side(p.b) if i < j}
    assert named == {(0, 1), (0, 2), (1, 2)}


def test_index_search_sends_no_vectors_with_pairs(spark, tmp_path):
    df, _ = vectors_without_clusters(spark, 200)
    index = vi.HashIndex.create(df, str(tmp_path / "index"), "id", "v", tables=4, projections=1)
    found = index.search(df.filter("id % 50 = 0"), "id", "v", 3)
    # the pairs meet the stored vectors as ids, the queries' vectors are sent to every task
    assert re.search(r"BroadcastHashJoin \[query", plan(found)) and found.count() > 0
    assert not re.search(r"Exchange hashpartitioning\(id[^\n]*\n[^\n]*uq#", plan(found))


def test_index_search_sends_no_candidates(spark, tmp_path, monkeypatch):
    """A query's candidates are compared where the blocks meet, in several steps; only the best are sent, and they are the best of all that share a bucket."""
    monkeypatch.setattr(vj, "BLOCK_ROWS", 60)
    monkeypatch.setattr(vi, "PAIRS_AT_ONCE", 50)
    df, unit = vectors_without_clusters(spark, 300)
    index = vi.HashIndex.create(df.filter("id % 2 = 0"), str(tmp_path / "index"), "id", "v", tables=6, projections=2)
    index.add(df, "id", "v")
    queries = df.filter("id % 3 = 0")
    found = index.search(queries, "id", "v", 4, 0.05, exclude_self=True)
    assert not re.search(r"Exchange hashpartitioning\(query#\d+L?, id", plan(found))
    shared = {}
    for r in index.candidates(vj.unit_rows(queries, "id", "v")).collect():
        shared.setdefault(r["query"], set()).add(r.id)
    scores, best = unit @ unit.T, set()
    for q, ids in shared.items():
        near = sorted((i for i in ids if i != q and scores[q, i] >= 0.05), key=lambda i: (-scores[q, i], i))[:4]
        best |= {(q, i, rank + 1) for rank, i in enumerate(near)}
    assert any(len(ids) < 300 for ids in shared.values())
    assert best and {(r["query"], r.neighbour, r["rank"]) for r in found.collect()} == best
