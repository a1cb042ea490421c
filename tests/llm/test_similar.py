"""Near-dedup by similarity against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import docs, odd, prose  # noqa: F401

from scriptoria.llm import similar


def brute_groups(texts):
    sets = [set(similar.shingles(t).tolist()) for t in texts]
    part = list(range(len(texts)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b) - 1e-9:
                part[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def near_copies(seed, n, edits, words=150):
    r = random.Random(seed)
    base = prose(seed, words).split()
    out = [" ".join(base)]
    for i in range(n):
        own = list(base)
        for _ in range(r.randint(0, edits)):
            own[r.randrange(words)] = f"edit{i}x{r.randrange(1000)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [8, 2048])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    texts = near_copies(1, 60, 3) + [t for s in range(2, 22) for t in near_copies(s, 2, 4)] + [prose(500 + i, 80) for i in range(40)]
    texts += [None, "", "  \n", "too few words", "Too FEW  words", prose(900, 30_000), prose(900, 30_000) + " end"]
    expected = brute_groups(texts)
    table = docs(spark, list(enumerate(texts)))
    got = {r["row"]: r["group"] for r in similar.similar_groups(table, "doc_id", "text").collect()}
    assert len(got) == len(texts) and [got[i] for i in range(len(texts))] == [min(j for j, g in enumerate(expected) if g == e) for e in expected]
    kept = similar.keep_one(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == set(got.values())


def test_similar_odd(spark, odd):  # noqa: F811
    kept = similar.keep_one(odd.withColumn("row__", F.lit(1)))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "3", "4", "None"]
    assert similar.keep_one(odd.limit(0)).count() == 0


def test_pivots_only_discard_far_pairs():
    r = np.random.default_rng(1)
    prints = r.integers(0, 2**63, (40, 4), dtype=np.uint64)
    prints[20:] = prints[:20] ^ (np.uint64(1) << r.integers(0, 64, (20, 4), dtype=np.uint64))
    sets = [np.arange(100 * (i % 20), 100 * (i % 20) + 100 - 2 * (i // 20), dtype=np.uint64) for i in range(40)]
    ids, refs, none = np.arange(40), similar.references(32).reshape(8, 4), np.zeros(40, dtype=bool)
    links = lambda sets, parts, second: {tuple(sorted(x)) for x in similar.verified_links(ids, prints, sets, parts, second, 0.8, 20, refs)}
    pairs = {(i, i + 20) for i in range(20)}
    assert links(sets, ids, none) == pairs == links(sets, ids, ids >= 20)
    assert links(sets, ids % 20, none) == set() == links(sets, ids, ids % 20 < 10)
    assert links([s[:75] if i < 20 else s for i, s in enumerate(sets)], ids, none) == set()


def test_a_hot_group_makes_rows_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 64)
    made = []
    real = similar._solved
    monkeypatch.setattr(similar, "_solved", lambda placed, *a: (made.append(placed.count()), real(placed, *a))[1])
    counts = []
    for n in (300, 600):
        made.clear()
        texts = near_copies(7, n, 3, 300) + [prose(4000 + i, 60) for i in range(100)]
        table = docs(spark, list(enumerate(texts)))
        assert similar.keep_one(table).count() == 101
        counts.append(sum(made))
    assert counts[0] <= 2 * 300 and counts[1] <= 2.5 * counts[0]


def test_rows_of_one_key_and_text(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (3, "h i j k l m"), (3, "h i j k l m"), (None, "n"), (None, "n")]
    kept = similar.keep_one(docs(spark, rows))
    assert sorted(str(r.doc_id) + r.text for r in kept.collect()) == ["1a b c d e f g", "3h i j k l m", "Nonen"]


@pytest.mark.parametrize("block", [32, 2048])
def test_families_near_the_limit_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    texts = []
    for edits in (4, 5):  # pairs of copies lie on both sides of 0.8
        r = random.Random(40 + edits)
        base = prose(40 + edits, 300).split()
        for i in range(200):
            own = list(base)
            for at in r.sample(range(300), edits + (i % 2)):
                own[at] = f"edit{edits}x{i}x{at}"
            texts.append(" ".join(own))
    expected = brute_groups(texts)
    got = {x["row"]: x["group"] for x in similar.similar_groups(docs(spark, list(enumerate(texts))), "doc_id", "text").collect()}
    assert [got[i] for i in range(len(texts))] == [min(j for j, g in enumerate(expected) if g == e) for e in expected]
