"""Vector codes, content sort, whitening and repeated ids of the top-k search against brute force."""

import hashlib
import random
import re
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_top, docs, odd, prose  # noqa: F401

from scriptoria.llm import chaining, content_sort, language, packing, secret_scan, tiling, vector_codes, voronoi, whitening
from scriptoria.llm import queries as llm_queries

VECTORS = "vec_id long, embedding array<double>, label int, id int, error double, code string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 7, 0.5, "z") for i, v, lab in rows], VECTORS)


def integers(rows, factor, size):
    return [(i, [int(np.floor(factor * x)) for x in v] + [0] * (size - len(v)), lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]


# 11 -----------------------------------------------------------------------------------------------


def nearest_entry(x, book):
    return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))


def brute_codes(rows, parts, entries, rounds):
    kept = integers(rows, 256, max(len(v) for _, v, _ in rows if v))
    width = -(-len(kept[0][1]) // parts)
    cut = [[(v + [0] * (width * parts - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0))[:entries]
    books = [[cut[r][p] for r in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for c in cut:
                held[nearest_entry(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(h) for x in zip(*h)] if h else e for h, e in zip(held, books[p])]
    out = []
    for (i, _, lab), c in zip(kept, cut):
        found = [nearest_entry(c[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found)))
    sums = {}
    for _, lab, _, e in out:
        sums[lab] = sums.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, lab, c, e, sums[lab]) for i, lab, c, e in out), key=str), digest


@pytest.mark.parametrize(("size", "scale", "entries"), [(10, 1.0, 8), (8, 0.01, 64), (8, 1e6, 16), (3, 1.0, 500)])
def test_codes_equal_brute_force(spark, size, scale, entries):
    r = random.Random(size)
    rows = [(i, [scale * r.gauss(0, 1) for _ in range(size)], r.choice([None, 1, 2])) for i in range(120)]
    rows += [(200, [0.25] * size, 1)] * 40 + [(None, [0.5] * size, 3), (300, [0.125] * (size - 1), 4)]
    rows += [(301, None, 1), (302, [1.0, None], 1), (303, [float("nan")] * size, 1), (304, [float("-inf")] * size, 1)]
    entries = min(entries, 256)
    coded, books = vector_codes.compress(vectors(spark, rows), parts=4, entries=entries)
    expected, digest = brute_codes(rows, 4, entries, 2)
    got = sorted(((x.id, x.label, x.code.hex(), x.error, x.label_error) for x in coded.collect()), key=str)
    assert got == expected and books.digest == digest


def test_codes_of_nothing(spark):
    coded, books = vector_codes.compress(vectors(spark, [(1, None, 1)]))
    assert coded.count() == 0 and books is None
    assert set(coded.columns) == {"id", "label", "code", "error", "label_error"}


def test_search_keeps_the_lower_index_of_ties():
    book = np.array([[5, 0], [0, 5], [0, 5], [9, 9], [-5, 0]])
    index, away = vector_codes.equal_average_search(np.array([[0, 5], [5, 5], [0, 0], [100, 100]]), book)
    assert index.tolist() == [1, 0, 0, 3] and away.tolist() == [0, 25, 25, 2 * 91**2]


# 12 -----------------------------------------------------------------------------------------------


def brute_equal(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    out = []
    for (key, _), t in zip(rows, norm):
        ids = [k for (k, _), other in zip(rows, norm) if other == t]
        least = min((k for k in ids if k is not None), default=None)
        out.append((key, least, len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("least_split", [1 << 20, 500])
def test_content_sort_equals_brute_force(spark, monkeypatch, least_split):
    monkeypatch.setattr(content_sort, "LEAST_SPLIT", least_split)
    hot = prose(1, 20)
    rows = [(i, hot if i % 3 else hot.replace(" ", " \t\n")) for i in range(400)] + [(900 + i, prose(i, 30)) for i in range(60)]
    rows += [(900 + i, prose(i, 30)) for i in range(0, 60, 2)]  # repeated rows
    rows += [(None, hot), (None, "no key"), (None, "no key"), (5000, None), (5001, ""), (5002, " "), (5003, " "), (5004, "\n")]
    rows += [(5005, prose(3, 60_000)), (5006, prose(3, 60_000) + "x"), (5007, "Case"), (5008, "case"), (5009, hot + " ")]
    table = docs(spark, rows)
    got = content_sort.exact_groups(table).collect()
    assert sorted(((g.key, g.keep, g.group_size, g.text_sha256) for g in got), key=str) == sorted(brute_equal(rows), key=str)
    for digest in {g.text_sha256 for g in got}:
        kept = [g for g in got if g.text_sha256 == digest and g.kept]
        assert len(kept) == 1 and kept[0].key == kept[0].keep
    assert content_sort.exact_groups(table.limit(0)).count() == 0


def test_content_sort_shuffles_texts_once_and_splits_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(content_sort, "LEAST_SPLIT", 1000)
    table = docs(spark, [(i, "the same words in every row") for i in range(3000)] + [(i, prose(i, 9)) for i in range(3000, 4000)])
    rows = table.select(F.col("doc_id").alias("key"), content_sort.normalised(F.col("text")).alias("body")).withColumn("h", F.xxhash64("body"))
    hot = content_sort._hot(rows).collect()
    assert len(hot) == 1 and hot[0].parts >= 16
    got = content_sort.exact_groups(table)
    assert got.groupBy("group_size").count().filter("group_size = 3000").first()["count"] == 3000
    assert got.filter("kept AND group_size = 3000").collect()[0].key == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 13 -----------------------------------------------------------------------------------------------


def check_whitening(rows, size, got, fitted, tolerance=1e-6):
    kept = integers(rows, 256, size)
    distinct = sorted({tuple(v) for _, v, _ in kept})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[float(Fraction(n * x - s, n)) for x, s in zip(v, sums)] for v in distinct])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes.T[::-1]
    k = min(4, int((values > 1e-12 * values[0]).sum()))
    assert (fitted.n, fitted.sums) == (n, sums) and len(fitted.values) == k and fitted.identity_error <= 1e-4
    assert np.allclose(fitted.explained, values[:k] / values.sum(), rtol=1e-8)
    expected = {}
    for i, v, _ in kept:
        expected.setdefault(i, []).append((sum((n * x - s) ** 2 for x, s in zip(v, sums)), (np.array([float(Fraction(n * x - s, n)) for x, s in zip(v, sums)]) @ axes[:k].T) / np.sqrt(values[:k])))
    seen = {}
    for g in got:
        seen.setdefault(g.id, {}).setdefault(g.component, []).append(g)
    assert set(seen) == set(expected)
    for i, by in seen.items():
        assert set(by) == set(range(1, k + 1))
        for c, held in by.items():
            assert sorted(int(g.deviation) for g in held) == sorted(d for d, _ in expected[i])
            for g in held:
                assert any(abs(abs(g.whitened) - abs(w[c - 1])) <= tolerance * (1 + abs(w[c - 1])) for _, w in expected[i])
    signs = {c: {np.sign(g.whitened) * np.sign(expected[g.id][0][1][c - 1]) for g in got if g.component == c and len(expected[g.id]) == 1 and abs(g.whitened) > 1e-3} for c in range(1, k + 1)}
    assert all(len(s) == 1 for s in signs.values())


@pytest.mark.parametrize("kind", ["plain", "far from zero", "ill-conditioned", "constant dimension", "few rows"])
def test_whitening_equals_brute_force(spark, kind):
    r = np.random.default_rng(len(kind))
    n, d = (5 if kind == "few rows" else 300), 9
    x = r.normal(size=(n, d)) * np.array([9, 7, 5, 3, 1, 1, 1, 1, 1])
    if kind == "far from zero":
        x += 4000
    if kind == "ill-conditioned":
        x *= 10.0 ** np.arange(6, -3, -1)
    if kind == "constant dimension":
        x[:, 4] = 0.5
        x[:, 7] = np.floor(256 * x[:, 8]) / 256
        x[:, 8] = x[:, 7]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(0, rows[0][1], 1)] * 30 + [(1, rows[2][1], 2), (None, rows[3][1], None), (7000, rows[1][1][:-2], 1)]
    rows += [(8000, None, 1), (8001, [1.0, None], 1), (8002, [float("nan")] * d, 1), (8003, [float("inf")] * d, 1)]
    whitened, fitted = whitening.whiten(vectors(spark, rows))
    check_whitening(rows, d, whitened.collect(), fitted)


def test_whitening_of_nothing(spark):
    for rows in ([(1, None, 1)], [(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)]):
        whitened, fitted = whitening.whiten(vectors(spark, rows))
        assert whitened.count() == 0 and fitted.identity_error == 0.0


def test_triangular_solve():
    r = np.random.default_rng(3)
    a, t = r.normal(size=(40, 7)), np.triu(r.normal(size=(7, 7))) + 5 * np.eye(7)
    assert np.allclose(whitening.solve(a, t) @ t, a)


def test_whitening_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    _, fitted = whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
    got = llm_queries.op13(spark, folder).withColumn("id", F.col("vec_id")).collect()
    check_whitening(rows, 64, got, fitted)
    assert {g.n for g in got} == {fitted.n} and {round(g.explained, 12) for g in got} == {round(float(e), 12) for e in fitted.explained}


# 1 ------------------------------------------------------------------------------------------------


def test_top_k_with_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "DATA_BLOCK", 16)
    r = random.Random(8)
    rows = [(0, [1.0 + r.random(), r.random()]) for _ in range(30)] + [(i, [r.random(), 1.0]) for i in range(1, 11)] + [(40, [9.0, 1.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = data.filter("vec_id = 40").unionByName(data.filter("vec_id = 0").limit(1))
    first = [float(x) for x in queries.filter("vec_id = 0").first().embedding]
    held = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    expected = []
    for i, v in ((40, [9.0, 1.0]), (0, first)):
        own = [int(np.floor(64 * x)) for x in v]
        scores = sorted((-sum(a * b for a, b in zip(own, w)), j) for j, w in held if j != i)
        expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:5])]
    for pivots in (1, 4, 16):
        got = sorted(map(tuple, voronoi.nearest(data, queries, 5, pivots=pivots).collect()))
        assert got == sorted(expected)


def test_large_components_and_what_is_sent(spark):
    rows = [(i, [3e6 + i, 1.0]) for i in range(25)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, voronoi.nearest(data, data.filter("vec_id % 20 = 0"), 3).collect()))
    assert got == brute_top(rows, 3)


def test_rows_of_other_clusters_are_not_sent(spark):
    r = np.random.default_rng(2)
    centres = 50 * np.eye(8)
    rows = [(i, (centres[i % 8] + r.normal(size=8)).tolist()) for i in range(800)]
    points = 64.0 * centres
    packing = voronoi.Packing.of(voronoi.integer_vectors(spark.createDataFrame(rows, "id long, e array<double>"), "e", 64.0, id=F.col("id")))
    held = voronoi.packed(voronoi.integer_vectors(spark.createDataFrame(rows, "id long, e array<double>"), "e", 64.0, id=F.col("id")), packing)
    placed = voronoi._placed(held, packing, points)
    reach = np.array([x.d for x in sorted(placed.groupBy("cell").agg(F.max("dist").alias("d")).collect())])
    near = [(x.cell, x.id, x.dist) for x in placed.collect()]
    bounds = voronoi.group_bounds(points, reach, near, 20)
    assert voronoi.route(placed, packing, points, reach, bounds, list(range(8))).count() == 0
    assert voronoi.route(placed, packing, points, reach, np.full(8, -np.inf), list(range(8))).count() == 7 * 800


# pipeline, 5, 6, 8 --------------------------------------------------------------------------------


def english(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("the of and a in is that for it was on are as with his they at be this from have or by one had not but what all were".split()) + r.choice(["", "s", "ing"]) for _ in range(n))


def test_stages_keep_columns_named_like_their_results(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "nothing like it at all in here " * 3)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, english(i, 60), "en", False, 3, 50, 1, 2) for i in range(60)] + [(99, "\n".join(["one", "two", "three", "one", "two", "three"]), "en", False, 3, 50, 1, 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, accepted boolean, n_removed int, n_chars long, row int, `group` int")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, table, str(tmp_path))
    assert one.columns == table.columns and one.count() == 61
    two = stages["line_dedup"](spark, one, str(tmp_path))
    short = two.filter("doc_id = 99").first()
    assert two.columns == table.columns and (short.text, short.n_chars, short.n_removed) == ("one\ntwo\nthree", 13, 3)
    without = stages["line_dedup"](spark, table.drop("n_chars"), str(tmp_path))
    assert without.columns == table.drop("n_chars").columns and without.count() == 61
    for name in ("near_dedup", "decontamination"):
        two = stages[name](spark, two, str(tmp_path))
        assert two.columns == table.columns and two.count() == 61
    assert stages["packing"](spark, two, str(tmp_path)).agg(F.countDistinct("doc_id")).first()[0] == 61
    for name in ("language_id", "line_dedup", "near_dedup", "decontamination", "packing"):
        assert stages[name](spark, table.limit(0), str(tmp_path)).count() == 0


def test_packing_beside_columns_of_its_names(spark):
    pieces = spark.createDataFrame([(i, 10, "x", 7) for i in range(20)], "key long, length long, sequence_id string, Offset int")
    got = packing.pack(pieces, 50)
    assert got.columns == ["key", "length", "sequence_id", "Offset", "sequence_id_", "offset_"]
    assert got.select("sequence_id_").distinct().count() == 4 and {r.sequence_id for r in got.collect()} == {"x"}


def test_short_benchmark_items_are_found_whole(spark):
    items = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "one two three four five six"), (4, None), (5, "")], "item_id long, text string")
    table = docs(spark, [(1, "x alpha beta y"), (2, "beta alpha"), (3, "say gamma, gamma"), (4, "gamma"), (5, "zero one two three four five six seven"), (6, None)])
    got = sorted((r.key, r.item) for r in tiling.contaminated(table, items).collect())
    assert got == [(1, 1), (3, 2), (4, 2), (5, 3)]


def test_letters_and_marks():
    assert language.words_of("½ ² Ⅷ 12 _ ③") == []
    assert language.words_of("नमस्ते दुनिया, l’été éa x²y") == ["नमस्ते", "दुनिया", "l", "été", "éa", "x", "y"]


def test_long_clean_texts_are_accepted(spark):
    r = random.Random(4)
    nordic = "och att det som en på är av för med till den har de inte om ett han men var jag sig från vi så kan när år"
    swedish = lambda seed: " ".join(random.Random(seed).choices(nordic.split(), k=80))
    rows = [(i, english(i, r.randint(40, 200)), "en") for i in range(200)] + [(1000 + i, swedish(i), "sv") for i in range(200)]
    models = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for times in (1, 30, 1000):
        table = spark.createDataFrame([(i, " ".join([english(5000 + i, 80)] * times)) for i in range(30)], "doc_id long, text string")
        assert language.keep_identified(table, models).count() >= 29
    junk = spark.createDataFrame([(i, " ".join("".join(r.choices("qxzjkvwpbf", k=7)) for _ in range(80))) for i in range(30)], "doc_id long, text string")
    assert language.keep_identified(junk, models).count() == 0


def test_languages_beyond_the_argument_are_not_learned(spark):
    rows = [(i, english(i, 50), "en") for i in range(30)] + [(100 + i, "wort und satz " * 9, "de") for i in range(20)] + [(200 + i, "tiny", f"x{i}") for i in range(30)]
    assert language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=2).languages == ["de", "en"]


# 9 ------------------------------------------------------------------------------------------------


def slow_parts(pieces, identity):
    """The parts of a chain by trying all runs and all neighbours each time."""
    over, merged = chaining._over, chaining._merged
    runs, total = [], 0.0
    for n, piece in enumerate(pieces):
        before, total = total, total + over(piece, identity)
        if total <= before:
            continue
        low, first = before, n
        while True:
            smaller = [k for k in range(len(runs)) if runs[k][0] < low]
            if not smaller or runs[smaller[-1]][1] >= total:
                break
            low, first = runs[smaller[-1]][0], runs[smaller[-1]][2]
            runs = runs[: smaller[-1]]
        runs.append((low, total, first, n))
    spans = [r[2:] for r in runs]
    while len(spans) > 1:
        scores = [over(merged(pieces[x[0] : y[1] + 1]), identity) for x, y in zip(spans, spans[1:])]
        if max(scores) < 0:
            break
        k = scores.index(max(scores))
        spans[k : k + 2] = [(spans[k][0], spans[k + 1][1])]
    return [merged(pieces[a : b + 1]) for a, b in spans]


def random_pieces(r, n):
    pieces, at, source = [], 0, 0
    for i in range(n):
        if i:
            gap, other = r.randrange(14), r.randrange(14)
            pieces.append((at, at + gap, source, source + other, r.randint(0, min(gap, other))))
            at, source = at + gap, source + other
        pieces.append((at, at + 8, source, source + 8, 8))
        at, source = at + 8, source + 8
    return pieces


def test_parts_of_long_chains_are_those_of_the_slow_way():
    r = random.Random(21)
    for _ in range(400):
        pieces = random_pieces(r, r.randrange(1, 25))
        assert chaining._parts(pieces, 0.8) == slow_parts(pieces, 0.8)
    pieces = random_pieces(r, 8000)  # 15,999 seeds and gaps
    start = time.perf_counter()
    chaining._parts(pieces, 0.8)
    assert time.perf_counter() - start < 1


def words_in_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def test_reported_passages_match_word_by_word(spark):
    """Planted verbatim and edited passages are found whole, and what is reported matches by as many words as it says."""
    r = random.Random(33)
    passages = [prose(700 + i, r.randrange(60, 140)) for i in range(8)]
    planted, rows = [], []
    for i in range(40):
        n = r.randrange(8)
        words = passages[n].split()
        for _ in range(r.randrange(3)):
            words[r.randrange(10, len(words) - 10)] = f"edit{i}"
        before = prose(3000 + i, r.randrange(20, 60)).split()
        before = [f"{w}{i}" for w in before]
        rows.append((i, " ".join(before + words + [f"{w}{i}" for w in prose(4000 + i, 20).split()])))
        planted.append((n, len(before), len(before) + len(words)))
    found = chaining.repeated_passages(docs(spark, rows)).collect()
    texts = {i: t.split() for i, t in rows}
    first = {}
    for i, (n, start, end) in enumerate(planted):
        if n not in first:
            first[n] = i
            assert not [f for f in found if f.key == i]
            continue
        mine = [f for f in found if f.key == i]
        # an edited first document leaves the seeds of its edits to later sources, whose parts lie within the passage
        assert mine and abs(min(f.start for f in mine) - start) <= 3 and abs(max(f.end for f in mine) - end) <= 3, (i, mine)
        assert {planted[f.source][0] for f in mine} == {n}
    for f in found:
        a, b = texts[f.key][f.start : f.end], texts[f.source][f.source_start : f.source_end]
        assert 0.8 * len(b) <= f.matched <= words_in_common(a, b)  # a part of the passage may have a source of its own


# 7 ------------------------------------------------------------------------------------------------


def test_a_placeholder_hides_only_the_windows_that_overlap_it(spark):
    secret = "q7Zt1VbX9mK4cR2wLp8sD0fH"
    rows = [(1, f"config/example/paths/that/go/on/{secret}"), (2, f"AAAAAAAAAAAAAAAA{secret}"), (3, "550e8400-e29b-41d4-a716-446655440000"), (4, f"example{secret[:12]}")]
    found = {r.key: r.spans for r in secret_scan.find_secrets(docs(spark, rows)).collect()}
    assert found[1].endswith(f":{len(rows[0][1])}") and found[2] == f"base64_entropy:16:{16 + len(secret)}"
    assert found[3] == "" and found[4] == ""
