"""Lexical pairs from packed blocks of texts: what is sent, and what the reports read."""

import random
import re

from pyspark.sql import functions as F

from scriptoria.operators import lexical as lx
from scriptoria.operators import plagiarism as pl
from scriptoria.plans import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def corpus(spark, n=120):
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(80)]
    texts = [" ".join(rng.choice(vocabulary[: 20 + i % 60]) for _ in range(30)) for i in range(n)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_lexical_pairs_send_a_text_once(spark, monkeypatch):
    """Blocks meet in a cross product that reads them; neither texts nor candidates are dealt to pairs of blocks."""
    _, texts = lx.collapse(corpus(spark), "doc_id", "text")
    grams = lx.gram_vectors(texts)
    whole = {(r.a, r.b): r.lexical for r in lx.pairs_above(grams, 0.3).collect()}
    monkeypatch.setattr(lx, "BLOCK_GRAMS", 500)
    pairs = lx.pairs_above(grams, 0.3)
    assert "CoGroup" not in plan(pairs) and re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(pairs))
    assert whole and {(r.a, r.b): r.lexical for r in pairs.collect()} == whole
    scored = lx.score_pairs(grams.selectExpr("rep AS a").crossJoin(grams.selectExpr("rep AS b")).filter("a < b"), grams)
    assert {(r.a, r.b): r.lexical for r in scored.filter("lexical >= 0.3").collect()} == whole


def test_pairs_meet_no_vectors(spark, monkeypatch):
    """Cosines come with the scores of texts; the vectors are joined with texts, never with pairs."""
    docs = corpus(spark)
    vectors = docs.selectExpr("doc_id", "array(cos(doc_id % 9), sin(doc_id % 9)) AS embedding").filter("doc_id % 5 > 0")
    met = []
    plain = pl.with_semantic
    monkeypatch.setattr(pl, "with_semantic", lambda rows, *rest: met.append(rows.filter("a <> b").count()) or plain(rows, *rest))
    pairs, _ = pl.detect(docs, "doc_id", "text", vectors, pl.Thresholds(potential=0.3))
    assert met == [0]
    held = {r.doc_id: r.embedding for r in vectors.collect()}
    rows = pairs.filter("kind = 'text'").collect()
    assert any(r.semantic is None for r in rows) and any(r.semantic is not None for r in rows)
    for r in rows:
        if r.a in held and r.b in held:
            x, y = held[r.a], held[r.b]
            assert abs(r.semantic - min(1.0, max(0.0, x[0] * y[0] + x[1] * y[1]))) < 1e-9
        else:
            assert r.semantic is None


def test_matches_are_not_written_again(spark, monkeypatch):
    """The report follows from the staged pairs: rows of owners' matches, two for each pair at least, are not staged."""
    docs = corpus(spark).selectExpr("doc_id", "text", "concat('o', doc_id % 3) AS source")
    pairs, members = pl.detect(docs, "doc_id", "text", t=pl.Thresholds(potential=0.3))
    staged, plain = [], pl.stage
    monkeypatch.setattr(pl, "stage", lambda df, name: staged.append(name) or plain(df, name))
    report = {r.doc_id: r.duplicates_found + r.potential_duplicates for r in pl.analysis_report(docs, "doc_id", "source", members, pairs).collect()}
    assert not {"text_matches", "class_matches", "flagged_pairs"} & set(staged)
    found = [(p.a, p.b) for p in pairs.collect()]
    assert any(report.values()) and report == {i: sum(i in p and p[0] % 3 != p[1] % 3 for p in found) for i in report}


def copies(spark, folder):
    """Texts 0 and 1 are copies, 2 and 3 others of the same vector, 4 stands alone; rows of two owners."""
    rows = [(0, "red fox runs", "x"), (1, "red fox runs", "y"), (2, "blue whale sings", "y"), (3, "grey owl waits", "y"), (4, "old stone bridge", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    vectors = [(i, 0, [1.0, 0.0] if i < 4 else [0.0, 1.0]) for i in range(5)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_confidence_rows_say_how_many_pairs_of_texts_they_stand_for(spark, tmp_path):
    rows = {(r.kind, r.a, r.b): r.n_texts for r in QUERIES["F5_confidence_labels"](spark, copies(spark, tmp_path)).collect()}
    assert rows["text", 0, 0] == 1 and rows["vector", 0, 0] == 3 and rows["member", 1, 0] == 1


def test_alerts_say_whose_submissions_match(spark, tmp_path):
    rows = [r for r in QUERIES["F9_alerts"](spark, copies(spark, tmp_path)).collect() if r.kind in ("text", "vector")]
    found = {(r.kind, r.owner): (r.own, r.others, r.doc_pairs) for r in rows}
    # the copies' own pair is a row of texts, so it is taken off the pairs of the class, not off its submissions
    assert found == {("text", "x"): (1, 1, 1), ("text", "y"): (1, 1, 1), ("vector", "x"): (1, 3, 2), ("vector", "y"): (3, 1, 2)}


def test_few_pairs_make_few_groups(spark, monkeypatch):
    """Each text with the next one: groups of about as many pairs as a block has texts, not one for each pair of blocks."""
    monkeypatch.setattr(lx, "BLOCK_TEXTS", 5)
    docs = corpus(spark)
    grams = lx.gram_vectors(docs.select(docs.doc_id.alias("rep"), lx.content_tokens(docs.text).alias("tokens")))
    plain = lx._Block
    pairs = docs.selectExpr("doc_id AS a", "doc_id + 1 AS b").filter("b < 120")
    groups = spark.sparkContext.accumulator(0)

    class Counted(plain):
        def __init__(self, texts):
            groups.add(1)
            super().__init__(texts)

    monkeypatch.setattr(lx, "_Block", Counted)
    held = {(r.a, r.b): r.lexical for r in lx.score_pairs(pairs, grams).collect()}
    assert len(held) == 119 and groups.value <= 24
    monkeypatch.setattr(lx, "BLOCK_TEXTS", 1000)
    assert held == {(r.a, r.b): r.lexical for r in lx.score_pairs(pairs, grams).collect()}


def staged_by(monkeypatch, module):
    held, plain = {}, module.stage
    monkeypatch.setattr(module, "stage", lambda df, name: held.setdefault(name, plain(df, name)))
    return held


def with_vectors(spark):
    docs = corpus(spark)
    return docs, docs.selectExpr("doc_id", "array(cos(doc_id % 9), sin(doc_id % 9)) AS embedding").filter("doc_id % 5 > 0")


def test_counts_of_flagged_pairs_write_no_row_per_pair(spark, monkeypatch):
    """reasons, presets and match types count pairs where they are scored; the counts are those of the listed pairs."""
    docs, vectors = with_vectors(spark)
    t = pl.Thresholds(potential=0.3)
    pairs, _ = pl.detect(docs, "doc_id", "text", vectors, t)
    expected = {r.reason: r.n for r in pairs.groupBy("reason").agg({"n_texts": "sum"}).toDF("reason", "n").collect()}
    staged = staged_by(monkeypatch, pl)
    found = {r.reason: r.n for r in pl.flagged_counts(docs, "doc_id", "text", {"reason": F.col("reason")}, vectors, t).collect()}
    n_pairs, n_classes = sum(expected.values()), 9 * 10 // 2
    assert found == expected and n_pairs > 500
    assert "text_rows" not in staged and staged["pair_counts"].count() <= (len(expected) + 1) * (n_classes + 1) < n_pairs


def test_staged_pairs_hold_what_a_report_reads(spark, monkeypatch):
    """labels are staged without scores, and of the pairs those that a report can list."""
    docs, vectors = with_vectors(spark)
    t = pl.Thresholds(potential=0.3)
    every = {(r.kind, r.a, r.b): r for r in pl.detect(docs, "doc_id", "text", vectors, t)[0].collect()}
    staged = staged_by(monkeypatch, pl)
    labels, _ = pl.detect(docs, "doc_id", "text", vectors, t, columns=["confidence"])
    assert {(r.kind, r.a, r.b): (r.n_texts, r.confidence) for r in labels.collect()} == {k: (r.n_texts, r.confidence) for k, r in every.items()}
    assert not {"lexical", "semantic"} & set(staged["text_rows"].columns)
    staged.clear()
    high, _ = pl.detect(docs, "doc_id", "text", vectors, t, least=0.7)
    listed = {k for k, r in every.items() if r.is_duplicate or r.score >= 0.7}
    assert {(r.kind, r.a, r.b) for r in high.collect()} == listed and len(listed) < len(every)
    assert staged["text_rows"].filter("near_a IS NULL").count() <= len(listed)


def test_words_are_sent_to_the_blocks_of_texts(spark, monkeypatch):
    """the shuffle to the blocks reads words, grams follow after it; pairs and cosines are those of grams dealt before."""
    docs, vectors = with_vectors(spark)
    _, texts = lx.collapse(docs, "doc_id", "text")
    units = vectors.selectExpr("doc_id AS rep", "doc_id % 9 AS vector_class", "embedding AS u")
    grams, rows = lx.gram_vectors(texts), lambda df: sorted(map(str, df.collect()))
    monkeypatch.setattr(lx, "BLOCK_GRAMS", 500)
    plans, plain = [], lx.stage
    monkeypatch.setattr(lx, "stage", lambda df, name: plans.append(plan(df)) or plain(df, name))
    found = lx.pairs_above(texts, 0.1, units)
    assert not any("hashpartitioning" in line and "grams" in line for line in plans[0].splitlines()) and "SortMergeJoin" not in plans[0]
    assert "Exchange" in plans[0] and "xxhash64" in plans[0].split("Exchange")[0]
    assert "hashpartitioning(guest_block" not in plan(found)
    assert rows(found) == rows(lx.pairs_above(grams, 0.1, units)) and found.count() > 20


def test_blocks_keep_large_ids(spark):
    """Ids beyond the whole numbers of a double stay as they are where some texts have no vector."""
    first = 2**60 + 1
    docs = spark.createDataFrame([(first + i, "red fox runs over old stone bridges " + w) for i, w in enumerate(["now", "then", "here"])], "rep long, text string")
    texts = docs.select("rep", lx.content_tokens(F.col("text")).alias("tokens"))
    units = docs.filter(f"rep < {first + 2}").selectExpr("rep", "rep AS vector_class", "array(1.0D, 0.0D) AS u")
    found = {(r.a - first, r.b - first, r.class_a - first, r.class_b - first, r.semantic) for r in lx.pairs_above(texts, 0.1, units).collect()}
    assert found == {(0, 1, 0, 1, 1.0), (0, 2, 0, 2, None), (1, 2, 1, 2, None)}


def test_words_of_given_pairs_are_sent(spark, monkeypatch):
    """given pairs meet words, grams are made after the last shuffle; a text without words or without a text scores 0; few pairs of neighbours share a range."""
    monkeypatch.setattr(lx, "BLOCK_TEXTS", 40)
    docs = corpus(spark).unionByName(spark.createDataFrame([(120, None), (121, ""), (122, "the")], "doc_id long, text string"))
    texts = docs.select(docs.doc_id.alias("rep"), lx.content_tokens(docs.text).alias("tokens"))
    pairs = docs.selectExpr("doc_id AS a", "doc_id + 1 AS b")
    grams = lx.gram_vectors(texts.filter("size(tokens) > 0"))
    plans, plain = [], lx.stage
    monkeypatch.setattr(lx, "stage", lambda df, name: plans.append((name, df)) or plain(df, name))
    for given in (pairs, pairs.crossJoin(docs.selectExpr("doc_id AS c")).selectExpr("a", "c AS b").filter("a < b")):
        found = lx.score_pairs(given, texts)
        tree = plan(found)
        # of the words' columns only the string is shuffled, and grams are hashed above every shuffle
        assert not any("hashpartitioning" in line and ("grams" in line or "tokens" in line) for line in tree.splitlines())
        assert "xxhash64" in tree.split("Exchange")[0] + tree.split("Exchange")[1]
        got, held = ({(r.a, r.b): r.lexical for r in df.collect()} for df in (found, lx.score_pairs(given, grams)))
        assert got == held and got[(119, 120)] == 0.0 and sum(s > 0 for s in got.values()) > 100
    assert "grams" not in [name for name, _ in plans]
    dealt = [df for name, df in plans if name == "dealt_pairs"][0]
    assert dealt.select("x").distinct().count() <= 4
    assert dealt.selectExpr("x", "explode(array(a, b)) AS rep").distinct().count() <= 123 + 1 + 4


def test_scores_of_blocks_by_matrices_are_those_of_single_texts(spark, monkeypatch):
    """F1: many texts at once, some grams by products of matrices and the others in several steps, also where counts exceed single precision."""
    rng = random.Random(5)
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words[: 10 + i % 50]) for _ in range(40)) for i in range(90)]
    for longest in (0, 5000):
        rows = texts + [" ".join(["loud"] * longest + [rng.choice(words) for _ in range(30)]) for _ in range(4)]
        _, held = lx.collapse(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "doc_id", "text")
        monkeypatch.setattr(lx, "BLOCK_GRAMS", 3000)
        monkeypatch.setattr(lx, "MATRIX_COST", 1e12)
        single = {(r.a, r.b): r.lexical for r in lx.pairs_above(held, 0.2).collect()}
        for name, value in (("MATRIX_COST", 0), ("MATRIX_GRAMS", 20), ("MATRIX_ROWS", 7), ("PLACES_AT_ONCE", 50)):
            monkeypatch.setattr(lx, name, value)
        assert len(single) > 100 and {(r.a, r.b): r.lexical for r in lx.pairs_above(held, 0.2).collect()} == single


def test_a_block_with_itself_looks_at_grams_of_two_texts(spark, monkeypatch):
    """F8, F9: a gram that one text of the block has is no shared gram; counts take as few bytes as the block's largest needs."""
    monkeypatch.setattr(lx, "SLOTS", 4)
    texts = [f"only{i} alone{i} sole{i} " + "common words here often " * (1 + i % 3) for i in range(40)]
    for longest, width in ((3, 1), (700, 2)):
        rows = [*texts, "often " * longest]
        _, held = lx.collapse(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "doc_id", "text")
        (row,) = lx._packed(held, None).collect()
        block, sides, plain = lx._Texts(row, ""), [], lx._Side
        monkeypatch.setattr(lx, "_Side", lambda *given: sides.append(plain(*given)) or sides[-1])
        found = lx._block_pairs(block, block, True, 0.3)
        monkeypatch.setattr(lx, "_Side", plain)
        assert len(row.counts) == width * len(block.number) and int(block.counts.max()) == longest
        in_texts = {n: len(set(block.row[block.number == n])) for n in set(block.number)}
        assert all(len(side.number) == sum(k for k in in_texts.values() if k > 1) for side in sides) and 1 in in_texts.values()
        scored = lx.score_pairs(spark.createDataFrame([(a, b) for a in range(41) for b in range(a + 1, 41)], "a long, b long"), lx.gram_vectors(held))
        expected = {(r.a, r.b): r.lexical for r in scored.filter("lexical >= 0.3").collect()}
        assert expected and {(int(a), int(b)): s for a, b, s in zip(found.a, found.b, found.lexical)} == expected
