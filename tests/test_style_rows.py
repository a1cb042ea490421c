"""Style features in the row: sorts and patterns that a row runs, and equality with plain definitions."""

import random

from pyspark.sql import functions as F

from scriptoria.functions import text as tx
from scriptoria.operators import stylometry as st


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def factors(words, threshold=0.72):
    count, seen, n = 0, set(), 0
    for word in words:
        seen.add(word)
        n += 1
        if len(seen) / n < threshold:
            count, seen, n = count + 1, set(), 0
    return count + (n > 0)


def test_mtld_sorts_a_text_once(spark):
    """Both readings come from one sort of the words, without a comparison function."""
    rng = random.Random(3)
    texts = [[f"w{rng.randint(0, 1 + size // 3)}" for _ in range(size)] for size in (50, 51, 75, 200, 700)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, w array<string>")
    got = rows.select("id", st.mtld(F.col("w")).alias("m"))
    assert "array_sort(" not in plan(got) and plan(got).count("sort_array(") == 3  # the words, and the places of either reading
    expected = {i: 2.0 * len(w) / (factors(w) + factors(w[::-1])) for i, w in enumerate(texts)}
    assert {r.id: r.m for r in got.collect()} == expected


def test_cleaned_text_of_all_kinds_of_spaces(spark):
    texts = ["a  b", " a\t b\n\nc ", "a b  \u0085c", "“x” ‘y’ 中— é \U0001f600 _9", "", "   ", None, "a .. b ! ?  . c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    straight = F.regexp_replace(F.translate("t", "“”‘’", "\"\"''"), f"[{tx.WS}]+", " ")
    plain = F.coalesce(F.trim(F.regexp_replace(straight, r"""[^\p{L}\p{N}_ .,!?;:\-'"()]""", "")), F.lit(""))
    for r in rows.select("t", tx.clean_text(F.col("t")).alias("got"), plain.alias("plain")).collect():
        assert r.got == r.plain
    counted = st.prepare(rows, "t").select("sentence_words", F.transform(tx.sentences(tx.clean_text(F.col("t"))), lambda s: F.regexp_count(s, F.lit(st.WORD))).alias("plain"))
    assert all(r.sentence_words == r.plain for r in counted.collect())
