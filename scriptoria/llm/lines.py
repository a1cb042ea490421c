"""Operator 4: removal of repeated three-line windows. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, stage


def _windows(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, print, pos, h1, h2): 128-bit hash of every ``size`` consecutive lines."""
    def hashes(lines, *salt):
        each = F.transform(lines, lambda line: F.xxhash64(line, *salt))
        return let(each, lambda h: F.transform(
            F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(size)), *salt)
        ))

    lines = F.split(F.col(text), "\n", -1)
    both = let(lines, lambda v: F.when(F.size(v) >= size, F.arrays_zip(
        hashes(v).alias("h1"), hashes(v, F.lit("second")).alias("h2")
    )))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("print"), F.posexplode(both))
    return rows.select("key", "print", "pos", "col.h1", "col.h2")


def _merged(starts: Column, size: int) -> Column:
    """Spans that windows at the sorted ``starts`` cover, those that touch joined: arrays ``starts`` and ``ends``."""
    return F.struct(
        F.filter(starts, lambda x, i: (i == 0) | (x > F.get(starts, i - 1) + size)).alias("starts"),
        F.transform(
            F.filter(starts, lambda x, i: (i == F.size(starts) - 1) | (F.get(starts, i + 1) > x + size)), lambda x: x + size
        ).alias("ends"),
    )


def remove_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``docs`` with ``text`` without the lines of repeated windows, and ``n_lines``, ``n_removed``.

    Every ``size`` consecutive lines are a window, and windows overlap. Of equal windows anywhere in the
    table, the first in the order (key, text hash, position) stays; the lines that later ones cover
    are removed, once however many windows cover them. Windows count per hash before they meet their
    first place, so a window that fills the table is one row on one side of the join.

    Null texts stay null (with 0 lines); texts of fewer lines stay as they are; a text may become empty.
    Null keys come first in the order. Rows with equal key and text count as one document and get the
    same result; rows with equal keys and other texts are apart. Lines are what stands between
    line feeds. Columns are kept; ``n_lines`` and ``n_removed`` get a longer name where the table has one.
    """
    windows = _windows(docs, key, text, size)
    place = F.struct("key", "print", "pos")
    first = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    first = stage(first, "first-windows")  # read again, it has an exchange of its own, so that the join can split a hot window
    later = windows.join(first, ["h1", "h2"]).filter(place > F.col("first")).select("key", "print", "pos")
    covered = later.groupBy("key", "print").agg(F.collect_set("pos").alias("starts"))
    names = {n: fresh(n, docs) for n in ("key__", "print__", "covered__", "result__", "n_lines", "n_removed")}
    covered = covered.select(
        F.col("key").alias(names["key__"]), F.col("print").alias(names["print__"]), F.col("starts").alias(names["covered__"])
    )
    joined = docs.join(
        covered, docs[key].eqNullSafe(covered[names["key__"]]) & (F.xxhash64(docs[text]) == covered[names["print__"]]), "left"
    )
    lines = F.split(F.col(text), "\n", -1)
    cleaned = let(F.array_sort(names["covered__"]), lambda s: let(_merged(s, size), lambda m: let(lines, lambda v: F.struct(
        F.array_join(F.flatten(F.transform(
            F.arrays_zip(F.concat(F.array(F.lit(0)), m["ends"]).alias("a"), F.concat(m["starts"], F.array(F.size(v))).alias("b")),
            lambda gap: F.slice(v, gap["a"] + 1, F.greatest(gap["b"] - gap["a"], F.lit(0))),
        )), "\n").alias("text"),
        F.aggregate(F.zip_with(m["starts"], m["ends"], lambda a, b: b - a), F.lit(0), lambda x, y: x + y).alias("removed"),
    ))))
    has = F.col(names["covered__"]).isNotNull()
    counted = joined.withColumn(names["result__"], F.when(has, cleaned))
    result = F.when(has, F.col(names["result__"])["text"]).otherwise(F.col(text))
    others = [result.alias(text) if c == text else F.col(c) for c in docs.columns]
    return counted.select(
        *others,
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias(names["n_lines"]),
        F.when(has, F.col(names["result__"])["removed"]).otherwise(F.lit(0)).cast("long").alias(names["n_removed"]),
    )
