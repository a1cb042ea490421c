"""Per-row statistics over arrays, so that document features need no shuffle.

Helpers that read a column inside a lambda take a *column name*: the array must be its own
projected column, otherwise the optimizer may inline its definition and evaluate it per element.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_run_lengths(df: DataFrame, tokens: str, out: str) -> DataFrame:
    """Add ``out``: how often each distinct element of ``tokens``, none of them null, occurs, in ascending order of the elements.

    Sorting puts equal elements side by side; the lengths of the runs are the frequencies.
    """
    s, b = f"__sorted_{out}", f"__starts_{out}"
    df = df.withColumn(s, F.sort_array(F.col(tokens)))
    n = F.size(s)
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(
        b, F.filter(index, lambda i: (i == 0) | (F.get(F.col(s), i) != F.get(F.col(s), i - 1)))
    )
    lengths = F.transform(F.col(b), lambda x, j: F.coalesce(F.get(F.col(b), j + 1), F.size(s)) - x)
    return df.withColumn(out, lengths).drop(s, b)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, also where a lambda reads it for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def placed(values: Column) -> Column:
    """(x, i): elements and their places from 0, sorted, so that equal elements are side by side."""
    return F.sort_array(F.transform(values, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))


def seen_before(held: Column) -> Column:
    """For each element of `placed` values, in order of place: one more than the place of the last equal one before it, or 0.

    `place_of` and `seen_of` read the two numbers, which are one long so that they sort fast.
    """
    last = lambda e, j: F.when((j > 0) & (F.get(held, j - 1)["x"] == e["x"]), F.get(held, j - 1)["i"] + 1).otherwise(0)
    return F.sort_array(F.transform(held, lambda e, j: F.shiftleft(e["i"].cast("long"), 32) + last(e, j)))


def seen_behind(held: Column) -> Column:
    """`seen_before` of the values in reverse order, from the same sorted elements."""
    n = F.size(held)
    following = lambda e, j: F.when(F.get(held, j + 1)["x"] == e["x"], n - F.get(held, j + 1)["i"]).otherwise(0)
    return F.sort_array(F.transform(held, lambda e, j: F.shiftleft((n - 1 - e["i"]).cast("long"), 32) + following(e, j)))


def place_of(entry: Column) -> Column:
    return F.shiftright(entry, 32).cast("int")


def seen_of(entry: Column) -> Column:
    return entry.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def last_places(values: Column) -> Column:
    """For each element the place of the last equal one before it, from 0, or -1."""
    return F.transform(let(placed(values), seen_before), lambda e: seen_of(e) - 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def total_of_squares(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long") * x)


def variance_numerator(values: Column) -> Column:
    """n * sum(x^2) - sum(x)^2: the population variance times n^2, exact for integers."""
    s = total(values)
    return F.size(values) * total_of_squares(values) - s * s


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-grams joined by a space (tokens never contain one)."""
    shifted = [F.slice(tokens, k + 1, F.greatest(F.size(tokens) - n + 1, F.lit(0))) for k in range(n)]
    return F.transform(F.arrays_zip(*[s.alias(f"g{k}") for k, s in enumerate(shifted)]),
                       lambda z: F.concat_ws(" ", *[z[f"g{k}"] for k in range(n)]))


def ngram_hashes(hashes: Column, n: int) -> Column:
    """64-bit hashes of the contiguous n-grams, from the hashes of the tokens."""
    shifted = [F.slice(hashes, k + 1, F.greatest(F.size(hashes) - n + 1, F.lit(0))) for k in range(n)]
    return reduce(lambda left, right: F.zip_with(left, right, lambda x, y: F.xxhash64(x, y)), shifted)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0.0 when there is nothing to divide by."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))
