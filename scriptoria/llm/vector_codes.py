"""Operator 11: vectors as short codes of codebook entries, found by equal-average search."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage
from .vectors import Packing, integer_vectors, packed

PARTS, ENTRIES, ROUNDS, FACTOR = 16, 64, 2, 256.0


def equal_average_search(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry of ``book`` nearest to each point, ties to the lower index.

    Entries are sorted by the sum of their components. From its own sum a point expands outward, nearest sum first;
    as a squared distance is at least the squared gap of the sums over the dimension, it stops when that strictly exceeds its best.
    """
    width, m = book.shape[1], len(book)
    order = np.argsort(book.sum(axis=1), kind="stable")
    entries, sums = book[order], book.sum(axis=1)[order]
    own = points.sum(axis=1)
    right = np.searchsorted(sums, own)
    left = right - 1
    index, best = np.full(len(points), m), np.full(len(points), -1, dtype=points.dtype)
    live = np.arange(len(points))
    while len(live):
        lower, upper = left[live], right[live]
        below, above = own[live] - sums[np.maximum(lower, 0)], sums[np.minimum(upper, m - 1)] - own[live]
        up = (upper < m) & ((lower < 0) | (above <= below).astype(bool))
        gap = np.where(up, above, below)
        going = ((lower >= 0) | (upper < m)) & ((best[live] < 0) | (gap * gap <= best[live] * width)).astype(bool)
        live, up = live[going], up[going]
        at = np.where(up, right[live], left[live])
        away = ((points[live] - entries[at]) ** 2).sum(axis=1)
        better = ((best[live] < 0) | (away < best[live]) | ((away == best[live]) & (order[at] < index[live]))).astype(bool)
        best[live[better]], index[live[better]] = away[better], order[at[better]]
        right[live[up]] += 1
        left[live[~up]] -= 1
    return index, best


@dataclass(frozen=True)
class Codebooks:
    """One codebook of integer entries per part of the vectors, as arrays [entry, position]."""

    packing: Packing
    books: list[np.ndarray]

    @property
    def width(self) -> int:
        return self.books[0].shape[1]

    @property
    def digest(self) -> str:
        """sha256 of all entries' components in the order of part, entry and position."""
        return hashlib.sha256(",".join(str(int(x)) for book in self.books for x in book.ravel()).encode()).hexdigest()

    def points(self, column) -> np.ndarray:
        """[row, part, position]; Python integers where squared distances could pass 64 bits."""
        return parts_of(self.packing.matrix(column), len(self.books), self.packing)

    def assign(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry indexes, squared distances), both [row, part]."""
        found = [equal_average_search(points[:, p], book) for p, book in enumerate(self.books)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def parts_of(x: np.ndarray, parts: int, packing: Packing) -> np.ndarray:
    width = -(-packing.size // parts)
    safe = 4 * packing.most**2 * (width * parts) ** 2 < 1 << 62
    wide = np.zeros((len(x), width * parts), dtype=np.int64)
    wide[:, : x.shape[1]] = x
    return (wide if safe else wide.astype(object)).reshape(len(x), parts, width)


def _updated(rows: DataFrame, held: Codebooks) -> Codebooks:
    """Every entry replaced by the floor of the mean of the parts that it is nearest to; unused ones stay.

    Each task sums its own rows, the sums are added by part, entry and position; the driver gets as many
    rows as the codebooks have components.
    """
    shape = (len(held.books), len(held.books[0]), held.width)

    def sums(batches):
        total, n = np.zeros(shape, dtype=np.int64 if held.packing.most < 1 << 31 else object), np.zeros(shape[:2], dtype=np.int64)
        for batch in batches:
            points = held.points(batch.column(0).to_pylist())
            index, _ = held.assign(points)
            for p in range(shape[0]):
                np.add.at(total[p], index[:, p], points[:, p])
                n[p] += np.bincount(index[:, p], minlength=shape[1])
        part, entry = np.nonzero(n)
        columns = [
            pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]),
            pa.array([[Decimal(int(x)) for x in row] for row in total[part, entry]], pa.list_(pa.decimal128(38, 0))),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

    found = rows.select("b").mapInArrow(sums, "part int, entry int, n long, sums array<decimal(38,0)>")
    added = found.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    books = [book.copy() for book in held.books]
    for r in added.collect():
        books[r.part][r.entry, r.at] = int(r.s) // r.n
    return Codebooks(held.packing, books)


def train(rows: DataFrame, packing: Packing, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of the rows (id, b): the first rows by id, then ``rounds`` rounds over all rows; None without rows."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "b").limit(entries).collect()
    if not first:
        return None
    start = parts_of(packing.matrix([bytes(r.b) for r in first]), parts, packing)
    books = Codebooks(packing, [start[:, p].copy() for p in range(parts)])
    for _ in range(rounds):
        books = _updated(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` with ``b`` replaced by code, a byte for each part, and error, the squared distance to the coded vector."""
    schema = T.StructType([f for f in rows.schema.fields if f.name != "b"] + [T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    at = rows.columns.index("b")

    def run(batches):
        for batch in batches:
            index, away = books.assign(books.points(batch.column(at).to_pylist()))
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            codes = pa.array([r.tobytes() for r in index.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([*kept, codes, pa.array(away.sum(axis=1).tolist(), pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, factor: float = FACTOR,
) -> tuple[DataFrame, Codebooks | None]:
    """((id, label, code, error, label_error), codebooks): every usable vector as one byte for each of its parts.

    Components become floor(factor * x), vectors are cut into ``parts`` equal parts, each with a codebook of up to 256
    ``entries``. It starts as the parts of the smallest keys (equal keys by their bytes, null keys last). In each
    round every part is assigned to its nearest entry by `equal_average_search`, then every entry becomes the floor of its parts' mean.
    Sums are made per task before they are added, so a vector or label that many rows share costs no more; the driver holds the
    codebooks alone. ``error`` is a row's squared distance to its coded vector, ``label_error`` the sum over its label.

    Vectors that are null or hold null or non-finite components are left out; null keys and labels stay, nulls of a label count together;
    repeated rows each have a code. Shorter vectors count as ending in zeros, as do those whose length the parts do not
    divide. Fewer rows than entries: as many entries as rows. Components beyond 2 ** 50 are held there; an error
    beyond 64 bits ends the job. An empty table gives no rows and no codebooks. Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index takes one byte")
    held = integer_vectors(vectors, vector, factor, id=F.col(key), label=F.col(label))
    packing = Packing.of(held)
    rows = stage(packed(held, packing), "integer-vectors")
    books = train(rows, packing, parts, entries, rounds)
    if books is None:
        empty = rows.select("id", "label", F.col("b").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.withColumn("label_error", F.lit(0).cast("long")), None
    coded = stage(encode(rows, books), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"])).drop("of"), books
