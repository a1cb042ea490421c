"""Operator 13: whitening of vectors by shifted CholeskyQR."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage
from .vectors import Packing, integer_vectors, packed

COMPONENTS, FACTOR = 4, 256.0
UNIT = float(np.finfo(np.float64).eps) / 2
#: Passes that orthogonalise; two after the shifted one are enough for any data of full rank.
PASSES = 8
#: Eigenvalues of a Gram matrix this near to 0 or 1 count as such.
SETTLED = 1e-10
#: Components under this share of the variance are rounding errors.
LEAST_SHARE = 1e-13


def solve(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a times the inverse of the upper triangular r, by forward substitution."""
    q = np.empty(a.shape, order="F")
    for j in range(a.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def gram(rows: DataFrame, packing: Packing, change: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Gram matrix of ``change(vectors)`` over all rows (column b); None without rows.

    Each task adds up its own matrix; the matrices meet one row of them at a time, so a group holds a row's numbers for each task
    and the driver gets one matrix.
    """
    def own(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                y = change(packing.matrix(batch.column(0).to_pylist()))
                total = y.T @ y + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array([r.tobytes() for r in total], pa.binary())], names=["at", "values"]
            )

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(part["values"].iloc[0]) // 8)
        for values in part["values"]:
            total += np.frombuffer(values)
        return pd.DataFrame({"at": part["at"].iloc[:1], "values": [total.tobytes()]})

    schema = "at int, values binary"
    found = rows.select("b").mapInArrow(own, schema).groupBy("at").applyInPandas(add, schema).collect()
    return np.stack([np.frombuffer(bytes(r["values"])) for r in sorted(found)]) if found else None


def sums_of(rows: DataFrame, packing: Packing) -> tuple[int, list[int]]:
    """(number of rows, exact sums of their components)."""
    def own(batches):
        n, total = 0, np.zeros(packing.size, dtype=np.int64 if packing.most < 1 << 31 else object)
        for batch in batches:
            n += batch.num_rows
            total = total + packing.matrix(batch.column(0).to_pylist()).astype(total.dtype).sum(axis=0)
        yield pa.RecordBatch.from_pydict(
            {"at": list(range(packing.size)), "n": [n] * packing.size, "total": [str(int(t)) for t in total]}, pa.schema([("at", pa.int32()), ("n", pa.int64()), ("total", pa.string())])
        )

    found = rows.select("b").mapInArrow(own, "at int, n long, total string")
    added = {r["at"]: (r.n, int(r.total)) for r in found.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    return (added[0][0], [added[i][1] for i in range(packing.size)]) if added else (0, [0] * packing.size)


def _settled(g: np.ndarray) -> bool:
    values = np.linalg.eigvalsh(g)
    return bool(np.minimum(np.abs(values - 1), np.abs(values)).max() <= SETTLED)


def triangle(rows: DataFrame, packing: Packing, n: int, mean: np.ndarray) -> np.ndarray | None:
    """R of the centred rows' QR factorisation; None if all rows are the same.

    The first Gram matrix is shifted, so that its Cholesky factor exists whatever the condition. Rows are solved by the factors found
    so far, their Gram matrix gives the next factor, until it is the identity. Directions without variance
    get a small shift each time, by which the composed factor loses them.
    """
    factors: list[np.ndarray] = []

    def orthogonal(x: np.ndarray) -> np.ndarray:
        q = x - mean
        for r in factors:
            q = solve(q, r)
        return q

    for step in range(PASSES):
        g = gram(rows, packing, orthogonal)
        if g is None or not g.any():
            return None
        if step and _settled(g):
            break
        d, norm = len(g), float(np.linalg.norm(g, 2))
        if not step:
            shift = 11 * (n * d + d * (d + 1)) * UNIT * norm
        else:
            shift = 100 * d * UNIT * norm if np.linalg.eigvalsh(g)[0] < 100 * d * UNIT * norm else 0.0
        factors.append(np.linalg.cholesky(g + shift * np.eye(d)).T)
    whole = factors[0]
    for r in factors[1:]:
        whole = r @ whole
    return whole


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: rows' count, sums and centre, unit components by falling eigenvalue, explained shares."""

    packing: Packing
    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return _projected(x, self.sums, self.n, self.components, self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum of (n * x - sums) ** 2 of each row, exact."""
        safe = (2 * self.n * self.packing.most) ** 2 * self.packing.size < 1 << 62
        away = x.astype(np.int64 if safe else object) * self.n - np.array(self.sums, dtype=np.int64 if safe else object)
        return [int(v) for v in (away * away).sum(axis=1)]


def _projected(x, sums, n, components, values):
    return (x - np.array([s / n for s in sums])) @ components.T / np.sqrt(values)


def fit(rows: DataFrame, packing: Packing, components: int = COMPONENTS) -> Whitening:
    """Fitted on the rows (column b), which are to be distinct."""
    n, sums = sums_of(rows, packing)
    none = np.zeros(0)
    r = triangle(rows, packing, n, np.array([s / n for s in sums])) if n else None
    if r is None:
        return Whitening(packing, n, sums, np.zeros((0, packing.size)), none, none, 0.0)
    _, s, vt = np.linalg.svd(r)
    shares = s**2 / (s**2).sum()
    k = int((shares[:components] > LEAST_SHARE).sum())
    axes, values = vt[:k], s[:k] ** 2 / n
    axes = axes * np.sign(axes[np.arange(k), np.abs(axes).argmax(axis=1)])[:, None]

    def told(x: np.ndarray) -> np.ndarray:
        return np.hstack([_projected(x, sums, n, axes, values), np.ones((len(x), 1))])

    g = gram(rows, packing, told) / n
    error = np.abs(g[:k, :k] - np.outer(g[k, :k], g[k, :k]) - np.eye(k)).max()
    return Whitening(packing, n, sums, axes, values, shares[:k], float(error))


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, factor: float = FACTOR
) -> tuple[DataFrame, Whitening]:
    """((id, component, deviation, whitened), fit): each usable vector projected on the first principal components, scaled to unit variance.

    Components of vectors become floor(factor * x). The fit is over each distinct integer vector once, so copies do not weigh. Gram matrices
    of the centred rows, solved by the triangular factors found so far, are added over the cluster pass by pass
    (`triangle`); the composed factor's singular vectors are the components. What reaches the driver and each
    task is a few matrices of the vectors' dimension squared. ``deviation`` is decimal(38, 0).

    Vectors that are null or hold null or non-finite components are left out. Null and repeated keys stay, a row for each. Shorter vectors count as
    ending in zeros. Fewer directions with variance than ``components``: fewer components; one distinct vector or an
    empty table: no rows. Components beyond 2 ** 50 are held there. Other columns are not read.
    """
    held = integer_vectors(vectors, vector, factor, id=F.col(key))
    packing = Packing.of(held)
    rows = stage(packed(held, packing), "integer-vectors")
    fitted = fit(stage(rows.select("b").distinct(), "distinct-vectors"), packing, components)
    k = len(fitted.values)
    schema = T.StructType([
        rows.schema["id"], T.StructField("component", T.IntegerType()), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.DoubleType())
    ])

    def run(batches):
        for batch in batches if k else ():
            x = packing.matrix(batch.column(1).to_pylist())
            row = np.repeat(np.arange(len(x)), k)
            deviation = pa.array(fitted.deviation(x), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), deviation.take(pa.array(row)),
                pa.array(fitted.whitened(x).ravel()),
            ], names=schema.names)

    return rows.select("id", "b").mapInArrow(run, schema), fitted
