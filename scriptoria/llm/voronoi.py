"""Operator 1: exact top-k inner products by a Voronoi kNN join."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage
from .vectors import Packing, integer_vectors, packed

#: Pivots, whose cells group queries and data alike.
PIVOTS = 16
#: Rows of data and queries that meet in one task, and queries scored at once within it.
DATA_BLOCK, QUERY_BLOCK, CHUNK = 8192, 4096, 256
#: Share of a bound's terms by which rounding could lower it.
SLACK = 1e-9


def _kind(packing: Packing) -> str:
    """Type in which inner products are exact, the fastest first."""
    bound = packing.most * packing.most * packing.size
    return "float32" if bound < 1 << 24 else "float64" if bound < 1 << 53 else "int64" if bound < 1 << 62 else "object"


def _placed(df: DataFrame, packing: Packing, pivots: np.ndarray) -> DataFrame:
    """Add the cell of the nearest pivot and the distance to it."""
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType())])
    squares = (pivots**2).sum(axis=1)

    def place(batches):
        for batch in batches:
            x = packing.matrix(batch.column(1).to_pylist()).astype(float)
            away = np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + squares, 0)
            cell = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(away[np.arange(len(x)), cell]))], names=schema.names
            )

    return df.mapInArrow(place, schema)


def group_bounds(pivots: np.ndarray, reach: np.ndarray, nearest: list[tuple[int, object, float]], k: int) -> np.ndarray:
    """Per group of queries, a score that the k-th best partner of every query in it reaches at least.

    ``reach``: greatest distance of a group's queries from its pivot. ``nearest``: (cell, id, distance) of the data
    rows nearest to their pivots, more than k ids per cell. Every id counts once, as one may be the query's own, whose rows, however
    many, are no partners. With q = p + a and d = c + b, q.d >= p.c - |p||b| - |a|(|c| + |b|).
    """
    out = np.full(len(pivots), -np.inf)
    ids = list(dict.fromkeys(i for _, i, _ in nearest))
    if len(ids) > k:
        number = {i: n for n, i in enumerate(ids)}
        cell, which, b = np.array([c for c, _, _ in nearest]), np.array([number[i] for _, i, _ in nearest]), np.array([x for _, _, x in nearest])
        size = np.sqrt((pivots**2).sum(axis=1))
        for g in range(len(pivots)):
            low = (pivots @ pivots[g])[cell] - size[g] * b - reach[g] * (size[cell] + b)
            low -= SLACK * (1 + (size[g] + reach[g]) * (size[cell] + b))
            best = np.full(len(ids), -np.inf)
            np.maximum.at(best, which, low)
            out[g] = np.sort(best)[::-1][k]
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row the k greatest scores with their ids, ties to smaller ids; ``ids`` ascending, the own id left out."""
    n = len(ids)
    out = []
    if scores.dtype != object and np.abs(scores).max(initial=0) < 1 << 40 and n < 1 << 20:
        # one integer per pair that sorts by score and then by id
        code = scores.astype(np.int64) * n + (n - 1 - np.arange(n))
        floor = -(1 << 62)
        code[own] = floor
        take = min(k, n)
        top = -np.partition(-code, take - 1, axis=1)[:, :take] if take < n else code
        top = -np.sort(-top, axis=1)
        for row in top:
            row = row[row > floor]
            out.append((ids[n - 1 - row % n], row // n))
    else:
        for row, mine in zip(scores, own):
            order = sorted(np.flatnonzero(~mine).tolist(), key=lambda i: -int(row[i]))[:k]
            out.append((ids[order], np.array([int(row[i]) for i in order], dtype=np.int64)))
    return out


def _solved(homes: DataFrame, guests: DataFrame, packing: Packing, k: int, result: str) -> DataFrame:
    """(row, query_id, id, score): of each query (row, id, b, g) its k best in each block of its group's data (id, b, g).

    A group meets in a grid of blocks of at most about `DATA_BLOCK` rows and `QUERY_BLOCK` queries.
    """
    def blocks(frame, most):
        counts = {r.g: math.ceil(r.n / most) for r in frame.groupBy("g").agg(F.count("*").alias("n")).collect()}
        split = F.create_map(*(F.lit(v) for x in counts.items() for v in x)) if counts else None
        return F.coalesce(F.element_at(split, F.col("g")), F.lit(1)) if counts else F.lit(1)

    data_blocks, query_blocks = blocks(homes, DATA_BLOCK), blocks(guests, QUERY_BLOCK)
    salt = lambda n, word: F.pmod(F.xxhash64("id", "b", F.lit(word)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    homes = homes.select("id", "b", "g", salt(data_blocks, "data").alias("db"), query_blocks.alias("n")).withColumn("qb", every(F.col("n"))).drop("n")
    guests = guests.select("row", "id", "b", "g", salt(query_blocks, "query").alias("qb"), data_blocks.alias("n")).withColumn("db", every(F.col("n"))).drop("n")
    kind = _kind(packing)

    def solve(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"row": [], "query_id": [], "id": [], "score": []})
        own = own.sort_values("id", ignore_index=True)
        ids, x = own["id"].to_numpy(), packing.matrix(own["b"]).astype(kind)
        rows, names, y = asked["row"].to_numpy(), asked["id"].to_numpy(), packing.matrix(asked["b"]).astype(kind)
        found_r, found_q, found_i, found_s = [], [], [], []
        for at in range(0, len(names), CHUNK):
            part = names[at : at + CHUNK]
            for row, name, (i, s) in zip(rows[at : at + CHUNK], part, _best(y[at : at + CHUNK] @ x.T, ids, k, part[:, None] == ids[None, :])):
                found_r.append(np.full(len(i), row))
                found_q.append(np.full(len(i), name))
                found_i.append(i)
                found_s.append(s)
        return pd.DataFrame({"row": np.concatenate(found_r), "query_id": np.concatenate(found_q), "id": np.concatenate(found_i), "score": np.concatenate(found_s).astype(np.int64)})

    return homes.groupBy("g", "qb", "db").cogroup(guests.groupBy("g", "qb", "db")).applyInPandas(solve, result)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", order).filter(F.col("rank") <= k)


def route(d: DataFrame, packing: Packing, points: np.ndarray, reach: np.ndarray, bounds: np.ndarray, live: list[int]) -> DataFrame:
    """(id, b, g): each data row once for each other group of queries in which it may be among the k best of one.

    The row's product with the group's pivot, plus what its length and the group's reach can add, has to reach the group's bound.
    """
    sizes = np.sqrt((points[live] ** 2).sum(axis=1))

    def groups(batches):
        for batch in batches:
            x = packing.matrix(batch.column(1).to_pylist()).astype(float)
            cell = batch.column(2).to_numpy()
            length = np.sqrt((x**2).sum(axis=1))[:, None]
            most = x @ points[live].T + length * reach[live] + SLACK * (1 + length * (sizes + reach[live]))
            sent = (most >= bounds[live]) & (cell[:, None] != np.array(live)[None])
            row, g = np.nonzero(sent)
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(row)) for c in batch.columns[:2]), pa.array(np.array(live, dtype=np.int32)[g])], names=["id", "b", "g"]
            )

    schema = T.StructType([*d.schema.fields[:2], T.StructField("g", T.IntegerType())])
    return d.select("id", "b", "cell").mapInArrow(groups, schema)


def nearest(
    data: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", factor: float = 64.0, pivots: int = PIVOTS
) -> DataFrame:
    """(query_id, rank, id, score): the k greatest inner products of floor(factor * x) of each query, itself left out.

    Pivots are the first rows by hash. Queries and data fall into the cells of their nearest pivots. Queries first meet the data of
    their own cell. The least k-th score that they find there, and the summaries of all cells (greatest distance, the k + 1 nearest
    ids), each bound what the k best of a group reach (`group_bounds`); a row of another cell is sent only to groups whose bound
    it can reach (`route`). Groups meet their data in blocks of bounded size, and each block gives k
    rows per query, of which the best are ranked. Only pivots and summaries, bounded by their number, reach the driver.

    Vectors that are null, have null or non-finite components, or a null key take no part. Rows with the query's key are never its
    partners; other repeated rows all are, and each of several queries with one key and vector stands for itself. Shorter vectors
    count as ending in zeros. Components beyond 2 ** 50 are held there; a result beyond 64 bits raises an error.
    Fewer than k partners: all. Empty tables give no rows. Other columns are not read.
    """
    spark = data.sparkSession
    d, q = (integer_vectors(df.filter(F.col(key).isNotNull()), vector, factor, id=F.col(key)) for df in (data, queries))
    packing = Packing.of(d, q)
    d = stage(packed(d, packing), "data-vectors")
    kind = d.schema["id"].dataType.simpleString()
    result = f"row long, query_id {kind}, id {kind}, score long"
    chosen = [bytes(r.b) for r in d.orderBy(F.xxhash64("id"), "id", "b").limit(pivots).collect()]
    if not chosen:
        return spark.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score long")
    points = packing.matrix(chosen).astype(float)
    d = stage(_placed(d, packing, points), "data-cells")
    q = stage(_placed(packed(q, packing), packing, points).withColumn("row", F.monotonically_increasing_id()), "query-cells")

    guests = q.select("row", "id", "b", F.col("cell").alias("g"))
    own = stage(_ranked(_solved(d.select("id", "b", F.col("cell").alias("g")), guests, packing, k, result), k).drop("rank"), "own-cell")
    kth = own.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") == k)
    groups = q.join(kth, "row", "left").groupBy("cell").agg(F.max("dist").alias("reach"), F.min(F.coalesce("score", F.lit(-(1 << 63)))).alias("least")).collect()
    live = sorted(r.cell for r in groups)
    reach, reached = np.zeros(len(points)), np.full(len(points), -np.inf)
    for r in groups:
        reach[r.cell], reached[r.cell] = r.reach, r.least if r.least > -(1 << 63) else -np.inf
    by_distance = W.partitionBy("cell").orderBy("dist", "id")
    summary = d.groupBy("cell", "id").agg(F.min("dist").alias("dist")).withColumn("r", F.row_number().over(by_distance)).filter(F.col("r") <= k + 1)
    bounds = np.maximum(reached, group_bounds(points, reach, [(r.cell, r.id, r.dist) for r in summary.collect()], k))
    if not live:
        return spark.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score long")
    others = stage(route(d, packing, points, reach, bounds, live), "routed")
    found = own.unionByName(_solved(others, guests, packing, k, result))
    return _ranked(found, k).select("query_id", "rank", "id", "score")
