"""Exact similarity join and k-nearest-neighbour join on vectors.

Vectors fall into the cell of their nearest pivot. By the triangle inequality on angles, a vector
can only have partners above a threshold in cells whose angle range it reaches, so it visits
those cells and no others. Small neighbouring cells are one group of about `BLOCK_ROWS` rows. A group is packed into blocks of
bounded size, however many rows it holds, one row per block in a stored table. Blocks whose groups reach each other are joined by a
cross product that reads that table, so a vector is shuffled and written once, whatever number of blocks it meets. A pair of blocks yields
only the pairs that pass, never all of its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as vx
from ..session import SMALL_ROWS, stage

BLOCK_ROWS = 2048
PART_KEYS = 1024  # keys of equal vectors that stand in one row
MAX_PIVOTS = 2048
SLACK = 1e-6  # radians, against rounding in the angle bounds
HELD_BLOCKS = 64  # blocks of queries whose best a task keeps at once


@dataclass(frozen=True)
class Cells:
    """Pivots with the angle range of their cells, each cell's group and the row count of the groups; bounded by the number of pivots."""

    pivots: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    group: np.ndarray
    rows: dict[int, int]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def unit_rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, u) with unit vectors."""
    return vx.with_unit(vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")), "v", "u").select("id", "u")


def pivot_count(n: int) -> int:
    return max(1, min(MAX_PIVOTS, int(math.sqrt(n) / 2)))


def _grouped(pivots: np.ndarray, rows: np.ndarray, group_rows: int) -> np.ndarray:
    """A group for every cell: cells in a chain of nearest pivots, cut whenever ``group_rows`` rows are reached."""
    group, left = np.zeros(len(pivots), dtype="int32"), np.ones(len(pivots), dtype=bool)
    at, number, held = 0, 0, 0
    for _ in range(len(pivots)):
        if held and held + rows[at] > group_rows:
            number, held = number + 1, 0
        group[at], left[at], held = number, False, held + rows[at]
        at = int(np.where(left, pivots @ pivots[at], -np.inf).argmax())
    return group


def build_cells(units: DataFrame, n_pivots: int | None = None, group_rows: int | None = None) -> Cells:
    """Choose pivots by hash order, measure the cells around them and put small ones together.

    Only the pivots and one row of statistics per cell reach the driver. ``group_rows`` of 1 leaves every cell by itself.
    """
    n_pivots = n_pivots or pivot_count(units.count())
    chosen = units.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()
    pivots = np.array([r.u for r in chosen], dtype="float64").reshape(len(chosen), len(chosen[0].u) if chosen else 0)
    return cells_of(place(units, pivots) if len(pivots) else None, pivots, group_rows)


def cells_of(placed: DataFrame | None, pivots: np.ndarray, group_rows: int | None = None) -> Cells:
    """The cells of rows (cell, angle) that `place` has put around ``pivots``."""
    stats = {}
    if placed is not None:
        found = placed.groupBy("cell").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n"))
        stats = {r.cell: r for r in found.collect()}
    cells = range(len(pivots))
    counts = np.array([stats[c].n if c in stats else 0 for c in cells], dtype="int64")
    group = _grouped(pivots, counts, group_rows or BLOCK_ROWS)
    return Cells(
        pivots,
        np.array([stats[c].lo if c in stats else np.inf for c in cells]),
        np.array([stats[c].hi if c in stats else -np.inf for c in cells]),
        group,
        {int(g): int(counts[group == g].sum()) for g in np.unique(group)},
    )


def place(units: DataFrame, pivots: np.ndarray, group: np.ndarray | None = None) -> DataFrame:
    """Add the nearest pivot, or its ``group``, and the angle to it."""
    schema = T.StructType(units.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def nearest(batches):
        for pdf in batches:
            if len(pdf):
                angles = _angles(_matrix(pdf["u"]), pivots)
                best = angles.argmin(axis=1)
                yield pdf.assign(cell=(best if group is None else group[best]).astype("int32"), angle=angles[np.arange(len(pdf)), best])

    return units.mapInPandas(nearest, schema)


def visits(units: DataFrame, cells: Cells, upper_only: bool) -> DataFrame:
    """(id, u, cell, target): every group with a cell that a row can have partners in within its ``reach`` (radians).

    ``cell`` is the row's own group. ``upper_only`` leaves out groups before it, so that a self-join meets each
    pair of groups once.
    """
    rows = _reaching(units, cells, upper_only).drop("reach")
    return rows.withColumn("target", F.explode("targets")).drop("targets")


def _reaching(units: DataFrame, cells: Cells, upper_only: bool) -> DataFrame:
    """``units`` (id, u, reach) with their own group and an array of the groups they visit."""
    schema = T.StructType(
        units.schema.fields
        + [T.StructField("cell", T.IntegerType()), T.StructField("targets", T.ArrayType(T.IntegerType()))]
    )

    def reachable(batches):
        for pdf in batches:
            if len(pdf):
                angles = _angles(_matrix(pdf["u"]), cells.pivots)
                own = angles.argmin(axis=1)
                reach = pdf["reach"].to_numpy()[:, None] + SLACK
                hit = (angles - reach <= cells.farthest) & (angles + reach >= cells.nearest)
                if upper_only:
                    hit &= cells.group >= cells.group[own][:, None]
                targets = [np.unique(cells.group[row]).astype("int32") for row in hit]
                yield pdf.assign(cell=cells.group[own].astype("int32"), targets=targets)

    return units.mapInPandas(reachable, schema)


def _block_count(n: int) -> int:
    return max(1, math.ceil(n / BLOCK_ROWS))


def _meet(
    home: DataFrame, visitors: DataFrame, cells: Cells, kernel: Callable, schema: str, one_block: bool = False
) -> DataFrame:
    """Run ``kernel(home, visitors)`` on a grid of bounded blocks per group of cells.

    A group with many home rows or many visitors is split into blocks of about `BLOCK_ROWS`; the
    block counts per group are a table bounded by the number of pivots. With ``one_block`` a
    visitor meets a single block of home rows instead of all of them.
    """
    spark = home.sparkSession
    arriving = {r.target: r["n"] for r in visitors.groupBy("target").agg(F.count("*").alias("n")).collect()}
    sizes = [(c, _block_count(n), _block_count(arriving.get(c, 0))) for c, n in cells.rows.items()]
    grid = F.broadcast(spark.createDataFrame(sizes or [(-1, 1, 1)], "target int, home_blocks int, visit_blocks int"))
    salt = lambda name, n: F.pmod(F.xxhash64("id", F.lit(name)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    homes = home.withColumnRenamed("cell", "target").join(grid, "target").withColumns(
        {"hb": salt("home", "home_blocks"), "vb": every("visit_blocks")}
    )
    guests = visitors.join(grid, "target").withColumns(
        {"vb": salt("visit", "visit_blocks"), "hb": salt("home", "home_blocks") if one_block else every("home_blocks")}
    )
    key = ["target", "hb", "vb"]
    return (
        homes.select(*key, "id", "u").groupBy(*key)
        .cogroup(guests.select(*key, *[c for c in visitors.columns if c != "target"]).groupBy(*key))
        .applyInPandas(kernel, schema)
    )


def _packed(rows: DataFrame, sizes: dict[int, int], name: str) -> DataFrame:
    """(cell, ids, u, floors, targets): rows (id, u, cell, reach, targets) in blocks of about `BLOCK_ROWS` of one group, a row each; staged.

    ``u`` is the block's matrix row by row, ``floors`` the cosines of the reaches, ``targets`` the groups that any of its rows visits.
    """
    grid = F.broadcast(rows.sparkSession.createDataFrame([(c, _block_count(n)) for c, n in sizes.items()] or [(-1, 1)], "cell int, parts int"))
    dealt = rows.join(grid, "cell", "left").withColumn("part", F.pmod(F.xxhash64("id", F.lit("home")), F.coalesce("parts", F.lit(1))).cast("int"))

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        block = {"cell": [key[0]], "ids": [pdf["id"].to_numpy()], "u": [np.concatenate(pdf["u"].to_numpy())]}
        return pd.DataFrame(block | {"floors": [np.cos(pdf["reach"].to_numpy())], "targets": [np.unique(np.concatenate(pdf["targets"].to_numpy()))]})

    schema = f"cell int, ids array<{_id_type(rows)}>, u array<double>, floors array<double>, targets array<int>"
    return stage(dealt.groupBy("cell", "part").applyInPandas(pack, schema), name)


def _cross(guests: DataFrame, homes: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """Run ``kernel`` on batches of pairs of packed blocks, of which the first visits the group of the second."""
    return cross_blocks(guests, homes.select("cell", "ids", "u"), kernel, schema, F.array_contains("guest_targets", F.col("cell")))


def cross_blocks(guests: DataFrame, homes: DataFrame, kernel: Callable, schema: str, meet: Column | None = None) -> DataFrame:
    """Run ``kernel`` on batches of pairs of blocks that ``meet``; the guest's columns begin with ``guest_``, ``guest_block`` is its number.

    A task holds one block of guests and a split of the homes' table, which it reads; only the guests' blocks are dealt out.
    """
    each = guests.select(*[F.col(c).alias(f"guest_{c}") for c in guests.columns], F.monotonically_increasing_id().alias("guest_block"))
    each = each.repartition(max(1, guests.count()))
    met = each.crossJoin(homes)
    met = met if meet is None else met.filter(meet).drop("guest_targets")
    return met.mapInPandas(kernel, schema)


def block_scores(row) -> np.ndarray:
    side = lambda ids, u: np.asarray(u).reshape(len(ids), -1)
    return side(row.guest_ids, row.guest_u) @ side(row.ids, row.u).T


def _id_type(units: DataFrame) -> str:
    return units.schema["id"].dataType.simpleString()


def pairs_above(units: DataFrame, threshold: float, cells: Cells | None = None) -> DataFrame:
    """(a, b, score): every pair a < b of (id, u) rows with cosine >= threshold.

    Vectors that occur many times should be collapsed first (see `distinct_vectors`), because the
    number of equal pairs is quadratic in the number of copies.
    """
    cells = cells or build_cells(units)
    id_type = _id_type(units)
    schema = f"a {id_type}, b {id_type}, score double"
    if not len(cells.pivots):
        return units.sparkSession.createDataFrame([], schema)
    reach = float(np.arccos(np.clip(threshold, -1.0, 1.0)))
    blocks = _packed(_reaching(units.withColumn("reach", F.lit(reach)), cells, upper_only=True), cells.rows, "vector_blocks")

    def kernel(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                scores = block_scores(row)
                g, h = np.nonzero(scores >= threshold)
                guest_ids, home_ids = np.asarray(row.guest_ids)[g], np.asarray(row.ids)[h]
                keep = (guest_ids < home_ids) | (row.guest_cell != row.cell)
                guest_ids, home_ids, values = guest_ids[keep], home_ids[keep], scores[g, h][keep]
                first = guest_ids < home_ids
                yield pd.DataFrame({"a": np.where(first, guest_ids, home_ids), "b": np.where(first, home_ids, guest_ids), "score": values})

    return _cross(blocks, blocks, kernel, schema)


def pairs_with(home: DataFrame, guests: DataFrame, cells: Cells, threshold: float) -> DataFrame:
    """(guest, home, score): every pair of a guest (id, u) and a home row (id, u, cell), placed around the cells' pivots, with cosine >= threshold.

    Home rows of groups that no guest reaches are not sent.
    """
    id_type = _id_type(guests)
    reach = float(np.arccos(np.clip(threshold, -1.0, 1.0)))
    visitors = stage(visits(guests.withColumn("reach", F.lit(reach)), cells, upper_only=False), "visitors")
    group = F.element_at(F.lit([int(g) for g in cells.group]), F.col("cell") + 1).cast("int")
    reached = F.broadcast(visitors.select(F.col("target").alias("cell")).distinct())
    homes = home.select("id", "u", group.alias("cell")).join(reached, "cell", "left_semi")

    def kernel(key, home_pdf: pd.DataFrame, guest: pd.DataFrame) -> pd.DataFrame:
        if not len(home_pdf) or not len(guest):
            return pd.DataFrame({"guest": [], "home": [], "score": []})
        scores = _matrix(guest["u"]) @ _matrix(home_pdf["u"]).T
        g, h = np.nonzero(scores >= threshold)
        return pd.DataFrame({"guest": guest["id"].to_numpy()[g], "home": home_pdf["id"].to_numpy()[h], "score": scores[g, h]})

    return _meet(homes, visitors, cells, kernel, f"guest {id_type}, home {id_type}, score double")


def _top(scores: np.ndarray, ids: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best entries >= floor, ties to the smaller id."""
    allowed = np.flatnonzero(scores >= floor)
    if len(allowed) > k:
        kth = np.partition(scores[allowed], len(allowed) - k)[len(allowed) - k]
        allowed = allowed[scores[allowed] >= kth]
    order = np.lexsort((ids[allowed], -scores[allowed]))[:k]
    return ids[allowed][order], scores[allowed][order]


def best_of_task(batches, k: int, threshold: float, exclude_self: bool, scores_of: Callable):
    """The best of every query among the pairs of blocks of a task; a row is looked at only if a score reaches its k-th best so far."""
    held = {}

    def best(block):
        ids, found, _ = block
        rows = [(q, i, s) for q, (i, s) in zip(ids, found) if len(i)]
        return pd.DataFrame({
            "query": np.repeat([q for q, _, _ in rows], [len(i) for _, i, _ in rows]) if rows else [],
            "neighbour": np.concatenate([i for _, i, _ in rows]) if rows else [], "score": np.concatenate([s for _, _, s in rows]) if rows else [],
        })

    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if row.guest_block not in held:
                if len(held) >= HELD_BLOCKS:
                    yield best(held.pop(next(iter(held))))
                nothing = (np.asarray(row.ids)[:0], np.zeros(0))
                floors = np.maximum(np.asarray(row.guest_floors) - SLACK, threshold)
                held[row.guest_block] = (np.asarray(row.guest_ids), [nothing] * len(floors), floors)
            queries, found, floors = held[row.guest_block]
            scores, ids = scores_of(row), np.asarray(row.ids)
            for q in np.flatnonzero((scores >= floors[:, None]).any(axis=1)):
                if exclude_self:
                    scores[q, ids == queries[q]] = -np.inf
                near = np.flatnonzero(scores[q] >= floors[q])
                i, s = found[q]
                found[q] = _top(np.concatenate([s, scores[q, near]]), np.concatenate([i, ids[near]]), k, threshold)
                if len(found[q][1]) == k:
                    floors[q] = max(floors[q], found[q][1][-1])
    for block in held.values():
        yield best(block)


def nearest(
    corpus: DataFrame, queries: DataFrame, k: int, threshold: float = 0.0, cells: Cells | None = None,
    exclude_self: bool = False,
) -> DataFrame:
    """(query, neighbour, score, rank): the k best corpus rows of each query row, cosine >= threshold.

    A first meeting with one block of the query's own cell gives a lower bound on its k-th best
    score; the second visits only the cells that can beat it. Blocks hand on k rows per query,
    so the final ranking sees little data.
    """
    cells = cells or build_cells(corpus)
    id_type = _id_type(corpus)
    home = place(corpus, cells.pivots, cells.group)

    def best_of(home_pdf: pd.DataFrame, guest: pd.DataFrame, floors: np.ndarray):
        scores = _matrix(guest["u"]) @ _matrix(home_pdf["u"]).T
        ids = home_pdf["id"].to_numpy()
        for row, query in enumerate(guest["id"].to_numpy()):
            if exclude_self:
                scores[row, ids == query] = -np.inf
            yield query, *_top(scores[row], ids, k, floors[row])

    def bound(key, home_pdf, guest):
        if not len(home_pdf) or not len(guest):
            return pd.DataFrame({"id": [], "reach": []})
        found = [(q, s[-1] if len(s) == k else -1.0) for q, _, s in best_of(home_pdf, guest, np.full(len(guest), -1.0))]
        reach = np.arccos(np.clip([max(s, threshold) for _, s in found], -1.0, 1.0))
        return pd.DataFrame({"id": [q for q, _ in found], "reach": reach})

    own = place(queries, cells.pivots, cells.group).withColumn("target", F.col("cell")).drop("angle")
    bounds = stage(_meet(home, own, cells, bound, f"id {id_type}, reach double", one_block=True), "reach")
    widest = float(np.arccos(np.clip(threshold, -1.0, 1.0)))
    reaching = queries.join(bounds, "id", "left").withColumn("reach", F.coalesce("reach", F.lit(widest))).select("id", "u", "reach")
    reaching = stage(_reaching(reaching, cells, upper_only=False), "reaching")
    arriving = {r.cell: r["n"] for r in reaching.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    nowhere = [F.lit(math.pi).alias("reach"), F.array().cast("array<int>").alias("targets")]
    homes = _packed(home.select("id", "u", "cell", *nowhere), cells.rows, "home_blocks")

    schema = f"query {id_type}, neighbour {id_type}, score double"
    guests = _packed(reaching, arriving, "guest_blocks")
    candidates = _cross(guests, homes, lambda batches: best_of_task(batches, k, threshold, exclude_self, block_scores), schema)
    ranked = candidates.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "neighbour")))
    return ranked.filter(F.col("rank") <= k)


def distinct_vectors(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Collapse equal vectors: (rep, vector, copies) and (key, rep)."""
    v = vectors.select(F.col(key), F.col(vector).alias("vector"))
    groups = stage(v.groupBy("vector").agg(F.min(key).alias("rep"), F.count("*").alias("copies")), "vector_groups")
    return groups.select("rep", "vector", "copies"), v.join(groups, "vector").select(key, "rep")


def for_every_key(groups: DataFrame, members: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function that turns (a, b, score) of `distinct_vectors` into rows (i, j, score) for every two keys that hold the two vectors.

    Keys of an equal vector are dealt in rows of about `PART_KEYS`, and two such rows meet in a task of their own, so that neither a
    row nor a task grows with the copies of a vector.
    """
    copied = groups.filter("copies > 1")
    n = copied.agg(F.sum("copies")).first()[0]
    if not n:
        return lambda pairs: pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), "score")
    key = members.columns[0]
    sent = F.broadcast if n <= SMALL_ROWS else lambda df: df
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by its number, as few rows become many
    parts = sent(copied.select("rep", F.ceil(F.col("copies") / PART_KEYS).cast("int").alias("parts")))
    dealt = members.join(parts, "rep").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")))
    held = stage(dealt.groupBy("rep", "part").agg(F.collect_list(key).alias("keys")), "vector_keys")
    side = lambda x: sent(held.select(F.col("rep").alias(x), F.col("part").alias(f"part_{x}"), F.col("keys").alias(f"keys_{x}")))
    keys = lambda x, name: F.explode(F.coalesce(f"keys_{x}", F.array(x))).alias(name)

    def expanded(pairs: DataFrame) -> DataFrame:
        met = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").repartition(tasks, "a", "b", "part_a", "part_b")
        return met.select(keys("a", "i"), "b", "keys_b", "score").select("i", keys("b", "j"), "score")

    return expanded
