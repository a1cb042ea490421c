"""Operator 10: SimHash near-duplicates, compared through tables of distances to pivots."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, stage
from .components import connected_components

#: Odd multiplier and start of the sequence from which reference fingerprints are drawn.
PIVOT_STEP, PIVOT_START = 0x9E3779B97F4A7C15, 0x243F6A8885A308D3
#: Fingerprints that one task compares with each other or with as many others.
BLOCK = 4096
#: Fingerprints that share a band key at most, on average, if their bits are evenly spread.
PER_KEY = 64
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint_of(text: str | None, words: int) -> int:
    """Unsigned 64-bit fingerprint; a bit is set if it is set in over half of the shingles' hashes."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), 42)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n, ones = 0, np.zeros(64, dtype=np.int64)
    for at in range(0, len(found) - words + 1, CHUNK):
        part = found[at : at + CHUNK + words - 1]
        hashes = np.fromiter((digest(join(s), 42) for s in zip(*(part[i:] for i in range(words)))), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, name: str = "fingerprint") -> DataFrame:
    """``docs`` with a signed 64-bit fingerprint of each whole text; no shuffle.

    Texts are lower-cased in A-Z, words are what stands between ASCII white space, shingles are ``words``
    words joined by spaces with repeats; fewer words are one shingle, none (or null) give 0.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            own = np.array([fingerprint_of(t, words) for t in batch.column(at).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.view(np.int64))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def references(n: int) -> np.ndarray:
    """Reference fingerprints: a fixed pseudo-random sequence."""
    with np.errstate(over="ignore"):
        x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(PIVOT_STEP) + np.uint64(PIVOT_START)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(27))


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(int(np.uint64(pivot).view(np.int64)))))


def blocks_for(n: int, most: int = 3) -> int:
    """Blocks of bits by which ``n`` distinct fingerprints are cut into bands.

    With b blocks a band key holds b - most of them, so more blocks give longer keys and more bands. The pairs
    within a key would grow with the square of ``n`` if its length stayed, so the fewest blocks are taken that leave `PER_KEY`
    rows to a key. The links found connect the same fingerprints whatever the number.
    """
    blocks = most + 1
    while blocks < 2 * most + 2 and n > PER_KEY * 2 ** (64 * (blocks - most) // blocks):
        blocks += 1
    return blocks


def _bands(fp: Column, most: int, blocks: int) -> Column:
    """Keys of which two fingerprints within ``most`` bits share one: all choices of ``blocks - most`` of the blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    keys = []
    for n, kept in enumerate(combinations(masks, blocks - most)):
        mask = np.uint64(sum(kept)).view(np.int64)
        keys.append(F.struct(F.lit(n).alias("band"), fp.bitwiseAND(F.lit(int(mask))).alias("key")))
    return F.array(*keys)


def _forest(left: np.ndarray, right: np.ndarray | None, most: int, pivots: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what pairs within ``most`` bits connect: within ``left``, or between it and ``right``.

    Rows are taken in the order of their distance to the first pivot, so only a window of that
    coordinate is looked at; pairs of it whose greatest coordinate difference is over ``most`` are
    discarded, and the survivors verified. Only links that join two parts are returned.
    """
    def table(x):
        return np.bitwise_count(x[:, None] ^ pivots[None, :]).astype(np.int8)

    own = right is None
    other = left if own else right
    a, b = table(left), table(other)
    order = np.argsort(b[:, 0], kind="stable")
    other, b = other[order], b[order]
    names, index = np.unique(np.concatenate([left, other]), return_inverse=True)
    parent = list(range(len(names)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    lo = np.searchsorted(b[:, 0], a[:, 0] - np.int8(most))
    hi = np.searchsorted(b[:, 0], a[:, 0] + np.int8(most), side="right")
    links = []
    for i in range(len(left)):
        near = np.arange(lo[i], hi[i])
        near = near[np.abs(b[near] - a[i]).max(axis=1) <= most] if len(near) else near
        near = near[np.bitwise_count(other[near] ^ left[i]) <= most]
        x = index[i]
        for j in near.tolist():
            p, q = root(x), root(index[len(left) + j])
            if p != q:
                parent[p] = q
                links.append((int(left[i]), int(other[j])))
    return links


def links(distinct: DataFrame, most: int = 3, blocks: int | None = None, pivots: int = 16) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints (column ``fp``) that pairs within ``most`` bits connect.

    Two fingerprints within ``most`` bits agree in one of the band keys, and their distances to any
    reference differ by ``most`` at most. So a row goes to (band key, cell of the distance to the first
    reference), and as a guest to the neighbouring cell that it is within ``most`` of. In a cell the
    full pivot table decides which pairs are verified. A cell of more than `BLOCK` fingerprints is split into
    blocks that meet in a grid, so no task gets a whole hot cell and no pair is lost. ``blocks`` of bits follow from the number of
    rows unless they are given.
    """
    blocks = blocks or blocks_for(distinct.count(), most)
    refs = references(pivots)
    width = 2 * most + 1
    d = _distance(F.col("fp"), int(refs[0]))
    cells = F.array_distinct(F.array(*(F.floor((d + s) / width).cast("int") for s in (0, most))))
    rows = distinct.select("fp", cells.alias("cells"), F.explode(_bands(F.col("fp"), most, blocks)).alias("k"))
    rows = rows.select("fp", F.col("k.band").alias("band"), F.col("k.key").alias("key"), F.explode("cells").alias("cell"))
    group = ["band", "key", "cell"]
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(sizes, group).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda i: F.struct(F.least(i, mine).alias("x"), F.greatest(i, mine).alias("y"), mine.alias("own")),
    )
    met = rows.select(*group, "fp", F.explode(meets).alias("m")).select(*group, "m.x", "m.y", "m.own", "fp")
    sets = met.groupBy(*group, "x", "y").agg(
        F.collect_list(F.when(F.col("own") == F.col("x"), F.col("fp"))).alias("left"),
        F.collect_list(F.when(F.col("own") != F.col("x"), F.col("fp"))).alias("right"),
    ).select("left", "right", "x", "y")

    def compare(batches):
        for batch in batches:
            found = []
            left, right, x, y = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                a = left[i].values.to_numpy().view(np.uint64)
                b = right[i].values.to_numpy().view(np.uint64)
                found += _forest(a, None if x[i].as_py() == y[i].as_py() else b, most, refs)
            a, b = (np.array(c, dtype=np.uint64).view(np.int64) for c in (list(zip(*found)) or [(), ()]))
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return sets.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, most: int = 3, blocks: int | None = None, pivots: int = 16
) -> DataFrame:
    """(key, fingerprint, component_id) of every row of ``docs``.

    Fingerprints within ``most`` bits are linked; ``component_id`` is the smallest key that links
    reach. Texts with equal fingerprints, exact copies among them, are compared as one. Texts
    without words have fingerprint 0 like null texts. Equal keys may have different fingerprints, each row
    then has its own component; null keys stay, and a component of null keys alone has a null id.
    Other columns are not read; an empty table stays empty. Fingerprints as signed longs.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    hashed = stage(fingerprints(rows, "text", words, "fp").select("key", "fp"), "fingerprints")
    distinct = stage(hashed.groupBy("fp").agg(F.min("key").alias("least")), "distinct-fingerprints")
    parts = connected_components(links(distinct, most, blocks, pivots))
    named = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("part", F.coalesce("part", "fp"))
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "part").select("fp", "component_id")
    return hashed.join(classes, "fp").select("key", F.col("fp").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the smallest (key, text).

    A null key comes before all others in its group. Repeated rows count as copies: one stays.
    """
    place, same, comp = fresh("row__", docs), fresh("fp__", docs), fresh("component__", docs)
    rows = stage(docs.withColumn(place, F.monotonically_increasing_id()), "numbered")
    # rows stand for themselves: their numbers are the keys, in the order of (key, text hash)
    groups = near_duplicates(rows, place, text, **settings).select(F.col("key").alias(place), F.col("component_id").alias(comp))
    order = F.struct(F.col(key), F.xxhash64(F.col(text)), F.col(place))
    first = rows.select(place, order.alias(same)).join(groups, place).groupBy(comp).agg(F.min(same).alias(same))
    return rows.join(first.select(F.col(f"{same}.{place}").alias(place)), place, "left_semi").drop(place)
