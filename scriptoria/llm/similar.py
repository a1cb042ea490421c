"""Near-dedup by similarity of shingle sets: groups of shared cells, in which tables of SimHash distances to pivots discard and whole sets decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, fresh, scratch, stage
from .components import connected_components
from .simhash import references

#: Words of a shingle and least Jaccard similarity of two shingle sets.
WORDS, SIMILARITY = 5, 0.8
#: Band keys of a text, and least hashes that make one: sets of similarity 0.8 share no key in about 3 of 100,000 cases.
BANDS, ROWS = 20, 4
#: 64-bit words of a fingerprint, and greatest number of differing bits of a pair that is verified: at similarity 0.8 the
#: expected number is 39 of 256 with a deviation below 6.
FINGERPRINT, MOST = 4, 72
PIVOTS = 8
#: Texts, and shingles of them, that one block of a group holds at most (a longer text is a block of its own).
BLOCK, BLOCK_SHINGLES = 1024, 1 << 22
#: Texts that meet every block of a group of several blocks: those in the largest cells.
ANCHORS = 16
CHUNK = 1 << 9


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    found = _words(text)
    if not found:
        return np.zeros(0, dtype=np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    spans = zip(*(found[i:] for i in range(words))) if len(found) >= words else [found]
    return np.unique(np.fromiter((digest(join(s), 42) for s in spans), dtype=np.uint64))


#: One odd multiplier for each hash that is made of a shingle's hash.
MULTIPLIERS = (references(FINGERPRINT + BANDS * ROWS) | np.uint64(1))[:, None]


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """As many other hashes of each hash as there are multipliers, a row for each."""
    x = hashes[None] * MULTIPLIERS
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, band keys): a bit of the fingerprint is set if over half of the shingles have it."""
    ones = np.zeros((FINGERPRINT, 64), dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), CHUNK):
        mixed = _mixed(hashes[at : at + CHUNK])
        held = np.unpackbits(mixed[:FINGERPRINT].view(np.uint8).reshape(FINGERPRINT, -1, 8), axis=2, bitorder="little")
        ones += held.sum(axis=1, dtype=np.int64)
        least = np.minimum(least, mixed[FINGERPRINT:].min(axis=1))
    bits = np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<u8").ravel()
    keys = [xxhash.xxh64_intdigest(row.tobytes(), n) for n, row in enumerate(least.reshape(BANDS, ROWS))]
    return bits, np.array(keys, dtype=np.uint64)


def verified_links(
    ids: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], parts: np.ndarray, second: np.ndarray, similarity: float, most: int, refs: np.ndarray
) -> list[tuple[int, int]]:
    """Links that connect what pairs of similar sets connect beyond ``parts``; at most one less than there are texts.

    With some rows ``second`` and others not, only pairs of one of each count. Every text is compared with those
    that are not in its part yet: a pair whose distances to some reference differ by over ``most`` is discarded unseen, as is one whose
    sizes alone rule out the similarity or whose fingerprints differ in over ``most`` bits; the others' shared
    shingles are counted.
    """
    n, across = len(ids), bool(second.any() and not second.all())
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    table = np.bitwise_count(prints[:, None, :] ^ refs[None, :, :]).sum(axis=2, dtype=np.int16)
    part = np.unique(parts, return_inverse=True)[1]
    held, found = np.zeros(len(names), dtype=bool), []
    for i in range(n):
        if across and second[i]:
            continue
        near = np.arange(n) if across else np.arange(i + 1, n)
        near = near[(part[near] != part[i]) & (second[near] if across else True)]
        near = near[np.minimum(sizes[near], sizes[i]) >= similarity * np.maximum(sizes[near], sizes[i]) - 1e-9]
        near = near[(np.abs(table[near] - table[i]) <= most).all(axis=1)]
        near = near[np.bitwise_count(prints[near] ^ prints[i]).sum(axis=1, dtype=np.int64) <= most]
        if not len(near):
            continue
        held[flat[starts[i] : starts[i + 1]]] = True
        for j in near.tolist():
            if part[j] == part[i]:
                continue
            shared = int(held[flat[starts[j] : starts[j + 1]]].sum())
            if shared >= similarity * (sizes[i] + sizes[j] - shared) - 1e-9:
                part[part == part[j]] = part[i]
                found.append((int(ids[i]), int(ids[j])))
        held[flat[starts[i] : starts[i + 1]]] = False
    return found


def _solved(placed: DataFrame, words: int, similarity: float, most: int) -> DataFrame:
    """(a, b): `verified_links` of each block (group, x, y) of rows (group, x, y, node, part, second, print, text).

    Blocks are dealt by their names and read in order, so a task holds one block's sets at a time.
    """
    refs = references(PIVOTS * FINGERPRINT).reshape(PIVOTS, FINGERPRINT)

    def links(block):
        if len(block) < 2:
            return []
        node, part, second, prints, texts = zip(*block)
        sets = [shingles(t, words) for t in texts]
        return verified_links(np.array(node), np.array(prints).view(np.uint64), sets, np.array(part), np.array(second), similarity, most, refs)

    def solve(batches):
        name, block = None, []
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("group", "x", "y", "node", "part", "second", "print", "text")]
            for group, x, y, *row in zip(*columns):
                if (group, x, y) != name:
                    out += links(block)
                    name, block = (group, x, y), []
                block.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        out = links(block)
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    dealt = placed.select("group", "x", "y", "node", "part", "second", "print", "text").repartition("group", "x", "y").sortWithinPartitions("group", "x", "y", "node")
    return dealt.mapInArrow(solve, "a long, b long")


def _blocks(count: Column, size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")


def _own(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int")


def _shared_cells(classes: DataFrame) -> DataFrame:
    """(node, group, central): texts that share cells, directly or through others, and how full their cells are."""
    rows = classes.select("node", F.explode("bands").alias("cell"))
    held = stage(rows.groupBy("cell").agg(F.count("*").alias("held"), F.min("node").alias("first")).filter("held > 1"), "cells")
    met = stage(rows.join(held, "cell").groupBy("node").agg(F.sum("held").alias("central"), F.array_distinct(F.collect_list("first")).alias("firsts")), "cell-members")
    parts = connected_components(met.select(F.col("node").alias("a"), F.explode("firsts").alias("b")).distinct())
    return met.select("node", "central").join(parts.withColumnRenamed("part", "group"), "node")


def _links(docs: DataFrame, classes: DataFrame, words: int, similarity: float, most: int) -> DataFrame:
    """(a, b) of longs: links of similar texts that connect all that such pairs connect.

    Texts that share no cell are not looked at. A group of texts connected by cells is solved in one block if it is small enough. A larger
    one is dealt into blocks, and its `ANCHORS` fullest texts to all of them; what this leaves outside of the group's
    largest part then meets every block it has not met: rows that grow with the group and with what is left, not with its square.
    """
    members = stage(_shared_cells(classes).join(classes.select("node", "n", "print", "key", "t1", "t2"), "node"), "members")
    sizes = members.groupBy("group").agg(F.count("*").alias("count"), F.sum("n").alias("size")).withColumn("blocks", _blocks(F.col("count"), F.col("size")))
    members = stage(members.join(sizes.select("group", "blocks"), "group"), "members-blocks")
    texts = docs.join(bounded(members.select("key", "t1", "t2")), _same(docs, members), "left_semi").dropDuplicates(["key", "t1", "t2"])
    texts = stage(members.select("node", "key", "t1", "t2").join(texts, _same(texts, members)).select("node", "text"), "member-texts")

    ranked = members.filter("blocks > 1").withColumn("place", F.row_number().over(W.partitionBy("group").orderBy(F.desc("central"), "node")))
    anchors = ranked.filter(F.col("place") <= ANCHORS).select("node", F.lit(True).alias("anchor"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    first = members.join(anchors, "node", "left").withColumn("x", F.explode(F.when(F.col("anchor"), every).otherwise(F.array(_own(F.col("blocks"))))))
    first = first.select("group", "x", F.col("x").alias("y"), "node", F.col("node").alias("part"), F.lit(False).alias("second"), "print")
    links = stage(_solved(first.join(texts, "node"), words, similarity, most), "links-blocks")

    large = members.filter("blocks > 1").select("group", "node", "n", "print")
    if large.isEmpty():
        return links
    parts = connected_components(links.join(large.select(F.col("node").alias("a")), "a", "left_semi"))
    labelled = stage(large.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "labelled")
    most_of = labelled.groupBy("group", "part").agg(F.count("*").alias("count")).groupBy("group").agg(F.max_by("part", F.struct("count", F.negative("part"))).alias("main"))
    sided = labelled.join(most_of, "group").withColumn("rest", F.col("part") != F.col("main"))
    count = lambda rest: _blocks(F.count_if(rest), F.coalesce(F.sum(F.when(rest, F.col("n"))), F.lit(0)))
    dealt = sided.groupBy("group").agg(count(F.col("rest")).alias("r"), count(~F.col("rest")).alias("m"), F.count_if("rest").alias("left")).filter("left > 0").drop("left")
    # blocks 0 .. r - 1 hold what is left, r .. r + m - 1 the largest part; every pair of blocks with one of the former meets
    own = F.when(F.col("rest"), _own(F.col("r"))).otherwise(F.col("r") + _own(F.col("m")))
    others = F.when(F.col("rest"), F.sequence(F.lit(0), F.col("r") + F.col("m") - 1)).otherwise(F.sequence(F.lit(0), F.col("r") - 1))
    met = sided.join(dealt, "group").withColumn("own", own).withColumn("other", F.explode(others))
    pairs = met.select(
        "group", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "part", (F.col("own") > F.col("other")).alias("second"), "print"
    )
    return links.unionAll(stage(_solved(pairs.join(texts, "node"), words, similarity, most), "links-rest"))


def _same(left: DataFrame, right: DataFrame) -> Column:
    """Rows of one key and text: nulls of the key are equal, texts by 128 bits."""
    return left["key"].eqNullSafe(right["key"]) & (left["t1"] == right["t1"]) & (left["t2"] == right["t2"])


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, t1, t2, text): the key, 128 bits of the text, the text."""
    return docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("t1"), F.xxhash64(F.col(text), F.lit("again")).alias("t2"), F.col(text).alias("text"))


def _classes(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Rows (key, t1, t2, h1, h2), and classes of equal word sequences (node, h1, h2, n, print, bands, key, t1, t2 of the least row)."""
    long = T.LongType()
    schema = T.StructType([
        docs.schema["key"], *(T.StructField(n, long) for n in ("t1", "t2", "h1", "h2", "n")), *(T.StructField(n, T.ArrayType(long)) for n in ("print", "bands"))
    ])

    def read(batches):
        for batch in batches:
            out = []
            for t in batch.column(3).to_pylist():
                hashes = shingles(t, words)
                bits, keys = sketch(hashes)
                digest = np.frombuffer(xxhash.xxh128_digest(b" ".join(_words(t))), dtype=np.int64)
                out.append((int(digest[0]), int(digest[1]), len(hashes), bits.view(np.int64), keys.view(np.int64)))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names)

    rows = stage(docs.mapInArrow(read, schema), "sketches")
    least = F.min(F.struct("key", "t1", "t2")).alias("least")
    classes = rows.groupBy("h1", "h2").agg(F.first("n").alias("n"), F.first("print").alias("print"), F.first("bands").alias("bands"), least)
    numbered = classes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "n", "print", "bands", "least.*")
    return rows.select("key", "t1", "t2", "h1", "h2"), stage(numbered, "classes")


def _groups(docs: DataFrame, words: int, similarity: float, most: int) -> DataFrame:
    """(key, t1, t2, best): every row of (key, t1, t2, text) and the least (key, t1, t2) of its group."""
    rows, classes = _classes(docs, words)
    parts = connected_components(_links(docs, classes, words, similarity, most))
    named = classes.select("node", "h1", "h2", F.struct("key", "t1", "t2").alias("least")).join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    best = named.groupBy("part").agg(F.min("least").alias("best"))
    return rows.join(named.join(best, "part").select("h1", "h2", "best"), ["h1", "h2"]).select("key", "t1", "t2", "best")


def similar_groups(docs: DataFrame, key: str, text: str, words: int = WORDS, similarity: float = SIMILARITY, most: int = MOST) -> DataFrame:
    """(row, group), a row's key and its group: rows that links of shingle sets with a Jaccard similarity of ``similarity`` or more connect.

    ``group`` is the smallest key of the group; a null key comes before all others. Texts with equal sequences of words, exact copies
    among them, are compared as one. Texts share a cell if the least hashes of one of 20 bands agree, which at
    similarity 0.8 fails for about 3 pairs in 100,000; such a pair is found only through others. Groups connected by cells
    are solved in blocks (`_links`): the pivot table of 256-bit fingerprints discards pairs of over ``most`` differing bits, over five
    deviations beyond what a pair at 0.8 has, and every other pair of texts that are not joined yet is decided by its whole shingle sets.

    Null texts and texts without words are one group. Repeated rows and equal keys each have a row. An empty table
    gives no rows. Other columns are not read.
    """
    named = _named(docs, key, text)
    with scratch(docs.sparkSession) as keep:
        return keep(_groups(named, words, similarity, most).select(F.col("key").alias("row"), F.col("best.key").alias("group")), "similar-groups")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, most: int = MOST) -> DataFrame:
    """``docs`` with one row of each of the `similar_groups`: the one with the smallest key, and then text hash.

    A null key comes before all others in its group. Repeated rows, of one key and text, count as copies: one stays. Null and blank
    texts are one group. Columns are kept, whatever their names; an empty table stays empty. All tables but
    that of the rows to drop are deleted before this returns; it is sent to all executors if it is small, and joined otherwise.
    """
    with scratch(docs.sparkSession) as keep:
        rows = _groups(_named(docs, key, text), words, similarity, most)
        texts = rows.groupBy("key", "t1", "t2", "best").agg(F.count("*").alias("copies")).withColumn("again", F.struct("key", "t1", "t2").eqNullSafe(F.col("best")))
        drop = keep(texts.filter("NOT again OR copies > 1").select("key", "t1", "t2", "again"), "dropped")
    names = [fresh(n, docs) for n in ("key__", "t1__", "t2__", "row__")]
    marked = docs.withColumns(dict(zip(names, [F.col(key), F.xxhash64(F.col(text)), F.xxhash64(F.col(text), F.lit("again"))])))
    same = lambda d: marked[names[0]].eqNullSafe(d["key"]) & (marked[names[1]] == d["t1"]) & (marked[names[2]] == d["t2"])
    out = marked.join(bounded(drop), same(drop), "left_anti").select(*docs.columns)
    repeated = drop.filter("again")
    if repeated.isEmpty():
        return out
    one = marked.join(bounded(repeated), same(repeated), "left_semi").groupBy(*names[:3]).agg(F.first(F.struct(*docs.columns)).alias(names[3]))
    return out.unionByName(one.select(f"{names[3]}.*"))
