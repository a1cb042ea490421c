"""Operator 5: benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, fresh, scratch, stage
from .wordhash import rolled, word_hashes

#: Words of a seed and least words of a tile.
SEED = 5
#: Share of a test item's words that tiles must cover.
COVERAGE = 0.5
#: The bitmap of the benchmark's seeds has two to this power bits (8 MB), however large the benchmark is.
BITMAP_BITS = 26
SEPARATOR = 0
#: Length at which the running search starts before it falls to the seed length.
LONG_TILE = 40
PRIME = (1 << 61) - 1


def _running_hashes(tokens: list[int], free: list[bool], size: int):
    """(hash, position) of every window of ``size`` free tokens, each from the one before it."""
    top = pow(131, size - 1, PRIME)
    value, run = 0, 0
    for i, token in enumerate(tokens):
        if not free[i]:
            value, run = 0, 0
            continue
        if run == size:
            value = (value - tokens[i - size] * top) % PRIME
            run -= 1
        value = (value * 131 + token) % PRIME
        run += 1
        if run == size:
            yield value, i - size + 1


def tiles(item: list[int], doc: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (item position, document position, length): the longest match of unmarked words first.

    Ties go to the smaller item position and then the smaller document position. Windows of the search length
    are matched by running hashes and grown to maximal matches; what marked words leave of a match
    is looked at again, so tiles never overlap on either side. Separators in ``doc`` match nothing.
    """
    item_free, doc_free = [True] * len(item), [d != SEPARATOR for d in doc]
    found: list[tuple[int, int, int]] = []
    for size in sorted({least, max(least, LONG_TILE)}, reverse=True):
        places: dict[int, list[int]] = {}
        for value, p in _running_hashes(item, item_free, size):
            places.setdefault(value, []).append(p)
        queue = []
        for value, t in _running_hashes(doc, doc_free, size) if places else ():
            for p in places.get(value, ()):
                if item[p : p + size] != doc[t : t + size]:
                    continue
                if p and t and item_free[p - 1] and doc_free[t - 1] and item[p - 1] == doc[t - 1]:
                    continue  # part of the match that began one word before
                n = size
                while p + n < len(item) and t + n < len(doc) and item_free[p + n] and doc_free[t + n] and item[p + n] == doc[t + n]:
                    n += 1
                queue.append((-n, p, t))
        heapq.heapify(queue)
        while queue:
            n, p, t = heapq.heappop(queue)
            n = -n
            free = [item_free[p + i] and doc_free[t + i] for i in range(n)]
            if all(free):
                found.append((p, t, n))
                for i in range(n):
                    item_free[p + i] = doc_free[t + i] = False
                continue
            start = None
            for i, f in enumerate([*free, False]):
                if f and start is None:
                    start = i
                elif not f and start is not None:
                    if i - start >= size:
                        heapq.heappush(queue, (-(i - start), p + start, t + start))
                    start = None
    return found


def _hashed(rows: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and the word hashes of column ``text``."""
    schema = T.StructType([*(rows.schema[k] for k in keep), T.StructField(name, T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            words = [word_hashes(t).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(words, pa.list_(pa.int64()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _grams(rows: DataFrame, words: str, key: str, seed: int) -> DataFrame:
    """(key, gram, places): distinct seeds of each row and how often each occurs, separators left out."""
    schema = T.StructType([rows.schema[key], T.StructField("gram", T.LongType()), T.StructField("places", T.LongType())])

    def run(batches):
        for batch in batches:
            of, grams, places = [], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for row, own in enumerate(batch.column(words)):
                tokens = own.values.to_numpy().view(np.uint64)
                keys = rolled(tokens, seed)
                clean = np.lib.stride_tricks.sliding_window_view(tokens, seed).all(axis=1) if len(keys) else np.zeros(0, dtype=bool)
                distinct, n = np.unique(keys[clean], return_counts=True)
                of += [row] * len(distinct)
                grams.append(distinct.view(np.int64))
                places.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(of, pa.int64())), pa.array(np.concatenate(grams)), pa.array(np.concatenate(places))], names=schema.names
            )

    return rows.select(key, words).mapInArrow(run, schema)


def _bitmap(grams: DataFrame, bits: int) -> np.ndarray:
    """Bits set at the leading bits of the seeds; 2 ** bits of them, made by Spark in words of 64."""
    slot = F.shiftrightunsigned("gram", 64 - bits)
    one = F.expr("shiftleft(1L, cast(slot & 63 AS int))")
    words = grams.select(slot.alias("slot")).select(F.shiftright("slot", 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    for r in words.toLocalIterator():
        out[r.word] = r.bits
    return out.view(np.uint64)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    coverage: float = COVERAGE, seed: int = SEED, bitmap_bits: int = BITMAP_BITS,
) -> DataFrame:
    """(key, print, item, n_words, covered, n_tiles, coverage): documents that hold a test item, perhaps reordered.

    Each document is reduced to the words of seeds that the bitmap of the benchmark's seeds may hold; tiles of ``seed``
    words and more lie within these, so tiling them gives what the whole text gives. Equal reduced documents are
    tiled once, so neither copies nor a passage that many hold are compared again. Seeds are joined only on those of an
    item that a covering document cannot all lack, the commonest left out first. Survivors are tiled.

    An item of fewer than ``seed`` words has its own length as seed, in a pass of its own, so a document has to hold it whole. Texts and
    items that are null or without words match nothing. ``print`` is the hash of the document's text:
    rows with equal keys and other texts are apart; repeated rows have one result each. Equal items are each reported.
    Empty tables give no rows. Other columns are not read.
    """
    tests = benchmark.select(F.monotonically_increasing_id().alias("iid"), F.col(item).alias("item"), F.col(item_text).alias("text"))
    tests = stage(_hashed(tests, "words", ["iid", "item"]), "benchmark-words")
    least = F.least(F.size("words"), F.lit(seed))
    sizes = sorted(r[0] for r in tests.select(least).distinct().collect() if r[0] and r[0] > 0)
    found = [_tiled(docs, tests.filter(least == n), key, text, coverage, n, bitmap_bits) for n in sizes or [seed]]
    return reduce(DataFrame.unionAll, found)


def _tiled(docs: DataFrame, tests: DataFrame, key: str, text: str, coverage: float, seed: int, bitmap_bits: int) -> DataFrame:
    """`contaminated` for the staged ``tests`` (iid, item, words), by tiles of ``seed`` words and more."""
    item_grams = stage(_grams(tests, "words", "iid", seed), "benchmark-seeds")
    bitmap = _bitmap(item_grams, bitmap_bits)

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("print"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["key"], rows.schema["print"], T.StructField("runs", T.ArrayType(T.LongType()))])

    def reduce_docs(batches):
        for batch in batches:
            of, runs = [], []
            for row, t in enumerate(batch.column(2).to_pylist()):
                words = word_hashes(t)
                slots = rolled(words, seed) >> np.uint64(64 - bitmap_bits)
                hit = np.flatnonzero((bitmap[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1))
                if len(hit):
                    # consecutive seeds make a run; each run's words and a separator
                    cuts = np.flatnonzero(np.diff(hit) > seed) + 1
                    spans = [np.append(words[h[0] : h[-1] + seed], np.uint64(SEPARATOR)) for h in np.split(hit, cuts)]
                    of.append(row)
                    runs.append(np.concatenate(spans).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), batch.column(1).take(pa.array(of, pa.int64())), pa.array(runs, pa.list_(pa.int64()))],
                names=schema.names,
            )

    sign = F.struct(F.xxhash64("runs").alias("x"), F.xxhash64("runs", F.lit("second")).alias("y"))
    hits = stage(rows.mapInArrow(reduce_docs, schema).withColumn("sign", sign), "benchmark-hits")
    shapes = stage(hits.groupBy("sign").agg(F.first("runs").alias("runs")), "benchmark-shapes")

    needed = F.ceil(F.ceil(F.size("words") * F.lit(coverage)) / seed)
    common = item_grams.groupBy("gram").agg(F.count("*").alias("df"))
    spare = F.sum("places").over(W.partitionBy("iid").orderBy(F.desc("df"), "gram"))
    sought = item_grams.join(common, "gram").withColumn("spare", spare).join(
        tests.select("iid", needed.alias("needed")), "iid"
    ).filter("spare >= needed").select("gram", "iid")
    pairs = _grams(shapes, "runs", "sign", seed).join(sought, "gram").select("sign", "iid").distinct()

    together = pairs.join(shapes, "sign").join(tests, "iid").select("sign", "iid", "item", "runs", "words")
    out = T.StructType([*(together.schema[c] for c in ("sign", "item")), *(T.StructField(c, T.LongType()) for c in ("n_words", "covered", "n_tiles"))])

    def tile(batches):
        for batch in batches:
            n_words, covered, n_tiles = [], [], []
            for runs, words in zip(batch.column(3), batch.column(4)):
                own, doc = words.values.to_numpy().view(np.uint64).tolist(), runs.values.to_numpy().view(np.uint64).tolist()
                found = tiles(own, doc, seed)
                n_words.append(len(own))
                covered.append(sum(t[2] for t in found))
                n_tiles.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in (n_words, covered, n_tiles))], names=out.names)

    tiled = together.mapInArrow(tile, out).filter((F.col("covered") >= F.col("n_words") * coverage) & (F.col("covered") > 0))
    return hits.select("key", "print", "sign").join(tiled, "sign").select(
        "key", "print", "item", "n_words", "covered", "n_tiles", (F.col("covered") / F.col("n_words")).alias("coverage")
    )


def remove_contaminated(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that ``found`` (of `contaminated`) names; few enough of them are sent to all executors."""
    mine, own = fresh("key__", docs), fresh("print__", docs)
    with scratch(docs.sparkSession) as keep:
        bad = keep(found.select(F.col("key").alias(mine), F.col("print").alias(own)).distinct(), "contaminated")
    bad = bounded(bad)
    return docs.join(bad, docs[key].eqNullSafe(bad[mine]) & (F.xxhash64(docs[text]) == bad[own]), "left_anti")
