"""Operator 6: best-fit packing of documents into sequences, certified by lower bounds and repacked where a gap is left."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, stage
from .encoding import encoder

#: Pieces that one task packs together.
GROUP_PIECES = 20_000
#: Sequences number as round, group and bin, each in its own range.
ROUND_STEP, GROUP_STEP = 1 << 54, 1 << 24


def cut(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text",
    with_ids: bool = False, words_apart: bool = True,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): whole texts as ids with ``end_id``, cut at ``capacity``.

    Null texts are empty: one piece with the end id. Repeated rows and null keys are kept. No shuffle.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    names = ["key", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    fields = [rows.schema["key"], T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in names[2:5])]
    fields += [T.StructField("ids", T.BinaryType())] * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = encoder(tokenizer, words_apart)
        for batch in batches:
            of, out = [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                ids = np.append(source.ids(t).astype("<u4"), np.uint32(end_id))
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity].tobytes()
                    of.append(row)
                    out.append((piece, start, len(own) // 4, zlib.crc32(own), *([own] * with_ids)))
            columns = list(zip(*out)) or [()] * (4 + with_ids)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds + [pa.binary()] * with_ids)]
            yield pa.record_batch([batch.column(0).take(pa.array(of, pa.int64())), *arrays], names=names)

    return rows.mapInArrow(pieces, T.StructType(fields))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by three families of dual feasible functions.

    Each maps lengths so that no bin's lengths can map to more than one bin's worth; the sum of the mapped
    lengths over the capacity, rounded up, is then a lower bound. The identity gives the volume bound.
    """
    if not len(lengths):
        return 0
    values, counts = np.unique(lengths, return_counts=True)
    best = -(-int(values @ counts) // capacity)
    # lengths beyond capacity - s count as whole bins, those below s as nothing
    below = np.concatenate([[0], np.cumsum(counts)])
    volume = np.concatenate([[0], np.cumsum(counts * values)])
    for s in np.unique(np.append(values[values <= capacity // 2], capacity // 2)):
        low, high = np.searchsorted(values, s), np.searchsorted(values, capacity - s, side="right")
        middle = int(volume[high] - volume[low]) if high > low else 0
        best = max(best, int(below[-1] - below[max(high, low)]) - (-middle // capacity))
    # rounding to multiples of 1 / k
    for k in range(1, 65):
        whole = (values * (k + 1)) % capacity == 0
        scaled = np.where(whole, values * k, (values * (k + 1)) // capacity * capacity)
        best = max(best, -(-int(scaled @ counts) // (capacity * k)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: bin and offset of every length, and the number of bins.

    Open bins are kept by free space; a bit per space finds the smallest that fits.
    """
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, opened = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            at = by_space[space].pop()
            if not by_space[space]:
                mask ^= 1 << space
        else:
            space, at, opened = capacity, opened, opened + 1
        bins[i], offsets[i] = at, capacity - space
        if space > n:
            by_space[space - n].append(at)
            mask |= 1 << (space - n)
    return bins, offsets, opened


def _packed(items: DataFrame, capacity: int, groups: int, turn: int) -> DataFrame:
    """One round: deal items out to groups, pack each; ``free`` is what a bin has left, ``gap`` the group's bins beyond its bound."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets, n = best_fit(lengths, capacity)
        free = capacity - np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        return pd.DataFrame({
            "rid": pdf["rid"], "length": lengths, "grp": int(key[0]), "bin": bins, "offset": offsets, "free": free[bins],
            "emptiest": bins == int(free.argmax()), "gap": n - lower_bound(lengths, capacity),
        })

    dealt = items.select("rid", "length", F.pmod(F.xxhash64("rid", F.lit(turn)), F.lit(groups)).alias("grp"))
    return stage(dealt.groupBy("grp").applyInPandas(
        run, "rid long, length long, grp long, bin long, offset long, free long, emptiest boolean, gap long"
    ), "packed")


def pack(pieces: DataFrame, capacity: int, length: str = "length", rounds: int = 5, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: best-fit decreasing per partition, certified and repacked.

    Pieces are dealt to groups of about ``group_pieces`` and packed there. A group whose bins equal
    the dual-feasible bound is certified and gives up only its emptiest bin; a group with a gap
    gives up every bin with free space. What was given up is dealt anew, to fewer groups, and packed
    again; it is taken if it saves bins. Rounds end at the global volume bound, when nothing is saved,
    or after ``rounds``. Lengths must be between 1 and ``capacity``; nulls or others raise an error in the
    job. The columns of ``pieces`` are kept, and the new ones get longer names where it has them; an empty table stays empty. Runs two jobs and up to two per round.
    """
    names = pieces.columns
    rid, sequence, offset = (fresh(n, pieces) for n in ("rid", "sequence_id", "offset"))
    checked = F.when(F.col(length).between(1, capacity), F.col(length).cast("long")).otherwise(
        F.raise_error(F.lit(f"a length is not between 1 and {capacity}"))
    )
    kept = stage(pieces.withColumn(rid, F.monotonically_increasing_id()), "pieces")
    items = kept.select(F.col(rid).alias("rid"), checked.alias("length"))
    n, total = items.agg(F.count("*"), F.sum("length")).first()
    bound = -(-(total or 0) // capacity)
    groups = max(1, math.ceil(n / group_pieces))
    now = _packed(items, capacity, groups, 0)
    final, used, turn = [], 0, 0
    number = lambda df, turn: df.select(
        "rid", (F.lit(turn) * ROUND_STEP + F.col("grp") * GROUP_STEP + F.col("bin")).alias("sequence_id"), F.col("offset").alias("offset")
    )
    while True:
        given = ((F.col("gap") > 0) & (F.col("free") > 0)) | (F.col("emptiest") & (F.col("free") > 0))
        first = F.col("offset") == 0
        bins, open_bins, open_pieces = now.agg(
            F.count_if(first), F.count_if(first & given), F.count_if(given)
        ).first()
        if turn == rounds or used + bins <= bound or open_bins < 2 or (turn and groups == 1):
            final.append(number(now, turn))
            break
        regroup = max(1, math.ceil(open_pieces / group_pieces))
        again = _packed(now.filter(given), capacity, regroup, turn + 1)
        if again.filter(first).count() >= open_bins:
            final.append(number(now, turn))
            break
        final.append(number(now.filter(~given), turn))
        used, now, turn, groups = used + bins - open_bins, again, turn + 1, regroup
    placed = final[0]
    for df in final[1:]:
        placed = placed.unionAll(df)
    return kept.join(placed.toDF(rid, sequence, offset), rid).select(*names, sequence, offset)


def assemble(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, ids): the ids of each sequence as bytes, its pieces in order; at most ``capacity`` ids each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.col(ids).alias("ids"))))
    whole = F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), ""))
    return packed.groupBy("sequence_id").agg(whole.alias("ids"))
