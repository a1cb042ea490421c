"""Operator 3: token ids as flat binary files with 64-bit document offsets, read back by memory map."""

from __future__ import annotations

import os
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ensure_checkpoint_dir, stage
from .encoding import encoder, id_type


@dataclass(frozen=True)
class TokenFiles:
    """Folder of ``part-N.bin`` (ids) and ``part-N.off`` (offsets); ``index``: key, part, ordinal, start, n_tokens."""

    folder: str
    width: str
    index: DataFrame


def mounted_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, as a path that every machine has mounted.

    Memory maps need files, so a checkpoint folder in an object store is refused.
    """
    place = urlparse(ensure_checkpoint_dir(spark))
    if place.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a shared folder that is mounted, not {place.scheme}://")
    return os.path.join(place.path, f"{name}-{uuid.uuid4().hex}")


def _replace(folder: str, name: str, write) -> None:
    """Write under a name of this attempt, then rename: a retried or second attempt leaves one whole file."""
    os.makedirs(folder, exist_ok=True)
    own = os.path.join(folder, f".{name}.{TaskContext.get().taskAttemptId()}")
    with open(own, "wb") as file:
        write(file)
    os.replace(own, os.path.join(folder, name))


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text",
    words_apart: bool = True,
) -> TokenFiles:
    """Encode every whole text, append ``end_id`` and write the ids in ascending ``key`` order.

    Documents are dealt by ranges of the key; each task writes one file while it encodes, holding
    one batch. The numbers of ids per file are summed up to the files' bases, and a second pass
    over the small index writes the 64-bit offsets: n documents have n + 1, from the start of the
    whole collection. Runs two jobs.

    Null texts are empty: one end id. Null keys come first; equal keys follow in the order of
    their texts, and repeated rows are written as often as they occur. An empty table gives no file.
    Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or mounted_folder(spark, "token-ids")
    from tokenizers import Tokenizer

    width = id_type(max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)).str
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    fields = [rows.schema["key"], T.StructField("part", T.IntegerType()), T.StructField("ordinal", T.LongType()), T.StructField("n_tokens", T.LongType())]

    def encode(batches):
        part, done, yielded = TaskContext.get().partitionId(), 0, []
        source = encoder(tokenizer, words_apart)

        def write(file):
            nonlocal done
            for batch in batches:
                lengths = []
                for t in batch.column(1).to_pylist():
                    ids = source.ids(t).astype(width, copy=False)
                    file.write(ids.tobytes())
                    file.write(np.array([end_id], dtype=width).tobytes())
                    lengths.append(len(ids) + 1)
                n = len(lengths)
                yielded.append(pa.record_batch(
                    [batch.column(0), pa.array([part] * n, pa.int32()), pa.array(range(done, done + n), pa.int64()), pa.array(lengths, pa.int64())],
                    names=["key", "part", "ordinal", "n_tokens"],
                ))
                done += n

        _replace(folder, f"part-{part}.bin", write)
        yield from yielded

    counted = stage(rows.mapInArrow(encode, T.StructType(fields)), "token-counts")
    bases = counted.groupBy("part").agg(F.sum("n_tokens").alias("total")).select(
        "part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("base")
    )
    within = F.sum("n_tokens").over(W.partitionBy("part").orderBy("ordinal")) - F.col("n_tokens")
    index = stage(counted.join(bases, "part").withColumn("start", F.col("base") + within).drop("base"), "token-index")

    def offsets(batches):
        part, starts, end = None, [], 0
        for batch in batches:
            for p, s, n in zip(*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))):
                if p != part and part is not None:
                    yield store(part, starts, end)
                    starts = []
                part, end = p, s + n
                starts.append(s)
        if part is not None:
            yield store(part, starts, end)

    def store(part, starts, end):
        _replace(folder, f"part-{part}.off", lambda file: file.write(np.array([*starts, end], dtype="<i8").tobytes()))
        return pa.record_batch([pa.array([part], pa.int32())], names=["part"])

    ordered = index.select("part", "start", "n_tokens", "ordinal").repartition("part").sortWithinPartitions("part", "ordinal")
    ordered.mapInArrow(offsets, "part int").agg(F.count("*")).collect()
    return TokenFiles(folder, width, index)


def read_token_files(files: TokenFiles) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the memory-mapped files.

    The checksum is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    folder, width = files.folder, files.width
    fields = [files.index.schema["key"], *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))]
    ordered = files.index.select("key", "part", "ordinal").repartition("part").sortWithinPartitions("part", "ordinal")

    def read(batches):
        opened, ids, offsets = None, None, None
        for batch in batches:
            out = []
            for part, ordinal in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if part != opened:
                    ids = np.memmap(os.path.join(folder, f"part-{part}.bin"), dtype=width, mode="r")
                    offsets = np.memmap(os.path.join(folder, f"part-{part}.off"), dtype="<i8", mode="r")
                    opened = part
                start, end = int(offsets[ordinal]), int(offsets[ordinal + 1])
                base = int(offsets[0])
                out.append((start, end - start, zlib.crc32(ids[start - base : end - base].astype("<u4").tobytes())))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["key", "start", "n_tokens", "ids_crc32"]
            )

    return ordered.mapInArrow(read, T.StructType(fields))
