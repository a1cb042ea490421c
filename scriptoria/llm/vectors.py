"""Integer vectors, held as bytes of the smallest integer type that takes all components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Integer components are held to this magnitude.
MOST_COMPONENT = 1 << 50


def integer_vectors(vectors: DataFrame, vector: str, factor: float, **kept: Column) -> DataFrame:
    """``kept`` columns and v, floor(factor * x) of every component; vectors null or with null or non-finite components left out."""
    v = F.col(vector)
    usable = v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    held = lambda x: F.greatest(F.least(x.cast("double") * factor, F.lit(float(MOST_COMPONENT))), F.lit(-float(MOST_COMPONENT)))
    columns = [c.alias(name) for name, c in kept.items()]
    return vectors.filter(usable).select(*columns, F.transform(v, lambda x: F.floor(held(x)).cast("long")).alias("v"))


@dataclass(frozen=True)
class Packing:
    """How vectors are held in bytes: number of components and integer type; shorter vectors end in zeros."""

    size: int
    kind: str
    most: int

    @staticmethod
    def of(*frames: DataFrame) -> Packing:
        rows = [df.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first() for df in frames]
        size, most = max([1, *(r[0] or 0 for r in rows)]), max([1, *(r[1] or 0 for r in rows)])
        return Packing(size, "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8", most)

    def matrix(self, column) -> np.ndarray:
        return np.frombuffer(b"".join(column), dtype=self.kind).reshape(-1, self.size)


def packed(df: DataFrame, packing: Packing) -> DataFrame:
    """``df`` with its column ``v``, the last one, turned into the bytes ``b``."""
    schema = T.StructType([*df.schema.fields[:-1], T.StructField("b", T.BinaryType())])

    def pack(batches):
        for batch in batches:
            v = batch.column(batch.num_columns - 1)
            sizes = np.diff(v.offsets.to_numpy())
            out = np.zeros((batch.num_rows, packing.size), dtype=packing.kind)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = v.flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r.tobytes() for r in out], pa.binary())], names=schema.names)

    return df.mapInArrow(pack, schema)
