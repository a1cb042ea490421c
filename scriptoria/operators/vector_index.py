"""Approximate nearest neighbours from stored hash tables, built once and extended when vectors are added.

Spark ML's random projections hash unit vectors. Several projections make one bucket key, so that far vectors rarely share it, and
several keys, the tables, give near vectors several chances to share one. What shares a bucket with a query is compared exactly.

Vectors are stored in blocks of up to `vector_join.BLOCK_ROWS` with their bucket keys, a row each. A search reads the blocks in a cross product with
blocks of queries: a task finds who shares a bucket, compares those and hands on each query's best, so that nothing is sent or written per candidate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import small, stage
from . import vector_join as vj
from .vector_join import SLACK, best_of_task, block_scores

#: Unit vectors on which the projections are drawn; only their dimension matters to them.
FIT_ROWS = 100
#: Rows of a bucket that meet as many queries in one task.
HOT_BUCKET = 4096
#: Pairs of one bucket that a task marks at once.
PAIRS_AT_ONCE = 1 << 20


def _blocks(rows: DataFrame, id_type: str) -> DataFrame:
    """(ids, u, buckets): rows (id, u, buckets) in blocks of up to `vector_join.BLOCK_ROWS`, arrays of a block one after another; no shuffle."""
    block_rows = vj.BLOCK_ROWS

    def pack(batches):
        for pdf in batches:
            for at in range(0, len(pdf), block_rows):
                part = pdf.iloc[at : at + block_rows]
                yield pd.DataFrame({"ids": [part["id"].to_numpy()], "u": [np.concatenate(part["u"].to_numpy())], "buckets": [np.concatenate(part["buckets"].to_numpy())]})

    return rows.select("id", "u", "buckets").mapInPandas(pack, f"ids array<{id_type}>, u array<double>, buckets array<long>")


class _Shared:
    """Scores of the vectors of two blocks that share a bucket, from 0 to 1, else minus infinity."""

    def __init__(self):
        self.block = None

    def __call__(self, row) -> np.ndarray:
        if row.guest_block != self.block:
            keys = np.asarray(row.guest_buckets)
            order = np.argsort(keys, kind="stable")
            self.block, self.keys, self.owner = row.guest_block, keys[order], order // (len(keys) // len(row.guest_ids))
        buckets = np.asarray(row.buckets)
        first, last = (np.searchsorted(self.keys, buckets, side=side) for side in ("left", "right"))
        asked = np.flatnonzero(last > first)
        n, first, home = (last - first)[asked], first[asked], asked // (len(buckets) // len(row.ids))
        met = np.zeros((len(row.guest_ids), len(row.ids)), dtype=bool)
        ends, at = np.cumsum(n), 0
        while at < len(n):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
            k = n[at:stop]
            place = np.arange(k.sum()) + np.repeat(first[at:stop] - (np.cumsum(k) - k), k)
            met[self.owner[place], np.repeat(home[at:stop], k)] = True
            at = stop
        return np.where(met, np.clip(block_scores(row), 0.0, 1.0), -np.inf)


@dataclass(frozen=True)
class HashIndex:
    """An index in ``folder``: the hash functions, and the unit vectors with their bucket keys in blocks (ids, u, buckets), appended in parts."""

    spark: SparkSession
    folder: str

    @staticmethod
    def create(
        vectors: DataFrame, folder: str, key: str, vector: str, tables: int = 12, projections: int = 4, width: float = 0.25, seed: int = 42
    ) -> HashIndex:
        """Draw the hash functions and store all vectors.

        ``tables`` more raise the share of neighbours that are found, ``projections`` more and a smaller ``width`` lower the number
        of comparisons; `recall` measures both on the data.
        """
        units = vj.unit_rows(vectors, key, vector)
        sample = units.limit(FIT_ROWS).select(array_to_vector("u").alias("features"))
        hashes = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables * projections, seed=seed)
        hashes.fit(sample).write().overwrite().save(f"{folder}/hashes")
        vectors.sparkSession.createDataFrame([(tables, projections)], "tables int, projections int").write.mode("overwrite").parquet(f"{folder}/settings")
        index = HashIndex(vectors.sparkSession, folder)
        index._append(units)
        return index

    def add(self, vectors: DataFrame, key: str, vector: str) -> None:
        """Store the vectors whose ids the index doesn't hold; the others and all that is stored stay as they are."""
        units = vj.unit_rows(vectors, key, vector).dropDuplicates(["id"])
        self._append(units.join(self.units().select("id"), "id", "left_anti"))

    def stored(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/units")

    def _rows(self, column: str, name: str) -> DataFrame:
        """(id, ``name``): what each stored vector has in an array of its block."""
        n = F.size("ids")
        width = (F.size(column) / n).cast("int")
        each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(column, i * width + 1, width))
        return self.stored().select(F.inline(F.arrays_zip(F.col("ids").alias("id"), each.alias(name))))

    def units(self) -> DataFrame:
        return self._rows("u", "u")

    def _append(self, units: DataFrame) -> None:
        _blocks(self.hashed(units), units.schema["id"].dataType.simpleString()).write.mode("append").parquet(f"{self.folder}/units")

    def hashed(self, units: DataFrame) -> DataFrame:
        """(id, u, buckets): a bucket key for each table; the key holds the table's number."""
        model = BucketedRandomProjectionLSHModel.load(f"{self.folder}/hashes")
        settings = self.spark.read.parquet(f"{self.folder}/settings").first()
        hashed = model.transform(units.withColumn("features", array_to_vector("u")))
        codes = [F.get(vector_to_array(F.get("hashes", F.lit(i))), F.lit(0)).cast("long") for i in range(settings.tables * settings.projections)]
        keys = [
            F.xxhash64(F.lit(t), *codes[t * settings.projections : (t + 1) * settings.projections]) for t in range(settings.tables)
        ]
        return hashed.select("id", "u", F.array(*keys).alias("buckets"))

    def candidates(self, queries: DataFrame) -> DataFrame:
        """(query, id): what shares a bucket with each query (id, u), each once. A bucket of many rows is dealt to several tasks."""
        buckets = self._rows("buckets", "buckets").select(F.explode("buckets").alias("bucket"), "id")
        asked = self.hashed(queries).select(F.explode("buckets").alias("bucket"), F.col("id").alias("query"))
        sizes = buckets.join(asked.select("bucket").distinct(), "bucket", "left_semi").groupBy("bucket").agg(F.ceil(F.count("*") / HOT_BUCKET).cast("int").alias("parts"))
        split = asked.join(sizes, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        held = buckets.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        return split.join(held, ["bucket", "part"]).select("query", "id").distinct()

    def _best(self, queries: DataFrame, k: int, threshold: float, exclude_self: bool) -> DataFrame:
        """(query, id): the k best candidates of each query in every task that compares blocks, or fewer."""
        id_type = queries.schema["id"].dataType.simpleString()
        # one block is one task; it is not dealt by rows that come as few to a split
        dealt = self.hashed(queries).repartition(max(1, math.ceil(queries.count() / vj.BLOCK_ROWS)))
        floors = F.array_repeat(F.lit(float(threshold)), F.size("ids"))
        guests = stage(_blocks(dealt, id_type).withColumn("floors", floors), "asked_blocks")

        def kernel(batches):
            return best_of_task(batches, k, threshold - SLACK, exclude_self, _Shared())

        found = vj.cross_blocks(guests, self.stored(), kernel, f"query {id_type}, neighbour {id_type}, score double")
        return found.select("query", F.col("neighbour").alias("id"))

    def search(self, queries: DataFrame, key: str, vector: str, k: int = 10, threshold: float = 0.0, exclude_self: bool = False) -> DataFrame:
        """(query, neighbour, score, rank): the k best of the rows that share a bucket with a query, by their exact cosine."""
        asked = vj.unit_rows(queries, key, vector)
        pairs = self._best(asked, k, threshold, exclude_self)
        # pairs are sent as ids to the stored vectors; the queries' vectors go to every task, or follow where they are many
        both = pairs.join(self.units(), "id").join(small(asked.select(F.col("id").alias("query"), F.col("u").alias("uq"))), "query")
        score = F.aggregate(F.zip_with("uq", "u", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        scored = both.select("query", F.col("id").alias("neighbour"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score")).filter(F.col("score") >= threshold)
        ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "neighbour")))
        return ranked.filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: how many of the exact neighbours (query, neighbour) there are, how many were found, and their share."""
    hit = exact.join(found.select("query", "neighbour", F.lit(1).alias("hit")), ["query", "neighbour"], "left")
    return hit.agg(F.count("*").alias("exact"), F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall"))
