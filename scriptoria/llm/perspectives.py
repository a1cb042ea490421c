"""Operator 2: multi-party dialogues rendered from the view of every participant."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How a turn is written. The name stands where {} does.
OWN_OPEN, OTHER_OPEN, CLOSE = "<|im_start|>assistant\n", "<|im_start|>user name={}\n", "<|im_end|>\n"
UNNAMED = "unknown"
#: Turn numbers that are counted together, and characters of a part of a long dialogue.
TURN_BUCKET, PART_CHARS = 256, 1 << 20


def render(turns: list[tuple[str, str]], speaker: str) -> tuple[str, list[tuple[int, int]]]:
    """Text of (name, text) turns with ``speaker`` as the assistant, and the spans on which it is trained.

    A span is the speaker's text and the mark that closes the turn; what others say and all headers are masked.
    """
    out, spans, at = [], [], 0
    for name, text in turns:
        head = OWN_OPEN if name == speaker else OTHER_OPEN.format(name)
        whole = head + text + CLOSE
        if name == speaker:
            spans.append((at + len(head), at + len(whole) - 1))
        out.append(whole)
        at += len(whole)
    return "".join(out), spans


def rotate(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", part_chars: int = PART_CHARS
) -> DataFrame:
    """(conv_id, speaker, part, start, n_turns, text, spans): each dialogue once for every participant.

    ``spans`` are (start, end) in characters of ``text``, end exclusive; everything else is masked. ``start`` is where the part
    begins in that participant's whole dialogue. A dialogue is one part unless its turns, written as others' turns, pass
    ``part_chars``: then turns are dealt to parts by the characters before them, so that no dialogue needs to fit into
    a task. Characters are summed within buckets of turn numbers first and carried on from bucket to bucket.

    Turns are in the order of (turn, speaker, text), null turns first; repeated rows are said as often as they occur.
    Null speakers are named `unknown`; null texts are empty. A null conversation is one of its own. An empty table gives no rows. Other
    columns are not read.
    """
    own = turns.select(
        F.col(conversation).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit(UNNAMED)).alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    others = len(OTHER_OPEN.format("")) + len(CLOSE)
    sized = own.withColumn("size", (F.length("text") + F.length("name") + others).cast("long")).withColumn("bucket", F.floor(F.col("turn") / TURN_BUCKET))
    totals = sized.groupBy("conv", "bucket").agg(F.sum("size").alias("total"))
    carried = totals.withColumn("carried", F.sum("total").over(W.partitionBy("conv").orderBy("bucket")) - F.col("total"))
    c = carried.select(F.col("conv").alias("c"), F.col("bucket").alias("b"), "carried")
    within = W.partitionBy("conv", "bucket").orderBy("turn", "name", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    ordered = sized.withColumn("before", F.sum("size").over(within) - F.col("size"))
    at = ordered.join(c, [ordered["conv"].eqNullSafe(c["c"]), ordered["bucket"].eqNullSafe(c["b"])]).withColumn("before", F.col("before") + F.col("carried"))
    parts = at.groupBy("conv", F.floor(F.col("before") / part_chars).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("before", "turn", "name", "text"))).alias("turns")
    )
    named = own.select("conv", "name").distinct().select(F.col("conv").alias("c"), F.col("name").alias("speaker"))
    views = parts.join(named, parts["conv"].eqNullSafe(named["c"])).select(
        "conv", "speaker", "part", F.col("turns.name").alias("names"), F.col("turns.text").alias("texts")
    )
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*views.schema.fields[:3], T.StructField("n_turns", T.LongType()), T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(span))])

    def run(batches):
        for batch in batches:
            texts, spans, n = [], [], []
            for who, names, said in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4))):
                whole, own_spans = render(list(zip(names, said)), who)
                texts.append(whole)
                spans.append([{"start": a, "end": b} for a, b in own_spans])
                n.append(len(names))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, kind)], names=schema.names)

    rendered = views.mapInArrow(run, schema)
    size = F.length("text").cast("long")
    start = F.sum(size).over(W.partitionBy("conv", "speaker").orderBy("part")) - size
    return rendered.withColumn("start", start).select(F.col("conv").alias("conv_id"), "speaker", "part", "start", "n_turns", "text", "spans")
