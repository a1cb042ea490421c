"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "scriptoria", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``master`` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: ``spark.checkpoint.dir`` where the cluster names one.

    Only a local master without the setting falls back to a temporary folder; on a
    cluster a machine-local folder would be lost with the machine, so it is refused.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="scriptoria-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


#: Paths of the staged tables of this context, those of the innermost `scratch` block.
_ROOT: list[str] = []
_STAGED: ContextVar[list[str]] = ContextVar("staged", default=_ROOT)


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), len(paths)
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def drop_staged(spark: SparkSession) -> int:
    """Delete every table that `stage` has written outside of `scratch` blocks; returns their number.

    Results built on them can't be read afterwards, so call it when the results are stored.
    """
    return _delete(spark, _ROOT)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete what is staged in the block when it ends, also by an error; blocks may be nested.

    The block gets a function that stages a result outside of itself, so that the result stays.
    """
    outer, mine = _STAGED.get(), []
    token = _STAGED.set(mine)
    try:
        yield lambda df, name: _write(df, name, outer)
    finally:
        _STAGED.reset(token)
        _delete(spark, mine)


def unstage(df: DataFrame) -> None:
    """Delete the staged table that ``df`` was read from; nothing built on it can be computed any more."""
    path = getattr(df, "_staged_path", None)
    held = _STAGED.get()
    if path in held:
        held.remove(path)
        _delete(df.sparkSession, [path])


def _write(df: DataFrame, name: str, held: list[str]) -> DataFrame:
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    held.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the checkpoint folder and read it back.

    For results that several later steps read: the table survives lost executors, its columns
    are pruned by each reader, and nothing before it is computed twice. It stays until the surrounding `scratch` block ends,
    `unstage` or `drop_staged`.
    """
    return _write(df, name, _STAGED.get())


def spread(df: DataFrame) -> DataFrame:
    """Use every core when the input came as fewer splits than there are cores.

    Text expressions are CPU-bound; one small file arrives as one task. An input that is
    already split is returned as it is, so that no shuffle is added on large data.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


#: Rows of a table that is sent to every executor rather than shuffling the pairs that look it up.
SMALL_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """Mark a table of few columns to be sent whole where it is small: the pairs that read it are many more than its rows."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df
