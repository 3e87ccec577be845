"""Session settings, kept results and their owner."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A hot text or venue is split by adaptive execution while it is joined.  The
# "force" switch lets it split even where the next step would have reused the
# join's partitioning, at the price of one more shuffle in the skewed case only.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set what the operators count on."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if current:
        return current
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="reviewloom-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there.

    For results that several later steps read and that are dear to make again,
    such as scorer replies and staged summaries.  They are written as Parquet, so
    later steps read only their columns, and Spark knows their size.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/reviewloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    own(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Paths written under the innermost open ``kept_results`` of this thread.
_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def own(path: str) -> None:
    """Have ``path`` deleted with the other results of the open ``kept_results``, if there is one."""
    paths = _OWNED.get()
    if paths is not None:
        paths.append(path)


@contextmanager
def kept_results(spark: SparkSession) -> Iterator[None]:
    """Own what this thread writes by ``cut_lineage`` inside, and delete it at the end.

    Plans that need their intermediate results more than once write them while they are
    built; their DataFrames are good until the block ends.  Other threads own their results themselves.
    """
    token = _OWNED.set([])
    try:
        yield
    finally:
        paths = _OWNED.get()
        _OWNED.reset(token)
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A dimension that is small by its meaning, broadcast; more than ``rows`` rows raise
    when it is read, and nothing is counted before."""
    few = df.agg(F.count("*")).scalar() <= rows
    return F.broadcast(df.where(F.when(few, True).otherwise(F.raise_error(F.lit("too many rows to broadcast")))))


# A broadcast row here is a key and an id, so this is well under 100 MB.
BROADCAST_ROWS = 500_000


def keep_for_broadcast(df: DataFrame) -> tuple[DataFrame, bool]:
    """Write a narrow ``df`` once, count it, and hint it for broadcast if it is small.

    The other side of the join is wide and large.  Adaptive execution finds out how
    small this side is only after it has shuffled both; knowing it beforehand spares
    the large side that shuffle.  The flag tells whether it is small.
    """
    kept = cut_lineage(df)
    small = kept.count() <= BROADCAST_ROWS
    return (F.broadcast(kept) if small else kept), small
