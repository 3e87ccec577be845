"""What the corpus operators share: written intermediates and names that cannot clash."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.session import checkpoint_dir, own

# Rows of a side that may be broadcast: narrow rows, so under 50 MB.
BROADCAST_ROWS = 300_000


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below ``spark.checkpoint.dir`` that nothing uses yet; an open ``kept_results`` owns it."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    own(path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it from there.

    Cuts the lineage: a lost executor repeats tasks of the running step only, and row
    numbers or local groups that depend on how the input was split are fixed.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete what ``keep`` wrote, once a later step has replaced it."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A kept, narrow ``df``, hinted for broadcast if it has at most ``rows`` rows.

    Beyond that the join shuffles both sides, and adaptive execution splits hot keys.
    """
    return F.broadcast(df) if df.count() <= rows else df


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as the struct ``row``, so that extra columns cannot clash."""
    return F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("row")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
