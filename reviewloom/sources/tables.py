"""Reading and writing tables, CSV lists and JSON columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions import words as W
from reviewloom.session import cut_lineage

Reader = Callable[[str], DataFrame]


def parquet_reader(spark: SparkSession, root: str) -> Reader:
    return lambda name: spark.read.parquet(f"{root}/{name}")


def catalog_reader(spark: SparkSession, database: str) -> Reader:
    return lambda name: spark.table(f"{database}.{name}")


def jdbc_reader(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    split: dict[str, tuple[str, int, int, int]] | None = None,
) -> Reader:
    """Tables of a database.

    ``split`` maps a large table to ``(id column, lowest id, highest id, parts)``
    so that it is read by that many tasks; the ids only place the cuts, rows
    beyond them are read too.
    """

    def read(name: str) -> DataFrame:
        source = spark.read.format("jdbc").options(url=url, dbtable=name, **properties)
        if split and name in split:
            column, low, high, parts = split[name]
            source = source.options(
                partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts
            )
        return source.load()

    return read


def save_table(
    df: DataFrame, name: str, bucket_by: str | None = None, buckets: int = 200
) -> None:
    """Replace a table.  Bucketing by the id the table is joined on stands in for
    an index: later joins on that id need no shuffle of this side."""
    writer = df.write.mode("overwrite")
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(name)


def replace_table(df: DataFrame, name: str, bucket_by: str | None = None, buckets: int = 200) -> None:
    """Replace a table by a DataFrame that may read that very table.

    Spark refuses to overwrite what a plan reads, so the new rows are written to the
    checkpoint folder first; the table is whole at all times but while it is replaced, and its new rows
    are stored beside it until then.
    """
    save_table(cut_lineage(df), name, bucket_by, buckets)


def save_partitioned(
    df: DataFrame, name: str, partition_by: str, bucket_by: str, buckets: int = 200
) -> None:
    """Replace a table that is to be changed partition by partition (:func:`update_partitions`).

    Rows are dealt by bucket before they are written, so each partition has one file for a bucket.
    """
    columns = [*(c for c in df.columns if c != partition_by), partition_by]
    (
        df.select(*columns).repartition(buckets, bucket_by)
        .write.mode("overwrite").partitionBy(partition_by).bucketBy(buckets, bucket_by).sortBy(bucket_by).saveAsTable(name)
    )


def update_partitions(spark: SparkSession, name: str, changes: DataFrame, key: str, column: str) -> list:
    """Take ``column`` from ``changes`` (``key``, ``column``) into the stored table, and return the partitions touched.

    The table has to be one that :func:`save_partitioned` wrote, bucketed by ``key``.  Only partitions with a row whose
    value changes are read in full and replaced, the others keep their files; rows meet
    their changes where their bucket lies, so the table is not shuffled.  Which partitions those are is found
    on three columns of the table, or on ``changes`` alone, if these have the partition column.  The new rows are written to the
    checkpoint folder before a partition is replaced, and a second run with the same changes touches nothing.
    """
    table = spark.table(name)
    (part,) = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    new = changes.select(key, F.col(column).cast(table.schema[column].dataType).alias("_new"), *([part] if part in changes.columns else []))
    if part in changes.columns:
        hints = [row[0] for row in new.select(part).distinct().collect()]  # a value a partition at most
        table = _in_partitions(table, part, hints)
        new = new.drop(part)
    changed = table.join(new, key).where(F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col(column)))
    touched = [row[0] for row in changed.select(part).distinct().collect()]
    if not touched:
        return []
    rows = _in_partitions(spark.table(name), part, touched)
    updated = rows.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).select(*rows.columns)
    stored = cut_lineage(updated)
    # Which partitions an overwrite replaces is a setting of the session, so a session of its own does it.
    writer = spark.newSession()
    writer.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    folder = stored.inputFiles()[0].rsplit("/", 1)[0]
    writer.read.schema(stored.schema).parquet(folder).write.mode("overwrite").insertInto(name)
    spark.catalog.refreshTable(name)
    return sorted(touched, key=lambda value: (value is not None, value))


def _in_partitions(table: DataFrame, part: str, values: list) -> DataFrame:
    """Rows of these partitions, a test that Spark answers from the folders' names."""
    inside = F.col(part).isin([value for value in values if value is not None])
    return table.where(inside | F.col(part).isNull() if None in values else inside)


def save_jdbc(df: DataFrame, url: str, name: str, properties: dict[str, str]) -> None:
    """Replace the rows of a database table; its definition stays."""
    df.write.option("truncate", True).jdbc(url, name, mode="overwrite", properties=properties)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": name})


def snapshot_table(spark: SparkSession, base: str, copy: str) -> DataFrame:
    """A copy that stays as it is when the base table is overwritten."""
    drop_table(spark, copy)
    spark.table(base).write.saveAsTable(copy)
    return spark.table(copy)


def read_allowed_words(spark: SparkSession, path: str) -> DataFrame:
    """The allow list: a CSV file with one column under the header AllowedWords."""
    return spark.read.csv(path, header=True, schema="AllowedWords string")


def stop_words_from_csv(spark: SparkSession, path: str, stops=W.ENGLISH_STOP_WORDS) -> list[str]:
    """The stop list less an allow list kept in a CSV file.

    The answer is a parameter of the cleaning step and at most as long as
    ``stops``.
    """
    listed = spark.createDataFrame([(word,) for word in stops], "AllowedWords string")
    kept = listed.join(read_allowed_words(spark, path), "AllowedWords", "left_anti")
    return [row.AllowedWords for row in kept.collect()]


def row_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON object."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
