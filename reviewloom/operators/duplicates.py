"""Work on equal texts: collapsing copies, id lists, label copying, running dates.

One text may make up a large part of all reviews, so no step here collects the
copies of a text in one place: groups are cut by blocks of review ids, which are
unique, and a block therefore never holds more rows than its width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.text import text_key

ID_BLOCK = 1 << 20


def id_block(column: str, width: int) -> Column:
    """Number of the block of an integer id; whole-number division, also below zero."""
    return F.expr(f"(`{column}` - pmod(`{column}`, {width}L)) div {width}L")


def collapse_duplicates(rows: DataFrame, text: str, id_column: str = "ReviewID") -> DataFrame:
    """One row for each distinct text: its smallest id and its number of copies.

    Copies are counted on the map side, so a common text costs one row per task.
    """
    return rows.groupBy(text).agg(
        F.min(id_column).alias(id_column), F.count("*").alias("Copies")
    )


def duplicate_id_lists(
    rows: DataFrame, text: str, id_column: str = "ReviewID", width: int = 10_000
) -> DataFrame:
    """Ids of each text in lists of at most ``width``, one list for a block of ids."""
    return (
        rows.groupBy(text, id_block(id_column, width).alias("Block"))
        .agg(F.sort_array(F.collect_list(id_column)).alias("MatchedTextIDs"))
    )


def fan_out(scored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Give every copy the result of its text; ``scored`` has one row a key.

    Adaptive execution splits the copies of a hot text.  For that ``scored`` has to
    come from storage or a checkpoint: the result of a grouping by the same key
    already lies where the join wants it, and is not shuffled with the copies.
    """
    return rows.join(scored, key)


def propagate_labels(
    rows: DataFrame,
    labels: DataFrame,
    id_column: str,
    text: str,
    label_columns: list[str],
    only_text: str | None = None,
    ignore_case: bool = False,
) -> DataFrame:
    """New ``(id, label)`` rows: labels of any copy of a text, for the copies that
    lack them.  Labels are made distinct for each text before they meet the copies."""
    written = rows.where(F.col(text).isNotNull())
    if only_text is not None:
        written = written.where(F.col(text) == only_text)
    keyed = written.select(id_column, text_key(F.col(text), ignore_case).alias("TextKey"))
    known = keyed.join(labels, id_column).select("TextKey", *label_columns).distinct()
    return (
        keyed.join(known, "TextKey")
        .select(id_column, *label_columns)
        .join(labels, [id_column, *label_columns], "left_anti")
    )


def running_max(
    rows: DataFrame, group: Column, value: str, id_column: str = "ReviewID",
    name: str = "RunningMax", width: int = ID_BLOCK,
) -> DataFrame:
    """Largest ``value`` of a group among the ids up to each row's own.

    A window over the whole group would put a common text into one task.  Each
    block of ids keeps its own running maximum instead, and takes over the maximum
    of the blocks before it.  Blocks are put into blocks of ``width`` in turn, until one is left
    for 64-bit ids, so no window holds more than ``width`` rows, however the ids are
    spread.  Rows whose group is null are a group of their own.
    """
    blocks = rows.withColumn("_group", group).withColumn("_block", id_block(id_column, width))
    within = Window.partitionBy("_group", "_block").orderBy(id_column)
    own = blocks.withColumn("_own", F.max(value).over(within))
    highest = blocks.groupBy("_group", "_block").agg(F.max(value).alias("_highest"))
    carried = _carried(highest, width, 2 * width.bit_length() - 2)
    on = F.col("b._group").eqNullSafe(F.col("c._group")) & (F.col("b._block") == F.col("c._block"))
    return (
        own.alias("b").join(carried.alias("c"), on)
        .withColumn(name, F.greatest("_own", "_carried"))
        .select("b.*", name)
        .drop("_group", "_block", "_own")
    )


def _carried(highest: DataFrame, width: int, bits: int) -> DataFrame:
    """Maximum of the blocks before each block, of rows ``_group, _block, _highest``.

    ``bits`` of an id are spent when the blocks above have been worked out.
    """
    above = highest.withColumn("_above", id_block("_block", width))
    before = Window.partitionBy("_group", "_above").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    own = above.withColumn("_before", F.max("_highest").over(before))
    if bits > 64:
        # Ids have 64 bits, so every block lies in block 0 or -1 of this level.
        low = above.where("_above < 0").groupBy("_group").agg(F.max("_highest").alias("_carried")).withColumn("_above", F.lit(0).cast("long"))
    else:
        upper = above.groupBy("_group", "_above").agg(F.max("_highest").alias("_highest")).withColumnRenamed("_above", "_block")
        low = _carried(upper, width, bits + width.bit_length() - 1).withColumnRenamed("_block", "_above")
    on = F.col("o._group").eqNullSafe(F.col("l._group")) & (F.col("o._above") == F.col("l._above"))
    return own.alias("o").join(low.alias("l"), on, "left").select(
        F.col("o._group").alias("_group"), F.col("o._block").alias("_block"), F.greatest("_before", "_carried").alias("_carried")
    )
