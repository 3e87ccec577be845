"""Numbering rows in order without bringing them together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.session import cut_lineage


def numbered_rows(
    rows: DataFrame, order: list[str], keep: Callable[[DataFrame], DataFrame] = cut_lineage
) -> DataFrame:
    """``rows`` with ``_number``, from 0 in the order of ``order``, nulls first.

    Rows are dealt to sorted ranges of ``order``, of any type, and written once with the number of their range and
    their place in it, as the bounds of ranges are sampled.  Only the ranges' sizes, one number each, meet in one place.
    """
    # Range and place in one number: the upper 31 bits count tasks, the lower 33 the rows of a task.
    ranged = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(F.shiftright("_at", 33).alias("_range"))
        .agg(F.count("*").alias("_size"))
        .select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    )
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    return (
        ranged.withColumn("_range", F.shiftright("_at", 33))
        .join(F.broadcast(starts), "_range")
        .withColumn("_number", F.col("_start") + place)
        .drop("_range", "_at", "_start")
    )
