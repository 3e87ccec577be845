"""Table changes as functions: the old table in, the new one out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.text import text_key
from reviewloom.operators.numbering import numbered_rows
from reviewloom.operators.relational import listed_once
from reviewloom.session import cut_lineage


def with_surrogate_keys(
    fresh: DataFrame, existing: DataFrame, id_column: str, order: list[str], few: bool = False,
    keep: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """Number new rows on from the largest key there is, in the order of ``order``.

    Numbering all rows in one go would take one task, which suits a handful only
    (``few``); otherwise sorted ranges are numbered (:func:`numbered_rows`).
    """
    last = F.coalesce(existing.agg(F.max(id_column)).scalar(), F.lit(0))
    kind = existing.schema[id_column].dataType
    if few:
        place = F.row_number().over(Window.orderBy(*order))
        return fresh.withColumn(id_column, (last + place).cast(kind))
    numbered = numbered_rows(fresh, order, keep)
    return numbered.withColumn(id_column, (last + F.col("_number") + 1).cast(kind)).drop("_number")


def absent_rows(
    existing: DataFrame, new: DataFrame, keys: list[str], id_column: str | None = None,
    order: list[str] | None = None, few: bool = False,
) -> DataFrame:
    """New rows whose natural key the table does not hold, numbered if it has an id.

    Keys may be of any type; a null in a key is a value like others, so that a row with it is
    added once.  With ``id_column`` and not ``few``, the new rows are written while this is
    called, to be numbered.
    """
    known = existing.select(*[F.col(key).alias(f"_{key}") for key in keys])
    same = reduce(and_, [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys])
    fresh = new.join(known, same, "left_anti").select(*new.columns)
    if id_column:
        fresh = with_surrogate_keys(fresh, existing, id_column, order or keys, few)
    return fresh.select(*existing.columns)


def insert_if_absent(
    existing: DataFrame, new: DataFrame, keys: list[str], id_column: str | None = None,
    order: list[str] | None = None, few: bool = False,
) -> DataFrame:
    """Append the rows whose natural key is missing.  Doing it twice adds nothing."""
    return existing.unionByName(absent_rows(existing, new, keys, id_column, order, few))


RANGE_KEYS = ["StartDateID", "EndDateID", "Months"]


def insert_date_ranges(date_range: DataFrame, ranges: DataFrame) -> DataFrame:
    """Add windows the table lacks; there are never more than a few."""
    return insert_if_absent(date_range, ranges, RANGE_KEYS, "DateRangeID", few=True)


def date_range_upsert(date_range: DataFrame, start: int, end: int, months: int) -> DataFrame:
    row = date_range.sparkSession.sql(
        "SELECT :start AS StartDateID, :end AS EndDateID, :months AS Months",
        args={"start": start, "end": end, "months": months},
    )
    return insert_date_ranges(date_range, row)


def update_column(table: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Take ``column`` from ``changes`` where there is a change, else keep it.

    ``changes`` holds at most one row for a key.
    """
    new = changes.select(key, F.col(column).alias("_new"))
    return (
        table.join(new, key, "left")
        .withColumn(column, F.coalesce("_new", column))
        .select(*table.columns)
    )


def delete_by_text(table: DataFrame, texts: DataFrame, text: str = "ReviewText") -> DataFrame:
    """Drop the rows whose text is listed; rows without a text stay.

    Texts are compared by their digests: the listed ones don't travel, and each once.
    """
    listed = texts.where(F.col(text).isNotNull()).select(text_key(F.col(text)).alias("_key"))
    keyed = table.withColumn("_key", F.when(F.col(text).isNotNull(), text_key(F.col(text))))
    return keyed.join(listed_once(listed, ["_key"]), "_key", "left_anti").select(*table.columns)
