"""Joins, set membership and selections over the star."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.text import text_key
from reviewloom.operators.numbering import numbered_rows
from reviewloom.session import checked_broadcast, cut_lineage
from reviewloom.sources.star import ReviewStar


def venue_operator(star: ReviewStar, operator_ids: list[int] | None = None) -> DataFrame:
    """Venue, brand and operator chained; an empty selection keeps nothing.

    No broadcast is asked for: the venue side grows with the data, and Spark
    broadcasts it only while its size allows.
    """
    operators = star.operator
    if operator_ids is not None:
        operators = operators.where(F.col("OperatorID").isin(list(operator_ids)))
    return (
        star.venue.select("VenueID", "BrandID")
        .join(star.brand.select("BrandID", "OperatorID"), "BrandID")
        .join(operators.select("OperatorID", "OperatorName"), "OperatorID")
        .select("VenueID", "OperatorID", "OperatorName")
    )


def venue_region(star: ReviewStar) -> DataFrame:
    """Venue, postcode and region chained."""
    return (
        star.venue.select("VenueID", "PostcodeID")
        .join(star.postcode.select("PostcodeID", "RegionID"), "PostcodeID")
        .join(star.region.select("RegionID", "Region"), "RegionID")
        .select("VenueID", "RegionID", "Region")
    )


def review_operator(star: ReviewStar, operator_ids: list[int] | None = None) -> DataFrame:
    """Reviews with the operator of their venue."""
    return star.review.join(venue_operator(star, operator_ids), "VenueID")


def operator_left_reviews(star: ReviewStar) -> DataFrame:
    """Every operator with its reviews that have a text, and operators without any.

    The text test belongs to the join, so it narrows the reviews and never drops
    an operator.  The last left join is written as its matching rows and the rest:
    the reviews of a busy venue can be split in an inner join, but not as the
    optional side of an outer one.
    """
    written = star.review.where(F.col("ReviewText").isNotNull()).select("ReviewID", "VenueID")
    venues = (
        star.operator.join(star.brand, "OperatorID", "left")
        .join(star.venue.select("VenueID", "BrandID"), "BrandID", "left")
        .select("OperatorID", "OperatorName", "VenueID")
    )
    unreviewed = venues.join(listed_once(written, ["VenueID"]), "VenueID", "left_anti")
    rows = written.join(venues, "VenueID").unionByName(unreviewed, allowMissingColumns=True)
    return rows.select("OperatorID", "OperatorName", "VenueID", "ReviewID")


def sentiments(star: ReviewStar) -> DataFrame:
    """The sentiment dimension, broadcast: its rows are the eleven scores and the two
    unknown states, however many reviews there are.  Joined by shuffle, thirteen
    keys would leave all but thirteen tasks idle.  A table of over
    a thousand rows raises when it is read."""
    return checked_broadcast(star.sentiment, 1000)


def named_venues(star: ReviewStar, operator_names: list[str]) -> DataFrame:
    """Venues whose export row carries one of the operator names."""
    export = star.venue_export.where(F.col("OperatorName").isin(sorted(set(operator_names))))
    return star.venue.join(export, "OperatorVenueCode", "left_semi").select("VenueID")


def without(rows: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among ``taken``."""
    return rows.join(taken.select(*keys), keys, "left_anti").select(*rows.columns)


def having(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is among ``wanted``; writes the listed keys while it is called."""
    return rows.join(listed_once(wanted, keys), keys, "left_semi").select(*rows.columns)


def having_text(rows: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """Rows whose text is among those of ``wanted``, compared by digest."""
    listed = wanted.where(F.col(text).isNotNull()).select(text_key(F.col(text)).alias("_key"))
    keyed = rows.where(F.col(text).isNotNull()).withColumn("_key", text_key(F.col(text)))
    return having(keyed, listed, ["_key"]).select(*rows.columns)


def listed_once(
    rows: DataFrame, keys: list[str], keep: Callable[[DataFrame], DataFrame] = cut_lineage
) -> DataFrame:
    """The distinct keys of ``rows``, kept, for the listed side of a semi or anti join.

    Straight from their grouping the keys would lie where the join wants them, and adaptive
    execution splits a hot key of the other side only where both sides are shuffled for
    the join itself.
    """
    return keep(rows.select(*keys).distinct())


def not_in(rows: DataFrame, column: str, listed: DataFrame, listed_column: str) -> DataFrame:
    """SQL ``NOT IN`` without broadcasting the list.

    A null in the list empties the answer, and a null in ``column`` passes an
    empty list only.  Both are read off two counts of the list, so the rows
    themselves go through an ordinary anti join.
    """
    values = listed.select(F.col(listed_column).alias(column))
    size = values.agg(F.count("*")).scalar()
    nulls = values.agg(F.count_if(F.col(column).isNull())).scalar()
    return rows.join(values, column, "left_anti").where(
        (size == 0) | ((nulls == 0) & F.col(column).isNotNull())
    )


def select_members(dimension: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Dimension rows whose name the user picked."""
    return dimension.where(F.col(column).isin(list(names)))


def search_dimension(dimension: DataFrame, column: str, query: str) -> DataFrame:
    """Case-blind substring search; an empty query keeps every row."""
    return dimension.where(F.lower(F.col(column)).contains(query.lower()))


def key_of(dimension: DataFrame, column: str, value: str, key: str) -> Column:
    """The key of the row holding ``value``, as a one-value subquery."""
    return dimension.where(F.col(column) == value).agg(F.min(key)).scalar()


def nth_group(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """All rows of the n-th distinct key, counted from 0 in key order, nulls first.

    The distinct keys are numbered by sorted ranges, whose sizes alone meet in one place, so any
    ``n`` costs the same.  One key comes back, which makes the broadcast safe.
    """
    numbered = numbered_rows(rows.select(*keys).distinct(), keys)
    nth = numbered.where(F.col("_number") == n).select(*[F.col(key).alias(f"_{key}") for key in keys])
    same = reduce(and_, [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys])
    return rows.join(F.broadcast(nth), same, "left_semi")
