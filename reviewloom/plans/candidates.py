"""Choosing the reviews that still need a score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom import schema
from reviewloom.functions.text import phrase_key, phrase_label_key, text_key
from reviewloom.operators.relational import named_venues, sentiments
from reviewloom.session import keep_for_broadcast
from reviewloom.sources.star import ReviewStar


def _select_texts(
    reviews: DataFrame, wanted: DataFrame, min_date: int | None, frame: str, ignore_case: bool
) -> DataFrame:
    """All copies of the texts of ``wanted`` that pass the date test.

    ``wanted`` has (ReviewID, TextKey, Wanted).  A running maximum of dates in id
    order reaches ``min_date`` from the first id on whose own date does, so one
    small aggregate for each text takes the place of a window over its copies.  Only
    key, id and date of a review take part in that; the texts themselves are read
    once, and shuffled only when the wanted keys are too many to broadcast.
    """
    dated = F.lit(True) if min_date is None else F.col("Review_DateID") >= min_date
    texts = (
        wanted.groupBy("TextKey")
        .agg(
            F.bool_or("Wanted").alias("Wanted"),
            F.min(F.when(dated, F.col("ReviewID"))).alias("FirstID"),
        )
        .where("Wanted AND FirstID IS NOT NULL")
        .select("TextKey", "FirstID")
    )
    texts, _ = keep_for_broadcast(texts)
    copies = (
        reviews.where(F.col("ReviewText").isNotNull())
        .select("ReviewID", "ReviewText")
        .withColumn("TextKey", text_key(F.col("ReviewText"), ignore_case))
        .join(texts, "TextKey")
    )
    if frame == "running":
        copies = copies.where(F.col("ReviewID") >= F.col("FirstID"))
    elif frame != "full":
        raise ValueError("frame is 'running' or 'full'")
    return copies.select("ReviewID", "ReviewText")


def _keyed(star: ReviewStar, ignore_case: bool) -> DataFrame:
    return star.review.where(F.col("ReviewText").isNotNull()).select(
        "ReviewID",
        "VenueID",
        "Review_DateID",
        "ReviewSentimentID",
        text_key(F.col("ReviewText"), ignore_case).alias("TextKey"),
    )


def _of_operators(star: ReviewStar, keyed: DataFrame, operator_names: list[str] | None) -> DataFrame:
    """Unset Wanted on reviews of other operators; the rows stay, since their dates count."""
    if not operator_names:
        return keyed
    venues = named_venues(star, operator_names).withColumn("_named", F.lit(True))
    return keyed.join(venues, "VenueID", "left").withColumn(
        "Wanted", F.col("Wanted") & F.coalesce("_named", F.lit(False))
    )


def candidates_overall(
    star: ReviewStar,
    min_date: int | None = None,
    operator_names: list[str] | None = None,
    frame: str = "running",
    ignore_case: bool = False,
) -> DataFrame:
    """Reviews whose text also occurs on an unprocessed review."""
    unprocessed = sentiments(star).where(F.col("SentimentText") == schema.UNPROCESSED).select(
        F.col("SentimentID").alias("ReviewSentimentID"), F.lit(True).alias("_open")
    )
    keyed = _keyed(star, ignore_case).join(unprocessed, "ReviewSentimentID", "left").withColumn(
        "Wanted", F.coalesce("_open", F.lit(False))
    )
    return _select_texts(
        star.review, _of_operators(star, keyed, operator_names), min_date, frame, ignore_case
    )


def candidates_phrase(
    star: ReviewStar,
    phrases: list[str],
    min_date: int | None = None,
    operator_names: list[str] | None = None,
    frame: str = "running",
    ignore_case: bool = False,
) -> DataFrame:
    """Reviews whose text also occurs on a review without a flag for the phrase."""
    flags = star.phrase_flag.where(phrase_key(F.col("Phrase")) == phrase_label_key(phrases))
    flagged = (
        star.phrase_review.join(flags, "PhraseSentimentFlagID", "left_semi")
        .select("ReviewID")
        .distinct()
        .withColumn("_flagged", F.lit(True))
    )
    keyed = _keyed(star, ignore_case).join(flagged, "ReviewID", "left").withColumn(
        "Wanted", F.col("_flagged").isNull()
    )
    return _select_texts(
        star.review, _of_operators(star, keyed, operator_names), min_date, frame, ignore_case
    )
