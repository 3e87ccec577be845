"""Storing scores: new state of the review, flag and bridge tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom import schema
from reviewloom.functions.scores import raw_phrase_score, raw_score
from reviewloom.functions.text import phrase_key, phrase_label, phrase_label_key
from reviewloom.operators.relational import sentiments
from reviewloom.operators.upserts import absent_rows, insert_if_absent, update_column
from reviewloom.session import cut_lineage, keep_for_broadcast
from reviewloom.sources.star import ReviewStar


def with_sentiment_id(scored: DataFrame, star: ReviewStar, raw: str) -> DataFrame:
    """Find the sentiment of a raw score.  Two sentiments share the unknown score; the
    processed one is meant."""
    dimension = sentiments(star).select("SentimentID", "SentimentText", "SentimentRawScore")
    known = (F.col("SentimentText") == schema.PROCESSED_UNKNOWN) | (F.col(raw) != schema.UNKNOWN_RAW)
    return scored.join(dimension, (F.col(raw) == F.col("SentimentRawScore")) & known)


def scored_ids(star: ReviewStar, scores: DataFrame) -> DataFrame:
    """(ReviewID, ReviewSentimentID) of scored reviews."""
    raw = scores.select("ReviewID", raw_score(F.col("Sentiment")).alias("Raw"))
    return with_sentiment_id(raw, star, "Raw").select(
        "ReviewID", F.col("SentimentID").alias("ReviewSentimentID")
    )


def writeback_overall(star: ReviewStar, scores: DataFrame) -> DataFrame:
    """The review table with the new sentiment ids."""
    changes, _ = keep_for_broadcast(scored_ids(star, scores))
    return update_column(star.review, changes, "ReviewID", "ReviewSentimentID")


@dataclass(frozen=True)
class PhraseTables:
    flags: DataFrame
    reviews: DataFrame
    added: DataFrame  # the rows of ``reviews`` that were not stored before


def phrase_rows(
    star: ReviewStar, scores: DataFrame, phrases: list[str], from_star: bool = False
) -> DataFrame:
    """(ReviewID, Phrase, PhraseFlag, PhraseSentimentID) of scored reviews that exist.

    The phrase is spelled as it is stored already, if it is.  ``from_star`` says that
    ``scores`` were made from reviews of this star, which spares looking for them there.
    """
    if not from_star:
        scores = scores.join(star.review.select("ReviewID"), "ReviewID", "left_semi")
    same = phrase_key(F.col("Phrase")) == phrase_label_key(phrases)
    stored = star.phrase_flag.where(same).agg(F.min("Phrase")).scalar()
    raw = scores.select(
        "ReviewID",
        F.coalesce(stored, F.lit(phrase_label(phrases))).alias("Phrase"),
        "PhraseFlag",
        raw_phrase_score(F.col("PhraseFlag"), F.col("Sentiment")).alias("Raw"),
    )
    return with_sentiment_id(raw, star, "Raw").select(
        "ReviewID", "Phrase", "PhraseFlag", F.col("SentimentID").alias("PhraseSentimentID")
    )


FLAG_KEYS = ["Phrase", "PhraseFlag", "PhraseSentimentID"]


def upsert_phrase_flags(flags: DataFrame, rows: DataFrame) -> DataFrame:
    """The flag table with the combinations it lacked; a phrase has thirteen at most.

    Phrases are compared in their normal form: a second spelling adds nothing.
    """
    known = flags.select(phrase_key(F.col("Phrase")).alias("_key"), *FLAG_KEYS[1:])
    wanted = rows.select(*FLAG_KEYS).distinct().withColumn("_key", phrase_key(F.col("Phrase")))
    fresh = wanted.join(known, ["_key", *FLAG_KEYS[1:]], "left_anti").drop("_key")
    return insert_if_absent(flags, fresh, FLAG_KEYS, "PhraseSentimentFlagID", few=True)


def absent_phrase_reviews(bridge: DataFrame, flags: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs that the bridge table lacks; of several spellings the first flag counts."""
    keyed = flags.groupBy(phrase_key(F.col("Phrase")).alias("_key"), *FLAG_KEYS[1:]).agg(
        F.min("PhraseSentimentFlagID").alias("PhraseSentimentFlagID")
    )
    pairs = (
        rows.withColumn("_key", phrase_key(F.col("Phrase")))
        .join(keyed, ["_key", *FLAG_KEYS[1:]])
        .select("ReviewID", "PhraseSentimentFlagID")
    )
    return absent_rows(bridge, pairs, ["ReviewID", "PhraseSentimentFlagID"])


def upsert_phrase_reviews(bridge: DataFrame, flags: DataFrame, rows: DataFrame) -> DataFrame:
    """The bridge table with the pairs it lacked."""
    return bridge.unionByName(absent_phrase_reviews(bridge, flags, rows))


def writeback_phrase(
    star: ReviewStar, scores: DataFrame, phrases: list[str],
    keep: Callable[[DataFrame], DataFrame] = cut_lineage, from_star: bool = False,
) -> PhraseTables:
    """Both new tables.

    The scored rows and the flags are read by several steps, so both are kept first.  Flags are few, and as
    a table of known size they are broadcast: dealt by flag, the scored rows would go to as many tasks as a phrase has flags.
    """
    rows = keep(phrase_rows(star, scores, phrases, from_star))
    return phrase_tables(star, rows, keep)


def phrase_tables(star: ReviewStar, rows: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> PhraseTables:
    """Both new tables from kept rows of any number of phrases."""
    flags = keep(upsert_phrase_flags(star.phrase_flag, rows))
    added = absent_phrase_reviews(star.phrase_review, flags, rows)
    return PhraseTables(flags, star.phrase_review.unionByName(added), added)
