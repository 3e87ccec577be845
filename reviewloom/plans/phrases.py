"""Any number of phrases in one run: one scan, one cleaning, one score a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom import schema
from reviewloom.functions import words as W
from reviewloom.functions.phrasebook import PhraseBook
from reviewloom.functions.scores import raw_phrase_score, rescale_score
from reviewloom.functions.text import clean_text, lexicon_score, phrase_key, text_key, word_list
from reviewloom.operators.relational import named_venues
from reviewloom.plans.writeback import PhraseTables, phrase_tables, with_sentiment_id
from reviewloom.session import cut_lineage, keep_for_broadcast
from reviewloom.sources.star import ReviewStar


def _numbered(star: ReviewStar, book: PhraseBook) -> DataFrame:
    """(PhraseSentimentFlagID, Number) of the stored flags of these phrases; at most 13 a phrase."""
    keys = F.create_map(*[F.lit(part) for number, label in enumerate(book.labels) for part in (label.lower(), number)])
    return star.phrase_flag.select(
        "PhraseSentimentFlagID", F.try_element_at(keys, phrase_key(F.col("Phrase"))).alias("Number")
    ).where("Number IS NOT NULL")


def candidates_phrases(
    star: ReviewStar, book: PhraseBook, min_date: int | None = None, operator_names: list[str] | None = None,
    frame: str = "running", ignore_case: bool = False,
) -> DataFrame:
    """``ReviewID, ReviewText, Wanted``: reviews with the numbers of the phrases their text needs a flag for.

    For each phrase these are the rows of ``candidates_phrase``.  A text needs a phrase unless every review with that
    text (of the named operators) has a flag for it, so copies and flagged copies are counted, each once for all
    phrases.  Texts themselves are read once, when the wanted ones are known.
    """
    if frame not in ("running", "full"):
        raise ValueError("frame is 'running' or 'full'")
    dated = F.lit(True) if min_date is None else F.col("Review_DateID") >= min_date
    keyed = star.review.where(F.col("ReviewText").isNotNull()).select(
        "ReviewID", "VenueID", dated.alias("Dated"), text_key(F.col("ReviewText"), ignore_case).alias("TextKey")
    )
    if operator_names:
        venues = named_venues(star, operator_names).withColumn("_named", F.lit(True))
        keyed = keyed.join(venues, "VenueID", "left").withColumn("Named", F.coalesce("_named", F.lit(False))).drop("_named")
    else:
        keyed = keyed.withColumn("Named", F.lit(True))
    keyed = cut_lineage(keyed.drop("VenueID"))
    copies = keyed.groupBy("TextKey").agg(
        F.count_if("Named").alias("Copies"), F.min(F.when(F.col("Dated"), F.col("ReviewID"))).alias("FirstID")
    ).where("Copies > 0 AND FirstID IS NOT NULL")
    flagged = star.phrase_review.join(_numbered(star, book), "PhraseSentimentFlagID").select("ReviewID", "Number").distinct()
    counts = (
        keyed.where("Named").select("ReviewID", "TextKey").join(flagged, "ReviewID")
        .groupBy("TextKey", "Number").agg(F.count("*").alias("Flagged"))
        .groupBy("TextKey").agg(F.collect_list(F.struct("Number", "Flagged")).alias("Flagged"))  # one for a phrase at most
    )
    done = F.transform(F.filter("Flagged", lambda one: one["Flagged"] >= F.col("Copies")), lambda one: one["Number"])
    every = F.sequence(F.lit(0), F.lit(len(book.labels) - 1))
    texts = copies.join(counts, "TextKey", "left").select(
        "TextKey", "FirstID", F.when(F.col("Flagged").isNull(), every).otherwise(F.array_except(every, done)).alias("Wanted")
    ).where(F.size("Wanted") > 0)
    texts, _ = keep_for_broadcast(texts)
    found = (
        star.review.where(F.col("ReviewText").isNotNull()).select("ReviewID", "ReviewText")
        .withColumn("TextKey", text_key(F.col("ReviewText"), ignore_case)).join(texts, "TextKey")
    )
    if frame == "running":
        found = found.where(F.col("ReviewID") >= F.col("FirstID"))
    return found.select("ReviewID", "ReviewText", "Wanted")


def score_phrases(candidates: DataFrame, book: PhraseBook, stops: list[str] | None = None, lexicon=W.LEXICON) -> DataFrame:
    """``ReviewID, Phrase, PhraseFlag, Sentiment`` (rescaled) for every wanted phrase of every candidate.

    A text is cleaned, searched and scored once, whatever the number of phrases; rows multiply last.  A phrase of
    several words is discussed where they follow each other.
    """
    labels = F.array(*map(F.lit, book.labels))
    read = candidates.where(F.col("ReviewText").isNotNull()).select(
        "ReviewID", "Wanted", word_list(clean_text(F.col("ReviewText"), stops)).alias("_words")
    )
    scored = read.select(
        "ReviewID", "Wanted", book.phrases_in(F.col("_words")).alias("_found"), lexicon_score(F.col("_words"), lexicon).alias("_score")
    )
    rows = scored.select("ReviewID", "_found", "_score", F.explode("Wanted").alias("_number"))
    flag = F.array_contains("_found", F.col("_number"))
    score = F.when(flag, F.col("_score")).otherwise(F.lit(schema.UNCLEAR_SCORE))
    return rows.select(
        "ReviewID", F.get(labels, F.col("_number")).alias("Phrase"), flag.cast("int").alias("PhraseFlag"), rescale_score(score).alias("Sentiment")
    )


def writeback_phrases(star: ReviewStar, scores: DataFrame) -> PhraseTables:
    """Flag and bridge tables with the scores of any number of phrases, spelled as they are stored already.

    ``scores`` are those of reviews of this star.
    """
    stored = star.phrase_flag.groupBy(phrase_key(F.col("Phrase")).alias("_key")).agg(F.min("Phrase").alias("_stored"))
    raw = (
        scores.withColumn("_key", phrase_key(F.col("Phrase"))).join(stored, "_key", "left")
        .select("ReviewID", F.coalesce("_stored", "Phrase").alias("Phrase"), "PhraseFlag", raw_phrase_score(F.col("PhraseFlag"), F.col("Sentiment")).alias("Raw"))
    )
    rows = cut_lineage(
        with_sentiment_id(raw, star, "Raw").select("ReviewID", "Phrase", "PhraseFlag", F.col("SentimentID").alias("PhraseSentimentID"))
    )
    return phrase_tables(star, rows)
