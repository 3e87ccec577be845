"""Dashboard queries.

Each one first counts reviews for every venue, which happens on the map side, and
joins the dimensions to those counts: neither the fact rows nor a busy venue ever
travel through a join.  A star with a rollup has the counts already (``plans/rollup``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom import schema
from reviewloom.functions.dates import preset_start
from reviewloom.functions.formats import format_stats
from reviewloom.functions.scores import exact_ratio
from reviewloom.functions.text import phrase_key, phrase_label_key
from reviewloom.operators.relational import sentiments, venue_operator
from reviewloom.plans.rollup import phrase_cells, review_cells
from reviewloom.session import checked_broadcast
from reviewloom.sources.star import ReviewStar

WIDE_SCORE = "decimal(20,6)"


def _picked_reviews(
    star: ReviewStar,
    phrases: list[str] | None = None,
    date_range: tuple[int, int] | None = None,
    operator_ids: list[int] | None = None,
) -> DataFrame:
    """Reviews narrowed by the optional operators, date range and discussed phrases.

    With operators picked, their venues come first: reviews of others take part in no
    join and no count.
    """
    reviews = star.review
    if operator_ids is not None:
        reviews = reviews.join(venue_operator(star, operator_ids).select("VenueID"), "VenueID", "left_semi")
    if date_range is not None:
        reviews = reviews.where(F.col("Review_DateID").between(*date_range))
    if phrases is not None:
        wanted = [phrase_label_key([phrase]) for phrase in phrases]
        flags = star.phrase_flag.where((F.col("PhraseFlag") == 1) & phrase_key(F.col("Phrase")).isin(wanted))
        discussed = star.phrase_review.join(flags, "PhraseSentimentFlagID", "left_semi")
        reviews = reviews.join(discussed, "ReviewID", "left_semi")
    return reviews


def _cells(
    star: ReviewStar,
    phrases: list[str] | None = None,
    date_range: tuple[int, int] | None = None,
    operator_ids: list[int] | None = None,
) -> DataFrame:
    """``VenueID, Review_DateID, ReviewSentimentID, ReviewRating, Written, N`` of the picked reviews.

    They come from the star's counts, if it has any, or else one cell is one review.  Cells that
    were taken back count less than 0; what is grouped and adds up to 0 is no group.  Counts
    don't tell which reviews discuss a phrase, so those are read themselves.
    """
    counts = star.review_counts
    if counts is None or phrases is not None:
        return review_cells(_picked_reviews(star, phrases, date_range, operator_ids))
    return _picked_cells(star, counts, date_range, operator_ids)


def _picked_cells(star: ReviewStar, counts: DataFrame, date_range, operator_ids) -> DataFrame:
    if operator_ids is not None:
        counts = counts.join(venue_operator(star, operator_ids).select("VenueID"), "VenueID", "left_semi")
    return counts if date_range is None else counts.where(F.col("Review_DateID").between(*date_range))


def _scored_counts(star, operator_ids, phrases, date_range, keys: list[str]) -> DataFrame:
    """Counts and rating totals of scored reviews by operator and ``keys``."""
    rated = F.col("ReviewRating").isNotNull()
    by_venue = _cells(star, phrases, date_range, operator_ids).groupBy("VenueID", "ReviewSentimentID").agg(
        F.sum("N").alias("Reviews"),
        F.sum(F.col("ReviewRating") * F.col("N")).alias("RatingTotal"),
        F.sum(F.when(rated, F.col("N")).otherwise(0)).alias("Ratings"),
    )
    scores = sentiments(star).where(F.col("SentimentScore").isNotNull()).select(
        F.col("SentimentID").alias("ReviewSentimentID"), "SentimentScore"
    )
    return (
        by_venue.where("Reviews <> 0").join(scores, "ReviewSentimentID")
        .join(venue_operator(star, operator_ids), "VenueID")
        .groupBy(*keys)
        .agg(
            F.sum("Reviews").alias("Reviews"),
            F.sum("RatingTotal").alias("RatingTotal"),
            F.sum("Ratings").alias("Ratings"),
            F.sum(F.col("SentimentScore") * F.col("Reviews")).alias("ScoreTotal"),
        )
    )


def list_operators(star: ReviewStar) -> DataFrame:
    """Operators with at least one review, by name."""
    reviewed = _cells(star).groupBy("VenueID").agg(F.sum("N").alias("N")).where("N <> 0")
    return (
        venue_operator(star)
        .join(reviewed, "VenueID", "left_semi")
        .select("OperatorID", "OperatorName")
        .distinct()
        .orderBy("OperatorName")
    )


def list_phrases(star: ReviewStar) -> DataFrame:
    return star.phrase_flag.select("Phrase").distinct().orderBy("Phrase")


def phrase_scores(
    star: ReviewStar, operator_ids: list[int] | None = None, phrases: list[str] | None = None,
    date_range: tuple[int, int] | None = None,
) -> DataFrame:
    """Average score of each discussed phrase for each operator."""
    wanted = F.lit(True)
    if phrases is not None:
        wanted = phrase_key(F.col("Phrase")).isin([phrase_label_key([phrase]) for phrase in phrases])
    flags = (
        star.phrase_flag.where((F.col("PhraseFlag") == 1) & wanted)
        .join(
            sentiments(star).where(F.col("SentimentScore").isNotNull()),
            F.col("PhraseSentimentID") == F.col("SentimentID"),
        )
        .select("PhraseSentimentFlagID", "Phrase", "SentimentScore")
    )
    if star.phrase_counts is None:
        cells = phrase_cells(star.phrase_review, _picked_reviews(star, None, date_range, operator_ids))
    else:
        cells = _picked_cells(star, star.phrase_counts, date_range, operator_ids)
    by_venue = (
        cells.join(flags, "PhraseSentimentFlagID")
        .groupBy("VenueID", "Phrase")
        .agg(F.sum(F.col("SentimentScore") * F.col("N")).alias("Total"), F.sum("N").alias("Flags"))
        .where("Flags <> 0")
    )
    return (
        by_venue.join(venue_operator(star, operator_ids), "VenueID")
        .groupBy("OperatorID", "Phrase")
        .agg((F.sum("Total") / F.sum("Flags")).cast(WIDE_SCORE).alias("AvgSentimentScore"))
    )


def rank_phrases(
    star: ReviewStar, operator_ids: list[int] | None = None, phrases: list[str] | None = None,
    date_range: tuple[int, int] | None = None,
) -> DataFrame:
    """Phrases of each operator ranked from both ends, ties by phrase."""
    of_operator = Window.partitionBy("OperatorID")
    return phrase_scores(star, operator_ids, phrases, date_range).select(
        "OperatorID",
        "Phrase",
        "AvgSentimentScore",
        F.row_number().over(of_operator.orderBy(F.desc("AvgSentimentScore"), "Phrase")).alias("PositiveRank"),
        F.row_number().over(of_operator.orderBy("AvgSentimentScore", "Phrase")).alias("NegativeRank"),
    )


def _at_rank(rank: str, column: str) -> Column:
    return F.max(F.when(F.col(rank) == 1, F.col(column)))


def operator_stats(
    star: ReviewStar, operator_ids: list[int] | None = None, phrases: list[str] | None = None,
    date_range: tuple[int, int] | None = None,
) -> DataFrame:
    """Review counts, scores and best and worst phrase, one row for each operator.

    Operators without reviews have a ratio of 0, a count of 0 and nulls.  ``phrases`` narrows
    the reviews to those that discuss one of them, and the ranks to these.
    """
    by_venue = (
        _cells(star, phrases, date_range, operator_ids)
        .where("Written")
        .groupBy("VenueID", "ReviewSentimentID")
        .agg(F.sum("N").alias("Reviews"))
        .where("Reviews <> 0")
    )
    states = sentiments(star).select(
        F.col("SentimentID").alias("ReviewSentimentID"),
        (F.col("SentimentText") != schema.UNPROCESSED).alias("Processed"),
        "SentimentScore",
    )
    reviews = F.col("Reviews")
    scored = F.col("Processed") & F.col("SentimentScore").isNotNull()
    counts = (
        by_venue.join(states, "ReviewSentimentID", "left")
        .join(venue_operator(star, operator_ids), "VenueID")
        .groupBy("OperatorID")
        .agg(
            F.sum("Reviews").alias("All"),
            F.sum(F.when(F.col("Processed"), reviews).otherwise(0)).alias("Processed"),
            F.sum(F.when(F.col("SentimentScore") > 0, reviews).otherwise(0)).alias("Positive"),
            F.sum(F.when(scored, reviews).otherwise(0)).alias("Scored"),
            F.sum(F.when(scored, F.col("SentimentScore") * reviews)).alias("ScoreTotal"),
        )
    )
    ends = rank_phrases(star, operator_ids, phrases, date_range).groupBy("OperatorID").agg(
        _at_rank("PositiveRank", "Phrase").alias("MostPositivePhraseName"),
        _at_rank("PositiveRank", "AvgSentimentScore").alias("MostPositivePhraseSentiment"),
        _at_rank("NegativeRank", "Phrase").alias("MostNegativePhraseName"),
        _at_rank("NegativeRank", "AvgSentimentScore").alias("MostNegativePhraseSentiment"),
    )
    operators = star.operator
    if operator_ids is not None:
        operators = operators.where(F.col("OperatorID").isin(list(operator_ids)))
    return (
        operators.join(counts, "OperatorID", "left")
        .join(ends, "OperatorID", "left")
        .select(
            "OperatorName",
            F.coalesce(exact_ratio(F.col("Processed") * 100, F.col("All"), 1), F.lit(0).cast("decimal(32,1)"))
            .alias("ProcessedReviewRatio"),
            exact_ratio(F.col("ScoreTotal"), F.col("Scored"), 2).alias("AvgSentimentScore"),
            exact_ratio(F.col("Positive") * 100, F.col("Processed"), 1)
            .cast("decimal(5,1)")
            .alias("PositiveReviewPercentage"),
            F.coalesce("All", F.lit(0)).alias("CountReviews"),
            "MostPositivePhraseName",
            "MostPositivePhraseSentiment",
            "MostNegativePhraseName",
            "MostNegativePhraseSentiment",
        )
        .orderBy("OperatorName")
    )


def operator_stats_display(star: ReviewStar, operator_ids: list[int] | None = None) -> DataFrame:
    """The same as display text."""
    return format_stats(operator_stats(star, operator_ids))


def rating_vs_sentiment(
    star: ReviewStar, operator_ids=None, phrases=None, date_range=None, top: int = schema.TOP_OPERATORS
) -> DataFrame:
    """The operators with the best average rating."""
    return (
        _scored_counts(star, operator_ids, phrases, date_range, ["OperatorName"])
        .select(
            "OperatorName",
            exact_ratio(F.col("RatingTotal"), F.col("Ratings"), 2).alias("AvgReviewRating"),
            exact_ratio(F.col("ScoreTotal"), F.col("Reviews"), 2).alias("AvgSentimentScore"),
        )
        .orderBy(F.desc_nulls_last("AvgReviewRating"), "OperatorName")
        .limit(top)
    )


def sentiment_distribution(star: ReviewStar, operator_ids=None, phrases=None, date_range=None) -> DataFrame:
    return _scored_counts(star, operator_ids, phrases, date_range, ["SentimentScore"]).select(
        "SentimentScore", F.col("Reviews").alias("CountSentimentScore")
    )


def sentiment_share(star: ReviewStar, operator_ids=None, phrases=None, date_range=None) -> DataFrame:
    """Share of each score in percent, one decimal; one row a score, eleven at most."""
    slices = sentiment_distribution(star, operator_ids, phrases, date_range)
    total = F.sum("CountSentimentScore").over(Window.partitionBy())
    return slices.withColumn("Share", exact_ratio(F.col("CountSentimentScore") * 100, total, 1))


def rating_by_sentiment(star: ReviewStar, operator_ids=None, phrases=None, date_range=None) -> DataFrame:
    return _scored_counts(star, operator_ids, phrases, date_range, ["SentimentScore"]).select(
        "SentimentScore",
        exact_ratio(F.col("RatingTotal"), F.col("Ratings"), 6).alias("AvgReviewRating"),
    )


def rating_mix_by_year(star: ReviewStar, operator_ids=None, phrases=None, date_range=None) -> DataFrame:
    """Share of each rating in its year.

    The date dimension has a row for a day, 36,525 in a century, so it is broadcast (over
    three centuries raise) and reviews are counted by venue, year and rating before any shuffle.  Years are
    added up from the counts, so the window sees a handful of rows.
    """
    dates = star.dates.select(F.col("DateID").alias("Review_DateID"), F.year("ActualDate").alias("ReviewYear"))
    counts = (
        _cells(star, phrases, date_range, operator_ids)
        .where(F.col("ReviewRating").isNotNull())
        .join(checked_broadcast(dates, 110_000), "Review_DateID")
        .groupBy("VenueID", "ReviewYear", "ReviewRating")
        .agg(F.sum("N").alias("Reviews"))
        .where("Reviews <> 0")
        .join(venue_operator(star, operator_ids), "VenueID")
        .groupBy("ReviewYear", "ReviewRating")
        .agg(F.sum("Reviews").alias("Reviews"))
    )
    total = F.sum("Reviews").over(Window.partitionBy("ReviewYear"))
    return counts.select(
        "ReviewYear",
        "ReviewRating",
        exact_ratio(F.col("Reviews"), total, 6).alias("RatingProportion"),
    ).orderBy("ReviewYear", "ReviewRating")


def rating_mix_pivot(star: ReviewStar, operator_ids=None, ratings=(3, 4, 5)) -> DataFrame:
    """One row a year, one column a rating, whole percents, 0 where there is none."""
    mix = rating_mix_by_year(star, operator_ids)
    wide = mix.groupBy("ReviewYear").pivot("ReviewRating", list(ratings)).agg(F.max("RatingProportion"))
    return wide.select(
        "ReviewYear",
        *[
            F.coalesce(F.round(F.col(str(rating)) * 100).cast("int"), F.lit(0)).alias(f"Rating{rating}")
            for rating in ratings
        ],
    ).orderBy("ReviewYear")


def preset_range(star: ReviewStar, months: int) -> DataFrame:
    """Date span of each operator's reviews, and the start of its last ``months`` months."""
    cells = _cells(star)
    if star.review_counts is not None:  # days whose reviews were all taken back don't count
        cells = cells.groupBy("VenueID", "Review_DateID").agg(F.sum("N").alias("N")).where("N <> 0")
    by_venue = cells.groupBy("VenueID").agg(F.min("Review_DateID").alias("first"), F.max("Review_DateID").alias("last"))
    spans = (
        by_venue.join(venue_operator(star), "VenueID")
        .groupBy("OperatorID")
        .agg(
            F.to_date(F.min("first").cast("string"), "yyyyMMdd").alias("MinDate"),
            F.to_date(F.max("last").cast("string"), "yyyyMMdd").alias("MaxDate"),
        )
    )
    return spans.select(
        "OperatorID",
        preset_start(F.col("MinDate"), F.col("MaxDate"), months).alias("StartDate"),
        F.col("MaxDate").alias("EndDate"),
    )
