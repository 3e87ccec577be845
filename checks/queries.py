"""One entry for each query: ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import params as P
from reviewloom import schema, session
from reviewloom.functions import dates, formats, scores, text
from reviewloom.functions.phrasebook import PhraseBook
from reviewloom.operators import batches as B
from reviewloom.operators import duplicates, relational, upserts
from reviewloom.plans import candidates, dashboard, learned, phrases, rollup, scoring, summaries, writeback
from reviewloom.sources import tables
from reviewloom.sources.journal import reply_journal
from reviewloom.sources.star import ReviewStar, star_from_orders
from reviewloom.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, so that two engines' values compare."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double").alias(field.name)
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string").alias(field.name)
        columns.append(column)
    return df.select(*columns)


def on_star(build: Callable[[ReviewStar], DataFrame]):
    """Register a query over the star, under the function's name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        session.tune(spark)
        return _plain(build(star_from_orders(spark, folder)))

    QUERIES[build.__name__] = run
    return build


def on_tables(build: Callable[[Callable[[str], DataFrame]], DataFrame]):
    """Register a query over the given tables themselves."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        session.tune(spark)
        return _plain(build(lambda name: spark.read.parquet(f"{folder}/{name}.parquet")))

    QUERIES[build.__name__] = run
    return build


# ---- dashboard ------------------------------------------------------------

@on_star
def operator_stats(star):
    return dashboard.operator_stats(star)


@on_star
def operator_stats_selected(star):
    return dashboard.operator_stats(star, P.OPERATOR_IDS)


@on_star
def operator_stats_filtered(star):
    return dashboard.operator_stats(star, P.OPERATOR_IDS, ["atmosphere", "Food"], (P.START, P.END))


@on_star
def format_stats(star):
    return dashboard.operator_stats_display(star)


@on_star
def list_operators(star):
    return dashboard.list_operators(star)


@on_star
def list_phrases(star):
    return dashboard.list_phrases(star)


@on_star
def rank_phrases(star):
    return dashboard.rank_phrases(star)


@on_star
def rating_vs_sentiment(star):
    return dashboard.rating_vs_sentiment(star)


@on_star
def sentiment_distribution(star):
    return dashboard.sentiment_distribution(star)


@on_star
def sentiment_distribution_filtered(star):
    return dashboard.sentiment_distribution(
        star, P.OPERATOR_IDS, phrases=P.PHRASES, date_range=(P.START, P.END)
    )


@on_star
def sentiment_share(star):
    return dashboard.sentiment_share(star)


@on_star
def sentiment_share_text(star):
    shares = dashboard.sentiment_share(star)
    return shares.select("SentimentScore", formats.percent_text(F.col("Share"), 1).alias("Share"))


@on_star
def rating_by_sentiment(star):
    return dashboard.rating_by_sentiment(star)


@on_star
def rating_mix_by_year(star):
    return dashboard.rating_mix_by_year(star)


@on_star
def rating_mix_pivot(star):
    return dashboard.rating_mix_pivot(star)


@on_star
def preset_range(star):
    return dashboard.preset_range(star, 3)


@on_star
def select_members(star):
    return relational.select_members(dashboard.list_operators(star), "OperatorName", P.OPERATORS)


@on_star
def search_dimension(star):
    return relational.search_dimension(dashboard.list_operators(star), "OperatorName", "Tor 1")


# ---- joins and sets -------------------------------------------------------

@on_star
def review_operator(star):
    return relational.review_operator(star).select("ReviewID", "VenueID", "OperatorID", "OperatorName")


@on_star
def venue_region(star):
    return relational.venue_region(star)


@on_star
def operator_left_reviews(star):
    return relational.operator_left_reviews(star)


@on_star
def anti_leftnull(star):
    done = star.summary_venue.where(F.col("DateRangeID") == 1)
    return relational.without(star.venue, done, ["VenueID"]).select("VenueID", "BrandID")


@on_star
def anti_not_exists(star):
    rows = star.phrase_review.select("ReviewID", F.lit(0).alias("PhraseSentimentFlagID"))
    return relational.without(rows, star.phrase_review, ["ReviewID", "PhraseSentimentFlagID"])


@on_star
def anti_not_in(star):
    return relational.not_in(
        star.review.select("ReviewID", "VenueID"), "ReviewID", star.phrase_review, "ReviewID"
    )


@on_star
def semi_text(star):
    open_reviews = star.review.where((F.col("ReviewSentimentID") == 1) & F.col("ReviewText").isNotNull())
    return relational.having_text(star.review, open_reviews, "ReviewText").select("ReviewID", "ReviewText")


@on_star
def nth_group(star):
    return relational.nth_group(summaries.region_inputs(star), ["OperatorID", "RegionID"], 2)


@on_star
def nth_group_far(star):
    """A group far from the first one; some keys have nulls."""
    return relational.nth_group(star.review, ["ReviewRating", "VenueID"], 150).select("ReviewID", "VenueID", "ReviewRating")


# ---- text and duplicates --------------------------------------------------

@on_star
def clean_text(star):
    return star.review.select("ReviewID", text.clean_text(F.col("ReviewText")).alias("CleanText"))


@on_tables
def clean_documents(table):
    return table("documents").select("doc_id", text.clean_text(F.col("text")).alias("CleanText"))


@on_star
def alpha_only(star):
    return star.review.select("ReviewID", text.alpha_only(F.col("ReviewText")).alias("Letters"))


@on_tables
def alpha_only_documents(table):
    return table("documents").select("doc_id", text.alpha_only(F.col("text")).alias("Letters"))


@on_tables
def summary_length(table):
    return table("documents").select(
        "doc_id",
        text.word_count(F.col("text")).alias("Words"),
        summaries.summary_is_short(F.col("text")).alias("Accepted"),
    )


@on_star
def collapse_duplicates(star):
    cleaned = scoring.clean_reviews(star.review)
    return duplicates.collapse_duplicates(cleaned, "CleanText")


@on_tables
def collapse_documents(table):
    return duplicates.collapse_duplicates(table("documents"), "text", "doc_id")


@on_star
def duplicate_id_lists(star):
    cleaned = scoring.clean_reviews(star.review)
    lists = duplicates.duplicate_id_lists(cleaned, "CleanText", width=P.LIST_WIDTH)
    return lists.withColumn("MatchedTextIDs", F.array_join("MatchedTextIDs", ","))


@on_star
def running_max_date(star):
    written = star.review.where(F.col("ReviewText").isNotNull()).select("ReviewID", "ReviewText", "Review_DateID")
    rows = duplicates.running_max(written, text.text_key(F.col("ReviewText")), "Review_DateID")
    return rows.select("ReviewID", "RunningMax")


# Ids spread over 2^40 numbers, as hashes are.
SPARSE = "(ReviewID * 2654435761) % 1099511627776"


@on_star
def running_max_sparse(star):
    written = star.review.where(F.col("ReviewText").isNotNull()).select(
        F.expr(SPARSE).alias("ReviewID"), "ReviewText", "Review_DateID"
    )
    rows = duplicates.running_max(written, text.text_key(F.col("ReviewText")), "Review_DateID")
    return rows.select("ReviewID", "RunningMax")


@on_star
def running_max_nulls(star):
    """Reviews without a text are one group."""
    rows = star.review.select("ReviewID", "ReviewText", "Review_DateID")
    return duplicates.running_max(rows, F.col("ReviewText"), "Review_DateID").select("ReviewID", "RunningMax")


@on_star
def propagate_labels(star):
    return duplicates.propagate_labels(
        star.review, star.phrase_review, "ReviewID", "ReviewText", ["PhraseSentimentFlagID"]
    )


@on_tables
def propagate_document_labels(table):
    return duplicates.propagate_labels(
        table("documents"), table("labels"), "doc_id", "text", ["quality", "toxic"]
    )


# ---- candidates -----------------------------------------------------------

@on_star
def candidates_overall(star):
    return candidates.candidates_overall(star, P.MIN_DATE)


@on_star
def candidates_overall_full(star):
    return candidates.candidates_overall(star, P.MIN_DATE, frame="full")


@on_star
def candidates_overall_operators(star):
    return candidates.candidates_overall(star, P.MIN_DATE, P.OPERATORS)


@on_star
def candidates_overall_undated(star):
    return candidates.candidates_overall(star)


@on_star
def candidates_phrase(star):
    return candidates.candidates_phrase(star, P.PHRASES, P.MIN_DATE)


@on_star
def candidates_phrase_operators(star):
    return candidates.candidates_phrase(star, P.PHRASES, P.MIN_DATE, P.OPERATORS)


# ---- scoring --------------------------------------------------------------

def _documents(table) -> DataFrame:
    return table("documents").select(F.col("doc_id").alias("ReviewID"), F.col("text").alias("ReviewText"))


@on_star
def score_overall(star):
    cleaned = scoring.clean_reviews(star.review)
    return scoring.score_overall(cleaned).select("ReviewID", "Sentiment")


@on_tables
def score_documents(table):
    return scoring.score_overall(scoring.clean_reviews(_documents(table))).select("ReviewID", "Sentiment")


@on_star
def score_phrase(star):
    cleaned = scoring.clean_reviews(star.review)
    return scoring.score_phrase(cleaned, P.PHRASES).select("ReviewID", "PhraseFlag", "Sentiment")


@on_star
def score_phrase_lower(star):
    cleaned = scoring.clean_reviews(star.review)
    return scoring.score_phrase(cleaned, ["drink"]).select("ReviewID", "PhraseFlag", "Sentiment")


@on_star
def score_two_phrases(star):
    cleaned = scoring.clean_reviews(star.review)
    return scoring.score_phrase(cleaned, ["Food", "Drink"]).select("ReviewID", "PhraseFlag", "Sentiment")


@on_star
def rescale_score(star):
    cleaned = scoring.clean_reviews(star.review)
    rescaled = scores.rescale_score(F.col("Sentiment"))
    return scoring.score_overall(cleaned).select(
        "ReviewID", rescaled.alias("Sentiment"), scores.raw_score(rescaled).alias("RawScore")
    )


def _unique_texts(star) -> DataFrame:
    cleaned = scoring.clean_reviews(star.review)
    unique = duplicates.collapse_duplicates(cleaned, "CleanText")
    return unique.select("ReviewID", F.col("CleanText").alias("ReviewText"))


@on_star
def assign_batches(star):
    ids = star.review.select("ReviewID")
    batched = B.assign_batches(ids, queues=B.queue_count(ids))
    return batched.select("ReviewID", "Queue", "Batch")


@on_star
def batch_json(star):
    unique = _unique_texts(star)
    batched = B.assign_batches(unique, size=5, queues=B.queue_count(unique))
    return B.batch_json(batched, ["ReviewID", "ReviewText"]).select("Queue", "Batch", "ItemsJson")


@on_star
def group_json(star):
    texts = star.review.where(F.col("ReviewText").isNotNull()).groupBy("VenueID", "ReviewText").agg(
        F.min("ReviewID").alias("ReviewID")
    )
    letters = texts.select("VenueID", "ReviewID", text.alpha_only(F.col("ReviewText")).alias("Letters"))
    return B.group_json(letters, ["VenueID"], "Letters", "ReviewID", size=3, width=P.LIST_WIDTH)


def _replies(star) -> DataFrame:
    """Replies that a scorer might have sent for batches of reviews: JSON under one
    root key, scores stored for the reviews."""
    rows = star.review.join(
        relational.sentiments(star).select(F.col("SentimentID").alias("ReviewSentimentID"), "SentimentScore"),
        "ReviewSentimentID",
    ).select("ReviewID", F.coalesce(F.col("SentimentScore") * 5 + 5, F.lit(-1)).cast("int").alias("Sentiment"))
    batched = B.batch_json(B.assign_batches(rows, queues=B.queue_count(rows)), ["ReviewID", "Sentiment"])
    return batched.select(
        "Queue", "Batch", F.concat(F.lit('{"review_sentiment":'), "ItemsJson", F.lit("}")).alias("Reply")
    )


@on_star
def parse_scores(star):
    return B.parse_scores(_replies(star), "Reply", schema.OVERALL_ITEM)


def _answers(star) -> tuple[DataFrame, DataFrame]:
    """Sent batches, and answers that lack old reviews, score the unrated ones out of
    range and bring in ids nobody sent."""
    sent = B.assign_batches(star.review, queues=B.queue_count(star.review))
    answered = sent.where(F.col("Review_DateID") >= 19950301).select(
        "Queue", "Batch", "ReviewID",
        F.when(F.col("ReviewRating").isNull(), 11).otherwise(F.col("ReviewRating") * 2).alias("Sentiment"),
    )
    strays = sent.where("Review_DateID >= 20010701").select(
        "Queue", "Batch", (-F.col("ReviewID") - 1).alias("ReviewID"), F.lit(5).alias("Sentiment")
    )
    return sent, answered.unionByName(strays)


@on_star
def validate_scores(star):
    return B.validate_scores(*_answers(star))


def _faulty(reply):
    """A scorer that goes wrong on some words: it drops a record, makes up a score,
    or says nothing."""
    import json

    def answer(batch: str) -> str:
        items = json.loads(reply(batch))["review_sentiment"]
        if "portion" in batch:
            items = items[1:]
        elif "price" in batch:
            items[0]["Sentiment"] = 11
        elif "drinks" in batch:
            return ""
        return json.dumps({"review_sentiment": items})

    return answer


def _faulty_run(star, passes: int) -> scoring.ScoreRun:
    return scoring.run_scorer(star.review, _faulty(scoring.lexicon_scorer()), size=2, passes=passes)


@on_star
def quarantine(star):
    return _faulty_run(star, 1).rejects.select(
        "Queue", "Batch", F.array_join("ReviewIDs", ",").alias("ReviewIDs"), "Reply", "Error",
        F.array_join("InvalidScores", ",").alias("InvalidScores"), "SameIds", "Reason",
    )


@on_star
def run_metrics(star):
    return _faulty_run(star, 1).metrics


@on_star
def rescued_scores(star):
    """Texts of refused batches are asked for again: only those that go wrong alone stay out."""
    return _faulty_run(star, 3).scores


@on_star
def rescued_metrics(star):
    return _faulty_run(star, 3).metrics


@on_star
def score_reviews(star):
    return scoring.score_reviews(candidates.candidates_overall(star, P.MIN_DATE))


@on_star
def score_reviews_phrase(star):
    found = candidates.candidates_phrase(star, P.PHRASES, P.MIN_DATE)
    return scoring.score_reviews(found, P.PHRASES)


@on_star
def score_learned(star):
    """Scores of all reviews by a model that learned from those with a score; held-out texts are marked."""
    scorer = learned.fit(star)
    held = learned.is_held_out(text.text_key(F.col("ReviewText")))
    marks = star.review.where(F.col("ReviewText").isNotNull()).select("ReviewID", held.alias("HeldOut"), "ReviewText")
    return scorer.scores(marks, "ReviewText").drop("ReviewText")


def _many_scored(star, names: list[str]) -> DataFrame:
    book = PhraseBook(names)
    return phrases.score_phrases(phrases.candidates_phrases(star, book, P.MIN_DATE), book)


@on_star
def score_many_phrases(star):
    """Flags and scores for several phrases from one run; words of a phrase have to follow each other."""
    return _many_scored(star, P.SOME_PHRASES)


@on_star
def phrase_coverage(star):
    """Of 198 phrases, how many reviews were looked at, how many discuss it, and what they say."""
    score = F.when(F.col("Sentiment") >= -1, F.col("Sentiment"))
    return _many_scored(star, P.MANY_PHRASES).groupBy("Phrase").agg(
        F.count("*").alias("Reviews"), F.count_if(F.col("PhraseFlag") == 1).alias("Flagged"), F.sum(score).cast("double").alias("Total"),
    )


@on_star
def writeback_many_phrases(star):
    made = phrases.writeback_phrases(star, _many_scored(star, P.SOME_PHRASES))
    return made.reviews.join(made.flags, "PhraseSentimentFlagID", "left").select("ReviewID", "Phrase", "PhraseFlag", "PhraseSentimentID")


@on_star
def score_reviews_batched(star):
    found = candidates.candidates_overall(star, P.MIN_DATE)
    return scoring.run_scorer(found, scoring.lexicon_scorer()).scores


@on_star
def score_phrase_batched(star):
    found = candidates.candidates_phrase(star, P.PHRASES, P.MIN_DATE)
    scorer = scoring.lexicon_scorer(phrases=P.PHRASES)
    return scoring.run_scorer(found, scorer, P.PHRASES).scores


@on_tables
def score_documents_batched(table):
    return scoring.run_scorer(_documents(table), scoring.lexicon_scorer()).scores


# ---- write-back and upserts -----------------------------------------------

@on_star
def score_dim_or_join(star):
    raw = star.review.join(
        relational.sentiments(star).select(F.col("SentimentID").alias("ReviewSentimentID"), "SentimentRawScore"),
        "ReviewSentimentID",
    ).select("ReviewID", F.col("SentimentRawScore").alias("Raw"))
    return writeback.with_sentiment_id(raw, star, "Raw").select("ReviewID", "SentimentID", "SentimentText")


def _overall_scores(star) -> DataFrame:
    return scoring.score_reviews(candidates.candidates_overall(star, P.MIN_DATE))


def _phrase_scores(star) -> DataFrame:
    return scoring.score_reviews(candidates.candidates_phrase(star, P.PHRASES, P.MIN_DATE), P.PHRASES)


@on_star
def update_scores(star):
    changes = star.phrase_review.groupBy("ReviewID").agg(
        F.max("PhraseSentimentFlagID").alias("ReviewSentimentID")
    )
    return upserts.update_column(star.review, changes, "ReviewID", "ReviewSentimentID").select(
        "ReviewID", "ReviewSentimentID"
    )


@on_star
def writeback_overall(star):
    return writeback.writeback_overall(star, _overall_scores(star)).select("ReviewID", "ReviewSentimentID")


def _unasked(batch: str) -> str:
    raise RuntimeError("this batch has a reply")


@on_star
def score_reviews_journaled(star):
    """A second run, whose scorer must not be asked, has all replies from the first one's journal."""
    found = candidates.candidates_overall(star, P.MIN_DATE)
    journal = reply_journal(star.review.sparkSession, "lexicon")
    scoring.run_scorer(found, scoring.lexicon_scorer(), journal=journal)
    return scoring.run_scorer(found, _unasked, journal=journal).scores


@on_star
def score_reviews_waves(star):
    """Few calls a task, so that batches go out in several waves."""
    found = candidates.candidates_overall(star, P.MIN_DATE)
    return scoring.run_scorer(found, scoring.lexicon_scorer(), size=5, calls=4, task_calls=3).scores


def _arriving(star, slices: int, at_a_time: int) -> DataFrame:
    """The reviews as files that a stream reads, a few at a time, older ones first."""
    inbox = f"{session.checkpoint_dir(star.review.sparkSession)}/inbox-{uuid.uuid4().hex}"
    star.review.repartitionByRange(slices, "Review_DateID").write.parquet(inbox)
    return star.review.sparkSession.readStream.schema(star.review.schema).option("maxFilesPerTrigger", at_a_time).parquet(inbox)


def _streamed_scores(star, score=scoring.score_reviews) -> DataFrame:
    spark = star.review.sparkSession
    store = incremental.ScoreStore(f"{session.checkpoint_dir(spark)}/scores-{uuid.uuid4().hex}", P.MIN_DATE, score)
    incremental.score_stream(_arriving(star, 6, 2), store, relational.sentiments(star)).awaitTermination()
    return store.scores(spark)


@on_star
def score_stream(star):
    """Scores of reviews that arrive in three batches."""
    return _streamed_scores(star)


@on_star
def writeback_stream(star):
    """The review table after scores of three batches were stored."""
    return writeback.writeback_overall(star, _streamed_scores(star)).select("ReviewID", "ReviewSentimentID")


@on_star
def writeback_partitions(star):
    """Scores stored into a table partitioned by month: only months with changed reviews are written."""
    spark, name = star.review.sparkSession, f"review_{uuid.uuid4().hex}"
    by_month = star.review.withColumn("Month", (F.col("Review_DateID") / 100).cast("int"))
    tables.save_partitioned(by_month, name, "Month", "ReviewID", buckets=8)
    tables.update_partitions(spark, name, writeback.scored_ids(star, _overall_scores(star)), "ReviewID", "ReviewSentimentID")
    result = session.cut_lineage(spark.table(name).select("ReviewID", "ReviewSentimentID"))
    tables.drop_table(spark, name)
    return result


def _few_flags(star) -> ReviewStar:
    """The star before most flags were made: only the "not discussed" ones exist."""
    return star.replace(phrase_flag=star.phrase_flag.where(F.col("PhraseFlag") == 0))


@on_star
def upsert_phrase_flags(star):
    early = _few_flags(star)
    rows = writeback.phrase_rows(early, _phrase_scores(star), P.PHRASES)
    return writeback.upsert_phrase_flags(early.phrase_flag, rows)


@on_star
def upsert_flags_two_words(star):
    """From candidates to stored flags, with a phrase in another spelling than the stored one."""
    phrases = [P.TWO_WORDS.lower()]
    found = candidates.candidates_phrase(star, phrases, P.MIN_DATE)
    early = star.replace(phrase_flag=star.phrase_flag.where(F.col("PhraseSentimentID") != 8))
    rows = writeback.phrase_rows(early, scoring.score_reviews(found, phrases), phrases)
    return writeback.upsert_phrase_flags(early.phrase_flag, rows)


@on_star
def upsert_phrase_reviews(star):
    rows = writeback.phrase_rows(star, _phrase_scores(star), P.PHRASES)
    return writeback.upsert_phrase_reviews(star.phrase_review, star.phrase_flag, rows)


@on_star
def writeback_phrase(star):
    tables = writeback.writeback_phrase(_few_flags(star), _phrase_scores(star), P.PHRASES)
    return tables.reviews.join(tables.flags, "PhraseSentimentFlagID", "left").select(
        "ReviewID", "PhraseSentimentFlagID", "Phrase", "PhraseFlag", "PhraseSentimentID"
    )


def _counted(star) -> ReviewStar:
    """The star after scores and then phrase flags were stored, with counts that were built before and
    took in both changes."""
    spark = star.review.sparkSession
    # Several steps read the flags, which all lines are grouped for, and the changed reviews, which are joined for it.
    star = star.replace(phrase_review=session.cut_lineage(star.phrase_review))
    counts = rollup.Rollup(f"{session.checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}").build(star)
    changes = session.cut_lineage(writeback.scored_ids(star, _overall_scores(star)))
    counts.change_sentiments(1, star.review, changes)
    changed = upserts.update_column(star.review, changes, "ReviewID", "ReviewSentimentID")
    stored = star.replace(review=session.cut_lineage(changed))
    made = writeback.writeback_phrase(stored, _phrase_scores(stored), P.PHRASES, from_star=True)
    counts.change_flags(2, star.review, made.added)
    return counts.over(stored.replace(phrase_flag=made.flags, phrase_review=made.reviews))


@on_star
def rollup_operator_stats(star):
    return dashboard.operator_stats(_counted(star))


@on_star
def rollup_rating_vs_sentiment(star):
    return dashboard.rating_vs_sentiment(_counted(star))


@on_star
def rollup_sentiment_distribution(star):
    return dashboard.sentiment_distribution(_counted(star))


@on_star
def rollup_rating_mix_by_year(star):
    return dashboard.rating_mix_by_year(_counted(star))


@on_star
def rollup_rating_by_sentiment(star):
    return dashboard.rating_by_sentiment(_counted(star))


@on_star
def insert_if_absent(star):
    fresh = star.venue.selectExpr(
        "'new' AS VenueSummary", "'-' AS VenuePros", "'-' AS VenueCons", "1 AS DateRangeID", "VenueID",
        "0 AS RegionSummaryID", "0 AS OperatorSummaryID",
    )
    return upserts.insert_if_absent(
        star.summary_venue, fresh, ["VenueID", "DateRangeID"], "VenueSummaryID"
    )


@on_star
def insert_sparse_keys(star):
    """New rows whose keys are spread like hashes."""
    fresh = star.venue.selectExpr(
        "'new' AS VenueSummary", "'-' AS VenuePros", "'-' AS VenueCons", "1 AS DateRangeID",
        "(VenueID * 2654435761) % 1099511627776 AS VenueID", "0 AS RegionSummaryID", "0 AS OperatorSummaryID",
    )
    return upserts.insert_if_absent(
        star.summary_venue, fresh, ["VenueID", "DateRangeID"], "VenueSummaryID"
    )


@on_star
def insert_null_and_string_keys(star):
    """Texts as keys, the missing one among them; half of them are there already."""
    texts = star.review.select("ReviewText").distinct()
    numbers = texts.select(F.lit(7).alias("TextID"), "ReviewText").where("ReviewText LIKE '%was%'")
    return upserts.insert_if_absent(numbers, texts, ["ReviewText"], "TextID")


@on_star
def date_range_upsert(star):
    """A new window for every month that has reviews, each at most once."""
    months = star.dates.select(F.date_format("ActualDate", "MMM-yy").alias("Label")).distinct()
    windows = months.select(
        dates.reporting_window(F.col("Label"), P.MONTHS).alias("w"), F.lit(P.MONTHS).alias("Months")
    ).select("w.StartDateID", "w.EndDateID", "Months")
    return upserts.insert_date_ranges(star.date_range, windows)


@on_star
def delete_by_text(star):
    done = star.review.where((F.col("ReviewSentimentID") == 2) & F.col("ReviewText").isNotNull())
    return upserts.delete_by_text(star.review, done).select("ReviewID", "ReviewText")


# ---- windows and summaries ------------------------------------------------

@on_star
def reporting_window(star):
    months = star.dates.select(F.date_format("ActualDate", "MMM-yy").alias("Label")).distinct()
    return months.select("Label", dates.reporting_window(F.col("Label"), P.MONTHS).alias("w")).select(
        "Label", "w.StartDateID", "w.EndDateID"
    )


@on_star
def remaining_venues(star):
    return summaries.remaining_venues(star, P.START, P.END)


@on_star
def remaining_operators(star):
    return summaries.remaining_operators(star)


@on_star
def remaining_regions(star):
    return summaries.remaining_regions(star)


@on_star
def venue_texts(star):
    return summaries.venue_texts(star.review.where(F.col("ReviewText").isNotNull()))


@on_star
def venue_inputs(star):
    return summaries.venue_inputs(star, P.START, P.END)


@on_star
def operator_inputs(star):
    return summaries.operator_inputs(star)


@on_star
def region_inputs(star):
    return summaries.region_inputs(star)


@on_star
def top_aspects(star):
    texts = summaries.venue_texts(star.review.where(F.col("ReviewText").isNotNull()))
    return summaries.top_aspects(texts, ["VenueID"], "ReviewText")


@on_tables
def top_aspects_by_source(table):
    return summaries.top_aspects(table("documents"), ["source"], "text")


@on_star
def summarise_group(star):
    texts = relational.review_operator(star).where(F.col("ReviewText").isNotNull())
    return summaries.summarise_group(texts.select("OperatorID", "ReviewText"), ["OperatorID"], "ReviewText")


@on_tables
def summarise_documents(table):
    return summaries.summarise_group(table("documents"), ["source"], "text")


@on_star
def summarise_venues(star):
    return summaries.stage_venues(star, P.START, P.END)


@on_star
def summarise_operators(star):
    return summaries.stage_operators(star)


@on_star
def summarise_regions(star):
    return summaries.stage_regions(star)


@on_star
def summarise_all(star):
    return summaries.summarise_all(star, P.NEW_LABEL, P.MONTHS).published.summary_venue


@on_star
def summarise_all_operators(star):
    return summaries.summarise_all(star, P.NEW_LABEL, P.MONTHS).published.summary_operator


@on_star
def summarise_all_regions(star):
    return summaries.summarise_all(star, P.NEW_LABEL, P.MONTHS).published.summary_region


@on_star
def publish_summaries(star):
    """Publish onto tables that were empty before."""
    empty = star.replace(
        summary_venue=star.summary_venue.where(F.lit(False)),
        summary_region=star.summary_region.where(F.lit(False)),
        summary_operator=star.summary_operator.where(F.lit(False)),
    )
    return summaries.publish_summaries(empty, star).summary_venue


# ---- summaries by a function, and storing ----------------------------------

def _by_count(texts: list[str], category: str) -> tuple[str, str, str]:
    if len(texts) % 3 == 0:
        raise ValueError("no answer")
    return ("word " * 51).strip() if len(texts) % 3 == 1 else f"{len(texts)} texts", "-", "-"


def _counted_level(star) -> summaries.Level:
    def summarise(texts, keys, text, category):
        return summaries.summarise_with(texts, keys, text, category, _by_count)

    return summaries.venue_level(star, P.START, P.END, summarise)


@on_star
def summary_rejects(star):
    return _counted_level(star).rejects


@on_star
def summary_metrics(star):
    return _counted_level(star).metrics


@on_star
def summarise_with_parts(star):
    """A summariser that counts: putting parts together gives the count of the whole."""
    texts = relational.review_operator(star).where(F.col("ReviewText").isNotNull()).select("OperatorID", "ReviewText")

    def count(found: list[str], category: str) -> tuple[str, str, str]:
        return f"{len(found)} texts", "-", "-"

    def add(parts: list[summaries.Part], category: str) -> tuple[str, str, str]:
        return f"{sum(int(summary.split()[0]) for summary, _, _, _ in parts)} texts", "-", "-"

    return summaries.summarise_with(texts, ["OperatorID"], "ReviewText", "Operator", count, chunk=20, combine=add)


@on_tables
def summarise_long_texts(table):
    """Documents without a full stop: their one sentence is cut into runs."""
    texts = table("documents").select("source", F.regexp_replace("text", text.SENTENCE_END, " ").alias("text"))
    return summaries.summarise_group(texts, ["source"], "text")


@on_tables
def row_json(table):
    return tables.row_json(table("documents"))


@on_star
def stop_words_csv(star):
    """Cleaning with an allow list from a CSV file, which is written first."""
    spark = star.review.sparkSession
    path = f"{session.checkpoint_dir(spark)}/allowed-{uuid.uuid4().hex}"
    spark.createDataFrame([(word,) for word in P.ALLOWED], "AllowedWords string").coalesce(1).write.csv(path, header=True)
    stops = tables.stop_words_from_csv(spark, path)
    return star.review.select("ReviewID", text.clean_text(F.col("ReviewText"), stops).alias("CleanText"))


@on_star
def save_and_snapshot(star):
    """A review table replaced by what is read from it, beside the copy made before."""
    spark, name = star.review.sparkSession, f"review_{uuid.uuid4().hex}"
    tables.save_table(star.review.select("ReviewID", "ReviewSentimentID"), name)
    before = tables.snapshot_table(spark, name, f"{name}_before")
    old = spark.table(name)
    tables.replace_table(
        old.withColumn("ReviewSentimentID", F.when(F.col("ReviewSentimentID") == 1, 2).otherwise(F.col("ReviewSentimentID"))), name
    )
    after = spark.table(name).select("ReviewID", F.col("ReviewSentimentID").alias("After"))
    result = session.cut_lineage(
        before.select("ReviewID", F.col("ReviewSentimentID").alias("Before")).join(after, "ReviewID")
    )
    for made in (name, f"{name}_before"):
        tables.drop_table(spark, made)
    return result
