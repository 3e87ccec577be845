"""A scorer that learns from the reviews that have a score, in place of the word list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom import schema
from reviewloom.functions.scores import rescale_score
from reviewloom.functions.text import clean_text, lexicon_score, text_key, word_list
from reviewloom.operators.relational import sentiments
from reviewloom.session import cut_lineage
from reviewloom.sources.star import ReviewStar

# Distinct texts that the model is fitted on, at most about; words and pairs of words that it knows.
SAMPLE_TEXTS = 200_000
VOCABULARY = 50_000
# Of a hundred texts, so many are held out.
HELD_OUT = 20
PENALTY, ELASTIC = 0.01, 0.5


def terms(text: Column) -> Column:
    """Words of a cleaned text and pairs of neighbours, so that ``wasnt great`` is a term of its own."""
    words = F.filter(word_list(clean_text(text)), lambda word: word != "")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, F.filter(pairs, lambda pair: pair.isNotNull()))


def is_held_out(key: Column) -> Column:
    """Whether a text is held out, by a hash of its digest: all copies of a text are on one side."""
    return F.pmod(F.xxhash64(F.lit("held out"), key), F.lit(100)) < HELD_OUT


def scored_texts(star: ReviewStar) -> DataFrame:
    """``TextKey, ReviewText, Reviews, Score`` (0 to 10, the average of its reviews) of every text with a score."""
    scores = sentiments(star).where(F.col("SentimentScore").isNotNull()).select(
        F.col("SentimentID").alias("ReviewSentimentID"), (F.col("SentimentScore") * 5 + 5).cast("double").alias("Score")
    )
    rows = star.review.where(F.col("ReviewText").isNotNull()).join(scores, "ReviewSentimentID")
    return rows.groupBy(text_key(F.col("ReviewText")).alias("TextKey")).agg(
        F.any_value("ReviewText").alias("ReviewText"), F.count("*").alias("Reviews"), F.avg("Score").alias("Score")
    )


@dataclass(frozen=True)
class LearnedScorer:
    """Scores texts by a weighted sum over their known words and pairs; -1 if they have none, or are null."""

    model: PipelineModel

    def scores(self, rows: DataFrame, text: str) -> DataFrame:
        """``rows`` with Sentiment, 0 to 10 or -1."""
        intercept = self.model.stages[-1].intercept
        found = self.model.transform(rows.withColumn("_terms", F.coalesce(terms(F.col(text)), F.array().cast("array<string>"))))
        # Without a known term nothing is added to the intercept.
        known = F.abs(F.col("_score") - intercept) > 1e-12
        score = F.least(F.lit(10), F.greatest(F.lit(0), F.round("_score").cast("int")))
        return found.withColumn("Sentiment", F.when(known, score).otherwise(schema.UNCLEAR_SCORE)).drop("_terms", "_vector", "_score")

    def __call__(self, candidates: DataFrame) -> DataFrame:
        """Rescaled scores of all candidates, as ``scoring.score_reviews`` gives them."""
        written = candidates.where(F.col("ReviewText").isNotNull())
        return self.scores(written, "ReviewText").select("ReviewID", rescale_score(F.col("Sentiment")).alias("Sentiment"))


def fit(star: ReviewStar, sample: int = SAMPLE_TEXTS, vocabulary: int = VOCABULARY) -> LearnedScorer:
    """Learn from texts that have a score and aren't held out, each once, weighted by its reviews.

    Of more than ``sample`` such texts a share of about that size is drawn by a hash, so the fit's memory is bounded:
    its rows hold words and counts, and a step of the fit sends one number a known term.  A term has to be in two
    texts to be known.  Without any scored text every score is -1.
    """
    texts = scored_texts(star).where(~is_held_out(F.col("TextKey")))
    found = cut_lineage(texts.select("TextKey", "Reviews", "Score", terms(F.col("ReviewText")).alias("_terms")))
    share = min(1.0, sample / max(found.count(), 1))
    drawn = F.pmod(F.xxhash64(F.lit("drawn"), "TextKey"), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = found.where(drawn)
    if rows.isEmpty():
        # One made-up line whose only term no text has: every score is unclear.
        rows = star.review.sparkSession.sql("SELECT 1L AS Reviews, 5.0D AS Score, array('') AS _terms")
    counted = CountVectorizer(inputCol="_terms", outputCol="_vector", vocabSize=vocabulary, minDF=2 if rows.count() > 2 else 1, binary=True)
    line = LinearRegression(
        featuresCol="_vector", labelCol="Score", predictionCol="_score", weightCol="Reviews", regParam=PENALTY,
        elasticNetParam=ELASTIC, standardization=False, solver="l-bfgs", maxIter=60,
    )
    return LearnedScorer(Pipeline(stages=[counted, line]).fit(rows))


def held_out_errors(star: ReviewStar, scorer: LearnedScorer) -> DataFrame:
    """``Reviews, LearnedError, ListError``: mean distances from the stored scores, over reviews of held-out texts.

    A text without an opinion counts as 5 for both.
    """
    texts = scored_texts(star).where(is_held_out(F.col("TextKey")))
    both = scorer.scores(texts, "ReviewText").withColumn("_words", word_list(clean_text(F.col("ReviewText")))).select(
        "Reviews", "Score", "Sentiment", lexicon_score(F.col("_words")).alias("Listed")
    )

    def error(name: str) -> Column:
        guess = F.when(F.col(name) < 0, 5).otherwise(F.col(name))
        return F.sum(F.abs(guess - F.col("Score")) * F.col("Reviews")) / F.sum("Reviews")

    return both.agg(F.sum("Reviews").alias("Reviews"), error("Sentiment").alias("LearnedError"), error("Listed").alias("ListError"))
