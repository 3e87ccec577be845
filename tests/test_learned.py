"""The learned scorer: what it learns, what it leaves out, and how it does on texts it has not seen."""

import random

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from reviewloom.functions.text import text_key
from reviewloom.plans import learned, scoring

REVIEW = "ReviewID long, VenueID long, Review_DateID int, ReviewRating int, ReviewText string, ReviewSentimentID int"


@pytest.fixture(scope="module")
def opinions(spark, star):
    """Reviews whose scores follow words that the list doesn't know; some have copies, one has many."""
    rng = random.Random(11)
    worth = {"zesty": 3, "plush": 2, "meh": -1, "soggy": -3, "grim": -4}
    fill = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    rows = []
    for i in range(3000):
        said = rng.sample(sorted(worth), rng.choice([0, 1, 1, 2]))
        turned = rng.random() < 0.2 and len(said) == 1
        total = sum(worth[word] for word in said)
        text = " ".join(rng.sample(fill, 4) + (["wasn't"] if turned else []) + said)
        score = max(0, min(10, 5 + (-total if turned else total)))
        for _ in range(300 if i == 7 else rng.choice([1, 1, 2])):
            rows.append((len(rows), 1, 20240101, 3, text, 3 + score))
    rows += [(10**6 + k, 1, 20240101, 3, text, state) for k, (text, state) in enumerate([(None, 5), ("", 5), ("unheard of", 1), ("zesty", 1)])]
    return star.replace(review=spark.createDataFrame(rows, REVIEW).repartition(4))


def test_learns_words_and_turned_words(opinions):
    scorer = learned.fit(opinions)
    found = {row.ReviewText: row.Sentiment for row in scorer.scores(opinions.review.sparkSession.createDataFrame([("so zesty",), ("the grim",), ("wasn't zesty",), ("nobody knows",), ("",)], "ReviewText string"), "ReviewText").collect()}
    assert found["so zesty"] >= 7 and found["the grim"] <= 2 and found["wasn't zesty"] <= 4
    assert found["nobody knows"] == found[""] == -1
    errors = learned.held_out_errors(opinions, scorer).first()
    assert errors.Reviews > 300 and errors.LearnedError < 0.6 < 1.5 < errors.ListError


def test_scores_take_the_place_of_the_list(opinions):
    scorer = learned.fit(opinions)
    found, listed = scorer(opinions.review), scoring.score_reviews(opinions.review)
    assert found.schema == listed.schema and found.count() == listed.count()


def test_copies_are_on_one_side(opinions):
    texts = opinions.review.where("ReviewText IS NOT NULL").withColumn("out", learned.is_held_out(text_key(F.col("ReviewText"))))
    assert texts.groupBy("ReviewText").agg(F.count_distinct("out").alias("n")).where("n > 1").isEmpty()
    share = texts.select("ReviewText", "out").distinct().agg(F.avg(F.col("out").cast("int"))).first()[0]
    assert 0.15 < share < 0.25


def test_a_bounded_sample_and_nothing_at_all(opinions):
    assert len(learned.fit(opinions, sample=200, vocabulary=20).model.stages[0].vocabulary) <= 20
    empty = opinions.replace(review=opinions.review.where("false"))
    scorer = learned.fit(empty)
    assert {row.Sentiment for row in scorer.scores(opinions.review, "ReviewText").collect()} == {-1}
    assert learned.held_out_errors(empty, scorer).first().LearnedError is None


def test_registered_query(spark, folder, star):
    rows = QUERIES["score_learned"](spark, folder)
    assert rows.count() == star.review.where("ReviewText IS NOT NULL").count()
    assert rows.where("Sentiment NOT BETWEEN -1 AND 10").isEmpty()
    errors = learned.held_out_errors(star, learned.fit(star)).first()
    assert errors.LearnedError <= errors.ListError
