"""Copies of texts: nothing lost, nothing gathered in one place."""

import random

import pytest
from pyspark.sql import functions as F

from reviewloom.operators import duplicates as D
from reviewloom.operators import relational
from reviewloom.plans import candidates
from reviewloom.session import cut_lineage


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one text."""
    random.seed(7)
    data = [
        (i, "hot" if random.random() < 0.34 else f"text {random.randrange(40)}", random.randrange(100))
        for i in range(3000)
    ]
    return data, spark.createDataFrame(data, "ReviewID long, ReviewText string, Review_DateID int").repartition(4).cache()


def test_running_max_equals_brute_force(skewed):
    data, df = skewed
    highest, expected = {}, {}
    for i, text, day in data:
        highest[text] = max(highest.get(text, -1), day)
        expected[i] = highest[text]
    for width in (50, 1 << 20):
        found = D.running_max(df, F.col("ReviewText"), "Review_DateID", width=width)
        assert {row.ReviewID: row.RunningMax for row in found.collect()} == expected


def test_id_lists_are_bounded_and_whole(skewed):
    data, df = skewed
    lists = D.duplicate_id_lists(df, "ReviewText", width=100).collect()
    assert max(len(row.MatchedTextIDs) for row in lists) <= 100
    assert sorted(i for row in lists for i in row.MatchedTextIDs) == [i for i, _, _ in data]


def test_collapse_keeps_the_smallest_id_and_counts(skewed):
    data, df = skewed
    collapsed = D.collapse_duplicates(df, "ReviewText").collect()
    assert sum(row.Copies for row in collapsed) == len(data)
    assert {row.ReviewText: row.ReviewID for row in collapsed} == {
        text: min(i for i, other, _ in data if other == text) for text in {text for _, text, _ in data}
    }


def test_fan_out_keeps_every_row(skewed):
    data, df = skewed
    scored = D.collapse_duplicates(df, "ReviewText").select("ReviewText", F.length("ReviewText").alias("s"))
    assert D.fan_out(scored, df, "ReviewText").count() == len(data)


def test_propagation_adds_labels_once(spark, rows):
    reviews = spark.createDataFrame(
        [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "A")], "ReviewID long, ReviewText string"
    )
    labels = spark.createDataFrame([(1, 7), (2, 7), (1, 8), (4, 9)], "ReviewID long, Flag int")
    new = D.propagate_labels(reviews, labels, "ReviewID", "ReviewText", ["Flag"])
    assert rows(new) == [(2, 8)]
    again = D.propagate_labels(reviews, labels.unionByName(new), "ReviewID", "ReviewText", ["Flag"])
    assert again.isEmpty()
    blind = D.propagate_labels(reviews, labels, "ReviewID", "ReviewText", ["Flag"], ignore_case=True)
    assert rows(blind) == [(2, 8), (5, 7), (5, 8)]
    assert D.propagate_labels(reviews, labels, "ReviewID", "ReviewText", ["Flag"], only_text="b").isEmpty()


def test_a_hot_text_is_split_while_joined(spark):
    """Adaptive execution cuts the hot partition of the large side."""
    df = spark.range(0, 60_000, 1, 8).selectExpr(
        "id AS ReviewID", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('text ', id % 500) END AS ReviewText"
    )
    saved = {}
    narrow = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    for name, value in narrow.items():
        saved[name] = spark.conf.get(name, None)
        spark.conf.set(name, value)
    try:
        scored = cut_lineage(D.collapse_duplicates(df, "ReviewText").select("ReviewText", "Copies"))
        joined = D.fan_out(scored, df, "ReviewText")
        assert len(joined.collect()) == 60_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        listed = df.withColumn("Extra", F.col("ReviewID") * 2)
        kept = relational.having(df, listed, ["ReviewText"])
        assert len(kept.collect()) == 60_000
        assert "skew=true" in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in saved.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_candidates_without_broadcast_are_the_same(star, rows, monkeypatch):
    small = rows(candidates.candidates_overall(star, 19980101))
    monkeypatch.setattr("reviewloom.session.BROADCAST_ROWS", 0)
    assert rows(candidates.candidates_overall(star, 19980101)) == small


def test_running_frame_drops_copies_before_the_first_late_one(spark, star, rows):
    reviews = spark.createDataFrame(
        [(1, 1, "x", 5, 19970101, 1), (2, 1, "x", 5, 19990101, 3), (3, 1, "x", 5, 19960101, 3), (4, 1, "y", 5, 19990101, 3)],
        "ReviewID long, VenueID long, ReviewText string, ReviewRating int, Review_DateID int, ReviewSentimentID int",
    )
    small = star.replace(review=reviews)
    assert rows(candidates.candidates_overall(small, 19980101)) == [(2, "x"), (3, "x")]
    assert rows(candidates.candidates_overall(small, 19980101, frame="full")) == [(1, "x"), (2, "x"), (3, "x")]
    assert rows(candidates.candidates_overall(small)) == [(1, "x"), (2, "x"), (3, "x")]
