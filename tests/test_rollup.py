"""Counts that take in changes answer like the tables themselves."""

import random

import pytest

from checks.queries import _counted
from reviewloom import session
from reviewloom.plans import dashboard, scoring, writeback
from reviewloom.plans.rollup import REVIEW_CELL, Rollup
from reviewloom.sources.star import ReviewStar

REVIEW = "ReviewID long, VenueID long, Review_DateID int, ReviewRating int, ReviewText string, ReviewSentimentID int"
BRIDGE = "ReviewID long, PhraseSentimentFlagID int"
ANSWERS = [
    dashboard.operator_stats, dashboard.rating_vs_sentiment, dashboard.sentiment_distribution, dashboard.sentiment_share,
    dashboard.rating_mix_by_year, dashboard.rating_by_sentiment, dashboard.list_operators, dashboard.rank_phrases,
    lambda star: dashboard.preset_range(star, 3),
    lambda star: dashboard.operator_stats(star, [1, 4], date_range=(20240101, 20240115)),
    lambda star: dashboard.sentiment_distribution(star, [1, 4], ["Food"], (20240101, 20240120)),
]


@pytest.fixture
def world(spark, star):
    rng = random.Random(7)
    rows = {
        i: (i, rng.randrange(40), 20240101 + rng.randrange(28), rng.choice([None, 1, 3, 5]), rng.choice([None, "x"]), rng.choice([None, 1, 2, 3, 8, 13]))
        for i in range(400)
    }
    flags = {(i, rng.randrange(78)) for i in range(400) for _ in range(rng.randrange(3))}

    def table(rows=rows, flags=flags):
        days = [(20240101 + d, f"2024-01-{1 + d:02d}") for d in range(28)]
        made = {
            "review": spark.createDataFrame(list(rows.values()), REVIEW).repartition(3),
            "phrase_review": spark.createDataFrame(sorted(flags), BRIDGE),
            "dates": spark.createDataFrame(days, "DateID int, day string").selectExpr("DateID", "to_date(day) AS ActualDate"),
        }
        return star.replace(**made)

    return rng, rows, flags, table


def same(rows, counts, star, answers=ANSWERS):
    counted = counts.over(star)
    for answer in answers:
        assert rows(answer(counted)) == rows(answer(star))


def test_counts_alone_answer(world, rows, tmp_path):
    star = world[3]()
    counts = Rollup(f"file://{tmp_path}/counts").build(star)
    same(rows, counts, star)
    # Not a review is read: the star has none.
    blind = ReviewStar({name: (lambda name=name: getattr(star, name)) for name in ("venue", "brand", "operator", "sentiment", "dates", "phrase_flag")})
    assert rows(dashboard.operator_stats(counts.over(blind))) == rows(dashboard.operator_stats(star))


def test_rounds_of_changes(spark, world, rows, tmp_path):
    rng, held, flags, table = world
    star = table()
    counts = Rollup(f"file://{tmp_path}/counts").build(star)

    changes = [(i, rng.choice([2, 8, 9])) for i in rng.sample(range(400), 150)] + [(9999, 8)]
    df = spark.createDataFrame(changes, "ReviewID long, ReviewSentimentID int")
    for _ in range(2):  # stored twice, counted once
        counts.change_sentiments(1, star.review, df)
    held |= {i: (*held[i][:5], state) for i, state in changes if i in held}
    same(rows, counts, table(), ANSWERS[1:3])

    gone = set(rng.sample(sorted(flags), 60))
    fresh = {(i, k) for i in range(0, 400, 5) for k in (12, 40)} - flags
    bridge = lambda some: spark.createDataFrame(sorted(some), BRIDGE)
    counts.change_flags(2, table().review, bridge(fresh), bridge(gone))
    flags -= gone
    flags |= fresh
    same(rows, counts, table(), ANSWERS[:1])

    # All reviews of some venues go, with their flags, and new ones come.
    out = {i: row for i, row in held.items() if row[1] % 3 == 0}
    out_flags = {pair for pair in flags if pair[0] in out}
    review = lambda some: spark.createDataFrame(list(some.values()), REVIEW)
    counts.remove_reviews(3, review(out), bridge(out_flags))
    for i in out:
        del held[i]
    flags -= out_flags
    came = {i: (i, 41 + i % 3, 20240128, 4, "y", 9) for i in range(1000, 1030)}
    counts.add_reviews(4, review(came), bridge({(1000, 20)}))
    held |= came
    flags.add((1000, 20))
    same(rows, counts, table())

    small = counts.compacted(spark, f"file://{tmp_path}/compacted")
    same(rows, small, table(), ANSWERS[:3])
    cells = small.reviews(spark)
    assert cells.count() == cells.select(*REVIEW_CELL).distinct().count() < counts.reviews(spark).count()
    assert cells.where("N <= 0").isEmpty()


def test_no_reviews(spark, world, rows, tmp_path):
    star = world[3]()
    empty = star.replace(review=star.review.where("false"), phrase_review=star.phrase_review.where("false"))
    same(rows, Rollup(f"file://{tmp_path}/counts").build(empty), empty)


def seen(df, passed):
    """``df``, whose rows are counted in ``passed`` whenever they are made."""

    def count(frames):
        for frame in frames:
            passed.add(len(frame))
            yield frame

    return df.mapInPandas(count, df.schema)


def test_stored_changes_read_the_flags_once(spark, world, rows):
    star, passed = world[3](), spark.sparkContext.accumulator(0)
    bridge = star.phrase_review
    counted = _counted(star.replace(phrase_review=seen(bridge, passed)))
    found = rows(dashboard.operator_stats(counted))
    assert passed.value == bridge.count()
    # The counts tell what the changed tables tell.
    counted.review_counts = counted.phrase_counts = None
    assert found == rows(dashboard.operator_stats(counted))


@pytest.mark.parametrize("few", [500_000, 0])
def test_added_flags(spark, world, rows, tmp_path, monkeypatch, few):
    monkeypatch.setattr(session, "BROADCAST_ROWS", few)
    star = world[3]()
    counts = Rollup(f"file://{tmp_path}/counts").build(star)
    scores = scoring.score_reviews(star.review, ["Atmosphere"])
    made = writeback.writeback_phrase(star, scores, ["Atmosphere"])
    assert rows(made.reviews) == sorted(rows(star.phrase_review) + rows(made.added), key=repr)
    assert made.added.count() and made.added.join(star.phrase_review, ["ReviewID", "PhraseSentimentFlagID"]).isEmpty()
    counts.change_flags(1, star.review, made.added)
    same(rows, counts, star.replace(phrase_flag=made.flags, phrase_review=made.reviews), ANSWERS[:1])
