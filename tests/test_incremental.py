"""Reviews that arrive in batches end up like reviews scored at once, also when batches are repeated."""

import os
import random

import pytest
from pyspark.sql import functions as F

from reviewloom.plans import candidates, scoring, writeback
from reviewloom.sources.star import ReviewStar
from reviewloom.streaming.incremental import ScoreStore, score_stream

REVIEW = "ReviewID long, VenueID long, Review_DateID int, ReviewRating int, ReviewText string, ReviewSentimentID int"
MIN_DATE = 20230201


def reviews(seed, n=300):
    """Copies, missing texts, states and dates; ids don't come in the order of arrival."""
    rng = random.Random(seed)
    words = ["great", "slow", "cold", "lovely", "terrible", "fine", "friendly", "nothing said"]
    rows = []
    for id_ in rng.sample(range(10 * n), n):
        text = None if rng.random() < 0.1 else f"The {rng.choice(['staff', 'food'])} was {rng.choice(words)}, {'Again' * rng.randrange(3)}!"
        rows.append((id_, id_ % 7, rng.choice([20220101, 20230131, 20230201, 20240101]), 3, text, rng.choice([1, 2, 8, 8, 9])))
    return rows


@pytest.fixture
def dimension(star):
    return star.sentiment


@pytest.fixture
def inbox(spark, tmp_path):
    """Rows as files, one a batch; and the stream over them."""
    folder = tmp_path / "inbox"

    def put(rows, batches):
        folder.mkdir(exist_ok=True)
        at = len(list(folder.glob("*.parquet")))
        for k in range(batches):
            some = spark.createDataFrame(rows[k::batches], REVIEW)
            some.coalesce(1).write.parquet(f"{tmp_path}/draft-{at + k}")
            (part,) = (tmp_path / f"draft-{at + k}").glob("*.parquet")
            os.utime(part, (1_000_000 + at + k, 1_000_000 + at + k))
            part.rename(folder / f"{at + k}.parquet")
        return spark.readStream.schema(REVIEW).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return put


def at_once(spark, rows, dimension, min_date=MIN_DATE):
    table = spark.createDataFrame(rows, REVIEW)
    star = ReviewStar({"review": lambda: table, "sentiment": lambda: dimension})
    return star, sorted(tuple(row) for row in scoring.score_reviews(candidates.candidates_overall(star, min_date)).collect())


def run(stream, store, dimension):
    score_stream(stream, store, dimension).awaitTermination()
    return sorted(tuple(row) for row in store.scores(stream.sparkSession).collect())


@pytest.mark.parametrize("seed, batches, min_date", [(1, 5, MIN_DATE), (3, 3, None)])
def test_batches_equal_all_at_once(spark, inbox, dimension, tmp_path, seed, batches, min_date):
    rows = reviews(seed)
    store = ScoreStore(f"file://{tmp_path}/store", min_date)
    found = run(inbox(rows, batches), store, dimension)
    star, want = at_once(spark, rows, dimension, min_date)
    assert found == want
    stored = writeback.writeback_overall(star, store.scores(spark)).where("ReviewSentimentID = 1")
    assert not set(row.ReviewID for row in stored.collect()) & {id_ for id_, _ in found}


def test_later_files_go_on(spark, inbox, dimension, tmp_path):
    """A new copy makes old ones due; texts that have a score are not asked for again."""
    asked = []

    def score(texts):
        asked.extend(row.ReviewText for row in texts.collect())
        return scoring.score_reviews(texts)

    store = ScoreStore(f"file://{tmp_path}/store", MIN_DATE, score)
    first = [(5, 1, 20240101, 3, "was great", 8), (6, 1, 20220101, 3, "was slow", 1), (7, 1, 20240101, 3, "was cold", 1)]
    assert run(inbox(first, 1), store, dimension) == [(7, pytest.approx(store.scores(spark).first().Sentiment))]
    second = [(9, 1, 20220101, 3, "was great", 1), (3, 1, 20230201, 3, "was slow", 9), (8, 1, 20220101, 3, "was cold", 9)]
    found = run(inbox(second, 1), store, dimension)
    assert [id_ for id_, _ in found] == [3, 5, 6, 7, 8, 9]
    assert sorted(asked) == ["was cold", "was great", "was slow"]
    assert found == at_once(spark, first + second, dimension)[1]
    assert run(inbox([], 1), store, dimension) == found


def test_killed_batches_are_repeated(spark, inbox, dimension, tmp_path):
    """Batches die before, while and after their scores are made; the state ends up the same."""
    rows = reviews(4)
    stream = inbox(rows, 3)
    for death in ("asked", "scored"):
        calls = []

        def dies(texts, death=death, calls=calls):
            calls.append(1)
            if len(calls) == 2 and death == "asked":
                raise RuntimeError("killed")
            scored = scoring.score_reviews(texts)
            if len(calls) == 2:
                return scored.where(F.when(F.col("ReviewID") >= 0, F.raise_error(F.lit("killed"))).otherwise(True))
            return scored

        folder = f"file://{tmp_path}/store-{death}"
        with pytest.raises(Exception, match="killed"):
            run(stream, ScoreStore(folder, MIN_DATE, dies), dimension)
        assert len(list((tmp_path / f"store-{death}" / "arrived").glob("batch=*"))) == 2
        assert run(stream, ScoreStore(folder, MIN_DATE), dimension) == at_once(spark, rows, dimension)[1]


def test_a_finished_batch_that_was_not_committed_is_replayed(spark, inbox, dimension, tmp_path):
    rows = reviews(5)
    stream, store = inbox(rows, 3), ScoreStore(f"file://{tmp_path}/store", MIN_DATE)
    found = run(stream, store, dimension)
    before = store.read(spark, "scores").count(), store.read(spark, "texts").count(), store.read(spark, "arrived").count()
    commits = tmp_path / "store" / "progress" / "commits"
    for name in ("2", ".2.crc"):
        if (commits / name).exists():
            (commits / name).rename(tmp_path / f"lost{name}")
    asked = []
    again = ScoreStore(store.folder, MIN_DATE, lambda texts: (asked.append(texts.count()), scoring.score_reviews(texts))[1])
    assert run(stream, again, dimension) == found
    assert len(asked) == 1
    assert before == (store.read(spark, "scores").count(), store.read(spark, "texts").count(), store.read(spark, "arrived").count())


def test_refused_texts_are_asked_for_again(spark, inbox, dimension, tmp_path):
    asked = []

    def moody(texts):
        asked.append(sorted(row.ReviewText for row in texts.collect()))
        refused = len(asked) < 3
        return scoring.score_reviews(texts.where(~F.col("ReviewText").contains("great") | F.lit(not refused)).where("ReviewText NOT LIKE '%slow%'"))

    store = ScoreStore(f"file://{tmp_path}/store", None, moody, attempts=3)
    rows = [(1, 1, 20240101, 3, "was great", 1), (2, 1, 20240101, 3, "was slow", 1), (3, 1, 20240101, 3, "was great", 9)]
    assert run(inbox(rows, 1), store, dimension) == []
    more = [(10 + k, 1, 20240101, 3, f"was fine {k}", 1) for k in range(4)]
    found = run(inbox(more, 4), store, dimension)
    assert [id_ for id_, _ in found] == [1, 3, 10, 11, 12, 13]
    assert [len(texts) for texts in asked] == [2, 3, 3, 1, 1]  # great twice more, slow three times in all
    assert {row.ReviewText: row.Attempts for row in store.unscored_texts(spark).collect()} == {"was slow": 3}
