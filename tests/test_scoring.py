"""Batches, scorers that go wrong, and what becomes of their replies."""

import json

import pytest
from pyspark.sql import functions as F

from reviewloom import schema
from reviewloom.operators import batches as B
from reviewloom.plans import candidates, scoring


def judged(spark, reply, ids=(1, 2), item=schema.OVERALL_ITEM):
    items = [(i, f"text {i}") for i in ids]
    df = spark.createDataFrame(
        [(0, 0, items, reply)],
        "Queue int, Batch int, Items array<struct<ReviewID: long, ReviewText: string>>, Reply string",
    )
    return B.check_batches(df, item)


def reply(*items, root="review_sentiment"):
    return json.dumps({root: list(items)})


def item(i, score, **more):
    return {"ReviewID": i, "Sentiment": score, **more}


@pytest.mark.parametrize(
    "text, reason",
    [
        (reply(item(1, 10), item(2, -1)), None),
        (reply(item(1, 10), item(2, 5), root="other"), None),
        ("", "empty reply"),
        ("not json", "empty reply"),
        (None, "empty reply"),
        (reply(), "empty reply"),
        (reply(item(2, 5), item(1, 5)), "ids differ"),
        (reply(item(1, 5)), "ids differ"),
        (reply(item(1, 5), item(2, 5), item(3, 5)), "ids differ"),
        (reply(item(1.5, 5), item(2, 5)), "ids differ"),
        (reply(item(1, 11), item(2, 5)), "invalid scores"),
        (reply(item(1, 4.5), item(2, 5)), "invalid scores"),
        (reply(item(1, None), item(2, 5)), "invalid scores"),
        (reply(item(1, 5, Extra=1), item(2, 5)), "unexpected keys"),
        (reply({"ReviewID": 1}, item(2, 5)), "unexpected keys"),
        (reply(item(1, "5"), item(2, 5)), "invalid scores"),
        (reply(item(1, True), item(2, 5)), "invalid scores"),
        (reply(item("1", 5), item(2, 5)), None),
        (reply(item(True, 5), item(2, 5)), "ids differ"),
        (reply(item(1, 5), "text"), "unexpected keys"),
        ('{"a": {"ReviewID": 1, "Sentiment": 5}}', "empty reply"),
        ('{"a": null, "b": [{"ReviewID": 1, "Sentiment": 5}]}', "empty reply"),
        ('{"b": [{"ReviewID": 1, "Sentiment": 5}, {"ReviewID": 2, "Sentiment": 6}], "a": []}', None),
        ('{"a": [{"ReviewID": 1, "Sentiment": 5, "Sentiment": 6}, {"ReviewID": 2, "Sentiment": 6}]}', "empty reply"),
        ('[{"ReviewID": 1, "Sentiment": 5}]', "empty reply"),
        ("{}", "empty reply"),
    ],
)
def test_verdicts(spark, text, reason):
    checked = judged(spark, text)
    assert checked.first().Reason == reason
    assert checked.count() == B.accepted_scores(checked, schema.OVERALL_ITEM).count() // 2 + B.quarantine(checked).count()


def test_a_reply_is_parsed_once(spark):
    plan = judged(spark, "{}")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1 and "variant" in plan


def test_large_ids_are_told_apart(spark):
    ids = (2**60 + 1, 2**60 + 2)
    assert judged(spark, reply(item(ids[0], 5), item(ids[1], 5)), ids).first().Reason is None
    assert judged(spark, reply(item(2**60, 5), item(ids[1], 5)), ids).first().Reason == "ids differ"


def test_summary_replies_parse(spark):
    text = json.dumps({"review_summary": [{"Summary": "Good.", "Pros": "great staff (20%)", "Cons": "-"}]})
    df = spark.createDataFrame([(1, text)], "VenueID int, Reply string")
    assert tuple(B.parse_scores(df, "Reply", schema.SUMMARY_ITEM).first()) == (1, "Good.", "great staff (20%)", "-")


def test_failing_scorer_fails_its_batches_only(star):
    inner = scoring.lexicon_scorer()

    def shaky(batch):
        if "portion" in batch:
            raise ValueError("no answer")
        return inner(batch)

    run = scoring.run_scorer(star.review, shaky, size=20)
    reasons = {(row.Reason, row.Error) for row in run.rejects.collect()}
    assert reasons == {("scorer failed", "ValueError: no answer")}
    good = scoring.clean_reviews(star.review).where("CleanText NOT LIKE '%portion%'")
    assert run.scores.count() == good.count()
    metrics = run.metrics.first()
    assert (metrics.Completed, metrics.Failed) == (
        good.select("CleanText").distinct().count(), run.rejects.agg(F.sum(F.size("ReviewIDs"))).first()[0]
    )


def test_a_scorer_that_always_raises_stops_the_run(star):
    def broken(batch):
        raise PermissionError("wrong password")

    with pytest.raises(RuntimeError, match="PermissionError: wrong password"):
        scoring.run_scorer(star.review, broken)


def test_passes_end_with_single_texts():
    assert scoring.pass_sizes(50, 3) == [50, 10, 1]
    assert scoring.pass_sizes(50, 1) == [50]
    assert scoring.pass_sizes(2, 4) == [2, 1, 1, 1]


def test_batches_fill_and_spread(spark, star):
    unique = scoring.unique_texts(scoring.clean_reviews(star.review))
    assert unique.count() == 84
    assert B.assign_batches(unique, queues=B.queue_count(unique)).select("Queue", "Batch").distinct().count() == 2
    steps = spark.range(0, 40 * 1021, 1021).withColumnRenamed("id", "ReviewID")
    assert B.assign_batches(steps, queues=8).select("Queue").distinct().count() > 5


def test_calls_are_spread_over_tasks(spark):
    """Whatever the bytes of the batches: adaptive execution merges no tasks that call."""
    rows = spark.range(200).selectExpr("id AS ReviewID", "concat('text ', id) AS ReviewText")
    batches = B.batch_json(B.assign_batches(rows, size=5), ["ReviewID", "ReviewText"])

    def who(batch):
        from pyspark import TaskContext

        return str(TaskContext.get().partitionId())

    asked = scoring.ask_scorer(batches, who, calls=4).collect()
    assert len(asked) == 40 and len({row.Reply for row in asked}) == 4


def test_phrase_flags_are_checked(spark):
    good = reply(item(1, 5, PhraseFlag=1), item(2, -1, PhraseFlag=0))
    bad = reply(item(1, 5, PhraseFlag=2), item(2, -1, PhraseFlag=0))
    assert judged(spark, good, item=schema.PHRASE_ITEM).first().Reason is None
    assert judged(spark, bad, item=schema.PHRASE_ITEM).first().Reason == "invalid flags"


def test_batches_hold_at_most_their_size(spark):
    ids = spark.range(1234).withColumnRenamed("id", "ReviewID")
    batched = B.assign_batches(ids, size=50, queues=7)
    sizes = batched.groupBy("Queue", "Batch").count().collect()
    assert max(row["count"] for row in sizes) == 50
    assert sum(row["count"] for row in sizes) == 1234
    again = B.assign_batches(ids.repartition(13), size=50, queues=7)
    assert batched.exceptAll(again).isEmpty()


def test_group_json_is_whole_and_bounded(spark):
    df = spark.range(1000).selectExpr("CASE WHEN id < 700 THEN 1 ELSE 2 END AS k", "id", "concat('t', id) AS t")
    parts = B.group_json(df, ["k"], "t", "id", size=20, width=150).collect()
    assert max(len(json.loads(row.ValuesJson)) for row in parts) <= 20
    assert sorted(value for row in parts for value in json.loads(row.ValuesJson)) == sorted(f"t{i}" for i in range(1000))


def test_row_by_row_validation(spark, rows):
    sent = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (0, 1, 3), (0, 2, 4)], "Queue int, Batch int, ReviewID long")
    got = spark.createDataFrame(
        [(0, 0, 1, 5.0), (0, 0, 9, 5.0), (0, 1, 3, 7.0), (0, 2, 4, 1.0), (0, 2, 4, 2.0)],
        "Queue int, Batch int, ReviewID long, Sentiment double",
    )
    found = {row.ReviewID: (row.State, row.Accepted) for row in B.validate_scores(sent, got).collect()}
    assert found == {
        1: ("ok", False), 2: ("missing", False), 9: ("extra", False), 3: ("ok", True), 4: ("repeated", False)
    }


def test_answers_out_of_order_are_misplaced(spark):
    sent = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (0, 1, 3)], "Queue int, Batch int, ReviewID long")
    got = spark.createDataFrame(
        [(0, 0, 2, 5, 0), (0, 0, 1, 5, 1), (0, 1, 3, 5, 0)], "Queue int, Batch int, ReviewID long, Sentiment int, Place int"
    )
    found = {row.ReviewID: (row.State, row.Accepted) for row in B.validate_scores(sent, got).collect()}
    assert found == {1: ("misplaced", False), 2: ("misplaced", False), 3: ("ok", True)}


def test_scorer_is_called_once_for_a_batch(spark, star):
    calls = spark.sparkContext.accumulator(0)
    inner = scoring.lexicon_scorer()

    def counted(batch):
        calls.add(1)
        return inner(batch)

    found = candidates.candidates_overall(star, 19980101)
    run = scoring.run_scorer(found, counted, size=10)
    total = run.scores.count()
    metrics = run.metrics.first()
    assert run.rejects.isEmpty()
    assert (metrics.Failed, metrics.Remaining) == (0, 0)
    assert total == found.count()
    unique = scoring.clean_reviews(found).select("CleanText").distinct().count()
    assert metrics.Completed == unique
    assert unique / 10 <= calls.value <= unique / 10 + 3


def test_both_scoring_paths_agree(star):
    found = candidates.candidates_overall(star, 19980101)
    in_place = scoring.score_reviews(found)
    batched = scoring.run_scorer(found, scoring.lexicon_scorer()).scores
    assert in_place.exceptAll(batched).isEmpty() and batched.exceptAll(in_place).isEmpty()


def test_refused_batches_leave_their_reviews_unscored(star):
    found = candidates.candidates_overall(star, 19980101)
    run = scoring.run_scorer(found, lambda batch: "{}")
    assert run.scores.isEmpty()
    metrics = run.metrics.first()
    assert metrics.Completed == 0 and metrics.Failed == metrics.Remaining > 0
