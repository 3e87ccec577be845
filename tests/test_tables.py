"""Upserts, write-back, summaries and table input and output."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from reviewloom import session
from reviewloom.functions import words as W
from reviewloom.operators import relational, upserts
from reviewloom.plans import candidates, dashboard, scoring, summaries, writeback
from reviewloom.sources import tables
from reviewloom.sources.star import ReviewStar, TABLES, read_star


def test_surrogate_keys_are_dense_in_key_order(spark):
    existing = spark.createDataFrame([(41, 1)], "id int, k long")
    fresh = spark.range(0, 5000, 3).select(F.col("id").alias("k")).repartition(5)
    numbered = upserts.with_surrogate_keys(fresh, existing, "id", ["k"])
    assert [row.id for row in numbered.orderBy("k").collect()] == list(range(42, 42 + 1667))


def test_null_and_text_keys_are_numbered_and_added_once(spark, rows):
    table = spark.createDataFrame([(2, "5")], "id int, k string")
    new = spark.createDataFrame([("6",), (None,), ("5",)], "k string")
    once = upserts.insert_if_absent(table, new, ["k"], "id")
    assert rows(once) == [(2, "5"), (3, None), (4, "6")]
    assert rows(upserts.insert_if_absent(once, new, ["k"], "id")) == rows(once)


def test_surrogate_keys_start_at_one_in_an_empty_table(spark):
    empty = spark.createDataFrame([], "id int, k long")
    fresh = spark.range(3).withColumnRenamed("id", "k")
    assert sorted(row.id for row in upserts.insert_if_absent(empty, fresh, ["k"], "id").collect()) == [1, 2, 3]


def test_date_range_twice_adds_one(star):
    once = upserts.date_range_upsert(star.date_range, 20240229, 20250228, 12)
    twice = upserts.date_range_upsert(once, 20240229, 20250228, 12)
    assert once.count() == twice.count() == star.date_range.count() + 1


def test_updates_and_deletes(spark, rows):
    table = spark.createDataFrame([(1, 5, "a"), (2, 6, None)], "ReviewID long, v int, ReviewText string")
    changes = spark.createDataFrame([(1, 9), (3, 9)], "ReviewID long, v int")
    assert rows(upserts.update_column(table, changes, "ReviewID", "v")) == [(1, 9, "a"), (2, 6, None)]
    assert rows(upserts.delete_by_text(table, spark.createDataFrame([("a",)], "ReviewText string"))) == [(2, 6, None)]


def test_not_in_follows_sql_nulls(spark, rows):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "b int")
    assert rows(relational.not_in(left, "a", frame([1]), "b")) == [(2,)]
    assert rows(relational.not_in(left, "a", frame([1, None]), "b")) == []
    assert rows(relational.not_in(left, "a", frame([]), "b")) == [(1,), (2,), (None,)]


def test_selections(star):
    assert dashboard.sentiment_distribution(star, []).isEmpty()
    assert dashboard.operator_stats(star, []).isEmpty()
    assert relational.search_dimension(star.operator, "OperatorName", "").count() == 25
    assert relational.select_members(star.operator, "OperatorName", []).isEmpty()


def test_operator_without_reviews(star):
    row = dashboard.operator_stats(star, [12]).first()
    assert (row.ProcessedReviewRatio, row.CountReviews) == (0, 0)
    assert row.AvgSentimentScore is None and row.MostPositivePhraseName is None


def test_proportions_and_shares_add_up(star):
    by_year = dashboard.rating_mix_by_year(star).groupBy("ReviewYear").agg(F.sum("RatingProportion").alias("s"))
    assert all(abs(float(row.s) - 1) < 1e-4 for row in by_year.collect())
    assert abs(float(dashboard.sentiment_share(star).agg(F.sum("Share")).first()[0]) - 100) < 1


def test_writing_scores_twice_changes_nothing_more(star):
    found = candidates.candidates_overall(star, 19980101)
    scores = scoring.score_reviews(found)
    once = star.replace(review=session.cut_lineage(writeback.writeback_overall(star, scores)))
    again = writeback.writeback_overall(once, scores)
    assert once.review.exceptAll(again.select(*once.review.columns)).isEmpty()
    assert once.review.count() == star.review.count()
    everything = scoring.score_reviews(candidates.candidates_overall(star))
    done = star.replace(review=session.cut_lineage(writeback.writeback_overall(star, everything)))
    assert candidates.candidates_overall(done).isEmpty()


def test_phrase_tables_twice_add_nothing(star):
    found = candidates.candidates_phrase(star, ["Atmosphere"])
    scores = scoring.score_reviews(found, ["Atmosphere"])
    once = writeback.writeback_phrase(star, scores, ["Atmosphere"])
    after = star.replace(phrase_flag=once.flags, phrase_review=once.reviews)
    twice = writeback.writeback_phrase(after, scores, ["Atmosphere"])
    assert once.reviews.count() == twice.reviews.count() > star.phrase_review.count()
    assert once.flags.count() == twice.flags.count()
    assert candidates.candidates_phrase(after, ["atmosphere"]).isEmpty()


def test_summarising_twice_adds_nothing(star):
    run = summaries.summarise_all(star, "Feb-00", 12)
    after = run.published
    assert summaries.remaining_venues(after, 19990228, 20000229).first().Remaining == 0
    assert summaries.remaining_operators(run.staged).first().Remaining == 0
    assert summaries.remaining_regions(run.staged).first().Remaining == 0
    again = summaries.summarise_all(after, "Feb-00", 12).published
    for name in ("date_range", "summary_venue", "summary_operator", "summary_region"):
        assert getattr(after, name).count() == getattr(again, name).count()
    words = after.summary_venue.agg(F.max(F.size(F.split("VenueSummary", " ")))).first()[0]
    assert words <= 50
    dashes = after.summary_region.where("RegionID = 99 AND DateRangeID = 4")
    assert dashes.count() > 0 and dashes.where("RegionSummary <> '-' OR RegionPros <> '-'").isEmpty()


def test_custom_summariser_reads_every_text_in_bounded_calls(spark):
    texts = [("big", f"word{i}") for i in range(1000)] + [("small", "alone")]
    df = spark.createDataFrame(texts, "k string, t string").repartition(5)
    longest = spark.sparkContext.accumulator(0)

    def joined(found, category):
        longest.add(1 if len(found) > 60 else 0)
        return " ".join(sorted(" ".join(found).split())), category, "-"

    result = summaries.summarise_with(df, ["k"], "t", "Operator", joined, chunk=30)
    found = {row.k: (row.Summary, row.Pros, row.Cons, row.Reason) for row in result.collect()}
    assert found["big"] == (" ".join(sorted(f"word{i}" for i in range(1000))), "-", "-", None)
    assert found["small"] == ("alone", "-", "-", None)
    assert longest.value == 0


def counters():
    """A summariser that counts, and what adds its counts up; made here so that they travel to the workers."""

    def count(texts, category):
        return f"{len(texts)}", "-", "-"

    def add(parts, category):
        return f"{sum(int(summary) for summary, _, _, _ in parts)}", f"{sum(n for _, _, _, n in parts)}", "-"

    return count, add


@pytest.mark.parametrize("chunk", [2, 7, 1_000_000])
def test_the_size_of_parts_does_not_change_the_answer(spark, chunk):
    texts = [("big", f"word{i}") for i in range(90)] + [("big", "word1"), ("big", None), ("small", "alone")]
    df = spark.createDataFrame(texts, "k string, t string").repartition(3)
    count, add = counters()
    result = summaries.summarise_with(df, ["k"], "t", "Operator", count, chunk=chunk, combine=add)
    assert sorted((row.k, row.Summary, row.Pros) for row in result.collect()) == [("big", "90", "90"), ("small", "1", "1")]


def test_pros_of_large_groups_count_reviews(spark):
    """Shares are of all texts, however many parts a group is read in."""
    df = spark.createDataFrame([("a", f"The staff was great {'abcdefghij'[i % 10]}{'x' * i}") for i in range(45)], "k string, t string")
    for chunk in (10, 100):
        row = summaries.summarise_with(df, ["k"], "t", "Operator", counters()[0], chunk=chunk).first()
        assert row.Pros == "great staff (100%)"


def test_parts_of_one_text_are_refused(spark):
    with pytest.raises(ValueError):
        summaries.summarise_with(spark.createDataFrame([], "k int, t string"), ["k"], "t", "", counters()[0], chunk=1)


def test_failed_summaries_have_a_reason(spark):
    def moody(texts, category):
        if "bad" in texts[0]:
            raise ValueError("no answer")
        return ("only one",) if "odd" in texts[0] else (texts[0], "-", "-")

    df = spark.createDataFrame([(1, "bad"), (2, "odd"), (3, "fine"), *[(4, f"bad {i}") for i in range(9)]], "k int, t string")
    result = summaries.summarise_with(df, ["k"], "t", "Operator", moody, chunk=4)
    assert {row.k: (row.Summary, row.Reason) for row in result.collect()} == {
        1: (None, "summariser failed: ValueError: no answer"), 2: (None, "unexpected reply"), 3: ("fine", None),
        4: (None, "summariser failed: ValueError: no answer"),
    }


def test_json_summaries_are_checked():
    record = {"Summary": "s", "Pros": "p", "Cons": "c"}
    answer = lambda reply: summaries.json_summariser(lambda asked: json.dumps(reply))(["t"], "Venue")
    assert answer({"review_summary": [record]}) == ("s", "p", "c")
    for wrong in ({}, {"a": [], "b": []}, {"a": []}, {"a": [record, record]}, {"a": [{**record, "More": 1}]}, {"a": [{**record, "Cons": None}]}, [record]):
        with pytest.raises(ValueError):
            answer(wrong)


def test_custom_summariser_in_the_pipeline(star):
    def first(found, category):
        return f"{category} {found[0].split()[0]}", "-", "-"

    def summarise(inputs, keys, text, category):
        return summaries.summarise_with(inputs, keys, text, category, first)

    rows = summaries.stage_operators(star, summarise).where("OperatorSummary LIKE 'Operator %'")
    assert rows.count() == summaries.operator_inputs(star).select("OperatorID", "DateRangeID").distinct().count()


def test_long_summaries_are_set_aside_with_a_reason(star):
    def long_winded(inputs, keys, text, category):
        row = [F.array_join(F.array_repeat(F.lit("word"), 51), " "), F.lit("-"), F.lit("-")]
        names = ("Summary", "Pros", "Cons")
        return inputs.select(*keys).distinct().select(*keys, *[c.alias(n) for c, n in zip(row, names)])

    level = summaries.operator_level(star, long_winded)
    assert level.table.count() == star.summary_operator.count()
    groups = summaries.operator_inputs(star).select("OperatorID", "DateRangeID").distinct().count()
    assert {row.Reason for row in level.rejects.collect()} == {"too long"}
    assert level.rejects.count() == groups
    assert tuple(level.metrics.first()) == ("Operator", 0, groups, groups)


def test_a_review_without_full_stops_is_summarised(spark):
    df = spark.createDataFrame([(1, " ".join(["good"] * 66))], "k int, t string")
    words = summaries.summarise_group(df, ["k"], "t").first().Summary.split()
    assert set(words) <= {"good", "good."} and 0 < len(words) <= 50


def test_stored_star(spark, star, tmp_path):
    for field, name in TABLES.items():
        getattr(star, field).write.parquet(f"{tmp_path}/{name}")
    stored = read_star(tables.parquet_reader(spark, str(tmp_path)))
    assert dashboard.operator_stats(stored).exceptAll(dashboard.operator_stats(star)).isEmpty()


def test_unknown_tables_are_refused():
    with pytest.raises(ValueError):
        ReviewStar({"reviews": lambda: None})


def test_saving_and_snapshots(spark):
    name, copy = "loom_base", "loom_copy"
    tables.drop_table(spark, name)
    tables.save_table(spark.range(10), name, bucket_by="id", buckets=2)
    snapshot = tables.snapshot_table(spark, name, copy)
    tables.save_table(spark.range(3), name)
    assert (snapshot.count(), spark.table(name).count()) == (10, 3)
    assert tables.catalog_reader(spark, "default")(name).count() == 3
    for table in (name, copy):
        tables.drop_table(spark, table)
        assert not spark.catalog.tableExists(table)


def test_allow_list_from_csv(spark, tmp_path):
    path = tmp_path / "allowed.csv"
    path.write_text("AllowedWords\n" + "\n".join(W.ALLOWED_STOP_WORDS) + "\n")
    assert sorted(tables.stop_words_from_csv(spark, str(path))) == sorted(W.stop_words())


def test_rows_as_json(spark):
    assert tables.row_json(spark.sql("SELECT 1 AS a, 'x' AS b")).first().json == '{"a":1,"b":"x"}'


def test_kept_results_are_read_back(spark, rows):
    df = spark.sql("SELECT 1 AS a, array(named_struct('b', CAST(1.5 AS decimal(3,1)))) AS s UNION ALL SELECT 2, NULL")
    assert rows(session.cut_lineage(df)) == rows(df)
    kept, small = session.keep_for_broadcast(df.where("a > 5"))
    assert small and kept.isEmpty()


def test_kept_results_are_deleted_with_their_owner(spark):
    with session.kept_results(spark):
        kept = session.cut_lineage(spark.range(3))
        path = kept.inputFiles()[0]
        assert kept.count() == 3 and os.path.exists(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:"))


def test_threads_own_their_results_apart(spark):
    """One thread's block ends while another's is open."""
    paths = {}
    ends = {"a": threading.Event(), "b": threading.Event()}

    def work(name, first, then):
        with session.kept_results(spark):
            paths[name] = session.cut_lineage(spark.range(2)).inputFiles()[0].removeprefix("file:")
            first.set()
            then.wait(60)

    done = threading.Event()
    threads = [threading.Thread(target=work, args=("a", ends["a"], ends["b"])), threading.Thread(target=work, args=("b", ends["b"], done))]
    for thread in threads:
        thread.start()
    threads[0].join(120)
    assert not os.path.exists(paths["a"]) and os.path.exists(paths["b"])
    done.set()
    threads[1].join(120)
    assert not os.path.exists(paths["b"])


def test_broadcasts_of_dimensions_are_checked(spark):
    assert session.checked_broadcast(spark.range(5), 5).count() == 5
    with pytest.raises(Exception, match="too many rows"):
        session.checked_broadcast(spark.range(6), 5).collect()


def test_a_table_can_be_replaced_by_what_is_read_from_it(spark):
    tables.drop_table(spark, "loom_self")
    tables.save_table(spark.range(10), "loom_self")
    tables.replace_table(spark.table("loom_self").where("id > 6"), "loom_self", bucket_by="id", buckets=2)
    assert spark.table("loom_self").count() == 3
    tables.drop_table(spark, "loom_self")


def test_checkpoint_folder_comes_from_the_session(spark):
    assert session.checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
