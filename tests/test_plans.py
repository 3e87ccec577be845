"""Physical plans as they would be at scale, with nothing small enough to broadcast by itself."""

import re

import pytest

from checks.queries import QUERIES

# Global counts, top-k rows, block starts and a handful of new windows or flags
# meet in one task; rows of the fact tables never do.
HANDFUL = {"Window", "HashAggregate", "ObjectHashAggregate", "TakeOrderedAndProject"}


def plan_of(spark, folder, name):
    return QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def at_scale(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


LAZY = [
    "operator_stats", "rating_vs_sentiment", "sentiment_distribution", "rating_by_sentiment", "rating_mix_by_year",
    "list_operators", "review_operator", "operator_left_reviews", "anti_not_in", "semi_text", "collapse_duplicates",
    "running_max_date", "propagate_labels", "candidates_overall", "candidates_phrase_operators", "score_reviews",
    "score_dim_or_join", "validate_scores", "writeback_overall", "insert_if_absent", "venue_inputs", "region_inputs",
    "top_aspects", "summarise_group", "publish_summaries", "remaining_venues",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_joins_no_python_and_no_rows_in_one_task(spark, folder, at_scale, name):
    plan = plan_of(spark, folder, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert operator not in plan
    lines = plan.splitlines()
    for place, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = re.sub(r"^[\s:+\-*()\d]*", "", lines[place + 1]).split(" ")[0].split("(")[0]
            assert below in HANDFUL


def test_best_sentences_are_picked_before_the_shuffle(spark, folder):
    plan = plan_of(spark, folder, "summarise_documents")
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_scans_read_only_what_they_need(spark, folder):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = plan_of(spark, folder, "rank_phrases")
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    lines = [schema for schema in schemas if "l_orderkey" in schema]
    assert lines and all("l_extendedprice" not in schema and "l_shipdate" not in schema for schema in lines)


def test_the_selection_reaches_the_reviews_before_they_are_joined(spark, folder, at_scale):
    """Venues of the picked operators meet the reviews before bridge and counts do."""
    plan = plan_of(spark, folder, "operator_stats_selected")
    assert plan.count("LeftSemi") >= 2
    for part in re.split(r"\n(?=[^\n]*Scan parquet)", plan):
        assert "partial_count" not in part or "LeftSemi" not in part.split("partial_count")[0]


def test_listed_texts_travel_as_keys(spark, folder):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = plan_of(spark, folder, "semi_text")
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert all("o_custkey" not in s and "o_orderdate" not in s for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan))


def test_windows_over_blocks_are_bounded(spark, folder):
    plan = plan_of(spark, folder, "running_max_sparse")
    assert "Exchange SinglePartition" not in plan
    specs = re.findall(r"windowspecdefinition\(([^,]*), ([^,]*),", plan)
    assert specs and all("_group" in a and ("_block" in b or "_above" in b) for a, b in specs)


def test_validation_is_one_shuffle(spark, folder):
    plan = plan_of(spark, folder, "validate_scores")
    assert len(re.findall(r"Exchange hashpartitioning\(Queue#\d+, Batch#\d+", plan)) == 1 and "Join" not in plan


def test_scoring_in_place_needs_no_shuffle(spark, folder):
    assert "Exchange" not in plan_of(spark, folder, "score_documents")


def test_cleaning_is_not_repeated_in_filters(spark, folder):
    """Not-null tests on keys would carry the cleaning down to the scan again."""
    plan = QUERIES["score_documents_batched"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if re.match(r"[\s:+\-*()\d]*Filter", line)]
    assert not any("regexp_replace" in line or "sha2" in line for line in filters)


def test_reviews_are_counted_before_dimensions_are_joined(spark, folder, at_scale):
    plan = plan_of(spark, folder, "sentiment_distribution")
    fact = plan[: plan.index("o_orderkey") if "o_orderkey" in plan else plan.index("o_custkey")]
    assert "partial_count" in plan and "SortMergeJoin" in fact
