"""Changes are stored where they belong, and nowhere else."""

import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from reviewloom.sources import tables


@pytest.fixture
def stored(spark):
    name = f"review_{uuid.uuid4().hex}"
    df = spark.range(0, 2000).selectExpr("id AS ReviewID", "CAST(id % 3 AS int) AS State", "concat('text ', id) AS Text", "CAST(nullif(202401 + id DIV 400, 202404) AS int) AS Month")
    tables.save_partitioned(df, name, "Month", "ReviewID", buckets=4)
    yield name
    tables.drop_table(spark, name)


def files(spark, name):
    found = {}
    for path in spark.table(name).inputFiles():
        path = path.removeprefix("file://")
        month = re.search(r"Month=(\w+)", path)[1]
        found.setdefault(month, set()).add((path, os.stat(path).st_mtime_ns))
    return found


def changes(spark, rows):
    return spark.createDataFrame(rows, "ReviewID long, State int")


def test_only_touched_partitions_are_written(spark, stored):
    before, old = files(spark, stored), {row.ReviewID: tuple(row) for row in spark.table(stored).collect()}
    new = [(5, 9), (6, 9), (7, 7 % 3), (450, 8), (999_999, 1), (1900, None)]
    assert tables.update_partitions(spark, stored, changes(spark, new), "ReviewID", "State") == [202401, 202402]
    after = files(spark, stored)
    assert {month for month in before if before[month] != after.get(month)} == {"202401", "202402"} and set(before) == set(after)
    assert all(len(found) == 4 for found in after.values())
    for row in spark.table(stored).collect():
        state = {5: 9, 6: 9, 450: 8}.get(row.ReviewID, old[row.ReviewID][1])
        assert tuple(row) == (row.ReviewID, state, *old.pop(row.ReviewID)[2:])
    assert not old


def test_doing_it_again_touches_nothing(spark, stored):
    new = changes(spark, [(1, 9), (1500, 9)])
    # The partition of ids 1200 to 1599 has no name.
    assert tables.update_partitions(spark, stored, new, "ReviewID", "State") == [None, 202401]
    before = files(spark, stored)
    assert tables.update_partitions(spark, stored, new, "ReviewID", "State") == []
    assert tables.update_partitions(spark, stored, new.where("false"), "ReviewID", "State") == []
    assert files(spark, stored) == before
    assert spark.table(stored).where("State = 9").count() == 2 and spark.table(stored).count() == 2000


def test_changes_that_know_their_partition(spark, stored):
    """Then other partitions aren't even looked at."""
    new = spark.createDataFrame([(5, 9, 202401), (1500, 9, None)], "ReviewID long, State int, Month int")
    assert tables.update_partitions(spark, stored, new, "ReviewID", "State") == [None, 202401]
    assert spark.table(stored).where("State = 9").count() == 2


def test_the_table_is_not_shuffled(spark, stored, monkeypatch):
    """Of the two sides only the changes have an Exchange, and the scan reads the touched folders only."""
    plans = []

    def look(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return original(df)

    original = tables.cut_lineage
    monkeypatch.setattr(tables, "cut_lineage", look)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = spark.range(0, 400, 7).select(F.col("id").alias("ReviewID"), F.lit(9).alias("State"))
        assert tables.update_partitions(spark, stored, wide, "ReviewID", "State") == [202401]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    (plan,) = plans
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning") <= 1
    scan = plan[plan.index("FileScan"):]
    assert "Month#" in scan and "202401" in scan[scan.index("PartitionFilters"):]
    table_side = plan[: plan.index("FileScan")].rsplit("Sort ", 1)[-1]
    assert "Exchange" not in table_side
