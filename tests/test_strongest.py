"""The strongest distinct values of groups, and that tasks keep few rows."""

import random

import pyarrow as pa
import pytest

from reviewloom.operators import strongest as S
from reviewloom.plans import summaries


def brute(rows, k):
    groups = {}
    for a, b, value, strength in rows:
        groups.setdefault((a, b), set()).add((-strength, value))
    return sorted(((a, b, value, -minus, place) for (a, b), held in groups.items() for place, (minus, value) in enumerate(sorted(held)[:k], 1)), key=repr)


def some_rows(seed, n, groups):
    rng = random.Random(seed)
    # Bytes order differs from that of UTF-16 and of lower case.
    values = [f"{rng.choice(['a', 'A', 'é', '￿', '😀', ''])}{rng.randrange(60)}" for _ in range(80)]
    return [(rng.choice([None, *range(groups)]), rng.choice([None, "x", "y"]), v, len(v) * 7 % 4) for v in rng.choices(values, k=n)]


SCHEMA = "a int, b string, value string, strength int"


@pytest.mark.parametrize("waiting, state", [(40_000, 200_000), (100, 150), (1, 1)])
def test_any_size_of_state(waiting, state, monkeypatch):
    monkeypatch.setattr(S, "WAITING_ROWS", waiting)
    monkeypatch.setattr(S, "STATE_ROWS", state)
    rows = some_rows(1, 3000, 4)
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), (pa.int32(), pa.string(), pa.string(), pa.int32()))]
    whole = pa.RecordBatch.from_arrays(columns, names=["a", "b", "value", "strength"])
    parts = [whole.slice(at, 77) for at in range(0, 3000, 77)]
    out = [tuple(row.values()) for batch in S._partial(iter(parts), ["a", "b"], "value", "strength", 5) for row in batch.to_pylist()]
    assert brute(out, 5) == brute(rows, 5)
    if state == 200_000:
        assert sorted(out, key=repr) == sorted((row[:4] for row in brute(rows, 5)), key=repr)
    assert list(S._partial(iter([]), ["a"], "value", "strength", 5)) == []


def test_rows_of_many_tasks(spark, rows):
    data = some_rows(2, 5000, 6)
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    assert rows(S.strongest_distinct(df, ["a", "b"], "value", "strength", 9)) == brute(data, 9)
    assert rows(S.strongest_distinct(df.where("false"), ["a"], "value", "strength", 9)) == []


def test_shuffle_is_bounded_by_groups_and_tasks(spark):
    """A group with many sentences and many copies: what reaches the shuffle is counted."""
    texts = spark.range(0, 60_000, numPartitions=3).selectExpr(
        "id % 2 AS VenueID", "concat('the staff was great in case ', translate(cast(id % 9000 AS string), '0123456789', 'abcdefghij')) AS Text"
    )
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    original = S._partial
    S._partial = lambda batches, *more: count(original(batches, *more))
    try:
        found = summaries.summary_text(texts, ["VenueID"], "Text").collect()
    finally:
        S._partial = original
    assert len(found) == 2 and all(len(row.Summary.split(" ")) <= 50 for row in found)
    assert 2 * 50 <= seen.value <= 2 * 3 * 50
