import math
import random
import re

import pytest
from pyspark.sql import functions as F

from reviewloom.llm import mixing


def test_targets():
    assert mixing.share_targets({"a": 100, "b": 100, "c": 100, None: 100}, (5, 2, 1), 3) == pytest.approx(
        {"a": 400 * 5 / 13, "b": 800 / 13, "c": 400 / 13, None: 2000 / 13}
    )
    # a wants 500 of 800 but stops at 30; what it leaves goes to the others by weight
    found = mixing.share_targets({"a": 10, "b": 390, "c": 400}, (5, 2, 1), 3)
    assert found == pytest.approx({"a": 30, "b": 770 * 2 / 3, "c": 770 / 3})
    chained = mixing.share_targets({"a": 10, "b": 20, "c": 1000}, (5, 2, 1), 3)
    assert chained == pytest.approx({"a": 30, "b": 60, "c": 940})
    assert mixing.share_targets({"a": 0, None: 0}, (5, 2, 1), 3) == {"a": 0, None: 0}
    assert mixing.share_targets({}, (5, 2, 1), 3) == {}


def rows(n=600):
    rng = random.Random(5)
    out = []
    for i in range(n):
        source = rng.choice(["s1", "s1", "s1", "s2", "S", "é", None])
        size = rng.choice([0, 1, 5, 20, 20, 20, 300, rng.randint(1, 900)])
        out.append((i, " \t".join(["w\xa0x"] * size), "en", source))
    return [*out, (3, None, "en", "s2"), (3, None, "en", "s2"), (None, "a b", "en", "s1"), (n, "long " * 9000, "en", "s2"), (n + 1, "", "en", "empty"), (n + 2, "one two", "en", "z")]


def test_mix(documents):
    data = rows()
    df = documents(data, "size target copies source_size")
    found = mixing.mix(df)
    got = found.selectExpr("row.doc_id", "row.text", "row.source", "size", "source_size", "target", "copies").collect()
    sizes = {}
    for _, text, _, source in data:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    targets = mixing.share_targets(sizes, (5, 2, 1), 3)
    assert len(got) == len(data)
    taken = {}
    for row in got:
        assert row.size == len(re.findall(r"[^\x20\x09-\x0D]+", row.text or ""))
        assert (row.source_size, row.target) == (sizes[row.source], pytest.approx(targets[row.source]))
        assert 0 <= row.copies <= 3
        taken[row.source] = taken.get(row.source, 0) + row.size * row.copies
    for source, words in taken.items():
        assert abs(words - targets[source]) <= 0.02 * targets[source] + 5, source
    key = lambda row: repr(tuple(row))
    again = mixing.mix(documents(data, "size target copies source_size", parts=5)).selectExpr("row.doc_id", "row.text", "row.source", "size", "source_size", "target", "copies").collect()
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert mixing.repeated(found).count() == sum(row.copies for row in got)
    assert mixing.repeated(found).columns == df.columns


def test_rates_are_tilted_and_meet_the_constraint(spark):
    cells = spark.createDataFrame([("a", size, 10) for size in range(1, 50)], "source string, size long, n long")
    words = 10 * sum(range(1, 50))
    totals = {"a": {"words": words, "least": 1, "largest": 49}}
    for share in (0.05, 0.7, 1.0, 1.9, 2.95, 3.0):
        value, scale = mixing.solve_rates(cells, {"a": share * words}, totals, 3.0)["a"]
        rates = [min(3.0, math.exp(value * size / scale)) for size in range(1, 50)]
        assert sum(10 * size * rate for size, rate in zip(range(1, 50), rates, strict=True)) == pytest.approx(share * words, rel=1e-6)


def test_one_size_only(documents):
    """Equal documents have one rate: some take one copy more than others."""
    data = [(i, "a b c d", "en", f"s{i % 2}") for i in range(1000)]
    found = mixing.mix(documents(data)).selectExpr("row.source", "size * copies AS taken", "target").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for row in found:
        assert row["sum(taken)"] == pytest.approx(row["max(target)"], rel=0.02)


def test_no_rows(documents):
    assert mixing.mix(documents([])).collect() == []
    only = mixing.mix(documents([(1, None), (2, "")])).selectExpr("row.doc_id", "copies", "target").collect()
    assert sorted(map(tuple, only)) == [(1, 1, 0.0), (2, 1, 0.0)]


def test_repeated_rows_meet_the_target(documents, spark):
    """Rows that repeat id and text take one copy more or less each, exactly as many as wanted."""
    data = [(7, "a b c d", "en", "s1")] * 1000 + [(i, "x y z", "en", "s2") for i in range(400)] + [(None, "u v w", "en", None)] * 300
    found = mixing.mix(documents(data)).selectExpr("row.source", "size", "size * copies AS taken", "target").groupBy("source").agg(
        F.sum("taken").alias("taken"), F.max("target").alias("target"), F.min("size").alias("size"), F.count("*").alias("n")
    ).collect()
    assert sorted((row.n for row in found)) == [300, 400, 1000]
    for row in found:
        assert abs(row.taken - row.target) <= row.size / 2, row


def test_lowest(spark):
    rng = random.Random(3)
    keys = {("a", 3): [rng.randrange(1 << 63) for _ in range(900)], (None, 5): [77] * 40 + [rng.randrange(1 << 30) for _ in range(60)], ("b", 1): [1 << 62] * 9}
    rows = spark.createDataFrame([(*cell, key) for cell, listed in keys.items() for key in listed], "source string, size long, key long")
    for share in (0.0, 0.1, 0.5, 0.98):
        needs = {cell: int(share * len(listed)) for cell, listed in keys.items()}
        found = mixing.lowest(rows, spark.createDataFrame([(*cell, n) for cell, n in needs.items()], "source string, size long, need long")).collect()
        assert {(row.source, row.size) for row in found} == set(keys)
        for row in found:
            listed = keys[row.source, row.size]
            assert sum(key < row.edge for key in listed) + row.rest == needs[row.source, row.size]
            assert 0 <= row.rest < max(listed.count(row.edge), 1)
