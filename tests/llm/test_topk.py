import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import topk as K

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, every=20, k=20):
    """Rows of (id, vector) against each other, as the contract tells it."""
    usable = [(id_, [math.floor(64 * float(np.float32(x))) for x in v]) for id_, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, (id_, own) in enumerate(usable):
        if id_ is None or id_ % every:
            continue
        scored = [(-sum(a * b for a, b in zip(own, other, strict=False)), other_id is None, other_id or 0) for j, (other_id, other) in enumerate(usable) if j != i]
        for rank, (score, null, other_id) in enumerate(sorted(scored)[:k], 1):
            out.append((id_, rank, None if null else other_id, -score))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(row) for row in df.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def vectors(spark, rows, parts=3):
    return spark.createDataFrame(rows, VECTORS).selectExpr("*", "vec_id AS id", "label AS terms", "1 AS rk").repartition(parts)




def test_vectors_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) / 3).tolist(), 1) for i in range(300)]
    rows += [(i, rows[20][1], 1) for i in range(300, 340)]  # ties beyond k
    rows += [(40, rows[1][1], 1), (40, rows[40][1], 1), (None, rows[20][1], 1), (None, rows[60][1], 1)]
    rows += [(1000 + 20 * i, v, 1) for i, v in enumerate([None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [None] * 8, [1e6] * 8, [-1e6] * 8, [0.5] * 12])]
    assert found(K.search_vectors(vectors(spark, rows), 20, 20)) == brute(rows)
    assert found(K.search_vectors(vectors(spark, rows, 1), 7, 3)) == brute(rows, 7, 3)


def test_few_rows_and_none(spark):
    rows = [(0, [0.1, 0.2], 1), (20, [0.3, -0.2], 1), (3, [0.5, 0.5], 1)]
    assert found(K.search_vectors(vectors(spark, rows), 20, 20)) == brute(rows)
    assert found(K.search_vectors(vectors(spark, rows[:1]), 20, 20)) == []
    assert found(K.search_vectors(vectors(spark, rows).where("false"), 20, 20)) == []


def test_sparse_rows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        terms = rng.integers(0, 3000, size=rng.integers(0, 30)).tolist()  # some repeat
        rows.append((i, terms, rng.integers(-5, 6, size=len(terms)).tolist()))
    df = spark.createDataFrame(rows, "id long, terms array<int>, weights array<long>").repartition(4)
    dense = np.zeros((400, 3000), np.int64)
    for i, terms, weights in rows:
        np.add.at(dense[i], terms, weights)
    scores = dense @ dense.T
    want = []
    for q in range(0, 400, 10):
        order = [j for j in np.lexsort((np.arange(400), -scores[q])).tolist() if j != q][:7]
        want += [(q, rank, j, int(scores[q, j])) for rank, j in enumerate(order, 1)]
    assert found(K.top_k(df, F.col("id") % 10 == 0, 7)) == sorted(want, key=repr)


def test_blocks_of_many_sizes():
    """The parts of a task by themselves: any cut into blocks gives the same best rows."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    matrix = rng.integers(-3, 4, size=(150, 10))
    matrix[:, 4] = 0
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(150), pa.int64()), pa.array([None if i == 9 else i for i in range(150)], pa.int64()), pa.array([list(range(10))] * 150, pa.list_(pa.int32())), pa.array(matrix.tolist(), pa.list_(pa.int64()))],
        names=["rk", "id", "terms", "weights"],
    )
    results = []
    for size, entries in ((4096, 1 << 20), (7, 1 << 20), (50, 35), (1, 1), (33, 5)):
        old = K.BLOCK, K.BLOCK_ENTRIES
        K.BLOCK, K.BLOCK_ENTRIES = size, entries
        try:
            postings = [b for out in K._blocks(iter([batch, batch.slice(0, 0)]), True) for b in out.column("block").to_pylist()]
            query = [b for out in K._blocks(iter([batch.slice(0, 5)]), False) for b in out.column("block").to_pylist()]
        finally:
            K.BLOCK, K.BLOCK_ENTRIES = old
        assert size == 4096 or len(postings) > 2
        blocks = [*((0, b) for b in query), *((1, b) for b in postings)]
        cells = pa.RecordBatch.from_arrays([pa.array([0] * len(blocks)), pa.array([0] * len(blocks)), pa.array([part for part, _ in blocks]), pa.array([b for _, b in blocks], pa.binary())], names=["group", "slice", "part", "block"])
        results.append([tuple(row.values()) for out in K._cells(iter([cells]), 6) for row in out.to_pylist()])
    assert len(results[0]) == 30 and all(result == results[0] for result in results)


def test_scores_of_many_bits(spark):
    rows = [(0, [3e6, 1.0], 1), (20, [4e7, 1.0], 1), (1, [-2e7, 1.0], 1)]
    big = brute(rows)
    assert found(K.search_vectors(vectors(spark, rows), 20, 20)) == big and max(abs(row[3]) for row in big) > 2**61
    with pytest.raises(Exception, match="64 bits|too large"):
        K.search_vectors(vectors(spark, [(0, [3e16], 1), (1, [3e16], 1)]), 20, 20).collect()
