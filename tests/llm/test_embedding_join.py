import numpy as np

from reviewloom.llm import embedding_join as J

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.98):
    def valid(row):
        id_, vector, label = row
        return id_ is not None and label is not None and vector and all(x is not None and np.isfinite(x) for x in vector) and any(vector)

    out, parent = [], list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = [0] * len(rows)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if valid(a) and valid(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = (np.array(np.array(v, np.float32), np.float64) for v in (a[1], b[1]))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    p, q = find(i), find(j)
                    parent[max(p, q)] = min(p, q)
    for i, (id_, _, _) in enumerate(rows):
        least = min((rows[k][0] for k in range(len(rows)) if find(k) == find(i) and rows[k][0] is not None), default=None)
        out.append((id_, links[i], least, id_ == least))
    return sorted(out, key=repr)


def check(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "vec_id AS id", "label AS place", "'x' AS component").repartition(parts)
    found = J.embedding_links(df).select("vec_id", "n_links", "component_id", "kept")
    assert sorted((tuple(row) for row in found.collect()), key=repr) == brute(rows)


def clusters(seed, groups, size, dim, spread, labels=2):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        centre = rng.normal(size=dim)
        for _ in range(size):
            rows.append((len(rows), (centre + rng.normal(size=dim) * spread).tolist(), int(rng.integers(labels))))
    return rows


def test_links_and_odd_vectors(spark):
    rows = clusters(1, 8, 12, 16, 0.12)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [1.0] * 16, [2.0] * 16, [1.0] * 8, [1e38] * 16, [1e-38] * 16]
    rows += [(1000 + i, vector, 1) for i, vector in enumerate(odd)]
    rows += [(2000, [1.0] * 16, None), (None, [1.0] * 16, 1), (1006, [1.0] * 16, 1), (2001, [-0.0, *[1.0] * 15], 0), (2002, [0.0, *[1.0] * 15], 0)]
    check(spark, rows)


def test_many_blocks_and_intervals(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "LEAF", 2)
    check(spark, clusters(2, 10, 14, 6, 0.1, labels=3), parts=5)


def test_fewer_dimensions_than_axes(spark):
    check(spark, clusters(3, 4, 10, 2, 0.15, labels=1))


def test_no_rows(spark):
    check(spark, [], parts=1)


def test_intervals_agree_with_multiplying_out():
    rng = np.random.default_rng(4)
    data = np.vstack([rng.normal(size=(1, 8)) + rng.normal(size=(40, 8)) * s for s in (0.001, 0.05, 0.3)])
    side = J._Side(data.tobytes(), 8)
    assert np.array_equal(J.link_matrix(side, side, 0.98), side.rows @ side.rows.T >= 0.98)


def test_different_vectors_of_one_id(spark):
    e = [[1.0 if i == j else 0.0 for j in range(4)] for i in range(4)]
    near = [[x + 0.05 * (i == 3) for i, x in enumerate(e[k])] for k in (0, 1)]
    check(spark, [(5, e[0], 1), (5, e[1], 1), (6, near[0], 1), (7, near[1], 1), (5, e[2], 1), (5, e[2], 1), (8, e[0], 1), (2, near[1], 2)])
