import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import minhash
from reviewloom.llm.components import components
from reviewloom.llm.shingles import jaccard, shingles


def brute(rows, similarity=0.8):
    sets = [np.unique(shingles(text)) for _, text in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i]) and len(sets[j]) and (rows[i][1] == rows[j][1] or jaccard(sets[i], sets[j]) >= similarity):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (id_, _) in enumerate(rows):
        least[find(i)].append(id_)
    return sorted((repr(id_), repr(min((x for x in least[find(i)] if x is not None), default=None))) for i, (id_, _) in enumerate(rows))


def near_copies(seed, groups, copies, words=120, edits=4):
    """Chains and stars of copies with a few words changed, and texts that share half."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(words)] = word()
            out.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
        out.append(" ".join(base[: words // 2] + [word() for _ in range(words // 2)]))
    rng.shuffle(out)
    return out


def classes(df):
    return sorted((repr(row.doc_id), repr(row.class_id)) for row in minhash.near_dedup(df).collect())


def test_classes(documents):
    rows = list(enumerate(near_copies(1, 12, 9)))
    rows += [(500, None), (501, None), (502, ""), (503, "..."), (504, "one two"), (505, "ONE, two!"), (506, "one two"), (None, rows[0][1]), (None, None), (507, rows[3][1]), (507, rows[3][1])]
    rows += [(600, "word " * 30_000), (601, "word " * 20_000)]
    assert classes(documents(rows, "class_id kept h1 bands rid")) == brute(rows)


def test_a_large_group_in_small_chunks(documents, monkeypatch):
    """Members are compared chunk by chunk; the result doesn't depend on it."""
    monkeypatch.setattr(minhash, "CHUNK", 4)
    monkeypatch.setattr(minhash, "WIDE", 7)
    rows = list(enumerate(near_copies(2, 1, 90, edits=14)))
    assert classes(documents(rows)) == brute(rows)


def test_pairs_left_by_the_first_comparison_are_found(spark, documents):
    """Components that share a bucket without a link are gone through."""
    monkey = near_copies(4, 6, 12, words=60, edits=7)
    rows = list(enumerate(monkey))
    assert classes(documents(rows)) == brute(rows)


def test_kept_rows(documents):
    rows = list(enumerate(near_copies(3, 4, 5))) + [(900, None), (901, ""), (950, "again and again and again"), (950, "again and again and again")]
    df = documents(rows, "kept _n class_id")
    found = minhash.near_dedup(df)
    kept = minhash.kept_rows(df, found)
    assert kept.columns == df.columns
    assert sorted(row.doc_id for row in kept.collect()) == sorted({row.class_id for row in found.collect()})


def test_no_rows(documents):
    assert minhash.near_dedup(documents([])).collect() == []


def test_registers_agree_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        agree = []
        for _ in range(30):
            pool = rng.integers(1, 1 << 62, 400).astype(np.uint64)
            n = int(400 * share / (1 + share) * 2 / 2)
            a, b = np.unique(pool[: 200 + n // 2]), np.unique(pool[200 - n // 2 :])
            found = minhash.signatures([(a, np.ones(len(a))), (b, np.ones(len(b)))])
            agree.append((found[0] == found[1]).mean() - jaccard(a, b))
            bits = minhash.packed(minhash.band_keys(found), found)
            assert abs(minhash.estimates(bits[0], bits[1:])[0] - jaccard(a, b)) < 0.12
        assert abs(np.mean(agree)) < 0.03


def test_signatures_stop_early_and_do_not_depend_on_company():
    sets = [(np.arange(k, dtype=np.uint64) * np.uint64(977), np.ones(k)) for k in (1, 3, 50, 4000)]
    together = minhash.signatures(sets)
    for one, found in zip(sets, together, strict=True):
        assert np.array_equal(minhash.signatures([one])[0], found)
    assert (together[0] == 0).all()  # the only shingle is 0


@pytest.mark.parametrize("edges", [
    [], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(i, (i * 7) % 40) for i in range(40)], [(3, 3), (5, 4), (4, 5)],
])
def test_components(spark, edges):
    parent = {x: x for edge in edges if edge[0] != edge[1] for x in edge}
    for _ in range(len(parent)):
        for a, b in edges:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {row.id: row.component for row in found.collect()} == parent


def test_passages_that_repeat_inside_one_text_only(documents):
    """Texts with nearly the same set of shingles are linked, however often some of them occur."""
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows = []
    for k, times in enumerate([1, 16] * 12 + [64, 256] * 8):
        start, passage = words(140), words(60)
        rows += [(10 * k, f"{start} {passage}"), (10 * k + 1, f"{start}{f' {passage}' * times}"), (10 * k + 2, f"{start} {passage} {words(4)}")]
    found = classes(documents(rows))
    assert found == brute(rows) and all(class_id == f"{int(id_) // 10 * 10}" for id_, class_id in found)


def test_registers_do_not_weigh_repeats():
    rng = random.Random(7)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    start, passage = words(140), words(60)
    texts = [f"{start} {passage}", f"{start}{f' {passage}' * 16}"]
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "h1": [1, 2], "h2": [1, 2], "text": texts})
    short = np.array([list(line) for line in next(minhash._sketch(iter([batch]))).column("signature").to_pylist()], np.uint8)
    want = jaccard(*(np.unique(shingles(text)) for text in texts))
    assert want > 0.95 and abs(minhash.estimates(short[0], short[1:])[0] - want) < 0.05


@pytest.mark.parametrize("outside", [1, 700, 50_000])
def test_rows_of_a_hot_bucket(spark, outside):
    """100,000 texts of two components in one bucket: what is compared stays below a million rows."""
    ids = spark.range(0, 100_000, numPartitions=4)
    shared = ids.selectExpr("7L AS key", "0 AS band", "100000L AS n", "id AS rid")
    reps = ids.selectExpr("id AS rid", "CAST('' AS binary) AS signature")
    reached = ids.selectExpr("id", f"CASE WHEN id < {outside} THEN 0L ELSE {outside}L END AS component")
    rows, total = minhash.cell_rows(shared, reps, reached)
    assert rows.count() == total < 1_000_000
    # Every row outside the largest component meets every row.
    cells = rows.groupBy("i", "j").agg(F.count_if("left").alias("x"), F.count_if(~F.col("left")).alias("y")).collect()
    assert sum(cell.x * cell.y for cell in cells) == outside * 100_000
    assert max(cell.x for cell in cells) < 2 * minhash.CHUNK and max(cell.y for cell in cells) < 2 * minhash.WIDE
    one = reached.withColumn("component", F.lit(0).cast("long"))
    assert minhash.cell_rows(shared, reps, one)[1] == 0
