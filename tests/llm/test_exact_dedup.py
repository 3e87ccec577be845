import hashlib
import random

import pyarrow as pa

from reviewloom.llm import exact_dedup as E


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    out = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        kept = [i == best for i in ids]
        while sum(kept) > 1:
            kept[kept.index(True)] = False
        out += [(i, best, len(ids), k, sha) for i, k in zip(ids, kept, strict=True)]
    return sorted(out, key=repr)


def check(df, rows, **options):
    classes, kept = E.exact_dedup(df, **options)
    found = classes.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted((tuple(row) for row in found.collect()), key=repr) == brute(rows)
    assert kept.columns == df.columns
    return kept


def test_classes(documents):
    rng = random.Random(3)
    rows = [(i, rng.choice(["same", None, "", "é", "é", f"own {i}", "x" * 50_000])) for i in range(300)]
    rows += [(7, "same"), (7, "same"), (None, "same"), (None, "only null"), (None, "only null"), (999, "same"), (999, "same")]
    kept = check(documents(rows, "keep_id row entry body address"), rows)
    assert kept.count() == len({text or "" for _, text in rows})
    assert {row.doc_id for row in kept.where("text = 'same'").collect()} == {999}


def test_small_buckets_double_the_directory(documents):
    rows = [(i, f"text number {i % 90} " * 5) for i in range(200)]
    check(documents(rows), rows, bucket_bytes=600, max_depth=10)
    check(documents(rows), rows, bucket_bytes=1, max_depth=2)  # buckets that cannot be split any more


def test_directory_covers_every_slot(spark):
    sizes = spark.range(500).selectExpr("xxhash64(id) AS address", "100L AS n_bytes")
    slots, depth = E.directory(sizes, 2000, 12)
    found = {row.slot: (row.bucket, row.depth) for row in slots.collect()}
    assert max(d for _, d in found.values()) == depth > 2
    assert all(bucket == slot >> (depth - d) for slot, (bucket, d) in found.items())


def test_equal_addresses_are_chained():
    row = pa.struct([("text", pa.string()), ("n", pa.int64())])
    texts = ["a", "b", "a", "c", "b"]
    batch = pa.RecordBatch.from_pydict({
        "bucket": [0] * 5, "address": [5, 5, 5, 5, 6], "entry": [1, 2, 3, 4, 5], "id": [10, 20, 30, 5, 1], "n": [2, 1, 1, 1, 1],
        "row": pa.array([{"text": t, "n": i} for i, t in enumerate(texts)], row),
    })
    schema = pa.schema([("bucket", pa.int64()), ("address", pa.int64()), ("link", pa.int64()), ("entry", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("won", pa.bool_()), ("row", row)])
    # The chain of address 5 goes on over the end of a batch.
    lines = [line for out in E._resolve(iter([batch.slice(0, 2), batch.slice(2)]), "text", schema) for line in out.to_pylist()]
    found = {line["entry"]: (line["address"], line["link"], line["keep_id"], line["group_size"], line["won"]) for line in lines}
    assert found == {1: (5, 0, 30, 3, False), 3: (5, 0, 30, 3, True), 2: (5, 1, 20, 1, True), 4: (5, 2, 5, 1, True), 5: (6, 0, 1, 1, True)}
    assert {line["row"]["n"] for line in lines if line["won"]} == {1, 2, 3, 4}


def test_no_rows(documents):
    classes, kept = E.exact_dedup(documents([]))
    assert classes.collect() == [] and kept.collect() == []


def test_text_ids(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "y")], "doc_id string, text string")
    classes, _ = E.exact_dedup(df)
    assert sorted((row.doc_id or "", row.keep_id, row.kept) for row in classes.collect()) == [("", None, True), ("a", "b", False), ("b", "b", True)]


def test_batches_are_worked_on_in_parts(monkeypatch):
    """Texts of entries stay whole and copies meet, however a batch is cut."""
    texts = [None if i % 11 == 0 else f"text {i % 17} " * (i % 5) for i in range(200)]
    rows = pa.StructArray.from_arrays([pa.array(range(200)), pa.array(texts, pa.string()), pa.array([f"s{i}" for i in range(200)])], names=["doc_id", "text", "source"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([0] * 200), pa.array(["x"] * 200), pa.array([3] * 200), rows], names=["id", "address", "sha", "task", "row"])
    names = pa.schema([(name, pa.null()) for name in ("id", "address", "sha", "entry", "is_entry", "n", "n_bytes", "row")])
    for size in (1, 50, 1000, 1 << 20):
        monkeypatch.setattr(E, "SLICE_BYTES", size)
        out = [row for part in E._collapse(iter([batch, batch.slice(0, 0)]), "text", names) for row in part.to_pylist()]
        assert [row["id"] for row in out] == list(range(200)) and len({row["entry"] for row in out if row["is_entry"]}) == sum(row["is_entry"] for row in out)
        owner = {row["entry"]: row["row"]["text"] or "" for row in out if row["is_entry"]}
        assert [owner[row["entry"]] for row in out] == [text or "" for text in texts]
        assert all(row["row"]["source"] == f"s{row['id']}" and (row["is_entry"] or row["row"]["text"] is None) for row in out)
        assert sum(row["n"] for row in out if row["is_entry"]) == 200
        assert size < 1 << 20 or sum(row["is_entry"] for row in out) == len({text or "" for text in texts})
