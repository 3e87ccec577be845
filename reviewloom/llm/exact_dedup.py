"""Exact dedup by an extendible-hash index on shared files.

1. Each task collapses the equal texts of a part of an Arrow batch, bytes compared, to one entry
   with their number and best row.  A text that makes up a third of the corpus thus sends one
   entry for a few megabytes, not one for a row.
2. The directory starts as one bucket.  Every round adds up the bytes of each bucket and
   doubles the directory for those that are overfull; it ends when none is, or at
   ``max_depth`` bits, where a bucket may be larger.
3. Owner tasks take ranges of buckets, sorted by hash address.  Entries of one address form
   a chain of different texts, told apart by their bytes.  An owner holds one chain at a
   time, however large its buckets are, and writes index files to the shared folder.
4. Rows find their class through their entry, so that no join key holds more rows than a part.

Defined cases: a null text counts as empty; the row with the largest id stays, a null id
loses to any other; of rows with equal text and id exactly one stays; an empty table gives
an empty result; other columns, whatever their names, are carried in ``row`` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.llm.common import keep, tasks, whole_row

BUCKET_BYTES = 4 << 20
# Bytes of text that a task compares and passes on at a time, unless one text alone has more.
SLICE_BYTES = 4 << 20
MAX_DEPTH = 18


def _slices(batch: pa.RecordBatch, body: pa.Array) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch in parts of a few megabytes of text, so that little is copied at a time."""
    ends = np.cumsum(np.asarray(pc.binary_length(body)), dtype=np.int64)
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        yield batch.slice(at, stop - at), body.slice(at, stop - at)
        at = stop


def _bodies(row: pa.StructArray, text: str) -> pa.Array:
    """The texts of the rows as bytes, null ones empty."""
    return pc.fill_null(row.field(row.type.get_field_index(text)).cast(pa.binary()), b"")


def _collapse(batches: Iterator[pa.RecordBatch], text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One entry for each different text of a part of a batch, on the row with the largest id."""
    number = 0
    for whole in batches:
        for batch, bodies in _slices(whole, _bodies(whole.column("row"), text)):
            body, ids = bodies.to_pylist(), batch.column("id").to_pylist()
            best: dict[bytes, int] = {}
            count: dict[bytes, int] = {}
            for i, key in enumerate(body):
                j = best.setdefault(key, i)
                if j != i and ids[i] is not None and (ids[j] is None or ids[i] > ids[j]):
                    best[key] = i
                count[key] = count.get(key, 0) + 1
            first = (batch.column("task")[0].as_py() << 40) + (number << 20)
            number += 1
            place = {key: first + j for key, j in best.items()}
            is_entry = pa.array([best[key] == i for i, key in enumerate(body)], pa.bool_())
            row = batch.column("row")
            # Only the texts of entries are copied.
            chosen = pa.array([i if best[key] == i else None for i, key in enumerate(body)], pa.int64())
            parts = [part.take(chosen) if field.name == text else part for field, part in zip(row.type, row.flatten(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("address"),
                    batch.column("sha"),
                    pa.array([place[key] for key in body], pa.int64()),
                    is_entry,
                    pa.array([count[key] for key in body], pa.int64()),
                    pc.binary_length(bodies).cast(pa.int64()),
                    pa.StructArray.from_arrays(parts, fields=[field.with_nullable(True) for field in row.type]),
                ],
                names=schema.names,
            )


def entries(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row with the entry it belongs to; entries carry their whole row, others no text."""
    body = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    # Each text goes to Python once, inside its row.
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.xxhash64(body).alias("address"), F.sha2(body, 256).alias("sha"),
        F.spark_partition_id().cast("long").alias("task"), whole_row(docs),
    )
    schema = T.StructType([
        rows.schema["id"], rows.schema["address"], rows.schema["sha"],
        T.StructField("entry", T.LongType()), T.StructField("is_entry", T.BooleanType()),
        T.StructField("n", T.LongType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("row", T.StructType([
            T.StructField(f.name, f.dataType, True) for f in rows.schema["row"].dataType
        ])),
    ])
    names = pa.schema([(f.name, pa.null()) for f in schema])
    return rows.mapInArrow(lambda batches: _collapse(batches, text_col, names), schema)


def directory(sizes: DataFrame, bucket_bytes: int, max_depth: int) -> tuple[DataFrame, int]:
    """Slots of the directory with their bucket and its depth; and the directory's own depth.

    ``sizes`` has ``address`` and ``n_bytes``.  A bucket of depth d holds the addresses that
    share their d highest bits; 2^depth slots point to the buckets.
    """
    cell = F.shiftrightunsigned("address", 64 - max_depth)
    open_cells = keep(sizes.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("n_bytes")), "cells")
    done = []
    for depth in range(max_depth + 1):
        bucket = F.shiftright("cell", max_depth - depth)
        loads = open_cells.groupBy(bucket.alias("bucket")).agg(F.sum("n_bytes").alias("load"))
        full = (F.col("load") > bucket_bytes) if depth < max_depth else F.lit(False)
        # At most 2^depth loads of two numbers: a few MB at the largest depth.
        round_ = keep(
            open_cells.withColumn("bucket", bucket).join(F.broadcast(loads), "bucket")
            .select("cell", "n_bytes", "bucket", F.lit(depth).alias("depth"), full.alias("full")),
            "directory",
        )
        done.append(round_.where(~F.col("full")))
        open_cells = round_.where("full").select("cell", "n_bytes")
        if open_cells.isEmpty():
            break
    slots = done[0]
    for part in done[1:]:
        slots = slots.unionByName(part)
    slot = F.shiftright("cell", max_depth - depth).alias("slot")
    return keep(slots.select(slot, "bucket", F.col("depth")).distinct(), "directory"), depth


def _resolve(batches: Iterator[pa.RecordBatch], text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Chains of the addresses in turn; a line for each entry, the winner's with its row."""
    open_address, chain = None, {}

    def flush(lines: list[tuple], rows: list) -> None:
        for link, (key, (best, count, winner, row, members, bucket)) in enumerate(sorted(chain.items())):
            for entry in members:
                won = entry == winner
                lines.append((bucket, open_address, link, entry, best, count, won))
                rows.append(row if won else None)

    def out(lines: list[tuple], rows: list, kind: pa.DataType) -> pa.RecordBatch:
        held = [row for row in rows if row is not None]
        every = pa.concat_arrays(held) if held else pa.array([], kind)
        numbers = iter(range(len(held)))
        places = pa.array([None if row is None else next(numbers) for row in rows], pa.int64())
        columns = [pa.array(list(values), field.type) for values, field in zip(zip(*lines), schema, strict=False)]
        return pa.RecordBatch.from_arrays([*columns, every.take(places)], names=schema.names)

    kind = None
    parts = (part for whole in batches for part in _slices(whole, _bodies(whole.column("row"), text)))
    for batch, found in parts:
        lines, rows = [], []
        row = batch.column("row")
        kind = row.type
        bodies = found.to_pylist()
        columns = [batch.column(name).to_pylist() for name in ("bucket", "address", "entry", "id", "n")]
        for i, (bucket, address, entry, id_, n) in enumerate(zip(*columns, strict=True)):
            if address != open_address:
                flush(lines, rows)
                open_address, chain = address, {}
            key = bodies[i]
            if key not in chain:
                chain[key] = [id_, n, entry, row.slice(i, 1), [entry], bucket]
                continue
            known = chain[key]
            known[1] += n
            known[4].append(entry)
            if (id_ is not None and (known[0] is None or id_ > known[0])) or (id_ == known[0] and entry < known[2]):
                known[0], known[2], known[3] = id_, entry, row.slice(i, 1)
        for known in chain.values():  # a slice would keep its whole batch in memory
            known[3] = known[3].take(pa.array([0]))
        if lines:
            yield out(lines, rows, kind)
    lines, rows = [], []
    flush(lines, rows)
    if lines:
        yield out(lines, rows, kind)


def build_index(rows: DataFrame, text_col: str, bucket_bytes: int, max_depth: int) -> DataFrame:
    """The index files: bucket, address, link in its chain, class, and the row that stays."""
    found = rows.where("is_entry")
    slots, depth = directory(found.select("address", "n_bytes"), bucket_bytes, max_depth)
    slot = F.shiftrightunsigned("address", 64 - depth) if depth else F.lit(0).cast("long")
    # The directory has at most 2^max_depth slots of three numbers.
    placed = found.withColumn("slot", slot).join(F.broadcast(slots), "slot")
    start = F.expr(f"shiftleft(bucket, {max_depth} - depth)")  # the first cell of the bucket
    owned = (
        placed.select(start.alias("bucket"), "address", "entry", "id", "n", "row")
        .repartitionByRange(tasks(rows.sparkSession), "bucket")
        .sortWithinPartitions("bucket", "address", "entry")
    )
    schema = T.StructType([
        T.StructField("bucket", T.LongType()), T.StructField("address", T.LongType()),
        T.StructField("link", T.LongType()), T.StructField("entry", T.LongType()),
        T.StructField("keep_id", rows.schema["id"].dataType), T.StructField("group_size", T.LongType()),
        T.StructField("won", T.BooleanType()), T.StructField("row", rows.schema["row"].dataType),
    ])
    arrow = pa.schema([
        ("bucket", pa.int64()), ("address", pa.int64()), ("link", pa.int64()), ("entry", pa.int64()),
        ("keep_id", _arrow_kind(rows.schema["id"].dataType)), ("group_size", pa.int64()),
        ("won", pa.bool_()), ("row", pa.null()),
    ])
    return keep(owned.mapInArrow(lambda batches: _resolve(batches, text_col, arrow), schema), "index")


def _arrow_kind(kind: T.DataType) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(
        kind.simpleString(), pa.int64()
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    max_depth: int = MAX_DEPTH,
) -> tuple[DataFrame, DataFrame]:
    """``(classes, kept)``: the class of every row, and the whole rows that stay.

    ``classes`` has id, keep_id, group_size, kept and text_sha256; ``kept`` the columns of ``docs``.
    """
    rows = keep(entries(docs, id_col, text_col), "entries")
    index = build_index(rows, text_col, bucket_bytes, max_depth)
    classes = (
        rows.select("id", "entry", "is_entry", "sha")
        .join(index.select("entry", "keep_id", "group_size", "won"), "entry")
        .select(
            F.col("id").alias(id_col), "keep_id", "group_size",
            (F.col("is_entry") & F.col("won")).alias("kept"), F.col("sha").alias("text_sha256"),
        )
    )
    return classes, index.where("won").select("row.*")
