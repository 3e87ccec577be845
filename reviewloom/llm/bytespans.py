"""Texts as bytes: rolling hashes, repeated keys, and cutting spans out of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import BROADCAST_ROWS, keep
from reviewloom.llm.shingles import _STEP, mix

# Spans, not rows, that a broadcast of spans may hold in all.
BROADCAST_SPANS = 1_000_000


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a number of their own, their id and the bytes of their text (null: empty), kept."""
    body = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    return keep(docs.select(F.monotonically_increasing_id().alias("rk"), F.col(f"`{id_col}`").alias("id"), body.alias("body")), "texts")


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64)) | np.uint64(1)


@lru_cache(maxsize=4)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    return tuple(
        np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]))
        for base in (_STEP, pow(_STEP, -1, 1 << 64))
    )


class RollingHash:
    """Hashes of any stretch of some bytes, from sums of values times powers."""

    def __init__(self, data: np.ndarray):
        up, self._down = powers(1 << max(16, len(data).bit_length()))
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_values()[data] * up[: len(data)], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes = (ends - starts).astype(np.uint64)
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts] + sizes)

    def every(self, width: int) -> np.ndarray:
        """Hashes of all stretches of one width."""
        return mix((self._sums[width:] - self._sums[:-width]) * self._down[: len(self._sums) - width])


def occurring_twice(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key other rows have, too, and how many have it (``n``).

    Keys are counted in the tasks before they are shuffled.  The counts are kept, so that both
    sides of the join are shuffled for it and adaptive execution splits hot keys.
    """
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(keep(counted, "counted"), key)


def merged(spans: DataFrame) -> DataFrame:
    """Maximal spans of each text: ``rk, spans array<struct<lo, hi>>`` of rows ``rk, lo, hi``.

    The spans of one text are at most as many as it has bytes.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column("spans"):
                flat = value.values
                lo, hi = (np.asarray(flat.field(k)) for k in (0, 1))
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                first = np.concatenate([[True], lo[1:] > hi[:-1]])
                last = np.concatenate([first[1:], [True]])
                out.append([{"lo": a, "hi": b} for a, b in zip(lo[first].tolist(), hi[last].tolist(), strict=True)])
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("rk"), pa.array(out, kind)], names=["rk", "spans"])

    gathered = spans.groupBy("rk").agg(F.collect_list(F.struct(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))).alias("spans"))
    return keep(gathered.mapInArrow(merge, "rk long, spans array<struct<lo: long, hi: long>>"), "spans")


def with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """All texts with their spans, empty for those without; the spans are broadcast if they are few."""
    sizes = spans.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("spans")).head()
    few = sizes["n"] <= BROADCAST_ROWS and sizes["spans"] <= BROADCAST_SPANS
    return texts.join(F.broadcast(spans) if few else spans, "rk", "left")


def cut_spans(texts: DataFrame) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept`` of texts with spans; ``kept`` is what remains."""
    kind = texts.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for body, spans in zip(batch.column("body"), batch.column("spans"), strict=True):
                body = body.as_py()
                listed = spans.as_py() or []
                ends = [0, *(span["hi"] for span in listed)]
                starts = [*(span["lo"] for span in listed), len(body)]
                rest = b"".join(body[a:b] for a, b in zip(ends, starts, strict=True)) if listed else body
                lines.append((len(body), len(body) - len(rest), len(listed), rest))
            n_bytes, n_removed, n_spans, kept = zip(*lines, strict=True) if lines else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return texts.select("id", "body", "spans").mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(data: Column) -> Column:
    return F.sha2(data, 256)


def blake(data: bytes) -> tuple[int, int]:
    """128 bits of digest as two signed numbers."""
    value = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(value[:8], "little", signed=True), int.from_bytes(value[8:], "little", signed=True)
