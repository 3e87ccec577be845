"""Substring dedup by content-defined chunks.

A gear hash, in which each byte shifts the hash by one bit and adds a random number of its own,
rolls over the bytes of a text; where its highest bits are zero, a chunk ends.  The hash
knows the last 32 bytes only, so what is inserted into a passage moves the cuts near it and no
others.  Single short chunks are equal by chance, so from every chunk on as many as make up ``min_run``
bytes are taken together, and have one digest of 128 bits.  Of equal runs the first stays: that of the smallest id,
then of the smallest place; the bytes of all others go.  So every byte that goes is part of ``min_run``
bytes or more that stand together elsewhere.  Chunks have 22
bytes on average, so that about one is lost at either end of a passage, and what is left of 51 words is
nearly always a run that goes (the README has the recall).

Defined cases: a null text is empty; what is left of a text after its last whole run belongs to no run of its own; chunks
have at least ``MIN`` bytes (but for a text's last) and at most ``MAX``; texts with equal ids are told apart by row; a null id comes last; an empty
table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.bytespans import blake, cut_spans, merged, numbered, occurring_twice, with_spans
from reviewloom.llm.common import keep
from reviewloom.llm.shingles import mix

MIN, MAX = 8, 1024
# So many highest bits are zero at a cut: one place in 16.
CUT_BITS = 4
# Bytes that have to stand together elsewhere: lines and turns of phrase of fewer are left alone.
MIN_RUN = 96
PIECE = 1 << 22


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    return (mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 20)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash (32 bits) after each byte, for all places at once.

    The hash over 2 w bytes is that over the last w plus the one before, shifted by w bits.
    """
    out = _gear()[data]
    width = 1
    while width < 32:
        out[width:] += out[:-width] << np.uint32(width) if len(out) > width else 0
        width *= 2
    return out


def chunk_ends(body: bytes) -> list[int]:
    """Where the chunks of a text end."""
    data = np.frombuffer(body, np.uint8)
    places = []
    for start in range(0, len(data), PIECE):
        before = max(0, start - 31)
        hashes = gear_hashes(data[before : start + PIECE])[start - before :]
        places.append(np.flatnonzero(hashes >> np.uint32(32 - CUT_BITS) == 0) + start + 1)
    ends, last = [], 0
    for place in np.concatenate(places).tolist() if places else ():
        if place - last < MIN:
            continue
        while place - last > MAX:
            last += MAX
            ends.append(last)
        if place - last >= MIN:
            ends.append(place)
            last = place
    while len(data) - last > MAX:
        last += MAX
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


def runs(ends: list[int], min_run: int) -> Iterator[tuple[int, int]]:
    """From each chunk on, the fewest chunks that have ``min_run`` bytes; none where too few bytes are left."""
    last = 0
    for lo in [0, *ends[:-1]]:
        while last < len(ends) and ends[last] - lo < min_run:
            last += 1
        if last == len(ends):
            return
        yield lo, ends[last]


def chunk_runs(texts: DataFrame, min_run: int) -> DataFrame:
    """``rk, id, lo, hi, d1, d2`` of the run that each chunk begins."""
    kind = texts.schema["id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, lows, highs, first, second = [], [], [], [], []
            for i, value in enumerate(batch.column("body")):
                body = value.as_py()
                for lo, hi in runs(chunk_ends(body), min_run):
                    d1, d2 = blake(body[lo:hi])
                    row.append(i)
                    lows.append(lo)
                    highs.append(hi)
                    first.append(d1)
                    second.append(d2)
                if len(row) > 200_000:
                    yield lines(batch, row, lows, highs, first, second)
                    row, lows, highs, first, second = [], [], [], [], []
            yield lines(batch, row, lows, highs, first, second)

    def lines(batch, row, lows, highs, first, second) -> pa.RecordBatch:
        at = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("rk").take(at), batch.column("id").take(at), pa.array(lows, pa.int32()), pa.array(highs, pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64())],
            names=["rk", "id", "lo", "hi", "d1", "d2"],
        )

    return texts.select("rk", "id", "body").mapInArrow(split, f"rk long, id {kind}, lo int, hi int, d1 long, d2 long")


def repeated_runs(texts: DataFrame, min_run: int) -> DataFrame:
    """``rk, lo, hi`` of every run that is not the first of its digest."""
    again = keep(occurring_twice(chunk_runs(texts, min_run), "d1").drop("n"), "runs")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "rk", "lo")
    first = keep(again.groupBy("d1", "d2").agg(F.min(place).alias("first")).select("d1", "d2", "first.rk", "first.lo"), "first").toDF("d1", "d2", "first_rk", "first_lo")
    same = (F.col("first_rk") == F.col("rk")) & (F.col("first_lo") == F.col("lo"))
    return again.join(first, ["d1", "d2"]).where(~same).select("rk", "lo", "hi")


def chunk_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, and the bytes that remain (kept)."""
    texts = numbered(docs, id_col, text_col)
    spans = merged(repeated_runs(texts, min_run))
    return cut_spans(with_spans(texts, spans)).withColumnRenamed("id", id_col)
