"""Exact top-k search by inner product: term-at-a-time accumulation over blocks of postings.

1. Each task packs the rows it reads into blocks of at most ``BLOCK`` rows.  A candidate block is an index of
   postings: for each term the rows that have it, with their weights.  A query block is the sparse rows.
   Blocks are written once, so a repeated task finds the same ones.
2. A cell holds one slice of the candidate blocks and one group of the query blocks.  Candidate blocks
   go to the cells of every query group and query blocks to those of every slice; nothing else
   is copied, and groups and slices are taken from the counted blocks.
3. In a cell the queries are held (at most ``GROUP`` blocks) and candidate blocks pass one by one.  Every
   term of a query scatters its weight times the term's postings into a dense array of scores; all
   candidates are scored.  A partition of the array selects the best ``k``, which are merged with those so far.
4. The ``k`` best of the cells are merged to the ``k`` best of all.

Defined cases: a row is a query or a candidate by its own row number, so rows with a repeated id are candidates of
each other and never of themselves; ties go to the smaller id, a null id comes last; a row without terms scores 0 with
all; terms that repeat in a row add up; a null list takes no part; fewer than ``k`` candidates are all returned; an
empty table gives an empty result.  The absolute products of two rows have to add up to less than 2^63, else the
query raises.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import keep, small, tasks

# Rows of a block: scores of a block stay in a core's cache.
BLOCK = 4096
# Terms and weights of a block at most, unless one row alone has more.
BLOCK_ENTRIES = 1 << 20
# Query blocks that a cell holds, and candidate blocks of a slice.
GROUP = 4
SLICE = 64
# A term of more than this share of a block's rows is kept as a whole column.
DENSE = 0.5

# Of a block: row numbers, ids, terms (or rows), where their lists start, what stands in the lists, weights.
_KINDS = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [np.ascontiguousarray(array, kind).tobytes() for array, kind in zip(arrays, _KINDS, strict=True)]
    return struct.pack("<6q", *map(len, parts)) + b"".join(parts)


def _unpack(data: bytes) -> list[np.ndarray]:
    at, out = 48, []
    for size, kind in zip(struct.unpack("<6q", data[:48]), _KINDS, strict=True):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


class _Buffer:
    """Rows that wait for their block."""

    def __init__(self):
        self.rk, self.ids, self.nulls, self.terms, self.weights, self.sizes = [], [], [], [], [], []
        self.rows = self.entries = 0

    def add(self, rk, ids, nulls, terms, weights, sizes) -> None:
        for held, new in zip((self.rk, self.ids, self.nulls, self.terms, self.weights, self.sizes), (rk, ids, nulls, terms, weights, sizes), strict=True):
            held.append(new)
        self.rows += len(rk)
        self.entries += len(terms)

    def block(self, by_term: bool) -> bytes:
        """The rows as a block: postings by term, or terms by row."""
        rk, ids, nulls, terms, weights, sizes = map(np.concatenate, (self.rk, self.ids, self.nulls, self.terms, self.weights, self.sizes))
        ids = np.concatenate([ids, np.flatnonzero(nulls)])  # where ids are null, behind the ids
        row = np.repeat(np.arange(len(rk)), sizes)
        order = np.lexsort((row, terms) if by_term else (terms, row))
        row, terms, weights = row[order], terms[order], weights[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (terms[1:] != terms[:-1])
        weights = np.add.reduceat(weights, np.flatnonzero(first)) if len(row) else weights
        row, terms = row[first], terms[first]
        held = weights != 0
        row, terms, weights = row[held], terms[held], weights[held]
        major, minor = (terms, row) if by_term else (row, terms)
        if by_term:
            keys, starts = np.unique(major, return_index=True)
        else:
            keys, starts = np.arange(len(rk)), np.searchsorted(major, np.arange(len(rk)))
        if not by_term and len(minor) and not -(2**31) <= minor.min() <= minor.max() < 2**31:
            raise ValueError("terms are 32-bit numbers")
        return _pack(rk, ids, keys, np.append(starts, len(major)), minor, weights)


def _blocks(batches: Iterator[pa.RecordBatch], by_term: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's rows ``rk, id, terms, weights``."""
    buffer = _Buffer()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([buffer.rows], pa.int64()), pa.array([buffer.block(by_term)], pa.binary())], names=["rows", "block"])

    for batch in batches:
        sizes = np.asarray(batch.column("terms").value_lengths().fill_null(0)).astype(np.int64)
        ends = np.cumsum(sizes)
        rk, nulls = np.asarray(batch.column("rk")), np.asarray(batch.column("id").is_null())
        ids = np.asarray(batch.column("id").fill_null(0))
        terms, weights = (np.asarray(batch.column(name).flatten()).astype(np.int64) for name in ("terms", "weights"))
        at = 0
        while at < len(rk):
            done = ends[at - 1] if at else 0
            fits = int(np.searchsorted(ends, done + BLOCK_ENTRIES - buffer.entries, "right"))
            stop = min(len(rk), at + BLOCK - buffer.rows, max(fits, at + (not buffer.rows)))
            if stop > at:
                upto = ends[stop - 1]
                buffer.add(rk[at:stop], ids[at:stop], nulls[at:stop], terms[done:upto], weights[done:upto], sizes[at:stop])
                at = stop
            if at < len(rk):
                yield out()
                buffer = _Buffer()
    if buffer.rows:
        yield out()


class _Postings:
    """A candidate block, ready to be scored against."""

    def __init__(self, data: bytes):
        self.rk, ids, terms, starts, rows, weights = _unpack(data)
        n = len(self.rk)
        self.ids, self.null = ids[:n], np.zeros(n, bool)
        self.null[ids[n:]] = True
        kind = np.int32 if len(weights) and -(2**31) < weights.min() and weights.max() < 2**31 else np.int64
        self.reach: dict[int, int] = {}  # the largest weight of a term, which tells how wide scores have to be
        self.lists: dict[int, tuple[np.ndarray | None, np.ndarray]] = {}
        for term, a, b in zip(terms.tolist(), starts.tolist(), starts[1:].tolist(), strict=False):
            self.reach[term] = max(-int(weights[a:b].min()), int(weights[a:b].max()))
            if b - a > DENSE * n:
                column = np.zeros(n, kind)
                column[rows[a:b]] = weights[a:b]
                self.lists[term] = None, column
            else:
                self.lists[term] = rows[a:b], weights[a:b].astype(kind)

    def scores(self, terms: list[int], weights: list[int]) -> np.ndarray:
        """Scores of one query with all rows, a term at a time."""
        most = sum(abs(weight) * self.reach.get(term, 0) for term, weight in zip(terms, weights, strict=True))
        if most >= 2**63:
            raise OverflowError("scores need more than 64 bits")
        kind = np.int32 if most < 2**31 else np.int64
        total = np.zeros(len(self.rk), kind)
        share = np.empty(len(self.rk), kind)
        for term, weight in zip(terms, weights, strict=True):
            places, column = self.lists.get(term, (None, None))
            if column is None:
                continue
            if places is None:
                np.multiply(column, kind(weight), out=share, casting="same_kind")
                np.add(total, share, out=total)
            else:
                total[places] += column.astype(kind, copy=False) * kind(weight)  # a row stands once in a list
        return total


class _Best:
    """The best so far of one query."""

    def __init__(self, k: int):
        self.k, self.score, self.null, self.ids = k, np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    def offer(self, score: np.ndarray, block: _Postings, own: int | None) -> None:
        n = len(score)
        k = self.k + (own is not None)
        # All that are as good as the k-th, so that ties are left to the ids.
        bar = np.partition(score, n - k)[n - k] if n > k else None
        if len(self.score) == self.k and (bar is None or self.score[-1] > bar):
            bar = self.score[-1]
        some = np.arange(n) if bar is None else np.flatnonzero(score >= bar)
        if own is not None:
            some = some[some != own]
        if not len(some):
            return
        score = np.concatenate([self.score, score[some]])
        null, ids = np.concatenate([self.null, block.null[some]]), np.concatenate([self.ids, block.ids[some]])
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.null, self.ids = score[order], null[order], ids[order]


def _cells(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best of every cell, for blocks sorted by cell, queries first."""
    names = ["query_rk", "query_id", "vec_id", "score"]
    cell, queries = None, []

    def out() -> Iterator[pa.RecordBatch]:
        for at in range(0, len(queries), 1024):
            some = queries[at : at + 1024]
            sizes = [len(best.score) for *_, best in some]
            every = lambda pick, kind: np.concatenate([np.empty(0, kind), *(pick(best) for *_, best in some)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([rk for rk, *_ in some], np.int64), sizes)),
                    pa.array(np.repeat(np.array([id_ for _, id_, *_ in some], np.int64), sizes)),
                    pa.array(every(lambda best: best.ids, np.int64), mask=every(lambda best: best.null, bool)),
                    pa.array(every(lambda best: best.score, np.int64)),
                ],
                names=names,
            )

    for batch in batches:
        for group, slice_, part, data in zip(*(batch.column(name) for name in ("group", "slice", "part", "block")), strict=True):
            if (group, slice_) != cell:
                yield from out()
                cell, queries = (group, slice_), []
            if part.as_py() == 0:
                rk, ids, _, starts, terms, weights = _unpack(data.as_py())
                for i, (a, b) in enumerate(zip(starts.tolist(), starts[1:].tolist(), strict=False)):
                    queries.append((int(rk[i]), int(ids[i]), terms[a:b].tolist(), weights[a:b].tolist(), _Best(k)))
                continue
            block = _Postings(data.as_py())
            place = {rk: i for i, rk in enumerate(block.rk.tolist())}
            for rk, _, terms, weights, best in queries:
                best.offer(block.scores(terms, weights), block, place.get(rk))
    yield from out()


def _dealt(blocks: DataFrame, n: int) -> DataFrame:
    """``blocks`` with ``deal``, 0 to n - 1 in turn.  Only a number for each block meets in one place."""
    numbered = blocks.withColumn("digest", F.xxhash64("block"))
    deal = (F.row_number().over(Window.orderBy("digest")) % n).cast("int")
    return numbered.join(small(keep(numbered.select("digest").withColumn("deal", deal), "deals")), "digest")


def top_k(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each query the ``k`` other rows of largest inner product.

    ``rows`` has ``id`` long, ``terms`` array<int> and ``weights`` array<long>; ``is_query`` is a condition on them
    (null ids are no queries).
    """
    spark = rows.sparkSession
    kept = keep(rows.select(F.monotonically_increasing_id().alias("rk"), "id", "terms", "weights").where("terms IS NOT NULL"), "vectors")
    schema = "rows long, block binary"
    chosen = kept.where(is_query & F.col("id").isNotNull())
    candidates = keep(kept.mapInArrow(lambda batches: _blocks(batches, True), schema), "postings")
    # Few of many rows: dealt anew, so that query blocks are full.
    n_queries = chosen.count()
    dealt = chosen.repartition(max(1, min(tasks(spark), -(-n_queries // BLOCK))))
    queries = keep(dealt.mapInArrow(lambda batches: _blocks(batches, False), schema), "queries")
    groups = max(1, -(-queries.count() // GROUP))
    n_blocks = candidates.count()
    slices = max(1, -(-n_blocks // SLICE), min(n_blocks, -(-tasks(spark) // groups)))
    # Blocks are dealt in turn, by the order of their digests, so that slices and groups are equally full.
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = _dealt(queries, groups).select(F.col("deal").alias("group"), copies(slices).alias("slice"), F.lit(0).alias("part"), "block").unionByName(
        _dealt(candidates, slices).select(copies(groups).alias("group"), F.col("deal").alias("slice"), F.lit(1).alias("part"), "block")
    )
    tasks_ = max(1, min(groups * slices, 4 * tasks(spark)))
    cells = both.repartitionByRange(tasks_, "group", "slice").sortWithinPartitions("group", "slice", "part")
    found = cells.mapInArrow(lambda batches: _cells(batches, k), "query_rk long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_rk").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fixed_point(vector: Column, scale: int = 64) -> tuple[Column, Column]:
    """Terms and weights of a dense vector: places from 0, and ``floor(scale * x)`` where that isn't 0.

    Null for a vector that is null or holds null or non-finite components.  A component beyond 64 bits raises.
    """
    wide = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    usable = vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    limit = float(2**62) / scale
    checked = F.when(F.exists(vector, lambda x: F.abs(x.cast("double")) > limit), F.raise_error(F.lit("a component is too large"))).otherwise(wide)
    places = F.sequence(F.lit(0), F.size(vector) - 1).cast("array<int>")
    terms = F.when(usable, F.when(F.size(vector) == 0, F.array().cast("array<int>")).otherwise(places))
    weights = F.when(usable, checked.cast("array<bigint>"))
    return terms, weights


def search_vectors(
    rows: DataFrame, every: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64
) -> DataFrame:
    """``top_k`` of fixed-point vectors; queries are the rows whose id ``every`` divides."""
    terms, weights = fixed_point(F.col(f"`{vector_col}`"), scale)
    sparse = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), terms.alias("terms"), weights.alias("weights"))
    return top_k(sparse, F.col("id") % every == 0, k)
