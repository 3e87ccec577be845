"""Long repeated substrings by run-length compressed Burrows-Wheeler indexes.

Every byte covered by a string of ``length`` bytes that starts anywhere else as well is marked,
exactly, over all texts; nothing of a text is compared with all others.

1. *Dealing.*  Each stretch of ``length`` bytes is named by the least of the hashes of its
   stretches of ``KEY`` bytes (the leftmost on ties).  Following stretches mostly share their name; together they make a
   *part* of a text.  Equal strings have equal names, so two occurrences meet under one
   name, and every stretch of the corpus lies in exactly one part.
2. *Counting.*  Names that occur once go.  Equal parts of a name are collapsed and counted.
   A name with a single part that occurs twice or more repeats as a whole.
3. *Indexing.*  Tasks gather the different parts of some names as one text and build its
   run-length index: suffix array, Burrows-Wheeler transform, its runs, and
   at each end of a run the text position and its neighbour in the suffix order.  Matching
   statistics stream over the text from these samples alone: from one sample to the next,
   the longest match shrinks by one each byte.  Where it reaches ``length``, the stretch repeats.
4. *Hot names.*  A name with more than ``HOT`` different parts (a passage that many documents hold
   between different neighbours) is split: its parts are cut at the same distances from the name's bytes
   into ever shorter ranges of stretches, named by all bytes these have in common, down to single
   stretches, which are equal or not.
5. Marks go back to all occurrences, spans are merged and cut out.

Bounds: a task holds one text's hashes (in pieces of 4 MB) or one index of about ``INDEX_BYTES``.
Parts are told apart by 128 bits of hash (64 of name and 64 of content).

Defined cases: a null text is empty; texts shorter than ``length`` stay whole; strings are judged on
the input, so every occurrence goes, the first one too; rows that repeat each other repeat each
other's strings; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.bytespans import RollingHash, cut_spans, merged, numbered, with_spans
from reviewloom.llm.common import keep, small, tasks
from reviewloom.llm.shingles import mix

LENGTH = 200
KEY = 64
HOT = 256
INDEX_BYTES = 1 << 20
PIECE = 1 << 22
SPLITS = (35, 9, 3, 1)


# ---- parts of texts ---------------------------------------------------------------

def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each stretch of ``width`` values."""
    n = len(values)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = values
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def cut_parts(body: bytes, length: int) -> dict[str, np.ndarray]:
    """Parts of a text: name, content (hash), first stretch, number of stretches, name's distance."""
    out: dict[str, list] = {"name": [], "content": [], "start": [], "n": [], "distance": []}
    data = np.frombuffer(body, np.uint8)
    for begin in range(0, max(len(data) - length + 1, 0), PIECE):
        piece = data[begin : begin + PIECE + length - 1]
        rolling = RollingHash(piece)
        keys = rolling.every(KEY)
        places = np.arange(len(keys), dtype=np.uint64)
        low = np.uint64((1 << 23) - 1)
        least = sliding_least((keys & ~low) | places, length - KEY + 1) & low
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [len(least)]])
        at = least[first].astype(np.int64)
        out["name"].append(keys[at])
        out["content"].append(rolling(first, last - 1 + length))
        out["start"].append(first + begin)
        out["n"].append(last - first)
        out["distance"].append(at - first)
    # Texts without parts have arrays of the same kinds: hashes mixed with signed numbers would become floats.
    kinds = {"name": np.uint64, "content": np.uint64}
    return {name: np.concatenate([np.zeros(0, kinds.get(name, np.int64)), *values]) for name, values in out.items()}


def parts(texts: DataFrame, length: int) -> DataFrame:
    """``name, content, rk, start, n, distance`` of all parts of all texts."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows, size = [], [], 0
            for rk, value in zip(batch.column("rk").to_pylist(), batch.column("body"), strict=True):
                found = cut_parts(value.as_py(), length)
                held.append(found)
                rows.append(np.full(len(found["n"]), rk, np.int64))
                size += len(found["n"])
                if size > 200_000:
                    yield lines(held, rows)
                    held, rows, size = [], [], 0
            if held:
                yield lines(held, rows)

    def lines(held: list, rows: list) -> pa.RecordBatch:
        column = {name: np.concatenate([found[name] for found in held]) for name in held[0]}
        return pa.RecordBatch.from_pydict({
            "name": column["name"].view(np.int64), "content": column["content"].view(np.int64), "rk": np.concatenate(rows),
            "start": column["start"].astype(np.int32), "n_starts": column["n"].astype(np.int16), "distance": column["distance"].astype(np.int16),
        })

    return texts.select("rk", "body").mapInArrow(split, "name long, content long, rk long, start int, n_starts short, distance short")


# ---- the index -----------------------------------------------------------------------

def suffix_order(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffix array by doubling, and the ranks of prefixes by their length, longest last.

    Symbols are 0 to 256.  Ranks have one place more, for what lies beyond the end.
    """
    n, first = len(text), 7
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(first, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(first):
        key = (key << 9) | padded[i : i + n]
    levels, width = [], first
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        rank = np.zeros(n + 1, np.int64)
        rank[order] = np.cumsum(new)
        levels.append((width, rank))
        if new.all():
            return order, levels
        beyond = np.zeros(n, np.int64)
        beyond[: max(n - width, 0)] = rank[width:n] if n > width else 0
        key = rank[:n] * (n + 2) + beyond
        width *= 2


def common_prefix(a: np.ndarray, b: np.ndarray, text: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Length of the longest common prefix of suffixes ``a`` and ``b``, which differ."""
    n = len(text)
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for width, rank in reversed(levels):
        same = (rank[a] == rank[b]) & (a < n) & (b < n)
        # Prefixes cut off by the end have ranks of their own, as the end ranks below all symbols.
        out += width * same
        a, b = np.minimum(a + width * same, n), np.minimum(b + width * same, n)
    padded = np.concatenate([text, [-1]])
    open_ = np.ones(len(a), bool)
    for _ in range(levels[0][0]):
        open_ &= (a < n) & (b < n) & (padded[a] == padded[b])
        out += open_
        a, b = np.minimum(a + open_, n), np.minimum(b + open_, n)
    return out


class RunIndex:
    """Run-length index of a text: runs of its Burrows-Wheeler transform, sampled at their ends."""

    def __init__(self, text: np.ndarray):
        self.n = len(text)
        order, levels = suffix_order(text)
        bwt = text[order - 1]
        parts_ = (bwt[1:] != bwt[:-1]) | (order[1:] == 0) | (order[:-1] == 0)
        heads = np.flatnonzero(np.concatenate([[True], parts_]))
        tails = np.concatenate([heads[1:] - 1, [self.n - 1]])
        self.runs = len(heads)
        # Each sample: a text position, and how long it matches its neighbour beyond the run.
        self._before = self._samples(order, heads, heads - 1, text, levels)
        self._after = self._samples(order, tails, tails + 1, text, levels)

    def _samples(self, order, rows, neighbours, text, levels) -> tuple[np.ndarray, np.ndarray]:
        inside = (neighbours >= 0) & (neighbours < self.n)
        match = np.zeros(len(rows), np.int64)
        match[inside] = common_prefix(order[rows[inside]], order[neighbours[inside]], text, levels)
        place = order[rows]
        sorted_ = np.argsort(place)
        return place[sorted_], match[sorted_]

    def matching_statistics(self) -> np.ndarray:
        """For each text position, the longest match that starts at any other position."""
        out = np.zeros(self.n, np.int64)
        for places, match in (self._before, self._after):
            steps = np.diff(np.concatenate([places, [self.n]]))
            since = np.arange(self.n) - np.repeat(places, steps)
            np.maximum(out, np.repeat(match, steps) - since, out=out)
        return out


def repeated_starts(bodies: list[bytes], counts: list[int], times: list[int], length: int) -> list[np.ndarray]:
    """Which of the stretches of each body repeat, in the bodies or by a body's own number."""
    text = np.concatenate([part for body in bodies for part in (np.frombuffer(body, np.uint8).astype(np.int64) + 1, np.zeros(1, np.int64))])
    statistics = RunIndex(text).matching_statistics()
    begins = np.cumsum([0, *(len(body) + 1 for body in bodies)])
    return [
        np.ones(n, bool) if many > 1 else statistics[begin : begin + n] >= length
        for begin, n, many in zip(begins, counts, times, strict=False)
    ]


def _index(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Marks of parts that come sorted by name: ranges of repeated stretches of each part."""
    bodies, keys, counts, times, size, last = [], [], [], [], 0, None

    def flush() -> pa.RecordBatch:
        lines = {"name": [], "content": [], "lo": [], "hi": []}
        for (name, content), found in zip(keys, repeated_starts(bodies, counts, times, length), strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[False], found, [False]])))
            for lo, hi in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
                for key, value in zip(lines, (name, content, lo, hi), strict=True):
                    lines[key].append(value)
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in lines.items()})

    for batch in batches:
        columns = (batch.column(k).to_pylist() for k in ("name", "content", "body", "n_starts", "times"))
        for name, content, body, n, many in zip(*columns, strict=True):
            if name != last and size >= INDEX_BYTES:
                yield flush()
                bodies, keys, counts, times, size = [], [], [], [], 0
            last = name
            bodies.append(body)
            keys.append((name, content))
            counts.append(n)
            times.append(many)
            size += len(body) + 1
    if bodies:
        yield flush()


# ---- resolving names --------------------------------------------------------------------

def _split(rows: DataFrame, width: int, length: int) -> DataFrame:
    """Parts cut into ranges of ``width`` stretches at fixed distances from the name's bytes."""
    span = length - KEY

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for row in batch.to_pylist():
                body, data = row["body"], np.frombuffer(row["body"], np.uint8)
                rolling = RollingHash(data)
                # Stretch i of the part starts ``phase + i`` after the earliest possible one.
                phase, n = span - row["distance"], row["n_starts"]
                lo = 0
                while lo < n:
                    range_ = (phase + lo) // width
                    hi = min(n, (range_ + 1) * width - phase)
                    # What every stretch of the range holds, wherever the part begins.
                    core = ((range_ + 1) * width - 1 - phase, range_ * width - phase + length)
                    core = (max(core[0], 0), min(core[1], len(data)))
                    name = int(mix(rolling(np.array([core[0]]), np.array([core[1]])) + mix(np.array([row["name"] & (1 << 64) - 1, ], np.uint64)) * np.uint64(31) + np.uint64(range_ * 1000 + width))[0].view(np.int64))
                    content = int(rolling(np.array([lo]), np.array([hi - 1 + length]))[0].view(np.int64))
                    lines.append((name, content ^ (lo + phase), row["name"], row["content"], lo, hi - lo, span - (phase + lo), row["times"], body[lo : hi - 1 + length]))
                    lo = hi
            kinds = [pa.int64()] * 8 + [pa.binary()]
            names = ["name", "content", "of_name", "of_content", "offset", "n_starts", "distance", "times", "body"]
            columns = list(zip(*lines, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "name long, content long, of_name long, of_content long, offset long, n_starts long, distance long, times long, body binary"
    return keep(rows.mapInArrow(cut, schema), "cuts")


def resolve(rows: DataFrame, length: int, splits: tuple[int, ...] = SPLITS, hot: int = HOT) -> DataFrame:
    """``name, content, lo, hi``: ranges of repeated stretches of different parts.

    ``rows`` are kept: name, content, n_starts, distance, times (occurrences) and body of each part.
    """
    sizes = rows.groupBy("name").agg(F.count(F.lit(1)).alias("parts"), F.sum("times").alias("total")).where("total > 1")
    sized = rows.join(keep(sizes, "sizes"), "name")
    plain = (
        sized.where(F.col("parts").between(2, hot)).select("name", "content", "n_starts", "times", "body")
        .repartition(tasks(rows.sparkSession), "name").sortWithinPartitions("name", "content")
        .mapInArrow(lambda batches: _index(batches, length), "name long, content long, lo long, hi long")
    )
    whole = sized.where("parts = 1").select("name", "content", F.lit(0).cast("long").alias("lo"), F.col("n_starts").cast("long").alias("hi"))
    marks = whole.unionByName(plain)
    crowded = sized.where(F.col("parts") > hot)
    if splits and not crowded.isEmpty():
        cuts = _split(crowded.drop("parts", "total"), splits[0], length)
        below = keep(
            cuts.groupBy("name", "content").agg(F.sum("times").alias("times"), *[F.first(c).alias(c) for c in ("n_starts", "distance", "body")]),
            "ranges",
        )
        found = resolve(below, length, splits[1:], hot)
        lifted = cuts.select("name", "content", "of_name", "of_content", "offset").join(found, ["name", "content"]).select(
            F.col("of_name").alias("name"), F.col("of_content").alias("content"), (F.col("lo") + F.col("offset")).alias("lo"), (F.col("hi") + F.col("offset")).alias("hi")
        )
        marks = marks.unionByName(lifted)
    return marks


def different_parts(found: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The different parts of ``found`` with their bytes, cut from the first text that has them."""
    first = found.groupBy("name", "content").agg(
        F.count(F.lit(1)).cast("long").alias("times"), F.min(F.struct("rk", "start", "n_starts", "distance")).alias("at")
    )
    listed = first.select("at.rk", F.struct("name", "content", "times", "at.start", "at.n_starts", "at.distance").alias("part"))
    per_text = keep(listed.groupBy("rk").agg(F.collect_list("part").alias("parts")), "places")
    holders = texts.join(small(keep(per_text.select("rk"), "holders")), "rk", "left_semi")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for body, listed_ in zip(batch.column("body"), batch.column("parts"), strict=True):
                body = body.as_py()
                for part in listed_.as_py():
                    end = part["start"] + part["n_starts"] - 1 + length
                    lines.append((part["name"], part["content"], part["n_starts"], part["distance"], part["times"], body[part["start"] : end]))
                if len(lines) > 20_000:
                    yield rows(lines)
                    lines = []
            yield rows(lines)

    def rows(lines: list) -> pa.RecordBatch:
        columns = list(zip(*lines, strict=True)) or [[]] * 6
        names = ["name", "content", "n_starts", "distance", "times", "body"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "body" else pa.int64()) for c, k in zip(columns, names, strict=True)], names=names)

    return keep(
        holders.join(per_text, "rk").select("body", "parts").mapInArrow(take, "name long, content long, n_starts long, distance long, times long, body binary"),
        "parts",
    )


def repeated_spans(texts: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``rk, lo, hi`` of bytes of ``texts (rk, body)`` that repeated strings cover."""
    every = parts(texts, length)
    # Kept, so that both sides of the join are shuffled for it and hot names are split.
    counted = keep(
        every.groupBy("name").agg(F.count(F.lit(1)).alias("n"), (F.min("content") == F.max("content")).alias("alike")).where("n > 1"),
        "counted",
    )
    mixed = keep(every.join(counted.drop("n"), "name"), "names")
    # Names whose parts are all equal repeat as a whole; the others are indexed.
    end = F.col("start") + F.col("n_starts") - 1 + length
    sure = mixed.where("alike").select("rk", F.col("start").alias("lo"), end.alias("hi"))
    rest = mixed.where("NOT alike")
    marks = keep(resolve(different_parts(rest, texts, length), length, hot=hot), "marks")
    marked = rest.join(marks, ["name", "content"]).select(
        "rk", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") - 1 + length).alias("hi")
    )
    return sure.unionByName(marked)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, and the bytes that remain (kept)."""
    texts = numbered(docs, id_col, text_col)
    spans = merged(repeated_spans(texts, length))
    return cut_spans(with_spans(texts, spans)).withColumnRenamed("id", id_col)
