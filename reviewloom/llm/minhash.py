"""Near-dedup with ProbMinHash signatures, banding and verification.

Every shingle of a text starts a Poisson process whose rate is its weight; each arrival falls on a
random register, and a register keeps the shingle that arrives first.  A shingle stops as soon as its
next arrival is later than every register's.  Registers of two texts agree with the chance that is their
probability Jaccard similarity.  All shingles weigh 1, however often they occur, so that this is the
Jaccard similarity of their sets, by which links are decided.

Texts that agree on all registers of a band share a bucket.  Nothing lists the pairs of a bucket:

1. Equal texts are collapsed.  Each text is compared with one other, the first of the buckets
   they share most often.  Verified pairs are links; links make components.
2. Buckets that still hold several components are gone through in chunks, chunk against
   chunk, each pair in the first bucket it shares.  Pairs of different components whose
   signatures agree well enough are compared: first a few for each two components, then all
   that are left, with components worked out anew in between.  After that no bucket has a pair of
   different components that agrees so well and was not compared.

So every pair that shares a bucket is in one component, has been compared, or agrees on so few of
480 registers that it is no link.  Two texts of similarity 0.8 miss all 24 bands of 5 with a chance
of 0.00007, and agree on too few registers with one of 0.00002.  Comparing is exact: Jaccard
similarity of the sets of five-word shingles (64-bit hashes) of the whole texts.

Defined cases: a null text, or one without words, is in a class of its own; a text of fewer than
five words has one shingle; equal texts with words are always in one class; a null id never names a
class unless all ids of the class are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import keep, small, tasks, whole_row
from reviewloom.llm.components import components
from reviewloom.llm.shingles import jaccard, mix, shingles

BANDS, ROWS = 24, 5
# The first registers make the bands; all of them, four bits each, tell how similar two texts are.
REGISTERS = 480
SIMILARITY = 0.8
# Estimate from which on two texts are compared: four standard deviations below 0.8.
AGREE = 0.72
# Rows outside a bucket's largest component that one cell compares with rows of any; rows of a task, about.
CHUNK, WIDE = 8192, 32_768
TASK_ROWS = 50_000
# Comparisons for each two components of a chunk, round by round; last, all.
TRIES = (4, None)
PORTION = 400_000


# ---- signatures ------------------------------------------------------------------

def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The shingle that each register keeps, a line for each set of (shingles, weights)."""
    sizes = np.array([len(found) for found, _ in sets])
    kept = np.zeros(len(sets) * REGISTERS, np.uint64)
    if not sizes.sum():
        return kept.reshape(-1, REGISTERS)
    shingle = np.concatenate([found for found, _ in sets])
    weight = np.concatenate([weights for _, weights in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    arrival = np.zeros(len(shingle))
    earliest = np.full(len(kept), np.inf)
    last = np.full(len(sets), np.inf)
    at_work, number = np.arange(len(shingle)), 0
    while len(at_work):
        # Several arrivals at a time once few shingles are left; those beyond the stop change nothing.
        steps = min(64, max(1, 50_000 // len(at_work))) if number else 1
        numbers = np.array([(number + k) * 0xD1342543DE82EF95 % (1 << 64) for k in range(steps)], np.uint64)
        draw = mix(shingle[at_work][:, None] + numbers)
        gaps = -np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / weight[at_work][:, None]
        gaps[:, 0] += arrival[at_work]
        now = np.add.accumulate(gaps, axis=1)
        arrival[at_work] = now[:, -1]
        register = (owner[at_work] * REGISTERS)[:, None] + (mix(draw) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(earliest, register.ravel(), now.ravel())
        first = now == earliest[register]
        kept[register[first]] = np.broadcast_to(shingle[at_work][:, None], first.shape)[first]
        busy = np.unique(owner[at_work]) if number else np.flatnonzero(sizes)
        last[busy] = earliest.reshape(-1, REGISTERS)[busy].max(axis=1)
        at_work = at_work[now[:, -1] < last[owner[at_work]]]
        number += steps
    return kept.reshape(-1, REGISTERS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A key for each band of each signature."""
    keys = np.repeat(mix(np.arange(BANDS))[None, :], len(signature), axis=0)
    for row in range(ROWS):
        keys = mix(keys ^ signature[:, row : BANDS * ROWS : ROWS])
    return keys.view(np.int64)


def packed(keys: np.ndarray, signature: np.ndarray) -> np.ndarray:
    """Of each signature, 32 bits of each band's key and four bits of each register, as bytes."""
    short = keys.astype(np.uint64).astype(np.uint32).view(np.uint8).reshape(len(keys), -1)
    bits = (mix(signature) & np.uint64(15)).astype(np.uint8)
    return np.hstack([short, bits[:, 0::2] << np.uint8(4) | bits[:, 1::2]])


KEY_BYTES = 4 * BANDS
# How many of two registers agree, by the exclusive or of their byte.
_AGREEING = np.array([(byte & 15 == 0) + (byte >> 4 == 0) for byte in range(256)], np.uint8)


def estimates(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarity of a text to others, from their packed registers; one in 16 agree by chance."""
    agree = _AGREEING[one[KEY_BYTES:] ^ others[:, KEY_BYTES:]].sum(axis=1, dtype=np.int64) / REGISTERS
    return (agree - 1 / 16) / (15 / 16)


def text_keys(text: Column) -> list[Column]:
    """128 bits of hash that stand for a text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2")]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bands and signature of each text, empty for texts without words."""

    def flush(batch: pa.RecordBatch, sets: list) -> pa.RecordBatch:
        found = signatures(sets)
        used = np.array([len(s) > 0 for s, _ in sets], bool)
        keys = band_keys(found)
        short = packed(keys, found)

        def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
            ends = np.cumsum(np.concatenate([[0], used * values.shape[1]]))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[used].ravel(), kind))

        names = ["id", "h1", "h2"]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(name) for name in names), lists(keys, pa.int64()), pa.array([line.tobytes() for line in short], pa.binary())], names=[*names, "bands", "signature"]
        )

    for batch in batches:
        sets, size, start = [], 0, 0
        for value in batch.column("text"):
            found = np.unique(shingles(value.as_py()))
            sets.append((found, np.ones(len(found))))
            size += len(found)
            if size > PORTION:
                yield flush(batch.slice(start, len(sets)), sets)
                start, sets, size = start + len(sets), [], 0
        if sets:
            yield flush(batch.slice(start, len(sets)), sets)


# ---- comparing ---------------------------------------------------------------------

def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Similarity of pairs ``(a, b)`` of ``texts (rid, text)``; ``pairs`` is kept and narrow."""
    left = texts.join(small(pairs), F.col("rid") == F.col("a")).select("a", "b", F.col("text").alias("text_a"))
    both = left.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b")

    def similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for b, first, second in zip(batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
                if b not in known:  # rows of one b mostly follow each other
                    known = {b: np.unique(shingles(second.as_py()))}
                out.append(jaccard(np.unique(shingles(first.as_py())), known[b]))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return keep(both.select("a", "b", "text_a", "text_b").mapInArrow(similarity, "a long, b long, similarity double"), "compared")


def _unlinked(batches: Iterator[pa.RecordBatch], tries: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in runs of rows of one cell.

    A pair counts in the first bucket that its texts share, and once where both are outside the largest component.
    """
    held = None

    def pairs(rows: pa.RecordBatch | pa.Table) -> list[tuple[int, int]]:
        rid, component, left, outside = (np.asarray(rows.column(name)) for name in ("rid", "component", "left", "outside"))
        band = rows.column("band")[0].as_py()
        found = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        keys = np.ascontiguousarray(found[:, :KEY_BYTES]).view(np.uint32)
        right = np.flatnonzero(~left)
        a, b = [], []
        for i in np.flatnonzero(left):
            others = right[(component[right] != component[i]) & (~outside[right] | (rid[right] > rid[i]))]
            others = others[(keys[others] == keys[i]).argmax(axis=1) == band]
            agree = estimates(found[i], found[others])
            near = agree >= AGREE
            a += [(-float(n), int(rid[i]), int(rid[o]), *sorted((int(component[i]), int(component[o])))) for n, o in zip(agree[near], others[near], strict=True)]
        taken: dict[tuple, int] = {}
        for _, x, y, *both in sorted(a):
            key = tuple(both)
            taken[key] = taken.get(key, 0) + 1
            if tries is None or taken[key] <= tries:
                b.append((min(x, y), max(x, y)))
        return b

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        key = np.stack([np.asarray(table.column(name)) for name in ("key", "i", "j")])
        cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [table.num_rows]])
        found = []
        for start, end in zip(cuts[:-2], cuts[1:-1], strict=True):
            found += pairs(table.slice(start, end - start))
        rest = table.slice(cuts[-2])
        held = rest.take(pa.array(range(rest.num_rows)))
        if found:
            yield out(found)
    if held is not None and held.num_rows:
        yield out(pairs(held))


def cell_rows(shared: DataFrame, reps: DataFrame, reached: DataFrame) -> tuple[DataFrame, int]:
    """Rows of all cells, and how many there are: what has to be compared in buckets of several components.

    Rows of a bucket's largest component are compared with those outside it only.  So these, in chunks
    of ``CHUNK``, meet all rows of the bucket, in chunks of ``WIDE``, each pair of chunks in a cell of its own.
    """
    labelled = shared.select("key", "band", "n", "rid").join(reached.select(F.col("id").alias("rid"), "component"), "rid", "left").withColumn(
        "component", F.coalesce("component", "rid")
    )
    sizes = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = F.max(F.struct("n", (-F.col("component")).alias("minus")))
    several = sizes.groupBy("key").agg(largest.alias("largest"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("components")).where("components > 1")
    parts = lambda n, size: F.ceil(n / size).cast("int")
    cut = several.select(
        "key", (-F.col("largest.minus")).alias("main"),
        parts(F.col("all") - F.col("largest.n"), CHUNK).alias("chunks"), parts(F.col("all"), WIDE).alias("wides"),
        (F.col("all") - F.col("largest.n")).alias("outsiders"), "all",
    )
    cut = keep(cut, "several")
    total = cut.agg(F.coalesce(F.sum(F.col("all") * F.col("chunks") + F.col("outsiders") * F.col("wides")), F.lit(0))).head()[0]
    outside = F.col("component") != F.col("main")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    chunk, wide = F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int"), F.pmod(F.xxhash64(F.lit(1), "rid"), F.col("wides")).cast("int")
    as_right = F.transform(every(F.col("chunks")), lambda i: F.struct(i.alias("i"), wide.alias("j"), F.lit(False).alias("left")))
    as_left = F.transform(every(F.col("wides")), lambda j: F.struct(chunk.alias("i"), j.alias("j"), F.lit(True).alias("left")))
    places = F.when(outside, F.concat(as_left, as_right)).otherwise(as_right)
    rows = (
        labelled.join(cut, "key").join(reps.select("rid", "signature"), "rid")
        .select("key", "band", "rid", "component", outside.alias("outside"), "signature", F.explode(places).alias("at"))
        .select("key", "band", "at.i", "at.j", "at.left", "rid", "component", "outside", "signature")
    )
    return rows, total


def open_pairs(shared: DataFrame, reps: DataFrame, reached: DataFrame, tries: int | None) -> DataFrame:
    """Pairs of different components that share a bucket and agree well enough."""
    rows, total = cell_rows(shared, reps, reached)
    n = max(tasks(shared.sparkSession), -(-total // TASK_ROWS))
    dealt = rows.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "rid", "left")
    return dealt.mapInArrow(lambda batches: _unlinked(batches, tries), "a long, b long").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: id, h1 and h2 of its text, class_id, kept."""
    text = F.col(f"`{text_col}`").cast("string")
    sketch = keep(
        docs.select(F.col(f"`{id_col}`").alias("id"), *text_keys(text), text.alias("text"))
        .mapInArrow(_sketch, f"id {docs.schema[id_col].dataType.simpleString()}, h1 long, h2 long, bands array<long>, signature binary"),
        "sketch",
    )
    reps = keep(
        sketch.where(F.size("bands") > 0).groupBy("h1", "h2")
        .agg(F.min("id").alias("least"), F.first(F.struct("bands", "signature")).alias("s"))
        .select(F.monotonically_increasing_id().alias("rid"), "h1", "h2", "least", "s.bands", "s.signature"),
        "representatives",
    )
    members = reps.select("rid", F.posexplode("bands").alias("band", "key"))
    counted = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("leader")).where("n > 1")
    # Counts are kept before they are joined, here and below, so that hot keys are split.
    shared = keep(members.join(keep(counted, "counted"), "key"), "buckets")

    involved = keep(reps.join(shared.select("rid").distinct(), "rid").select("rid", "h1", "h2"), "involved")
    texts = keep(
        docs.select(*text_keys(text), text.alias("text")).join(small(involved), ["h1", "h2"])
        .groupBy("rid").agg(F.first("text").alias("text")),
        "texts",
    )
    often = shared.where("rid <> leader").groupBy("rid", "leader").agg(F.count(F.lit(1)).alias("n"))
    best = often.groupBy(F.col("rid").alias("a")).agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("b"))
    compared = compare(keep(best, "pairs"), texts)
    links = compared.where(F.col("similarity") >= similarity).select("a", "b")
    reached = components(links)
    for tries in TRIES:
        found = keep(open_pairs(shared, reps, reached, tries), "pairs")
        if found.isEmpty():  # with all tries there would be none, either
            break
        seen = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = keep(found.join(seen, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        new = compare(pairs, texts)
        compared = compared.unionByName(new)
        links = compared.where(F.col("similarity") >= similarity).select("a", "b")
        reached = components(links)
    in_class = reps.select("rid", "h1", "h2", "least").join(reached.select(F.col("id").alias("rid"), "component"), "rid", "left").withColumn(
        "component", F.coalesce("component", "rid")
    )
    named = keep(in_class.groupBy("component").agg(F.min("least").alias("class_id")), "named")
    classes = keep(in_class.join(named, "component").select("h1", "h2", "class_id"), "classes")
    words = F.size("bands") > 0
    own = sketch.select("id", "h1", "h2", words.alias("words"))
    linked = own.where("words").join(classes, ["h1", "h2"]).select("id", "h1", "h2", "class_id")
    alone = own.where(~F.col("words")).select("id", "h1", "h2", F.col("id").alias("class_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("class_id"))).withColumnRenamed("id", id_col)


def kept_rows(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each class.

    Rows that repeat both id and text are one row here.
    """
    stay = keep(
        classes.where("kept").groupBy(F.col(id_col).alias("of"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
        .agg(F.count(F.lit(1)).alias("n")),
        "stay",
    )
    keyed = docs.select(whole_row(docs), F.col(f"`{id_col}`").alias("id"), *text_keys(F.col(f"`{text_col}`")))
    on = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & F.col("id").eqNullSafe(F.col("of"))
    found = keyed.join(small(stay), on)
    once = found.where("n = 1").select("row.*")
    if stay.where("n > 1").isEmpty():
        return once
    return once.unionByName(found.where("n > 1").dropDuplicates(["of", "h1", "h2"]).select("row.*"))
