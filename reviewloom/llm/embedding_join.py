"""Embedding near-dedup by an epsilon grid order join.

Cosine at least c between unit vectors means a distance of at most e = sqrt(2 - 2 c).  Vectors are
turned to the principal axes of all vectors, sorted by label and by their cells of width e
on the leading axes, and cut into blocks of the sequence.  Intervals of the sequence form a
tree; starting from the pairs of roots, pairs of intervals are followed down to blocks, and those whose
boxes lie further apart than e are skipped.  The remaining pairs of blocks are joined in tasks
of their own, again by halving intervals: distant halves are skipped, halves that
are close as a whole are linked as a whole, and only what is left is multiplied out.

Equal vectors of a label are collapsed first and counted, so a third of all rows may be
one vector.  Links are never listed: a task returns counts of links and, for components,
one edge for each vector at most.

Defined cases: null labels or ids, and vectors that are null, empty, all zero or hold null or
non-finite parts, link with nothing; vectors of different length are not compared; a repeated id
is a vector of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import keep, tasks
from reviewloom.llm.components import components

BLOCK = 256
AXES = 6
LEAF = 32
FAN = 8
# Bounds are kept this far from the limit, for rounding.
SLACK = 1e-9


def _valid(vector: Column, label: Column, id_: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(label.isNotNull() & id_.isNotNull() & ~bad & some, F.lit(False))


def units(data: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    rows = np.asarray(data, dtype=np.float64)
    largest = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / np.where(largest > 0, largest, 1)  # no overflow of squares
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors, all axes, the leading ones first.

    Second moments are added up in the tasks and then by place; the driver gets one number
    for each pair of dimensions.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = np.asarray(batch.column("dim"))
            for dim in np.unique(lengths).tolist():
                rows = units(_matrix(batch.column("vector").filter(pa.array(lengths == dim)), dim))
                rows = np.hstack([rows, np.ones((len(rows), 1))])
                total[dim] = total.get(dim, 0) + rows.T @ rows
        for dim, sums in total.items():
            i, j = np.indices(sums.shape)
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * sums.size, pa.int32()), "i": i.ravel(), "j": j.ravel(), "value": sums.ravel()})

    lines = (
        vectors.select("dim", "vector").mapInArrow(moments, "dim int, i long, j long, value double")
        .groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).toPandas()
    )
    axes = {}
    for dim, part in lines.groupby("dim"):
        sums = np.zeros((dim + 1, dim + 1))
        sums[part["i"], part["j"]] = part["value"]
        mean = sums[:dim, dim] / sums[dim, dim]
        _, found = np.linalg.eigh(sums[:dim, :dim] / sums[dim, dim] - np.outer(mean, mean))
        axes[int(dim)] = found[:, ::-1].copy()
    return axes


def order_blocks(vectors: DataFrame, axes: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    """Blocks of the sequence in epsilon grid order, each with its box on the leading axes."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(axes)  # squares of the dimension
    value_type = vectors.schema["vector"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("dim"))
            cells = np.zeros((batch.num_rows, AXES), np.int64)
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                lead = shared.value[dim][:, :AXES]
                cells[at, : lead.shape[1]] = np.floor(units(_matrix(batch.column("vector").take(pa.array(at)), dim)) @ lead / epsilon)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), AXES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=[*batch.schema.names, "cell"])

    placed = keep(vectors.mapInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema) + ", cell array<long>"), "cells")
    order = ["label", "dim", *[F.col("cell")[i] for i in range(AXES)], "id"]
    ordered = placed.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held, key = TaskContext.get().partitionId(), 0, None, None

        def block(part: pa.Table) -> pa.RecordBatch:
            dim = part.column("dim")[0].as_py()
            rows = units(_matrix(part.column("vector").combine_chunks(), dim)) @ shared.value[dim][:, :AXES]
            box = np.full((2, AXES), 0.0)
            box[0, : rows.shape[1]], box[1, : rows.shape[1]] = rows.min(axis=0), rows.max(axis=0)
            listed = lambda name: pa.array([part.column(name).to_pylist()])
            return pa.RecordBatch.from_pydict({
                "task": [task], "number": [number], "label": part.column("label").slice(0, 1).combine_chunks(), "dim": pa.array([dim], pa.int32()),
                "lo": [box[0].tolist()], "hi": [box[1].tolist()],
                "ids": listed("id"), "times": listed("times"), "data": [_matrix(part.column("vector").combine_chunks(), dim).tobytes()],
            })

        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
            start = 0
            for i in range(batch.num_rows):
                size = (held.num_rows if held else 0) + i - start
                if keys[i] != key or size >= BLOCK:
                    if size:
                        own = table.slice(start, i - start)
                        yield block(pa.concat_tables([held, own]) if held else own)
                        number += 1
                    held, start, key = None, i, keys[i]
            rest = table.slice(start)
            held = pa.concat_tables([held, rest]) if held else rest
            held = held.take(pa.array(range(held.num_rows)))  # not the whole batch
        if held is not None and held.num_rows:
            yield block(held)

    label_type = vectors.schema["label"].dataType.simpleString()
    return keep(
        ordered.mapInArrow(cut, f"task long, number long, label {label_type}, dim int, lo array<double>, hi array<double>, ids array<long>, times array<long>, data binary"),
        "blocks",
    )


def near_blocks(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs ``(p, q)`` of places of blocks, p <= q, whose boxes are not provably distant."""
    meta = blocks.select("place", "label", "dim", "lo", "hi")
    last = meta.agg(F.max("place")).head()[0]
    levels = 0
    while last is not None and FAN**levels <= last:
        levels += 1

    def nodes(level: int) -> DataFrame:
        """Intervals of FAN^level places, of one label and length, with their boxes."""
        box = [F.min(F.col("lo")[i]).alias(f"lo{i}") for i in range(AXES)] + [F.max(F.col("hi")[i]).alias(f"hi{i}") for i in range(AXES)]
        at = F.expr(f"place div {FAN**level}").alias("node")
        return meta.groupBy("label", "dim", at).agg(*box).select(
            "label", "dim", "node", F.expr(f"node div {FAN}").alias("above"),
            F.array(*[f"lo{i}" for i in range(AXES)]).alias("lo"), F.array(*[f"hi{i}" for i in range(AXES)]).alias("hi"),
        )

    def side(frame: DataFrame, name: str) -> DataFrame:
        return frame.select("label", "dim", *[F.col(c).alias(f"{name}_{c}") for c in ("node", "above", "lo", "hi")])

    gap = sum(
        F.pow(F.greatest(F.lit(0.0), F.col("p_lo")[i] - F.col("q_hi")[i], F.col("q_lo")[i] - F.col("p_hi")[i]), 2) for i in range(AXES)
    )
    near = gap <= (epsilon + SLACK) ** 2
    pairs = None
    for level in range(levels, -1, -1):
        here = keep(nodes(level), "nodes")
        p, q = side(here, "p"), side(here, "q")
        if pairs is None:  # one root for each label
            pairs = p.join(q, ["label", "dim"]).where((F.col("p_node") <= F.col("q_node")) & near)
        else:
            above = pairs.select("label", "dim", F.col("p_node").alias("p_above"), F.col("q_node").alias("q_above"))
            pairs = above.join(p, ["label", "dim", "p_above"]).join(q, ["label", "dim", "q_above"]).where((F.col("p_node") <= F.col("q_node")) & near)
        pairs = keep(pairs.select("label", "dim", "p_node", "q_node"), "pairs")
    return pairs.select("label", "dim", F.col("p_node").alias("p"), F.col("q_node").alias("q"))


class _Side:
    """A block's unit vectors; intervals of it know their centre and radius."""

    def __init__(self, data: bytes, dim: int):
        self.rows = units(np.frombuffer(data, np.float64).reshape(-1, dim))
        self._balls: dict[tuple[int, int], tuple[np.ndarray, float]] = {}

    def ball(self, span: tuple[int, int]) -> tuple[np.ndarray, float]:
        if span not in self._balls:
            part = self.rows[span[0] : span[1]]
            centre = part.mean(axis=0)
            self._balls[span] = centre, float(np.sqrt(((part - centre) ** 2).sum(axis=1).max()))
        return self._balls[span]


def link_matrix(x: _Side, y: _Side, cosine: float) -> np.ndarray:
    """Which rows of two blocks link: intervals halved until skipped, linked whole or multiplied."""
    out = np.zeros((len(x.rows), len(y.rows)), bool)
    epsilon = float(np.sqrt(2 - 2 * cosine))
    work = [((0, len(x.rows)), (0, len(y.rows)))]
    while work:
        a, b = work.pop()
        (centre, radius), (other, reach) = x.ball(a), y.ball(b)
        apart = float(np.sqrt(((centre - other) ** 2).sum()))
        if apart - radius - reach > epsilon + SLACK:
            continue
        if apart + radius + reach < epsilon - SLACK:
            out[a[0] : a[1], b[0] : b[1]] = True
        elif max(a[1] - a[0], b[1] - b[0]) <= LEAF:
            out[a[0] : a[1], b[0] : b[1]] = x.rows[a[0] : a[1]] @ y.rows[b[0] : b[1]].T >= cosine
        else:
            work += [(s, t) for s in _halves(a) for t in _halves(b)]
    return out


def _halves(span: tuple[int, int]) -> list[tuple[int, int]]:
    low, high = span
    if high - low <= LEAF:
        return [span]
    middle = (low + high) // 2
    return [(low, middle), (middle, high)]


def _forest(found: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every linked vector to the smallest id it reaches within the two blocks."""
    none = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        to_b = np.minimum(b, np.where(found, a[:, None], none).min(axis=0))
        to_a = np.minimum(a, np.where(found, to_b[None, :], none).min(axis=1))
        if (to_a == a).all() and (to_b == b).all():
            break
        a, b = to_a, to_b
    return np.concatenate([left, right]), np.concatenate([a, b])


def join_blocks(pairs: DataFrame, blocks: DataFrame, cosine: float) -> DataFrame:
    """Of each pair of blocks: links of each vector (n), or an edge to another one (to)."""

    def side(name: str) -> DataFrame:
        return blocks.select("label", "dim", *[F.col(c).alias(f"{name}_{c}" if c != "place" else name) for c in ("place", "ids", "times", "data")])

    both = pairs.join(side("p"), ["label", "dim", "p"]).join(side("q"), ["label", "dim", "q"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, same = _Side(row["p_data"], row["dim"]), row["p"] == row["q"]
                y = x if same else _Side(row["q_data"], row["dim"])
                found = link_matrix(x, y, cosine)
                if same:
                    np.fill_diagonal(found, False)
                if not found.any():
                    continue
                left, right = np.array(row["p_ids"]), np.array(row["q_ids"])
                n_left = found @ np.array(row["q_times"])
                ids, n = left[n_left > 0], n_left[n_left > 0]
                if not same:
                    n_right = np.array(row["p_times"]) @ found
                    ids, n = np.concatenate([ids, right[n_right > 0]]), np.concatenate([n, n_right[n_right > 0]])
                start, end = _forest(found, left, right)
                start, end = start[start != end], end[start != end]
                yield pa.RecordBatch.from_pydict({
                    "id": np.concatenate([ids, start]), "n": np.concatenate([n, np.zeros(len(start), np.int64)]),
                    "to": pa.array([None] * len(ids) + end.tolist(), pa.int64()),
                })

    return keep(both.mapInArrow(join, "id long, n long, to long"), "block-links")


def embedding_links(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    epsilon = float(np.sqrt(2 - 2 * cosine))
    vector, label, id_ = (F.col(f"`{name}`") for name in (vector_col, label_col, id_col))
    ok = _valid(vector, label, id_)
    # 128 bits of hash tell vectors of a label apart; zeros of either sign are one.
    plain = F.transform(vector, lambda x: x + F.lit(0.0).cast("float"))
    rows = table.select(
        id_.cast("long").alias("id"), label.alias("label"), ok.alias("ok"), vector.alias("vector"),
        F.xxhash64(F.lit(1), label, plain).alias("h1"), F.xxhash64(F.lit(2), plain, label).alias("h2"),
    )
    reps = keep(
        rows.where("ok").groupBy("label", "h1", "h2")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times"), F.first("vector").alias("vector"))
        .withColumn("dim", F.size("vector")).withColumn("rid", F.monotonically_increasing_id()),
        "vectors",
    )
    # From here on ``rid`` tells vectors apart: different vectors may have one id.
    blocks = order_blocks(reps.select(F.col("rid").alias("id"), "label", "dim", "times", "vector"), principal_axes(reps), epsilon)
    width = (blocks.agg(F.max("number")).head()[0] or 0) + 1
    blocks = blocks.withColumn("place", F.col("task") * width + F.col("number"))
    found = join_blocks(near_blocks(blocks, epsilon), blocks, cosine)
    edges = found.where("to IS NOT NULL").select(F.col("id").alias("a"), F.col("to").alias("b"))
    reached = components(edges).select(F.col("id").alias("rid"), F.col("component").alias("of_rid"))
    linked = found.groupBy(F.col("id").alias("rid")).agg(F.sum("n").alias("n"))
    named = keep(reps.select("rid", "id").join(reached, "rid").groupBy("of_rid").agg(F.min("id").alias("component")), "named")
    classes = (
        reps.select("label", "h1", "h2", "id", "rid", "times")
        .join(linked, "rid", "left").join(reached, "rid", "left").join(named, "of_rid", "left")
        .select(
            F.col("label").alias("of"), F.col("h1").alias("g1"), F.col("h2").alias("g2"),
            (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("component", "id").alias("component"),
        )
    )
    on = (F.col("label") == F.col("of")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & F.col("ok")
    component = F.coalesce("component", "id")
    return rows.drop("vector").join(keep(classes, "classes"), on, "left").select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )
