"""Mixing sources to target weights by entropy balancing.

Every source gets a share of all words; within a source, documents get rates that differ least
from one copy each (in relative entropy) and meet the source's word count.  The convex dual
of that problem has one multiplier a source, and the rates are ``exp(multiplier * size)``, held
to at most ``cap`` copies.  Newton's method solves the dual: each iteration adds up, over all
documents, the words that the present rates take and their derivative.  Documents of one
source and size have one rate, so the sums run over counted (source, size) cells: exact,
and as narrow as there are different sizes.

Rates become copies in two steps.  Cell by cell, from long documents to short ones, the copies
of a cell are rounded and what is left over is carried on, so a source ends within half of its
shortest document of its target, unless its last cells stop at the cap or at no copy.  Within a
cell, the documents of the lowest hashes take one more copy, exactly as many as the cell is to give: counts
of a hash's leading bits tell where to stop, a few bits at a time, so a cell with a third of
all rows is never sorted or gathered.  Rows of one hash are written and told apart by row number.

Bounds: the driver holds one line a source.  The cells of one source are as many as it has
different sizes, at most the square root of twice its words.

Defined cases: a null text has size 0; a null source is a source of its own, the last one;
documents without words keep one copy and take no words; of equal rows, some may take one copy
more than others; an empty table gives an empty result; other columns,
whatever their names, are carried in ``row``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from reviewloom.llm.common import forget, keep, small, whole_row

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
# Bits of a key of 63 that each step of a selection counts by.
STEPS = (8, 16, 16, 23)
ROUNDS = 200


def size_of(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share_targets(sizes: dict[str | None, int], weights: Sequence[float], cap: float) -> dict[str | None, float]:
    """Words of each source: shares by weight, at most ``cap`` times its size, the rest shared anew.

    Sources are in the order of code points, null last; weights repeat.
    """
    order = sorted(sizes, key=lambda name: (name is None, name or ""))
    weight = {name: float(weights[i % len(weights)]) for i, name in enumerate(order)}
    targets: dict[str | None, float] = {}
    rest, free = float(sum(sizes.values())), list(order)
    while free:
        total = sum(weight[name] for name in free)
        shares = {name: rest * weight[name] / total for name in free}
        over = [name for name in free if shares[name] > cap * sizes[name]]
        if not over:
            return targets | shares
        for name in over:
            targets[name] = float(cap * sizes[name])
            rest -= targets[name]
        free = [name for name in free if name not in targets]
        rest = max(rest, 0.0)
    return targets


class _Dual:
    """One source's multiplier, kept between two bounds that enclose the solution."""

    def __init__(self, words: int, least: int, largest: int, target: float, cap: float):
        self.target, self.scale = target, float(max(largest, 1))
        self.full = words > 0 and target >= cap * words * (1 - 1e-12)
        self.done = words == 0 or self.full or target <= 0
        # At the upper bound every document is at the cap; at the lower one next to nothing is taken.
        step = self.scale / max(least, 1)
        self.low = -(math.log(max(words / target, 1.0)) + 1.0) * step if target > 0 else -1e18
        self.high = math.log(cap) * step
        self.value = self.high if self.full else self.low if target <= 0 else 0.0
        self.value = 0.0 if words == 0 else self.value

    def step(self, taken: float, slope: float) -> None:
        gap = taken - self.target
        if gap > 0:
            self.high = self.value
        else:
            self.low = self.value
        newton = self.value - gap / slope if slope > 0 else math.inf
        inside = self.low < newton < self.high
        new = newton if inside else (self.low + self.high) / 2
        settled = abs(gap) <= 1e-10 * self.target or abs(new - self.value) <= 1e-14 * max(1.0, abs(new))
        if settled:
            self.done = True
        else:
            self.value = new


def solve_rates(cells: DataFrame, targets: dict[str | None, float], totals: dict, cap: float) -> dict:
    """Newton's method on all sources' duals at once; returns multipliers of size / largest size."""
    spark = cells.sparkSession
    duals = {
        name: _Dual(total["words"], total["least"] or 0, total["largest"] or 0, targets[name], cap)
        for name, total in totals.items()
    }
    for _ in range(ROUNDS):
        at_work = [(name, dual.value, dual.scale) for name, dual in duals.items() if not dual.done]
        if not at_work:
            break
        now = spark.createDataFrame(at_work, T.StructType([
            T.StructField("now_source", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("scale", T.DoubleType()),
        ]))
        x = F.col("size") / F.col("scale")
        power = F.col("value") * x
        rate = F.when(power >= math.log(cap), F.lit(cap)).otherwise(F.exp(power))
        words = F.col("n") * F.col("size")
        sums = (
            cells.where("size > 0")
            .join(F.broadcast(now), F.col("source").eqNullSafe(F.col("now_source")))  # a line a source
            .groupBy("source")
            .agg(
                F.sum(words * rate).alias("taken"),
                F.sum(F.when(power < math.log(cap), words * x * rate).otherwise(0.0)).alias("slope"),
            )
        )
        for line in sums.collect():  # a line a source
            duals[line["source"]].step(line["taken"], line["slope"])
    return {name: (float(f"{dual.value:.11g}"), dual.scale) for name, dual in duals.items()}


def round_cells(cells: DataFrame, cap: float) -> DataFrame:
    """Whole copies of each cell, what rounding leaves carried from long documents to short ones."""

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False, ignore_index=True)
        rest, copies = 0.0, []
        for size, n, rate in zip(pdf["size"], pdf["n"], pdf["rate"], strict=True):
            want = rest + n * size * rate
            taken = min(max(math.floor(want / size + 0.5), 0), int(cap) * n)
            rest = want - taken * size
            copies.append(taken)
        return pdf[["source", "size", "n"]].assign(copies=copies)

    schema = T.StructType([
        T.StructField("source", T.StringType()), T.StructField("size", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("copies", T.LongType()),
    ])
    return cells.groupBy("source").applyInPandas(carry, schema)


def lowest(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``source, size, edge, rest``: a cell's ``need`` rows of lowest key are those below ``edge`` and
    ``rest`` of those at it.

    ``rows`` are kept and narrow (source, size, key); a cell has more rows than it needs.
    """
    shift, closed = sum(STEPS), []
    at_work = wanted.select(F.col("source").alias("of"), F.col("size").alias("at"), "need", F.lit(0).cast("long").alias("prefix"))
    for width in STEPS:
        at_work = keep(at_work, "selecting")
        if at_work.isEmpty():
            break
        inside = F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("at")) & (F.shiftright("key", shift) == F.col("prefix"))
        if shift == sum(STEPS):
            inside = F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("at"))
        shift -= width
        counted = rows.join(small(at_work), inside).groupBy("of", "at", F.shiftright("key", shift).alias("prefix")).agg(
            F.max("need").alias("need"), F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")
        )
        upto = F.sum("n").over(Window.partitionBy("of", "at").orderBy("prefix"))
        edge = keep(
            counted.withColumn("below", upto - F.col("n")).where("below <= need AND need < below + n")
            .select("of", "at", (F.col("need") - F.col("below")).alias("need"), "prefix", "low", "high"),
            "edges",
        )
        done = (F.col("need") == 0) | (F.col("low") == F.col("high"))
        closed.append(edge.where(done).select(F.col("of").alias("source"), F.col("at").alias("size"), F.col("low").alias("edge"), F.col("need").alias("rest")))
        at_work = edge.where(~done).select("of", "at", "need", "prefix")
    out = closed[0] if closed else wanted.select("source", "size", F.lit(0).cast("long").alias("edge"), F.lit(0).cast("long").alias("rest")).limit(0)
    for part in closed[1:]:
        out = out.unionByName(part)
    return keep(out, "lowest")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    cap: int = 3,
) -> DataFrame:
    """Every row with its size, its source's size and target, and its number of copies."""
    spark = docs.sparkSession
    rows = docs.select(
        whole_row(docs),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        size_of(F.col(f"`{text_col}`")).alias("size"),
        F.shiftrightunsigned(F.xxhash64(f"`{id_col}`", f"`{text_col}`"), 1).alias("key"),
    )
    keys = keep(rows.select("source", "size", "key"), "keys")
    cells = keep(keys.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    with_words = F.when(F.col("size") > 0, F.col("size"))
    totals = {
        line["source"]: line
        for line in cells.groupBy("source").agg(
            F.sum(F.col("n") * F.col("size")).alias("words"), F.min(with_words).alias("least"), F.max("size").alias("largest")
        ).collect()  # a line a source
    }
    targets = share_targets({name: line["words"] for name, line in totals.items()}, weights, cap)
    solved = solve_rates(cells, targets, totals, float(cap))
    lines = [(name, totals[name]["words"], targets[name], *solved[name]) for name in totals]
    of_source = keep(spark.createDataFrame(lines, T.StructType([
        T.StructField("of", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()),
        T.StructField("value", T.DoubleType()), T.StructField("scale", T.DoubleType()),
    ])).coalesce(1), "sources")
    rate = F.least(F.lit(float(cap)), F.exp(F.col("value") * F.col("size") / F.col("scale")))
    rated = cells.where("size > 0").join(F.broadcast(of_source), F.col("source").eqNullSafe(F.col("of")))
    copies = keep(round_cells(rated.select("source", "size", "n", rate.alias("rate")), cap), "copies")

    whole = F.expr("copies div n")
    wanted = keep(copies.select("source", "size", whole.alias("whole"), (F.col("copies") - whole * F.col("n")).alias("need")), "wanted")
    cell = [F.col("w.source").eqNullSafe(F.col("l.source")), F.col("w.size") == F.col("l.size")]
    decided = keep(
        wanted.alias("w").join(lowest(keys, wanted.drop("whole")).alias("l"), cell)
        .select(F.col("w.source").alias("cell_source"), F.col("w.size").alias("cell_size"), "whole", "edge", "rest"),
        "decided",
    )
    for done in (keys, cells, copies, wanted):
        forget(done)
    joined = (
        rows.join(small(decided), F.col("source").eqNullSafe(F.col("cell_source")) & (F.col("size") == F.col("cell_size")), "left")
        .join(F.broadcast(of_source), F.col("source").eqNullSafe(F.col("of")), "left")
    )

    def taken(listed: DataFrame, more: Column) -> DataFrame:
        number = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("whole") + F.when(more, 1).otherwise(0))
        return listed.select("row", "size", "source_size", "target", number.cast("int").alias("copies"))

    open_cells = decided.where("rest > 0").select(F.col("cell_source").alias("source"), F.col("cell_size").alias("size"), F.col("rest").alias("need"))
    if open_cells.isEmpty():
        return taken(joined, F.col("key") < F.col("edge"))
    # Rows of one hash, some of which take one copy more: numbered as they are written.
    tie = F.coalesce((F.col("key") == F.col("edge")) & (F.col("rest") > 0), F.lit(False))
    tied = keep(joined.where(tie).select("row", "source", "size", "source_size", "target", "whole", F.monotonically_increasing_id().alias("number")), "tied")
    tied = tied.withColumn("key", F.shiftrightunsigned(F.xxhash64("number"), 1))
    edges = lowest(tied.select("source", "size", "key"), open_cells).select(F.col("source").alias("edge_source"), F.col("size").alias("edge_size"), "edge")
    edged = tied.join(small(edges), F.col("source").eqNullSafe(F.col("edge_source")) & (F.col("size") == F.col("edge_size")))
    return taken(joined.where(~tie), F.col("key") < F.col("edge")).unionByName(taken(edged, F.col("key") < F.col("edge")))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as it has copies, with the input's columns."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
