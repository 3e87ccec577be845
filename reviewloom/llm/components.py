"""Connected components of a table of links, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import forget, keep


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``links (a, b)``; a component is its smallest id.

    In each round every node moves to the neighbour of least random rank, itself included,
    and links between different nodes go on to the next round.  Ranks are drawn anew each round
    from a hash, so long chains shrink by a constant factor a round.  Minima are added up before
    they are shuffled, and adaptive execution splits joins at nodes with many links.
    """
    at_work = keep(
        links.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.a", "e.b").distinct(),
        "links",
    )
    first, moves, round_ = at_work, [], 0
    while not at_work.isEmpty():
        rank = _rank(round_)
        moved = keep(
            at_work.groupBy("a").agg(F.min(F.struct(rank("b").alias("rank"), F.col("b").alias("to"))).alias("best"))
            .select(F.col("a").alias("id"), F.least(F.struct(rank("a").alias("rank"), F.col("a").alias("to")), F.col("best"))["to"].alias("to")),
            "moves",
        )
        moves.append(moved)
        left, right = moved.select(F.col("id").alias("a"), F.col("to").alias("na")), moved.select(F.col("id").alias("b"), F.col("to").alias("nb"))
        after = keep(
            at_work.join(left, "a").join(right, "b").where("na <> nb")
            .select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct(),
            "links",
        )
        if at_work is not first:
            forget(at_work)
        at_work, round_ = after, round_ + 1
    if not moves:
        return first.select(F.col("a").alias("id"), F.col("b").alias("component"))
    label = moves.pop()
    while moves:
        below = moves.pop()
        on = label.select(F.col("id").alias("to"), F.col("to").alias("root"))
        label = keep(below.join(on, "to", "left").select("id", F.coalesce("root", "to").alias("to")), "labels")
    least = keep(label.groupBy("to").agg(F.min("id").alias("component")), "least")
    return keep(label.join(least, "to").select("id", "component"), "components")


def _rank(round_: int):
    def rank(name: str) -> Column:
        return F.xxhash64(F.lit(round_), F.col(name))

    return rank
