"""Prefix trie of conversations, by ternary search trees over range shards.

1. Turns get ids from a dictionary of the digests of role and text; equal sequences of ids are collapsed
   and counted, so a conversation that many ids share is one sequence.
2. The distinct sequences are sorted and cut into range shards.  Each shard inserts its sequences into a
   ternary search tree, medians first, so that the tree is balanced.  A traversal without recursion, children before
   parents, adds up members, leaves, children and saved tokens.
3. Nodes that neighbouring shards share are known beforehand (``borders``).  A shard leaves out
   what the shard before it has counted already, so the shares of a node add up; only shared nodes are merged, and
   looked up as parents.
4. The ids that end in a node are hashed as one text, from pieces that are made in sorted ranges; pieces of one
   node pass through one task, one at a time.

Defined cases: rows without a conversation id belong to none and are left out; a null role or text is empty; turns are
ordered by number, null first, equal numbers by the digest of role and text, repeated rows stay repeated; a
conversation without turns is a member of the root; an empty table gives no nodes; texts never leave the
task that reads them.  A conversation's ids, 16 bytes a turn with its words, pass through one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.borders import Border, borders, shared_node
from reviewloom.llm.common import keep, small, tasks

WORD = r"[^\x20\x09-\x0D]+"
EVERY = 20
HEADS = 4
# Turns of the distinct sequences that one task makes a tree of.
SHARD_TURNS = 200_000
PIECE_IDS = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


def encoded_turns(rows: DataFrame) -> DataFrame:
    """``conv, pos, tid, words`` of rows ``conv_id, turn, role, text``; ``tid`` numbers the distinct turns."""
    role, text = (F.coalesce(F.col(name), F.lit("")) for name in ("role", "text"))
    turns = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "digest")
    placed = keep(turns.withColumn("pos", (F.row_number().over(order) - 1).cast("long")), "turns")
    # Kept, so that the numbers stay and both sides of the join are shuffled for it: hot turns are split.
    numbers = keep(placed.select("digest").distinct().withColumn("tid", F.monotonically_increasing_id()), "dictionary")
    return placed.join(numbers, "digest").select("conv", "pos", "tid", "words")


def rebuilt(turns: DataFrame, every: int = EVERY, heads: int = HEADS) -> DataFrame:
    """``conv, part, pos, tid, words``: each conversation behind the first turns of its leader.

    The leader of c is ``c - c % every``; it gives its first h turns, ``h = crc32(c) % heads``, in place of the first h
    of c.  A conversation has one row more, without a turn.
    """
    head = lambda conv: F.crc32(F.col(conv).cast("string").cast("binary")) % heads
    ids = turns.select("conv").distinct()
    leading = turns.where((F.col("conv") % every == 0) & (F.col("pos") < heads - 1)).withColumnRenamed("conv", "leader")
    # A leader has fewer than 2 * every followers, each of which takes fewer than ``heads`` turns.
    taken = (
        ids.withColumn("leader", F.col("conv") - F.col("conv") % every).withColumn("head", head("conv"))
        .join(leading, "leader").where(F.col("pos") < F.col("head"))
        .select("conv", F.lit(0).alias("part"), "pos", "tid", "words")
    )
    own = turns.where(F.col("pos") >= head("conv")).select("conv", F.lit(1).alias("part"), "pos", "tid", "words")
    none = ids.select("conv", F.lit(2).alias("part"), *(F.lit(None).cast("long").alias(name) for name in ("pos", "tid", "words")))
    return taken.unionByName(own).unionByName(none)


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Of sorted ``key, conv``: runs of at most ``size`` ids as text."""
    key, run = None, []

    def out(lines: list) -> pa.RecordBatch:
        keys, firsts, texts = zip(*lines, strict=True) if lines else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(firsts, pa.int64()), pa.array(texts, pa.string())], names=["key", "first", "ids"])

    for batch in batches:
        lines = []
        for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist(), strict=True):
            if run and (k != key or len(run) >= size):
                lines.append((key, run[0], ",".join(map(str, run))))
                run = []
            key = k
            run.append(conv)
        yield out(lines)
    if run:
        yield out([(key, run[0], ",".join(map(str, run)))])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's pieces, which come in order."""
    key, state = None, None
    names = ["key", "ends"]
    for batch in batches:
        keys, digests = [], []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    keys.append(key)
                    digests.append(state.hexdigest())
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=names)


def distinct_sequences(rows: DataFrame) -> DataFrame:
    """``seq, words, n, least, ends``: each distinct sequence, its members and the digest of their ids."""
    turn = F.when(F.col("tid").isNotNull(), F.struct("part", "pos", "tid", "words"))
    gathered = rows.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("turns")).select(
        "conv", F.col("turns.tid").alias("seq"), F.col("turns.words").alias("words")
    )
    members = keep(gathered.withColumn("key", F.sha2(F.array_join(F.col("seq").cast("array<string>"), ","), 256)), "members")
    found = keep(
        members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"), F.any_value("seq").alias("seq"), F.any_value("words").alias("words")),
        "sequences",
    )
    several = keep(found.where("n > 1").select("key"), "several")
    n = tasks(rows.sparkSession)
    ordered = keep(members.select("key", "conv").join(several, "key"), "ends").repartitionByRange(n, "key", "conv").sortWithinPartitions("key", "conv")
    pieces = ordered.mapInArrow(lambda batches: _pieces(batches, PIECE_IDS), "key string, first long, ids string")
    ends = pieces.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key string, ends string")
    alone = F.sha2(F.col("least").cast("string").cast("binary"), 256)
    return found.join(ends, "key", "left").select("seq", "words", "n", "least", F.coalesce("ends", alone).alias("ends"))


class _Tree:
    """A ternary search tree: siblings by ``low`` and ``high``, the first of a node's children by ``down``."""

    def __init__(self):
        # Node 0 is the root, without a turn; 0 in low, high and down stands for none.
        self.tid, self.low, self.high, self.down = [0], [0], [0], [0]
        self.parent, self.depth, self.words, self.end = [-1], [0], [0], [-1]

    def _new(self, tid: int, words: int, parent: int) -> int:
        for column, value in ((self.tid, tid), (self.low, 0), (self.high, 0), (self.down, 0), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.words, words), (self.end, -1)):
            column.append(value)
        return len(self.tid) - 1

    def insert(self, seq: list[int], words: list[int], number: int) -> None:
        node = 0
        for tid, count in zip(seq, words, strict=True):
            links, at = self.down, node
            while child := links[at]:
                if tid == self.tid[child]:
                    break
                links, at = (self.low if tid < self.tid[child] else self.high), child
            else:
                child = links[at] = self._new(tid, count, node)
            node = child
        self.end[node] = number


def _medians(n: int) -> Iterator[int]:
    """0 .. n-1, the middle first, then the middles of both halves, and so on."""
    ranges = [(0, n)]
    while ranges:
        a, b = ranges.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            ranges += [(a, middle), (middle + 1, b)]


_NODES = "conv_id long, parent_conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, shared long, parent_shared long"


def _shard_nodes(shard: list[tuple], border: Border) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard, given its sorted ``(seq, words, n, least, ends)``."""
    tree = _Tree()
    for i in _medians(len(shard)):
        tree.insert(shard[i][0], shard[i][1], i)
    count = len(tree.tid)
    members, least = [0] * count, [None] * count
    children, leaves, saved = [0] * count, [0] * count, [0] * count
    # Numbers of the nodes that other shards have, too; all have the root.
    shared: dict[int, int] = {0: 0}
    entering, leaving = _path(tree, border.before), _path(tree, border.after)
    for path, owners in ((entering, border.before_owners), (leaving, border.after_owners)):
        shared.update((node, shared_node(owner, depth)) for depth, (node, owner) in enumerate(zip(path[1:], owners, strict=True), 1))
    # The last sequence goes on in the next shard.
    goes_on = leaving[-1] if not border.final and len(shard[-1][0]) == len(border.after) else -1
    for node in range(count - 1, -1, -1):  # children come after their parents
        if (number := tree.end[node]) >= 0:
            _, _, n, first, _ = shard[number]
            members[node] += n
            least[node] = first if least[node] is None else min(first, least[node])
        if not children[node] and node != goes_on:
            leaves[node] = 1
        saved[node] += (members[node] - 1) * tree.words[node]
        if node:
            above = tree.parent[node]
            members[above] += members[node]
            least[above] = least[node] if least[above] is None else min(least[node], least[above])
            children[above] += 1
            leaves[above] += leaves[node]
            saved[above] += saved[node]
    # Nodes on the path that the shard before has, too, are counted there.
    twice = 0
    for depth in range(len(entering) - 1, -1, -1) if not border.first else ():
        node = entering[depth]
        twice += tree.words[node]
        saved[node] += twice
        children[node] -= depth + 1 < len(entering)
    for a in range(0, count, 10_000):
        nodes = range(a, min(count, a + 10_000))
        up = [tree.parent[node] for node in nodes]
        ends = [shard[tree.end[node]][4] if tree.end[node] >= 0 else None for node in nodes]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([least[node] for node in nodes], pa.int64()),
                pa.array([None if parent < 0 or parent in shared else least[parent] for parent in up], pa.int64()),
                pa.array([tree.depth[node] for node in nodes], pa.int64()),
                *(pa.array(values[a : a + 10_000], pa.int64()) for values in (members, children, leaves, saved)),
                pa.array(ends, pa.string()),
                pa.array([shared.get(node) for node in nodes], pa.int64()),
                pa.array([shared.get(parent) for parent in up], pa.int64()),
            ],
            names=[field.split()[0] for field in _NODES.split(", ")],
        )


def _path(tree: _Tree, seq: list[int]) -> list[int]:
    """The nodes along a sequence that the tree has, the root first."""
    path = [0]
    for tid in seq:
        child = tree.down[path[-1]]
        while tree.tid[child] != tid:
            child = tree.low[child] if tid < tree.tid[child] else tree.high[child]
        path.append(child)
    return path


def _trees(batches: Iterator[pa.RecordBatch], known: dict[int, Border]) -> Iterator[pa.RecordBatch]:
    at, shard = None, []
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("shard", "seq", "words", "n", "least", "ends")]
        for number, *sequence in zip(*columns, strict=True):
            if number != at:
                if shard:
                    yield from _shard_nodes(shard, known[at])
                at, shard = number, []
            shard.append(tuple(sequence))
    if shard:
        yield from _shard_nodes(shard, known[at])


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie over ``sequences`` as ``distinct_sequences`` returns them."""
    kept = keep(sequences, "distinct")
    turns = kept.agg(F.coalesce(F.sum(F.size("seq") + 1), F.lit(0))).head()[0]
    shards = max(1, -(-turns // shard_turns))
    dealt = keep(kept.repartitionByRange(shards, "seq").withColumn("shard", F.spark_partition_id().cast("long")), "shards")
    ends = dealt.groupBy("shard").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    known = borders(sorted((row["shard"], list(row["first"]), list(row["last"])) for row in ends.collect()))  # two a shard
    parts = keep(
        dealt.repartition(shards, "shard").sortWithinPartitions("shard", "seq").mapInArrow(lambda batches: _trees(batches, known), _NODES),
        "nodes",
    )
    counts = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    # At most the root and, for each shard, as many as its first sequence has turns.
    merged = keep(
        parts.where("shared IS NOT NULL").groupBy("shared").agg(
            F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *(F.sum(name).alias(name) for name in counts),
            F.max("ends_sha256").alias("ends_sha256"), F.max("parent_shared").alias("parent_shared"),
        ),
        "merged",
    )
    both = parts.where("shared IS NULL").drop("shared").unionByName(merged.drop("shared").withColumn("parent_conv_id", F.lit(None).cast("long")))
    above = small(merged.select(F.col("shared").alias("parent_shared"), F.col("conv_id").alias("above")))
    return both.join(above, "parent_shared", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), *counts[:3], "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, every: int = EVERY, heads: int = HEADS) -> DataFrame:
    """The trie of the rebuilt conversations of rows ``conv_id, turn, role, text``."""
    turns = keep(encoded_turns(conversations), "encoded")
    return prefix_trie(distinct_sequences(rebuilt(turns, every, heads)))
