"""Spelling variants: words that differ by one code point, found by pairs of trie nodes.

1. Runs of letters are counted in the tasks that read them, before anything is shuffled.
2. The words, sorted, are cut into range shards; each numbers the nodes of its part of the trie of
   prefixes.  Nodes that neighbouring shards share get their number from ``borders``.  The reversed words
   give the nodes of the trie of suffixes in the same way.
3. A word has a pair (prefix node, suffix node) for each place where one code point is skipped and
   for each gap where one could be inserted.  Two words with the same skipped pair differ in that code
   point only; a word whose gap is another's skipped pair is that other word without it.  A
   code point in a run of equal ones is skipped for its gap at the first of them only, so that every
   pair of near words meets once.
4. Words that share a pair are at most as many as there are different code points.  Of each pair only
   the number of words and the two most frequent ones go on, and a word adds those up over its own pairs:
   no list of near words is made.
5. A word's form is its near word of largest count, if that is at least ``ratio`` times its own.  Counts
   at least double along forms, so following them to the end takes a few rounds.

Defined cases: a null text has no words; a null document id counts as an empty string; counts add up
over repeated rows; ties go to the word that comes first in code-point order; an empty table, or one
without frequent words, gives an empty result; words may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.borders import PLACES, Border, borders, common, shared_node
from reviewloom.llm.common import forget, keep

LETTERS = r"[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH = 5
MIN_COUNT = 3
DROP_EVERY = 97
RATIO = 2
# Words that one task numbers.
SHARD_WORDS = 100_000


def _without(word: Column, place: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = LETTERS,
    min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int | None = DROP_EVERY,
) -> DataFrame:
    """``word, n``: the frequent words of all texts.

    With ``drop_every``, a run whose ``crc32("<id>:<run>")`` it divides loses the code point at that
    number modulo its length, so that the texts hold misspellings.
    """
    lower = F.translate(F.col(f"`{text_col}`"), CAPITALS, SMALL)
    runs = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lower, F.lit(pattern), F.lit(0))).alias("run"),
    )
    word = F.col("run")
    if drop_every:
        crc = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        place = (crc % F.length("run")).cast("int")
        word = F.when(crc % drop_every == 0, _without(word, place)).otherwise(word)
    words = runs.select(word.alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _paths(batches: Iterator[pa.RecordBatch], known: dict[int, Border], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Node numbers along every word, for words sorted by shard and key."""
    at, last, path, used, place, border = None, "", [0], 0, 0, Border()
    for batch in batches:
        nodes, ends, ids, fresh = [], [0], [], []
        for shard, key in zip(batch.column("shard").to_pylist(), batch.column("key").to_pylist(), strict=True):
            if shard != at:
                at, last, path, used, place, border = shard, "", [0], 0, 0, known[shard]
                same, entering = 0, len(border.before)
            else:
                same, entering = common(last, key), 0
            leaving = common(key, border.after)
            del path[same + 1 :]
            for depth in range(same + 1, len(key) + 1):
                if depth <= entering:
                    path.append(shared_node(border.before_owners[depth - 1], depth))
                elif depth <= leaving:
                    path.append(shared_node(border.after_owners[depth - 1], depth))
                else:
                    used += 1
                    path.append((shard << PLACES) + used)
            nodes.extend(path)
            ends.append(len(nodes))
            ids.append((shard << PLACES) + place)
            fresh.extend([True, *map(str.__ne__, key[1:], key), False] if key else [False])
            last, place = key, place + 1
        ends = pa.array(ends, pa.int32())
        columns = {
            "place": pa.array(ids, pa.int64()),
            "nodes": pa.ListArray.from_arrays(ends, pa.array(nodes, pa.int64())),
            "fresh": pa.ListArray.from_arrays(ends, pa.array(fresh, pa.bool_())),
        }
        yield pa.RecordBatch.from_arrays([columns.get(name) if name in columns else batch.column(name) for name in names], names=names)


def trie_paths(rows: DataFrame, key: Column, shard_rows: int) -> DataFrame:
    """``rows`` with ``place`` (in the order of ``key``), ``nodes`` and ``fresh`` of the trie over their keys.

    ``nodes`` has the number of every prefix of the key, the empty one first; ``fresh`` tells where a
    code point differs from the one before it.
    """
    shards = max(1, -(-rows.count() // shard_rows))
    # Kept: the cuts come from samples, and a repeated task must find the same ones.
    dealt = keep(
        rows.withColumn("key", key).repartitionByRange(shards, "key").withColumn("shard", F.spark_partition_id().cast("long")),
        "shards",
    )
    ends = dealt.groupBy("shard").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    known = borders(sorted(tuple(row) for row in ends.collect()))  # two words a shard
    names = [*rows.columns, "place", "nodes", "fresh"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return (
        dealt.repartition(shards, "shard").sortWithinPartitions("shard", "key")
        .mapInArrow(lambda batches: _paths(batches, known, names), f"{kinds}, place long, nodes array<long>, fresh array<boolean>")
    )


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``p, s, skips, fresh, id, n`` for every skipped code point and every gap of every word."""
    for batch in batches:
        prefix, suffix = batch.column("prefix"), batch.column("suffix")
        sizes = np.asarray(prefix.value_lengths()).astype(np.int64)  # one more than the word has code points
        p, s = np.asarray(prefix.flatten()), np.asarray(suffix.flatten())
        fresh = np.asarray(batch.column("fresh").flatten())
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        place, length = np.arange(len(p)) - starts, np.repeat(sizes - 1, sizes)
        of = np.repeat(np.arange(len(sizes)), sizes)
        skipped = place < length
        rest = starts + length - place
        of_both = np.concatenate([of, of[skipped]])
        gaps = len(p)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([p, p[skipped]])),
                pa.array(np.concatenate([s[rest], s[rest[skipped] - 1]])),
                pa.array(np.arange(len(of_both)) >= gaps),
                pa.array(np.concatenate([np.zeros(gaps, bool), fresh[skipped]])),
                batch.column("id").take(pa.array(of_both)),
                batch.column("n").take(pa.array(of_both)),
            ],
            names=["p", "s", "skips", "fresh", "id", "n"],
        )


def _best(n: Column, id_: Column) -> Column:
    """Larger is better: more occurrences, then the smaller id."""
    return F.struct(n.alias("n"), (-id_).alias("minus_id"))


def near_words(words: DataFrame) -> DataFrame:
    """``id, n_near, best`` of words with near words; ``words`` has ``id, n, prefix, suffix, fresh``."""
    rows = words.select("id", "n", "prefix", "suffix", "fresh").mapInArrow(_pairs, "p long, s long, skips boolean, fresh boolean, id long, n long")
    own = _best(F.col("n"), F.col("id"))
    pair = Window.partitionBy("p", "s")
    placed = rows.withColumn("place", F.row_number().over(pair.orderBy(F.desc("skips"), F.desc("n"), "id")))
    skip = F.col("skips")
    met = placed.select(
        "id", "n", "skips", "fresh", "place",
        F.count_if(skip).over(pair).alias("skippers"),
        F.count_if("fresh").over(pair).alias("longer"),
        F.max(F.when(skip & (F.col("place") == 1), own)).over(pair).alias("top"),
        F.max(F.when(skip & (F.col("place") == 2), own)).over(pair).alias("second"),
        F.max(F.when(F.col("fresh"), own)).over(pair).alias("top_longer"),
        F.max(F.when(~skip, own)).over(pair).alias("shorter"),
    ).where("skippers > 1 OR (longer > 0 AND shorter IS NOT NULL)")
    replaced = F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("top"))
    shorter = F.when(F.col("fresh"), F.col("shorter"))
    near = F.when(skip, F.col("skippers") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)).otherwise(F.col("longer"))
    best = F.when(skip, F.greatest(replaced, shorter)).otherwise(F.col("top_longer"))
    return (
        met.select("id", near.alias("near"), best.alias("best")).where("near > 0")
        .groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))
    )


def _ends(forms: DataFrame) -> DataFrame:
    """``id, root`` of ``id, form``: where following the forms ends, by doubling the steps."""
    at = keep(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("id").alias("root"), F.col("root").alias("further"))
        after = keep(at.join(onward, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        forget(at)
        if after.where("moved").isEmpty():
            return after.select("id", "root")
        at = keep(after.select("id", "root"), "roots")
        forget(after)


def group_variants(words: DataFrame, ratio: int = RATIO, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``words`` (``word, n``, words distinct)."""
    counted = keep(words.select("word", F.col("n").cast("long").alias("n")), "words")
    forward = keep(
        trie_paths(counted, F.col("word"), shard_words).select(F.col("place").alias("id"), "word", "n", F.col("nodes").alias("prefix"), "fresh"),
        "prefixes",
    )
    backward = trie_paths(forward.select("id", "word"), F.reverse("word"), shard_words).select("id", F.col("nodes").alias("suffix"))
    near = keep(near_words(forward.join(backward, "id")), "near")
    best_id, best_n = -F.col("best.minus_id"), F.col("best.n")
    found = keep(
        forward.select("id", "word", "n").join(near, "id", "left").select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(best_n >= ratio * F.col("n"), best_id).alias("form"), F.when(best_n >= ratio * F.col("n"), best_n).alias("form_n"),
        ),
        "forms",
    )
    roots = _ends(found.where("form IS NOT NULL").select("id", "form"))
    spelled = found.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    final = found.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    led = found.where("form IS NOT NULL").join(roots, "id").join(spelled, "form").join(final, "root").select("id", "form_word", "root_word")
    return found.join(led, "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the words of all texts and group their variants."""
    return group_variants(count_words(docs, id_col, text_col))
