"""Secret scan: wide patterns find candidates, a random forest removes false positives.

Candidates are values of 6 or more characters, whatever they are, that are assigned after a secret
word, and runs of 16 or more characters that keys and tokens are made of, with digits or not.  A value
ends at a blank or at the quote that opened it.  A name and equals sign before a value are
not part of it; a run's name that could be a key itself is a candidate of its own.  The forest sees a candidate's length, its character transitions (how often the kind of
character changes, and how usual its pairs of characters are in the corpus, counted over all
texts), how much of it dictionary words cover, its path, and the words beside it.  It is trained
from findings that somebody has labelled.

Bounds: the forest is fitted on at most about ``sample`` labelled findings, as many of either label;
pairs of characters are 38 x 38 numbers; the dictionary is the vocabulary of a tokenizer.

Defined cases: a null text has no candidates; a null path is an empty one; candidates overlap
never; a text of any length is scanned whole, and every candidate is returned; labels that are null or
of findings that don't exist are ignored; with labels of one kind only every score is that kind;
without labels scores are null and nothing is removed; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import keep

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.@-]{16,}")
RUN, VALUE_LEAST = 16, 6
# A sign of assignment and, behind it, a scheme of authorization; addresses of the web have no such sign.
SIGN = re.compile(r"[:=]+>?(?!//)[ \t]*(?:(?:bearer|basic|token)[ \t]+)?", re.IGNORECASE)
# A value in quotes, up to the same quote; else up to a blank or the next name and sign.
VALUE = re.compile(
    r"""(\\*)(["'`])(?P<quoted>(?:(?!\1\2)(?>\\\S|\S))*+)\1\2|\\*["'`]?(?P<plain>(?:(?![&;,]\\*["'`]?[\w.-]+\\*["'`]?[ \t]*[:=])\S)+)"""
)
NAME = re.compile(r"[^=]+=+(?=[^=])")
WORD = re.compile(r"[A-Za-z][\w-]*")
ADDRESS = re.compile(r"[\w.+-]+@(?:[\w-]+\.)+[A-Za-z]{2,}")
ASSIGNED = re.compile(r"[:=]>?\s*(?:(?:bearer|basic|token)\s+)?\\*[\"'`]?$", re.IGNORECASE)
SAMPLE = 20_000
TREES, DEPTH = 24, 7
BESIDE = 48
# Own lists; extend them as labels call for it.
SECRET_WORDS = ("token", "key", "secret", "password", "passwd", "pwd", "auth", "credential", "bearer", "private")
EXAMPLE_WORDS = ("example", "sample", "dummy", "test", "fake", "placeholder", "changeme", "mock", "xxxx")
PATH_WORDS = (*EXAMPLE_WORDS, "doc", "fixture", "spec")
SYMBOLS = 38

FEATURES = (
    "length", "entropy", "digits", "upper", "hex", "changes", "usual_pairs", "least_usual_pair", "coverage", "digit_run", "letter_run",
    "dots", "slashes", "address", "path_parts", "path_example", "path_hash", "secret_word", "word_distance", "assigned", "quoted",
    "example_word", "repeated_characters",
)


def dictionary(rank_path: str, least: int = 4) -> frozenset[str]:
    """Words of a tokenizer's vocabulary: lower-case pieces of letters after a space."""
    from reviewloom.llm.bpe import read_ranks

    words = (token[1:].decode("ascii", "ignore") for token in read_ranks(rank_path) if token[:1] == b" ")
    return frozenset(word.lower() for word in words if len(word) >= least and word.isalpha() and word.isascii())


# ---- pairs of characters ---------------------------------------------------------------

def _symbols() -> np.ndarray:
    """Of a byte: letters without case 0 to 25, digits 26 to 35, white space 36, others 37."""
    table = np.full(256, 37, np.int64)
    for byte in range(256):
        char = chr(byte)
        if char.isascii() and char.isalpha():
            table[byte] = ord(char.lower()) - 97
        elif char.isascii() and char.isdigit():
            table[byte] = 26 + int(char)
        elif char.isspace() and byte < 128:
            table[byte] = 36
    return table


def pair_logs(docs: DataFrame, text_col: str) -> np.ndarray:
    """Binary logarithms of how likely one character follows another, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _symbols(), np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for batch in batches:
            for value in batch.column(0):
                data = table[np.frombuffer(value.as_buffer() if value.is_valid else b"", np.uint8)]
                total += np.bincount(data[:-1] * SYMBOLS + data[1:], minlength=len(total))
        yield pa.RecordBatch.from_pydict({"pair": np.arange(len(total)), "n": total})

    lines = docs.select(F.col(f"`{text_col}`").cast("binary")).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    total = np.ones(SYMBOLS * SYMBOLS)
    for line in lines:
        total[line["pair"]] += line["n"]
    total = total.reshape(SYMBOLS, SYMBOLS)
    return np.log2(total / total.sum(axis=1, keepdims=True))


# ---- candidates and their features ---------------------------------------------------------

def _kind(char: str) -> int:
    return 0 if char.isdigit() else 1 if char.islower() else 2 if char.isupper() else 3


def _covered(candidate: str, words: frozenset[str]) -> float:
    """Share of a candidate inside dictionary words, the longest first from the left."""
    text, i, covered = candidate.lower(), 0, 0
    while i < len(text):
        for size in range(min(16, len(text) - i), 3, -1):
            if text[i : i + size] in words:
                covered += size
                i += size
                break
        else:
            i += 1
    return covered / len(text)


def _near(before: str) -> list[str]:
    """The last words and names before a place; a name is one word."""
    return [word.lower() for word in WORD.findall(before)[-4:]]


def _assigned(text: str) -> Iterator[tuple[int, int]]:
    """Where values are that are assigned after a secret word."""
    low = text.lower()
    if not any(word in low for word in SECRET_WORDS):
        return
    end = 0
    for sign in SIGN.finditer(text):
        if sign.start() < end or not any(name in word for word in _near(text[max(0, sign.start() - BESIDE) : sign.start()]) for name in SECRET_WORDS):
            continue
        value = VALUE.match(text, sign.end())
        if not value:
            continue
        lo, hi = value.span("plain" if value["quoted"] is None else "quoted")
        if value["quoted"] is None:
            while hi > lo and (text[hi - 1] in "\"'`\\,;." or text[hi - 1] in ")]}" and "([{"[")]}".index(text[hi - 1])] not in text[lo:hi]):
                hi -= 1
        if hi - lo >= VALUE_LEAST:
            end = hi
            yield lo, hi


def spans(text: str) -> list[tuple[int, int]]:
    """Where the candidates of a text are, in order; they never overlap."""
    out = list(_assigned(text))
    found, at = list(out), 0
    for run in CANDIDATE.finditer(text):
        lo, last = run.span()
        while at < len(found) and found[at][1] <= lo:
            at += 1
        pieces, k = [], at
        while k < len(found) and found[k][0] < last:
            pieces.append((lo, found[k][0]))
            lo, k = max(lo, found[k][1]), k + 1
        for lo, hi in [*pieces, (lo, last)]:
            name = NAME.match(text, lo, hi)
            if hi - lo >= RUN and name and hi - name.end() >= VALUE_LEAST:
                # Base64 may end in equals signs, so they stay with what was in front of them.
                if name.end() - lo >= RUN and any(char.isdigit() for char in name.group()):
                    out.append((lo, name.end()))
                lo = name.end()
                out.append((lo, hi))
            elif hi - lo >= RUN and any(char.isalnum() for char in text[lo:hi]) and (hi == last or text[hi - 1] != "=" or any(char.isdigit() for char in text[lo:hi])):
                out.append((lo, hi))
    return sorted(out)


def features(candidate: str, before: str, after: str, path: str, pairs: np.ndarray, table: np.ndarray, words: frozenset[str]) -> list[float]:
    size, counts = len(candidate), Counter(candidate)
    entropy = -sum(n / size * math.log2(n / size) for n in counts.values())
    kinds = [_kind(char) for char in candidate]
    at = table[np.frombuffer(candidate.encode(), np.uint8)]
    logs = pairs[at[:-1], at[1:]]
    low, near = path.lower(), _near(before)
    found = [i for i, word in enumerate(reversed(near)) if any(name in word for name in SECRET_WORDS)]
    runs = [max((len(run) for run in re.findall(pattern, candidate)), default=0) for pattern in (r"\d+", r"[A-Za-z]+")]
    return [
        size, entropy, kinds.count(0) / size, kinds.count(2) / size, sum(char in "0123456789abcdefABCDEF" for char in candidate) / size,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / (size - 1), float(logs.mean()), float(logs.min()),
        _covered(candidate, words), *runs, candidate.count("."), candidate.count("/"), float(bool(ADDRESS.fullmatch(candidate))),
        len([part for part in re.split(r"[/\\]", path) if part]), float(any(word in low for word in PATH_WORDS)), float(sum(path.encode()) % 16),
        float(bool(found)), found[0] if found else 9, float(bool(ASSIGNED.search(before))),
        float(before[-1:] in "\"'`" and after[:1] in "\"'`" and bool(before) and bool(after)),
        float(any(word in part for word in EXAMPLE_WORDS for part in (*near, candidate.lower()))), 1 - len(counts) / size,
    ]


def find_candidates(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``id, text_hash, lo, hi, candidate, before, after, path, features`` of every candidate.

    ``text_hash`` tells texts apart that have one id, or none.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((pair_logs(docs, text_col), dictionary(rank_path)))  # bounded by the vocabulary
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (pairs, words), table = shared.value, _symbols()
        for batch in batches:
            lines, rows = [], []
            for i, (value, path) in enumerate(zip(batch.column("text"), batch.column("path").to_pylist(), strict=True)):
                text = value.as_py() or ""
                for lo, hi in spans(text):
                    candidate = text[lo:hi]
                    before, after = text[max(0, lo - BESIDE) : lo], text[hi : hi + BESIDE]
                    rows.append(i)
                    lines.append((lo, hi, candidate, before, after, path or "", features(candidate, before, after, path or "", pairs, table, words)))
            columns = list(zip(*lines, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4, pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name).take(pa.array(rows, pa.int64())) for name in ("id", "text_hash")), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["id", "text_hash", "lo", "hi", "candidate", "before", "after", "path", "features"],
            )

    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("text_hash"),
        F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{path_col}`").cast("string").alias("path"),
    )
    return keep(
        rows.mapInArrow(scan, f"id {kind}, text_hash long, lo long, hi long, candidate string, before string, after string, path string, features array<double>"),
        "candidates",
    )


# ---- the forest ------------------------------------------------------------------------------

def judge(found: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Candidates with ``score`` and ``is_secret``.

    ``labels`` has id, lo and label (1 for a secret, 0 for a false positive), and text_hash, if ids repeat or are null
    and their labels shall go to one text only.  A null id is one like others.  Labels that contradict each other,
    and null ones, count for nothing; a label that is given twice counts once.  A table without labels calls all
    candidates secrets; one with labels of one kind calls all that.
    """
    keys = ["id", "lo", *(["text_hash"] if "text_hash" in labels.columns else [])]
    agreed = labels.groupBy(*keys).agg(F.min("label").cast("double").alias("label"), F.max("label").cast("double").alias("most")).where("label = most")
    given = agreed.select(*(F.col(key).alias(f"_{key}") for key in keys), "label")
    same = reduce(and_, (F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys))
    known = found.join(given, same).drop(*(f"_{key}" for key in keys))
    sizes = {line["label"]: line["count"] for line in known.groupBy("label").count().collect()}  # two lines
    if not sizes:
        return found.withColumn("score", F.lit(None).cast("double")).withColumn("is_secret", F.lit(True))
    if len(sizes) == 1:
        only = next(iter(sizes))
        return found.withColumn("score", F.lit(only)).withColumn("is_secret", F.lit(only > 0.5))
    draw = F.pmod(F.xxhash64("id", "lo"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, sample / len(sizes) / n))).otherwise(share)
    fit = keep(known.where(draw < share).select("label", "features"), "labelled").select("label", array_to_vector("features").alias("vector"))
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7, probabilityCol="chances", rawPredictionCol="votes"
    ).fit(fit)
    judged = forest.transform(found.withColumn("vector", array_to_vector("features")))
    score = vector_to_array("chances")[1]
    return judged.withColumn("score", score).withColumn("is_secret", F.col("score") >= 0.5).drop("vector", "votes", "chances", "prediction")


def rule_labels(found: DataFrame) -> DataFrame:
    """Labels where nobody has labelled: a secret is an assigned, random value after a secret word.

    Random means that its characters differ, as far as its length lets them; addresses and words
    are false positives, as is what stands beside words of examples.
    """
    at: dict[str, Column] = {name: F.col("features")[i] for i, name in enumerate(FEATURES)}
    secret = (at["secret_word"] > 0) & (at["assigned"] > 0) & (at["address"] == 0) & (at["example_word"] == 0)
    secret &= at["entropy"] >= F.least(F.lit(3.0), 0.75 * F.log2(at["length"]))
    secret &= (at["coverage"] < 0.8) | (at["digits"] > 0)
    return found.select("id", "text_hash", "lo", F.when(secret, 1).otherwise(0).alias("label"))


def redact(docs: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of its text replaced; a null id is one like others, and texts of one id are told apart."""
    spans = judged.where("is_secret").groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("_spans")
    )

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, listed in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            for span in reversed(listed or []):
                text = text[: span["lo"]] + mark + text[span["hi"] :]
            out.append(text)
        return pa.array(out, pa.string())

    text_hash = F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    joined = docs.join(spans, F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (text_hash == F.col("_hash")), "left")
    columns = [cut(F.col(f"`{text_col}`"), F.col("_spans")).alias(name) if name == text_col else F.col(f"`{name}`") for name in docs.columns]
    return joined.select(*columns)
