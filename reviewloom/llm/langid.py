"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed n-grams of one to three lower-case letters (everything else is a space),
weighted by relative frequency times inverse document frequency.  The document frequencies
are counted over all documents that may be learned from.  The weights are learned with
follow-the-regularised-leader and elastic-net penalties: each epoch, a fixed number of shards
starts from the common state, passes over its documents, and the shards' states are averaged.
Last, one temperature is chosen for the logits on documents set aside, so that scores are
calibrated probabilities.

Bounds: the model is fitted on a bounded sample of labelled rows, ``sample`` in all, shared
evenly among languages, plus a fourth of that to calibrate; whole texts of these are used.  The
model holds 65,536 x languages numbers and is the only thing that passes through the driver.
Prediction reads every text whole, in pieces of bounded memory.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows with a null
language are never learned from; with no labelled row at all every row is ``und``, and
with a single language every other row gets that one; ties go to the language that sorts
first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import keep

BITS = 16
FEATURES = 1 << BITS
GRAMS = (1, 2, 3)
SAMPLE = 6000
SHARDS = 8
EPOCHS = 3
# Factor of the relative frequencies, so that common n-grams are near one.
SCALE = 32.0
# Learning rate and its offset; elastic net.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
TEMPERATURES = [round(2.0 ** (k / 4), 4) for k in range(-20, 21)]
PIECE = 1 << 18
UNDETERMINED = "und"


# ---- features ------------------------------------------------------------------

@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter of each code point, a space for what is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            table[code] = ord(char.lower()[0])
    return table


def _codes(text: str) -> np.ndarray:
    return _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """Hashed n-grams, an array for each length."""
    out, value = [], np.zeros(len(codes), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(codes) < n:
            break
        value = (value[: len(codes) - n + 1] if n == 1 else value[:-1]) * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
        if n in GRAMS:
            mixed = value * np.uint32(0x9E3779B1)
            out.append((mixed ^ (mixed >> np.uint32(15))) >> np.uint32(32 - BITS))
    return out


def pieces(text: str) -> Iterator[list[np.ndarray]]:
    """Hashed n-grams of a whole text, a piece of bounded length at a time."""
    codes = _codes(text)
    overlap = max(GRAMS) - 1
    for start in range(0, max(len(codes), 1), PIECE):
        hashes = _hashes(codes[start : start + PIECE + overlap])
        yield [h[:PIECE] for h in hashes]  # what lies beyond belongs to the next piece


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their relative frequencies."""
    total = np.zeros(FEATURES, np.int64)
    for hashes in pieces(text):
        for h in hashes:
            total += np.bincount(h, minlength=FEATURES)
    found = np.flatnonzero(total)
    return found.astype(np.int32), (total[found] / max(total.sum(), 1)).astype(np.float64)


def has_letter(text: str) -> bool:
    return bool((_codes(text) != 32).any())


# ---- the model --------------------------------------------------------------------

class Model:
    """Languages, weights times idf (features x languages), intercepts, temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.languages, self.weights, self.bias, self.temperature = languages, weights, bias, temperature

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for hashes in pieces(text):
            for h in hashes:
                total += self.weights[h].sum(axis=0, dtype=np.float64)
                n += len(h)
        return SCALE * total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        scaled = self.logits(text) / self.temperature
        chances = np.exp(scaled - scaled.max())
        chances /= chances.sum()
        best = int(chances.argmax())
        return self.languages[best], float(chances[best])


def _leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights that follow from sums of gradients and of their squares."""
    pulled = np.sign(z) * L1 - z
    return np.where(np.abs(z) <= L1, 0.0, pulled / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _learn(pdf: pd.DataFrame, z: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass over a shard's documents; the last line of the state is the intercept."""
    for label, found, values in zip(pdf["label"], pdf["found"], pdf["share"], strict=True):
        at = np.append(np.asarray(found), FEATURES)
        x = np.append(np.asarray(values) * idf[at[:-1]] * SCALE, 1.0)
        w = _leader(z[at], n[at])
        logits = x @ w
        chances = np.exp(logits - logits.max())
        chances /= chances.sum()
        chances[label] -= 1.0
        gradient = np.outer(x, chances)
        squared = gradient * gradient
        z[at] += gradient - (np.sqrt(n[at] + squared) - np.sqrt(n[at])) / ALPHA * w
        n[at] += squared
    return z, n


def _epoch(state: Broadcast) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What one pass over a shard adds to the common state."""

    def change(pdf: pd.DataFrame) -> pd.DataFrame:
        z0, n0, idf = state.value
        z, n = _learn(pdf.sort_values(["order", "label"]), z0.copy(), n0.copy(), idf)
        at, of = np.nonzero((z != z0) | (n != n0))
        return pd.DataFrame({"feature": at, "label": of, "z": (z - z0)[at, of], "n": (n - n0)[at, of]})

    return change


def _document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many of the texts each feature occurs; last, how many texts there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                found = np.zeros(FEATURES, bool)
                for hashes in pieces(value.as_py()):
                    for h in hashes:
                        found[h] = True
                total += found
                seen += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({
            "feature": pa.array(np.append(at, FEATURES).astype(np.int32)), "n": pa.array(np.append(total[at], seen)),
        })

    found = texts.mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(FEATURES + 1, np.int64)
    out[found["feature"].to_numpy()] = found["n"].to_numpy()
    return out


def held_out(id_column: Column) -> Column:
    """Whether the rest of CRC-32 of the id as text by 5 is 0; a null id counts as empty."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % 5 == 0


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE
) -> Model:
    """A model from the labelled rows of ``docs`` that are not held out."""
    spark = docs.sparkSession
    labelled = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
    ).where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {line["lang"]: line["count"] for line in labelled.groupBy("lang").count().collect()}  # a line a language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((FEATURES, 0)), np.zeros(0))
    frequencies = _document_frequencies(labelled.select("text"))
    idf = np.log((1 + frequencies[FEATURES]) / (1 + frequencies[:FEATURES])) + 1.0

    # A hash of the id decides who is in the sample, on which shard, and who calibrates.
    quota = 1.25 * sample / len(languages)
    limits = spark.createDataFrame(
        [(lang, k, min(1.0, quota / sizes[lang])) for k, lang in enumerate(languages)], "of string, label int, share_of double"
    )
    draw = F.pmod(F.xxhash64(F.lit("draw"), "id"), F.lit(1 << 30)) / float(1 << 30)
    deal = F.pmod(F.xxhash64(F.lit("deal"), "id"), F.lit(5 * SHARDS)).cast("int")
    drawn = labelled.join(F.broadcast(limits), F.col("lang") == F.col("of")).where(draw < F.col("share_of"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(value.as_py()) for value in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("order"), batch.column("deal"), batch.column("label"),
                 pa.array([f for f, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float64()))],
                names=["order", "deal", "label", "found", "share"],
            )

    shards = keep(
        drawn.select(F.xxhash64(F.lit("order"), "id").alias("order"), deal.alias("deal"), "label", "text")
        .mapInArrow(featurise, "order long, deal int, label int, found array<int>, share array<double>"),
        "langid",
    )
    fit, aside = shards.where(F.col("deal") >= SHARDS), shards.where(F.col("deal") < SHARDS)
    classes = len(languages)
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))
    for _ in range(EPOCHS):
        state = spark.sparkContext.broadcast((z, n, idf))  # 65,537 x languages numbers, twice
        change = (
            fit.groupBy((F.col("deal") % SHARDS).alias("shard"))
            .applyInPandas(_epoch(state), "feature long, label long, z double, n double")
            .groupBy("feature", "label").agg(F.sum("z").alias("z"), F.sum("n").alias("n"))
        ).toPandas()
        z, n = z.copy(), n.copy()
        at = (change["feature"].to_numpy(), change["label"].to_numpy())
        z[at] += change["z"].to_numpy() / SHARDS
        n[at] += change["n"].to_numpy() / SHARDS
        state.unpersist()
    weights = _leader(z, n)
    model = Model(languages, weights[:FEATURES] * idf[:, None], weights[FEATURES])
    model.temperature = _temperature(aside, model)
    model.weights = model.weights.astype(np.float32)
    return model


def _temperature(aside: DataFrame, model: Model) -> float:
    """The temperature with the least log loss on documents set aside; 1 if there are none."""
    shared = aside.sparkSession.sparkContext.broadcast(model)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        total = np.zeros(len(TEMPERATURES))
        for batch in batches:
            for label, found, share in zip(*(batch.column(k) for k in ("label", "found", "share")), strict=True):
                logits = SCALE * (share.values.to_numpy() @ model.weights[found.values.to_numpy()]) + model.bias
                scaled = logits[None, :] / np.array(TEMPERATURES)[:, None]
                scaled -= scaled.max(axis=1, keepdims=True)
                total += np.log(np.exp(scaled).sum(axis=1)) - scaled[:, label.as_py()]
        yield pa.RecordBatch.from_pydict({"k": list(range(len(TEMPERATURES))), "loss": total})

    lines = aside.mapInArrow(losses, "k long, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()
    loss = {line["k"]: line["loss"] for line in lines}
    if not any(loss.values()):
        return 1.0
    return TEMPERATURES[min(loss, key=lambda k: (round(loss[k], 9), abs(k - len(TEMPERATURES) // 2)))]


def identify(model: Model, spark, text: Column) -> Column:
    """``struct<lang_pred, score>`` of a text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in texts:
            found = [model.predict(value.as_py()) for value in batch]
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["lang_pred", "score"],
            )

    return predict(text.cast("string"))
