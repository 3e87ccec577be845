"""Scoring reviews: by the lexicon in place, or by any scorer in batches of distinct texts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom import schema
from reviewloom.functions import words as W
from reviewloom.functions.scores import rescale_score
from reviewloom.functions.text import clean_text, lexicon_score, phrase_flag, text_key, word_list
from reviewloom.operators import batches as B
from reviewloom.operators.duplicates import collapse_duplicates, fan_out
from reviewloom.session import cut_lineage
from reviewloom.sources.journal import ReplyJournal

# A scorer takes the JSON of one batch and returns its reply.
Scorer = Callable[[str], str]


def clean_reviews(candidates: DataFrame, stops: list[str] | None = None) -> DataFrame:
    """Cleaned texts; a review without a text is not scored."""
    written = candidates.where(F.col("ReviewText").isNotNull())
    return written.select("ReviewID", clean_text(F.col("ReviewText"), stops).alias("CleanText"))


def score_overall(texts: DataFrame, text: str = "CleanText", lexicon=W.LEXICON) -> DataFrame:
    """Add Sentiment, 0..10 or -1, to rows of cleaned text."""
    return (
        texts.withColumn("_words", word_list(F.col(text)))
        .withColumn("Sentiment", lexicon_score(F.col("_words"), lexicon))
        .drop("_words")
    )


def score_phrase(
    texts: DataFrame, phrases: list[str], text: str = "CleanText", lexicon=W.LEXICON,
    synonyms=W.PHRASE_SYNONYMS,
) -> DataFrame:
    """Add PhraseFlag and, where it is 1, the score; elsewhere the score is -1."""
    words = F.col("_words")
    score = F.when(F.col("PhraseFlag") == 1, lexicon_score(words, lexicon))
    return (
        texts.withColumn("_words", word_list(F.col(text)))
        .withColumn("PhraseFlag", phrase_flag(words, W.phrase_terms(phrases, synonyms)))
        .withColumn("Sentiment", score.otherwise(F.lit(schema.UNCLEAR_SCORE)))
        .drop("_words")
    )


def _result_columns(phrases: list[str] | None) -> list[str]:
    return ["PhraseFlag", "Sentiment"] if phrases else ["Sentiment"]


def score_reviews(
    candidates: DataFrame, phrases: list[str] | None = None, stops: list[str] | None = None,
    lexicon=W.LEXICON,
) -> DataFrame:
    """Rescaled lexicon scores of all candidates.

    The lexicon costs no more than the cleaning does, so each review is scored where
    it is read: collapsing copies first would add two shuffles and save nothing.
    Scorers that are dear to call go through :func:`run_scorer`.
    """
    cleaned = clean_reviews(candidates, stops)
    scored = score_phrase(cleaned, phrases, lexicon=lexicon) if phrases else score_overall(cleaned, lexicon=lexicon)
    return scored.select("ReviewID", *_rescaled(phrases))


def _rescaled(phrases: list[str] | None) -> list[Column]:
    score = rescale_score(F.col("Sentiment")).alias("Sentiment")
    return [F.col("PhraseFlag"), score] if phrases else [score]


@dataclass(frozen=True)
class ScoreRun:
    scores: DataFrame
    rejects: DataFrame
    metrics: DataFrame


def reply_item(phrases: list[str] | None) -> T.StructType:
    return schema.PHRASE_ITEM if phrases else schema.OVERALL_ITEM


# Calls that one task makes at most; what it loses with its executor is bounded by that.
TASK_CALLS = 64

_ITEMS = T.ArrayType(T.StructType([T.StructField("ReviewID", T.LongType()), T.StructField("ReviewText", T.StringType())]))


def ask_scorer(
    batches: DataFrame, scorer: Scorer, calls: int | None = None, journal: ReplyJournal | None = None,
    task_calls: int = TASK_CALLS,
) -> DataFrame:
    """Call the scorer once for each batch row; only JSON crosses to Python and back.

    ``calls`` is how many tasks call it at a time at most, all cores if it isn't given.  A task makes
    ``task_calls`` calls at most: batches go out in as many waves, each a job of ``calls`` tasks whose replies are
    written before the next starts.  A call that raises leaves the batch without a reply
    but with its Error, and it is set aside later: one bad batch does not end the run.

    With a ``journal``, batches that it has a reply for are not asked, and every reply goes there at once:
    a repeated task, or a run after one that was stopped, asks only for what has no reply.
    """
    spark = batches.sparkSession
    calls = calls or spark.sparkContext.defaultParallelism
    narrow = batches.select("Queue", "Batch", "ItemsJson")
    if journal is None:
        return _with_items(_in_waves(narrow, scorer, calls, task_calls, None), [])
    names = ["Digest", "Attempt"]
    named = cut_lineage(journal.named(narrow, "ItemsJson"))
    known = cut_lineage(journal.known(spark).join(named.select("Name"), "Name", "left_semi"))
    found = named.join(known, "Name").withColumn("Error", F.lit(None).cast("string"))
    asked = _in_waves(named.join(known, "Name", "left_anti").select(*named.columns), scorer, calls, task_calls, journal)
    return _with_items(asked.unionByName(found), names)


def _with_items(answered: DataFrame, names: list[str]) -> DataFrame:
    return answered.select("Queue", "Batch", *names, F.from_json("ItemsJson", _ITEMS).alias("Items"), "Reply", "Error")


def _in_waves(narrow: DataFrame, scorer: Scorer, calls: int, task_calls: int, journal: ReplyJournal | None) -> DataFrame:
    """``narrow`` with Reply and Error, from jobs of ``calls`` tasks with ``task_calls`` calls each at most."""
    waiting = cut_lineage(narrow)
    waves = -(-waiting.count() // (calls * task_calls))
    if waves <= 1:
        return _asked(waiting, scorer, calls, journal)
    wave = F.pmod(F.xxhash64(F.lit("wave"), "Queue", "Batch"), F.lit(waves))
    dealt = cut_lineage(waiting.withColumn("_wave", wave).repartitionByRange(waves, "_wave"))
    parts = [cut_lineage(_asked(dealt.where(F.col("_wave") == k).drop("_wave"), scorer, calls, journal)) for k in range(waves)]
    return reduce(DataFrame.unionByName, parts)


def _asked(waiting: DataFrame, scorer: Scorer, calls: int, journal: ReplyJournal | None) -> DataFrame:
    ask = journal.answering(scorer) if journal else lambda _, question: scorer(question)

    def attempt(name: str | None, batch: str) -> tuple[str | None, str | None]:
        try:
            return ask(name, batch), None
        except Exception as error:
            return None, f"{type(error).__name__}: {error}"[:500]

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = [attempt(name, batch) for name, batch in zip(frame.get("Name", [None] * len(frame)), frame["ItemsJson"])]
            yield frame.assign(
                Reply=pd.Series([reply for reply, _ in answers], dtype=object, index=frame.index),
                Error=pd.Series([error for _, error in answers], dtype=object, index=frame.index),
            )

    more = [T.StructField("Reply", T.StringType()), T.StructField("Error", T.StringType())]
    return waiting.repartition(calls, "Queue", "Batch").mapInPandas(answer, T.StructType([*waiting.schema.fields, *more]))


def unique_texts(cleaned: DataFrame) -> DataFrame:
    """The distinct cleaned texts, each with its smallest id."""
    return collapse_duplicates(cleaned, "CleanText").select(
        "ReviewID", F.col("CleanText").alias("ReviewText")
    )


def judged_batches(
    unique: DataFrame, scorer: Scorer, phrases: list[str] | None = None,
    size: int = schema.BATCH_ROWS, calls: int | None = None, journal: ReplyJournal | None = None,
    task_calls: int = TASK_CALLS,
) -> DataFrame:
    """Batches of ``unique`` texts, scored, with the verdict on each reply.

    ``unique`` is kept: it is counted first, so that there are as many queues as fill.
    """
    batched = B.assign_batches(unique, size=size, queues=B.queue_count(unique))
    asked = ask_scorer(B.batch_json(batched, ["ReviewID", "ReviewText"]), scorer, calls, journal, task_calls)
    return B.check_batches(asked, reply_item(phrases))


def pass_sizes(size: int, passes: int) -> list[int]:
    """Batch sizes of the passes over refused texts: a fifth each time, single texts last."""
    sizes = [max(1, size // 5**k) for k in range(passes)]
    return [*sizes[:-1], 1] if passes > 1 else sizes


def accepted_copies(
    judged: DataFrame, cleaned: DataFrame, phrases: list[str] | None = None
) -> DataFrame:
    """Accepted scores, rescaled, for every copy of the scored texts."""
    scored = B.accepted_scores(judged, reply_item(phrases)).select(
        text_key(F.col("ReviewText")).alias("TextKey"), *_result_columns(phrases)
    )
    keyed = cleaned.select("ReviewID", text_key(F.col("CleanText")).alias("TextKey"))
    return fan_out(scored, keyed, "TextKey").select("ReviewID", *_rescaled(phrases))


def run_metrics(judged: DataFrame, queued: DataFrame) -> DataFrame:
    """Distinct texts completed, failed and left, given the judged batches and the
    distinct texts that were waiting."""
    done = judged.agg(
        F.coalesce(F.sum(F.when(F.col("Reason").isNull(), F.size("Items"))), F.lit(0)).alias("Completed"),
        F.coalesce(F.sum(F.when(F.col("Reason").isNotNull(), F.size("Items"))), F.lit(0)).alias("Failed"),
    )
    waiting = queued.agg(F.count("*")).scalar()
    return done.withColumn("Remaining", waiting - F.col("Completed"))


def run_scorer(
    candidates: DataFrame, scorer: Scorer, phrases: list[str] | None = None,
    stops: list[str] | None = None, size: int = schema.BATCH_ROWS, calls: int | None = None,
    passes: int = 3, journal: ReplyJournal | None = None, task_calls: int = TASK_CALLS,
) -> ScoreRun:
    """Score with any scorer: distinct texts in batches, then every copy.

    Texts of refused batches are asked for again, in smaller batches, ``passes`` times in
    all and alone in the end, so a bad text keeps no others out.  A run in which every
    call raised stops with the error.  The cleaned and the distinct texts and the replies of each pass
    are written to the checkpoint folder, so that the scorer is called once for a
    batch, however many of the results are used.  With a ``journal`` that also holds for tasks that
    are repeated, and for later runs with the same batches; refused replies are asked for again.
    """
    cleaned = cut_lineage(clean_reviews(candidates, stops))
    unique = cut_lineage(unique_texts(cleaned))
    waiting, accepted = unique, None
    for number, own_size in enumerate(pass_sizes(size, passes)):
        judged = cut_lineage(judged_batches(waiting, scorer, phrases, own_size, calls, journal, task_calls))
        calls_made, raised, refused, error = judged.agg(
            F.count("*"), F.count("Error"), F.count("Reason"), F.min("Error")
        ).first()
        if calls_made and raised == calls_made and not number:
            raise RuntimeError(f"the scorer raised on every batch: {error}")
        if journal is not None and refused:
            journal.discard(judged)
        passed = judged.where(F.col("Reason").isNull())
        accepted = passed if accepted is None else accepted.unionByName(passed)
        if not refused or number == passes - 1:
            break
        waiting = cut_lineage(
            judged.where(F.col("Reason").isNotNull()).select(F.inline("Items"))
        )
    refused_batches = judged.where(F.col("Reason").isNotNull())
    return ScoreRun(
        scores=accepted_copies(accepted, cleaned, phrases),
        rejects=B.quarantine(judged),
        metrics=run_metrics(accepted.unionByName(refused_batches), unique),
    )


def lexicon_scorer(lexicon=W.LEXICON, negators=W.NEGATORS, phrases: list[str] | None = None) -> Scorer:
    """The default scores behind the scorer interface, for trying the batch path."""
    weights = {term: weight for weight, terms in lexicon.items() for term in terms}
    turning = set(negators)
    wanted = set(W.phrase_terms(phrases)) if phrases else None

    def score(words: list[str]) -> int:
        hits = [
            -weights[word] if before in turning else weights[word]
            for before, word in zip(["", *words], words)
            if word in weights
        ]
        return max(0, min(10, 5 + sum(hits))) if hits else schema.UNCLEAR_SCORE

    def reply(batch: str) -> str:
        answers = []
        for item in json.loads(batch):
            words = item["ReviewText"].split()
            answer = {"ReviewID": item["ReviewID"]}
            if wanted is not None:
                answer["PhraseFlag"] = int(not wanted.isdisjoint(words))
            discussed = wanted is None or answer["PhraseFlag"]
            answer["Sentiment"] = score(words) if discussed else schema.UNCLEAR_SCORE
            answers.append(answer)
        return json.dumps({"review_sentiment": answers})

    return reply
