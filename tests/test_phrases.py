"""Many phrases in one run find what one run a phrase finds."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks import params as P
from reviewloom.functions import words as W
from reviewloom.functions.phrasebook import PhraseBook, cleaned_words
from reviewloom.functions.text import clean_text, word_list
from reviewloom.plans import candidates, phrases, scoring, writeback


def brute(book, synonyms, words):
    padded = f" {' '.join(words)} "
    known = {phrase.lower(): terms for phrase, terms in synonyms.items()}
    return [
        number
        for number, label in enumerate(book.labels)
        if any(f" {' '.join(cleaned_words(term))} " in padded for term in known.get(label.lower(), [label]) if cleaned_words(term))
    ]


def test_sequences_that_overlap():
    rng = random.Random(3)
    letters = ["great", "food", "slow", "cold", "bar"]
    names = sorted({" ".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(60)})
    synonyms = {"Drink": ["bar bar", "food slow cold"], **W.PHRASE_SYNONYMS}
    book = PhraseBook([*names, "Drink", " DRINK", "Atmosphere"], synonyms)
    assert len(book.labels) == len(names) + 2
    texts = [[rng.choice([*letters, "x", "y"]) for _ in range(rng.randint(0, 12))] for _ in range(400)] + [None, []]
    found = book._lists(pa.array(texts, pa.list_(pa.string()))).to_pylist()
    assert found == [brute(book, synonyms, words or []) for words in texts]
    assert book._lists(pa.array(texts, pa.list_(pa.string())).slice(50, 20)).to_pylist() == found[50:70]
    assert book._lists(pa.array([["food", None, "slow"]], pa.list_(pa.string()))).to_pylist() == [brute(book, synonyms, ["food", "?", "slow"])]


def test_phrases_are_cleaned_as_texts_are(spark):
    raw = ["Price  or VALUE", "it's the  staff's", "wasn't & great, very", "Ünder 24/7 x", "a\tb\nc"]
    df = spark.createDataFrame([(text,) for text in raw], "t string")
    split = [[word for word in row[0] if word] for row in df.select(word_list(clean_text(F.col("t")))).collect()]
    assert split == [cleaned_words(text) for text in raw]
    with pytest.raises(ValueError, match="no words left"):
        PhraseBook(["Food", "the & 7"])


def test_candidates_are_those_of_single_runs(star, rows):
    names = ["Food", "Atmosphere", "Parking"]
    book = PhraseBook(names)
    for settings in ({}, {"min_date": P.MIN_DATE}, {"min_date": P.MIN_DATE, "operator_names": P.OPERATORS}, {"min_date": P.MIN_DATE, "frame": "full", "ignore_case": True}):
        found = phrases.candidates_phrases(star, book, **settings).select("ReviewID", "ReviewText", F.explode("Wanted").alias("Number"))
        for number, name in enumerate(names):
            single = candidates.candidates_phrase(star, [name], **settings)
            assert rows(found.where(F.col("Number") == number).drop("Number")) == rows(single)
    with pytest.raises(ValueError):
        phrases.candidates_phrases(star, book, frame="half")


def test_scores_are_those_of_single_runs(star, rows):
    names = [*P.STORED_PHRASES, "Parking"]
    book = PhraseBook(names)
    scores = phrases.score_phrases(phrases.candidates_phrases(star, book, P.MIN_DATE), book).cache()
    for name in names:
        single = scoring.score_reviews(candidates.candidates_phrase(star, [name], P.MIN_DATE), [name])
        assert rows(scores.where(F.col("Phrase") == book.labels[names.index(name)]).drop("Phrase")) == rows(single)
    scores.unpersist()


def test_two_hundred_phrases_equal_one_run_each(star, rows):
    book = PhraseBook(P.MANY_PHRASES)
    assert len(book.labels) == 198
    found = phrases.score_phrases(phrases.candidates_phrases(star, book, P.MIN_DATE), book)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    counts = {row.Phrase: (row.n, row.hits) for row in found.groupBy("Phrase").agg(F.count("*").alias("n"), F.sum("PhraseFlag").alias("hits")).collect()}
    assert sum(hits > 0 for _, hits in counts.values()) > 20
    for label in random.Random(1).sample(book.labels, 5):
        one = PhraseBook([label])
        single = phrases.score_phrases(phrases.candidates_phrases(star, one, P.MIN_DATE), one)
        assert rows(found.where(F.col("Phrase") == label)) == rows(single)


def test_writeback_equals_one_after_another(star, rows):
    names = ["atmosphere", "staff was great"]
    book = PhraseBook(names)
    made = phrases.writeback_phrases(star, phrases.score_phrases(phrases.candidates_phrases(star, book, P.MIN_DATE), book))
    # The stored spelling stays, and a second time adds nothing.
    assert {row.Phrase for row in made.flags.join(star.phrase_flag, "PhraseSentimentFlagID", "left_anti").collect()} <= {"Atmosphere", "Staff Was Great"}
    again = star.replace(phrase_flag=made.flags, phrase_review=made.reviews)
    twice = phrases.writeback_phrases(again, phrases.score_phrases(phrases.candidates_phrases(again, book, P.MIN_DATE), book))
    assert rows(twice.flags) == rows(made.flags) and rows(twice.reviews) == rows(made.reviews)

    one = candidates.candidates_phrase(star, ["Atmosphere"], P.MIN_DATE)
    single = writeback.writeback_phrase(star, scoring.score_reviews(one, ["Atmosphere"]), ["Atmosphere"])
    pick = lambda tables: tables.reviews.join(tables.flags.where("Phrase = 'Atmosphere'"), "PhraseSentimentFlagID").select("ReviewID", "PhraseFlag", "PhraseSentimentID")
    assert rows(pick(made)) == rows(pick(single))
