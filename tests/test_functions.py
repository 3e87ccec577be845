"""Column functions at their edges."""

import re
from datetime import date
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewloom.functions import dates, formats, scores, text
from reviewloom.functions import words as W


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def values(spark, data, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [row.x for row in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def plain_clean(raw):
    """Cleaning spelt out on one Python string."""
    stops = set(W.stop_words())
    kept = " ".join(word for word in raw.lower().split() if word not in stops)
    return re.sub("[^a-zA-Z ]", "", kept).strip(" ")


TRICKY = [
    "The staff wasn't great & we'll be back.",
    "the, the THE",
    "  A\tB\nC  ",
    "wide blank and\x1cseparator　end",
    "café crème 5/5 \U0001f600 ok",
    "",
    "&",
    "I don't think so, mustn't you?",
]


def test_clean_text_on_tricky_texts(spark):
    assert values(spark, TRICKY, text.clean_text) == [plain_clean(raw) for raw in TRICKY]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="İͅΣK"), max_size=60), max_size=40))
def test_clean_text_on_any_text(spark, raw):
    raw = [value for value in raw if value.lower() == value.lower().lower()]
    if raw:
        assert values(spark, raw, text.clean_text) == [plain_clean(value) for value in raw]


def test_null_text_stays_null(spark):
    assert values(spark, [None], text.clean_text) == [None]
    assert values(spark, [None], text.alpha_only) == [None]


def test_ampersand_leaves_two_blanks_in_letters(spark):
    assert values(spark, ["Nice & cosy. 10/10"], text.alpha_only) == ["Nice  cosy"]


def test_negations_are_kept():
    stops = W.stop_words()
    assert "wasn't" not in stops and "not" not in stops and "the" in stops
    assert len(W.ENGLISH_STOP_WORDS) == 179 and len(W.ALLOWED_STOP_WORDS) == 52


def test_phrase_titles(spark):
    assert text.phrase_label([" price or value", "FOOD "]) == "Price or Value or Food"
    assert text.phrase_label_key(["Price  OR value"]) == "price or value"
    assert values(spark, ["price  OR value ", "Price Or Value"], text.phrase_key) == ["price or value"] * 2
    assert W.phrase_terms(["drink"]) == W.phrase_terms([" DRINK "]) == W.phrase_terms(["Drink"])
    assert W.phrase_terms(["parking"]) == ["parking"]


def test_long_sentences_are_cut_into_runs(spark):
    found = values(spark, [" ".join(f"{c}" for c in "abcdefg") + ". x"], lambda text_: text.sentences(text_, 3))
    assert found == [["a b c", "d e f", "g", "x"]]


def score(raw):
    return text.lexicon_score(text.word_list(raw))


def test_lexicon_scores(spark):
    given_texts = ["staff great", "staff wasnt great", "wasnt terrible", "fine", "nothing here", "", "not not great",
                   "great superb amazing", "awful rude dirty worst", "great terrible"]
    assert values(spark, given_texts, score) == [7, 3, 7, 5, -1, -1, 3, 10, 0, 5]


def test_restaurant_is_not_a_negator(spark):
    assert values(spark, ["restaurant great"], score) == [7]


def test_phrase_flag(spark):
    flag = lambda raw: text.phrase_flag(text.word_list(raw), W.phrase_terms(["Food", "Nap Rooms"]))
    assert values(spark, ["meal cold", "nap", "seafood", ""], flag) == [1, 1, 0, 0]


def test_aspects_pair_nouns_and_adjectives(spark):
    hits = lambda raw: text.aspects(text.word_list(raw))
    found = values(
        spark,
        ["staff great", "great staff", "waiter was lovely", "staff wasnt great", "great", "food cold food cold", "wasnt slow service"],
        hits,
    )
    plain = [[(hit.good, hit.aspect) for hit in row] for row in found]
    assert plain == [
        [(True, "great staff")], [(True, "great staff")], [(True, "nice staff")], [(False, "not great staff")],
        [], [(False, "cold food")], [(True, "not slow staff")],
    ]


def test_sentences(spark):
    assert values(spark, ["Good  food! Was it?  5 stars...\nYes"], text.sentences) == [["Good food", "Was it", "stars", "Yes"]]


def test_rescale_and_raw_score(spark):
    rescaled = values(spark, list(range(-1, 11)), scores.rescale_score, "int")
    assert rescaled == [Decimal(n) / 5 - 1 for n in range(-1, 11)]
    raw = values(spark, list(range(-1, 11)), lambda v: scores.raw_score(scores.rescale_score(v)), "int")
    assert raw == ["-", "-1", "-0.8", "-0.6", "-0.4", "-0.2", "0", "0.2", "0.4", "0.6", "0.8", "1"]


def test_undiscussed_phrase_is_unknown(spark):
    column = scores.raw_phrase_score(F.lit(0), F.lit(1).cast("decimal(3,1)"))
    assert one(spark, column) == "-"


def test_valid_scores(spark):
    given_scores = [-1.0, 0.0, 10.0, 4.5, -1.2, 11.0, None, float("nan")]
    assert values(spark, given_scores, scores.is_valid_score, "double") == [True, True, True, False, False, False, False, False]


def test_every_dimension_score_is_reached(spark, star):
    raw = values(spark, list(range(-1, 11)), lambda v: scores.raw_score(scores.rescale_score(v)), "int")
    known = {row.SentimentRawScore for row in star.sentiment.collect()}
    assert set(raw) == known


@pytest.mark.parametrize(
    "label, months, window",
    [("FEB-25", 12, (20240229, 20250228)), ("Mar-24", 1, (20240229, 20240331)), ("Jan-99", 13, (19971231, 19990131))],
)
def test_reporting_window(spark, label, months, window):
    assert dates.window_ids(label, months) == window
    assert tuple(one(spark, dates.reporting_window(F.lit(label), months))) == window


def test_preset_start_is_clamped(spark):
    first, last = F.lit(date(2024, 1, 15)), F.lit(date(2024, 3, 31))
    assert one(spark, dates.preset_start(first, last, 1)) == date(2024, 2, 29)
    assert one(spark, dates.preset_start(first, last, 12)) == date(2024, 1, 15)


def test_date_ids(spark):
    assert one(spark, dates.date_id(F.lit(date(2024, 2, 9)))) == 20240209
    assert one(spark, dates.from_date_id(F.lit(20240209))) == date(2024, 2, 9)


def test_display_numbers(spark):
    df = spark.sql(
        "SELECT 1234567 AS n, CAST(12.50 AS decimal(32,1)) AS one, CAST(0.125 AS decimal(20,6)) AS two, "
        "CAST(3 AS decimal(5,1)) AS whole, CAST(NULL AS decimal(5,1)) AS missing, 'x' AS name"
    )
    assert tuple(formats.format_stats(df).first()) == ("1,234,567", "12.5", "0.12", "3", None, "x")


def test_exact_ratio_rounds_half_up_and_survives_zero(spark):
    assert one(spark, scores.exact_ratio(F.lit(4900), F.lit(400), 1)) == Decimal("12.3")
    assert one(spark, scores.exact_ratio(F.lit(1), F.lit(0), 1)) is None
