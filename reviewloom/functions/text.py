"""Text columns: cleaning, word lists, lexicon scores, phrase flags and aspects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom import schema
from reviewloom.functions import words as W

# Unicode white space and the four separator controls.
WHITESPACE = "(?U)[\\s\\x1c-\\x1f]+"
# Everything but letters and blanks, as ranges: a negated class takes the regex
# engine about twice as long.
NOT_LETTERS = "[\\x00-\\x1f!-@\\[-`{-\\x{10ffff}]+"
SENTENCE_END = "[.!?\\n]+"


def clean_text(text: Column, stops: list[str] | None = None) -> Column:
    """Lower case, drop stop words, then drop everything but letters and blanks.

    Stop words go before punctuation does, so ``the,`` stays and a lone ``&``
    leaves two blanks behind.
    """
    stops = W.stop_words() if stops is None else stops
    kept = F.filter(
        F.split(F.lower(text), WHITESPACE),
        lambda word: (word != "") & ~word.isin(stops),
    )
    return F.trim(F.regexp_replace(F.array_join(kept, " "), NOT_LETTERS, ""))


def alpha_only(text: Column) -> Column:
    """Drop everything but letters and blanks; case and stop words stay."""
    return F.trim(F.regexp_replace(text, NOT_LETTERS, ""))


def word_count(text: Column) -> Column:
    """Number of pieces between single blanks."""
    return F.size(F.split(text, " "))


def phrase_key(phrase: Column) -> Column:
    """The normal form of a stored phrase, by which phrases are compared everywhere."""
    return F.trim(F.lower(F.regexp_replace(phrase, " +", " ")))


def phrase_label(phrases: list[str]) -> str:
    """Several phrases are looked for, and stored, as one, each in title case."""
    return " or ".join(
        " ".join(word if word == "or" else word.capitalize() for word in phrase.lower().split())
        for phrase in phrases
    )


def phrase_label_key(phrases: list[str]) -> str:
    """The normal form of several phrases as one."""
    return phrase_label(phrases).lower()


def text_key(text: Column, ignore_case: bool = False) -> Column:
    """A narrow stand-in for a text, which must not be null, as a group and join key.

    The key is never null.  If it could be, Spark would add a not-null test to each
    join and push it, with the whole cleaning of the text, down to the scan.
    """
    return F.coalesce(F.sha2(F.lower(text) if ignore_case else text, 256), F.lit(""))


def word_list(cleaned: Column) -> Column:
    """Words of a cleaned text.

    The functions below take this list as a column of its own: inside them it is
    looked at many times, and an expression would be worked out anew each time.
    """
    return F.split(cleaned, " +")


def lexicon_score(words: Column, lexicon=W.LEXICON, negators=W.NEGATORS) -> Column:
    """Overall score 0..10 of a word list, -1 when no word is in the lexicon.

    Every term adds its weight to a neutral 5, turned round by a negator right
    before it.  One pass over the words, no join and no shuffle.
    """
    before = F.concat(F.array(F.lit("")), words)
    terms = [term for group in lexicon.values() for term in group]

    def weigh(word: Column, previous: Column) -> Column:
        weight = F.lit(None).cast("int")
        for value, group in lexicon.items():
            weight = F.when(word.isin(group), F.lit(value)).otherwise(weight)
        sign = F.when(previous.isin(negators), -1).otherwise(1)
        return F.when(word.isin(terms), weight * sign)

    return F.aggregate(
        F.zip_with(words, before, weigh),
        F.lit(None).cast("int"),
        lambda total, weight: F.coalesce(total + weight, total, weight),
        lambda total: F.when(total.isNull(), F.lit(schema.UNCLEAR_SCORE)).otherwise(
            F.least(
                F.lit(schema.HIGHEST_SCORE),
                F.greatest(F.lit(schema.LOWEST_SCORE), total + 5),
            )
        ),
    )


def phrase_flag(words: Column, terms: list[str]) -> Column:
    """1 when any word is one of ``terms``, else 0."""
    return F.coalesce(F.exists(words, lambda word: word.isin(terms)), F.lit(False)).cast("int")


def _lookup(word: Column, groups: dict[str, list[str]]) -> Column:
    found = F.lit(None).cast("string")
    for name, terms in groups.items():
        found = F.when(word.isin(terms), F.lit(name)).otherwise(found)
    return found


def aspects(words: Column, nouns=W.ASPECT_NOUNS, praise=W.PRAISE, blame=W.BLAME,
            negators=W.NEGATORS) -> Column:
    """Distinct ``struct(good, aspect)`` hits of a word list.

    An adjective belongs to the noun one or two words before it ("staff was
    great"), else to the noun right after it ("great staff").  A negator right
    before the adjective turns praise into blame and the other way round.
    """
    adjectives = {**praise, **blame}
    every_adjective = sorted({term for terms in adjectives.values() for term in terms})
    places = F.filter(
        F.transform(words, lambda word, i: F.when(word.isin(every_adjective), i)),
        lambda place: place.isNotNull(),
    )

    def hit(place: Column) -> Column:
        return F.struct(
            _lookup(F.get(words, place), adjectives).alias("adjective"),
            F.coalesce(
                _lookup(F.get(words, place - 1), nouns),
                _lookup(F.get(words, place - 2), nouns),
                _lookup(F.get(words, place + 1), nouns),
            ).alias("noun"),
            F.coalesce(F.get(words, place - 1).isin(negators), F.lit(False)).alias("negated"),
        )

    def labelled(found: Column) -> Column:
        negated = found["negated"]
        return F.struct(
            (found["adjective"].isin(list(praise)) != negated).alias("good"),
            F.concat(
                F.when(negated, F.lit("not ")).otherwise(F.lit("")),
                found["adjective"], F.lit(" "), found["noun"],
            ).alias("aspect"),
        )

    found = F.filter(F.transform(places, hit), lambda hit: hit["noun"].isNotNull())
    return F.array_distinct(F.transform(found, labelled))


def sentences(text: Column, limit: int | None = None) -> Column:
    """Letters-only sentences of a text, single blanks, none empty.

    With a ``limit``, longer ones are cut into runs of at most so many words.
    """
    pieces = F.transform(
        F.split(text, SENTENCE_END),
        lambda piece: F.regexp_replace(alpha_only(piece), " +", " "),
    )
    found = F.filter(pieces, lambda piece: piece != "")
    if limit is None:
        return found

    def runs(piece: Column) -> Column:
        words = F.split(piece, " ")
        starts = F.sequence(F.lit(1), F.size(words), F.lit(limit))
        return F.transform(starts, lambda start: F.array_join(F.slice(words, start, limit), " "))

    return F.flatten(F.transform(found, runs))
