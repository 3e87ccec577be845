"""Word lists: stop words, and the default lexicon, negators, synonyms and aspects."""

from __future__ import annotations

# The usual English stop list (the public NLTK one, 179 words).
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all
any both each few more most other some such no nor not only own same so than too
very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# Stop words that stay in the text, because they carry negation,
# tense or emphasis.
ALLOWED_STOP_WORDS = """
was were not very will don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()


def stop_words(stops=ENGLISH_STOP_WORDS, allowed=ALLOWED_STOP_WORDS) -> list[str]:
    """The stop list less the allowed words."""
    keep = set(allowed)
    return [word for word in stops if word not in keep]


# Default lexicon: weight -> terms.  A weight of 0 is a neutral opinion, which
# still counts as a hit.
LEXICON = {
    2: "amazing brilliant delicious excellent fantastic great outstanding perfect superb wonderful",
    1: "attentive clean cosy enjoyable fresh friendly generous good helpful lovely nice pleasant tasty welcoming",
    0: "average fine okay standard",
    -1: "bad bland cold dear expensive late loud lukewarm noisy overpriced poor slow small",
    -2: "awful dirty disgusting horrible rude terrible worst",
}
LEXICON = {weight: terms.split() for weight, terms in LEXICON.items()}

# Words that turn the next term round, as they look after cleaning.
NEGATORS = """
not never arent couldnt didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt
neednt shant shouldnt wasnt werent wont wouldnt
""".split()

# Phrase -> words that show the phrase is being discussed.  Fixed values: the names of the
# phrases, which stored flags carry; the words are this project's own choice.
PHRASE_SYNONYMS = {
    "Price or Value": "price prices priced value cost costs worth bill",
    "Atmosphere": "atmosphere ambience vibe environment music decor",
    "Food": "food meal meals dish dishes menu starter dessert",
    "Drink": "drink drinks wine beer cocktail cocktails coffee",
    "Staff or Service": "staff service manager waiter waitress bartender team server",
    "Portion Size": "portion portions size serving",
}
PHRASE_SYNONYMS = {phrase: terms.split() for phrase, terms in PHRASE_SYNONYMS.items()}

# Noun of an aspect -> words for it.
ASPECT_NOUNS = {
    "price": PHRASE_SYNONYMS["Price or Value"],
    "atmosphere": PHRASE_SYNONYMS["Atmosphere"],
    "food": PHRASE_SYNONYMS["Food"],
    "drinks": PHRASE_SYNONYMS["Drink"],
    "staff": PHRASE_SYNONYMS["Staff or Service"],
    "portion": PHRASE_SYNONYMS["Portion Size"],
}

# Adjective of an aspect -> words for it, praise and blame apart.
PRAISE = {
    "great": LEXICON[2] + "attentive friendly helpful welcoming".split(),
    "nice": "clean cosy enjoyable fresh generous good lovely nice pleasant tasty".split(),
}
BLAME = {
    "cold": "cold lukewarm".split(),
    "poor": "awful bad bland dirty disgusting horrible poor rude small terrible worst".split(),
    "pricey": "dear expensive overpriced".split(),
    "noisy": "loud noisy".split(),
    "slow": "late slow".split(),
}


def phrase_terms(phrases: list[str], synonyms=PHRASE_SYNONYMS) -> list[str]:
    """Every word that shows one of ``phrases`` is being discussed.

    Phrases are looked up whatever their case and blanks; one without synonyms stands
    for its own words.
    """
    known = {" ".join(phrase.lower().split()): words for phrase, words in synonyms.items()}
    terms: set[str] = set()
    for phrase in phrases:
        words = phrase.lower().split()
        terms.update(known.get(" ".join(words), words))
    return sorted(terms)
