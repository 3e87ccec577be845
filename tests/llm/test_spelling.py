import zlib
from collections import Counter
import re

import pytest

from reviewloom.llm import spelling as S
from reviewloom.llm.borders import borders, common


def counted(rows):
    """Words of (id, text) rows as the contract tells them."""
    counts = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(S.CAPITALS, S.SMALL))
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 97 == 0:
                place = h % len(run)
                run = run[:place] + run[place + 1 :]
            counts[run] += 1
    return {word: n for word, n in counts.items() if len(word) >= 5 and n >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(words):
    forms, out = {}, {}
    for word, n in words.items():
        close = [other for other in words if near(word, other)]
        best = min(close, key=lambda other: (-words[other], other), default=None)
        if best is not None and words[best] >= 2 * n:
            forms[word] = best
        out[word] = len(close)
    lines = []
    for word, n in words.items():
        root = word
        while root in forms:
            root = forms[root]
        form = forms.get(word)
        lines.append((word, form, root, n, out[word], words[form] if form is not None else None))
    return sorted(lines)


def grouped(spark, words, **settings):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    found = S.group_variants(df, **settings).select("word", "form", "root", "n", "n_near", "form_n")
    return sorted(tuple(row) for row in found.collect())


WORDS = {
    "aaaaa": 40, "aaaa": 20, "aaaaaa": 10, "aabaa": 5, "abaaa": 5, "baaaa": 100, "aaaab": 3, "x": 1, "xy": 2, "y": 2, "": 9,
    "words": 64, "wordz": 32, "word": 16, "sword": 8, "swordz": 4, "wrods": 3, "wordss": 64, "übel": 3, "ubel": 6, "über": 6,
    "😀mile": 2, "😁mile": 4, "mile": 8, "mile": 4,
}


@pytest.mark.parametrize("shard", [1, 2, 3, 7, 1000])
def test_groups_in_any_number_of_shards(spark, shard):
    assert grouped(spark, WORDS, shard_words=shard) == brute(WORDS)


def test_random_words_over_few_letters(spark):
    import random

    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(0, 7))): rng.choice([1, 1, 2, 4, 4, 8, 30]) for _ in range(500)}
    assert grouped(spark, words, shard_words=40) == brute(words)


def test_long_words_and_chains(spark):
    long = "ab" * 3000
    words = {long: 4, long + "b": 8, long[:1000] + long[1001:]: 2, long[:1000] + "z" + long[1001:]: 1, **{"chain" + "x" * i: 2 ** (i + 1) for i in range(20)}}
    assert grouped(spark, words, shard_words=2) == brute(words)


def test_words_of_documents(spark, documents):
    texts = [(i % 40 if i % 9 else None, f"Colour COLOR colours× naÏve naïve word{i}word colourr " * 3) for i in range(300)]
    texts += [(1, None), (2, ""), (3, "123 ??"), (4, "x" * 200_000 + " " + "colour " * 5000), (4, "x" * 200_000), (4, "x" * 200_000)]
    docs = documents(texts, extra="word n id run key shard place")
    words = {row["word"]: row["n"] for row in S.count_words(docs).collect()}
    assert words == counted(texts)
    found = S.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(tuple(row) for row in found.collect()) == brute(counted(texts))


def test_nothing_frequent(spark, documents):
    assert S.spelling_variants(documents([(1, "single words only")])).isEmpty()
    assert S.spelling_variants(documents([(1, None)]).where("false")).isEmpty()


def test_borders_name_each_shared_prefix_once():
    keys = sorted(["a", "ab", "abc", "abcd", "abd", "abda", "b", "ba", "bab", "babb"])
    for size in (1, 2, 3):
        shards = [keys[i : i + size] for i in range(0, len(keys), size)]
        known = borders((10 * i, shard[0], shard[-1]) for i, shard in enumerate(shards))
        for i, shard in enumerate(shards):
            own = known[10 * i]
            for depth, owner in enumerate(own.before_owners, 1):
                first = next(j for j, other in enumerate(shards) if any(key.startswith(shard[0][:depth]) for key in other))
                assert owner == 10 * first
            assert len(own.before) == (common(shards[i - 1][-1], shard[0]) if i else 0) == len(own.before_owners)


def test_common():
    assert [common(*pair) for pair in (("", ""), ("a", ""), ("abc", "abd"), ("ab", "abc"), ([1, 2], [1, 3]), ("xa", "ya"))] == [0, 0, 2, 2, 1, 0]
