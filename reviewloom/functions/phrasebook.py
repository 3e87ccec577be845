"""Many phrases at once: an automaton over words that finds all of them in one pass over a text."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions import words as W
from reviewloom.functions.text import phrase_label


def cleaned_words(text: str, stops: list[str] | None = None) -> list[str]:
    """The words that cleaning leaves of a text, as the column function does it."""
    stops = set(W.stop_words() if stops is None else stops)
    kept = " ".join(word for word in text.lower().split() if word not in stops)
    return re.sub("[^a-zA-Z ]+", "", kept).split()


@dataclass
class _Node:
    next: dict[int, int] = field(default_factory=dict)
    back: int = 0
    found: set[int] = field(default_factory=set)


class PhraseBook:
    """Numbered phrases, each with the word sequences that show it is being discussed.

    A phrase has the sequences of its synonyms, or else its own words, in their order.  Both are
    cleaned as texts are.  Phrases are told apart in their normal form; one that is listed twice counts once, and one
    of which cleaning leaves no word raises.
    """

    def __init__(self, phrases: list[str], synonyms=W.PHRASE_SYNONYMS, stops: list[str] | None = None):
        known = {" ".join(phrase.lower().split()): terms for phrase, terms in synonyms.items()}
        self.labels = list(dict.fromkeys(phrase_label([phrase]) for phrase in phrases))
        self.words: dict[str, int] = {}
        self._nodes = [_Node()]
        for number, label in enumerate(self.labels):
            sequences = [cleaned_words(term, stops) for term in known.get(label.lower(), [label])]
            if not any(sequences):
                raise ValueError(f"no words left of {label!r}")
            for sequence in filter(None, sequences):
                self._add(sequence, number)
        self._link()

    def _add(self, sequence: list[str], number: int) -> None:
        at = 0
        for word in sequence:
            code = self.words.setdefault(word, len(self.words) + 1)
            if code not in self._nodes[at].next:
                self._nodes.append(_Node())
                self._nodes[at].next[code] = len(self._nodes) - 1
            at = self._nodes[at].next[code]
        self._nodes[at].found.add(number)

    def _link(self) -> None:
        """Where to go on after a mismatch: the longest suffix that begins another sequence."""
        queue = deque(self._nodes[0].next.values())
        while queue:
            at = queue.popleft()
            for code, child in self._nodes[at].next.items():
                back = self._nodes[at].back
                while back and code not in self._nodes[back].next:
                    back = self._nodes[back].back
                self._nodes[child].back = self._nodes[back].next.get(code, 0)
                self._nodes[child].found |= self._nodes[self._nodes[child].back].found
                queue.append(child)

    def find(self, codes: list[int]) -> set[int]:
        """Phrases in a sequence of word numbers, 0 for words that are in no phrase."""
        nodes, at, found = self._nodes, 0, set()
        for code in codes:
            if not code:
                at = 0
                continue
            while at and code not in nodes[at].next:
                at = nodes[at].back
            at = nodes[at].next.get(code, 0)
            found |= nodes[at].found
        return found

    def _lists(self, texts: pa.Array) -> pa.Array:
        flat = texts.flatten().dictionary_encode()
        known = np.array([0, *(self.words.get(word, 0) for word in flat.dictionary.to_pylist())])
        codes = known[flat.indices.fill_null(-1).to_numpy(zero_copy_only=False) + 1]
        sizes = texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        found = [sorted(self.find(part.tolist())) if part.any() else [] for part in (codes[a:b] for a, b in zip(ends - sizes, ends))]
        return pa.array(found, pa.list_(pa.int32()))

    def phrases_in(self, words: Column) -> Column:
        """Numbers of the phrases in a word list: array<int>, sorted, empty for none or null.

        The book goes to the tasks inside the function; its size is that of the phrases given.
        """

        @F.arrow_udf("array<int>")
        def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield self._lists(batch)

        return search(words)
