import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from reviewloom.llm import repeats as R
from reviewloom.llm.bytespans import cut_spans, merged, numbered, with_spans


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(words))


def brute(rows, length=R.LENGTH):
    bodies = [(text or "").encode() for _, text in rows]
    seen = Counter(body[i : i + length] for body in bodies for i in range(len(body) - length + 1))
    out = []
    for (id_, _), body in zip(rows, bodies, strict=True):
        gone = np.zeros(len(body), bool)
        for i in range(len(body) - length + 1):
            if seen[body[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        kept = bytes(np.frombuffer(body, np.uint8)[~gone])
        out.append((id_, len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df, hot=R.HOT):
    texts = numbered(df, "doc_id", "text")
    cut = cut_spans(with_spans(texts, merged(R.repeated_spans(texts, hot=hot))))
    return sorted(((*tuple(row)[:4], hashlib.sha256(bytes(row.kept)).hexdigest()) for row in cut.collect()), key=repr)


def corpus():
    passage, line = prose(1, 70), prose(2, 60)
    rows = [(i, f"{prose(10 + i, 30)} {passage[i % 7 :]} {prose(300 + i, 20)}" if i % 2 else prose(600 + i, 60)) for i in range(40)]
    rows += [(50, f"{line}\n{line}\n{line}"), (51, None), (52, ""), (53, "x" * 199), (54, "y" * 200), (55, "y" * 200), (56, "z" * 700)]
    rows += [(57, rows[0][1]), (57, rows[0][1]), (None, passage), (58, "é" * 150), (59, "a" + "é" * 150), (60, passage[:199]), (61, passage[3:203])]
    return rows


def test_repeats(documents):
    rows = corpus()
    assert found(documents(rows, "rk name content body")) == brute(rows)


@pytest.mark.parametrize("hot", [1, 4])
def test_hot_names_are_split(documents, hot):
    rows = corpus()[:30]
    assert found(documents(rows), hot) == brute(rows)


def test_remove_repeats(documents):
    assert R.remove_repeats(documents([])).collect() == []
    row = R.remove_repeats(documents([(1, "q" * 300)])).collect()[0]
    assert (row.doc_id, row.n_bytes, row.n_removed, row.n_spans, bytes(row.kept)) == (1, 300, 300, 1, b"")


def test_index_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        text = np.array([rng.randint(0, 2) for _ in range(rng.randint(1, 60))] + [0], dtype=np.int64)

        def common(a, b, text=text):
            k = 0
            while a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            return k

        index = R.RunIndex(text)
        want = [max((common(i, j) for j in range(len(text)) if j != i), default=0) for i in range(len(text))]
        assert index.matching_statistics().tolist() == want


def test_runs_stay_few_in_repetitive_texts():
    once = np.frombuffer(prose(5, 300).encode(), np.uint8).astype(np.int64) + 1
    assert R.RunIndex(np.concatenate([np.tile(once, 30), [0]])).runs < 1.2 * R.RunIndex(np.concatenate([once, [0]])).runs + 30


def test_parts_hold_every_stretch_once(monkeypatch):
    body = prose(6, 800).encode() + b"a" * 900
    for piece in (1 << 22, 777):
        monkeypatch.setattr(R, "PIECE", piece)
        parts = R.cut_parts(body, 200)
        starts = np.concatenate([np.arange(s, s + n) for s, n in zip(parts["start"], parts["n"], strict=True)])
        assert sorted(starts.tolist()) == list(range(len(body) - 199))
        assert ((0 <= parts["distance"]) & (parts["distance"] <= 200 - R.KEY)).all()
