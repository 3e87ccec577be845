import random

import numpy as np

from reviewloom.llm import chunk_dedup as C


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(words))


def test_gear_hash_is_the_rolling_one():
    data = np.frombuffer(prose(1, 50).encode(), np.uint8)
    value, want = 0, []
    for byte in data:
        value = ((value << 1) + int(C._gear()[byte])) & 0xFFFFFFFF
        want.append(value)
    assert C.gear_hashes(data).tolist() == want
    assert C.gear_hashes(np.zeros(0, np.uint8)).tolist() == []


def test_chunks_cover_texts_and_survive_insertions(monkeypatch):
    text = prose(2, 2000).encode()
    for body in (b"", b"a", b"a" * 5000, text):
        ends = C.chunk_ends(body)
        assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == len(body)
        sizes = np.diff([0, *ends])
        assert all(C.MIN <= size <= C.MAX for size in sizes[:-1])
    cut = lambda body: {body[a:b] for a, b in zip([0, *C.chunk_ends(body)], C.chunk_ends(body), strict=False)}
    own = cut(text)
    moved = cut(text[:5000] + b"inserted" + text[5000:])
    assert len(own - moved) <= 4
    whole = C.chunk_ends(text)
    monkeypatch.setattr(C, "PIECE", 100)
    assert C.chunk_ends(text) == whole


def brute(rows, min_run=C.MIN_RUN):
    """Sizes of what remains, with runs kept by (id, place) of their first occurrence."""
    first, cut = {}, {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for i in order:
        body = (rows[i][1] or "").encode()
        gone = bytearray(len(body))
        ends = C.chunk_ends(body)
        for lo in [0, *ends[:-1]]:
            hi = next((end for end in ends if end - lo >= min_run), None)
            if hi is not None and first.setdefault(body[lo:hi], (i, lo)) != (i, lo):
                gone[lo:hi] = b"x" * (hi - lo)
        rest = bytes(byte for byte, out in zip(body, gone, strict=True) if not out)
        spans = sum(bool(out) and (k == 0 or not gone[k - 1]) for k, out in enumerate(gone))
        cut[i] = (len(body), len(body) - len(rest), spans, rest)
    return sorted(((rows[i][0], *cut[i]) for i in cut), key=repr)


def test_what_goes_stands_together_elsewhere():
    """Single chunks that repeat in different places are not put together to a run."""
    pieces = [prose(300 + k, 5)[:30] for k in range(40)]
    rng = random.Random(8)
    texts = [" ".join(rng.sample(pieces, 12)) for _ in range(60)]
    copied = prose(7, 60)
    texts += [f"{prose(401, 30)} {copied} {prose(402, 30)}", f"{prose(403, 30)} {copied} {prose(404, 30)}"]
    bodies = [text.encode() for text in texts]
    first = {}
    for i, body in enumerate(bodies):
        for lo, hi in C.runs(C.chunk_ends(body), C.MIN_RUN):
            assert hi - lo >= C.MIN_RUN
            if first.setdefault(body[lo:hi], i) != i:
                assert body[lo:hi] in bodies[first[body[lo:hi]]] and i == 61
    assert not list(C.runs([], 10)) and not list(C.runs([9], 10)) and list(C.runs([9, 10], 10)) == [(0, 10)]


def test_passages_go_and_clean_texts_stay(documents):
    passage = prose(9, 60)
    rows = [(i, f"{prose(100 + i, 80)} {passage} {prose(200 + i, 50)}" if i % 3 == 0 else prose(100 + i, 120)) for i in range(30)]
    rows += [(50, None), (51, ""), (52, rows[4][1]), (None, rows[4][1]), (53, "é" * 3000)]
    found = [tuple(row) for row in C.chunk_dedup(documents(rows, "rk lo hi id spans")).collect()]
    found = sorted(((*row[:4], bytes(row[4])) for row in found), key=repr)
    assert found == brute(rows)
    removed = {row[0]: row[2] for row in found}
    assert all(removed[i] > 0.5 * len(passage) for i in range(3, 30, 3))
    assert all(removed[i] == 0 for i in range(30) if i % 3 and i != 4) and removed[0] == 0


def test_no_rows(documents):
    assert C.chunk_dedup(documents([])).collect() == []


def test_recall_of_passages_of_51_to_60_words(documents):
    """Every passage that repeats in another context is found, and most of it goes."""
    passages = [prose(5000 + k, 51 + k % 10) for k in range(400)]
    rows = [(i, f"{prose(10_000 + i, 30)} {passages[i % 400]} {prose(20_000 + i, 30)}") for i in range(800)]
    removed = {row.doc_id: row.n_removed for row in C.chunk_dedup(documents(rows)).collect()}
    assert all(removed[i] == 0 for i in range(400))
    shares = [removed[400 + k] / len(passages[k]) for k in range(400)]
    assert min(shares) > 0 and sum(shares) / len(shares) > 0.7
