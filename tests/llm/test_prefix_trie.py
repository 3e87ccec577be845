import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from reviewloom.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuild(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, digest, (role, text)))
    turns = {conv: [turn for *_, turn in sorted(listed)] for conv, listed in own.items()}
    out = {}
    for conv, listed in turns.items():
        h = zlib.crc32(str(conv).encode()) % 4
        leader = conv - (abs(conv) % 20) * (1 if conv > 0 else -1)
        out[conv] = turns.get(leader, [])[:h] + listed[h:]
    return out


def brute(convs):
    members, ends, below = defaultdict(set), defaultdict(list), defaultdict(set)
    for conv, turns in convs.items():
        ends[tuple(turns)].append(conv)
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].add(conv)
            if depth:
                below[tuple(turns[: depth - 1])].add(tuple(turns[:depth]))
    out = []
    for node, held in members.items():
        inside = [other for other in members if other[: len(node)] == node]
        saved = sum((len(members[other]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", other[-1][1])) for other in inside if other)
        text = ",".join(map(str, sorted(ends.get(node, []))))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(below[node]), sum(not below[other] for other in inside), saved, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(row) for row in df.select(COLUMNS).collect()), key=repr)


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "conv_id AS conv", "text AS seq", "turn AS pos", "role AS shared").repartition(parts)


def random_rows(seed, convs, choices, most):
    rng = random.Random(seed)
    return [
        (conv, turn, rng.choice(["user", "assistant"]), f"words {rng.randrange(choices)} and more"[: rng.choice([0, 9, 30])])
        for conv in range(-convs // 3, convs) if rng.random() < 0.9 for turn in range(rng.randrange(most))
    ]


def test_random_conversations(spark):
    rows = random_rows(1, 150, 2, 7)
    rows += [(7, None, None, None), (7, None, "user", None), (8, 1, "user", "  "), (8, 1, "user", "  "), (None, 1, "user", "of none"), (8, 1, "a", "b\tc\x0bd e")]
    assert found(P.conversation_trie(table(spark, rows))) == brute(rebuild(rows))


def sequences(spark, convs):
    """Rows of ``rebuilt`` for given conversations of (role, text)."""
    ids = {turn: i * 7 % 1000 for i, turn in enumerate(sorted({turn for turns in convs.values() for turn in turns}))}
    rows = [(conv, 1, i, ids[turn], len(turn[1].split())) for conv, turns in convs.items() for i, turn in enumerate(turns)]
    rows += [(conv, 2, None, None, None) for conv in convs]
    return spark.createDataFrame(rows, "conv long, part int, pos long, tid long, words long").repartition(3)


@pytest.mark.parametrize("shard_turns", [1, 5, 23, 10_000])
def test_shards_of_any_size(spark, shard_turns):
    """Shards of single sequences share whole paths, also over several shards."""
    rng = random.Random(shard_turns)
    convs = {}
    for conv in range(120):
        depth = rng.randrange(6)
        convs[conv] = [("u", "x " * (d + 1)) for d in range(depth)] + [("a", f"y{rng.randrange(2)} z") for _ in range(rng.randrange(3))]
    convs |= {500 + i: [("u", "x")] * i for i in range(30)}  # each a prefix of the next
    assert found(P.prefix_trie(P.distinct_sequences(sequences(spark, convs)), shard_turns)) == brute(convs)


def test_many_members_of_one_sequence(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE_IDS", 50)
    convs = {conv: [("u", "same"), ("a", "same again")] for conv in range(3000)} | {9000 + i: [] for i in range(700)}
    got = found(P.prefix_trie(P.distinct_sequences(sequences(spark, convs))))
    text = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == sorted([(0, 0, None, 3700, 1, 1, 2999 * 3, text(range(9000, 9700))), (0, 1, 0, 3000, 1, 1, 2999 * 3, P.NO_ENDS), (0, 2, 0, 3000, 0, 1, 2999 * 2, text(range(3000)))], key=repr)


def test_long_conversation_and_long_text(spark):
    rows = [(20, i, "user", f"turn {i % 7}") for i in range(1500)] + [(21, i, "user", f"turn {i % 7}") for i in range(1400)] + [(22, 0, "user", "word " * 100_000)]
    convs = rebuild(rows)
    got = found(P.conversation_trie(table(spark, rows)))
    assert len(got) == len({tuple(turns[:d]) for turns in convs.values() for d in range(len(turns) + 1)})
    root = next(row for row in got if row[1] == 0)
    assert root[3] == 3 and root[2] is None


def test_nothing_and_only_turnless(spark):
    assert P.conversation_trie(table(spark, [(1, 1, "u", "x")]).where("false")).isEmpty()
    conv = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert found(P.conversation_trie(table(spark, [(conv, 0, "u", "x"), (None, 0, "u", "y")]))) == brute({conv: []})


def test_medians():
    assert sorted(P._medians(10)) == list(range(10)) and list(P._medians(3))[0] == 1 and list(P._medians(0)) == []
