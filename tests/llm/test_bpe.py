import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from reviewloom.llm import bpe
from reviewloom.llm.queries import bpe_digests, byte_codec

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [
    "", " ", "  a", "a ", "\n a", "a \n b  c   d\t e", "x\x1c y\x85z", "日本語 テスト", "½ ² Ⅷ", "\x00 a\x00", "a" * 5000, " " * 3000,
    "it's we'll <|endoftext|>", "\U0001f937\U0001f3fd", "Ere. " * 4000, "né ​  b",
]


def test_ids_are_those_of_the_rank_file():
    encoder = bpe.Encoder(bpe.serialise(RANKS), public_tokenizers.PATTERN)
    edges = [f"{a}{chr(c)}a {chr(c)}{chr(c)} 1{chr(c)}  b" for a in ("", " ") for c in [*range(1, 0x500), *range(0x2000, 0x2100), 0x3000]]
    for text, ids in zip(TEXTS + edges, encoder(TEXTS + edges), strict=True):
        assert ids.tolist() == TIKTOKEN.encode_ordinary(text), repr(text)


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 600)
    encoder = bpe.Encoder(bpe.serialise(RANKS), public_tokenizers.PATTERN)
    for _ in range(3):
        assert encoder(["a b c d e f g"])[0].tolist() == TIKTOKEN.encode_ordinary("a b c d e f g")


def test_vocabularies_without_all_bytes_are_refused():
    with pytest.raises(ValueError):
        bpe.serialise({bytes([b]): b for b in range(255)})
    with pytest.raises(ValueError):
        bpe.serialise({bytes([b]): b + 1 for b in range(256)})


def test_digests(spark, documents):
    rows = [(i, text) for i, text in enumerate([*TEXTS, None, TEXTS[-1]])] + [(None, "null id")]
    found = bpe_digests(documents(rows, "ids decoded n_tokens"))
    got = {(row.doc_id, row.n_tokens, row.ids_sha256, row.decoded_sha256) for row in found.collect()}
    want = set()
    for i, text in rows:
        ids = TIKTOKEN.encode_ordinary(text or "")
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == want
    assert bpe_digests(documents([])).collect() == []


def test_portions_hold_every_text(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "PORTION", 10)
    for texts in ([], ["a" * 30], ["", None, "abc", "d" * 11, "é" * 5, "e", None]):
        portions = [portion.to_pylist() for portion in bpe._portions(pa.array(texts, pa.string()))]
        assert [text for portion in portions for text in portion] == texts
        assert all(len(portion) == 1 or sum(len((text or "").encode()) for text in portion) <= 10 for portion in portions)


def test_decoding(spark):
    ids = spark.createDataFrame([([15496, 995],), ([],), (None,)], "ids array<int>")
    codec = byte_codec(spark)
    assert [bytes(row[0]) for row in ids.select(codec.decode(F.col("ids"))).collect()] == [b"Hello world", b"", b""]
    with pytest.raises(Exception, match="no piece"):
        spark.createDataFrame([([50256],)], "ids array<int>").select(codec.decode(F.col("ids"))).collect()
