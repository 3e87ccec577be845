"""Byte-level BPE with a sentencepiece model written straight from a rank file.

The model is serialised here, piece by piece: every token's bytes are mapped to one character
each (byte b to the code point 256 + b), its score is the negative rank, and normalisation is
the identity without white space handling.  The best pair by score is then the pair of lowest
rank, the leftmost on ties, as in the merge order of the rank file, and ids are ranks.
A text is cut into pre-tokens by the tokenizer's pattern, each encoded separately;
decoding maps pieces back to bytes.

Defined cases: a null text is empty and has no ids; special tokens are ordinary text; a text
of any length is encoded whole; ids decode to the exact bytes; an id without a piece, or a
null id, raises.
"""

from __future__ import annotations

import base64
import codecs
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Character of a byte: any 256 code points that sentencepiece leaves alone.
FIRST = 0x100
MAPPED = "".join(chr(FIRST + byte) for byte in range(256))

# Bytes of chunks and their ids that a Python worker remembers; beyond that it starts anew.
CACHE = 48 << 20
# What a chunk takes besides its characters and ids: two objects and their place in the dictionary.
CHUNK_COST = 200
# Bytes of text that are encoded, decoded and passed on at a time, unless one text alone has more.
PORTION = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, content: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(content)) + content


def _piece(text: str, score: float, kind: int) -> bytes:
    score_field = _varint(2 << 3 | 5) + struct.pack("<f", score)
    return _block(1, _block(1, text.encode()) + score_field + _number(3, kind))


def to_chars(data: bytes) -> str:
    return codecs.charmap_decode(data, "strict", MAPPED)[0]


def to_bytes(chars: str) -> bytes:
    return bytes(ord(char) - FIRST for char in chars)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model of the vocabulary, in the wire format of its public schema.

    Fields: pieces (1: piece, score, type), trainer (2), normaliser (3).  Piece types are
    normal (1) and unknown (2); model type 2 is BPE.  All 256 bytes have to be tokens, and
    ranks have to run from 0 without gaps, so that the place of a piece is its rank.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[token] for token in tokens] != list(range(len(tokens))):
        raise ValueError("ranks have to run from 0 without gaps")
    if any(bytes([byte]) not in ranks for byte in range(256)):
        raise ValueError("the vocabulary lacks single bytes")
    pieces = b"".join(_piece(to_chars(token), -float(rank), 1) for rank, token in enumerate(tokens))
    unknown = _piece("<unk>", 0.0, 2)
    absent = (1 << 64) - 1  # -1: the model has no such token
    trainer = _number(3, 2) + _number(40, len(tokens)) + b"".join(_number(field, absent) for field in (41, 42, 43))
    # No dummy prefix (3), no removed (4) and no escaped (5) white space.
    normaliser = _block(1, b"identity") + b"".join(_number(field, 0) for field in (3, 4, 5))
    return pieces + unknown + _block(2, trainer) + _block(3, normaliser)


class Encoder:
    """Ids of whole texts, with the ids of chunks seen before at hand.

    A space before a character that is no white space always starts a pre-token, and
    what stands before it never looks past it.  So texts are cut at such spaces first, and
    the pattern and the model only see chunks that are new.
    """

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self._bpe = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._split = regex.compile(pattern).findall
        self._known: dict[str, bytes] = {}  # 32-bit ids of a chunk, by the chunk without its space
        self._held = 0

    def _words(self, words: list[str]) -> tuple[bytes, np.ndarray]:
        """Packed ids of pre-tokens, each encoded for itself, and where each one's start."""
        # No UTF-8 text holds the byte 255, so it can part the words while they are mapped.
        chars = to_chars(b"\xff".join(map(str.encode, words))).split(MAPPED[255]) if words else []
        ids = self._bpe.encode(chars, num_threads=1) if chars else []
        ends = np.cumsum([0, *map(len, ids)])
        return np.fromiter(chain.from_iterable(ids), np.int32, ends[-1]).tobytes(), ends * 4

    def _learn(self, chunks: list[str]) -> None:
        words = self._split(" " + " ".join(chunks))
        packed, places = self._words(words)
        begins = np.cumsum([0, *map(len, words)])  # characters; most chunks have one byte for each
        first = np.searchsorted(begins, np.cumsum([0, *(len(chunk) + 1 for chunk in chunks)]))
        cuts = places[first].tolist()
        self._known.update((chunk, packed[i:j]) for chunk, i, j in zip(chunks, cuts, cuts[1:], strict=False))
        self._held += len(packed) + begins[-1] + len(chunks) * CHUNK_COST

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        starts, rests, new = [], [], set()
        for text in texts:
            first, *rest = text.split(" ")
            unseen = set(rest).difference(self._known)
            if any(not part or part[0].isspace() for part in unseen):
                first, rest = self._merged(first, rest)
                unseen = set(rest).difference(self._known)
            new |= unseen
            starts.append(self._split(first))
            rests.append(rest)
        if self._held > CACHE:
            self._known.clear()
            self._held = 0
            new = set(chain.from_iterable(rests))
        if new:
            self._learn(list(new))
        packed, places = self._words(list(chain.from_iterable(starts)))
        cuts = places[np.cumsum([0, *map(len, starts)])].tolist()
        ids_of = self._known.__getitem__
        return [
            np.frombuffer(packed[i:j] + b"".join(map(ids_of, rest)), np.int32)
            for i, j, rest in zip(cuts, cuts[1:], rests, strict=False)
        ]

    @staticmethod
    def _merged(first: str, rest: list[str]) -> tuple[str, list[str]]:
        """Parts that begin with white space joined to the one before."""
        groups = [[first]]
        for part in rest:
            if part and not part[0].isspace():
                groups.append([part])
            else:
                groups[-1].append(part)
        first, *rest = [" ".join(group) for group in groups]
        return first, rest


def _portions(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in turn, as slices of a few megabytes."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)), dtype=np.int64)
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + PORTION, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def _texts(portion: pa.Array) -> list[str]:
    return [text or "" for text in portion.to_pylist()]


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *values])))


class Decoder:
    """Bytes of ids, by the inverse mapping of the model's pieces."""

    def __init__(self, model: bytes):
        import sentencepiece

        bpe = sentencepiece.SentencePieceProcessor(model_proto=model)
        # The last piece stands for unknown input and has no bytes.
        pieces = [to_bytes(bpe.id_to_piece(i)) for i in range(bpe.get_piece_size() - 1)]
        self._lengths = np.array([len(piece) for piece in pieces])
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._data = np.frombuffer(b"".join(pieces), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, a portion of them at a time."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self._lengths)):
            raise ValueError("an id has no piece")
        return b"".join(self._portion(ids[a : a + PORTION // 4]) for a in range(0, len(ids), PORTION // 4))

    def _portion(self, ids: np.ndarray) -> bytes:
        size = self._lengths[ids]
        first = np.cumsum(size) - size
        return self._data[np.repeat(self._starts[ids] - first, size) + np.arange(size.sum())].tobytes()


@lru_cache(maxsize=2)
def _encoder(model: bytes, pattern: str) -> Encoder:
    """One for each Python worker, so that later tasks find what earlier ones have learnt."""
    return Encoder(model, pattern)


@lru_cache(maxsize=2)
def _decoder(model: bytes) -> Decoder:
    return Decoder(model)


class Codec:
    """The model as a session's broadcast, and what encodes and decodes with it."""

    def __init__(self, spark: SparkSession, rank_path: str, pattern: str):
        # Bounded by the vocabulary: about 1 MB for 50,000 tokens.
        self._model = spark.sparkContext.broadcast(serialise(read_ranks(rank_path)))
        self._pattern = pattern

    def encode(self, text: Column) -> Column:
        """Ids of a text: array<int>, empty for null."""
        model, pattern = self._model, self._pattern

        @F.arrow_udf("array<int>")
        def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = _encoder(model.value, pattern)
            for batch in texts:
                yield _lists([ids for portion in _portions(batch) for ids in encoder(_texts(portion))])

        return encode(text)

    def decode(self, ids: Column) -> Column:
        """Bytes of an array of ids: binary, empty for null."""
        model = self._model

        @F.arrow_udf("binary")
        def decode(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
            decoder = _decoder(model.value)
            for batch in lists:
                yield pa.array([decoder(np.asarray(value.values if value.is_valid else [], dtype=np.int64)) for value in batch], pa.binary())

        return decode(ids)

    def round_trip(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """``id, ids, decoded`` of every row: both ways in one Python worker, a portion of a batch at a time."""
        model, pattern = self._model, self._pattern

        def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder, decoder = _encoder(model.value, pattern), _decoder(model.value)
            for batch in batches:
                at = 0
                for portion in _portions(batch.column("text")):
                    ids = encoder(_texts(portion))
                    own = batch.column("id").slice(at, len(portion))
                    at += len(portion)
                    yield pa.RecordBatch.from_arrays([own, _lists(ids), pa.array([decoder(value) for value in ids], pa.binary())], names=["id", "ids", "decoded"])

        rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
        return rows.mapInArrow(both, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded binary")
