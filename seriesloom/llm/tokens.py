"""Token ids of whole texts under a public byte-level BPE vocabulary (problem 6).

A sentencepiece BPE model is serialised directly from the ranks: each token's
bytes become characters by a fixed one-to-one mapping, its score is its negative
rank, and normalisation is the identity. Merging the best-scored pair first is
then the same as merging the lowest rank first. Texts are cut into pre-tokens by
the vocabulary's pattern and each distinct pre-token is encoded once per worker.

The model is bounded by the vocabulary (about 1 MB) and travels with the code.
There is no exchange; the scan reads the id and the text only.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pattern of this vocabulary's pre-tokens (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces of text kept per worker, of 16 characters on average; beyond it the memory is emptied, with the same results.
MEMORY = 300_000


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where printable, else one from U+0100 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in the order of their ranks, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes | None] = [None] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    if any(x is None for x in out):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return out  # type: ignore[return-value]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, b: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(b)) + b


def serialise_model(ranks: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; one unknown piece follows them."""
    alphabet = byte_alphabet()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _bytes(1, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    body = b"".join(piece("".join(alphabet[b] for b in t), -float(i), 1) for i, t in enumerate(ranks))
    unknown = piece("⁇", 0.0, 2)  # outside the byte alphabet, so no text has it
    trainer = _number(3, 2) + _number(40, len(ranks)) + b"".join(_number(f, -1) for f in (41, 42, 43)) + _bytes(45, "⁇".encode())
    normalizer = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return body + unknown + _bytes(2, trainer) + _bytes(3, normalizer)


#: White space as the pattern has it, but for the plain space (fixed values).
_OTHER_SPACE = "\t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BESIDE_SPACE = ("  ", *(" " + c for c in _OTHER_SPACE), *(c + " " for c in _OTHER_SPACE))


class Encoder:
    """Encodes and decodes texts with a serialised model.

    A single space between two characters that are no white space always begins a
    pre-token. Texts with only such spaces are cut there, and each distinct cut is
    split by the pattern and encoded once; other texts are split as a whole.
    """

    def __init__(self, model: bytes, pattern: str = PATTERN):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        self.plain = pattern == PATTERN
        self.alphabet = byte_alphabet()
        self.to_byte = {c: b for b, c in enumerate(self.alphabet)}
        self.latin = {b: c for b, c in enumerate(self.alphabet)}
        self.known: dict[str, tuple[int, ...]] = {}
        self.cuts: dict[str, tuple[int, ...]] = {}
        self.size = 0

    def learn(self, tokens: Iterable[str]) -> None:
        missing = [t for t in tokens if t not in self.known]
        if not missing:
            return
        # each byte is read as the character of its number, then mapped in one pass
        mapped = [t.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.latin) for t in missing]
        self.known.update(zip(missing, map(tuple, self.sp.encode(mapped, num_threads=1))))
        self.size += 2 * sum(map(len, missing))  # as much again for the cuts they are in

    def pieces(self, text: str | None) -> Iterable[tuple[int, ...]]:
        """The ids of a text in consecutive tuples."""
        if not text:
            return ()
        if len(self.known) + len(self.cuts) > MEMORY or self.size > 16 * MEMORY:
            self.known.clear()
            self.cuts.clear()
            self.size = 0
        if not self.plain or any(x in text for x in _BESIDE_SPACE) or text[0] == " " or text[-1] == " ":
            tokens = self.find(text)
            self.learn(set(tokens))
            return map(self.known.__getitem__, tokens)
        words = text.split(" ")
        first = self.find(words[0])
        rest = words[1:]
        missing = [(w, self.find(" " + w)) for w in set(rest) if w not in self.cuts]
        self.learn({t for _, ts in missing for t in ts} | set(first))
        for w, ts in missing:
            self.cuts[w] = tuple(chain.from_iterable(map(self.known.__getitem__, ts)))
        return chain(map(self.known.__getitem__, first), map(self.cuts.__getitem__, rest))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.pieces(text)))

    def count(self, text: str | None) -> int:
        return sum(map(len, self.pieces(text)))

    def decode(self, ids: Iterable[int]) -> str:
        text = "".join(self.sp.id_to_piece(list(map(int, ids))))
        return bytes(self.to_byte[c] for c in text).decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def encoder_of(model: bytes) -> Encoder:
    """This process's encoder for a model; made once."""
    key = hash(model)
    if key not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """`key, ids array<int>`: the ids of each row's whole text, without special tokens.

    Null and empty texts have an empty list. What looks like a special token is
    ordinary text. Rows are kept as they are, repeated or null keys included;
    other columns are not read.
    """
    model = serialise_model(read_ranks(vocabulary))
    rows = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        for batch in batches:
            ends, parts = [0], []
            for t in batch.column(1).to_pylist():
                ids = encoder.encode(t)
                parts.append(np.array(ids, dtype=np.int32))
                ends.append(ends[-1] + len(ids))
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_ids(rows: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """`key, text string`: the inverse of encode_texts(); null ids give a null text."""
    model = serialise_model(read_ranks(vocabulary))
    given = rows.select(F.col(key).alias("__key"), F.col(ids).cast("array<int>").alias("__ids"))
    kind = given.schema["__key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    ship(given.sparkSession)
    return given.mapInArrow(run, f"`{key}` {kind}, text string")


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """The columns `keep` and the number of tokens of each text (0 for null and empty ones)."""
    model = serialise_model(read_ranks(vocabulary))
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        for batch in batches:
            n = pa.array([encoder.count(t) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], names=[*keep, name])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, f"{kinds}, `{name}` long")
