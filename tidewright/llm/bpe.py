"""Byte-level BPE through sentencepiece: a rank file becomes a sentencepiece model, texts become ids and bytes again.

`model_of` writes the model straight from the ranks, without training: a piece per token, its bytes in the
printable alphabet of byte-level vocabularies, scored by its negative rank, in the order of the ranks, so that a
piece's number is the token's id; the normaliser is the identity and adds nothing. Merging the best-scored
neighbours first is then merging the lowest rank first, leftmost first among equals.

A text is split by the vocabulary's pattern; no merge crosses a split. A pre-token that is a token as a whole is
that token, any other goes to sentencepiece. Workers keep the ids of up to KEPT pre-tokens, and of recurring pieces
between single spaces in texts of plain Latin letters; the others are merged anew each time, so the bounds change
no result.

Defined cases: null text is empty and has no ids; null and repeated document ids stay rows of their own; an empty
table gives no rows; other columns are left behind. Texts of any length are encoded whole. Decoding null ids gives
empty bytes; an id outside the vocabulary is an error.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import arrow_rows, ship, text_rows
from tidewright.llm.tokens import BYTE_SPLIT, PLAIN, SPACES_AFTER, Pieces, byte_alphabet

MULTI = "byte_bpe_multi_50k.tiktoken"
KEPT = 500_000
_BATCH = 256

# Field numbers and kinds of the sentencepiece model format.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE, _SCORE, _TYPE = 1, 2, 3
_NORMAL, _UNKNOWN = 1, 2
_MODEL_TYPE, _BPE, _UNK_ID = 3, 2, 40
_NAME, _DUMMY_PREFIX, _EXTRA_SPACE, _ESCAPE_SPACE = 1, 3, 4, 5


def read_ranks(name: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file; name is a public file's name or a path."""
    with open(name if "/" in name else public_tokenizers.path(name), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _piece(text: str, score: float, kind: int) -> bytes:
    return _bytes(_PIECES, _bytes(_PIECE, text.encode()) + _varint(_SCORE << 3 | 5) + struct.pack("<f", score) + _number(_TYPE, kind))


def model_of(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of these ranks, serialised; ranks are 0, 1, 2 ... and hold every byte."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("ranks must run from 0 without gaps and hold all 256 bytes")
    visible = byte_alphabet()
    pieces = [_piece("".join(visible[b] for b in t), -float(rank), _NORMAL) for rank, t in enumerate(tokens)]
    pieces.append(_piece("<unk>", 0.0, _UNKNOWN))
    trainer = _bytes(_TRAINER, _number(_MODEL_TYPE, _BPE) + _number(_UNK_ID, len(tokens)))
    plain = _bytes(_NAME, b"identity") + _number(_DUMMY_PREFIX, 0) + _number(_EXTRA_SPACE, 0) + _number(_ESCAPE_SPACE, 0)
    return b"".join(pieces) + trainer + _bytes(_NORMALIZER, plain)


class _Kept(dict):
    """Pre-token -> ids as bytes of two-byte or four-byte numbers."""

    def __init__(self, ranks: dict[bytes, int], code: str):
        super().__init__()
        self.ranks, self.code, self.visible = ranks, code, byte_alphabet().__getitem__
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_of(ranks))

    def __missing__(self, part: str) -> bytes:
        data = part.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self.model.encode("".join(map(self.visible, data)))
        found = array(self.code, ids).tobytes()
        if len(self) < KEPT:
            self[part] = found
        return found


class ByteBpe:
    """encode(text) gives ids, decode(ids) the bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        code = "H" if len(ranks) <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if code == "H" else "<u4")
        self.split, self.kept = regex.compile(pattern).findall, _Kept(ranks, code)
        self.plain = PLAIN.fullmatch if pattern == public_tokenizers.PATTERN else lambda text: None
        self.pieces = Pieces(self.kept, BYTE_SPLIT, " ")
        inverse = {ord(c): b for b, c in enumerate(byte_alphabet())}
        piece = self.kept.model.id_to_piece
        self.bytes_of = {i: bytes(inverse[ord(c)] for c in piece(i)) for i in range(len(ranks))}

    def encode(self, text: str) -> np.ndarray:
        kept = self.kept.__getitem__
        if not self.plain(text):
            found = map(kept, self.split(text))
        elif any(pair in text for pair in SPACES_AFTER):
            found = map(kept, BYTE_SPLIT.findall(text))
        else:
            first, *rest = text.split(" ")
            found = [*map(kept, BYTE_SPLIT.findall(first)), *map(self.pieces.__getitem__, rest)]
        return np.frombuffer(b"".join(found), self.dtype)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@cache
def byte_bpe(name: str, pattern: str) -> ByteBpe:
    """One model per worker process, vocabulary file and pattern."""
    return ByteBpe(read_ranks(name), pattern)


def encode(docs: DataFrame, vocabulary: str = MULTI, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (array<int>): every whole text in the vocabulary's ids, without special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(vocabulary, pattern)
        for batch in batches:
            found = [model.encode(text) for text in batch.column(1).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            flat = np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["doc_id", "ids"])

    ship(docs.sparkSession)
    arrow_rows(docs.sparkSession, _BATCH)
    return text_rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = MULTI, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids, data (binary): the bytes that the ids stand for, by the inverse mapping of the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(vocabulary, pattern)
        for batch in batches:
            data = [model.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], ["doc_id", "ids", "data"])

    ship(encoded.sparkSession)
    arrow_rows(encoded.sparkSession, _BATCH)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, data binary")


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256."""
    return decoded.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.coalesce("ids", F.array().cast("array<int>")).cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )
