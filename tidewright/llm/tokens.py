"""Token ids of whole texts with the tokenizers library, through caches of recurring pieces.

Both vocabularies split a text before merging and no merge crosses a split, so the ids of a text are
the ids of its parts in order. A worker keeps the ids of up to KEPT_PIECES space-delimited pieces and
KEPT_PARTS pre-split parts; anything not kept is merged anew, so the bounds change no result. Texts of
plain Latin letters, digits and punctuation go to the vocabulary's merge model part by part; any other
text, and any that holds the string of a special token, goes through the full encoder, which gives such a string
its one id.
"""

from __future__ import annotations

import re
from array import array
from functools import cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

KEPT_PIECES = 400_000
KEPT_PARTS = 400_000
WORD = "word_bpe_49k.json"
BYTE = "byte_bpe_50k.json"

# Plain text, and how the two vocabularies split it before merging.
PLAIN = re.compile("[\t-\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-į]*")
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-į"
_WORD_SPLIT = re.compile(rf"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+")
BYTE_SPLIT = re.compile(rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
SPACES_AFTER = [f"{c} " for c in "\t\n\x0b\x0c\r "]  # a run of white space that such a pair ends is not cut at its spaces


def byte_alphabet() -> list[str]:
    """Byte-level vocabularies write bytes without a visible Latin-1 form as U+0100 onwards, in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in visible)}
    return [hidden.get(b, chr(b)) for b in range(256)]


class Parts(dict):
    """Pre-split part -> ids as bytes of the encoder's width."""

    def __init__(self, tokenize, code: str):
        super().__init__()
        self.tokenize, self.code, self.visible = tokenize, code, byte_alphabet().__getitem__
        self.space = self.visible(32)

    def __missing__(self, part: str) -> bytes:
        seen = part.replace(" ", self.space) if part.isascii() and part.isprintable() else "".join(map(self.visible, part.encode()))
        found = array(self.code, [t.id for t in self.tokenize(seen)]).tobytes()
        if len(self) < KEPT_PARTS:
            self[part] = found
        return found


class Pieces(dict):
    """Space-delimited piece -> ids as bytes; lead is put before a piece that is split."""

    def __init__(self, parts: Parts, split: re.Pattern, lead: str):
        super().__init__()
        self.part, self.findall, self.lead = parts.__getitem__, split.findall, lead

    def __missing__(self, piece: str) -> bytes:
        found = self.part(self.lead + piece) if piece.isalpha() else b"".join(map(self.part, self.findall(self.lead + piece)))
        if len(self) < KEPT_PIECES:
            self[piece] = found
        return found


class Encoder:
    """encode(text) gives ids as a little-endian unsigned array of `dtype` (two bytes where they fit)."""

    def __init__(self, path: str):
        self.full = Tokenizer.from_file(path)
        special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)", re.IGNORECASE)
        self.words = path.endswith(WORD)
        self.fast = self.words or path.endswith(BYTE)
        code = "H" if self.full.get_vocab_size() <= 65536 else "I"
        self.dtype = np.dtype("<u2" if code == "H" else "<u4")
        self.split = _WORD_SPLIT if self.words else BYTE_SPLIT
        self.parts = Parts(self.full.model.tokenize, code)
        self.pieces = Pieces(self.parts, self.split, "" if self.words else " ")

    def whole(self, text: str) -> np.ndarray:
        """The full encoder's own answer."""
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def encode(self, text: str) -> np.ndarray:
        if not self.fast or not PLAIN.fullmatch(text) or self.special.search(text):
            return self.whole(text)
        if self.words:
            found = map(self.pieces.__getitem__, text.lower().split())
        elif any(pair in text for pair in SPACES_AFTER):
            found = map(self.parts.__getitem__, self.split.findall(text))
        else:
            first, *rest = text.split(" ")
            found = [*map(self.parts.__getitem__, self.split.findall(first)), *map(self.pieces.__getitem__, rest)]
        return np.frombuffer(b"".join(found), dtype=self.dtype)


@cache
def encoder(name: str) -> Encoder:
    """One encoder per worker process and vocabulary file; name is a public file's name or a path."""
    return Encoder(name if "/" in name else public_tokenizers.path(name))
