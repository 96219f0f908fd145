"""Whole-text tokenization through a cache of independently encoded chunks.

A byte-pair tokenizer that first splits text by a pattern encodes the pieces
independently, so the ids of a text are those of its chunks joined, wherever a
chunk border is certain to be a piece border.  Each distinct chunk goes through
the tokenizer library once per worker; texts whose white space makes borders
uncertain, or that hold the string of a special token, go through the library
whole.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks a worker remembers.  When full it keeps what it has (common chunks come first); after
#: STALE misses in that state it starts over, so that a change of language is followed.
CACHE_ENTRIES, STALE = 1_000_000, 20_000_000

_UNSURE = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x00", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
_WIDE_SPACE = re.compile("[\x85\xa0  -     　]")
_CONTROL_SPACE = re.compile("[\x1c-\x1f]")


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_BYTE = _byte_letters()
_MARKS = frozenset(".,")


class ChunkIds(dict):
    """chunk -> its ids as little-endian unsigned 16-bit (or 32-bit) integers."""

    def __init__(self, tokenizer, dtype: str, spaceless: bool):
        super().__init__()
        assert sys.byteorder == "little"
        self.tokenizer, self.model, self.dtype, self.spaceless, self.missed = tokenizer, tokenizer.model, dtype, spaceless, 0
        self.code = "H" if dtype == "<u2" else "I"

    def piece(self, chunk: str) -> bytes:
        """The ids of one chunk; Latin letters alone are one piece and need only the merges."""
        word = chunk[1:] if chunk[:1] == " " else chunk
        plain = chunk.isascii()
        if not word.isalpha() or not plain and max(word) >= "\u0250":
            return self.whole(chunk)
        if self.spaceless:
            chunk = word.lower() if plain else unicodedata.normalize("NFC", word).lower()
            if not plain and not chunk.isalpha():
                return self.whole(word)
        mapped = chunk.replace(" ", _BYTE[32]) if plain else "".join(map(_BYTE.__getitem__, chunk.encode()))
        return array(self.code, [x.id for x in self.model.tokenize(mapped)]).tobytes()

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        # a letter before a final full stop or comma: the mark is a piece of its own
        if chunk[-1:] in _MARKS and chunk[-2:-1].isalpha() and chunk[:-1].strip().isalpha():
            ids = self[chunk[:-1]] + self[chunk[-1]]
        else:
            ids = self.piece(chunk)
        if len(self) < CACHE_ENTRIES:
            self[chunk] = ids
        else:
            self.missed += 1
            if self.missed >= STALE:
                self.clear()
                self.missed = 0
        return ids


_loaded: dict[tuple[str, bool], tuple[ChunkIds, bool, tuple[str, ...]]] = {}


class TextEncoder:
    """ids(text) for a tokenizers file, as the library gives them without adding special tokens.

    The string of a special token in a text becomes that token, unless plain_specials is set: then it is ordinary text.
    Pickles as its settings; a worker loads the file on first use.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        self.path, self.plain_specials = path, plain_specials

    def _state(self) -> tuple[ChunkIds, bool, tuple[str, ...]]:
        key = self.path, self.plain_specials
        if key not in _loaded:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(self.path)
            t.encode_special_tokens = self.plain_specials
            added = [x.content for x in t.get_added_tokens_decoder().values()]
            special = () if self.plain_specials else tuple(added)
            dtype = "<u2" if t.get_vocab_size() <= 1 << 16 else "<u4"
            spaceless = t.normalizer is not None and t.encode("a b", add_special_tokens=False).ids == t.encode("a   \n b", add_special_tokens=False).ids
            _loaded[key] = ChunkIds(t, dtype, spaceless), spaceless, special
        return _loaded[key]

    def ids(self, text: str) -> np.ndarray:
        """The ids as unsigned 32-bit integers."""
        cache, spaceless, special = self._state()
        if any(x in text for x in special):
            packed = cache.whole(text)
        elif spaceless:  # white space is dropped, so words are independent
            packed = b"".join(map(cache.__getitem__, text.split())) if not _CONTROL_SPACE.search(text) else cache.whole(text)
        elif any(x in text for x in _UNSURE) or not text.isascii() and _WIDE_SPACE.search(text):
            packed = cache.whole(text)
        else:
            packed = b"".join(map(cache.__getitem__, text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")))
        return np.frombuffer(packed, cache.dtype).astype("<u4")
