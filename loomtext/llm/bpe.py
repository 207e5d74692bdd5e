"""Byte-pair encoding with a public rank file, with a cache of space-delimited chunks.

The pattern that splits text before merging has no look-behind, and a single space between two
non-space characters always begins a new pre-token. Text can so be cut at those spaces and each
chunk encoded alone; chunks repeat, so most are found in a dictionary.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import regex
import tiktoken

#: Where the rank file lies by default; a parameter of every operator that tokenises.
VOCAB_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-token pattern of 50k-rank byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries kept per worker; beyond it chunks are encoded without being kept (results are the same).
CACHE = 400_000


class _Unsafe(Exception):
    """A chunk touches white space other than one single space: the text must be split as a whole."""


class _Cache(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < CACHE:
            self[key] = value
        return value


class Bpe:
    def __init__(self, path: str = VOCAB_PATH):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        #: Two bytes an id where the vocabulary allows it, else four; little-endian.
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.pattern = regex.compile(PATTERN)
        self._counts = _Cache(lambda c: len(self.encoding.encode_ordinary(" " + self._safe(c))))
        self._bytes = _Cache(lambda c: self._raw(" " + self._safe(c)))
        self._pieces = _Cache(lambda p: len(self.encoding.encode_ordinary(p)))

    @staticmethod
    def _safe(chunk: str) -> str:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Unsafe
        return chunk

    def _raw(self, text: str) -> bytes:
        return np.asarray(self.encoding.encode_ordinary(text), dtype=self.dtype).tobytes()

    @staticmethod
    def _clean(text: str) -> str:
        """Lone surrogates can't be encoded as UTF-8; they count as U+FFFD."""
        try:
            text.encode()
            return text
        except UnicodeEncodeError:
            return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def count(self, text: str) -> int:
        first, *rest = text.split(" ")
        try:
            if rest and first:
                self._safe(first)
                return len(self.encoding.encode_ordinary(first)) + sum(map(self._counts.__getitem__, rest))
        except (_Unsafe, UnicodeEncodeError):
            pass
        return len(self.encoding.encode_ordinary(self._clean(text)))

    def encode(self, text: str) -> bytes:
        """The ids of text as raw little-endian integers."""
        first, *rest = text.split(" ")
        try:
            if rest and first:
                self._safe(first)
                return self._raw(first) + b"".join(map(self._bytes.__getitem__, rest))
        except (_Unsafe, UnicodeEncodeError):
            pass
        return self._raw(self._clean(text))

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def piece_count(self, piece: str) -> int:
        return self._pieces[piece]


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One encoder for each worker process and file."""
    return Bpe(path)
