"""Readers of the two common binary files of word vectors."""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, field

import numpy as np

from loomtext.errors import InvalidData, TooLarge, Unsupported
from loomtext.functions.hashing import subword_hashes
from loomtext.functions.text import split_words

FASTTEXT_MAGIC, FASTTEXT_VERSION = 793712314, 12
MAX_DIMS, MAX_WORDS, MAX_BUCKETS, MAX_MATRIX_BYTES, MAX_WORD_BYTES = 4096, 5_000_000, 20_000_000, 2 << 30, 4096


@dataclass
class SubwordVectors:
    """Words with vectors, and vectors of hashed subwords for other words."""

    dims: int
    words: dict[str, np.ndarray]
    buckets: dict[int, np.ndarray] = field(default_factory=dict)
    min_n: int = 0
    max_n: int = 0
    n_buckets: int = 0
    n_words: int = 0

    def hashes(self, word: str) -> list[int]:
        return subword_hashes(word, self.min_n, self.max_n, self.n_buckets, self.n_words)

    def vector_for(self, word: str) -> np.ndarray | None:
        """The word's row; else the mean of its known subwords; else None."""
        if word in self.words:
            return self.words[word]
        known = [self.buckets[h] for h in self.hashes(word) if h in self.buckets]
        return np.mean(known, axis=0, dtype=np.float32) if known else None

    def __contains__(self, word: str) -> bool:
        return word in self.words

    def validate(self) -> SubwordVectors:
        if not 1 <= self.dims <= MAX_DIMS or any(len(v) != self.dims for v in (*self.words.values(), *self.buckets.values())):
            raise InvalidData("embeddings", f"vectors must all have {self.dims} dimensions, at most {MAX_DIMS}")
        return self


@dataclass
class CentroidVectors:
    """Words with vectors, and their centroid for any other word."""

    dims: int
    words: dict[str, np.ndarray]
    centroid: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def __post_init__(self):
        if not len(self.centroid):
            self.centroid = np.mean(list(self.words.values()), axis=0, dtype=np.float32) if self.words else np.zeros(self.dims, np.float32)

    def vector_for(self, word: str) -> np.ndarray:
        return self.words.get(word, self.centroid)

    def __contains__(self, word: str) -> bool:
        return word in self.words

    def validate(self) -> CentroidVectors:
        if not 1 <= self.dims <= MAX_DIMS or any(len(v) != self.dims for v in (*self.words.values(), self.centroid)):
            raise InvalidData("embeddings", f"vectors must all have {self.dims} dimensions, at most {MAX_DIMS}")
        return self


class FastTextFile:
    """A version 12 model file: dictionary and input matrix, without quantisation."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:

            def take(fmt: str) -> tuple:
                size = struct.calcsize(fmt)
                data = f.read(size)
                if len(data) < size:
                    raise InvalidData("fasttext", f"{path} ends early")
                return struct.unpack(fmt, data)

            magic, version = take("<ii")
            if magic != FASTTEXT_MAGIC:
                raise InvalidData("fasttext", f"{path} has another magic number")
            if version != FASTTEXT_VERSION:
                raise Unsupported("fasttext", f"version {version}")
            # some writers put the learning rate before the other arguments; the one that makes sense is taken
            for skip in (0, 8):
                f.seek(8 + skip)
                args = take("<12i")
                take("<d")
                self.dims, self.n_buckets, self.min_n, self.max_n = args[0], args[8], args[9], args[10]
                if 1 <= self.dims <= MAX_DIMS and 0 < self.n_buckets <= MAX_BUCKETS and 0 < self.min_n <= self.max_n <= MAX_WORD_BYTES:
                    break
            else:
                raise TooLarge("fasttext", f"{path}: dimensions, buckets or subword lengths out of range")
            size, self.n_words, _, _, pruned = *take("<iii"), *take("<qq")
            if not 1 <= self.dims <= MAX_DIMS or not 0 <= self.n_words <= size <= MAX_WORDS or not 0 <= self.n_buckets <= MAX_BUCKETS:
                raise TooLarge("fasttext", f"{path}: dimensions {self.dims}, words {size}, buckets {self.n_buckets}")
            self.words: list[str] = []
            for _ in range(size):
                word = bytearray()
                while (b := f.read(1)) != b"\0":
                    if not b or len(word) > MAX_WORD_BYTES:
                        raise InvalidData("fasttext", f"{path} has a damaged dictionary")
                    word += b
                _, kind = take("<qb")
                if kind == 0:
                    self.words.append(word.decode("utf-8", "replace"))
                    if pruned >= 0:
                        take("<i")
            if take("<b")[0]:
                raise Unsupported("fasttext", "quantised model")
            rows, cols = take("<qq")
            if cols != self.dims or not self.n_words <= rows <= self.n_words + self.n_buckets or rows * cols * 4 > MAX_MATRIX_BYTES:
                raise InvalidData("fasttext", f"{path}: matrix of {rows} x {cols}")
            data = f.read(rows * cols * 4)
            if len(data) < rows * cols * 4:
                raise InvalidData("fasttext", f"{path} ends early")
            self.matrix = np.frombuffer(data, "<f4").reshape(rows, cols)
        if len(self.words) > rows:
            raise InvalidData("fasttext", f"{path}: more words than rows")
        self.row = {w: i for i, w in enumerate(self.words)}

    def _vectors(self, words: dict[str, np.ndarray], buckets: dict[int, np.ndarray]) -> SubwordVectors:
        return SubwordVectors(self.dims, words, buckets, self.min_n, self.max_n, self.n_buckets, self.n_words).validate()

    def extract_all(self) -> SubwordVectors:
        return self._vectors({w: self.matrix[i] for w, i in self.row.items()}, {i: self.matrix[i] for i in range(self.n_words, len(self.matrix))})

    def extract_for_vocab(self, words: list[str]) -> SubwordVectors:
        """Only these words; subwords are kept only for those that the dictionary lacks. Entries aren't tokenised."""
        out = self._vectors({w: self.matrix[self.row[w]] for w in words if w in self.row}, {})
        out.buckets = {h: self.matrix[h] for w in words if w not in self.row for h in out.hashes(w) if h < len(self.matrix)}
        return out


class Word2VecFile:
    """A text header and binary rows. A line end after a row is skipped only if it is there."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            head = f.readline(64)
            try:
                n, self.dims = map(int, head.split())
            except ValueError as e:
                raise InvalidData("word2vec", f"{path} has no header") from e
            if not 0 < n <= MAX_WORDS or not 0 < self.dims <= MAX_DIMS or n * self.dims * 4 > MAX_MATRIX_BYTES:
                raise TooLarge("word2vec", f"{path}: {n} words of {self.dims} dimensions")
            if os.path.getsize(path) < n * self.dims * 4:
                raise InvalidData("word2vec", f"{path} ends early")
            self.words: dict[str, np.ndarray] = {}
            for _ in range(n):
                word = bytearray()
                while (b := f.read(1)) not in (b" ", b"\t"):
                    if not b or len(word) > MAX_WORD_BYTES:
                        raise InvalidData("word2vec", f"{path} has a damaged word")
                    if b != b"\n" or word:
                        word += b
                data = f.read(4 * self.dims)
                if len(data) < 4 * self.dims:
                    raise InvalidData("word2vec", f"{path} ends early")
                self.words[word.decode("utf-8", "replace")] = np.frombuffer(data, "<f4")

    def extract_all(self) -> CentroidVectors:
        return CentroidVectors(self.dims, dict(self.words)).validate()

    def extract_for_vocab(self, texts: list[str]) -> CentroidVectors:
        """Only the words of these texts, normalised and split as classifiers do; the centroid is that of the kept ones."""
        words = dict.fromkeys(t for text in texts for t in split_words(text))
        return CentroidVectors(self.dims, {t: self.words[t] for t in words if t in self.words}).validate()
