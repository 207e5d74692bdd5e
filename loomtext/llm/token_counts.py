"""Operator 1: token counts that follow edits without encoding the whole document again."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loomtext.llm import bpe
from loomtext.llm.common import slices, table

Edit = tuple[int, int, str]

#: Pre-tokens in a leaf of the tree when it is built.
LEAF = 32
#: Edits closer than this many characters are re-encoded as one region.
NEAR = 48
#: A pre-token's extent depends on at most this many characters after it.
LOOKAHEAD = 2


def merge_edits(text: str, edits: list[Edit]) -> list[Edit]:
    """Edits in order, clipped to the text, later ones that overlap dropped, close ones joined."""
    out: list[Edit] = []
    reach = -1
    for start, end, new in sorted((max(0, min(s, len(text))), max(0, min(e, len(text))), r) for s, e, r in edits):
        if end < start or start < reach:
            continue
        if out and start - out[-1][1] < NEAR:
            s, e, r = out[-1]
            out[-1] = (s, end, r + text[e:start] + new)
        else:
            out.append((start, end, new))
        reach = max(end, start)
    return out


def apply_edits(text: str, edits: list[Edit]) -> str:
    """The edited text; the rules for overlaps are those of merge_edits."""
    parts, at = [], 0
    for start, end, new in merge_edits(text, edits):
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


class PreTokenTree:
    """A segment tree over the pre-tokens of one document; nodes hold sums of characters and tokens.

    Leaves are runs of pre-tokens. An edit finds its leaf by descending on character sums, splits
    the touched region and its boundary context again, and stops where a new pre-token boundary
    meets an old one behind the edit; only the leaves of that region and the sums above change.
    """

    def __init__(self, text: str, coder: bpe.Bpe):
        self.coder = coder
        pieces = coder.pieces(text)
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars = [0] * (2 * self.width)
        self.tokens = [0] * (2 * self.width)
        self.reencoded = 0
        for i in range(len(self.leaves)):
            self._sum_leaf(i)
        for node in range(self.width - 1, 0, -1):
            self._sum_node(node)

    def _sum_leaf(self, i: int) -> None:
        self.chars[self.width + i] = sum(map(len, self.leaves[i]))
        self.tokens[self.width + i] = sum(map(self.coder.piece_count, self.leaves[i]))

    def _sum_node(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def sums(self) -> tuple[list[int], list[int]]:
        """Characters and tokens by leaf: what a StoredTree needs besides the text."""
        n = len(self.leaves)
        return self.chars[self.width : self.width + n], self.tokens[self.width : self.width + n]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at (the last leaf with any text, beyond the end) and where it begins."""
        node, base = 1, 0
        at = min(at, self.chars[1] - 1)
        while node < self.width:
            node *= 2
            if at - base >= self.chars[node]:
                base += self.chars[node]
                node += 1
        return min(max(node - self.width, 0), len(self.leaves) - 1), base

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters start to end of the present text by new."""
        i, base = self._find(max(0, start - LOOKAHEAD - 1)) if self.chars[1] else (0, 0)
        k = 0
        while k < len(self.leaves[i]) and base + len(self.leaves[i][k]) < start - LOOKAHEAD:
            base += len(self.leaves[i][k])
            k += 1
        first = (i, k)
        old_ends: dict[int, tuple[int, int]] = {}  # end in the old text: the position after it
        taken, at, shift = [], base, len(new) - (end - start)
        fresh: list[str] = []
        want = end + 16
        while True:
            while at < want or at < end:
                while i < len(self.leaves) and k >= len(self.leaves[i]):
                    i, k = i + 1, 0
                if i == len(self.leaves):
                    break
                taken.append(self.leaves[i][k])
                at += len(taken[-1])
                k += 1
                old_ends[at] = (i, k)
            over = i == len(self.leaves)
            old = "".join(taken)
            now = old[: start - base] + new + old[end - base :]
            fresh, pos, stop = [], base, None
            for piece in self.coder.pieces(now):
                pos += len(piece)
                fresh.append(piece)
                if pos >= start + len(new) and pos - shift >= end and pos - shift in old_ends and pos - base + LOOKAHEAD < len(now):
                    stop = old_ends[pos - shift]
                    break
            if stop or over:
                last = stop or (len(self.leaves) - 1, len(self.leaves[-1]))
                break
            want = at + 4 * (want - end)
        self.reencoded += len(fresh)
        self._splice(first, last, fresh)

    def _splice(self, first: tuple[int, int], last: tuple[int, int], fresh: list[str]) -> None:
        (i, k), (j, m) = first, last
        tail = self.leaves[j][m:]
        if i == j:
            self.leaves[i] = self.leaves[i][:k] + fresh + tail
        else:
            self.leaves[i] = self.leaves[i][:k] + fresh
            for x in range(i + 1, j):
                self.leaves[x] = []
            self.leaves[j] = tail
        nodes = set()
        for x in range(i, j + 1):
            self._sum_leaf(x)
            nodes.add((self.width + x) // 2)
        while nodes and 0 not in nodes:
            for node in nodes:
                self._sum_node(node)
            nodes = {node // 2 for node in nodes}

    def apply(self, text: str, edits: list[Edit]) -> PreTokenTree:
        """Edits with positions in text, the text the tree was built from."""
        for start, end, new in reversed(merge_edits(text, edits)):
            self.edit(start, end, new)
        return self


class _Leaves(list):
    """Leaves of a stored tree: the pre-tokens of a leaf are split from its stretch of the text when it's first asked for."""

    def __init__(self, text: str, chars: list[int], coder: bpe.Bpe):
        super().__init__([None] * len(chars))
        self.text, self.coder, self.split = text, coder, 0
        self.ends = [0, *accumulate(chars)]

    def __getitem__(self, i):
        leaf = super().__getitem__(i)
        if leaf is None:
            start, end = self.ends[i % len(self)], self.ends[i % len(self) + 1]
            leaf, at = [], start
            for piece in self.coder.pieces(self.text[start : end + LOOKAHEAD]):
                if at >= end:
                    break
                leaf.append(piece)
                at += len(piece)
            self.split += 1
            self[i] = leaf
        return leaf

    def __iter__(self):
        return (self[i] for i in range(len(self)))


class StoredTree(PreTokenTree):
    """A tree made of the leaf sums that a former one kept and its text; nothing is encoded until an edit touches it."""

    def __init__(self, text: str, chars: list[int], tokens: list[int], coder: bpe.Bpe):
        if sum(chars) != len(text):
            raise ValueError("the sums belong to another text")
        self.coder, self.reencoded = coder, 0
        self.leaves = _Leaves(text, chars, coder)
        self.width = 1 << (len(chars) - 1).bit_length()
        gap = [0] * (self.width - len(chars))
        self.chars, self.tokens = [0] * self.width + chars + gap, [0] * self.width + tokens + gap
        for node in range(self.width - 1, 0, -1):
            self._sum_node(node)


_RUNS = re.compile(r"([!-/:-@\[-`{-~])\1{2,}")


def cleaning_edits(text: str) -> list[Edit]:
    """The production edits: runs of three or more of one symbol go, and repeated lines of a document go."""
    out: list[Edit] = [(m.start(), m.end(), "") for m in _RUNS.finditer(text)]
    if "\n" in text:
        seen, at = set(), 0
        for line in text.split("\n"):
            if len(line) > 20:
                if line in seen:
                    out.append((at, min(len(text), at + len(line) + 1), ""))
                seen.add(line)
            at += len(line) + 1
    return out


def count_tokens(
    docs: DataFrame,
    edits: Callable[[str], list[Edit]] = cleaning_edits,
    vocab_path: str = bpe.VOCAB_PATH,
) -> DataFrame:
    """Tokens of every document before and after its edits.

    Returns a row for each row of docs: doc_id; n_tokens of the text as it is; n_edits; n_reencoded,
    the pre-tokens split again for the edits; n_tokens_edited. A null text has nulls in all counts, an
    empty text zeros. Repeated rows and null ids are counted row by row. Texts of any length are
    counted whole. An empty table gives an empty result. Other columns are not looked at. Needs no
    shuffle: a scan of doc_id and text and one pass in Arrow batches.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_edits", pa.int64()), ("n_reencoded", pa.int64()), ("n_tokens_edited", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocab_path)
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    rows.append((doc_id, None, None, None, None))
                elif found := merge_edits(text, raw := edits(text)):
                    tree = PreTokenTree(text, coder)
                    before = tree.total
                    for start, end, new in reversed(found):
                        tree.edit(start, end, new)
                    rows.append((doc_id, before, len(raw), tree.reencoded, tree.total))
                else:
                    n = coder.count(text)
                    rows.append((doc_id, n, 0, 0, n))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    narrow = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_edits bigint, n_reencoded bigint, n_tokens_edited bigint")


def with_trees(docs: DataFrame, vocab_path: str = bpe.VOCAB_PATH) -> DataFrame:
    """docs with tree_chars and tree_tokens, the leaf sums of each text's tree, to be stored beside the text.

    A null text has null sums, an empty one those of one empty leaf. Rows and other columns are as they
    were; docs must not have columns of these two names. One pass in Arrow batches, no shuffle.
    """
    if {"tree_chars", "tree_tokens"} & set(docs.columns):
        raise ValueError("docs has tree_chars or tree_tokens already")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocab_path)
        for batch in slices(batches):
            sums = [(None, None) if t is None else PreTokenTree(t, coder).sums() for t in batch.column(at).to_pylist()]
            more = [pa.array([x[i] for x in sums], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "tree_chars", "tree_tokens"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("tree_chars", "tree_tokens"))]))


def count_edited(stored: DataFrame, edits: Callable[[str], list[Edit]] = cleaning_edits, vocab_path: str = bpe.VOCAB_PATH) -> DataFrame:
    """The rows of count_tokens for docs that carry their trees (with_trees): only what the edits touch is split and encoded.

    n_tokens is the root of the stored sums. Rows without sums have null counts; sums of another text are an error.
    Otherwise as count_tokens.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_edits", pa.int64()), ("n_reencoded", pa.int64()), ("n_tokens_edited", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocab_path)
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, text, chars, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if text is None or chars is None or tokens is None:
                    rows.append((doc_id, None, None, None, None))
                    continue
                raw = edits(text)
                tree = StoredTree(text, chars, tokens, coder) if raw else None
                before = tree.total if tree else sum(tokens)
                if tree:
                    tree.apply(text, raw)
                rows.append((doc_id, before, len(raw), tree.reencoded if tree else 0, tree.total if tree else before))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    narrow = stored.select(stored["doc_id"].cast("bigint").alias("doc_id"), stored["text"].alias("text"), "tree_chars", "tree_tokens")
    return narrow.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_edits bigint, n_reencoded bigint, n_tokens_edited bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
