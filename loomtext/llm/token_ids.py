"""Operator 9: raw token ids in shards, with a minimal perfect hash index from document key to place."""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import bpe
from loomtext.llm.common import reread, slices, table

#: Bytes of ids after which a shard is closed (a single longer document makes a longer shard).
SHARD_BYTES = 4 << 20
#: Entries of an index file; a block with more (one key may have a third of all rows) is cut into as many files as it takes.
FILE_ENTRIES = 4_000_000
#: Bits of the hash levels per key that is still to be placed.
GAMMA = 2
_HEAD = struct.Struct("<8sIIIII")
_MAGIC = b"LTMPH\x00\x00\x01"
_U = np.uint64


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijective 64-bit mix, so that different keys never collide in all levels."""
    x = x.astype(np.uint64) + _U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(keys, 101) % _U(blocks)).astype(np.int64)


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 202) >> _U(32)).astype("<u4")


def build_index(keys: np.ndarray, shards: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> bytes:
    """The index block of these entries; a key that occurs more than once has all of its places."""
    order = np.lexsort((offsets, shards, keys))
    keys, shards, offsets, counts = (a[order] for a in (keys, shards, offsets, counts))
    unique, first, times = np.unique(keys, return_index=True, return_counts=True)
    left, sizes, words = unique.view(np.uint64), [], []
    while len(left):
        size = max(64, -(-GAMMA * len(left) // 64) * 64)
        at = (mix(left, len(sizes)) % _U(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(size)
        left = left[~alone[at]]
    bits = np.concatenate(words) if words else np.zeros(0, "<u8")
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits))])[:-1].astype("<u4") if len(bits) else np.zeros(0, "<u4")
    slot = _slots(unique.view(np.uint64), np.array(sizes, "<u4"), bits, ranks)
    by_slot = np.argsort(slot)
    starts = np.concatenate([[0], np.cumsum(times[by_slot])]).astype("<u4")
    places = np.concatenate([np.arange(f, f + t) for f, t in zip(first[by_slot], times[by_slot])]) if len(unique) else np.zeros(0, np.int64)
    parts = [np.array(sizes, "<u4"), bits, ranks, _fingerprints(unique[by_slot].view(np.uint64)), starts, shards[places].astype("<i8"), offsets[places].astype("<i8"), counts[places].astype("<i8")]
    return _HEAD.pack(_MAGIC, len(unique), len(keys), len(sizes), len(bits), 0) + b"".join(p.tobytes() for p in parts)


def _slots(keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The slot of each key: the rank of its bit in the first level where it has one; -1 if none."""
    slot, base = np.full(len(keys), -1, np.int64), 0
    for level, size in enumerate(sizes):
        at = (mix(keys, level) % _U(size)).astype(np.int64) + base
        word = bits[at >> 6]
        bit = (at & 63).astype(np.uint64)
        hit = (slot < 0) & ((word >> bit) & _U(1)).astype(bool)
        slot[hit] = (ranks[at >> 6] + np.bitwise_count(word & ((_U(1) << bit) - _U(1))))[hit]
        base += int(size)
    return slot


class IndexBlock:
    """Reads a block that build_index made; find is constant time: a few hashes, one fingerprint."""

    def __init__(self, content: bytes):
        magic, self.n, entries, levels, n_words, _ = _HEAD.unpack_from(content)
        if magic != _MAGIC:
            raise ValueError("not an index block")
        at = _HEAD.size
        out = []
        for kind, n in (("<u4", levels), ("<u8", n_words), ("<u4", n_words), ("<u4", self.n), ("<u4", self.n + 1), ("<i8", entries), ("<i8", entries), ("<i8", entries)):
            out.append(np.frombuffer(content, kind, n, at))
            at += out[-1].nbytes
        self.sizes, self.bits, self.ranks, self.prints, self.starts, self.shards, self.offsets, self.counts = out

    def find(self, key: int) -> list[tuple[int, int, int]]:
        """(shard, byte offset, ids) of each document with this key; -1 ids for a null text."""
        k = np.array([key], np.int64).view(np.uint64)
        slot = int(_slots(k, self.sizes, self.bits, self.ranks)[0])
        if slot < 0 or self.prints[slot] != _fingerprints(k)[0]:
            return []
        return [(int(self.shards[i]), int(self.offsets[i]), int(self.counts[i])) for i in range(self.starts[slot], self.starts[slot + 1])]


def token_files(docs: DataFrame, blocks: int | None = None, vocab_path: str = bpe.VOCAB_PATH, shard_bytes: int = SHARD_BYTES, file_entries: int = FILE_ENTRIES) -> DataFrame:
    """The files of a token store, one row each: path, n_docs, n_tokens, content.

    ids/<shard>.bin holds the ids of its documents one after the other and nothing else, two bytes
    each (four for a vocabulary over 65,536), little-endian. index/<block>-of-<blocks>-<part>.mph holds the
    index of the keys that hash to the block, out of `blocks` (as many as shuffle partitions unless
    given). A block has one part, but for one of over `file_entries` entries, which are spread over several by place.

    Each text is encoded once, into rows of ids and of index entries that are written to the shared folder.
    Rows of ids are read from there as they are; only the entries, some forty bytes a document, are
    shuffled. A shard's name comes from its input partition, so a task that runs again makes the same file.

    A null text has an entry with -1 ids, an empty one with 0. A repeated doc_id has all its places
    under one key, in the order of shards. A null doc_id has its ids stored but no entry. An empty
    table has no id files; a block that gets no key has no index file.
    Texts of any length are encoded whole. Other columns aren't looked at.
    """
    spark = docs.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = [("route", pa.int64()), ("shard", pa.int64()), ("key", pa.int64()), ("offset", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("content", pa.binary())]
    schema = pa.schema(fields)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocab_path)
        wide = coder.dtype.itemsize
        shard = TaskContext.get().partitionId() << 24
        held: list[bytes] = []
        size = held_docs = 0

        def payload() -> pa.RecordBatch:
            row = [-1 - shard, shard, None, 0, held_docs, size // wide, b"".join(held)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)

        for batch in slices(batches):
            entries = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = b"" if text is None else coder.encode(text)
                if key is not None:
                    entries.append((key, shard, size, -1 if text is None else len(ids) // wide))
                held.append(ids)
                size += len(ids)
                held_docs += 1
                if size >= shard_bytes:
                    yield payload()
                    shard, size, held_docs = shard + 1, 0, 0
                    held = []
            if entries:
                keys, of, offsets, counts = (np.array(c, np.int64) for c in zip(*entries))
                none = pa.nulls(len(keys), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(block_of(keys.view(np.uint64), blocks)), pa.array(of), pa.array(keys), pa.array(offsets), pa.array(np.ones(len(keys), np.int64)), pa.array(counts), none], schema=schema)
        if held_docs:
            yield payload()

    out_schema = pa.schema([("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("content", pa.binary())])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.stack([np.asarray(c) for c in batch.columns]) for batch in batches if batch.num_rows]
        if found:
            route, part, shards, keys, offsets, counts = np.concatenate(found, axis=1)
            for block, nth in np.unique(np.stack([route, part]), axis=1).T:
                own = (route == block) & (part == nth)
                content = build_index(keys[own], shards[own], offsets[own], counts[own])
                row = [f"index/{block:06d}-of-{blocks:06d}-{nth:06d}.mph", int(own.sum()), int(np.maximum(counts[own], 0).sum()), content]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, out_schema.types)], schema=out_schema)

    narrow = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    rows = reread(narrow.mapInArrow(encode, "route bigint, shard bigint, key bigint, offset bigint, n_docs bigint, n_tokens bigint, content binary"), "token-ids")
    name = F.format_string("ids/%06d-%06d.bin", F.shiftright("shard", 24), F.col("shard").bitwiseAND(0xFFFFFF))
    payload = rows.where("key IS NULL").select(name.alias("path"), "n_docs", "n_tokens", "content")
    entries = rows.where("key IS NOT NULL")
    parts = {r.route: -(-r["count"] // file_entries) for r in entries.groupBy("route").count().collect()}  # a row for each block
    parts = F.lit(json.dumps({r: n for r, n in parts.items() if n > 1}))
    files = F.coalesce(F.element_at(F.from_json(parts, "map<string, bigint>"), F.col("route").cast("string")), F.lit(1))
    part = F.pmod(F.xxhash64("shard", "offset"), files)
    entries = entries.select("route", part.alias("part"), "shard", "key", "offset", "n_tokens").repartition(blocks, "route", "part")
    return payload.union(entries.mapInArrow(index, "path string, n_docs bigint, n_tokens bigint, content binary"))


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder given by path or by URI, and its path there."""
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


def write_files(files: DataFrame, folder: str) -> None:
    """Write the rows of token_files under a folder, a path or URI, that all executors share.

    Each file gets its name only when it is whole, so a task that is lost and runs again does no harm.
    """

    def write(rows) -> None:
        there, base = _opened(folder)
        for row in rows:
            path = f"{base}/{row.path}"
            parent, _, name = path.rpartition("/")
            there.create_dir(parent, recursive=True)
            part = f"{parent}/.{name}.{TaskContext.get().taskAttemptId()}"
            with there.open_output_stream(part) as out:
                out.write(row.content)
            there.move(part, path)

    files.foreachPartition(write)


class TokenStore:
    """Keyed reads from a folder that write_files wrote."""

    def __init__(self, folder: str, dtype: str = "<u2"):
        (self.there, self.base), self.dtype = _opened(folder), np.dtype(dtype)
        names = self.there.get_file_info(fs.FileSelector(f"{self.base}/index", allow_not_found=True))
        self.index: dict[int, list[str]] = {}
        for x in sorted(names, key=lambda x: x.path):
            if x.extension == "mph":
                self.index.setdefault(int(x.base_name[:6]), []).append(x.path)
        self.blocks = int(next(iter(self.index.values()))[0].rpartition("-of-")[2][:6]) if self.index else 1
        self._open: dict[str, IndexBlock] = {}

    def _block(self, path: str) -> IndexBlock:
        if path not in self._open:
            with self.there.open_input_file(path) as f:
                self._open[path] = IndexBlock(f.read())
        return self._open[path]

    def get(self, key: int) -> list[np.ndarray | None]:
        block = int(block_of(np.array([key], np.int64).view(np.uint64), self.blocks)[0])
        out: list[np.ndarray | None] = []
        for shard, offset, n in (place for path in self.index.get(block, []) for place in self._block(path).find(key)):
            if n < 0:
                out.append(None)
                continue
            with self.there.open_input_file(f"{self.base}/ids/{shard >> 24:06d}-{shard & 0xFFFFFF:06d}.bin") as f:
                out.append(np.frombuffer(f.read_at(n * self.dtype.itemsize, offset), self.dtype))
        return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))
