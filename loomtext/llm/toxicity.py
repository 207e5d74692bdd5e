"""Operator 4: toxicity by compression distance between two zstandard dictionaries.

zstandard trains a dictionary on each class. Taken as they come they differ most in which of the
countless ordinary fragments each happens to hold, so the toxic one is contrasted: of its content only
the segments stay that ordinary text hasn't, and they are set beside the ordinary dictionary against as
many blanks. Both compress every window of a text; the difference in bytes is the window's gain.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import slices, table

#: Bytes of a window; windows end at white space and don't overlap.
WINDOW = 224
#: Bytes of the dictionary that zstandard trains on each class, and of the base that both share.
DICTIONARY, BASE = 32_768, 8192
#: Most labelled documents of each class that a model is trained on, the ones with the lowest hash.
PER_CLASS = 2500
#: Share of held-out ordinary documents that the calibrated threshold may reject.
FALSE_ALARMS = 0.002
#: Windows whose compressed lengths differ by less than this many bytes count as alike.
LEAST_GAIN = 1
#: Bytes of a piece of the toxic dictionary, and the least that zstandard takes for a match, so that a window gains by whole pieces alone.
PIECE = 6
#: Natural log by which a piece must be less likely to come from chance than one in all pieces, and the share of ordinary documents that may have it.
SURE, STRAY = 3.0, 0.001
#: What each window of a run may gain before any counts: this many times the mean of ordinary windows.
DRIFT = 8.0
#: zstandard's level: the least that looks for a match at every byte, where faster ones skip ahead in text that they can't compress.
LEVEL = 5
#: zstandard looks for no match in the last eight bytes of its input, so that each window ends in a pad.
_PAD = b" ........"
_BLANK = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """The whole text in lower case without ASCII punctuation, cut at spaces into windows."""
    data = b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANK).split())
    out, at, n = [], 0, len(data)
    while at < n:
        end = data.find(b" ", at + size) if at + size < n else n
        end = n if end < 0 else end
        out.append(b" " + data[at:end] + _PAD)
        at = end + 1
    return out


@dataclass(frozen=True)
class Model:
    """Two dictionaries with the same entropy tables and base content, and the calibrated threshold.

    They differ in one part alone: toxic has segments of the dictionary trained on toxic text where ordinary has
    as many blank bytes, so that an ordinary window compresses to the same length under both.
    """

    ordinary: bytes
    toxic: bytes
    threshold: float
    segments: tuple[bytes, ...]
    #: Bytes a window that a run must gain before any count.
    drift: float = 0.0
    #: Natural log by which a run of ordinary windows gets less likely with each byte.
    rate: float = 1.0

    def excess(self, gains: list[int]) -> float:
        """Bytes over the drift in the best run of neighbouring windows, less what as many ordinary windows reach by chance.

        Ordinary windows anywhere else leave a run as it is; their number counts only by its logarithm. All
        windows together are one run that isn't chosen, and have nothing taken off.
        """
        best = run = every = 0.0
        for g in gains:
            over = (g if g >= LEAST_GAIN else 0) - self.drift
            run, every = max(0.0, run + over), every + over
            best = max(best, run)
        return max(every, best - math.log(max(1, len(gains))) / self.rate)

    def scorer(self) -> Scorer:
        return _scorer(self.ordinary, self.toxic)


class Scorer:
    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.bad = (self._compressor(d) for d in (ordinary, toxic))

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=2 * WINDOW, dict_size=len(content), min_match=PIECE, write_content_size=0, write_dict_id=0, write_checksum=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT)
        d.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=how)

    def gains(self, text: str) -> list[int]:
        """By window, bytes that the toxic dictionary saves against the ordinary one."""
        plain, bad = self.plain.compress, self.bad.compress
        return [len(plain(w)) - len(bad(w)) for w in windows(text)]


def chance_rate(gains: list[int], drift: float) -> float:
    """The rate at which the best sum of a run of such gains less the drift falls off: where the mean of exp(rate * (gain - drift)) is 1."""
    counts = Counter(g if g >= LEAST_GAIN else 0 for g in gains)
    low, high = 0.0, 20.0
    for _ in range(60):
        rate = (low + high) / 2
        if sum(n * math.exp(rate * (g - drift)) for g, n in counts.items()) > len(gains):
            high = rate
        else:
            low = rate
    return max(low, 1e-3)


@lru_cache(maxsize=4)
def _scorer(ordinary: bytes, toxic: bytes) -> Scorer:
    return Scorer(ordinary, toxic)


def fresh_words(texts: list[str]) -> list[bytes]:
    """The texts without words that stand beside a neighbour they had before, here or in an earlier text.

    Of copies and of passages that documents share only the first is left, while a word that many
    documents use, each in its own sentence, stays in all of them.
    """
    split = [t.lower().encode("utf-8", "replace").translate(_BLANK).split() for t in texts]
    sizes = np.array([len(words) for words in split], np.int64)
    ends = np.cumsum(sizes)
    own = np.fromiter((crc32(w) for words in split for w in words), np.uint64, int(sizes.sum()))
    left, right = np.roll(own, 1), np.roll(own, -1)
    left[(ends - sizes)[sizes > 0]] = right[ends[sizes > 0] - 1] = 1 << 32  # no word hashes to it
    fresh = np.ones(len(own), bool)
    for pair in (left * np.uint64(0x9E3779B97F4A7C15) + own, own * np.uint64(0x9E3779B97F4A7C15) + right):
        first = np.zeros(len(own), bool)
        first[np.unique(pair, return_index=True)[1]] = True
        fresh &= first
    return [b" " + b" ".join(w for w, keep in zip(words, fresh[end - n : end]) if keep) + b" " for words, n, end in zip(split, sizes, ends)]


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary that zstandard trains on the samples, repeated where there are too few for it."""
    samples = [s for s in samples if s.strip()]
    if not samples:
        return b""
    return zstandard.train_dictionary(size, samples * max(1, -(-400 // len(samples))), level=LEVEL).as_bytes()


def _cut(data: bytes) -> list[bytes]:
    return [data[at : at + WINDOW] for at in range(0, len(data), WINDOW)]


def _runs(data: bytes) -> np.ndarray:
    """Every run of PIECE bytes as a number."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(0, len(raw) - PIECE + 1)
    out = np.zeros(n, np.uint64)
    for i in range(PIECE):
        out = (out << np.uint64(8)) | raw[i : i + n]
    return out


def contrast(dictionary: bytes, toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The segments of a dictionary, trained on toxic text, that ordinary text hasn't.

    A piece stays if it is in more of the toxic texts than chance could bring there at the rate of the
    ordinary ones (a bound on the Poisson tail), and in hardly any of those. Segments are
    joined pieces; what isn't in one would save bytes in windows of either class.
    """
    runs = _runs(dictionary)
    pieces = np.unique(runs)

    def count(texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(pieces), np.int64)
        for text in texts:
            here = np.unique(_runs(text))
            at = np.minimum(np.searchsorted(pieces, here), len(pieces) - 1)
            out[at[pieces[at] == here]] += 1
        return out

    if not len(pieces):
        return []
    n, strays = count(toxic), count(ordinary)
    chance = (strays + 1) * len(toxic) / max(1, len(ordinary))
    good = (n > chance) & (strays <= STRAY * len(ordinary)) & (n * np.log(np.maximum(n, 1) / chance) - n + chance >= math.log(len(pieces)) + SURE)
    keep = np.zeros(len(dictionary) + 1, bool)
    for i in np.flatnonzero(good[np.searchsorted(pieces, runs)]):
        keep[i : i + PIECE] = True
    edges = np.flatnonzero(np.diff(keep.astype(np.int8), prepend=0)).reshape(-1, 2)
    return sorted({dictionary[a:b] for a, b in edges})


def train(toxic: list[str], ordinary: list[str]) -> Model | None:
    """A model of labelled texts: two thirds of each class train its dictionary, the last third of both sets the threshold.

    The threshold lies midway between the highest score that FALSE_ALARMS leaves to ordinary texts and the
    next of toxic ones. None where a class has fewer than two texts or toxic text no segment of its own.
    """
    toxic, ordinary = ([t for t in texts if t and t.strip()] for texts in (toxic, ordinary))
    fit_toxic, fit_ordinary = ([t for i, t in enumerate(x) if i % 3] for x in (toxic, ordinary))
    fresh_toxic, fresh_ordinary = fresh_words(fit_toxic), fresh_words(fit_ordinary)
    own_toxic = trained([c for t in fresh_toxic for c in _cut(t)], DICTIONARY) if fit_toxic and fit_ordinary else b""
    segments = contrast(own_toxic, fresh_toxic, fresh_ordinary)
    if not segments:
        return None
    base = trained([w for t in fit_ordinary for w in windows(t)], BASE)
    own = b"\0".join(segments) + b"\0"
    ordinary_part, toxic_part = base + b"\0" * len(own), base + own
    scorer = _scorer(ordinary_part, toxic_part)
    gains = [[scorer.gains(t) for t in x[::3]] for x in (toxic, ordinary)]
    every = [LEAST_GAIN, *(g for x in gains[1] for g in x)]  # as if one more window gained, so that the rate is finite
    drift = DRIFT * sum(g for g in every if g >= LEAST_GAIN) / len(every)
    model = Model(ordinary_part, toxic_part, 0.0, tuple(segments), drift, chance_rate(every, drift))
    bad, fine = (sorted(map(model.excess, x)) for x in gains)
    allowed = max(1.5 * LEAST_GAIN, fine[len(fine) - 1 - int(FALSE_ALARMS * len(fine))])
    above = next((x for x in bad if x > allowed), allowed)
    return replace(model, threshold=(allowed + above) / 2)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[str], list[str]]:
    """Texts of at most per_class toxic and ordinary documents: those whose id has the lowest hash.

    The ids are chosen from labels alone; one scan of docs then fetches their texts.
    """
    ids = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(labels["doc_id"].cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    lowest = [ids.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class) for y in (0, 1)]
    chosen = F.broadcast(lowest[0].union(lowest[1]))
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text")).join(chosen, "doc_id").where("text IS NOT NULL")
    rows = [r for y in (0, 1) for r in texts.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(per_class).collect()]
    return [r.text for r in rows if r.toxic == 1], [r.text for r in rows if r.toxic == 0]


_SCORES = [("toxic_bytes", pa.int64()), ("largest_gain", pa.int64()), ("toxic_windows", pa.int64()), ("windows", pa.int64()), ("is_toxic", pa.bool_())]


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """Every document with its compression scores and verdict.

    Columns: doc_id; toxic_bytes, the bytes that the toxic dictionary saves over all windows that gain;
    largest_gain of a window; toxic_windows, those that gain; windows, all; is_toxic, whether a run of
    neighbouring windows, one or all, gains more than chance brings in a text of that many windows and the threshold. A row of docs gives a row: null and repeated ids
    too. Null and empty texts score 0 and aren't toxic. Without a model all scores are null and
    nothing is toxic. Texts of any length are read whole. Other columns aren't looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), *_SCORES])
        for batch in slices(batches):
            rows = [(None, None, None, None, False) if model is None else _verdict(model, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows), _SCORES))], schema=schema)

    narrow = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, toxic_bytes bigint, largest_gain bigint, toxic_windows bigint, windows bigint, is_toxic boolean")


def _verdict(model: Model, text: str | None) -> tuple[int, int, int, int, bool]:
    gains = model.scorer().gains(text) if text else []
    hits = [g for g in gains if g >= LEAST_GAIN]
    return sum(hits), max(hits, default=0), len(hits), len(gains), model.excess(gains) > model.threshold


def drop_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that aren't toxic, with all their columns as they are.

    Rows with a null or empty text stay, so do all rows where there's no model. Null and repeated ids play
    no part: each row is judged by its own text, of any length, so equal rows go or stay together. An
    empty table stays empty. Other columns may have any name.
    """
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = [model is None or not _verdict(model, t)[4] for t in batch.column(text_at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def model_for(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model | None:
    return train(*labelled_sample(docs, table(spark, sf_dir, "labels")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, model_for(spark, docs, sf_dir))
