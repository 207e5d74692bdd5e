"""Class labels: seventeen well-known names and any other short text."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.errors import InvalidConfig, InvalidLabel

CANONICAL = (
    "SPAM MALWARE PHISHING ANOMALY FUZZING WEB_ATTACK FLOOD PORN RAW_DATA BLOCK_LIST VIRUS HUMAN ANIMAL CANCER FUNGUS BACTERIA FREE".split()
)
MAX_BYTES = 64


def _ascii_upper(text: str) -> str:
    return "".join(chr(ord(c) - 32) if "a" <= c <= "z" else c for c in text)


def canonical_label(text: str) -> str:
    """The well-known label that text spells in any case, else text as it is; raises InvalidLabel."""
    if not text or len(text.encode()) > MAX_BYTES or any(ord(c) < 32 or 127 <= ord(c) < 160 for c in text):
        raise InvalidLabel("label", f"{text!r} is empty, over {MAX_BYTES} bytes, or has control characters")
    upper = _ascii_upper(text)
    return upper if upper in CANONICAL else text


def label_column(text: Column) -> Column:
    """canonical_label as an expression; null where it would raise, and for null."""
    upper = F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    valid = (F.octet_length(text) > 0) & (F.octet_length(text) <= MAX_BYTES) & ~text.rlike(r"[\x00-\x1f\x7f-\x{9f}]")
    return F.when(valid, F.when(upper.isin(CANONICAL), upper).otherwise(text))


@dataclass(frozen=True)
class LabelEncoder:
    """The distinct labels of a training set in byte order, and their numbers."""

    labels: tuple[str, ...]

    @classmethod
    def fit(cls, samples: DataFrame | Iterable[str], label: str = "label") -> LabelEncoder:
        """From a column, of which only distinct values reach the driver, or from labels. Nulls don't count."""
        found = (r[0] for r in samples.select(label).distinct().collect()) if isinstance(samples, DataFrame) else samples
        return cls(tuple(sorted({x for x in found if x is not None}, key=str.encode)))

    def encode(self, label: str) -> int:
        try:
            return self.labels.index(label)
        except ValueError:
            raise InvalidConfig("labels", f"unseen label: {label}") from None

    def decode(self, code: int) -> str:
        """The label of a number, RAW_DATA for one that is out of range."""
        return self.labels[code] if 0 <= code < len(self.labels) else "RAW_DATA"

    def encoded(self, label: Column) -> Column:
        """encode as an expression; an unseen label is an error of the running task, a null stays null."""
        code = F.array_position(F.lit(list(self.labels)).cast("array<string>"), label) - 1
        unseen = F.raise_error(F.concat(F.lit("unseen label: "), label))
        return F.when(label.isNull(), F.lit(None)).when(code >= 0, code).otherwise(unseen.cast("bigint")).cast("int")

    def decoded(self, code: Column) -> Column:
        return F.when(code.isNotNull(), F.coalesce(F.get(F.lit(list(self.labels)).cast("array<string>"), code), F.lit("RAW_DATA")))
