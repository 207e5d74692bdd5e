"""Normalising and tokenising text, as expressions; decoding of obfuscated text as an Arrow function."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"\p{IsAlphabetic}\p{N}"
#: Passes of decoding at most; each undoes one layer.
PASSES = 4
_WIDE, _NARROW = "＇％／＜＞＝", "'%/<>="


def normalize_text(text: Column, decode: bool = False) -> Column:
    """Lower case; whatever is neither letter, digit nor white space becomes one space."""
    return F.regexp_replace(F.lower(decode_obfuscated_text(text) if decode else text), rf"[^{WORD}\s]", " ")


def tokens(text: Column, decode: bool = False) -> Column:
    """Runs of letters and digits of the text in lower case."""
    low = F.lower(decode_obfuscated_text(text) if decode else text)
    return F.filter(F.split(low, f"[^{WORD}]+"), lambda t: t != "")


def split_words(text: str) -> list[str]:
    """tokens() of one text on the driver."""
    return regex.findall(r"[\p{Alphabetic}\p{N}]+", text.lower())


def tokenize(text: Column) -> Column:
    """Runs of letters and digits, cut as well wherever upper case meets anything else; case stays."""
    cut = F.regexp_replace(text, r"(?<=\p{IsUppercase})(?=[^\p{IsUppercase}])|(?<=[^\p{IsUppercase}])(?=\p{IsUppercase})", " ")
    return F.filter(F.split(cut, f"[^{WORD}]+"), lambda t: t != "")


def _numeric(text: str, prefix: str, base: int) -> str:
    """Numeric entities: from each & up to a semicolon, or to over twelve bytes, which then stay as they are."""
    out, i, n = [], 0, len(text)
    while i < n:
        if text[i] != "&":
            j = text.find("&", i)
            j = n if j < 0 else j
            out.append(text[i:j])
            i = j
            continue
        j, size = i + 1, 1
        while j < n:
            size += len(text[j].encode("utf-8", "replace"))
            j += 1
            if text[j - 1] == ";" or size > 12:
                break
        entity = text[i:j]
        body = entity[len(prefix) : -1]
        if entity.startswith(prefix) and entity.endswith(";") and len(entity) > len(prefix) and re.fullmatch(r"\+?[0-9]+" if base == 10 else r"\+?[0-9a-fA-F]+", body):
            value = int(body, base)
            if value < 0xD800 or 0xE000 <= value < 0x110000:
                entity = chr(value)
        out.append(entity)
        i = j
    return "".join(out)


_PERCENT = re.compile(rb"%([0-9a-fA-F+][0-9a-fA-F])")


def _percent(text: str) -> str:
    def byte(m: re.Match) -> bytes:
        return bytes([int(m[1], 16)])

    return _PERCENT.sub(byte, text.encode("utf-8", "surrogatepass")).decode("utf-8", "replace")


def decode_once(text: str) -> str:
    """One pass: entities, percent codes, full-width characters, null characters, inline comments."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'")):
        text = text.replace(entity, char)
    if "&#" in text:
        text = _numeric(_numeric(text, "&#x", 16), "&#", 10)
    if "%" in text:
        text = _percent(text)
    text = text.translate(str.maketrans(_WIDE, _NARROW)).replace("\0", "")
    return text.replace("/**/", "").replace("/* */", "").replace("--", " ").replace("#", " ")


def decode_text(text: str) -> str:
    for _ in range(PASSES):
        now = decode_once(text)
        if now == text:
            break
        text = now
    return text


@F.pandas_udf(StringType())
def _decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(decode_text, na_action="ignore")


def decode_obfuscated_text(text: Column) -> Column:
    """The text with up to PASSES layers of encoding undone; texts without any sign of one stay in the JVM."""
    touched = text.rlike(rf"[&%#\x00{_WIDE}]|--|/\*")
    return F.when(touched, _decode(F.when(touched, text))).otherwise(text)


def named_entities_once(text: Column) -> Column:
    """The named entities alone, one pass, as built-in expressions."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def strip_comments(text: Column) -> Column:
    """Inline comments out, comment starts to spaces, full-width forms to ASCII, as built-in expressions."""
    text = F.translate(F.translate(text, _WIDE, _NARROW), "\0", "")
    for what, by in (("/**/", ""), ("/* */", ""), ("--", " "), ("#", " ")):
        text = F.replace(text, F.lit(what), F.lit(by))
    return text
