"""Operator 6: personal identifiers, found through disguises and mapped back to source characters."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomtext.llm.common import slices, table

# --- transducers: each rewrites text and says which source characters every output character is from ---

_LOOKALIKES = {
    "a": "аαɑ", "b": "Ь", "c": "сϲ", "d": "ԁ", "e": "еёε", "g": "ɡ", "h": "һ", "i": "іιı", "j": "јϳ", "k": "κк", "l": "ӏ",
    "m": "м", "n": "η", "o": "оο", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "тτ", "u": "υ", "v": "ν", "w": "ԝ", "x": "хχ", "y": "уү",
    "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ",
    "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ",
    "-": "‐‑‒–−﹣", ".": "․。｡", "@": "﹫", " ": "    ",
}
#: One character for one: full-width forms, look-alike letters, other scripts' decimal digits.
HOMOGLYPHS = {ord(c): latin for latin, cs in _LOOKALIKES.items() for c in cs} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
HOMOGLYPHS |= {zero + d: str(d) for zero in (0x660, 0x6F0, 0x966, 0x9E6, 0xE50, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}

_DIGITS = dict(zip("zero one two three four five six seven eight nine oh".split(), "01234567890"))
_DIGIT_WORDS = {w.encode() for w in _DIGITS}
_DIGIT = "(?:zero|one|two|three|four|five|six|seven|eight|nine|oh)"
_SPELLED = re.compile(rf"(?<![^\W\d_]){_DIGIT}(?:(?: - |[ \-.,]{{1,2}}){_DIGIT})+(?![^\W\d_])", re.I)
#: Spelled digits between two " - ".
_GROUP = re.compile(rf"{_DIGIT}(?:[ \-.,]{{1,2}}{_DIGIT})*", re.I)
#: What may stand between spelled digits, and what may touch them.
_JOINS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
_INVISIBLE = re.compile("[­​-‍⁠﻿]+")
#: The forms of at and dot; a name part before an at, and domain parts after it.
_AT = r"(?:\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+|@)"
_POINT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|\.)"
_BRACKETED = re.compile(r"[\[({<]\s*(at|dot|@|\.)\s*[\])}>]\s*", re.I)
_ADDRESS = re.compile(rf"(?<![^\W_])[A-Za-z0-9](?:[\w+\-.]{{0,62}}[A-Za-z0-9])?({_AT})[A-Za-z0-9\-]+(?:{_POINT}[A-Za-z0-9\-]+)*{_POINT}[A-Za-z]{{2,}}(?![^\W_])", re.I)
_DOT = re.compile(_POINT, re.I)
Rewrite = tuple[int, int, str]


class Mapped:
    """Text and, piecewise, where its characters come from."""

    def __init__(self, text: str):
        self.text = text
        self.layers: list[tuple[list[int], list[int], list[int]]] = []

    def rewrite(self, edits: list[Rewrite]) -> None:
        """Replace disjoint, ordered spans; remember for each boundary what lies before it."""
        if not edits:
            return
        parts, at, out = [], 0, 0
        begins, sources, lengths = [], [], []  # of output pieces; a replaced piece has its source length negated
        for start, end, new in edits:
            if start > at:
                begins.append(out), sources.append(at), lengths.append(0)
                out += start - at
            begins.append(out), sources.append(start), lengths.append(end - start)
            parts += [self.text[at:start], new]
            out += len(new)
            at = end
        begins.append(out), sources.append(at), lengths.append(0)
        parts.append(self.text[at:])
        self.layers.append((begins, sources, [-1 if not n else n for n in lengths]))
        self.text = "".join(parts)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of characters start to end; characters of a replaced piece stand for all of its source."""
        for begins, sources, lengths in reversed(self.layers):
            i = bisect_right(begins, start) - 1
            start = sources[i] if lengths[i] > 0 else sources[i] + start - begins[i]
            last = end - 1
            i = bisect_right(begins, last) - 1
            end = sources[i] + lengths[i] if lengths[i] > 0 else sources[i] + last - begins[i] + 1
        return start, end


def _plain(text: str) -> bool:
    """No character of the text can be a look-alike or invisible one."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "\xa0" not in text and "\xad" not in text


def _bracketed(text: str) -> list[Rewrite]:
    """Bracketed forms of at and dot with the white space around them."""
    out: list[Rewrite] = []
    for m in _BRACKETED.finditer(text):
        start, floor = m.start(), out[-1][1] if out else 0
        while start > floor and text[start - 1].isspace():
            start -= 1
        out.append((start, m.end(), {"at": "@", "dot": "."}.get(m[1].lower(), m[1])))
    return out


def normalise(text: str) -> Mapped:
    """The text without disguises: look-alikes, invisible characters, spelled digits, and at and dot in words."""
    plain = _plain(text)
    out = Mapped(text if plain else text.translate(HOMOGLYPHS))
    if not plain:
        out.rewrite([(m.start(), m.end(), "") for m in _INVISIBLE.finditer(out.text)])
    edits = _bracketed(out.text) if any(c in out.text for c in "[({<") else []
    words = set(out.text.encode("utf-8", "replace").translate(_JOINS).lower().split())
    if (b"dot" in words or edits) and (b"at" in words or "@" in out.text):
        held = {e[:2] for e in edits}
        for m in _ADDRESS.finditer(out.text):
            points = [(m.end(1) + d.start(), m.end(1) + d.end(), ".") for d in _DOT.finditer(out.text[m.end(1) : m.end()]) if d[0] != "."]
            if points:  # a bare "at" before a plain domain isn't a disguise; bracketed ones are rewritten anyway
                edits += [e for e in ([(*m.span(1), "@")] if m[1] != "@" else []) + points if e[:2] not in held]
    out.rewrite(sorted(edits))
    if not words.isdisjoint(_DIGIT_WORDS):
        groups = [(m.start() + g.start(), m.start() + g.end(), g[0]) for m in _SPELLED.finditer(out.text) for g in _GROUP.finditer(m[0])]
        out.rewrite([(a, b, "".join(_DIGITS[w.lower()] for w in re.findall(_DIGIT, g, re.I))) for a, b, g in groups])
    return out


# --- detectors, over normalised text ---

_EMAIL = re.compile(r"(?<![\w+.\-])[A-Za-z0-9][\w.+\-]{0,63}@(?:[A-Za-z0-9\-]{1,63}\.)+[A-Za-z]{2,24}(?![\w])", re.A)
# the first character stands before its own look-behind: the search for it is then a fast scan
_IPV4 = re.compile(r"\d(?<![\w.].)\d{0,2}(?:\.\d{1,3}){3}(?!\w|\.\d)")
_NUMBER = re.compile(r"[+(\d](?<![\w.].)(?:(?<=\d)|(?<=\+)\(?\d|(?<=\()\d)(?:[ .()\-]{0,2}\d){6,18}(?!\w|\.\d)")
_SPACED = re.compile(r"[+(\d](?<![\w.].)(?:(?<=\d)|(?<=\+)\(?\d|(?<=\()\d)(?:(?:\)? - |[ .()\-]{0,2})\d){6,18}(?!\w|\.\d)")
_KEYS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_ASSIGNED = re.compile(r"(?i)(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?([^\s\"']{8,})[\"']?")
#: What isn't the value of a secret: runs of one symbol, or no letter or digit at all.
_JUNK = re.compile(r"([^\w\s])\1\1|^[\W_]+$")
_SSN = re.compile(r"\d(?<![\w\-].)\d{2}-\d{2}-\d{4}(?![\w\-])")
_IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9].)[A-Z]\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_HAS_DIGIT = re.compile(r"\d")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _iban(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _number_kind(found: str) -> str | None:
    digits = re.sub(r"\D", "", found)
    if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", found):
        return None  # a version, or an address out of range
    if re.fullmatch(r"[\d ]+|[\d\-]+", found) and 13 <= len(digits) <= 19:
        return "card" if _luhn(digits) else None  # a number of that length that fails its check digit is no identifier
    if 7 <= len(digits) <= 15 and (found[0] in "+(" or re.search(r"\d[ .()\-]+\d", found) or len(digits) in (10, 11)):
        groups = re.findall(r"\d+", found)
        if found[0] == "+" or found[0] == "(" or len(groups) == 1 or all(2 <= len(g) <= 5 for g in groups[1:]) and len(groups) <= 5 and len(groups[0]) <= 4:
            if len(groups) == 3 and [len(g) for g in groups] in ([4, 2, 2], [2, 2, 4]):
                return None  # a date
            return "phone"
    return None


def _spaced_kind(found: str) -> str | None:
    """The kind of a number with " - " between some of its groups; stricter, since ranges are written so."""
    tight = found.replace(" - ", "-")
    kind, groups = _number_kind(tight), re.findall(r"\d+", tight)
    if kind == "phone" and found[0] not in "+(" and (sum(map(len, groups)) > 11 or len(groups) == 2 and ([len(g) for g in groups] != [3, 4] or groups[0] < "2")):
        return None
    return kind if kind in ("phone", "card") else None


def _numbers(t: str) -> list[tuple[int, int, str]]:
    """Cards and phones. One with " - " inside stands for the only other number that it holds, but not for several."""
    hits = [(*m.span(), kind) for m in _NUMBER.finditer(t) if (kind := _number_kind(m[0]))]
    if " - " not in t:
        return hits
    out, at = [], 0
    for m in _SPACED.finditer(t):
        while at < len(hits) and hits[at][1] <= m.start():
            out.append(hits[at])
            at += 1
        end = at
        while end < len(hits) and hits[end][0] < m.end():
            end += 1
        if end - at < 2 and " - " in m[0] and (kind := _spaced_kind(m[0])):
            out.append((*m.span(), kind))
            at = end
    return out + hits[at:]


def find(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normalised value) of the identifiers, in source characters, first kinds first served."""
    if not text:
        return []
    view = normalise(text)
    t = view.text
    hits: list[tuple[int, int, str]] = []
    if "@" in t:
        hits += [(*m.span(), "email") for m in _EMAIL.finditer(t)]
    if ("=" in t or ":" in t) and any(w in t.lower() for w in ("passw", "pwd", "token", "secret", "key")):
        hits += [(*m.span(1), "secret") for m in _ASSIGNED.finditer(t) if not _JUNK.search(m[1])]
    if _HAS_DIGIT.search(t):
        if "AKIA" in t or "ASIA" in t or "gh" in t:
            hits += [(*m.span(), "secret") for m in _KEYS.finditer(t)]
        hits += [(*m.span(), "iban") for m in _IBAN.finditer(t) if _iban(m[0])]
        hits += [(*m.span(), "ip") for m in _IPV4.finditer(t) if all(int(x) < 256 for x in m[0].split("."))]
        hits += [(*m.span(), "ssn") for m in _SSN.finditer(t)]
        hits += _numbers(t)
    out: list[tuple[int, int, str]] = []  # disjoint, in order
    for hit in hits:
        at = bisect_left(out, hit)
        if (not at or out[at - 1][1] <= hit[0]) and (at == len(out) or hit[1] <= out[at][0]):
            out.insert(at, hit)
    return sorted(((kind, *view.source(start, end), t[start:end]) for start, end, kind in out), key=lambda h: (h[1], h[2]))


def redact(text: str | None) -> str | None:
    """The text with each identifier's source characters replaced by its kind in brackets."""
    hits = find(text)
    if not hits:
        return text
    parts, at = [], 0
    for kind, start, end, _ in hits:
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
            at = end
    return "".join([*parts, text[at:]])


def identifiers(docs: DataFrame) -> DataFrame:
    """Every identifier of every document: doc_id, kind, start, end, source, value.

    start and end count characters (code points) of the source text, source is that part of it, value
    what it says without disguise. Kinds: email, secret, iban, ip, ssn, card (digits that pass the Luhn
    test; other long numbers are none), phone. Where finds overlap the kind named first
    has the characters. Null and empty texts have none; a null or repeated doc_id is carried for each
    of its rows. Texts of any length are searched whole. Other columns aren't looked at.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("source", pa.string()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(i, kind, s, e, t[s:e], v) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for kind, s, e, v in find(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    narrow = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, kind string, start bigint, end bigint, source string, value string")


def redact_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs with identifiers in text replaced; other columns, of any name, are as they were.

    n_chars, where docs has it as an integer column, counts the new text if it counted the old one. A row
    gives a row: null and repeated ids play no part, equal texts are redacted alike. Null, empty and clean texts
    stay as they are. Texts of any length are searched whole, in time that grows in proportion. An empty
    table stays empty.
    """
    names = docs.columns
    at = names.index("text")
    count = names.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("int", "bigint") else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            old = batch.column(at).to_pylist()
            new = [redact(t) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if count >= 0:
                n = [len(b) if a is not None and c == len(a) else c for a, b, c in zip(old, new, batch.column(count).to_pylist())]
                columns[count] = pa.array(n, batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers(table(spark, sf_dir, "documents"))
