"""Small tables that hold every awkward case: nulls, empty and long texts, repeats, clashing names."""

from __future__ import annotations

import random

LONG = "long text without end " * 5000
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, __copies string, __key string, node bigint, keep_id string"


def docs(spark, rows):
    full = [(i, t, "en", s, None if t is None else len(t), "x", "y", 1, "z") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


AWKWARD = [(1, "one two three four", "a"), (1, "one two three four", "a"), (2, None, "a"), (3, "", None), (None, "an orphan text", None), (None, None, "b"), (4, LONG, "b"), (5, "   \n\t ", "b"), (6, "émoji 😀 and space", "a"), (7, "one two three four", "b")]


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    pool = [f"{a}{b}{c}" for a in ("ra", "te", "mo", "li") for b in ("sol", "ven", "tar", "ish", "gom") for c in ("a", "en", "or", "ist", "ul")]
    return " ".join(rng.choice(pool) + (str(rng.randrange(words)) if rng.random() < 0.5 else "") for _ in range(n))
