"""Wrapped prose back to sentences with the lines they span."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What keeps a line by itself, and what ends a sentence at a line's end.
STRUCTURAL = re.compile(r"\s*(?:#{1,6}\s|[-*+]\s|\d+[.)]\s|\||```|~~~|>|\t|    \S)")
CLOSED = re.compile(r"[.!?:;|`]\s*$")
ENDED = re.compile(r"(?<=[.!?])\s+")
FIELDS = T.ArrayType(T.StructType([T.StructField("first_line", T.IntegerType()), T.StructField("last_line", T.IntegerType()), T.StructField("sentence", T.StringType())]))


def blocks(lines: list[str]) -> list[tuple[int, int]]:
    """The stretches of lines (from, to) that are one piece of prose each.

    Two neighbours hang together if both are plain and the upper one does not end a sentence; a stretch
    is an island of such neighbours."""
    plain = [not x.isspace() and x != "" and not STRUCTURAL.match(x) for x in lines]
    hangs = [False, *(a and b and not CLOSED.search(x) for a, b, x in zip(plain, plain[1:], lines))]
    opens = [i for i, joined in enumerate(hangs[: len(lines)]) if not joined]
    return list(zip(opens, [*opens[1:], len(lines)]))


def sentences(text: str, start: int = 1) -> list[tuple[int, int, str]]:
    """(first line, last line, sentence) of a text whose first line has number ``start``."""
    lines, found = text.splitlines(), []
    for a, b in blocks(lines):
        prose = lines[a] if b == a + 1 else " ".join(x.strip() for x in lines[a:b])
        pieces = (p.strip(" \t-*#>") for p in ENDED.split(prose))
        found.extend((start + a, start + b - 1, p) for p in pieces if p)
    return found


@F.pandas_udf(FIELDS)
def sentences_udf(texts: pd.Series, starts: pd.Series) -> pd.Series:
    names = ("first_line", "last_line", "sentence")
    return pd.Series([[dict(zip(names, s)) for s in sentences(x or "", int(n))] for x, n in zip(texts, starts)])
