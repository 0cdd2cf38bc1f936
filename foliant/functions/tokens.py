"""Token counters. The default counts CJK characters, word runs and other visible characters one each."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import SPACE

CJK = r"\x{3400}-\x{9FFF}"
TOKEN = rf"[A-Za-z0-9_]+|[^A-Za-z0-9_{SPACE}]"
PIECE = rf"[{SPACE}]*(?:{TOKEN})"  # a token with the white space before it: pieces make up the text

_counters: dict[str, Callable[[Column], Column]] = {}


def register_counter(name: str, counter: Callable[[Column], Column]) -> None:
    """Make a counter (text column to count column) known by name; the name goes into ids."""
    _counters[name] = counter


def token_count(c: Column, counter: str = "regex") -> Column:
    if counter not in _counters:
        raise ValueError(f"unknown token counter {counter!r}; known: {sorted(_counters)}")
    return _counters[counter](c)


def pandas_counter(count: Callable[[str], int]) -> Callable[[Column], Column]:
    """A counter from a Python function over one text, run in Arrow batches."""

    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: 0 if t is None else count(t))

    return run


register_counter("regex", lambda c: F.coalesce(F.size(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))), F.lit(0)).cast("bigint"))


def grams(c: Column) -> Column:
    """Distinct terms of a text: two-character grams of CJK runs (single characters kept), whole word runs."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(rf"[{CJK}]+|[a-zA-Z0-9_]+"), F.lit(0))
    cut = F.transform(
        runs,
        lambda r: F.when(
            r.rlike(rf"^[{CJK}]{{2}}"),
            F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))),
        ).otherwise(F.array(r)),
    )
    return F.array_distinct(F.flatten(cut))
