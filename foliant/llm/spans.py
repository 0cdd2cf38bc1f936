"""Spans of pattern matches as columns, in code points, with built-in functions only.

Patterns used here are written so that Java's matcher needs no recursion and no quadratic rescans: runs
are possessive and a run that cannot match is not tried again from its middle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import bound, folded

SPAN = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"
SIDE = 48


def found(text: Column, pattern: str, context: bool = False) -> Column:
    """All leftmost, non-overlapping matches: start, end (exclusive), value and the text on both sides.

    Matches and the gaps between them, in turn, make up the text, so positions are running lengths.
    """
    side = (lambda c, f: f(c, F.lit(SIDE))) if context else (lambda c, f: F.lit(""))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def joined(gaps: Column) -> Column:
        pairs = F.zip_with(values, gaps, lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
        after = F.slice(gaps, F.lit(2), F.size(gaps)) if context else gaps
        return F.zip_with(pairs, after, lambda x, n: F.struct(x["value"].alias("value"), x["gap"].alias("gap"), n.alias("next")))

    parts = bound(F.split(text, pattern, -1), joined)

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["value"])
        one = F.struct(
            start.alias("start"), end.alias("end"), x["value"].alias("value"),
            side(x["gap"], F.right).alias("before"), side(x["next"], F.left).alias("after"),
        )
        return end, F.array(one)

    none = F.array().cast(SPAN)
    whole = folded(F.filter(parts, lambda x: x["value"].isNotNull()), F.lit(0).cast("bigint"), none, step)
    return F.when(text.rlike(pattern), whole).otherwise(none)


def labelled(spans: Column, kind: str, ok=None) -> Column:
    """kind, start, end of the spans that satisfy ok(value)."""
    kept = spans if ok is None else F.filter(spans, lambda s: ok(s["value"]))
    return F.transform(kept, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def ordered(spans: Column, kinds: list[str], by_start: bool) -> Column:
    """The spans by start then kind, or by kind then start; kinds in the order given, repeats dropped."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keys = lambda s: (s["start"], rank[s["kind"]]) if by_start else (rank[s["kind"]], s["start"])
    packed = F.array_sort(F.transform(spans, lambda s: F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys(s))], s.alias("s"))))
    return bound(packed, lambda p: F.transform(F.filter(p, lambda x, i: (i == 0) | (x != F.get(p, i - 1))), lambda x: x["s"]))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn check."""
    d = digits(value)
    nth = lambda i: F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
    part = lambda i: F.when(i % 2 == 1, nth(i)).otherwise(nth(i) * 2 - F.when(nth(i) > 4, 9).otherwise(0))
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), part), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two hashes that name a document by id and text; equal rows share them, and no value is null."""
    return [F.xxhash64(doc_id, text).alias("key_a"), F.xxhash64(text, doc_id, F.lit(7)).alias("key_b")]
