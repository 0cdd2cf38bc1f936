"""Folds along arrays in time linear in their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the lambda functions in body ask for it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(items: Column, first: Column, none: Column, step: Callable, last: Callable | None = None) -> Column:
    """What step(state, item) -> (next state, array of results) gives along an array; last(state) may add more.

    Appending one by one copies the whole result for each item. So results gather in short arrays, one for
    each BLOCK items, and only those are appended to the whole. A null array gives null.
    """

    def along(xs: Column) -> Column:
        def block(acc: Column, i: Column) -> Column:
            def inner(a: Column, x: Column) -> Column:
                state, more = step(a["state"], x)
                return F.struct(state.alias("state"), F.concat(a["out"], more).alias("out"))

            return F.aggregate(
                F.slice(xs, i * BLOCK + 1, BLOCK), F.struct(acc["state"].alias("state"), none.alias("out")), inner,
                lambda a: F.struct(a["state"].alias("state"), F.concat(acc["out"], a["out"]).alias("out")),
            )

        numbers = F.sequence(F.lit(0), F.floor((F.greatest(F.size(xs), F.lit(1)) - 1) / BLOCK).cast("int"))
        end = lambda acc: F.concat(acc["out"], last(acc["state"])) if last else acc["out"]
        return F.aggregate(numbers, F.struct(first.alias("state"), none.alias("out")), block, end)

    return bound(items, along)
