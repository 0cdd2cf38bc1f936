"""Mixing sources to target weights: whole copies by rate, plus one hash-seeded Bernoulli copy.

Sizes are words, aggregated per source before anything is joined; only the table of sources (one row
each) is ordered in one place. A hot source costs no more than others: it is one row there, and its
documents stay where they were read when that table is small enough to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import own_prefix, saved

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share=1.5, cap=2.0) -> DataFrame:
    """source, source_size, target from rows of source and size.

    Sources in code-point order, null last, take the weights in turn. They divide share times the sum
    of all sizes by weight; a target stops at cap times its source's size and the excess goes to the
    others by weight. The final level is found directly: in order of the level at which each source
    would reach its cap, the full ones form a prefix.
    """
    order = F.col("source").asc_nulls_last()
    ranked = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("at", F.row_number().over(Window.orderBy(order)) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")))
        .withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
    )
    before = Window.orderBy("full_at", "at").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("full_at", "at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nothing = F.lit(0)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("source_size").over(before), nothing) * F.lit(cap)) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), nothing)
    )
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("level", F.max(F.when(F.col("full_at") > F.col("level"), F.col("level"))).over(everything))
    most = F.col("source_size") * F.lit(cap)
    return ranked.select("source", "source_size", F.least(most, F.coalesce(F.col("level") * F.col("weight"), most)).alias("target"))


def copies(doc_id: Column, rate: Column, seed: str = "mix") -> Column:
    """floor(rate) copies and one more with probability rate - floor(rate), by a hash of the id.

    Rows with one id (or none) share one draw; reruns agree.
    """
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    uniform = F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    return (F.floor(rate) + F.when(uniform < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _planned(rows: DataFrame, targets: DataFrame, seed: str, own: str) -> DataFrame:
    """rows with source_size, target and copies of their source beside all their own columns; own begins the new names."""
    t = targets.select(F.col("source").alias(f"{own}source"), F.col("source_size").alias(f"{own}source_size"), F.col("target").alias(f"{own}target"))
    rate = F.when(F.col(f"{own}source_size") > 0, F.col(f"{own}target") / F.col(f"{own}source_size")).otherwise(0.0)
    return rows.join(t, rows["source"].eqNullSafe(t[f"{own}source"])).withColumn(f"{own}copies", copies(rows["doc_id"], rate, seed))


def sizes_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def mix_plan(docs: DataFrame, seed: str = "mix", **targets) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (words).

    Null text: size 0. Null source: a source of its own, last in order. Source of size 0: target 0 and
    no copies. Repeated rows: each is counted and taken. Sources that would fill up at one level: in order of
    the source. Texts are counted whole however long. Empty table: no rows. Other columns are ignored.
    """
    sizes = saved(sizes_of(docs), "mix-sizes")
    planned = _planned(sizes, saved(source_targets(sizes, **targets), "mix-targets"), seed, "__mix_")
    return planned.select(
        "doc_id", "source", "size", F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"),
        F.col("__mix_copies").alias("copies"), (F.col("__mix_copies") * F.col("size")).alias("taken"),
    )


def mix(docs: DataFrame, seed: str = "mix", **targets) -> DataFrame:
    """The mixed documents themselves, with all their columns: each row as often as mix_plan says, odd rows included.

    Copies are whole texts, however long; an empty table gives no rows; no column of docs is taken for a helper.
    """
    wanted = saved(source_targets(sizes_of(docs), **targets), "mix-targets")
    own = own_prefix(docs, "__mix_")
    planned = _planned(docs, wanted, seed, own).filter(F.col(f"{own}copies") > 0)
    return planned.withColumn(f"{own}copy", F.explode(F.sequence(F.lit(1), F.col(f"{own}copies")))).select(*[planned[c] for c in docs.columns])
