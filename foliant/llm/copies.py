"""Documents with equal texts: one of them is worked on, all of them are reported."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import folded
from .components import components
from .storage import saved


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few of them are Python objects at once."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(7)).alias("t2")]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2, text of the rows that have an id; a null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(text), text.alias("text")).filter("doc_id is not null")


def groups(marks: DataFrame) -> DataFrame:
    """t1, t2, rep, last: the smallest and the largest id of each text."""
    return saved(marks.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "copies")


def representatives(marks: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of marks that stand for their text."""
    return marks.join(grouped, ["t1", "t2"]).filter("doc_id = rep").drop("rep", "last").dropDuplicates(["t1", "t2"])


def merged(spans: Column) -> Column:
    """Structs of start and end, in order, joined where they touch or overlap."""
    state = F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    one = lambda a: F.array(F.struct(a["start"].alias("start"), a["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(a: Column, s: Column) -> tuple[Column, Column]:
        joins = s["start"] <= a["end"]
        moved = F.struct(F.when(joins, a["start"]).otherwise(s["start"]).alias("start"), F.when(joins, F.greatest(a["end"], s["end"])).otherwise(s["end"]).alias("end"))
        return moved, F.when(joins | a["start"].isNull(), none).otherwise(one(a))

    return folded(F.array_sort(spans), state, none, step, lambda a: F.when(a["start"].isNull(), none).otherwise(one(a)))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(marks: DataFrame, grouped: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """One row for every document with a repeated passage, copies of a text included.

    found: rep_id, spans, other, links (ids of representatives that share a passage) and perhaps removed
    (spans of which a document of a smaller id keeps the like) of representatives. A copy of at least `least`
    words is repeated whole. cluster_id is the smallest id that links connect; n_links is the
    number of a row's own links, which connect what shares a passage but are not all pairs that do.
    """
    links = found.select(F.col("rep_id").alias("a"), F.explode("links").alias("b"))
    roots = saved(components(links).withColumnRenamed("root", "joint"), "report-clusters")
    rows = marks.select("doc_id", "t1", "t2", "n_words").distinct().join(grouped, ["t1", "t2"])
    rows = rows.join(found, rows["rep"] == found["rep_id"], "left").join(roots, F.col("rep") == roots["node"], "left")
    whole = (F.col("rep") != F.col("last")) & (F.col("n_words") >= least)
    all_of = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    spans = F.when(whole, all_of).otherwise(F.col("spans"))
    partner = F.when(F.col("doc_id") != F.col("rep"), F.when(whole, F.col("rep")).otherwise(F.col("other")))
    partner = partner.otherwise(F.when(whole, F.least(F.col("last"), F.col("other"))).otherwise(F.col("other")))
    removed = [F.when(whole & (F.col("doc_id") != F.col("rep")), all_of).otherwise(F.col("removed")).alias("removed")] if "removed" in found.columns else []
    cluster = F.least(F.col("rep"), F.coalesce("joint", "rep")).alias("cluster_id")
    n_links = F.coalesce(F.size(F.array_remove("links", F.col("rep"))), F.lit(0)).cast("long").alias("n_links")
    rows = rows.select("doc_id", "rep", "n_words", spans.alias("spans"), *removed, partner.alias("shares_with"), cluster, n_links).filter(F.size("spans") > 0)
    return rows.select(
        "doc_id", F.col("rep").alias("copy_of"), "cluster_id", F.col("n_words").cast("long").alias("n_words"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("dup_words"),
        listed(F.col("spans")).alias("spans"), *([F.coalesce(listed(F.col("removed")), F.lit("")).alias("removed")] if removed else []), "shares_with", "n_links",
    )
