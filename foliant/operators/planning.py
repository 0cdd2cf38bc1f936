"""Token budgets, segments, batches and the work that merging them will take."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, content_fingerprint, stable_id
from ..functions.tokens import token_count
from ..stages import saved
from .chunks import cut_text

BLOCK = 8192  # items of a key that one task follows at once
SEAM = 16  # tokens that each further item of a merge request costs


def derive_budget(df: DataFrame) -> DataFrame:
    """df with request_input_limit, available_content_tokens and reason (null if the budget is valid)."""
    limit = F.least("max_input_tokens", F.col("context_window_tokens") - F.col("output_reserve_tokens"))
    df = df.withColumn("request_input_limit", limit)
    df = df.withColumn("available_content_tokens", F.col("request_input_limit") - F.col("safety_margin_tokens"))
    reason = F.when(F.col("output_reserve_tokens") + F.col("safety_margin_tokens") >= F.col("context_window_tokens"), "reserve_exceeds_context").when(
        F.col("available_content_tokens") < 64, "too_little_content"
    )
    return df.withColumn("reason", reason)


def _segments_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of key, block, n as tables that end where a block does."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        cut = int(_begins(rows)[-1])  # the last block may go on
        if cut:
            yield rows.slice(0, cut).combine_chunks()
        held = rows.slice(cut)
    if held is not None:
        yield held.combine_chunks()


def _begins(rows: pa.Table) -> np.ndarray:
    """Where blocks begin: numbers go up by one within a block."""
    n, block = rows["n"].to_numpy(), rows["block"].to_numpy()
    return np.concatenate([[0], np.flatnonzero((n[1:] != n[:-1] + 1) | (block[1:] != block[:-1])) + 1])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Beside each row the first group start outside its block that follows from it, and the starts up to there."""
    for rows in _segments_of(batches):
        begins = _begins(rows)
        ends = np.repeat(np.append(begins[1:], len(rows)), np.diff(np.append(begins, len(rows)))).tolist()
        n, following = rows["n"].to_pylist(), rows["following"].to_pylist()
        out, hops = following[:], [1] * len(n)
        for i in range(len(n) - 1, -1, -1):
            j = len(n) if following[i] is None else i + following[i] - n[i]
            if j < ends[i]:
                out[i], hops[i] = out[j], hops[j] + 1
        yield from rows.append_column("out", pa.array(out, pa.int64())).append_column("hops", pa.array(hops, pa.int64())).to_batches()


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The group starts that follow from the rows with an ordinal within their block, numbered on."""
    for rows in _segments_of(batches):
        n, following, number = (rows[c].to_pylist() for c in ("n", "following", "number"))
        for i, at in enumerate(number):
            j = len(n) if at is None or following[i] is None else i + following[i] - n[i]
            if j < len(n) and n[j] == following[i]:
                number[j] = at + 1
        some = [i for i, x in enumerate(number) if x is not None]
        found = rows.take(pa.array(some, pa.int64()))
        yield from found.set_column(found.schema.get_field_index("number"), "number", pa.array([number[i] for i in some], pa.int64())).to_batches()


def next_fit(items: DataFrame, key: str, pos: str, size: str, limit: int, first: int = 0, seam: int = 0) -> DataFrame:
    """key, pos, group (from 1): adjacent items packed in order, a new group where the next would exceed the limit.

    `first` is what an empty group costs, `seam` what each item after a group's first does; sizes are not negative.
    The item that begins the next group, if an item began one, is the first whose prefix sum exceeds the
    item's own by the limit: items and the sums looked for are dealt by ranges of the limit's width, so a
    range holds about a group. Which items do begin one follows from these pointers. Within BLOCK items they are
    followed directly, from block to block by doubling, so a key of any length is never one row or one array.
    """
    mine = Window.partitionBy("key")
    rows = items.select(F.col(key).alias("key"), F.col(pos).alias("pos"), F.col(size).cast("bigint").alias("size"))
    rows = rows.withColumn("n", F.row_number().over(mine.orderBy("pos")).cast("bigint")).withColumn("upto", F.sum(F.col("size") + seam).over(mine.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    rows = saved(rows, "pack-items")
    width = max(1, limit)
    sums = rows.select("key", "n", F.col("upto").alias("value"), F.lit(1).alias("kind"))
    asked = rows.select("key", "n", (F.lit(limit - first) - F.col("size") + F.col("upto")).alias("value"), F.lit(0).alias("kind"))
    both = sums.unionByName(asked).withColumn("range", F.expr(f"value div {width}"))
    item = F.when(F.col("kind") == 1, F.col("n"))
    above = Window.partitionBy("key", "range").orderBy(F.desc("value"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("key").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = both.groupBy("key", "range").agg(F.min(item).alias("least"), F.max(item).alias("last"))
    firsts = firsts.select("key", "range", F.min("least").over(later).alias("least"), F.max("last").over(mine).alias("last"))
    linked = both.withColumn("found", F.min(item).over(above)).filter("kind = 0").join(firsts, ["key", "range"])
    to = F.coalesce("found", "least")
    to = F.when(to.isNotNull() & (F.col("n") < F.col("last")), F.greatest(to, F.col("n") + 1))
    linked = linked.select("key", F.expr(f"(n - 1) div {BLOCK}").alias("block"), "n", to.alias("following"), "last")
    in_order = lambda df: df.repartition("key", "block").sortWithinPartitions("key", "block", "n")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in linked.schema)
    linked = saved(in_order(linked).mapInArrow(_exits, f"{kind}, out bigint, hops bigint"), "pack-links")
    entries = linked.filter("n = 1").select("key", "n", F.lit(1).cast("bigint").alias("number"))
    jumps = linked.filter("out is not null").select("key", "n", "out", "hops")
    while True:
        more = saved(entries.join(jumps, ["key", "n"]).select("key", F.col("out").alias("n"), (F.col("number") + F.col("hops")).alias("number")), "pack-entries")
        if more.isEmpty():
            break
        entries = entries.unionByName(more)
        on = jumps.select("key", F.col("n").alias("out"), F.col("out").alias("further"), F.col("hops").alias("more"))
        jumps = saved(jumps.join(on, ["key", "out"]).select("key", "n", F.col("further").alias("out"), (F.col("hops") + F.col("more")).alias("hops")), "pack-jumps")
    begun = in_order(linked.drop("out", "hops").join(entries, ["key", "n"], "left").select("key", "block", "n", "following", "last", "number")).mapInArrow(_walked, f"{kind}, number bigint")
    members = F.explode(F.sequence(F.col("n"), F.coalesce(F.col("following") - 1, F.col("last"))))
    groups = begun.select("key", members.alias("n"), F.col("number").cast("int").alias("group"))
    return rows.join(groups, ["key", "n"]).select(F.col("key").alias(key), F.col("pos").alias(pos), "group")


def plan_segments(bodies: DataFrame, limit: int, counter: str = "regex") -> tuple[DataFrame, DataFrame]:
    """(segments with content; chapters whose title leaves no room).

    bodies: book_id, chapter_id, ordinal, title, body, chunk_ids, contains_edits. Blank bodies are skipped.
    """
    rows = bodies.filter(F.col("body").rlike(rf"[^{SPACE}]"))
    head = F.concat(F.lit("【章节 "), F.col("ordinal").cast("string"), F.lit("："), F.col("title"))
    whole = F.concat(head, F.lit("】\n"), F.col("body"))
    room = F.lit(limit) - token_count(F.concat(head, F.lit(" · 片段 999999】\n")), counter)
    rows = rows.withColumns({"__fits": token_count(whole, counter) <= limit, "__room": room})
    errors = rows.filter("not __fits and __room < 1").select("book_id", "chapter_id", F.lit("title_exceeds_budget").alias("reason"))
    short = rows.filter("__fits").withColumns({"part_ordinal": F.lit(1).cast("bigint"), "part_count": F.lit(1).cast("bigint"), "content": whole})
    long = cut_text(rows.filter("not __fits and __room >= 1").drop("__fits"), "body", "__room", 0)
    long = long.withColumns({
        "part_ordinal": F.col("part") + 1, "part_count": F.count("*").over(Window.partitionBy("book_id", "chapter_id")),
        "content": F.concat(head, F.lit(" · 片段 "), (F.col("part") + 1).cast("string"), F.lit("】\n"), F.col("piece")),
    })
    columns = ["book_id", "chapter_id", "ordinal", "title", "chunk_ids", "contains_edits", "part_ordinal", "part_count", "content"]
    segments = short.select(columns).unionByName(long.select(columns))
    segments = segments.withColumns({"token_count": token_count(F.col("content"), counter), "character_count": F.length("content").cast("bigint"), "content_fingerprint": content_fingerprint(F.col("content"))})
    sid = stable_id("segment", F.col("book_id"), F.col("chapter_id"), F.col("part_ordinal"), F.col("content_fingerprint"), F.lit(limit))
    return segments.withColumn("segment_id", sid), errors


def pack_batches(segments: DataFrame, limit: int) -> DataFrame:
    """segments with pos (their order in the book) and batch_no; texts stay out of the packing."""
    order = Window.partitionBy("book_id").orderBy("ordinal", "part_ordinal")
    rows = segments.withColumn("pos", F.row_number().over(order))
    groups = next_fit(rows, "book_id", "pos", "token_count", limit).withColumnRenamed("group", "batch_no")
    return rows.join(groups, ["book_id", "pos"])


def batch_metadata(packed: DataFrame) -> DataFrame:
    """One row per batch: ordered ids, chapter range and label, counts, fingerprint, edits."""
    first, last = F.min_by("title", "pos"), F.max_by("title", "pos")
    rows = packed.groupBy("book_id", "batch_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "segment_id"))), lambda x: x["segment_id"]).alias("segment_ids"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chapter_id"))), lambda x: x["chapter_id"])).alias("chapter_ids"),
        F.min("ordinal").alias("first_chapter"), F.max("ordinal").alias("last_chapter"),
        F.when(F.min("ordinal") == F.max("ordinal"), first).otherwise(F.concat(first, F.lit(" → "), last)).alias("range_label"),
        F.sum("token_count").alias("token_count"), (F.sum("character_count") + 2 * (F.count("*") - 1)).alias("character_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n\n").alias("content"),
        F.bool_or("contains_edits").alias("contains_edits"),
    )
    rows = rows.withColumn("content_fingerprint", content_fingerprint(F.col("content")))
    bid = F.concat(F.lit("batch_"), F.substring(F.sha2(F.concat_ws("\x1f", "book_id", "content_fingerprint", F.array_join("segment_ids", "\x1f")), 256), 1, 16))
    return rows.withColumn("batch_id", bid)


def estimate_merge_work(n: Column, limit: Column, size: Column) -> Column:
    """struct<calls, tokens> of merging n summaries of a size level by level under a limit."""
    group = F.floor((limit + SEAM) / (size + SEAM)).cast("bigint")
    group = F.when(group < 2, F.lit(2)).otherwise(group).cast("bigint")

    def step(acc: Column, _: Column) -> Column:
        full, rest = F.floor(acc["n"] / group).cast("bigint"), acc["n"] % group
        merged = full + F.when(rest > 0, 1).otherwise(0)
        tokens = full * (group * size + (group - 1) * SEAM) + F.when(rest > 0, rest * size + (rest - 1) * SEAM).otherwise(0)
        going = acc["n"] > 1
        return F.struct(
            F.when(going, merged).otherwise(acc["n"]).cast("bigint").alias("n"),
            (acc["calls"] + F.when(going, merged).otherwise(0)).cast("bigint").alias("calls"),
            (acc["tokens"] + F.when(going, tokens).otherwise(0)).cast("bigint").alias("tokens"),
        )

    zero = F.lit(0).cast("bigint")
    many = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(n.cast("bigint").alias("n"), zero.alias("calls"), zero.alias("tokens")), step)
    return F.struct(
        F.when(n <= 0, zero).when(n == 1, F.lit(1).cast("bigint")).otherwise(many["calls"]).alias("calls"),
        F.when(n <= 0, zero).when(n == 1, size.cast("bigint")).otherwise(many["tokens"]).alias("tokens"),
    )


def summary_size(reserve: Column, available: Column) -> Column:
    return F.least(reserve, F.greatest(F.lit(32), F.floor(available / 4).cast("bigint")), F.lit(1200)).cast("bigint")


def plan_rollup(batches: DataFrame, budget_json: str, limit: int, size: int) -> DataFrame:
    """One row per book: batches, tokens, estimated merge calls and tokens, plan_id."""
    rows = batches.groupBy("book_id").agg(
        F.count("*").alias("batch_count"), F.sum("token_count").alias("content_tokens"),
        F.transform(F.array_sort(F.collect_list(F.struct("batch_no", "batch_id"))), lambda x: x["batch_id"]).alias("batch_ids"),
    )
    work = estimate_merge_work(F.col("batch_count"), F.lit(limit), F.lit(size))
    pid = F.concat(F.lit("plan_"), F.substring(F.sha2(F.concat_ws("\x1f", F.col("book_id"), F.lit(budget_json), F.array_join("batch_ids", "\x1f")), 256), 1, 16))
    return rows.withColumn("w", work).select("book_id", "batch_count", "content_tokens", F.col("w.calls").alias("merge_calls"), F.col("w.tokens").alias("merge_tokens"), pid.alias("plan_id"))


def plan_drift(saved: DataFrame, current: DataFrame) -> DataFrame:
    """Books whose rebuilt plan differs from the saved one: book_id, saved_plan, current_plan."""
    both = saved.select("book_id", F.col("plan_id").alias("saved_plan")).join(current.select("book_id", F.col("plan_id").alias("current_plan")), "book_id", "full")
    return both.filter(~F.col("saved_plan").eqNullSafe(F.col("current_plan")))
