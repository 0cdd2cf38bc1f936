"""Token-bounded chunks of chapters, their edits, and bodies rebuilt from them."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bound, folded
from ..functions.text import normalize_newlines, preview, stable_id
from ..functions.tokens import PIECE, token_count
from .structure import slice_text

# Marks after which a chunk may end.
MARKS = "。！？；.!?;"
_TOKEN = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")
MAX_EDIT = 1_000_000
SENT = 1 << 20  # characters of windows that a task hands on at once


def windows(text: str, max_tokens: int, overlap: int, blank: bool = True) -> Iterator[tuple[int, int]]:
    """Windows of at most max_tokens: each but the last ends at the right-most natural boundary of its last
    two fifths (before a newline, after a mark), and the next begins so that it repeats at most overlap tokens.
    Unless blank, they stop before a window without tokens. Besides the text they need 16 bytes a token."""
    begins, ends = array("q"), array("q")
    for m in _TOKEN.finditer(text):
        begins.append(m.start())
        ends.append(m.end())
    start, n = 0, len(text)
    while start < n:
        first = bisect_left(begins, start)
        safe = n if first + max_tokens >= len(begins) else max(begins[first + max_tokens], start + 1)
        end = safe
        if safe < n:
            low = start + int((safe - start) * 0.6)
            best = max(text.rfind("\n", low, safe), *(text.rfind(m, low, safe) + 1 or -1 for m in MARKS))
            end = best if best > start else safe
        if not blank and (first >= len(begins) or begins[first] >= end):
            break
        yield start, end
        if end >= n:
            break
        kept = bisect_right(ends, end) - overlap - 1
        start = max(start + 1, end if overlap == 0 else ends[kept] if kept >= 0 else 0)


def cuts(text: str, max_tokens: int, overlap: int, blank: bool = True) -> list[tuple[int, int]]:
    return list(windows(text, max_tokens, overlap, blank))


def cut_text(rows: DataFrame, text: str, max_tokens: str, overlap: int, blank: bool = True) -> DataFrame:
    """A row for every window of a text column: the other columns, part, part_start, part_end and piece, its slice.

    Windows of one text follow from each other, so a text is one row of work; texts spread over all tasks.
    Windows leave as they are found, some SENT characters at once, and never carry the text they come from.
    """
    fields = [f for f in rows.schema.fields if f.name not in (text, max_tokens)]
    kept = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, found, size = batch.select(kept), [], 0

            def made() -> pa.RecordBatch:
                row, part, start, end, piece = zip(*found)
                own = rest.take(pa.array(row, pa.int64()))
                new = [pa.array(part, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(piece, pa.string())]
                return pa.RecordBatch.from_arrays([*own.columns, *new], names=[*kept, "part", "part_start", "part_end", "piece"])

            for i, (t, most) in enumerate(zip(batch.column(text), batch.column(max_tokens).to_pylist())):
                whole = t.as_py() or ""
                for part, (a, b) in enumerate(windows(whole, int(most), overlap, blank)):
                    found.append((i, part, a, b, whole[a:b]))
                    size += b - a
                    if size > SENT:
                        yield made()
                        found, size = [], 0
            if found:
                yield made()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(run, f"{schema}, part bigint, part_start bigint, part_end bigint, piece string")


def _described(chunks: DataFrame, counter: str, overlap: bool = True) -> DataFrame:
    """Ids, counts, preview and the overlap with the chunk before, from book_id, chapter_id, start_char, end_char, content."""
    order = Window.partitionBy("book_id", "chapter_id").orderBy("start_char")
    before = F.lag("end_char").over(order)
    shared = F.substring("content", F.lit(1), F.greatest(F.lit(0), (before - F.col("start_char")).cast("int")))
    return chunks.select(
        "book_id", "chapter_id", F.row_number().over(order).alias("ordinal"), "start_char", "end_char",
        stable_id("chunk", F.col("book_id"), F.col("chapter_id"), F.col("start_char"), F.col("end_char"), F.lit(counter)).alias("chunk_id"),
        stable_id("cite", F.col("book_id"), F.col("start_char"), F.col("end_char")).alias("citation_id"),
        token_count(F.col("content"), counter).alias("token_count"), (F.col("end_char") - F.col("start_char")).alias("character_count"),
        F.when(before.isNull(), F.lit(0).cast("bigint")).otherwise(token_count(shared, counter)).alias("overlap_tokens"),
        preview(F.col("content"), 120).alias("preview"),
    )


def chunk_chapters(chapters: DataFrame, books: DataFrame, max_tokens: int = 6000, overlap: int = 300) -> DataFrame:
    """Chunks of every chapter, with offsets in the book's text."""
    rows = chapters.join(books.select("book_id", "text"), "book_id").select(
        "book_id", "chapter_id", "content_start", slice_text(F.col("text"), F.col("content_start"), F.col("content_end")).alias("body"),
        F.lit(max_tokens).alias("most"),
    )
    parts = cut_text(rows, "body", "most", overlap, blank=False)
    parts = parts.select(
        "book_id", "chapter_id", (F.col("content_start") + F.col("part_start")).alias("start_char"),
        (F.col("content_start") + F.col("part_end")).alias("end_char"), F.col("piece").alias("content"),
    )
    return _described(parts, "regex")


def fixed_token_windows(chapters: DataFrame, books: DataFrame, size: int, stride: int) -> DataFrame:
    """Windows of exactly size tokens, a stride apart, without natural boundaries; built-in functions only."""
    rows = chapters.join(books.select("book_id", "text"), "book_id").select(
        "book_id", "chapter_id", "content_start", slice_text(F.col("text"), F.col("content_start"), F.col("content_end")).alias("body")
    )
    none = F.array().cast("array<struct<window:int,at:bigint,n:bigint,content:string>>")

    def windows(pieces: Column) -> Column:
        n = F.size(pieces)
        last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(stride)).cast("int"))

        def step(at: Column, w: Column) -> tuple[Column, Column]:
            piece = lambda k: F.array_join(F.slice(pieces, w * stride + 1, F.lit(k)), "")
            held = F.least(F.lit(size), n - w * stride).cast("bigint")
            return at + F.length(piece(stride)), F.array(F.struct(w.alias("window"), at.alias("at"), held.alias("n"), piece(size).alias("content")))

        return F.when(n > 0, folded(F.sequence(F.lit(0), last), F.lit(0).cast("bigint"), none, step)).otherwise(none)

    pieces = F.regexp_extract_all("body", F.lit(PIECE), F.lit(0))
    rows = rows.select("book_id", "chapter_id", "content_start", F.explode(bound(pieces, windows)).alias("w"))
    start = F.col("content_start") + F.col("w.at")
    return rows.select(
        "book_id", "chapter_id", F.col("w.window").alias("window"), start.alias("start_char"), (start + F.length("w.content")).alias("end_char"),
        F.col("w.n").alias("token_count"), F.col("w.content").alias("content"),
    )


def apply_chunk_edits(chunks: DataFrame, edits: DataFrame, max_tokens: int, counter: str = "regex") -> tuple[DataFrame, DataFrame]:
    """(chunks with content_override, is_edited, token_count; rejected edits with a reason).

    chunks: chunk_id, content, parsed_at; edits: chunk_id, content, edited_at. The latest edit after the
    last parse wins; one equal to the source clears the override.
    """
    edits = edits.withColumn("content", normalize_newlines(F.col("content")))
    reason = (
        F.when(~F.coalesce(F.col("content").rlike(r"\S"), F.lit(False)), "blank")
        .when(F.length("content") > MAX_EDIT, "too_long")
        .when(token_count(F.col("content"), counter) > max_tokens, "too_many_tokens")
    )
    judged = edits.withColumn("reason", reason)
    newest = Window.partitionBy("chunk_id").orderBy(F.desc("edited_at"), F.desc("content"))
    good = judged.filter("reason is null").join(chunks.select("chunk_id", "parsed_at"), "chunk_id").filter("edited_at >= parsed_at")
    good = good.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").select("chunk_id", F.col("content").alias("__edit"))
    out = chunks.join(good, "chunk_id", "left").withColumn("content_override", F.nullif("__edit", "content")).drop("__edit")
    out = out.withColumn("is_edited", F.col("content_override").isNotNull())
    out = out.withColumn("token_count", token_count(F.coalesce("content_override", "content"), counter))
    return out, judged.filter("reason is not null")


def delete_chunks(chunks: DataFrame, deletions: DataFrame) -> DataFrame:
    return chunks.join(deletions.select("chunk_id"), "chunk_id", "left_anti")


def chunk_content(chunks: DataFrame, books: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """chunks with original_content, content and is_edited; edits: chunk_id, content_override."""
    rows = chunks.join(books.select("book_id", "text"), "book_id").withColumn("original_content", slice_text(F.col("text"), F.col("start_char"), F.col("end_char"))).drop("text")
    if edits is None:
        return rows.withColumns({"content": F.col("original_content"), "is_edited": F.lit(False)})
    rows = rows.join(edits.select("chunk_id", "content_override"), "chunk_id", "left")
    return rows.withColumns({"content": F.coalesce("content_override", "original_content"), "is_edited": F.col("content_override").isNotNull()}).drop("content_override")


def chapter_bodies(chunks: DataFrame) -> DataFrame:
    """book_id, chapter_id, body, chunk_ids, contains_edits: chapters from active chunks, without their overlap.

    chunks: chunk_content's columns. An edited chunk drops as many leading tokens as it shares with the
    text already covered.
    """
    order = Window.partitionBy("book_id", "chapter_id").orderBy("start_char", "end_char")
    covered = F.max("end_char").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = chunks.withColumn("__from", F.greatest("start_char", F.coalesce(covered, F.col("start_char")))).filter("__from < end_char")
    skip = (F.col("__from") - F.col("start_char")).cast("int")
    shared = token_count(F.substring("original_content", F.lit(1), skip))
    pieces = F.regexp_extract_all("content", F.lit(PIECE), F.lit(0))
    unedited = F.substring("original_content", skip + 1, F.length("original_content"))
    edited = F.when(shared == 0, F.col("content")).otherwise(F.array_join(F.slice(pieces, shared.cast("int") + 1, F.greatest(F.size(pieces), F.lit(1))), ""))
    rows = rows.withColumn("__piece", F.when(F.col("is_edited"), edited).otherwise(unedited)).filter("__piece <> ''")
    one = F.struct(F.col("start_char").alias("s"), F.col("__piece").alias("piece"), F.col("chunk_id").alias("id"))
    out = rows.groupBy("book_id", "chapter_id").agg(F.array_sort(F.collect_list(one)).alias("x"), F.bool_or("is_edited").alias("contains_edits"))
    return out.select(
        "book_id", "chapter_id", F.array_join(F.transform("x", lambda s: s["piece"]), "").alias("body"),
        F.transform("x", lambda s: s["id"]).alias("chunk_ids"), "contains_edits",
    )
