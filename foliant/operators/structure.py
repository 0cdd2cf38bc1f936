"""Books to lines, headings, chapters and volumes, with exact half-open character ranges.

Everything is keyed by book_id. Texts are split into lines before anything is shuffled; heading tables
hold no text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import HEADINGS, SPACE, classify_heading, heading_number, heading_title, preview, stable_id
from ..functions.tokens import token_count
from ..stages import settled

PASSES = 100


def by_start():
    return Window.partitionBy("book_id").orderBy("start")


def explode_lines(books: DataFrame) -> DataFrame:
    """book_id, line_no, line, start, end, next_start; the empty line after a last newline is dropped."""
    lines = books.select("book_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"), F.length("text").alias("__n"))
    before = Window.partitionBy("book_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))
    lines = lines.withColumn("start", start).withColumn("end", F.col("start") + F.length("line"))
    return lines.filter("start < __n").select("book_id", "line_no", "line", "start", "end", F.least(F.col("end") + 1, F.col("__n").cast("bigint")).alias("next_start"))


def find_headings(lines: DataFrame, patterns=HEADINGS) -> DataFrame:
    """book_id, title, kind, start, heading_end, content_start, number of the lines that are headings."""
    titled = lines.withColumn("title", heading_title(F.col("line"))).withColumn("kind", classify_heading(F.col("title"), patterns))
    return titled.filter("kind is not null").select(
        "book_id", "title", "kind", "start", F.col("end").alias("heading_end"), F.col("next_start").alias("content_start"),
        heading_number(F.col("title"), F.col("kind")).alias("number"),
    )


def outlier_pass(headings: DataFrame) -> DataFrame:
    """headings with outlier: a chapter between two consecutive chapters of its volume that is neither of them."""
    segment = F.sum(F.when(F.col("kind") == "volume", 1).otherwise(0)).over(by_start())
    marked = headings.withColumn("__segment", segment).withColumn("__chapter", F.col("kind") == "chapter")
    chapters = Window.partitionBy("book_id", "__segment", "__chapter").orderBy("start")
    before, after = F.lag("number").over(chapters), F.lead("number").over(chapters)
    odd = F.col("__chapter") & (after == before + 1) & (F.col("number") != before) & (F.col("number") != after)
    return marked.withColumn("outlier", F.coalesce(odd, F.lit(False))).drop("__segment", "__chapter")


def remove_sequence_outliers(headings: DataFrame) -> DataFrame:
    """Drop outliers until none is left; all triples of a pass are judged together."""
    now = headings
    for _ in range(PASSES):
        marked = settled(outlier_pass(now))
        now = marked.filter("not outlier").drop("outlier")
        if marked.filter("outlier").isEmpty():
            return now
    raise RuntimeError(f"outliers did not settle in {PASSES} passes")


def assign_volumes(headings: DataFrame) -> DataFrame:
    """headings with volume_start and volume_title of the volume they stand in, null before the first."""
    start = F.when(F.col("kind") == "volume", F.struct("start", "title"))
    current = F.last(start, ignorenulls=True).over(by_start().rowsBetween(Window.unboundedPreceding, 0))
    marked = headings.withColumn("__v", current)
    return marked.withColumns({"volume_start": F.col("__v.start"), "volume_title": F.col("__v.title")}).drop("__v")


def chapter_ranges(headings: DataFrame, books: DataFrame) -> DataFrame:
    """headings with content_end: the start of the next heading, or the length of the text."""
    lengths = books.select("book_id", F.length("text").cast("bigint").alias("__n"))
    ranged = headings.withColumn("content_end", F.lead("start").over(by_start())).join(lengths, "book_id")
    return ranged.withColumn("content_end", F.coalesce("content_end", "__n")).drop("__n")


def slice_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def _blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{SPACE}]")


def front_matter(ranged: DataFrame, books: DataFrame) -> DataFrame:
    """Chapters of headings with the text before the first heading and after volume headings as chapters.

    ranged must have volume_start (assign_volumes) and content_end (chapter_ranges).
    """
    first = ranged.groupBy("book_id").agg(F.min("start").alias("content_end")).join(books.select("book_id", "text"), "book_id")
    zero = F.lit(0).cast("bigint")
    head = first.filter(~_blank(slice_text(F.col("text"), zero, F.col("content_end")))).select(
        "book_id", F.lit("卷首").alias("title"), F.lit("special").alias("kind"), zero.alias("start"), zero.alias("heading_end"),
        zero.alias("content_start"), "content_end", F.lit(None).cast("bigint").alias("number"), F.lit(None).cast("bigint").alias("volume_start"),
    )
    columns = head.columns
    volumes = ranged.filter("kind = 'volume'").join(books.select("book_id", "text"), "book_id")
    volumes = volumes.filter(~_blank(slice_text(F.col("text"), F.col("content_start"), F.col("content_end"))))
    volumes = volumes.withColumns({"title": F.concat("title", F.lit(" · 卷首")), "kind": F.lit("special"), "number": F.lit(None).cast("bigint")})
    return reduce(DataFrame.unionByName, [head, volumes.select(*columns), ranged.filter("kind <> 'volume'").select(*columns)])


def fallback_chapters(books: DataFrame, specs: DataFrame) -> DataFrame:
    """One whole-text chapter for each book without headings, or whose chapters are all empty."""
    filled = specs.groupBy("book_id").agg(F.max(F.col("content_end") - F.col("content_start")).alias("n")).filter("n > 0")
    zero = F.lit(0).cast("bigint")
    return books.join(filled, "book_id", "left_anti").select(
        "book_id", F.lit("全文").alias("title"), F.lit("fallback").alias("kind"), zero.alias("start"), zero.alias("heading_end"),
        zero.alias("content_start"), F.length("text").cast("bigint").alias("content_end"), F.lit(None).cast("bigint").alias("number"),
        F.lit(None).cast("bigint").alias("volume_start"),
    )


def chapter_specs(books: DataFrame, headings: DataFrame) -> DataFrame:
    """Chapters as ranges, before ids and counts: found ones, front matter and fallbacks."""
    ranged = chapter_ranges(assign_volumes(headings), books)
    specs = front_matter(ranged, books)
    fallback = fallback_chapters(books, specs)
    return specs.join(fallback.select("book_id"), "book_id", "left_anti").unionByName(fallback)


def chapters(books: DataFrame, headings: DataFrame | None = None, counter: str = "regex") -> DataFrame:
    """book_id, chapter_id, ordinal, title, kind, ranges, character_count, token_count, preview, volume_id.

    Empty chapters of a book that has others are kept out.
    """
    if headings is None:
        headings = remove_sequence_outliers(find_headings(explode_lines(books)))
    specs = chapter_specs(books, headings).filter("content_end > content_start")
    order = Window.partitionBy("book_id").orderBy("content_start", "start")
    rows = specs.withColumn("ordinal", F.row_number().over(order)).join(books.select("book_id", "text"), "book_id")
    content = slice_text(F.col("text"), F.col("content_start"), F.col("content_end"))
    cid = F.when(F.col("kind") == "fallback", stable_id("chapter", F.col("book_id"), F.lit("0"), F.col("content_end"), F.col("title"))).otherwise(
        stable_id("chapter", F.col("book_id"), F.col("start"), F.col("content_end"), F.col("title"))
    )
    volume = F.when(F.col("volume_start").isNotNull(), F.col("volume_start"))
    return rows.select(
        "book_id", cid.alias("chapter_id"), "ordinal", "title", "kind", "number", "start", "heading_end", "content_start", "content_end",
        (F.col("content_end") - F.col("content_start")).alias("character_count"), token_count(content, counter).alias("token_count"),
        preview(content, 160).alias("preview"), volume.alias("volume_start"),
    )


def volumes(headings: DataFrame, chapter_rows: DataFrame, books: DataFrame) -> DataFrame:
    """book_id, volume_id, ordinal, title, start, end (the next volume or the text's end), ordered chapter_ids."""
    own = headings.filter("kind = 'volume'")
    ends = F.lead("start").over(by_start())
    own = own.withColumns({"ordinal": F.row_number().over(by_start()), "end": ends}).join(books.select("book_id", F.length("text").cast("bigint").alias("__n")), "book_id")
    ids = chapter_rows.filter("volume_start is not null").groupBy("book_id", F.col("volume_start").alias("start")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "chapter_id"))), lambda x: x["chapter_id"]).alias("chapter_ids")
    )
    rows = own.join(ids, ["book_id", "start"], "left")
    return rows.select(
        "book_id", stable_id("volume", F.col("book_id"), F.col("start"), F.col("title")).alias("volume_id"), "ordinal", "title", "start",
        F.coalesce("end", "__n").alias("end"), F.coalesce("chapter_ids", F.array().cast("array<string>")).alias("chapter_ids"),
    )


def document_manifest(books: DataFrame, chapter_rows: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """One row per book: characters, tokens, chapters, chunks, whether the whole-text fallback was used."""
    totals = chapter_rows.groupBy("book_id").agg(
        F.count("*").alias("chapter_count"), F.sum("token_count").alias("token_count"), F.max(F.col("kind") == "fallback").alias("used_fallback")
    )
    out = books.select("book_id", F.length("text").cast("bigint").alias("character_count")).join(totals, "book_id", "left").fillna(0, ["chapter_count", "token_count"])
    if chunks is not None:
        out = out.join(chunks.groupBy("book_id").agg(F.count("*").alias("chunk_count")), "book_id", "left").fillna(0, ["chunk_count"])
    return out.withColumn("used_fallback", F.coalesce("used_fallback", F.lit(False)))
