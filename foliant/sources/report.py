"""Outlines flattened to items and rendered as one self-contained HTML string per book."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape

# Sections in order, their titles, the fields that make an item's title, body and bullets.
SECTIONS = {
    "overall_summary": ("全书概览", None),
    "chapter_outline": ("章节细纲", ("chapter_range", "summary", "key_events")),
    "storylines": ("故事线", ("title", "summary", None)),
    "characters": ("人物", ("name", "summary", None)),
    "worldbuilding": ("世界观", ("name", "description", None)),
    "foreshadowing": ("伏笔", (None, "description", None)),
    "unresolved_items": ("未解决事件与不确定项", (None, "description", None)),
}


def _check(sections: list[str]) -> None:
    if not sections or len(set(sections)) != len(sections) or not set(sections) <= set(SECTIONS):
        raise ValueError("sections must be a non-empty list of known names without repeats")


def outline_items(outlines: DataFrame, sections: list[str]) -> DataFrame:
    """book_id, section, pos, title, body, bullets, confidence, n_chapters, n_batches.

    outlines: book_id and a column per section; items are structs with sources; unresolved_items also
    takes conflicts_and_uncertainties.
    """
    _check(sections)
    none = F.lit(None).cast("string")
    parts = []
    for name in sections:
        if name == "overall_summary":
            parts.append(outlines.select("book_id", F.lit(name).alias("section"), F.lit(0).alias("pos"), none.alias("title"), F.col(name).alias("body"), F.array().cast("array<string>").alias("bullets"), none.alias("confidence"), F.lit(0).alias("n_chapters"), F.lit(0).alias("n_batches")))
            continue
        title, body, bullets = SECTIONS[name][1]
        for column in [name] + (["conflicts_and_uncertainties"] if name == "unresolved_items" else []):
            if column not in outlines.columns:
                continue
            fields = {f.name for f in outlines.schema[column].dataType.elementType.fields}
            rows = outlines.select("book_id", F.posexplode(column).alias("pos", "x"))
            pick = lambda f: F.col(f"x.{f}") if f in fields else none  # noqa: B023, E731
            n = lambda f: F.coalesce(F.size(F.array_distinct(F.col(f"x.sources.{f}"))), F.lit(0)) if "sources" in fields else F.lit(0)  # noqa: B023, E731
            offset = F.lit(0) if column == name else F.lit(1_000_000)
            parts.append(rows.select(
                "book_id", F.lit(name).alias("section"), (F.col("pos") + offset).alias("pos"), pick(title).alias("title"), pick(body).alias("body"),
                (F.col(f"x.{bullets}") if bullets in fields else F.array().cast("array<string>")).alias("bullets"), pick("confidence").alias("confidence"),
                n("chapter_ids").alias("n_chapters"), n("batch_ids").alias("n_batches"),
            ))
    return reduce(DataFrame.unionByName, parts)


def render_html_report(books: DataFrame, items: DataFrame, sections: list[str]) -> DataFrame:
    """book_id, html: contents, chosen sections, a text where one is empty, and a provenance note; all text escaped.

    books: book_id, title.
    """
    _check(sections)
    esc = lambda c: html_escape(F.coalesce(c, F.lit("")))
    one = F.struct("pos", "title", "body", "bullets", "confidence", "n_chapters", "n_batches")
    grouped = items.groupBy("book_id").pivot("section", sections).agg(F.array_sort(F.collect_list(one)))

    def block(x: Column) -> Column:
        head = F.when(x["title"].isNotNull(), F.concat(F.lit("<h3>"), esc(x["title"]), F.lit("</h3>"))).otherwise(F.lit(""))
        bullets = F.when(F.size(x["bullets"]) > 0, F.concat(F.lit("<ul>"), F.array_join(F.transform(x["bullets"], lambda b: F.concat(F.lit("<li>"), esc(b), F.lit("</li>"))), ""), F.lit("</ul>"))).otherwise(F.lit(""))
        note = F.when(x["n_chapters"] + x["n_batches"] > 0, F.concat(F.lit("<small>"), x["n_chapters"].cast("string"), F.lit(" / "), x["n_batches"].cast("string"), F.lit("</small>"))).otherwise(F.lit(""))
        return F.concat(F.lit("<article>"), head, F.lit("<p>"), esc(x["body"]), F.lit("</p>"), bullets, note, F.lit("</article>"))

    contents = F.lit("<nav><ol>" + "".join(f'<li><a href="#{s}">{SECTIONS[s][0]}</a></li>' for s in sections) + "</ol></nav>")
    body = [
        F.concat(
            F.lit(f'<section id="{s}"><h2>{SECTIONS[s][0]}</h2>'),
            F.when(F.coalesce(F.size(F.col(s)), F.lit(0)) > 0, F.array_join(F.transform(F.col(s), block), "")).otherwise(F.lit("<p>（无）</p>")),
            F.lit("</section>"),
        )
        for s in sections
    ]
    title = esc(F.col("title"))
    page = F.concat(
        F.lit('<!DOCTYPE html><html lang="zh"><head><meta charset="utf-8"><title>'), title, F.lit("</title></head><body><h1>"), title, F.lit("</h1>"),
        contents, *body, F.lit("<footer>每项附来源章节数 / 批次数</footer></body></html>"),
    )
    return books.join(grouped, "book_id", "left").select("book_id", page.alias("html"))
