"""Queries of outline reports: the turns of conversations stand for the items of an outline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import report
from .base import query, table

SECTIONS = ["overall_summary", "chapter_outline", "unresolved_items"]
TURNS = """
turns as (select conv_id::varchar as book_id, turn, role, coalesce(text, '') as body from conversations),
items as (
  select book_id, 'overall_summary' as section, 0 as pos, null::varchar as title, arg_min(body, turn) as body, []::varchar[] as bullets, 0 as n_chapters, 0 as n_batches
    from turns group by book_id
  union all select book_id, 'chapter_outline', (row_number() over (partition by book_id order by turn) - 1)::int, turn::varchar, body, [role, body], 2, 1 from turns
  union all select book_id, 'unresolved_items', (row_number() over (partition by book_id order by turn) - 1)::int, null, body, []::varchar[], 0, 0
    from (select * from turns where role = 'user')
  union all select book_id, 'unresolved_items', ((row_number() over (partition by book_id order by turn) - 1) + 1000000)::int, null, body, []::varchar[], 0, 0
    from (select * from turns where role <> 'user'))"""


def _outlines(spark, d):
    """One outline per conversation: a chapter per turn; what users say is open, what others say is in conflict."""
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("body"))
    books = table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("book_id")).agg(F.array_sort(F.collect_list(turn)).alias("x"))

    def chapter(t):
        number = t["turn"].cast("string")
        sources = F.struct(F.array(number, number, F.lit("last")).alias("chapter_ids"), F.array(F.lit("b"), F.lit("b")).alias("batch_ids"))
        return F.struct(number.alias("chapter_range"), t["body"].alias("summary"), F.array(t["role"], t["body"]).alias("key_events"), sources.alias("sources"))

    def told(t):
        return F.struct(t["body"].alias("description"), F.lit("uncertain").alias("confidence"))

    return books.select(
        "book_id", F.col("x")[0]["body"].alias("overall_summary"), F.transform("x", chapter).alias("chapter_outline"),
        F.transform(F.filter("x", lambda t: t["role"] == "user"), told).alias("unresolved_items"),
        F.transform(F.filter("x", lambda t: t["role"] != "user"), told).alias("conflicts_and_uncertainties"),
    )


@query("a8_outline_items", f"with {TURNS} select book_id, section, pos, title, md5(body) as body, len(bullets)::int as n_bullets, n_chapters, n_batches from items")
def a8(spark, d):
    items = report.outline_items(_outlines(spark, d), SECTIONS)
    return items.select("book_id", "section", "pos", "title", F.md5(F.col("body").cast("binary")).alias("body"), F.size("bullets").alias("n_bullets"), "n_chapters", "n_batches")


def _escaped(expr: str) -> str:
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        expr = f"replace({expr}, '{plain}', '{name}')"
    return expr


def _section(name: str) -> str:
    heading = report.SECTIONS[name][0]
    return f"""'<section id="{name}"><h2>{heading}</h2>' || coalesce((select string_agg(block, '' order by pos) from blocks b where b.book_id = k.book_id and b.section = '{name}'), '<p>（无）</p>') || '</section>'"""


CONTENTS = "".join(f'<li><a href="#{s}">{report.SECTIONS[s][0]}</a></li>' for s in SECTIONS)


@query("a7_render_html_report", f"""
with {TURNS},
blocks as (
  select book_id, section, pos, '<article>' || case when title is null then '' else '<h3>' || {_escaped('title')} || '</h3>' end || '<p>' || {_escaped('body')} || '</p>'
    || case when len(bullets) > 0 then '<ul><li>' || {_escaped('bullets[1]')} || '</li><li>' || {_escaped('bullets[2]')} || '</li></ul>' else '' end
    || case when n_chapters + n_batches > 0 then '<small>' || n_chapters || ' / ' || n_batches || '</small>' else '' end || '</article>' as block
  from items)
select book_id, md5('<!DOCTYPE html><html lang="zh"><head><meta charset="utf-8"><title>' || title || '</title></head><body><h1>' || title || '</h1><nav><ol>{CONTENTS}</ol></nav>'
  || {' || '.join(map(_section, SECTIONS))} || '<footer>每项附来源章节数 / 批次数</footer></body></html>') as html
from (select distinct book_id, 'Talk &lt;' || book_id || '&gt;' as title from turns) k""")
def a7(spark, d):
    outlines = _outlines(spark, d)
    books = outlines.select("book_id", F.concat(F.lit("Talk <"), "book_id", F.lit(">")).alias("title"))
    pages = report.render_html_report(books, report.outline_items(outlines, SECTIONS), SECTIONS)
    return pages.select("book_id", F.md5(F.col("html").cast("binary")).alias("html"))
