"""Registering queries with their SQL, and the books that the driver's tables stand for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conv_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book per conversation, a heading before each turn."""
    rows = table(spark, sf_dir, "conversations")
    piece = F.concat(F.lit("Chapter "), (F.col("turn") + 1).cast("string"), F.lit(" "), F.col("role"), F.lit("\n"), F.col("text"), F.lit("\n"))
    books = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", piece.alias("piece")))).alias("x"))
    return books.select(F.md5(F.col("conv_id").cast("string").cast("binary")).alias("book_id"), F.array_join(F.transform("x", lambda s: s["piece"]), "").alias("text"))


def doc_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book without headings per document."""
    return table(spark, sf_dir, "documents").select(F.md5(F.col("doc_id").cast("string").cast("binary")).alias("book_id"), "text")


SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
TOKEN = rf"[A-Za-z0-9_]+|[^A-Za-z0-9_{SPACE}]"
PIECE = rf"[{SPACE}]*(?:{TOKEN})"
CONV = """
books as (
  select md5(conv_id::varchar) as book_id,
    string_agg('Chapter ' || (turn + 1)::varchar || ' ' || role || chr(10) || text || chr(10), '' order by turn) as text
  from conversations group by conv_id)"""
DOCS = "\nbooks as (select md5(doc_id::varchar) as book_id, text from documents)"
LINES = """,
raw_lines as (
  select book_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no, length(text) as n from books),
lines as (
  select book_id, line_no, line, start, start + length(line) as "end", least(start + length(line) + 1, n) as next_start from (
    select *, coalesce(sum(length(line) + 1) over (partition by book_id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint as start from raw_lines)
  where start < n)"""
ENGLISH = r"(?i:chapter)[ \t\x{3000}]+[0-9０-９]+(?:[ \t\x{3000}]*[:：.．-]?[ \t\x{3000}]*[^\n]{0,48})"
HEADINGS = rf""",
titled as (select *, trim(line, ' ' || chr(9) || chr(12288) || chr(13) || chr(65279)) as title from lines),
headings as (
  select book_id, title, 'chapter' as kind, start, "end" as heading_end, next_start as content_start,
    cast(regexp_extract(title, '(?i:chapter)[ \t]+([0-9]+)', 1) as bigint) as number
  from titled where title <> '' and instr('。！？；，,.!?;', right(title, 1)) = 0 and regexp_full_match(title, '{ENGLISH}'))"""


def tokens(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, '{TOKEN}'))::bigint"


def collapse(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '[{SPACE}]+', ' ', 'g'), '^ | $', '', 'g')"


def preview(expr: str, limit: int) -> str:
    c = collapse(expr)
    return f"case when length({c}) > {limit} then substr({c}, 1, {limit}) || '…' else {c} end"


def stable_id(prefix: str, *parts: str) -> str:
    return f"'{prefix}_' || substr(sha256(concat_ws(chr(31), {', '.join(f'({p})::varchar' for p in parts)})), 1, 16)"


RANGES = """,
ranged as (
  select h.*, coalesce(lead(h.start) over (partition by h.book_id order by h.start), length(b.text)) as content_end
  from headings h join books b using (book_id))"""
CHAPTERS = RANGES + f""",
specs as (
  select book_id, '卷首' as title, 'special' as kind, 0 as start, 0 as heading_end, 0 as content_start, min(start) as content_end, null::bigint as number
  from ranged join books using (book_id) group by book_id, text having regexp_matches(substr(text, 1, min(start)), '[^{SPACE}]')
  union all select book_id, title, kind, start, heading_end, content_start, content_end, number from ranged),
filled as (select book_id from specs group by book_id having max(content_end - content_start) > 0),
full_specs as (
  select * from specs where book_id in (from filled)
  union all select book_id, '全文', 'fallback', 0, 0, 0, length(text), null from books where book_id not in (from filled)),
chapters as (
  select book_id, case kind when 'fallback' then {stable_id('chapter', 'book_id', "'0'", 'content_end', 'title')}
      else {stable_id('chapter', 'book_id', 'start', 'content_end', 'title')} end as chapter_id,
    row_number() over (partition by book_id order by content_start, start) as ordinal, title, kind, number, start, heading_end, content_start, content_end,
    content_end - content_start as character_count, substr(text, (content_start + 1)::bigint, (content_end - content_start)::bigint) as content
  from full_specs join books using (book_id) where content_end > content_start)"""
SIZE, STRIDE = 120, 90
WINDOWS = f""",
pieces as (select book_id, chapter_id, content_start, regexp_extract_all(content, '{PIECE}') as pieces from chapters),
windows as (
  select book_id, chapter_id, w as window, start_char, start_char + length(content) as end_char, least({SIZE}, len(pieces) - w * {STRIDE}) as token_count, content from (
    select *, content_start + length(array_to_string(pieces[1:w * {STRIDE}], '')) as start_char, array_to_string(pieces[w * {STRIDE} + 1:w * {STRIDE} + {SIZE}], '') as content
    from (select *, unnest(range(0, case when len(pieces) <= {SIZE} then 1 else ceil((len(pieces) - {SIZE}) / {STRIDE})::bigint + 1 end)) as w from pieces where len(pieces) > 0)))"""
