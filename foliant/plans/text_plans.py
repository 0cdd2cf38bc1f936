"""Queries of scalar operators and sources."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.tokens import token_count
from ..operators import incremental
from ..operators.planning import derive_budget
from ..sources import corpus
from .base import CONV, HEADINGS, LINES, SPACE, conv_books, preview, query, stable_id, table, tokens


@query("a5_expire", """
select event_id, coalesce(case when event_id % 2 = 0 then ts + interval 5 day end, ts + interval 1 day) > timestamp '2024-01-20' as live from events""")
def a5(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.expr("interval 5 days")).alias("expires_at"), F.col("ts").alias("modified_at"))
    live, gone = corpus.expire(rows, F.lit("2024-01-20").cast("timestamp"), timedelta(days=1))
    return live.select("event_id", F.lit(True).alias("live")).union(gone.select("event_id", F.lit(False)))


@query("a5_purge", """
select event_id from events where user_id not in (select user_id from events where user_id % 7 = 0 and event_type = 'signup')""")
def a5_purge(spark, d):
    e = table(spark, d, "events")
    return corpus.purge(e.select("event_id", "user_id"), e.filter("user_id % 7 = 0 and event_type = 'signup'").select("user_id").distinct(), "user_id").select("event_id")


@query("a9_safe_filename", r"""
select page_id, substr(coalesce(nullif(trim(regexp_replace(regexp_replace(url, '(?i)\.txt$', ''), '[<>:"/\\|?*\x00-\x1F]', '_', 'g'), ' ._'), ''), 'book'), 1, 120) || '-全书细纲.html' as filename from pages""")
def a9(spark, d):
    return table(spark, d, "pages").select("page_id", t.safe_filename(F.col("url"), "html").alias("filename"))


@query("b1_normalize_newlines", r"""
select doc_id, md5(regexp_replace(replace(replace(text, '. ', chr(13) || chr(10)), ', ', chr(13)), '\r\n?', chr(10), 'g')) as digest from documents""")
def b1(spark, d):
    raw = F.replace(F.replace("text", F.lit(". "), F.lit("\r\n")), F.lit(", "), F.lit("\r"))
    return table(spark, d, "documents").select("doc_id", F.md5(t.normalize_newlines(raw).cast("binary")).alias("digest"))


@query("b2_is_readable", rf"""
select doc_id, regexp_matches(x, '[^{SPACE}]') and length(regexp_replace(x, '[^\x00-\x08\x0B-\x1F]', '', 'g')) <= greatest(5, length(x) // 100) as readable
from (select doc_id, case when doc_id % 5 = 0 then replace(text, ' ', chr(1)) else text end as x from documents)""")
def b2(spark, d):
    x = F.when(F.col("doc_id") % 5 == 0, F.replace("text", F.lit(" "), F.lit("\x01"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.is_readable(x).alias("readable"))


@query("b3_preview", f"select doc_id, {preview('text', 160)} as preview from documents")
def b3(spark, d):
    return table(spark, d, "documents").select("doc_id", t.preview(F.col("text"), 160).alias("preview"))


@query("b4_stable_id", f"select doc_id, {stable_id('cite', 'doc_id', 'lang', 'n_chars')} as id from documents")
def b4(spark, d):
    return table(spark, d, "documents").select("doc_id", t.stable_id("cite", F.col("doc_id"), F.col("lang"), F.col("n_chars")).alias("id"))


@query("b5_fingerprints", """
select doc_id, sha256(text) as content_fingerprint, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}') as row_fingerprint from documents""")
def b5(spark, d):
    return table(spark, d, "documents").select("doc_id", t.content_fingerprint(F.col("text")).alias("content_fingerprint"), t.row_fingerprint("n_chars", "lang", "doc_id").alias("row_fingerprint"))


@query("b6_derive_budget", """
select o_orderkey, l as request_input_limit, l - m as available_content_tokens,
  case when r + m >= c then 'reserve_exceeds_context' when l - m < 64 then 'too_little_content' end as reason
from (select *, least(i, c - r) as l from (
  select o_orderkey, 1024 + o_orderkey % 5000 as c, 300 + o_custkey % 4000 as i, 64 + o_orderkey % 1500 as r, 128 + o_custkey % 700 as m from orders))""")
def b6(spark, d):
    rows = table(spark, d, "orders").select(
        "o_orderkey", (1024 + F.col("o_orderkey") % 5000).alias("context_window_tokens"), (300 + F.col("o_custkey") % 4000).alias("max_input_tokens"),
        (64 + F.col("o_orderkey") % 1500).alias("output_reserve_tokens"), (128 + F.col("o_custkey") % 700).alias("safety_margin_tokens"),
    )
    return derive_budget(rows).select("o_orderkey", "request_input_limit", "available_content_tokens", "reason")


@query("b7_classify_heading", f"with {CONV}{LINES}{HEADINGS} select book_id, start, title, kind from headings")
def b7(spark, d):
    from ..operators.structure import explode_lines

    lines = explode_lines(conv_books(spark, d)).withColumn("title", t.heading_title(F.col("line")))
    return lines.withColumn("kind", t.classify_heading(F.col("title"))).filter("kind is not null").select("book_id", "start", "title", "kind")


@query("b8_heading_number", """
select conv_id, turn, (turn + 1) * 10 + 3 as ascii_number, turn + 1 as wide_number from conversations""")
def b8(spark, d):
    n = F.col("turn") + 1
    title = F.concat(F.lit("Chapter "), (n * 10 + 3).cast("string"), F.lit(" x"))
    wide = F.concat(F.lit("第"), F.translate(n.cast("string"), "0123456789", "０１２３４５６７８９"), F.lit("章 x"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", t.heading_number(title, F.lit("chapter")).alias("ascii_number"), t.heading_number(wide, F.lit("chapter")).alias("wide_number"))


@query("b9_contract_violations", """
select l_orderkey, l_linenumber, list_filter([case when not coalesce(l_linenumber >= 1, false) then 'ordinal' end,
  case when not coalesce(l_quantity between 1 and 40, false) then 'quantity' end, case when not coalesce(l_returnflag in ('A', 'N'), false) then 'flag' end,
  case when not coalesce(l_discount <= l_tax, false) then 'range' end], lambda x: x is not null) as violations from lineitem""")
def b9(spark, d):
    rules = {"ordinal": "l_linenumber >= 1", "quantity": "l_quantity between 1 and 40", "flag": "l_returnflag in ('A', 'N')", "range": "l_discount <= l_tax"}
    return incremental.contract_violations(table(spark, d, "lineitem"), rules).select("l_orderkey", "l_linenumber", "violations")


@query("b10_count_consistency", """
select o_orderkey, o_orderkey % 7 + 1 as declared, count(l_orderkey) as actual from orders left join lineitem on o_orderkey = l_orderkey
group by o_orderkey having count(l_orderkey) <> o_orderkey % 7 + 1""")
def b10(spark, d):
    manifest = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).alias("declared"))
    return incremental.count_consistency(manifest, table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "declared")


@query("b12_strip_code_fence", rf"""
select doc_id, md5(regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')) as digest from documents""")
def b12(spark, d):
    fenced = F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```"))
    x = F.when(F.col("doc_id") % 2 == 0, fenced).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(t.strip_code_fence(x).cast("binary")).alias("digest"))


@query("b13_phase", """
select event_id, case event_type when 'signup' then 'queued' when 'view' then 'summarizing' when 'click' then 'merging' when 'purchase' then 'completed' else 'failed' end as phase,
  event_type in ('purchase', 'error') as terminal from events""")
def b13(spark, d):
    states = {"signup": "pending", "view": "running", "click": "merging", "purchase": "completed", "error": "interrupted"}
    status = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in states.items()])
    return table(spark, d, "events").select("event_id", t.phase(status).alias("phase"), t.is_terminal(status).alias("terminal"))


@query("d1_token_count", f"select doc_id, {tokens('text')} as token_count from documents")
def d1(spark, d):
    return table(spark, d, "documents").select("doc_id", token_count(F.col("text")).alias("token_count"))


@query("m2_custom_headings", """
select conv_id, turn, case when role = 'user' then 'ask' else 'answer' end as kind from conversations""")
def m2(spark, d):
    patterns = (("ask", r"== user ==[0-9]*"), ("answer", r"== [a-z]+ ==[0-9]*"))
    title = F.concat(F.lit("== "), F.col("role"), F.lit(" =="), F.col("turn").cast("string"))
    return table(spark, d, "conversations").select("conv_id", "turn", t.classify_heading(title, patterns).alias("kind"))
