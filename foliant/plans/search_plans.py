"""Queries of retrieval, evidence and evaluation operators, and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import grams
from ..operators import evaluation as ev
from ..operators import retrieval as rt
from ..stages import shared_folder
from .base import query, table

PASSAGES = """
passages as (
  select book_id, chapter_id, chunk_id, 1 as chunk_ordinal, o as "offset", 'passage_' || substr(sha256(chunk_id || ':' || o || ':' || content), 1, 24) as passage_id, 'original' as origin, content from (
    select *, substr(text, o + 1, 1200) as content from (
      select md5(doc_id::varchar) as book_id, 'c' || doc_id as chapter_id, 'k' || doc_id as chunk_id, text, unnest(range(0, length(text), 1000)) as o from documents)))"""
GRAM = "list_distinct(regexp_extract_all(lower({0}), '[\\x{{3400}}-\\x{{9FFF}}]+|[a-zA-Z0-9_]+'))"
INDEX = PASSAGES + f""",
posted as (select passage_id, content, chapter_id, len(terms) as doc_len, unnest(terms) as term from (select *, {GRAM.format('content')} as terms from passages)),
freq as (select term, count(*) as df from posted group by term),
totals as (select count(*) as n_docs, avg(len({GRAM.format('content')})) as avg_len from passages)"""
ORDERED = "list_filter(regexp_extract_all(lower(query), '[a-zA-Z0-9_]+'), lambda x, i: list_position(regexp_extract_all(lower(query), '[a-zA-Z0-9_]+'), x) = i)"


def _search_sql(restrict: str = "") -> str:
    return INDEX + f""",
queries as (select item_id as query_id, text as query from benchmark),
terms as (select query_id, unnest(list_distinct(regexp_extract_all(lower(query), '[a-zA-Z0-9_]+'))) as term from queries),
weighed as (select query_id, term, greatest(1e-6, ln((n_docs - df + 0.5) / (df + 0.5))) as idf, avg_len from terms join freq using (term), totals),
scored as (
  select query_id, passage_id, any_value(p.content) as content, any_value(chapter_id) as chapter_id, sum(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * doc_len / avg_len))) as score
  from posted p join weighed using (term) {restrict} group by query_id, passage_id),
ranked as (select *, row_number() over (partition by query_id order by round(score, 9) desc, passage_id) as n from scored),
firsts as (select * from ranked where n <= 200 qualify row_number() over (partition by query_id, chapter_id, content order by n) = 1),
found as (select query_id, row_number() over (partition by query_id order by n) as rank, passage_id, round(score, 6) as score, content from firsts qualify rank <= 4)"""


def _chunks(spark, d):
    return table(spark, d, "documents").select(
        F.md5(F.col("doc_id").cast("string").cast("binary")).alias("book_id"), F.concat(F.lit("c"), "doc_id").alias("chapter_id"),
        F.concat(F.lit("k"), "doc_id").alias("chunk_id"), F.lit(1).alias("ordinal"), F.col("text").alias("content"), F.lit(False).alias("is_edited"))


def _passages(spark, d):
    return rt.passages(_chunks(spark, d))


def _index(spark, d):
    """One index of all documents in the shared folder: the first query that asks writes it, the others find it."""
    return rt.stored_index(_chunks(spark, d), f"{shared_folder(spark)}/indexes", None)


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("h1_passages", f'with {PASSAGES} select book_id, chapter_id, chunk_id, "offset", passage_id, origin from passages')
def h1(spark, d):
    return _passages(spark, d).select("book_id", "chapter_id", "chunk_id", "offset", "passage_id", "origin")


@query("h2_grams", f"select doc_id, list_sort({GRAM.format('text')}) as terms from documents")
def h2(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_sort(grams(F.col("text"))).alias("terms"))


@query("h3_build_index", f"with {INDEX} select term, df, n_docs, round(avg_len, 6) as avg_len from freq, totals")
def h3(spark, d):
    freq, totals = rt.index_stats(_index(spark, d))
    return freq.join(totals, "space").select("term", "df", "n_docs", F.round("avg_len", 6).alias("avg_len"))


@query("h4_search", f"with {_search_sql()} select query_id, rank, passage_id, score from found")
def h4(spark, d):
    return rt.search(_queries(spark, d), _index(spark, d)).select("query_id", "rank", "passage_id", F.round("score", 6).alias("score"))


@query("h5_search_chapters", f"with {_search_sql('where substr(chapter_id, 2)::bigint % 5 = query_id % 5')} select query_id, rank, passage_id, score from found")
def h5(spark, d):
    """Five sets of chapters, one for each query to search in."""
    sets = table(spark, d, "documents").select((F.col("doc_id") % 5).alias("chapter_set"), F.concat(F.lit("c"), "doc_id").alias("chapter_id"))
    queries = _queries(spark, d).withColumn("chapter_set", F.col("query_id") % 5)
    return rt.search(queries, _index(spark, d), chapters=sets).select("query_id", "rank", "passage_id", F.round("score", 6).alias("score"))


@query("h6_verify_evidence", f"""with {PASSAGES},
evidence as (
  select row_number() over (order by passage_id) as n, book_id, passage_id, chapter_id, chunk_id, content from passages)
select passage_id, case when passage_id like '%0' then false when passage_id like '%1' then false when passage_id like '%2' then contains(content, 'tion the') else true end as valid from evidence""")
def h6(spark, d):
    rows = _passages(spark, d)
    last = F.right("passage_id", F.lit(1))
    evidence = rows.select(
        "book_id", "passage_id", F.when(last == "0", "forged").otherwise(F.col("chapter_id")).alias("chapter_id"), "chunk_id",
        F.when(last == "1", "user_edit").when(last == "3", None).otherwise("original").alias("origin"),
        F.when(last == "2", "tion the").otherwise(F.substring("content", 5, 100)).alias("quote"))
    return rt.verify_evidence(evidence, rows).select("passage_id", "valid")


@query("h7_first_passage", f'with {PASSAGES} select book_id, min_by(passage_id, "offset") as passage_id from passages group by book_id')
def h7(spark, d):
    return rt.first_passage(_passages(spark, d))


@query("l1_retrieval_hits", f"""with {_search_sql()},
hit as (select item_id, coalesce(bool_or(contains(content, text)), false) as hit from benchmark left join found on item_id = query_id group by item_id)
select count(*) as queries, count(case when hit then 1 end) as hits, count(case when hit then 1 end) / count(*) as rate from hit""")
def l1(spark, d):
    return flagship(spark, d)


def flagship(spark, d):
    """Passages of all documents, one index, the benchmark texts as queries, and how many are found again."""
    cases = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("quote"))
    return ev.retrieval_hits_at_k(cases, rt.search(_queries(spark, d), _index(spark, d)))


TRACE = """
trace as (select event_id, user_id::varchar as task_id, case when event_type in ('view', 'click') then 'model_call' when event_type = 'purchase' then 'tool_call' else 'note' end as kind,
  case when event_type = 'error' then 'error' else 'ok' end as status, value as duration_ms, (event_id % 500) as estimated_tokens, case when user_id % 3 > 0 or event_id % 11 > 0 then event_id % 400 end as measured_tokens, ts as time from events)"""


def trace(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "model_call").when(F.col("event_type") == "purchase", "tool_call").otherwise("note")
    return e.select(
        "event_id", F.col("user_id").cast("string").alias("task_id"), kind.alias("kind"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.col("value").alias("duration_ms"), (F.col("event_id") % 500).alias("estimated_tokens"),
        F.when((F.col("user_id") % 3 > 0) | (F.col("event_id") % 11 > 0), F.col("event_id") % 400).alias("measured_tokens"), F.col("ts").alias("time"))


@query("l2_quote_coverage", """
with checks as (select doc_id as item_id, quality = 1 as valid from labels), ok as (select item_id, bool_and(valid) as ok from checks group by item_id)
select count(*) as items, count(case when ok then 1 end) as covered, count(case when ok then 1 end) / count(*) as coverage from (select distinct doc_id as item_id from documents) left join ok using (item_id)""")
def l2(spark, d):
    checks = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), (F.col("quality") == 1).alias("valid"))
    return ev.quote_coverage(table(spark, d, "documents").select(F.col("doc_id").alias("item_id")).distinct(), checks)


@query("l3_run_metrics", f"""with {TRACE}
select task_id, count(case when kind = 'model_call' then 1 end) as model_calls, count(case when kind = 'tool_call' then 1 end) as tool_calls, count(case when status = 'error' then 1 end) as failures,
  sum(case when kind = 'model_call' then estimated_tokens end)::bigint as estimated_tokens,
  case when count(case when kind = 'model_call' then measured_tokens end) = count(case when kind = 'model_call' then 1 end) then sum(case when kind = 'model_call' then measured_tokens end)::bigint end as measured_tokens
from trace group by task_id""")
def l3(spark, d):
    return ev.run_metrics(trace(spark, d))


@query("l4_call_latency", f"with {TRACE} select kind, status, count(*) as calls, round(avg(duration_ms), 6) as avg_ms, max(duration_ms) as max_ms from trace group by kind, status")
def l4(spark, d):
    return ev.call_latency(trace(spark, d))
