"""Queries of sources: the documents are written as files to the shared folder first, then read by the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import pandas_counter, register_counter, token_count
from ..operators import retrieval as rt
from ..sources import corpus
from ..sources.listing import write_texts
from ..stages import new_folder
from .base import SPACE, query, table
from .search_plans import TRACE, trace

BODY = "coalesce(text, '') || chr(10)"


def _texts(spark, d, packed="false"):
    """What write_texts takes: a row for each document, named by its id, compressed where packed holds."""
    key = F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("key")
    return table(spark, d, "documents").select(key, F.coalesce("text", F.lit("")).alias("value"), F.coalesce(F.expr(packed), F.lit(False)).alias("packed"))


def _files(spark, d, packed="false"):
    """One text file per document; returns the folder."""
    folder = new_folder(spark, "texts")
    write_texts(_texts(spark, d, packed), folder)
    return folder


def _doc_id():
    return F.regexp_extract("path", r"doc_(\d+)[^/]*(?:/[^/]*)?$", 1).cast("long").alias("doc_id")


@query("a1_read_txt_corpus", f"select doc_id, strlen({BODY}) as size_bytes from documents")
def a1(spark, d):
    accepted, _ = corpus.read_txt_corpus(spark, _files(spark, d))
    return accepted.select(_doc_id(), "size_bytes")


@query("a1_rejected_files", f"""
select doc_id, reason, n from (
  select doc_id, case when lang = 'fr' then 'wrong_suffix' when strlen({BODY}) > 4000 then 'too_large' end as reason, case when lang <> 'fr' then strlen({BODY}) end as n from documents)
where reason is not null""")
def a1_rejected(spark, d):
    """Texts above a limit, and those of one language that lie there compressed, are on record with the reason."""
    _, rejected = corpus.read_txt_corpus(spark, _files(spark, d, "lang = 'fr'"), max_bytes=4000)
    return rejected.select(_doc_id(), "reason", F.when(F.col("reason") == "too_large", F.col("size_bytes")).alias("n"))


@query("a2_decode_text", rf"""
select doc_id, 'utf-8' as encoding, length(x) as character_count, md5(x) as digest from (select doc_id, regexp_replace({BODY}, '\r\n?', chr(10), 'g') as x from documents)
where regexp_matches(x, '[^{SPACE}]') and length(regexp_replace(x, '[^\x00-\x08\x0B-\x1F]', '', 'g')) <= greatest(5, length(x) // 100)""")
def a2(spark, d):
    accepted, _ = corpus.read_txt_corpus(spark, _files(spark, d))
    good, _ = corpus.decode_text(accepted)
    return good.select(_doc_id(), "encoding", "character_count", F.md5(F.col("text").cast("binary")).alias("digest"))


STAGE = "book_id string, v string, bucket int"


def _staged(spark, d):
    root = new_folder(spark, "stages")
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("book_id"), F.md5(F.col("text").cast("binary")).alias("v"), "lang", "doc_id")
    corpus.write_stage(rows.select("book_id", "v"), root, "digests", buckets=16)
    return root, rows


@query("a3_read_stage", "select doc_id::varchar as book_id, md5(text) as v from documents")
def a3(spark, d):
    return corpus.read_stage(spark, _staged(spark, d)[0], "digests", STAGE).select("book_id", "v")


@query("a4_write_stage", "select doc_id::varchar as book_id, case when lang = 'en' then 'edited' else md5(text) end as v from documents")
def a4(spark, d):
    """The documents of one language are replaced, all others stay as they are."""
    root, rows = _staged(spark, d)
    corpus.write_stage(rows.filter("lang = 'en'").select("book_id", F.lit("edited").alias("v")), root, "digests", buckets=16)
    return corpus.read_stage(spark, root, "digests", STAGE).select("book_id", "v")


@query("a6_read_trace", f"with {TRACE} select time, kind, task_id, status, duration_ms, estimated_tokens, measured_tokens from trace")
def a6(spark, d):
    folder = new_folder(spark, "trace")
    records = trace(spark, d).drop("event_id").withColumn("time", F.col("time").cast("timestamp"))
    records.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(folder)
    return corpus.read_trace(spark, folder).withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("m3_counter", "select doc_id, coalesce(length(text), 0)::bigint as regular, coalesce(len(string_split(text, ' ')), 0)::bigint as pandas from documents")
def m3(spark, d):
    """Two counters registered by name: one of built-in functions, one of Python in Arrow batches."""
    register_counter("characters", lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long"))
    register_counter("spaces", pandas_counter(lambda t: t.count(" ") + 1))
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", token_count(text, "characters").alias("regular"), token_count(text, "spaces").alias("pandas"))


@query("h3_stored_index", "select count(*) as n, 1 as indexes from (select unnest(range(0, length(text), 1000)) from documents)")
def h3_stored(spark, d):
    """The index is written for the first asker; equal chunks find it again."""
    root = new_folder(spark, "index")
    chunks = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("book_id"), F.lit("c").alias("chapter_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.lit(1).alias("ordinal"),
        F.col("text").alias("content"), F.lit(False).alias("is_edited"))
    rt.stored_index(chunks, root)
    again = rt.stored_index(chunks.repartition(3), root)
    where = F.regexp_extract(F.input_file_name(), "(index-[^/]*)/", 1)
    return again.passages.select(where.alias("folder")).agg(F.count("*").alias("n"), F.count_distinct("folder").cast("int").alias("indexes"))
