"""Queries that run the streams themselves: the tables arrive in two parts, and each stream takes up where it stopped."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.listing import remove_texts, write_texts
from ..stages import new_folder
from ..streaming import progress as pr
from .base import SPACE, query, table
from .knowledge_plans import PHASES, _manifests
from .search_plans import TRACE, trace
from .source_plans import BODY, _doc_id, _texts

LOT, LOTS = 512 << 20, 8  # bytes of texts that lie there as files at once, at least; lots at most, as each reads the table


def _streamed(spark, rows, time, run, mode="append"):
    """What a stream run(source) gives when rows arrive in two parts by time and it is started anew for each."""
    folder, checkpoint, out = (new_folder(spark, n) for n in ("stream-in", "stream-checkpoint", "stream-out"))
    middle = rows.agg(F.expr(f"timestamp_micros((unix_micros(min(cast({time} as timestamp))) + unix_micros(max(cast({time} as timestamp)))) div 2)")).first()[0]
    early = F.col(time).cast("timestamp") <= F.lit(middle)
    for part in (early, ~early):
        rows.filter(part).write.mode("append").parquet(folder)
        write = lambda df, n: df.write.mode("append" if mode == "append" else "overwrite").parquet(out)
        pr.run_available(run(spark.readStream.schema(rows.schema).parquet(folder)), checkpoint, write, mode)
    return spark.read.parquet(out)


@query("k1_stream_progress", f"select user_id::varchar as task_id, {PHASES} as phase, event_type in ('purchase', 'error') as terminal, (event_id % 50)::int as completed, ts as updated_at from events")
def k1_stream(spark, d):
    rows = _manifests(spark, d)
    found = _streamed(spark, rows.withColumn("updated_at", F.col("updated_at").cast("timestamp")), "updated_at", lambda s: pr.stream_progress(s, "3650 days"))
    return found.select("task_id", "phase", "terminal", "completed", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("k2_stream_changes", f"""
with e as (
  select user_id::varchar as task_id, {PHASES} as phase, event_type in ('purchase', 'error') as terminal, (event_id % 50)::int as completed, ts as updated_at, event_id,
    row_number() over (partition by user_id order by ts, event_id) as n from events),
firsts as (select task_id, min(n) filter (terminal and (n > 1 or task_id::bigint % 2 = 1)) as last from e group by task_id)
select task_id, phase, terminal, completed, updated_at from e join firsts using (task_id) where n <= coalesce(last, n) and (n > 1 or task_id::bigint % 2 = 1)""")
def k2_changes(spark, d):
    """Readers of every second task have seen its first snapshot; all are served up to the first terminal one after that."""
    rows = _manifests(spark, d)
    rows = rows.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    first = pr.snapshots(rows).groupBy("task_id").agg(F.min_by("event_id", "updated_at").alias("last_seen"))
    seen = first.filter("cast(task_id as bigint) % 2 = 0")
    found = _streamed(spark, rows, "updated_at", lambda s: pr.stream_changes(pr.snapshots(s), seen))
    return found.select("task_id", "phase", "terminal", "completed", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("k2_stream_latest", f"select user_id::varchar as task_id, max_by({PHASES}, ts) as phase, max_by((event_id % 50)::int, ts) as completed, max(ts) as updated_at from events group by user_id")
def k2_latest(spark, d):
    rows = _manifests(spark, d)
    found = _streamed(spark, rows.withColumn("updated_at", F.col("updated_at").cast("timestamp")), "updated_at", lambda s: pr.stream_latest(pr.snapshots(s)), "complete")
    return found.select("task_id", "phase", "completed", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("k3_stream_totals", f"with {TRACE} select task_id, kind, count(*) as calls, sum(estimated_tokens)::bigint as tokens, round(sum(duration_ms), 4) as total_ms from trace group by task_id, kind")
def k3_stream(spark, d):
    rows = trace(spark, d)
    found = _streamed(spark, rows.withColumn("time", F.col("time").cast("timestamp")), "time", pr.stream_trace_totals, "complete")
    return found.withColumn("total_ms", F.round("total_ms", 4))


@query("k4_stream_ingest", rf"""
select doc_id, count(*) as n_passages, sum(least(1200, n - o))::bigint as n_chars from (
  select doc_id, length(x) as n, unnest(range(0, length(x), 1000)) as o from (select doc_id, regexp_replace({BODY}, '\r\n?', chr(10), 'g') as x from documents)
  where regexp_matches(x, '[^{SPACE}]') and length(regexp_replace(x, '[^\x00-\x08\x0B-\x1F]', '', 'g')) <= greatest(5, length(x) // 100)) group by doc_id""")
def k4(spark, d):
    """All documents as files, taken in by the stream; a second run finds nothing new.

    Small files fill whole blocks of a disk, so many documents come in lots; a lot goes when both runs are over.
    """
    folder, out, checkpoint = (new_folder(spark, n) for n in ("texts", "ingested", "ingest-checkpoint"))
    rows = _texts(spark, d)
    lots = min(LOTS, (rows.agg(F.sum(F.octet_length("value"))).first()[0] or 0) // LOT + 1)
    write = lambda df, name: df.write.mode("append").option("compression", "zstd").parquet(f"{out}/{name}")
    for lot in range(lots):
        write_texts(rows.filter(F.pmod(F.xxhash64("key"), F.lit(lots)) == lot), f"{folder}/{lot}")
        for _ in range(2):
            pr.stream_ingest(spark, folder, checkpoint, write).awaitTermination()
        remove_texts(spark, f"{folder}/{lot}")
    books = spark.read.parquet(f"{out}/books").select("book_id", _doc_id())
    found = spark.read.parquet(f"{out}/passages").select("book_id", F.length("content").alias("n")).join(books, "book_id").groupBy("doc_id")
    return found.agg(F.count("*").alias("n_passages"), F.sum("n").cast("long").alias("n_chars"))
