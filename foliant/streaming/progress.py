"""Progress and trace streams, and incremental ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import is_terminal, phase
from ..operators.retrieval import passages
from ..operators.structure import chapters
from ..sources.corpus import decoded, judged, read_txt_corpus, sorted_out
from ..sources.listing import LISTED, files, reading_tasks, with_contents
from ..stages import bucketed, exists, saved, spent

MANIFEST = "task_id string, status string, completed int, total int, updated_at timestamp"


def snapshots(manifests: DataFrame) -> DataFrame:
    """Compact snapshots with an id from their content; works on batch and streaming tables."""
    event = F.substring(F.sha2(F.to_json(F.struct("completed", "status", "task_id", "total", "updated_at")), 256), 1, 16)
    return manifests.select(event.alias("event_id"), "task_id", phase(F.col("status")).alias("phase"), is_terminal(F.col("status")).alias("terminal"), "completed", "total", "updated_at")


def stream_progress(manifests: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Snapshots, each state once: repeats within the watermark are dropped."""
    return snapshots(manifests).withWatermark("updated_at", lateness).dropDuplicatesWithinWatermark(["event_id"])


def stream_latest(progress: DataFrame) -> DataFrame:
    """The current snapshot of each task; for update mode. The query's checkpoint stands for the last seen id."""
    last = F.max_by(F.struct("event_id", "phase", "terminal", "completed", "total"), F.struct("updated_at", "event_id"))
    return progress.groupBy("task_id").agg(last.alias("s"), F.max("updated_at").alias("updated_at")).select("task_id", "s.*", "updated_at")


CHANGE = "event_id string, task_id string, phase string, terminal boolean, completed int, total int, updated_at timestamp"
CHANGED = [field.split()[0] for field in CHANGE.split(", ")]


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What goes out of one task's snapshots of one batch; a task that has ended costs neither a sort nor a frame."""
    last, ended = state.get if state.exists else (None, False)
    if ended:
        return  # nothing goes out after the end, and the state stays
    parts = list(batches)
    rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    events, times, terminal = rows["event_id"].tolist(), rows["updated_at"].astype("int64").tolist(), rows["terminal"].tolist()
    order = sorted(range(len(events)), key=lambda i: (times[i], events[i]))
    if not state.exists:
        last = rows["last_seen"].iloc[0]
        last = None if pd.isna(last) else last
        met = [n for n, i in enumerate(order) if last is not None and events[i] == last]
        order = order[met[-1] + 1 :] if met else order
    out = []
    for i in order:
        if events[i] != last:
            out.append(i)
            last = events[i]
        if terminal[i]:
            ended = True
            break
    state.update((last, ended))
    if out:
        yield rows[CHANGED].take(out)


def stream_changes(progress: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The snapshots of each task in order, where they change, up to the terminal one; for append mode.

    State per task is the last id that went out and whether the task has ended, so a restarted query goes on
    after it. seen (task_id, last_seen; one row a task): ids that a reader has already; a task starts after that
    snapshot if it comes, and does not repeat it. Within a batch snapshots are ordered by updated_at, then event_id.
    """
    known = seen.select("task_id", F.col("last_seen").cast("string").alias("last_seen")) if seen is not None else None
    rows = progress.join(known, "task_id", "left") if known is not None else progress.withColumn("last_seen", F.lit(None).cast("string"))

    return rows.groupBy("task_id").applyInPandasWithState(_changes, CHANGE, "last string, ended boolean", "append", GroupStateTimeout.NoTimeout)


def run_available(frame: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a streaming table over what its source holds now, from its checkpoint on, and wait for the end."""
    frame.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_trace_totals(trace: DataFrame) -> DataFrame:
    """task_id, kind, calls, tokens, total_ms."""
    return trace.groupBy("task_id", "kind").agg(F.count("*").alias("calls"), F.sum("estimated_tokens").alias("tokens"), F.sum("duration_ms").alias("total_ms"))


def stream_ingest(spark: SparkSession, path: str, checkpoint: str, write: Callable[[DataFrame, str], None]):
    """New text files through decoding, chapters and passages, once each; returns the started query.

    The batch function sees whole files, as headings need loops; write(df, name) appends a table. Files that
    the checks of read_txt_corpus or all encodings reject go to the table rejected, with the reason. The folder is
    listed in tasks; what no earlier listing has goes to a log in the checkpoint's folder, and the stream reads that
    log, so that no batch names its files one by one to be looked up again. A batch's texts lie in buckets by book
    until it ends, so no text is shuffled, however often chapters and passages are cut from it.
    """
    log, found = f"{checkpoint}/listed", files(spark, path)
    there = exists(spark, log)
    fresh = found.join(spark.read.schema(LISTED).parquet(log).select("path"), "path", "left_anti").select(found.columns) if there else found
    if not there or not fresh.isEmpty():
        fresh.write.mode("append").parquet(log)

    def batch(rows: DataFrame, _: int) -> None:
        checked = judged(rows)
        good = checked.filter("reason is null").select(F.md5(F.col("path").cast("binary")).alias("book_id"), "path", "length")
        tasks = reading_tasks(good)
        texts = bucketed(decoded(with_contents(good, path, tasks, "book_id").drop("length")), "ingest-texts", "book_id", tasks)
        try:
            taken(checked, texts)
        finally:
            spent(texts)

    def taken(checked: DataFrame, texts: DataFrame) -> None:
        books, bad = sorted_out(texts)
        write(checked.filter("reason is not null").select("path", "reason").union(bad.select("path", "reason")), "rejected")
        found = saved(chapters(books), "ingest-chapters")
        whole = found.join(books.select("book_id", "text"), "book_id").select(
            "book_id", "chapter_id", F.col("chapter_id").alias("chunk_id"), "ordinal",
            F.substring("text", (F.col("content_start") + 1).cast("int"), F.col("character_count").cast("int")).alias("content"), F.lit(False).alias("is_edited"),
        )
        write(books, "books")
        write(found, "chapters")
        write(passages(whole), "passages")
        spent(found)

    listed = spark.readStream.schema(LISTED).parquet(log)
    return listed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["MANIFEST", "read_txt_corpus", "run_available", "snapshots", "stream_changes", "stream_ingest", "stream_latest", "stream_progress", "stream_trace_totals"]
