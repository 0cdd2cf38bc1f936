"""Rollups over retrieval results, evidence checks and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_hits_at_k(cases: DataFrame, results: DataFrame, k: int = 4) -> DataFrame:
    """One row: queries, hits, rate; a hit is a quote contained in one of the query's k best passages."""
    top = results.filter(F.col("rank") <= k).select("query_id", "content")
    hit = cases.join(top, "query_id", "left").groupBy("query_id").agg(F.bool_or(F.coalesce(F.contains("content", "quote"), F.lit(False))).alias("hit"))
    return hit.agg(F.count("*").alias("queries"), F.count_if("hit").alias("hits"), (F.count_if("hit") / F.nullif(F.count("*"), F.lit(0))).alias("rate"))


def quote_coverage(items: DataFrame, checks: DataFrame) -> DataFrame:
    """One row: items, covered (with evidence, all of it valid), coverage (null without items)."""
    ok = checks.groupBy("item_id").agg(F.bool_and("valid").alias("ok"))
    rows = items.select("item_id").join(ok, "item_id", "left").agg(F.count("*").alias("items"), F.count_if(F.coalesce("ok", F.lit(False))).alias("covered"))
    return rows.withColumn("coverage", F.col("covered") / F.nullif("items", F.lit(0)))


def run_metrics(trace: DataFrame) -> DataFrame:
    """task_id, model_calls, tool_calls, failures, estimated_tokens, measured_tokens (only if every call reports them)."""
    call = F.col("kind") == "model_call"
    return trace.groupBy("task_id").agg(
        F.count_if(call).alias("model_calls"), F.count_if(F.col("kind") == "tool_call").alias("tool_calls"), F.count_if(F.col("status") == "error").alias("failures"),
        F.sum(F.when(call, F.col("estimated_tokens"))).alias("estimated_tokens"),
        F.when(F.count(F.when(call, F.col("measured_tokens"))) == F.count_if(call), F.sum(F.when(call, F.col("measured_tokens")))).alias("measured_tokens"),
    )


def call_latency(trace: DataFrame) -> DataFrame:
    """kind, status, calls, avg_ms, max_ms."""
    return trace.groupBy("kind", "status").agg(F.count("*").alias("calls"), F.round(F.avg("duration_ms"), 6).alias("avg_ms"), F.max("duration_ms").alias("max_ms"))
