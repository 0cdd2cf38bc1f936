"""What is still to do, what an edit invalidates, and where every task stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What each kind of change drops.
DROPS = {
    "chunk_edit": ("plan", "batch_summary", "merge", "outline", "knowledge"),
    "summary_edit": ("merge", "outline", "knowledge"),
    "outline_edit": (),
}


def pending_work(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Units of the plan (plan_id, unit_id, input_fingerprint) that have no result for these very inputs."""
    return plan.join(results.select("plan_id", "unit_id", "input_fingerprint"), ["plan_id", "unit_id", "input_fingerprint"], "left_anti")


def invalidate_downstream(artifacts: DataFrame, changes: DataFrame) -> DataFrame:
    """Artifacts (book_id, stage) that survive the changes (book_id, change)."""
    dropped = artifacts.sparkSession.createDataFrame([(c, s) for c, stages in DROPS.items() for s in stages], "change string, stage string")
    gone = changes.select("book_id", "change").join(F.broadcast(dropped), "change").select("book_id", "stage").distinct()
    return artifacts.join(gone, ["book_id", "stage"], "left_anti")


def summaries_revision(summaries: DataFrame) -> DataFrame:
    """book_id, revision: a hash over the ordered summaries and their edit times."""
    one = F.struct("batch_no", "summary", "edited_at")
    return summaries.groupBy("book_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(one))), 256).alias("revision"))


def apply_latest(rows: DataFrame, edits: DataFrame, key: str, value: str) -> DataFrame:
    """rows with value replaced by the latest edit of its key (key, value, edited_at), and user_edited_at."""
    newest = edits.groupBy(key).agg(F.max_by(value, F.struct("edited_at", value)).alias("__v"), F.max("edited_at").alias("user_edited_at"))
    out = rows.join(newest, key, "left")
    return out.withColumn(value, F.coalesce("__v", value)).drop("__v")


def task_status(units: DataFrame) -> DataFrame:
    """task_id, total, completed, failed, current_unit, attempts, state from unit rows (task_id, unit_no, status, attempts)."""
    rows = units.groupBy("task_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.min(F.when(F.col("status") != "completed", F.col("unit_no"))).alias("current_unit"), F.sum("attempts").alias("attempts"),
        F.count_if(F.col("status") == "running").alias("__running"),
    )
    state = F.when(F.col("failed") > 0, "failed").when(F.col("completed") == F.col("total"), "completed").when((F.col("__running") > 0) | (F.col("completed") > 0), "running").otherwise("pending")
    return rows.withColumn("state", state).drop("__running")


def reset_stale(units: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, with running and failed ones of inactive tasks pending again; the tasks interrupted by that)."""
    rows = units.join(active.select("task_id").distinct().withColumn("__on", F.lit(True)), "task_id", "left")
    stale = F.col("__on").isNull() & F.col("status").isin("running", "failed")
    rows = rows.withColumn("__stale", stale)
    out = rows.withColumn("status", F.when(F.col("__stale"), "pending").otherwise(F.col("status"))).drop("__on", "__stale")
    return out, rows.filter("__stale").select("task_id", F.lit("interrupted").alias("state")).distinct()


def remaining_calls(plan: DataFrame, batches: DataFrame, merges: DataFrame) -> DataFrame:
    """book_id, remaining: pending batches plus the larger of planned and known merge work, less what is done.

    plan: book_id, planned_merges; batches: book_id, status; merges: book_id, level, node_id, inputs, status.
    Inputs of a level that no node of the next level covers count as one more call each pair.
    """
    left = batches.groupBy("book_id").agg(F.count_if(F.col("status") != "completed").alias("pending"))
    covered = merges.select("book_id", F.explode("inputs").alias("node_id")).distinct()
    top = merges.join(covered, ["book_id", "node_id"], "left_anti").groupBy("book_id").agg(F.count("*").alias("loose"))
    known = merges.groupBy("book_id").agg(F.count("*").alias("known"), F.count_if(F.col("status") == "completed").alias("done"))
    rows = plan.join(left, "book_id", "left").join(known, "book_id", "left").join(top, "book_id", "left").fillna(0)
    work = F.greatest("planned_merges", F.col("known") + F.ceil(F.greatest(F.lit(0), F.col("loose") - 1) / 2)) - F.col("done")
    return rows.select("book_id", (F.col("pending") + F.greatest(F.lit(0), work)).cast("bigint").alias("remaining"))


def library(books: DataFrame, plans: DataFrame, status: DataFrame) -> DataFrame:
    """Bookshelf rows, newest first: book_id, filename, updated_at, batch_count, completed, stage."""
    rows = books.join(plans.select("book_id", "batch_count"), "book_id", "left").join(status.select(F.col("task_id").alias("book_id"), "completed", "state"), "book_id", "left")
    stage = F.when(F.col("batch_count").isNull(), "parsed").when(F.col("state").isNull(), "planned").otherwise(F.col("state"))
    return rows.select("book_id", "filename", "updated_at", "batch_count", "completed", stage.alias("stage")).orderBy(F.desc("updated_at"), "book_id")


def contract_violations(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    """df with violations: the names of the conditions (SQL) that a row breaks; null conditions count as broken."""
    broken = F.array(*[F.when(~F.coalesce(F.expr(cond), F.lit(False)), F.lit(name)) for name, cond in contract.items()])
    return df.withColumn("violations", F.filter(broken, lambda x: x.isNotNull()))


def count_consistency(manifest: DataFrame, children: DataFrame, key: str, declared: str) -> DataFrame:
    """key, declared, actual of rows whose declared count is not the number of their children."""
    counts = children.groupBy(key).agg(F.count("*").alias("actual"))
    rows = manifest.select(key, declared).join(counts, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return rows.filter(F.col(declared) != F.col("actual"))


def latest(rows: DataFrame, key: str, time: str) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(F.desc(time))
    return rows.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")
