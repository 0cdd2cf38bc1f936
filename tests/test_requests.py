"""Golden cases of model jobs, hierarchies and provenance."""

import json

from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.operators import hierarchy as hi
from foliant.operators import incremental as inc
from foliant.operators import requests as rq
from foliant.stages import settled


class Scripted:
    """Refuses each prompt as often as its last digit says."""

    def __init__(self):
        self.calls = {}

    def generate(self, prompt):
        self.calls[prompt] = self.calls.get(prompt, 0) + 1
        if prompt.startswith("bad"):
            raise rq.CallError("provider_http_401", False)
        if self.calls[prompt] <= int(prompt[-1]):
            raise rq.CallError("provider_http_429", True)
        return {"content": "ok", "model": "m", "request_id": prompt, "input_tokens": 1, "output_tokens": 1}


def test_retries(spark):
    rows = spark.createDataFrame([("a", "x0"), ("b", "x2"), ("c", "x3"), ("d", "bad0")], "unit_id string, prompt string")
    got = {r.unit_id: (r.content, r.code, len(r.attempts)) for r in rq.generate(rows, Scripted, 2, base_delay=0.0).collect()}
    assert got == {"a": ("ok", None, 1), "b": ("ok", None, 3), "c": (None, "provider_http_429", 3), "d": (None, "provider_http_401", 1)}


def test_code_fence_and_shorthand(spark):
    item = {"description": "d", "sources": ["i1"], "confidence": "certain"}
    full = {"description": "e", "sources": {"input_ids": ["i2"], "batch_ids": ["b"], "chapter_ids": []}}
    rows = spark.createDataFrame([("a", "```json\n" + json.dumps({"claims": [item, full]}) + "\n```"), ("b", "{"), ("c", "{}")], "unit_id string, content string")
    good, bad = rq.parse_items(rows, "claims")
    got = [(r.description, r.sources.input_ids, r.confidence) for r in good.orderBy("pos").collect()]
    assert got == [("d", ["i1"], "certain"), ("e", ["i2"], "likely")]
    assert {r.unit_id: r.code for r in bad.collect()} == {"b": "invalid_json", "c": "missing_field"}
    assert not any("{" in r.message for r in bad.collect())


def test_confidence_cannot_rise(spark):
    items = spark.createDataFrame([("i", "b", ["x"], "text", "certain"), ("j", "b", ["x"], "text", None)], "item_id string, book_id string, input_ids array<string>, description string, confidence string")
    inputs = spark.createDataFrame([("b", "x", 2)], "book_id string, input_id string, worst int")
    got = {r.item_id: (r.confidence, r.description) for r in hi.confidence_floor(items, inputs).collect()}
    assert got == {"i": ("uncertain", "text"), "j": (None, "[uncertain] text")}


def _tree(spark, n, tokens, limit):
    rows = spark.createDataFrame([("b", i, f"x{i}", f"f{i}", f"r{i}", [f"x{i}"], [f"c{i}"], "p", tokens) for i in range(1, n + 1)],
                                 "book_id string, pos int, input_id string, fingerprint string, label string, batch_ids array<string>, chapter_ids array<string>, payload string, tokens long")
    calls = []

    def merge(groups):
        calls.append(groups.count())
        return groups.select("book_id", "group", F.lit("m").alias("payload"), F.lit(tokens).cast("long").alias("tokens"))

    return (*hi.merge_tree(rows, limit, 10, merge, lambda df, _: settled(df)), calls)


def test_merge_tree_covers_all_leaves(spark):
    roots, errors, calls = _tree(spark, 40, 50, 300)
    rows = roots.orderBy("pos").collect()
    assert errors.isEmpty() and max(r.level for r in rows) == len(calls) >= 2
    assert [b for r in rows for b in r.batch_ids] == [f"x{i}" for i in range(1, 41)]
    assert _tree(spark, 40, 50, 300)[0].orderBy("pos").select("input_id").collect() == [(r.input_id,) for r in rows]


def test_merge_errors(spark):
    assert [r.code for r in _tree(spark, 3, 400, 300)[1].collect()] == ["merge_input_too_large"]
    assert [r.code for r in _tree(spark, 3, 200, 300)[1].collect()] == ["merge_cannot_reduce"]


def test_no_inputs_is_an_error(spark):
    books = spark.createDataFrame([("b",), ("c",)], "book_id string")
    roots = spark.createDataFrame([("b", 1, ["x"], ["c"], "p", 0)], "book_id string, pos int, batch_ids array<string>, chapter_ids array<string>, payload string, level int")
    assert [(r.book_id, r.code) for r in hi.final_outline(books, roots)[1].collect()] == [("c", "no_inputs")]


def test_rerun_has_nothing_pending(spark):
    plan = spark.createDataFrame([("p", "u1", "f1"), ("p", "u2", "f2")], "plan_id string, unit_id string, input_fingerprint string")
    assert inc.pending_work(plan, plan).isEmpty()
    assert inc.pending_work(plan, plan.withColumn("input_fingerprint", F.lit("f1"))).first().unit_id == "u2"


def test_edits_drop_what_depends_on_them(spark):
    stages = ["plan", "batch_summary", "merge", "outline", "knowledge"]
    artifacts = spark.createDataFrame([("a", s) for s in stages] + [("b", s) for s in stages], "book_id string, stage string")
    changes = spark.createDataFrame([("a", "chunk_edit"), ("b", "summary_edit")], "book_id string, change string")
    assert sorted(map(tuple, inc.invalidate_downstream(artifacts, changes).collect())) == [("b", "batch_summary"), ("b", "plan")]


def test_html_is_escaped(spark):
    assert spark.range(1).select(t.html_escape(F.lit("<script>&'\""))).first()[0] == "&lt;script&gt;&amp;&#x27;&quot;"


def test_books_that_no_merge_reduces_have_no_outline(spark, tmp_path):
    from oracle import expected, rows

    from foliant.plans import registry

    turns = [(1, ["a " * 400, "b " * 400]), (2, ["c " * 620]), (3, ["x"]), (4, ["d " * 300, "e " * 350, "f " * 320])]
    table = [(book, turn, "user", text) for book, texts in turns for turn, text in enumerate(texts)]
    spark.createDataFrame(table, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "conversations.parquet")
    (tmp_path / "made").rename(tmp_path.with_name(tmp_path.name + "-rest"))
    found = registry.queries()["g10_final_outline"](spark, str(tmp_path)).toPandas()
    assert {r.book_id: r.n_batches for r in found.itertuples()} == {"3": 1, "4": 3}
    assert rows(found) == rows(expected(registry.oracle_sql()["g10_final_outline"], str(tmp_path)))
