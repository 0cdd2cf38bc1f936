"""Model answers: what fits the schema is typed, all else is a failure with its place."""

import json

import pytest

from foliant.operators import answers as an

CLAIM = {"description": "d", "chapter_ids": ["c1"], "source_chunk_ids": ["k1"]}
SUMMARY = {"overview": "o", "key_events": [CLAIM, {**CLAIM, "confidence": "likely"}], "worldbuilding": [{**CLAIM, "category": "rule", "name": "n"}]}
POINT = {"description": "p", "sources": {"input_ids": ["i1"], "chapter_ids": ["c"]}, "confidence": "uncertain"}
RANGE = {"chapter_range": "1-2", "summary": "s", "key_events": ["e"], "sources": ["i1", "i2"]}
MERGE = {"overview": "o", "chapter_outline": [RANGE], "key_events": [POINT]}
OUTLINE = {"overall_summary": "o", "chapter_outline": [RANGE], "storylines": [{"name": "n", "summary": "s", "sources": ["i1"]}], "conflicts_and_uncertainties": [POINT]}


def changed(base, path, value):
    """base with another value at a path; ... takes the field away."""
    base = json.loads(json.dumps(base))
    at = base
    for p in path[:-1]:
        at = at[p]
    if value is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return base


def run(spark, parse, cases, strict=True, **allowed):
    columns = list(allowed)
    rows = [(str(i), c if c is None or isinstance(c, str) else json.dumps(c, ensure_ascii=False), *allowed.values()) for i, c in enumerate(cases)]
    table = spark.createDataFrame(rows, "unit_id string, content string" + "".join(f", {c} array<string>" for c in columns))
    good, bad = parse(table, strict)
    return {int(r.unit_id): r for r in good.collect()}, {int(r.unit_id): r for r in bad.collect()}


def test_summaries(spark):
    fenced = "```json\n" + json.dumps(SUMMARY) + "\n```"
    good, bad = run(spark, an.parse_summaries, [SUMMARY, fenced, {"overview": "only"}])
    assert not bad and good[0].overview == "o" and good[1] == type(good[1])(**{**good[0].asDict(), "unit_id": "1"})
    assert [(e.description, e.chapter_ids, e.source_chunk_ids, e.confidence) for e in good[0].key_events] == [("d", ["c1"], ["k1"], "certain"), ("d", ["c1"], ["k1"], "likely")]
    assert good[0].worldbuilding[0].category == "rule" and good[2].characters == [] and good[2].key_events == []


WRONG = [
    ("overview", (), "overview", ..., "missing"), ("null", (), "overview", None, "wrong_type"), ("number", (), "overview", 5, "wrong_type"), ("empty", (), "overview", "", "too_short"),
    ("long", (), "overview", "x" * 12_001, "too_long"), ("list", (), "key_events", {}, "wrong_type"), ("null list", (), "key_events", None, "wrong_type"), ("item", ("key_events",), 1, "text", "wrong_type"),
    ("no ids", ("key_events", 0), "chapter_ids", [], "too_short"), ("ids", ("key_events", 0), "chapter_ids", ..., "missing"), ("id type", ("key_events", 0), "chapter_ids", ["c", 1], "wrong_type"),
    ("choice", ("key_events", 1), "confidence", "sure", "not_allowed"), ("category", ("worldbuilding", 0), "category", ..., "missing"),
]


@pytest.mark.parametrize("strict", [True, False])
def test_summary_violations(spark, strict):
    cases = [changed(SUMMARY, (*path, field), value) for _, path, field, value, _ in WRONG]
    good, bad = run(spark, an.parse_summaries, cases, strict)
    assert not good
    for i, (_, path, field, _, code) in enumerate(WRONG):
        assert (bad[i].code, bad[i].at, bad[i].n_wrong) == (code, ".".join(map(str, (*path, field))), 1)
        assert bad[i].message == f"summary: {code} at {bad[i].at}"


def test_unknown_fields_and_broken_answers(spark):
    cases = [{**SUMMARY, "secret words": 1}, changed(SUMMARY, ("key_events", 1, "extra"), 2), "{broken secret", "[]", '"text"', None, "null", "{}"]
    good, bad = run(spark, an.parse_summaries, cases)
    assert not good and [(bad[i].code, bad[i].at) for i in range(8)] == [
        ("unknown_field", ""), ("unknown_field", "key_events.1"), ("invalid_json", ""), ("wrong_type", ""), ("wrong_type", ""), ("invalid_json", ""), ("wrong_type", ""), ("missing", "overview")]
    assert not any("secret" in r.message for r in bad.values())
    good, bad = run(spark, an.parse_summaries, cases[:2], strict=False)
    assert set(good) == {0, 1}


@pytest.mark.parametrize("parse, base", [(an.parse_merges, MERGE), (an.parse_outlines, OUTLINE)])
def test_sources_and_shorthand(spark, parse, base):
    cases = [base, changed(base, ("chapter_outline", 0, "sources"), []), changed(base, ("chapter_outline", 0, "sources"), "i1"), changed(base, ("chapter_outline", 0, "sources"), ...),
             changed(base, ("chapter_outline", 0, "sources"), {"batch_ids": ["b"]}), changed(base, ("chapter_outline", 0, "sources"), ["elsewhere"]), changed(base, ("chapter_outline", 0, "sources"), {"input_ids": ["i1"], "x": []})]
    good, bad = run(spark, parse, cases, allowed_ids=["i1", "i2"])
    assert set(good) == {0} and tuple(good[0].chapter_outline[0].sources) == (["i1", "i2"], [], [])
    points = good[0].key_events if "key_events" in base else good[0].conflicts_and_uncertainties
    assert tuple(points[0].sources) == (["i1"], [], ["c"]) and points[0].confidence == "uncertain"
    at = "chapter_outline.0.sources"
    assert [(bad[i].code, bad[i].at) for i in range(1, 7)] == [("too_short", at), ("wrong_type", at), ("missing", at), ("missing", f"{at}.input_ids"), ("outside", "input_ids"), ("unknown_field", at)]


def test_summaries_cite_only_their_batch(spark):
    good, bad = run(spark, an.parse_summaries, [SUMMARY, changed(SUMMARY, ("key_events", 0, "chapter_ids"), ["c9"]), changed(SUMMARY, ("key_events", 0, "source_chunk_ids"), ["k9"])], allowed_chapters=["c1"], allowed_chunks=["k1"])
    assert set(good) == {0} and [(bad[i].code, bad[i].at) for i in (1, 2)] == [("outside", "chapter_ids"), ("outside", "source_chunk_ids")]


def test_failures_compute_an_answer_once(spark):
    rows = spark.createDataFrame([("a", "{}", ["c"])], "unit_id string, content string, allowed_ids array<string>")
    plan = an.parse_merges(rows, strict=True)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 3 and not any("variant" in line for line in plan.splitlines() if "Filter" in line)
