"""Golden cases of retrieval, evidence and the knowledge graph."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.operators import evaluation as ev
from foliant.operators import knowledge as kn
from foliant.operators import retrieval as rt
from foliant.stages import settled, shared_folder

CHUNK = "book_id string, chapter_id string, chunk_id string, ordinal int, content string, is_edited boolean"


def chunked(spark, *texts, edited=False):
    return spark.createDataFrame([("b", f"c{i}", f"k{i}", i, x, edited) for i, x in enumerate(texts)], CHUNK)


def passages(spark, *texts, edited=False):
    return rt.passages(chunked(spark, *texts, edited=edited))


def find(spark, chunks, query, k=4, chapters=None):
    queries = spark.createDataFrame([("q", "b", query, "s")], "query_id string, book_id string, query string, chapter_set string")
    index = rt.stored_index(chunks, shared_folder(spark))
    return [r.chapter_id for r in rt.search(queries, index, k, chapters).orderBy("rank").collect()] if chapters else [
        r.chapter_id for r in rt.search(queries.drop("chapter_set"), index, k).orderBy("rank").collect()]


def test_passages_overlap_and_keep_the_tail(spark):
    rows = passages(spark, "x" * 2100).orderBy("offset").collect()
    assert [(r.offset, len(r.content)) for r in rows] == [(0, 1200), (1000, 1100), (2000, 100)]


def test_search_ranks_and_restricts(spark):
    rows = chunked(spark, "林舟回到故乡。", "阿舟离开了山城。", "林舟与阿舟在雨夜重逢，林舟沉默。", "完全无关")
    assert find(spark, rows, "林舟")[0] == "c0" and set(find(spark, rows, "林舟")) == {"c0", "c2"}
    only = spark.createDataFrame([("s", "c2"), ("other", "c0")], "chapter_set string, chapter_id string")
    assert find(spark, rows, "林舟", chapters=only) == ["c2"]
    assert find(spark, rows, "缺席") == []


def test_equal_contents_of_a_chapter_are_one_hit(spark):
    rows = spark.createDataFrame([("b", "c", f"k{i}", i, "same words", False) for i in range(5)], CHUNK)
    assert find(spark, rows, "same") == ["c"]
    assert find(spark, rows.limit(0), "same") == []


def bm25(texts, query, allowed):
    """The ranked numbers of texts by the formula, over all of them."""
    sets = [set(re.findall(r"[a-z0-9_]+", t.lower())) for t in texts]
    avg, scores = sum(map(len, sets)) / len(sets), {}
    for t in dict.fromkeys(re.findall(r"[a-z0-9_]+", query.lower())):
        df = sum(t in s for s in sets)
        idf = max(1e-6, math.log((len(sets) - df + 0.5) / (df + 0.5))) if df else 0
        for i in allowed:
            if t in sets[i]:
                scores[i] = scores.get(i, 0) + idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(sets[i]) / avg))
    return {i: round(x, 9) for i, x in scores.items()}


@pytest.mark.parametrize("page_bits, wanted", [(6, 6), (6, 40), (7, 12)])
def test_search_equals_brute_force(spark, monkeypatch, page_bits, wanted):
    """Hot words, rare words, unlike lengths; few candidates and small pages, so that terms, pages and passages are skipped."""
    monkeypatch.setattr(rt, "PAGE_BITS", page_bits)
    monkeypatch.setattr(rt, "PAGE", 1 << rt.PAGE_BITS)
    monkeypatch.setattr(rt, "CANDIDATES", wanted)
    monkeypatch.setattr(rt, "SEEDS", 2 * wanted)
    rng = random.Random(page_bits * 100 + wanted)
    words = ["the", "of"] * 20 + [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    texts = [" ".join(["the", *rng.choices(words, k=rng.choice([3, 20, 60]))]) for _ in range(500)]
    chunks = spark.createDataFrame([(f"b{i % 3}", f"c{i}", f"k{i}", 0, t, False) for i, t in enumerate(texts)], CHUNK).repartition(3)
    asked = [" ".join(rng.choices(words, k=8)) for _ in range(8)] + ["the", "the of", "missing", ""]
    sets = spark.createDataFrame([(i % 2, f"c{i}") for i in range(500)], "chapter_set int, chapter_id string")
    root = f"{shared_folder(spark)}/brute-{page_bits}-{wanted}"
    for scope in (None, "book_id"):
        index = rt.stored_index(chunks, root, scope)
        rows = [(n, q, f"b{n % 3}", [None, 0, 1][n % 3]) for n, q in enumerate(asked)]
        queries = spark.createDataFrame(rows, "query_id int, query string, book_id string, chapter_set int")
        got = {}
        for r in rt.search(queries, index, wanted, sets).collect():
            got.setdefault(r.query_id, []).append((r.rank, int(r.chapter_id[1:]), round(r.score, 9)))
        for n, q, book, chosen in rows:
            mine = [i for i in range(500) if scope is None or f"b{i % 3}" == book]
            part = [texts[i] for i in mine]
            scores = bm25(part, q, [j for j, i in enumerate(mine) if chosen is None or i % 2 == chosen])
            scores = {mine[j]: x for j, x in scores.items()}
            best = sorted(scores.values(), reverse=True)[:wanted]
            found = sorted(got.get(n, []))
            assert [x for _, _, x in found] == pytest.approx(best, abs=2e-9), (scope, q)
            assert all(scores[i] == pytest.approx(x, abs=2e-9) for _, i, x in found)


def test_common_words_are_not_read(spark):
    """A word of every text adds next to nothing: its postings bring no candidate."""
    texts = [f"the and {'rare' if i % 3 == 0 else 'plain'} t{i}" for i in range(900)]
    chunks = spark.createDataFrame([("b", f"c{i}", f"k{i}", 0, t, False) for i, t in enumerate(texts)], CHUNK)
    queries = spark.createDataFrame([("q", "the and rare t3 t6")], "query_id string, query string")
    index = rt.stored_index(chunks, f"{shared_folder(spark)}/common", None)
    found = rt.candidates(queries, index).count()
    assert 200 <= found <= 300
    assert rt.stored_index(chunks.repartition(5), f"{shared_folder(spark)}/common", None).passages.inputFiles() == index.passages.inputFiles()


def test_passages_of_one_file_are_dealt_in_order_of_their_ids(spark):
    """However few files the chunks come from, an index has many shelves; its numbers settle ties of scores."""
    chunks = spark.createDataFrame([("b", f"c{i}", f"k{i}", 0, f"word t{i}", False) for i in range(400)], CHUNK).coalesce(1)
    index = rt.stored_index(chunks, f"{shared_folder(spark)}/dealt", None)
    rows = index.passages.select("no", "shelf", "passage_id").orderBy("no").collect()
    assert [r.passage_id for r in rows] == sorted(r.passage_id for r in rows) and len(rows) == 400
    shelves = [r.shelf for r in rows]
    assert len(set(shelves)) == 4 and max(shelves.count(x) for x in set(shelves)) < 150


def test_each_query_keeps_as_many_candidates_as_are_wanted(spark, monkeypatch):
    """Where all passages match alike, those of least id stay; queries are dealt in groups, each block once for a group."""
    monkeypatch.setattr(rt, "TOGETHER", 2)
    monkeypatch.setattr(rt, "CANDIDATES", 20)
    chunks = spark.createDataFrame([("b", f"c{i}", f"k{i}", 0, "one two", False) for i in range(300)], CHUNK)
    index = rt.stored_index(chunks, f"{shared_folder(spark)}/alike", None)
    queries = spark.createDataFrame([(i, "two three" if i < 4 else "three") for i in range(5)], "query_id int, query string")
    ids = sorted(r.passage_id for r in index.passages.collect())
    found = rt.candidates(queries, index).join(index.passages, ["no"]).collect()
    assert all([r.passage_id for r in sorted(found, key=lambda r: r.at) if r.query_id == q] == ids[:20] for q in range(4))
    assert len(found) == 80


def test_evidence(spark):
    rows = passages(spark, "一句原文在这里")
    p = rows.first()
    cases = [("ok", p.passage_id, "c0", "k0", "原文", "original"), ("none", p.passage_id, "c0", "k0", "原文", None), ("quote", p.passage_id, "c0", "k0", "没有", "original"),
             ("forged", p.passage_id, "c9", "k0", "原文", "original"), ("origin", p.passage_id, "c0", "k0", "原文", "user_edit"), ("stale", "passage_x", "c0", "k0", "原文", "original")]
    rows_in = spark.createDataFrame([("b", *c) for c in cases], "book_id string, n string, passage_id string, chapter_id string, chunk_id string, quote string, origin string")
    assert {r.n for r in rt.verify_evidence(rows_in, rows).collect() if r.valid} == {"ok", "none"}


TASKS = "book_id string, task_id string"
DEPS = "book_id string, task_id string, depends_on string"


def test_dag(spark):
    tasks = spark.createDataFrame([("b", x) for x in ("names", "rules", "life")] + [("c", "x"), ("c", "x"), ("d", "s")], TASKS)
    deps = spark.createDataFrame([("b", "life", "names"), ("c", "x", "gone"), ("d", "s", "s")], DEPS)
    assert {(r.task_id, r.level) for r in kn.task_levels(tasks.filter("book_id = 'b'"), deps).collect()} == {("names", 0), ("rules", 0), ("life", 1)}
    assert {(r.book_id, r.problem) for r in kn.validate_dag(tasks, deps).collect()} == {("c", "duplicate"), ("c", "missing_dependency"), ("d", "cycle")}
    closed = kn.repair_closure(spark.createDataFrame([("b", "names")], TASKS), deps)
    assert {r.task_id for r in closed.collect()} == {"names", "life"}


ITEMS = "book_id string, item_id string, seq int, subject string, predicate string, object string, aliases array<string>, chapters array<string>, classification string"


def test_aliases_entities_conflicts(spark):
    items = spark.createDataFrame([
        ("b", "1", 1, "林舟", "身份", "渔夫", ["阿舟"], ["c1"], "certain"), ("b", "2", 2, "阿舟", "居住", "山城", [], ["c2", "c2"], "certain"),
        ("b", "3", 3, "沈遥", "身份", "医生", ["先生"], ["c2"], "certain"), ("b", "4", 4, "顾言", "身份", "教师", ["先生"], ["c3"], "certain"), ("b", "5", 5, "顾言", "敌对", "林舟", ["老顾"], ["c3"], "certain"),
    ], ITEMS)
    reviews = spark.createDataFrame([(str(i), "supported") for i in range(1, 5)] + [("5", "uncertain")], "item_id string, verdict string")
    m = kn.resolve_aliases(items, reviews)
    assert {r.alias: (r.subject, r.ambiguous) for r in m.collect()} == {"阿舟": ("林舟", False), "先生": (None, True)}
    assert {r.canonical: r.names for r in kn.entities(items, m).collect()}["林舟"] == sorted(["林舟", "阿舟"])
    assert [(r.canonical, r.chapters) for r in kn.relation_history(items, m).orderBy("seq").collect()][1] == ("林舟", ["c2"])
    assert {(r.kind, r.item_id) for r in kn.conflicts(items, reviews).collect()} == {("unsupported", "5"), ("ambiguous_alias", "4")}
    checks = spark.createDataFrame([("1", 0, "q", True), ("1", 1, "r", False), ("5", 0, "s", True)], "item_id string, pos int, quote string, valid boolean")
    report = kn.knowledge_report(items, reviews, checks).first()
    assert report.n_supported == 4 and len(report.fingerprint) == 64
    assert [(i.item_id, i.aliases, i.classification, i.evidence) for i in report["items"]][4] == ("5", [], "uncertain", [])
    assert report["items"][0].evidence == ["q"]


def test_endless_policy_stops(spark):
    items = spark.createDataFrame([("i",)], "item_id string")
    ask = lambda rows: rows.select("item_id", F.lit("search").alias("action"), F.lit("x").alias("argument"), F.lit(None).cast("string").alias("verdict"))
    tool = lambda rows: rows.select("item_id", F.lit("seen").alias("observation"), F.lit(False).alias("valid"))
    got = kn.review_items(items, ask, tool, tool, lambda df, _: settled(df), max_steps=4, call_budget=2).first()
    assert tuple(got) == ("i", "uncertain", 3, 2)


def test_review_budget(spark):
    items = spark.createDataFrame([("b", str(i), i) for i in range(3)], "book_id string, item_id string, seq int")
    good, rest = kn.review_budget(items, 1)
    assert good.count() == 1 and [(r.verdict, r.steps) for r in rest.collect()] == [("uncertain", 0)] * 2


def test_coverage_of_nothing_is_null(spark):
    none = spark.createDataFrame([], "item_id string")
    checks = spark.createDataFrame([], "item_id string, valid boolean")
    assert ev.quote_coverage(none, checks).first().coverage is None
