"""Golden cases of headings, chapters, volumes, chunks and bodies."""

import random
import time

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.functions import tokens as tk
from foliant.operators import chunks as ch
from foliant.operators import planning as pl
from foliant.operators import structure as st


def books(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "book_id string, text string")


def titles(spark, text):
    return [(r.title, r.kind) for r in st.chapters(books(spark, b=text)).orderBy("ordinal").collect()]


@pytest.mark.parametrize(("line", "kind", "number"), [
    ("第一百二十章 风雪", "chapter", 120), ("第１２回 故人", "chapter", 12), ("正文 第3节 夜谈", "chapter", 3), ("第一万二千零三章", "chapter", 12003),
    ("第二〇章 夜", "chapter", 20), ("第十二章", "chapter", 12), ("番外 灯会", "special", None), ("Chapter 12 Nightfall", "chapter", 12),
    ("第三卷", "volume", None), ("卷１２ 山河", "volume", None), ("下卷 归途", "volume", None), ("第一章 归来。", None, None), ("普通的一行", None, None), ("", None, None),
])
def test_headings(spark, line, kind, number):
    title = t.heading_title(F.lit(f"　{line} \r"))
    k = t.classify_heading(title)
    assert tuple(spark.range(1).select(k, t.heading_number(title, k)).first()) == (kind, number)


def test_front_matter_and_volumes(spark):
    text = "题记\n正文 第十二章 雨夜来客\n内容一\n卷二 山河远阔\n卷中引言\n尾声\n内容二\n"
    assert titles(spark, text) == [("卷首", "special"), ("正文 第十二章 雨夜来客", "chapter"), ("卷二 山河远阔 · 卷首", "special"), ("尾声", "special")]


def test_volumes_hold_their_chapters(spark):
    b = books(spark, b="卷一 起\n第一章 甲\n一\n第二章 乙\n二\n卷二 承\n第三章 丙\n三\n")
    headings = st.remove_sequence_outliers(st.find_headings(st.explode_lines(b)))
    rows = st.volumes(headings, st.chapters(b, headings), b).orderBy("ordinal").collect()
    assert [(r.title, len(r.chapter_ids)) for r in rows] == [("卷一 起", 2), ("卷二 承", 1)]
    assert rows[0].end == rows[1].start and rows[1].end == len(b.first().text)


def test_outlier_is_text_of_the_chapter_before(spark):
    assert titles(spark, "第三十章 甲\n一\n第三章 乙\n二\n第三十一章 丙\n三\n") == [("第三十章 甲", "chapter"), ("第三十一章 丙", "chapter")]


def test_mixed_numbering_stays(spark):
    assert len(titles(spark, "第一章 a\n一\n第2章 b\n二\n第３章 c\n三\nChapter 4 d\n四\n")) == 4


@pytest.mark.parametrize("text", ["没有标题。\n第二段。", "第一章 归来。\n正文", "第一章\n第二章\n"])
def test_fallback(spark, text):
    assert titles(spark, text) == [("全文", "fallback")]


def test_lines_keep_offsets(spark):
    text = "a😀\n\nbc\n"
    got = [(r.start, r.end, r.line) for r in st.explode_lines(books(spark, b=text)).orderBy("line_no").collect()]
    assert got == [(0, 2, "a😀"), (3, 3, ""), (4, 6, "bc")]


def test_chunks_are_slices_within_limits_and_rebuild_the_text(spark):
    text = "".join(f"Sentence {i} says some words; then more.\n" for i in range(300))
    b = books(spark, b=text)
    for most, overlap in ((18, 5), (50, 0), (7, 3)):
        cuts = ch.cuts(text, most, overlap)
        assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
        assert all(x[1] >= y[0] > x[0] for x, y in zip(cuts, cuts[1:]))
        chunks = ch.chunk_chapters(st.chapters(b), b, most, overlap)
        assert chunks.filter(f"token_count > {most} or overlap_tokens > {overlap}").isEmpty()
        rebuilt = ch.chapter_bodies(ch.chunk_content(chunks, b))
        assert rebuilt.first().body == text


def test_windows_of_a_long_chapter_leave_one_by_one(spark):
    """A million tokens in thousands of windows: the text goes with none of them."""
    one = spark.range(1).select(F.lit("b").alias("book_id"), F.lit("c").alias("chapter_id"), F.lit(0).alias("content_start"), F.expr("repeat('word. ', 500000)").alias("text"))
    one = one.withColumn("content_end", F.length("text"))
    began = time.perf_counter()
    got = ch.chunk_chapters(one.drop("text"), one.select("book_id", "text"), 300, 20).agg(F.count("*").alias("n"), F.max("end_char").alias("end"), F.max("token_count").alias("most")).first()
    assert (got.n, got.end, got.most) == (3572, 3_000_000, 300) and time.perf_counter() - began < 60
    parts = ch.cut_text(one.select("chapter_id", "text", F.lit(1000).alias("most"), F.array(F.lit("k")).alias("chunk_ids")), "text", "most", 0)
    assert parts.columns == ["chapter_id", "chunk_ids", "part", "part_start", "part_end", "piece"]
    assert parts.agg(F.sum(F.length("piece"))).first()[0] == 3_000_000


def test_cut_before_newline_and_after_mark():
    assert ch.cuts("aa bb cc\ndd ee ff", 4, 0)[0] == (0, 8)
    assert ch.cuts("aa bb cc。 dd ee ff", 5, 0)[0] == (0, 9)


def test_edited_chunk_drops_shared_tokens(spark):
    b = books(spark, b="one two three four five six")
    rows = spark.createDataFrame([("b", "c", "k1", 0, 18), ("b", "c", "k2", 8, 27)], "book_id string, chapter_id string, chunk_id string, start_char long, end_char long")
    edits = spark.createDataFrame([("k2", "uno dos tres quatro")], "chunk_id string, content_override string")
    out = ch.chapter_bodies(ch.chunk_content(rows, b, edits)).first()
    assert out.body == "one two three four tres quatro"
    assert out.contains_edits and out.chunk_ids == ["k1", "k2"]


def test_edits_latest_wins_and_rejects(spark):
    chunks = spark.createDataFrame([("a", "source"), ("b", "source")], "chunk_id string, content string").withColumn("parsed_at", F.timestamp_seconds(F.lit(100)))
    edits = spark.createDataFrame([("a", "first", 101), ("a", "second", 102), ("a", "early", 99), ("b", "source", 103), ("b", " ", 104), ("b", "x " * 50, 105)], "chunk_id string, content string, s long")
    out, bad = ch.apply_chunk_edits(chunks, edits.withColumn("edited_at", F.timestamp_seconds("s")), 20)
    assert {r.chunk_id: r.content_override for r in out.collect()} == {"a": "second", "b": None}
    assert {r.reason for r in bad.collect()} == {"blank", "too_many_tokens"}


def test_oversized_chapter_parts_rebuild_it(spark):
    body = "".join(f"这是第{i}句话。" for i in range(200))
    rows = spark.createDataFrame([("b", "c", 1, "题", body, ["k"], False), ("b", "d", 2, "空", " \n", ["k"], False)], "book_id string, chapter_id string, ordinal int, title string, body string, chunk_ids array<string>, contains_edits boolean")
    segments, errors = pl.plan_segments(rows, 120)
    got = segments.orderBy("part_ordinal").collect()
    assert errors.isEmpty() and len(got) > 5 and all(r.token_count <= 120 and r.part_count == len(got) for r in got)
    assert "".join(r.content.split("】\n", 1)[1] for r in got) == body
    errors = pl.plan_segments(rows, 10)[1]
    assert [r.reason for r in errors.collect()] == ["title_exceeds_budget"]


@pytest.mark.parametrize("n", [6, 1000])
def test_every_chapter_is_in_one_batch(spark, n):
    text = "".join(f"第{i}章 标题{i}\n独有句子编号{i}号。\n" for i in range(1, n + 1))
    b = books(spark, b=text)
    rows = st.chapters(b).join(b, "book_id").select("book_id", "chapter_id", "ordinal", "title", st.slice_text(F.col("text"), F.col("content_start"), F.col("content_end")).alias("body"), F.array("chapter_id").alias("chunk_ids"), F.lit(False).alias("contains_edits"))
    batches = pl.batch_metadata(pl.pack_batches(pl.plan_segments(rows, 220)[0], 220)).persist()
    assert batches.filter("token_count > 220").isEmpty()
    whole = "\n".join(r.content for r in batches.collect())
    assert all(whole.count(f"独有句子编号{i}号。") == 1 for i in range(1, n + 1))


def test_merge_estimate(spark):
    work = lambda n, limit, s: tuple(spark.range(1).select(pl.estimate_merge_work(F.lit(n), F.lit(limit), F.lit(s)).alias("w")).first().w)
    assert work(0, 100, 30) == (0, 0) and work(1, 100, 30) == (1, 30)
    assert work(5, 100, 30) == (3 + 2 + 1, (76 + 76 + 30) + (76 + 30) + 76)


def test_same_result_on_other_partitions(spark):
    b = books(spark, **{f"b{i}": "第一章 a\n" + "字。" * i + "\n第二章 b\n内容\n" for i in range(1, 30)})
    one, many = (sorted(map(tuple, st.chapters(b.repartition(n)).collect())) for n in (1, 16))
    assert one == many


def test_counters(spark):
    tk.register_counter("letters", tk.pandas_counter(len))
    row = spark.createDataFrame([("ab 中文!",)], "x string").select(tk.token_count(F.col("x")).alias("n"), tk.token_count(F.col("x"), "letters").alias("m")).first()
    assert (row.n, row.m) == (4, 6)
    with pytest.raises(ValueError, match="unknown"):
        tk.token_count(F.col("x"), "none")


def test_grams(spark):
    assert spark.range(1).select(tk.grams(F.lit("林舟来 Hello a_b 中 hello"))).first()[0] == ["林舟", "舟来", "hello", "a_b", "中"]


def test_file_names(spark):
    got = [r[0] for r in spark.createDataFrame([("../../山海:卷?.TXT",), ("\x01/..",)], "x string").select(t.safe_filename(F.col("x"), "html", "outline")).collect()]
    assert got == ["山海_卷-全书细纲.html", "outline-全书细纲.html"]


@pytest.mark.parametrize("block, limit, first, seam", [(8192, 20, 0, 0), (4, 20, 3, 2), (1, 9, 0, 1), (7, 0, 0, 0), (3, 100, 5, 0)])
def test_next_fit_equals_the_fold(spark, monkeypatch, block, limit, first, seam):
    """Books of unlike lengths, items of size 0 and above the limit; blocks of a few items, so that pointers are doubled."""
    monkeypatch.setattr(pl, "BLOCK", block)
    rng = random.Random(limit)
    sizes = {f"b{k}": [rng.choice([0, 0, 1, 2, 5, 8, 30]) for _ in range(n)] for k, n in enumerate([1, 2, 7, 40, 150])}
    rows = [(b, 10 * i, x) for b, xs in sizes.items() for i, x in enumerate(xs)]
    want = {}
    for b, xs in sizes.items():
        group = used = 0
        for i, x in enumerate(xs):
            if group and used + seam + x <= limit:
                used += seam + x
            else:
                group, used = group + 1, first + x
            want[b, 10 * i] = group
    items = spark.createDataFrame(rows, "book_id string, pos int, size int").repartition(3)
    assert {(r.book_id, r.pos): r.group for r in pl.next_fit(items, "book_id", "pos", "size", limit, first, seam).collect()} == want


def test_folds_are_linear(spark):
    from pyspark.sql import functions as F

    from foliant.operators.planning import next_fit

    items = spark.range(200_000).select(F.lit("b").alias("book_id"), F.col("id").alias("pos"), F.lit(3).alias("size"))
    groups = next_fit(items, "book_id", "pos", "size", 10)
    assert groups.agg(F.max("group"), F.count("*")).first()[:2] == (66_667, 200_000)
    books = spark.range(1).select(F.lit("b").alias("book_id"), F.expr("repeat('word ', 1000000)").alias("text"))
    chapters = books.select("book_id", F.lit("c").alias("chapter_id"), F.lit(0).alias("content_start"), F.length("text").alias("content_end"))
    windows = ch.fixed_token_windows(chapters, books, 120, 90)
    last = windows.agg(F.count("*").alias("n"), F.max("end_char").alias("end")).first()
    assert (last.n, last.end) == (11111, 4_999_999)


def test_blank_text_gives_no_chunk():
    assert ch.cuts("   \n", 5, 0, blank=False) == [] and ch.cuts("   \n", 5, 0) == [(0, 4)]
    assert ch.cuts("a b   ", 5, 0, blank=False) == [(0, 6)]
