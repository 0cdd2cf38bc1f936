"""Files in, tables out, streams."""

import hashlib
import subprocess
import sys
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliant import stages
from foliant.sources import corpus, listing, report
from foliant.streaming import progress as pr


@pytest.fixture
def folder(tmp_path):
    files = {
        "a.txt": "第一章 归来\n正文".encode(), "b.TXT": "山城的雨夜".encode("gb18030"), "c.txt": "﻿有标记".encode(), "d.txt": "宽字符".encode("utf-16"),
        "e.txt": b"", "f.md": b"x", "g.txt": b" \n\t", "h.txt": b"line\r\nnext\rlast", "i.txt": b"x" * 3000, "j.txt": bytes(range(1, 32)) * 5,
    }
    (tmp_path / "in").mkdir()
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    return tmp_path


def test_read_and_decode(spark, folder):
    accepted, rejected = corpus.read_txt_corpus(spark, str(folder / "in"), max_bytes=2000)
    assert {r.filename: r.reason for r in rejected.collect()} == {"e.txt": "empty", "f.md": "wrong_suffix", "i.txt": "too_large"}
    good, bad = corpus.decode_text(accepted)
    got = {r.filename: (r.text, r.encoding) for r in good.collect()}
    assert got == {
        "a.txt": ("第一章 归来\n正文", "utf-8"), "b.TXT": ("山城的雨夜", "gb18030"), "c.txt": ("有标记", "utf-8-sig"), "d.txt": ("宽字符", "utf-16"), "h.txt": ("line\nnext\nlast", "utf-8"),
    }
    assert {r.filename for r in bad.collect()} == {"g.txt", "j.txt"}


def test_stage_replaces_only_its_keys(spark, tmp_path):
    root = str(tmp_path)
    corpus.write_stage(spark.createDataFrame([(f"b{i}", 1) for i in range(40)], "book_id string, v int"), root, "s", buckets=40)
    bucket = F.pmod(F.xxhash64("book_id"), F.lit(40)).cast("int")
    before = corpus.read_stage(spark, root, "s", "book_id string, v int, bucket int")
    first = before.select(bucket.alias("k")).first().k
    mine = [r.book_id for r in before.filter(bucket == first).collect()]
    corpus.write_stage(spark.createDataFrame([(b, 2) for b in mine], "book_id string, v int"), root, "s", buckets=40)
    after = {r.book_id: r.v for r in corpus.read_stage(spark, root, "s", "book_id string, v int, bucket int").collect()}
    assert len(after) == 40 and {b for b, v in after.items() if v == 2} == set(mine)


def test_stage_keeps_other_keys_of_a_bucket(spark, tmp_path):
    root, kind = str(tmp_path), "book_id string, v int, bucket int"
    corpus.write_stage(spark.createDataFrame([(f"b{i}", 1) for i in range(200)], "book_id string, v int"), root, "s", buckets=4)
    corpus.write_stage(spark.createDataFrame([("b0", 2), ("new", 3)], "book_id string, v int"), root, "s", buckets=4)
    after = {r.book_id: r.v for r in corpus.read_stage(spark, root, "s", kind).collect()}
    assert len(after) == 201 and {b: v for b, v in after.items() if v > 1} == {"b0": 2, "new": 3}


def test_two_writers_lose_no_row(spark, tmp_path, monkeypatch):
    """A second writer commits between the first one's read and its commit: other buckets, then the same one."""
    root, kind = str(tmp_path), "book_id string, v int, bucket int"
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "book_id string, v int")
    assert corpus.write_stage(rows(*((f"b{i}", 0) for i in range(30))), root, "s", buckets=3) == 1
    commit, between = corpus._commit, [("other", 7), ("b1", 8)]

    def late(*a):
        if between:
            monkeypatch.setattr(corpus, "_commit", commit)
            corpus.write_stage(rows(between.pop()), root, "s", buckets=3)
            monkeypatch.setattr(corpus, "_commit", late)
        return commit(*a)

    monkeypatch.setattr(corpus, "_commit", late)
    assert corpus.write_stage(rows(("b1", 1), ("b2", 2)), root, "s", buckets=3) == 4
    read = {r.book_id: r.v for r in corpus.read_stage(spark, root, "s", kind).collect()}
    assert len(read) == 31 and (read["b1"], read["b2"], read["other"], read["b3"]) == (1, 2, 7, 0)
    assert {r.v for r in corpus.read_stage(spark, root, "s", kind, version=1).collect()} == {0}
    corpus.write_stage(rows(("b9", 9)), root, "s", buckets=3)
    assert corpus.clean_stage(spark, root, "s", keep=1) and corpus.read_stage(spark, root, "s", kind).count() == 31
    assert corpus.read_stage(spark, root, "none", kind).isEmpty()


def test_purge_deletes_old_folders_of_our_own(spark):
    mine = stages.saved(spark.range(3), "purged")._saved_at
    other = f"{stages.shared_folder(spark)}/not-ours"
    spark.range(3).write.mode("overwrite").parquet(other)
    assert mine.rsplit("/", 1)[1] not in stages.purge(spark, timedelta(hours=1))
    gone = stages.purge(spark, timedelta(hours=1), datetime.now(UTC) + timedelta(hours=2))
    assert mine.rsplit("/", 1)[1] in gone and not stages.exists(spark, mine) and stages.exists(spark, other)


def test_listing_deals_folders(tmp_path):
    for i in range(300):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "x.txt").write_text("x")
    (tmp_path / "top.txt").write_text("")
    reader = listing.FilesReader(str(tmp_path))
    parts = reader.partitions()
    names = [p for part in parts for batch in reader.read(part) for p in batch.column("path").to_pylist()]
    assert len(parts) == 20 and len(names) == len(set(names)) == 301 and f"file:{tmp_path}/top.txt" in names


def test_last_resort_encodings():
    assert corpus._legacy("Съешь ещё этих мягких французских булок".encode("cp1251"))[0] is not None
    assert corpus._legacy(bytes(range(1, 32)) * 20) == (None, None)


def test_expiry(spark):
    books = spark.createDataFrame([("a", 10, 0), ("b", None, 0), ("c", None, 50)], "book_id string, e long, m long")
    books = books.select("book_id", F.timestamp_seconds("e").alias("expires_at"), F.timestamp_seconds("m").alias("modified_at"))
    live, gone = corpus.expire(books, F.timestamp_seconds(F.lit(60)), timedelta(seconds=30))
    assert ([r.book_id for r in live.collect()], sorted(r.book_id for r in gone.collect())) == (["c"], ["a", "b"])


OUTLINE = (
    "book_id string, overall_summary string, chapter_outline array<struct<chapter_range:string,summary:string,key_events:array<string>,sources:struct<batch_ids:array<string>,chapter_ids:array<string>>>>,"
    "unresolved_items array<struct<description:string,confidence:string>>, conflicts_and_uncertainties array<struct<description:string,confidence:string>>"
)


def test_report(spark):
    outline = spark.createDataFrame([("b", "<script>x</script>", [("1-2", "s", ["e1", "e2"], (["b1"], ["c1", "c1", "c2"]))], [], [("open?", "uncertain")])], OUTLINE)
    sections = ["overall_summary", "chapter_outline", "unresolved_items"]
    items = report.outline_items(outline, sections)
    rows = {r.section: r for r in items.collect()}
    assert (rows["chapter_outline"].n_chapters, rows["chapter_outline"].n_batches, rows["chapter_outline"].bullets) == (2, 1, ["e1", "e2"])
    assert rows["unresolved_items"].body == "open?"
    page = report.render_html_report(spark.createDataFrame([("b", "T<")], "book_id string, title string"), items, sections).first().html
    assert "<script>x" not in page and "&lt;script&gt;x" in page and "T&lt;" in page and "<li>e1</li>" in page
    for wrong in ([], ["overall_summary", "overall_summary"], ["nope"]):
        with pytest.raises(ValueError, match="sections"):
            report.outline_items(outline, wrong)


def test_streams(spark, tmp_path):
    rows = [("t1", "running", 1, 3, "2024-01-01 00:00:01"), ("t1", "running", 1, 3, "2024-01-01 00:00:01"), ("t1", "completed", 3, 3, "2024-01-01 00:00:05"), ("t2", "pending", 0, 3, "2024-01-01 00:00:02")]
    spark.createDataFrame(rows, "task_id string, status string, completed int, total int, u string").withColumn("updated_at", F.col("u").cast("timestamp")).drop("u").write.json(str(tmp_path / "m"))
    manifests = spark.readStream.schema(pr.MANIFEST).json(str(tmp_path / "m"))
    for name, frame, mode in (("snaps", pr.stream_progress(manifests), "append"), ("latest", pr.stream_latest(pr.snapshots(manifests)), "complete")):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("snaps").count() == 3
    assert {(r.task_id, r.phase, r.terminal) for r in spark.table("latest").collect()} == {("t1", "completed", True), ("t2", "queued", False)}


def test_stream_of_changes_resumes(spark, tmp_path):
    """States repeat, tasks end, a reader has seen one; a second run goes on from the state of the first."""
    at = lambda n: f"2024-01-01 00:00:{n:02d}"
    parts = [
        [("a", "running", 1, at(1)), ("a", "running", 1, at(1)), ("a", "running", 2, at(2)), ("b", "pending", 0, at(1)), ("c", "running", 1, at(3)), ("c", "running", 2, at(4))],
        [("a", "running", 2, at(2)), ("a", "completed", 3, at(5)), ("b", "failed", 0, at(6)), ("b", "running", 1, at(7)), ("c", "running", 3, at(8))],
        [("a", "running", 9, at(9)), ("d", "pending", 0, at(9))],
    ]
    kind = "task_id string, status string, completed int, total int, updated_at timestamp"
    frames = [spark.createDataFrame([(t, s, c, 3, u) for t, s, c, u in p], "t string, s string, c int, n int, u string").select(*(F.col(x).cast(k.split()[1]).alias(k.split()[0]) for x, k in zip("tscnu", kind.split(", ")))) for p in parts]
    ids = {(r.task_id, r.completed): r.event_id for f in frames for r in pr.snapshots(f).collect()}
    seen = spark.createDataFrame([("c", ids["c", 1]), ("d", "unknown")], "task_id string, last_seen string")
    got = []
    for frame in frames:
        frame.write.mode("append").parquet(str(tmp_path / "in"))
        rows = []
        changes = pr.stream_changes(pr.snapshots(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))), seen)
        pr.run_available(changes, str(tmp_path / "ck"), lambda df, n: rows.extend(df.collect()))
        got.append(sorted((r.task_id, r.completed, r.terminal) for r in rows))
    assert got == [[("a", 1, False), ("a", 2, False), ("b", 0, False), ("c", 2, False)], [("a", 3, True), ("b", 0, True), ("c", 3, False)], [("d", 0, False)]]


def test_ended_tasks_give_no_frame():
    """Neither a task that has ended nor one without a change costs an empty table."""
    rows = pd.DataFrame({"event_id": ["y", "x"], "task_id": "t", "phase": "p", "terminal": [True, False], "completed": 1, "total": 2, "updated_at": pd.to_datetime(["2024-01-02", "2024-01-01"]), "last_seen": None})

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state = State()
    assert [list(f["event_id"]) for f in pr._changes(("t",), iter([rows[1:], rows[:1]]), state)] == [["x", "y"]]
    assert state.get == ("y", True)
    assert list(pr._changes(("t",), iter([rows]), state)) == []
    state.get = ("x", False)
    assert list(pr._changes(("t",), iter([rows[1:]]), state)) == [] and state.get == ("x", False)


def test_stream_ingest_takes_new_files_once(spark, folder):
    out = folder / "out"

    def write(df, name):
        df.write.mode("append").parquet(str(out / name))

    for _ in range(2):
        pr.stream_ingest(spark, str(folder / "in" / "a.txt"), str(folder / "ck"), write).awaitTermination(120)
    assert [r.title for r in spark.read.parquet(str(out / "chapters")).collect()] == ["第一章 归来"]
    assert spark.read.parquet(str(out / "passages")).count() == 1


def test_stream_ingest_looks_up_no_file_by_itself(spark, tmp_path):
    """As few tasks for many files as for one; files that come later are taken in by the next run, old ones are not again."""
    def write(df, name):
        df.write.mode("append").parquet(str(tmp_path / "out" / name))

    def run():
        query = pr.stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "ck"), write)
        query.awaitTermination(120)
        tracker = spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(query.runId)]
        return max((x.numTasks for j in jobs for i in j.stageIds if (x := tracker.getStageInfo(i))), default=0)

    (tmp_path / "in").mkdir()
    for i in range(60):
        (tmp_path / "in" / f"t{i}.txt").write_text(f"text {i}\n")
    (tmp_path / "in" / "empty.txt").write_text("")
    assert run() < 50
    (tmp_path / "in" / "late.txt").write_text("late\n")
    run()
    paths = [r.path.rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "out" / "books")).collect()]
    assert sorted(paths) == sorted([f"t{i}.txt" for i in range(60)] + ["late.txt"])
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "out" / "rejected")).collect()] == ["empty"]


def test_stream_ingest_shuffles_no_text(spark, tmp_path):
    """What goes through shuffles is small beside the texts, and no texts stay behind but those of the tables."""
    def write(df, name):
        df.write.mode("append").parquet(str(tmp_path / "out" / name))

    (tmp_path / "in").mkdir()
    size = 0
    for i in range(60):
        body = [" ".join(hashlib.sha512(f"{i} {c} {n}".encode()).hexdigest() for n in range(150)) for c in range(3)]
        text = f"before\nChapter 1 a\n{body[0]}\nChapter 2 b\n{body[1]}\nChapter 9 odd\n{body[2]}\nChapter 3 c\nend\n" if i % 3 else "\n".join(body)
        data = text.encode("utf-16") if i % 5 == 1 else text.encode()
        size += (tmp_path / "in" / f"t{i}.txt").write_bytes(data)
    (tmp_path / "in" / "bad.txt").write_bytes(bytes(range(1, 32)) * 5)
    local = Path(spark.sparkContext.getConf().get("spark.local.dir"))
    before = {*local.glob("blockmgr-*/*/shuffle_*.data")}
    pr.stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "ck"), write).awaitTermination(240)
    assert sum(x.stat().st_size for x in {*local.glob("blockmgr-*/*/shuffle_*.data")} - before) < size / 10
    assert not list((local / "checkpoints").glob("ingest-texts-*")) and not list((local / "checkpoints").glob("ingest-chapters-*")) and not [t.name for t in spark.catalog.listTables() if "ingest" in t.name]
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    books = {r.book_id: r for r in read("books").collect()}
    assert len(books) == 60 and {r.reason for r in read("rejected").collect()} == {"undecodable"}
    assert {r.encoding for r in books.values()} == {"utf-8", "utf-16"}
    for book, name in ((b, r.path.rsplit("/", 1)[1]) for b, r in books.items()):
        i = int(name[1:-4])
        assert books[book].text == (tmp_path / "in" / name).read_bytes().decode("utf-16" if i % 5 == 1 else "utf-8")
    whole = {(r.book_id, r.chapter_id): r for r in read("chapters").collect()}
    assert sorted({r.title for r in whole.values()}) == ["Chapter 1 a", "Chapter 2 b", "Chapter 3 c", "全文", "卷首"]
    cut = read("passages").collect()
    assert len(cut) == sum(-(-r.character_count // 1000) for r in whole.values())
    for r in cut:
        start = whole[r.book_id, r.chapter_id].content_start + r.offset
        assert r.content == books[r.book_id].text[start : min(start + 1200, whole[r.book_id, r.chapter_id].content_end)]


def test_listing_of_very_many_folders_is_dealt_to_few_tasks(tmp_path):
    for i in range(20_000):
        (tmp_path / f"b{i}").mkdir()
    parts = listing.FilesReader(str(tmp_path)).partitions()
    assert len(parts) <= listing.TASKS + 1 and sum(len(p.paths) for p in parts) == 20_001


def test_texts_are_written_to_few_folders_and_all_found(spark, tmp_path):
    rows = spark.range(3000).selectExpr("concat('doc_', id % 2999) as key", "if(id % 3 = 0, '', 'é' || id) as value", "id % 5 = 0 as packed")
    listing.write_texts(rows.coalesce(2), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) <= 4
    accepted, rejected = corpus.read_txt_corpus(spark, str(tmp_path / "out"))
    assert rejected.groupBy("reason").count().collect() == [("wrong_suffix", 600)]
    got = sorted(bytes(r.content).decode() for r in accepted.select("content").collect())
    assert got == sorted(("" if i % 3 == 0 else f"é{i}") + "\n" for i in range(3000) if i % 5)


def test_written_texts_go_whole(spark, tmp_path):
    listing.write_texts(spark.range(2500).selectExpr("concat('doc_', id) as key", "'x' as value", "false as packed"), str(tmp_path / "out"))
    (tmp_path / "other.txt").write_text("stays")
    for _ in range(2):
        listing.remove_texts(spark, str(tmp_path / "out"))
    assert [x.name for x in tmp_path.iterdir()] == ["other.txt"]


def test_queries_are_named_before_a_session_starts():
    code = "import __spark_entry__ as e; assert 'a1_read_txt_corpus' in e.queries() and 'g10_final_outline' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[1])
