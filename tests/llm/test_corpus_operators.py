"""Near-duplicates, repeated passages, neighbours and the pipeline against brute force and on odd rows."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import neighbours, paragraphs, simhash, suffixes
from foliant.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, spans string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in rows], DOCS)


def join(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(500, i) for i in range(501, 900)] + [(1000 + i, 1001 + i) for i in range(200)]
    links = spark.createDataFrame([*pairs, (None, 3), (7, 7)], "a long, b long")
    want = join(1300, pairs)
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {x: want[x] for p in pairs for x in p if p[0] != p[1]}
    assert components(links.limit(0)).isEmpty()


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def varied(rng, n):
    """Texts with copies and copies of which a few words are changed."""
    out = []
    for i in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 3, 40, 200, 500]))]
        out.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            changed = list(words)
            for _ in range(rng.choice([0, 1, 2])):
                changed[rng.randrange(len(changed))] = f"z{rng.randrange(99)}"
            out.append(" ".join(changed).replace("w1", "W1"))
    return out


def test_simhash(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(varied(random.Random(6), 250))] + [(9000, None), (9001, ""), (9002, " \n"), (9001, "")]
    prints = [slow_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = join(len(rows), pairs)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        least[root[i]] = min(least[root[i]], d)
    want = sorted((d, prints[i] - (1 << 64) * (prints[i] >> 63), least[root[i]]) for i, (d, _) in enumerate(rows))
    for full in (1024, 3):  # with 3, most buckets are dealt again
        monkeypatch.setattr(simhash, "FULL", full)
        assert sorted(map(tuple, simhash.near_duplicates(docs(spark, rows)).collect())) == want
    kept = [r.doc_id for r in simhash.keep_one(docs(spark, rows)).collect()]
    assert sorted(kept) == sorted(set(least.values()))


def test_bit_planes():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in range(1, 9))]))
    run = np.sort(rng.integers(0, 3, len(fps)))
    a, b = simhash.linked(fps, run, 4)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if run[i] == run[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 4]
    want = join(len(fps), pairs)
    got = list(range(len(fps)))
    for x, y in zip(a.tolist(), b.tolist()):
        got[x] = y
    assert got == want


def test_simhash_of_null_ids(spark):
    got = simhash.near_duplicates(docs(spark, [(None, "a b"), (3, "a b"), (None, "c d")])).collect()
    assert sorted((r.component_id is None, r.component_id or 0) for r in got) == [(False, 3), (False, 3), (True, 0)]
    assert simhash.near_duplicates(docs(spark, [])).isEmpty()
    assert simhash.keep_one(docs(spark, [(1, "x y"), (1, "x y"), (2, "x y")])).count() == 1


def passages(rng):
    """Documents of their own words; some hold a shared passage, changed or not, somewhere inside."""
    words = lambda n: [f"{rng.choice(['W', 'w'])}{rng.randrange(10**6)}" for _ in range(n)]
    out, shared = [], [words(n) for n in (51, 52, 60, 75, 120, 200)]
    for i in range(240):
        text = words(rng.randrange(0, 300))
        if i % 3 == 0:
            at = rng.randrange(len(text) + 1)
            text[at:at] = shared[i // 3 % len(shared)]
        out.append(text)
    return out, shared


@pytest.mark.parametrize("find", [suffixes.repeated_passages, paragraphs.similar_paragraphs])
def test_repeated_passages(spark, find):
    texts, shared = passages(random.Random(8))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(900 + i, rows[1][1]) for i in range(5)] + [(950, rows[4][1]), (951, rows[4][1] + " tail")] + [(2000, None), (2001, ""), (None, rows[0][1]), (1, rows[1][1])]
    windows = defaultdict(set)
    for d, t in rows:
        w = (t or "").split()
        for i in range(len(w) - 50):
            if d is not None:
                windows[tuple(w[i : i + 51])].add(d)
    want = {d for ids in windows.values() if len(ids) > 1 for d in ids}
    got = {r.doc_id: r for r in find(docs(spark, rows)).collect()}
    assert set(got) == want
    assert all(r.shares_with is not None and r.shares_with != d for d, r in got.items())
    for i in range(0, 240, 3):
        if i not in got or got[i].copy_of != i:
            continue
        passage, w = shared[i // 3 % len(shared)], texts[i]
        at = next(k for k in range(len(w)) if w[k : k + len(passage)] == passage)
        covered = {p for s in got[i].spans.split(",") for p in range(*map(int, s.split(":")))}
        assert len(covered & set(range(at, at + len(passage)))) >= len(passage) - (6 if find is paragraphs.similar_paragraphs else 0)
    assert find(docs(spark, [])).isEmpty()


def test_near_paragraphs(spark):
    rng = random.Random(9)
    base = [f"W{rng.randrange(10**6)}" for _ in range(160)]
    rows = [(1, " ".join(base))]
    for d, places in ((2, [70]), (3, [10, 90, 150]), (4, list(range(0, 160, 8)))):
        changed = list(base)
        for p in places:
            changed[p] = "other"
        rows.append((d, " ".join(changed)))
    rows.append((5, " ".join(f"V{rng.randrange(10**6)}" for _ in range(160))))
    assert {r.doc_id for r in paragraphs.similar_paragraphs(docs(spark, rows)).collect()} == {1, 2, 3}


def test_every_lead_of_a_paragraph_is_compared():
    rng = np.random.default_rng(12)
    unit, lead = paragraphs.UNIT, paragraphs.LEAD
    for first in range(lead + 1):
        for edit in {*range(51)} - {*range(lead - first, lead - first + unit)}:
            passage = rng.integers(1, 1 << 32, 51, np.uint32)
            changed = passage.copy()
            changed[edit] = 7
            rows = [np.concatenate([rng.integers(1, 1 << 32, first, np.uint32), p, rng.integers(1, 1 << 32, lead - first, np.uint32)]) for p in (passage, changed)]
            around = paragraphs.Around(pa.array([r.tobytes() for r in rows], pa.binary()))
            found, lo, hi = paragraphs.spans_alike(around, np.array([0]), np.array([1]))
            assert found[0] and lo[0] <= first - lead and hi[0] >= first - lead + 51


def test_sets_of_repeated_shingles():
    rng = np.random.default_rng(15)
    words = rng.integers(1, 1 << 32, 60, np.uint32)
    rows = []
    for k in range(12):  # paragraphs that repeat a part of themselves
        row = np.concatenate([words, words[:32]])
        row[rng.integers(0, 92, k // 3)] = 9
        rows.append(row)
    around = paragraphs.Around(pa.array([r.tobytes() for r in rows], pa.binary()))
    a, b = map(np.array, zip(*[(i, j) for i in range(12) for j in range(i)]))
    got = paragraphs.spans_alike(around, a, b)
    for i, j, found, lo, hi in zip(a, b, *got):
        grams = [[tuple(r[k : k + 5]) for k in range(88)] for r in (rows[i], rows[j])]
        sets = [[set(g[c : c + 47]) for c in range(42)] for g in grams]
        ok = [c for c in range(42) if len(x := sets[0][c]) >= 38 and len(y := sets[1][c]) >= 38 and len(x & y) >= 0.8 * len(x | y)]
        assert found == bool(ok) and (not ok or (lo, hi) == (ok[0] - 41, ok[-1] - 41 + 51))


def test_paragraphs_of_three_that_share_units(spark):
    rng = random.Random(13)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(0, 1500, 3):  # the third shares 45 words only, so it is like neither of the others
        passage = text(51)
        rows += [(i + j, " ".join(text(60) + p + text(60))) for j, p in enumerate((passage, passage, passage[3:48]))]
    assert {r.doc_id for r in paragraphs.similar_paragraphs(docs(spark, rows)).collect()} == {i for i in range(1500) if i % 3 < 2}


def edited_passages(rng, n):
    """Texts that share nothing but one passage of 51 to 58 words by pairs, changed once; and how it was changed."""
    word = lambda: f"{'Ww'[rng.randrange(8) > 0]}{rng.randrange(10**6)}"
    common = [word() for _ in range(30)]  # a line in every fourth text
    out = []
    for i in range(n):
        passage = [word() for _ in range(rng.randrange(51, 59))]
        at, other = rng.randrange(len(passage)), list(passage)
        if i % 4 == 0:
            other[at] = word()
        elif i % 4 == 1:
            other.insert(at, word())
        elif i % 4 == 2:
            del other[at]
        else:
            for at in (0, -3) if i % 8 == 3 else (20, 35):  # two changes inside are too many
                other[at] = word()
        for p in (passage, other):
            out.append((common if i % 4 == 3 else []) + [word() for _ in range(rng.randrange(20, 60))] + p + [word() for _ in range(rng.randrange(20, 60))])
    return out


def best_jaccard(a, b):
    grams = [[tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in (a, b)]
    x, y = ([set(g[i : i + 47]) for i in range(len(g) - 46)] for g in grams)
    return max(len(p & q) / len(p | q) for p in x for q in y)


@pytest.mark.parametrize("full", [3, 512])
def test_every_edited_passage_is_found(spark, monkeypatch, full):
    monkeypatch.setattr(paragraphs, "FULL", full)
    texts = edited_passages(random.Random(14), 120)
    want = {d for i in range(0, 240, 2) if best_jaccard(texts[i], texts[i + 1]) >= 0.8 for d in (i, i + 1)}
    got = {r.doc_id for r in paragraphs.similar_paragraphs(docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    print("RECALL", len(got & want), len(want))
    assert got == want and 100 < len(want) < 240


def test_an_instance_that_many_bands_find_is_one_row(spark):
    """By a common core and by halves as well: what joins roots has a row for each instance, not for each find."""
    rng = np.random.default_rng(7)
    base, other = (rng.integers(1, 1 << 32, paragraphs.WIDTH, dtype=np.uint32) for _ in range(2))
    alike, edited = base.copy(), base.copy()
    alike[80:] = other[80:]
    edited[[30, 62]] = other[[30, 62]]
    rows = [(5, i, bytearray(w.tobytes())) for i, w in enumerate([base, alike, edited, other])]
    found = paragraphs._common(spark.createDataFrame(rows, "unit long, inst long, words binary")).collect()
    assert sorted((r.inst, r.root) for r in found) == [(0, 0), (1, 0), (2, 0)]


def test_copies_with_edits_meet_by_blocks(spark, monkeypatch):
    """What a unit's blocks share has a row for each block, not for each copy; links are those of one large comparison."""
    rng = random.Random(11)
    base, rows = [f"{'Ww'[k % 9 > 0]}{k}" for k in range(90)], []
    for i in range(300):
        text = list(base)
        for at in rng.sample(range(90), rng.randrange(1, 9)):
            text[at] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join([f"a{i}", *text, f"b{i}"])))
    held, saved = {}, paragraphs.saved

    def kept(df, name, *partition):
        held[name] = out = saved(df, name, *partition)
        return out

    def found(full):
        monkeypatch.setattr(paragraphs, "FULL", full)
        return {r.doc_id: r.cluster_id for r in paragraphs.similar_paragraphs(docs(spark, rows)).collect()}

    want = found(512)
    monkeypatch.setattr(paragraphs, "saved", kept)
    assert found(64) == want and len(want) > 100
    assert 0 < held["paragraph-core"].count() <= 2 * held["paragraph-firsts"].count() * (300 // 64 + 1)
    per_key = held["paragraph-core"].groupBy("key").count().agg({"count": "max"}).first()[0]
    assert per_key <= 300 // 64 + 1


def test_common_line_makes_no_paragraph(spark, monkeypatch):
    monkeypatch.setattr(paragraphs, "FULL", 4)
    rng = random.Random(10)
    rows = [(i, "The very common line that they all begin with. " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + f" end{i}") for i in range(10)]
    assert {r.doc_id for r in paragraphs.similar_paragraphs(docs(spark, rows)).collect()} == {*range(10), *range(100, 110)}


def exact(x, ids, k=10):
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("n", [60, 700])
def test_neighbours_of_small_tables(spark, n):
    """Up to a part's rows the search is exact; above, the learned parts are searched as for any table."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 8)).astype("f4")
    x[5] = x[9] = x[20] = x[n // 7]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(10_000, None, 0), (10_100, [0.0] * 8, 0), (10_200, [float("nan")] * 8, 0), (10_300, [None] * 8, 0), (10_400, [1.0, 2.0], 0), (None, x[0].tolist(), 0), (0, x[0].tolist(), 0)]
    got = defaultdict(list)
    for r in neighbours.search(spark.createDataFrame(rows, VECTORS)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = exact(x.astype("f8"), np.arange(n))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    for q, found in got.items():
        far = np.sqrt(((x.astype("f8") - x[q].astype("f8")) ** 2).sum(axis=1))
        assert q not in [i for i, _ in found] and all(abs(far[i] - score) < 1e-12 for i, score in found)
        assert found == sorted(found, key=lambda r: (r[1], r[0]))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in v}) for q, v in want.items())
    assert hits == 10 * len(want) if n <= neighbours.PART_ROWS else hits >= 9 * len(want)
    assert neighbours.fit(x.astype("f8"), n).parts == (1 if n <= neighbours.PART_ROWS else 16)
    few = neighbours.search(spark.createDataFrame(rows[:4], VECTORS)).collect()
    assert [r.rank for r in few] == [1, 2, 3]
    assert neighbours.search(spark.createDataFrame([], VECTORS)).isEmpty()


def test_a_repeated_neighbour_counts_once(spark):
    x = np.random.default_rng(6).normal(size=(60, 8)).astype("f4")
    want = exact(x.astype("f8"), np.arange(60))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += 25 * [rows[want[0][0][0]]]
    got = neighbours.search(spark.createDataFrame(rows, VECTORS)).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for i, _ in want[0]]


def test_learned_partitions_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 500)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16))
    x = (centres[rng.integers(0, 60, 9000)] + 0.25 * rng.normal(size=(9000, 16))).astype("f4")
    x[:900] = x[0]  # a very common vector
    got = defaultdict(set)
    for r in neighbours.search(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)).collect():
        got[r.query_id].add(r.vec_id)
    want = exact(x.astype("f8"), np.arange(9000))
    hits = sum(len(got[q] & {i for i, _ in v}) for q, v in want.items())
    assert all(len(v) == 10 for v in got.values()) and hits >= 0.9 * 10 * len(want)
    router = neighbours.fit(x[:4000].astype("f8"), 9000)
    assert router.probes < router.parts


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = [(i, " ".join(word() for _ in range(120)) + (f" mail a{i}@b.co" if i % 4 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0", 0), (101, "too few", "en", "s1", 0), (102, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert ids <= set(range(60)) and len(ids) > 30
    assert not any("@" in r.text for r in out) and all(("<EMAIL>" in r.text) == (r.doc_id % 4 == 0) for r in out)
    assert all(r.token_ids for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "pii", "mixing", "bpe"]
    words = defaultdict(int)
    for r in out:
        words[r.source] += len(r.text.split())
    assert len(words) == 3


def test_pipeline_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs_in = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(80)), "en", "a", 1)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs_in, str(tmp_path)).columns == docs_in.columns, name
        assert stage(spark, docs_in.limit(0), str(tmp_path)).isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, docs_in, "").filter(F.size("token_ids") > 0).count() == 1


def test_stages_and_columns_of_their_own_names(spark):
    """Columns of docs that are named as the stages' helpers keep their names and values through all stages."""
    names = ["__mix_source", "__mix_copies", "__mix_copy", "__pii_spans", "__pii_a", "__PII_added", "__ledger_failed", "__ledger_measures", "__kept_id", "node", "root", "failed"]
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshrd") for _ in range(5))
    rows = [(i, "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(12)) + " Write to a.b@c.org now.", "en", "s", 0, *[f"{n}{i}" for n in names]) for i in range(4)]
    docs_in = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs_in, "")
        kept = out.select("doc_id", *names).distinct().collect()
        assert kept and all(tuple(r)[1:] == tuple(f"{n}{r.doc_id}" for n in names) for r in kept)
