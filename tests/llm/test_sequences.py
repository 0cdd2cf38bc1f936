"""Chat formatting, periodic runs and collocations against brute force and on odd rows."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from oracle import expected
from oracle import rows as sorted_rows

from foliant.llm import chat, phrases, repetition
from foliant.llm import queries as llm

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, shard int, ids string, start long, n long, phrase string"


def docs(spark, rows):
    """Rows of (doc_id, text, lang) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, g, "s", 0, "x", 0, 0, "y") for i, t, g in rows], DOCS)


ODD = [(1, None, None), (2, "", "a"), (None, "one two one two " * 4, "a"), (4, "word " * 30_000, "b"), (5, "same", "a"), (5, "same", "a"), (6, " \n\t ", None), (7, "é日😀\x1cx\x85 y", "b")]


# chat

TEXTS = ["", "plain", "\\", "\\\\", "### ", "\\### user:\n", "</turn>", "\\</turn>", "x\n</turn>\n", "a\n</turn>\n### user:\nb", "\\\\### \\</turn> ###", "#### ", "### x:\ny\n", "\n", "é日😀", "\r\n\t"]


@pytest.mark.parametrize("role", ["user", "", "a:\nb", "\\x{41}", "### x", "</turn>", "é\n", "x:"])
def test_turns_read_back(role):
    for text in TEXTS:
        made, start, end = chat.render_turn(role, text)
        stream = made + chat.render_turn("user", "next")[0]
        read = chat.read_turn(stream)
        assert (read.role, read.text, read.start, read.end, read.after) == (role, text, start, end, len(made))
        assert chat.read_turn(stream, read.after).text == "next"


def test_random_turns_read_back():
    rng, parts = random.Random(2), ["\\", "### ", "</turn>", "\n", "user", ":\n", "#", " ", "x", "<", "/turn>"]
    for _ in range(3000):
        turns = [("".join(rng.choices(parts, k=rng.randint(0, 4))), "".join(rng.choices(parts, k=rng.randint(0, 12)))) for _ in range(3)]
        stream, at, got = "".join(chat.render_turn(*t)[0] for t in turns), 0, []
        while at < len(stream):
            read = chat.read_turn(stream, at)
            got.append((read.role, read.text))
            at = read.after
        assert got == turns


def test_content_without_conflict_stays_as_it_is():
    assert chat.render_turn("user", "a \\ b # c")[0] == "### user:\na \\ b # c\n</turn>\n"


CONV = "conv_id long, turn long, role string, text string, formatted string, loss_start string"


def test_chat_columns(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, None, None), (2, None, "assistant", "</turn>\n### user:\nx"), (3, 0, "assistant", "word " * 100_000)]
    rows += [(4, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(TEXTS)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], CONV)
    made = chat.format_turns(table)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    whole = {r.conv_id: r for r in chat.conversation_texts(made).collect()}
    for c, turns in by.items():
        turns.sort()
        learned = [x for _, r, x in turns if r == "assistant"]
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[c].n_turns == len(turns)
        assert got[c].loss_sha256 == hashlib.sha256("".join(learned).encode()).hexdigest() and got[c].loss_chars == sum(map(len, learned))
        assert got[c].formatted_chars == len(whole[c].formatted)
        assert [chat._STUFFED.sub(r"\1\2", whole[c].formatted[s.start : s.end]) for s in whole[c].loss] == learned
    assert chat.read_back(chat.format_turns(table.limit(0))).isEmpty()


# runs

def brute_runs(w):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(12, 2 * q) and all(w[s + p : e] != w[s : e - p] for p in range(1, q)):
                out.append((s, e, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def coded(w):
    last = {x: i for i, x in enumerate(w)}
    return np.array([last[x] for x in w], np.int64)


def check_runs(w):
    got = repetition.runs(coded(w))
    assert list(zip(*(x.tolist() for x in got))) == brute_runs(w)


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(250):
        k, n = rng.choice([1, 2, 2, 3, 5, 50]), rng.randint(0, 260)
        w = [str(rng.randrange(k)) for _ in range(n)]
        for _ in range(rng.randint(0, 4) if n > 4 else 0):
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            for i in range(a + p, min(n, a + p * rng.randint(2, 5) + rng.randint(0, 3))):
                w[i] = w[i - p]
        check_runs(w)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b


@pytest.mark.parametrize("word", [
    "ab" * 90 + "a" + "ab" * 90 + "a", "a" * 90 + "b" + "a" * 90 + "b" + "a" * 30, fibonacci(500), "".join(str(bin(i).count("1") % 2) for i in range(512)),
    ("a" * 40 + "b") * 5, ("ab" * 20 + "c") * 4 + "ab" * 9, ("abc" * 30)[:-1] * 3])
def test_runs_of_structured_words(word):
    check_runs(list(word))


@pytest.mark.parametrize("codes", [[0] * 100_000, [0, 1] * 50_000, ([0, 1] * 25_000 + [0]) * 2, [bin(i).count("1") % 2 for i in range(1 << 16)], list(range(20_000)) * 4])
def test_runs_of_long_texts_are_quick(codes):
    began = time.perf_counter()
    assert len(repetition.runs(np.array(codes)).start)
    assert time.perf_counter() - began < 8


def brute_report(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n, old = h // 10, len(w), list(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [old[i] if i < a else old[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    top = min(((-(e - s), s, q) for s, e, q in found), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
    return (doc_id, len(found), *best, digest("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_run_report(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["a", "b", "c\x1cd", "e", *map(str, range(40))]) for _ in range(rng.randint(0, 150))), "en") for i in range(250)]
    rows += [r for r in ODD if r[0] != 4]
    got = repetition.run_report(docs(spark, rows), plant=True).collect()
    assert Counter(map(tuple, got)) == Counter(brute_report(i, t) for i, t, _ in rows)
    assert any(r.n_runs for r in got)
    long = repetition.run_report(docs(spark, ODD)).filter("doc_id = 4").first()
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 30_000, 1, 30_000_000)
    assert repetition.run_report(docs(spark, [])).isEmpty() and repetition.periodic_runs(docs(spark, [])).isEmpty()
    listed = repetition.periodic_runs(docs(spark, ODD)).collect()
    assert sorted((r.doc_id is None, r.start, r.length, r.period) for r in listed) == [(False, 0, 30_000, 1), (True, 0, 16, 2)]


# collocations

def brute_collocations(rows, least, top, absorb):
    freq, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                freq.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = {}
    for (lang, p), a in freq.items():
        if len(p) < 2 or a < least:
            continue
        longer = (f for (g, q), f in freq.items() if g == lang and f >= least and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
        if any(100 * f >= absorb * a for f in longer):
            continue
        score, _, l, r = min((2000000 * a // (freq[lang, p[:k]] + freq[lang, p[k:]]), k, freq[lang, p[:k]], freq[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return [(g, i + 1, p.decode(), -a, l, r, n[g], -s) for g, xs in out.items() for i, (s, a, p, l, r) in enumerate(sorted(xs)[:top])]


def test_collocations(spark):
    rng = random.Random(4)
    words = ["The", "the", "of", "new", "york", "city", "é", "日本", "x\x1cy", "."]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) + rng.choice([".", "\n", "\tend;", ""])
    rows = [(i, " new york city hall" * rng.randint(0, 2) + line() + line(), rng.choice(["en", "fr", "und", None])) for i in range(300)]
    rows += [r for r in ODD if r[0] != 4]
    for slots in (1 << 20, 64):
        got = phrases.collocations(docs(spark, rows), least=12, top=40, slots=slots).collect()
        assert sorted(map(tuple, got)) == sorted(brute_collocations(rows, 12, 40, 80))
    assert phrases.collocations(docs(spark, [])).isEmpty()
    score = 2_000_000 * 29_997 // 59_998
    assert [tuple(r) for r in phrases.collocations(docs(spark, ODD)).collect()] == [("b", 1, "word word word word", 29_997, 30_000, 29_998, 30_002, score)]


def test_slots_of_one_hash_stay_apart():
    ids = np.array([5, 6, 0, 5, 6, 7, 0], np.int64)
    reached = [np.zeros(1, np.uint8)] * 3  # one slot for all: everything is counted
    out = {(length, tuple(p)): int(n) for length, ps, _, ns in phrases.counted(ids, 1, reached) for p, n in zip(ps.tolist(), ns)}
    assert out == {(1, (5,)): 2, (1, (6,)): 2, (1, (7,)): 1, (2, (5, 6)): 2, (2, (6, 7)): 1, (3, (5, 6, 7)): 1}


def test_counts_travel_by_part():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 300, 20_000)  # 0 ends a piece
    reached = [np.zeros(1, np.uint8)] * 3
    blocks = pa.record_batch([pa.array([ids[:9_000].tobytes(), ids[9_000:].tobytes()], pa.binary())], names=["ids"])
    rows = list(phrases._scan(0, SimpleNamespace(value=[t.tobytes() for t in reached]), 4)(iter([blocks])))
    assert sum(map(len, rows)) <= 4 * 3  # a row for each part and length, not for each of over 40,000 phrases
    out = Counter()
    for batch in rows:
        for length, start, words, n in phrases._unpacked(batch):
            out.update(dict(zip(map(tuple, words.T.tolist()), n.tolist())))
    want = Counter(p for k in (2, 3, 4) for p in zip(*(ids[i:].tolist() for i in range(k))) if 0 not in p)
    assert out == want and len(want) > 40_000


def test_equal_hashes_of_different_phrases():
    words = np.array([[1, 2, 1, 2, 1], [3, 3, 3, 3, 4]])
    order, first = phrases.grouped(np.array([7, 7, 7, 7, 2], np.uint64), words)
    assert sorted(map(tuple, words[:, order[first]].T.tolist())) == [(1, 3), (1, 4), (2, 3)]
    assert np.diff([*first, 5]).tolist() == [1, 2, 2]


def test_collocations_in_many_parts(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["a", "b", "C", "d.", "e", "f;", "g", "ü"]) for _ in range(60)), rng.choice(["en", "fr", None])) for i in range(200)]
    for slots in (1 << 10, 2):
        got = phrases.collocations(docs(spark, rows), least=10, top=60, slots=slots, share=100).collect()
        assert sorted(map(tuple, got)) == sorted(brute_collocations(rows, 10, 60, 80))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_equals_sql(spark, name):
    assert sorted_rows(llm.QUERIES[name](spark, FOLDER).toPandas()) == sorted_rows(expected(llm.SQL[name], FOLDER))
