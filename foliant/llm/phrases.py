"""Collocations by dynamic itemset counting over shards of words.

The corpus is written once as words' hashes in SHARDS shards, and single words are counted on the way. The shards are
then scanned in a cycle. Every scan counts phrases of all lengths at once: pairs of frequent words from the first scan on,
a longer phrase from the scan after both phrases that it consists of but for its last and its first word have
reached the threshold, each for one whole cycle, so that every count is exact. A phrase that waits for the end of
a level in level-wise mining is counted here as soon as it may be frequent.

Which phrases have reached the threshold, and when, goes to the tasks as one table of SLOTS bytes for each
length, indexed by hash: its size is fixed whatever the data. Phrases that share a slot share its time,
so some are counted without need and none is missed; at more frequent phrases than SLOTS the work grows
and the counts stay the same. Phrases are told apart by the 64-bit hashes of all their words.

Each task adds up its counts before they are shuffled, so a hot word or pair is counted once a task. Counts travel as
arrays, one row for all phrases of a task that fall into one part of the hashes; there are as many parts as keep
a part at about SHARE words of the corpus, and each part is added up by itself. A row for every phrase cost the JVM
two thirds of the whole job.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .copies import slices
from .storage import saved, spent

LONGEST, SHARDS = 4, 4
SLOTS = 1 << 22
WORDS = 1 << 19  # words that a task counts at once
SHARE = 1 << 19  # words of the corpus for each part of the hashes
ROW = 1 << 15  # words in a row of a shard; large rows fill the JVM with objects that it can hardly move
NEVER = 255
TOP_SALTS = 64
_STOPS = b".,;:!?\n\x0b\x0c\r"
#: upper case to lower, tabs to spaces, what ends a piece to full stops
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + b"\t" + _STOPS, bytes(range(97, 123)) + b" " + b"." * len(_STOPS))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def split_pieces(text: str) -> list[bytes]:
    """The words of a text, with b"." where a piece ends."""
    return text.encode().translate(_PLAIN).replace(b".", b" . ").split()


def word_hash(lang: str, word: bytes) -> int:
    """64 bits for a word of a language, never 0."""
    return xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + word) or 1


class _Names:
    """The different words of a language in a task, b"." first, their hashes and times."""

    def __init__(self, lang: str):
        self.lang, self.codes, self.hashes, self.times = lang, defaultdict(count().__next__), np.zeros(1, np.uint64), np.zeros(1, np.int64)
        self.codes[b"."]

    def coded(self, words: list[bytes]) -> np.ndarray:
        """Hashes of words, pieces ending in 0; counts the words."""
        at = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        new = list(islice(reversed(self.codes), len(self.codes) - len(self.hashes)))[::-1]
        self.hashes = np.append(self.hashes, np.fromiter((word_hash(self.lang, w) for w in new), np.uint64, len(new)))
        times = np.bincount(at, minlength=len(self.codes))
        times[: len(self.times)] += self.times
        self.times = times
        return np.append(self.hashes[at], np.uint64(0))


SHARD_ROWS = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("ids", pa.binary()), ("words", pa.binary()), ("times", pa.binary()), ("size", pa.int64()), ("n", pa.int64())])


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of words (shard, ids) and rows of different words (shard -1; ids, words joined by spaces, times, how many they are and occur)."""
    from pyspark import TaskContext

    turn = TaskContext.get().partitionId()
    held: dict[str, list[bytes]] = {}
    names: dict[str, _Names] = {}

    def made(lang: str) -> pa.RecordBatch:
        nonlocal turn
        ids = (names.get(lang) or names.setdefault(lang, _Names(lang))).coded(held.pop(lang))
        turn += 1
        return _rows(SHARD_ROWS, [((turn - 1) % SHARDS, None, ids.tobytes(), None, None, None, None)])

    def named() -> Iterator[pa.RecordBatch]:
        for lang, known in names.items():
            words = list(known.codes)
            for i in range(1, len(words), ROW):
                some, times = words[i : i + ROW], known.times[i : i + ROW]
                yield _rows(SHARD_ROWS, [(-1, lang, known.hashes[i : i + ROW].tobytes(), b" ".join(some), times.tobytes(), len(some), int(times.sum()))])
        names.clear()

    n = 0
    for batch in slices(batches, 256):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = held.setdefault(lang, [])
            before = len(words)
            words.extend(split_pieces(text))
            words.append(b".")
            n += len(words) - before
            if len(words) >= ROW:
                n -= len(words)
                yield made(lang)
        if n >= WORDS:  # many languages, few words of each
            for lang in list(held):
                yield made(lang)
            n = 0
        if sum(len(x.codes) for x in names.values()) > WORDS:
            yield from named()
    for lang in list(held):
        yield made(lang)
    yield from named()


def _folded(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def _longer(key: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases that go on by a word."""
    return _folded(key * _ODD + words)


def _hashed(words: np.ndarray) -> np.ndarray:
    """Hashes of phrases; words: a row for each place in the phrase."""
    x = words.view(np.uint64)
    out = _folded(x[0])
    for more in x[1:]:
        out = _longer(out, more)
    return out


def _part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """Which of equal ranges of the hashes each is in."""
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def grouped(key: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash that brings equal phrases together, and where each begins in it."""
    order = np.argsort(key)
    for again in (False, True):
        if again:
            order = np.lexsort((*words, key))
        other = np.zeros(max(len(order) - 1, 0), bool)
        for w in words:
            w = w[order]
            other |= w[1:] != w[:-1]
        sorted_key = key[order]
        if not (other & (sorted_key[1:] == sorted_key[:-1])).any():
            break  # no two phrases have one hash
    return order, np.concatenate([[0], np.flatnonzero(other) + 1])


def counted(ids: np.ndarray, step: int, reached: list[np.ndarray], shortest: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """length, phrases as rows of word ids by their hashes, scan from which they count, occurrences: what one scan counts in these words.

    reached[k]: for each slot of phrases of k + 1 words the scan after one of them came to the threshold.
    """
    x = ids.view(np.uint64)
    at = np.flatnonzero(ids)  # a 0 ends a piece
    key, start = _folded(x[at]), np.zeros(len(at), np.uint8)
    for length in range(1, LONGEST + 1):
        some = np.flatnonzero((start <= step) & (start >= max(step - SHARDS + 1, 0)))
        if length >= shortest and len(some):
            words = np.stack([ids[at[some] + k] for k in range(length)])
            order, first = grouped(key[some], words)
            n = np.diff(np.append(first, len(some)))
            first = order[first]
            yield length, words[:, first].T, start[some[first]].astype(np.int32), n
        if length == LONGEST:
            return
        # a phrase's time is never before those of the phrases within it: one that shares a slot may not come early
        ready = np.maximum(start, reached[length - 1][(key & np.uint64(len(reached[length - 1]) - 1)).view(np.int64)])
        go = np.flatnonzero((at[1:] == at[:-1] + 1) & (ready[:-1] != NEVER) & (ready[1:] != NEVER))
        at, start = at[go], np.maximum(ready[go], ready[go + 1])
        key = _longer(key[go], x[at + length])


COUNT_ROWS = pa.schema([("part", pa.int32()), ("length", pa.int32()), ("start", pa.int32()), ("often", pa.bool_()), ("phrases", pa.binary()), ("counts", pa.binary())])
COUNTS = "part int, length int, start int, often boolean, phrases binary, counts binary"


def packed(length: int, phrase: np.ndarray, start: np.ndarray, n: np.ndarray, parts: int) -> Iterator[tuple]:
    """Counts that are ordered by hash, as one row for each part and start: words of the first place, then of the second and so on."""
    for s in np.unique(start):
        some = start == s
        words, times = np.ascontiguousarray(phrase[some].T), n[some].astype(np.int64)
        part = _part_of(_hashed(words), parts)
        ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(part)).tolist()
        for lo, hi in zip([0, *ends], ends):
            yield int(part[lo]), length, int(s), False, words[:, lo:hi].tobytes(), times[lo:hi].tobytes()


def _scan(step: int, tables, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = [np.frombuffer(t, np.uint8) for t in tables.value]

        def made(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for length, phrase, start, n in counted(np.concatenate(held), step, reached, shortest=2):
                yield _rows(COUNT_ROWS, list(packed(length, phrase, start, n, parts)))

        held, n = [], 0
        for batch in batches:
            for ids in batch.column(0):
                held.append(np.frombuffer(ids.as_buffer(), np.int64))
                n += len(held[-1])
                if n >= WORDS:
                    yield from made(held)
                    held, n = [], 0
        if held:
            yield from made(held)

    return run


def _unpacked(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """length, start, words (a row for each place in the phrase) and counts of each row."""
    for length, start, words, n in zip(*(table.column(c) for c in ("length", "start", "phrases", "counts"))):
        yield length.as_py(), start.as_py(), np.frombuffer(words.as_buffer(), np.int64).reshape(length.as_py(), -1), np.frombuffer(n.as_buffer(), np.int64)


def _added(step: int, least: int):
    def run(table: pa.Table) -> pa.Table:
        """The counts of one part, added up; rare phrases whose cycle ends with this scan are left out."""
        part, held, out = table.column("part")[0].as_py(), {}, []
        for length, start, words, n in _unpacked(table):
            held.setdefault((length, start), []).append((words, n))
        for (length, start), rows in held.items():
            words, n = np.concatenate([w for w, _ in rows], axis=1), np.concatenate([x for _, x in rows])
            order, first = grouped(_hashed(words), words)
            words, n = words[:, order[first]], np.add.reduceat(n[order], first)
            for often, some in ((True, n >= least), (False, (n < least) & (start + SHARDS > step + 1))):
                if some.any():
                    out.append((part, length, start, often, words[:, some].tobytes(), n[some].tobytes()))
        return pa.Table.from_batches([_rows(COUNT_ROWS, out)])

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """phrase, f: a row for each phrase."""
    for batch in batches:
        for length, _, words, n in _unpacked(batch):
            raw = np.ascontiguousarray(words.T).tobytes()
            size = 8 * length
            yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary()), pa.array(n)], names=["phrase", "f"])


def _reach(new: DataFrame, tables: list[np.ndarray], start: int) -> bool:
    """Write the scan that follows into the slots of phrases at the threshold, by bitmaps of fixed size; whether any slot is new."""
    slot = _slot(len(tables[0]))
    if "phrase" not in new.columns:  # counts: in one worker with what unpacks them, as each holds memory of its own
        slots = new.mapInArrow(lambda batches: slot(_listed(batches)), "length int, slot long")
    else:
        slots = new.mapInArrow(slot, "length int, slot long")
    slots = slots.withColumn("slot", F.col("slot") + 1)
    bits = slots.groupBy("length", F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    found = False
    for length, bucket, marked in bits.collect():  # a bit for each slot at most
        at = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(marked), np.uint8), bitorder="little")) + (bucket - 1) * 8 * len(marked)
        at = at[tables[length - 1][at] == NEVER]
        tables[length - 1][at] = start
        found |= len(at) > 0
    return found


def _slot(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """length, slot of phrases."""
        for batch in batches:
            by = {}
            for k in batch.column(0).to_pylist():
                by.setdefault(len(k) // 8, []).append(k)
            for length, ks in by.items():
                words = np.ascontiguousarray(np.frombuffer(b"".join(ks), np.int64).reshape(-1, length).T)
                slot = (_hashed(words) & np.uint64(slots - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([length] * len(ks), pa.int32()), pa.array(slot)], names=["length", "slot"])

    return run


NAME_ROWS = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("ids", pa.binary()), ("words", pa.binary()), ("times", pa.binary())])


def _dealt(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of different words, one for each part of their hashes."""
        for batch in batches:
            for lang, ids, words, times in zip(*(batch.column(c) for c in ("lang", "ids", "words", "times"))):
                ids, times, words = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(times.as_buffer(), np.int64), words.as_py().split(b" ")
                part = _part_of(_hashed(ids[None]), parts)
                order = np.argsort(part)
                ends = np.searchsorted(part[order], np.arange(parts), "right").tolist()
                some = [(i, order[lo:hi]) for i, (lo, hi) in enumerate(zip([0, *ends], ends)) if lo < hi]
                yield _rows(NAME_ROWS, [(i, lang.as_py(), ids[x].tobytes(), b" ".join([words[j] for j in x.tolist()]), times[x].tobytes()) for i, x in some])

    return run


def _named(least: int):
    schema = pa.schema([("id", pa.binary()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        """The words of one part that occur often enough."""
        rows = [tuple(table.column(c)[i] for c in ("lang", "ids", "words", "times")) for i in range(len(table))]
        ids, times = (np.concatenate([np.frombuffer(r[k].as_buffer(), np.int64) for r in rows]) for k in (1, 3))
        order, first = grouped(ids.view(np.uint64), ids[None])
        n = np.add.reduceat(times[order], first)
        often = n >= least
        which = np.sort(order[first[often]])
        n = dict(zip(ids[order[first[often]]].tolist(), n[often].tolist()))
        out, begin = [], 0
        for lang, _, words, _ in rows:
            words = words.as_py().split(b" ")
            for i in which[np.searchsorted(which, begin) : np.searchsorted(which, begin + len(words))].tolist():
                id = int(ids[i])
                out.append((id.to_bytes(8, "little", signed=True), lang.as_py(), words[i - begin].decode(), n[id]))
            begin += len(words)
        return pa.Table.from_batches([_rows(schema, out)])

    return run


def frequent_phrases(docs: DataFrame, least: int = 30, slots: int = SLOTS, share: int = SHARE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrase, f) of all phrases of 1 to LONGEST words with f >= least; (id, lang, word, n) of such words; (lang, n) of all words.

    phrase: the ids of its words, 8 bytes each. What is counted is written to the shared folder scan by scan.
    slots: a power of two; each task holds three tables of so many bytes. share: words of the corpus for each part
    that is added up by itself, in memory.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    made = saved(rows.mapInArrow(_shards, "shard int, lang string, ids binary, words binary, times binary, size long, n long"), "phrase-shards", "shard")
    names = made.filter("shard = -1")
    total = saved(names.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    size, n = (max(x or 0, 1) for x in names.agg(F.sum("size"), F.sum("n")).first())
    dealt = names.select("lang", "ids", "words", "times").mapInArrow(_dealt(-(-size // share)), "part int, lang string, ids binary, words binary, times binary")
    words = saved(dealt.groupBy("part").applyInArrow(_named(least), "id binary, lang string, word string, n long"), "phrase-words")
    parts = -(-n // share)
    tables = [np.full(slots, NEVER, np.uint8) for _ in range(LONGEST - 1)]
    now, done, step = None, [words.select(F.col("id").alias("phrase"), F.col("n").alias("f"))], 0
    ends = SHARDS if _reach(words.select(F.col("id").alias("phrase")), tables, 0) else 0
    while step < ends:
        sent = spark.sparkContext.broadcast([t.tobytes() for t in tables])
        counts = made.filter(F.col("shard") == step % SHARDS).select("ids").mapInArrow(_scan(step, sent, parts), COUNTS)
        if now is not None:
            counts = counts.unionByName(now.filter(F.col("start") + SHARDS > step))
        last, now = now, saved(counts.groupBy("part").applyInArrow(_added(step, least), COUNTS), "phrase-counts", "often")
        sent.destroy()
        if last is not None:
            spent(last)
        new = now.filter(F.col("often") & (F.col("length") < LONGEST)).select("length", "start", "phrases", "counts")
        step += 1
        if _reach(new, tables, step):
            ends = step + SHARDS
        ended = now.filter(F.col("often") & (F.col("start") + SHARDS <= step)).select("length", "start", "phrases", "counts")
        done.append(saved(ended.mapInArrow(_listed, "phrase binary, f long"), "phrase-done"))
    spent(made, *([now] if now is not None else []))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every, words, total


def _part(phrase: Column, first: Column, n: Column) -> Column:
    """n words of a phrase from the first (from 1) on."""
    return F.substring(phrase, (first - 1) * 8 + 1, n * 8)


def _times(x: Column, by: int) -> Column:
    return x.cast("decimal(20,0)") * F.lit(by).cast("decimal(7,0)")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, absorb: int = 80, slots: int = SLOTS, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2 to 4 words.

    Words are lower-cased runs (A-Z only) between spaces and tabs, phrases lie within pieces between
    .,;:!? and line breaks; a = f(phrase) >= least. A phrase is cut where floor(2000000 a / (l + r)) is least (ties: the
    first cut), l and r being the frequencies of its parts. Phrases inside a longer one of at least absorb
    percent of their frequency are left out. Order: score, a (both descending), phrase by bytes. n: words of
    the language. Null lang: "und"; null text: empty; repeated rows all count; texts of any length are whole;
    an empty table gives no rows; other columns, ids among them, are not read. All numbers are exact.
    """
    freq, words, total = frequent_phrases(docs, least, slots, share)
    freq = saved(freq, "phrase-frequent")
    size = F.octet_length("phrase") / 8
    cand = freq.withColumn("len", size.cast("int")).filter("len >= 2").withColumnRenamed("f", "a")
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("len") - 1)))
    cuts = cuts.withColumns({"left": _part(F.col("phrase"), F.lit(1), F.col("k")), "right": _part(F.col("phrase"), F.col("k") + 1, F.col("len") - F.col("k"))})
    cuts = cuts.join(freq.select(F.col("phrase").alias("left"), F.col("f").alias("l")), "left").join(freq.select(F.col("phrase").alias("right"), F.col("f").alias("r")), "right")
    cuts = cuts.withColumn("score", F.expr("cast(a as decimal(20,0)) * 2000000 div (l + r)"))
    best = cuts.groupBy("phrase", "a", "len").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("phrase", "a", "len", "x.score", "x.l", "x.r")
    longer = cand.filter("len > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("len") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("len") - F.col("m") + 1)))
    longer = longer.groupBy(_part(F.col("phrase"), F.col("at"), F.col("m")).alias("inner")).agg(F.max("a").alias("most"))
    inside = _times(F.col("most"), 100) >= _times(F.col("a"), absorb)
    kept = best.join(longer, F.col("phrase") == F.col("inner"), "left").filter(~F.coalesce(inside, F.lit(False)))
    kept = kept.withColumns({f"w{i}": F.when(F.col("len") >= i, _part(F.col("phrase"), F.lit(i), F.lit(1))) for i in range(1, LONGEST + 1)})
    named = words.select("id", "lang", "word")
    ranked = kept.join(named.select(F.col("id").alias("w1"), "lang", F.col("word").alias("t1")), "w1")
    score = [F.desc("score"), F.desc("a")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALTS))
    for part in (["lang", salt], ["lang"]):  # no task ranks a whole language
        ranked = ranked.withColumn("above", F.rank().over(Window.partitionBy(*part).orderBy(*score))).filter(F.col("above") <= top)
    for i in range(2, LONGEST + 1):
        ranked = ranked.join(named.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"t{i}")), f"w{i}", "left")
    text = F.concat_ws(" ", *(f"t{i}" for i in range(1, LONGEST + 1)))
    order = Window.partitionBy("lang").orderBy(*score, "text")
    ranked = ranked.withColumn("text", text).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", F.col("text").alias("phrase"), "a", "l", "r", "n", "score")
