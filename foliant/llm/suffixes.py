"""Repeated passages by sparse suffix arrays.

Suffixes are retained at minimisers: of any WINDOW consecutive grams of GRAM words, the one of least
hash. So two equal passages retain the same suffixes. Suffixes whose gram occurs in one document only
are dropped by counting; the others are sorted by their text, each is compared with its neighbours of
other documents, and a match is extended left and right. A passage of at least RIGHT + WINDOW - 1 = 51
words starts with a retained suffix that keeps RIGHT words to its right, and between two such suffixes
the order holds none that shares less, so comparing neighbours loses none of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .copies import groups, keyed, merged, report, representatives, slices
from .storage import saved

GRAM, WINDOW, RIGHT = 16, 12, 40
SHOWN = RIGHT + WINDOW + 8  # words to the right that a suffix row carries: later ones belong to later suffixes
PASSAGE = RIGHT + WINDOW


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words."""
    n = len(hashes) - k + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in range(k if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(29)


def retained(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the retained suffixes and the hashes of their grams."""
    if len(words) < RIGHT:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    grams = gram_hashes(word_hashes(words), GRAM)
    view = np.lib.stride_tricks.sliding_window_view(grams, min(WINDOW, len(grams)))
    at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    return at.astype(np.int32), grams[at].view(np.int64)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        rows = []
        for text in batch.column(3):
            words = text.as_py().encode().split()
            rows.append((len(words), *retained(words)))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
            names=["doc_id", "t1", "t2", "n_words", "at", "gram"],
        )


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        ids, at, left, right = [], [], [], []
        for doc, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            words = text.as_py().split(None) if text.as_py().isascii() else [w.decode() for w in text.as_py().encode().split()]
            for p in places.as_py():
                ids.append(doc)
                at.append(p)
                left.append(" ".join(words[max(0, p - WINDOW) : p]))
                right.append(" ".join(words[p : p + SHOWN]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(left, pa.string()), pa.array(right, pa.string())], names=["doc_id", "at", "left", "right"])


def _same(a: list[str], b: list[str]) -> int:
    """How many words two lists share from their start."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class _Row:
    __slots__ = ("at", "doc", "left", "raw", "right")

    def __init__(self, doc, at, left, right):
        self.doc, self.at, self.raw = doc, at, (left, right)
        self.left, self.right = left.split(" ")[::-1] if left else [], right.split(" ")


def _compare(edges: bool):
    """Matches of sorted neighbours. With edges, also the rows at both ends that other tasks must see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        first: list[_Row] | None = []  # the first rows until the document changes, and the row after them
        before: _Row | None = None  # the last row of another document
        alike: list[_Row] = []  # rows of one document in a row

        def match(a: _Row, b: _Row):
            r = len(a.right) if a.raw[1] == b.raw[1] else _same(a.right, b.right)
            if r >= RIGHT:
                left = _same(a.left, b.left)
                out.append((a.doc, a.at - left, a.at + r, b.doc, None, None, None))
                out.append((b.doc, b.at - left, b.at + r, a.doc, None, None, None))

        def edge(row: _Row):
            out.append((row.doc, None, None, None, row.at, *row.raw))

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            columns = list(zip(*out)) or [[]] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "end", "other", "at", "left", "right"])

        for batch in slices(batches, 1000):
            for values in zip(*(batch.column(i).to_pylist() for i in range(4))):
                row = _Row(*values)
                if edges and first is not None:
                    edge(row)
                    first = None if first and row.doc != first[0].doc else [row]
                if alike and row.doc != alike[-1].doc:
                    for a in alike:
                        match(a, row)
                    before, alike = alike[-1], [row]
                else:
                    if before is not None:
                        match(before, row)
                    # of equal rows of one document, the next document need only meet one
                    if alike and alike[-1].right[:RIGHT] != row.right[:RIGHT]:
                        alike = []
                    alike.append(row)  # all of them begin with the same RIGHT words
                if len(out) >= 4000:
                    yield batch_of()
        if edges:
            for row in ([before] if before else []) + alike:
                edge(row)
        yield batch_of()

    return run


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, copy_of, n_words, dup_words, spans, shares_with: documents that repeat a passage of another.

    spans are start:end of words (runs without the six ASCII blanks; end exclusive). Every passage of 51
    words or more that two documents share is in them; shorter ones of at least RIGHT words may be.
    copy_of is the smallest id of the same text (its own if there is none), whose spans it shares; a
    document without any repeated passage gives no row. Rows without an id take no part; null text is
    empty; repeated rows count once; an empty table gives no rows; other columns are ignored. Suffixes that
    are equal as far as they are shown stand in order of doc_id; very long texts are whole, and n_links counts the
    documents beside which a suffix was sorted, not all that share the passage.
    """
    marks = saved(keyed(docs).mapInArrow(_mark, "doc_id long, t1 long, t2 long, n_words int, at array<int>, gram array<long>"), "suffix-marks")
    grouped = groups(marks)
    spread = representatives(marks, grouped).select("doc_id", "t1", "t2", F.explode(F.arrays_zip("at", "gram")).alias("x"))
    spread = saved(spread.select("doc_id", "t1", "t2", "x.at", "x.gram"), "suffix-grams")
    shared = spread.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi").select("gram")
    kept = spread.join(saved(shared, "suffix-shared"), "gram", "left_semi")
    kept = saved(kept.groupBy("doc_id", "t1", "t2").agg(F.array_sort(F.collect_list("at")).alias("at")), "suffix-kept")
    texts = keyed(docs).join(kept, ["doc_id", "t1", "t2"]).select("doc_id", "text", "at")
    row = "doc_id long, at int, left string, right string"
    suffixes = saved(texts.mapInArrow(_suffixes, row), "suffixes")
    order = ["right", "doc_id", "at"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = suffixes.select("doc_id", "at", "left", "right").repartitionByRange(n, *order).sortWithinPartitions(*order)
    match = "doc_id long, start int, end int, other long, at int, left string, right string"
    met = saved(ordered.mapInArrow(_compare(True), match), "suffix-matches")
    # a few rows of each task: the neighbours over the borders of the tasks
    ends = met.filter("start is null").select("doc_id", "at", "left", "right").distinct().repartition(1).sortWithinPartitions(*order)
    spans = met.filter("start is not null").union(ends.mapInArrow(_compare(False), match)).select("doc_id", "start", "end", "other")
    found = spans.groupBy(F.col("doc_id").alias("rep_id")).agg(merged(F.collect_set(F.struct("start", "end"))).alias("spans"), F.min("other").alias("other"), F.collect_set("other").alias("links"))
    return report(marks, grouped, saved(found, "suffix-found"), PASSAGE - 1)
