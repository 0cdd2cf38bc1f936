"""Periodic runs of words by multi-scale minimizers.

A run of period q equals itself q words later, so inside it the least gram of every window of grams
repeats at distance q. At the scale w (a power of two) grams and windows are w long; a window and its
grams are 2w - 1 words, so every run of 2w <= q < 4w shows two equal minimizers q apart. Pairs of equal
minimizers at such distances seed an extension to both sides. Periods below LAGS are found by
comparing the words with themselves at each lag.

Grams are compared by names, not by hashes: a name of 2w words is the pair of the names of its halves,
so equality is exact, and places whose gram is unique need no name and seed nothing. The names of all
scales also measure how far two places agree, by steps of halving length. Where a short period fills a
long stretch, equal minimizers form a progression; two such progressions share one seed for each
distance, so the work stays near n log n on any text. All of a batch of texts is one array; words of
different texts have different codes and never match.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .copies import slices

LAGS = 16  # periods from here on are found by minimizers
LEAST = 12  # words of the shortest run
WORDS = 1 << 18  # words that are worked on at once, if one text has no more


class Runs(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    period: np.ndarray


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def lag_stretches(codes: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """start, end of the stretches that keep a period and are long enough to be runs."""
    same = np.flatnonzero(codes[:-lag] == codes[lag:])
    if not len(same):
        return same, same
    cut = np.flatnonzero(np.diff(same) > 1)
    first, last = same[np.concatenate([[0], cut + 1])], same[np.concatenate([cut, [len(same) - 1]])]
    long = last - first + 1 + lag >= max(LEAST, 2 * lag)
    return first[long], last[long] + 1 + lag


def doubled(name: np.ndarray, width: int) -> np.ndarray | None:
    """Names of grams of twice the width; -1 where a gram is unique. None if all are."""
    at = np.flatnonzero(name[:-width] >= 0)
    at = at[name[at + width] >= 0]
    if not len(at):
        return None
    _, pair, times = np.unique(name[at].astype(np.int64) * (int(name.max()) + 1) + name[at + width], return_inverse=True, return_counts=True)
    kept = times[pair] > 1
    if not kept.any():
        return None
    out = np.full(len(name), -1, np.int32)
    out[at[kept]] = pair[kept]
    return out


def minimizers(name: np.ndarray, width: int) -> np.ndarray:
    """Places of the least gram (the first of equal ones) of every window of `width` places that all have names."""
    n = len(name) - width + 1
    named = np.concatenate([[0], np.cumsum(name >= 0)])
    if n < 1 or not (whole := named[width:] - named[:-width] == width).any():
        return np.zeros(0, np.int64)
    # hash above place: the least value names the first least gram
    value = (_mixed(name) >> np.uint64(32) << np.uint64(32)) | np.arange(len(name), dtype=np.uint64)
    blocks = -(-len(name) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(name)] = value
    padded = padded.reshape(blocks, width)
    head = np.minimum.accumulate(padded, axis=1).ravel()  # least from the block's begin
    tail = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()  # least to the block's end
    least = np.minimum(tail[:n], head[width - 1 : width - 1 + n])
    return np.unique((least[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64))


def seeds(name: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags of equal minimizers 2 * width to 4 * width apart, one place for each lag of two progressions."""
    at = minimizers(name, width)
    low, high = 2 * width, 4 * width
    if len(at) < 2:
        return at[:0], at[:0]
    order = np.lexsort((at, name[at]))
    at = at[order]
    of = name[at]
    gap = np.where(of[1:] == of[:-1], np.diff(at), 0)
    step = np.where(gap * 2 <= width, gap, 0)
    # a progression goes on while the same short step repeats; its first step may follow any place
    goes = np.zeros(len(at), bool)  # whether a place belongs to the progression of the one before
    goes[1:] = step > 0
    if goes.any():
        change = np.zeros(len(at), bool)
        change[2:] = goes[1:-1] & goes[2:] & (step[1:] != step[:-1])
        goes &= ~change
    first = np.flatnonzero(~goes)
    size = np.diff(np.concatenate([first, [len(at)]]))
    begin, last = at[first], at[first + size - 1]
    stride = np.where(size > 1, at[np.minimum(first + 1, len(at) - 1)] - begin, 1)
    label = of[first]
    found_at, found_lag = [], []
    shift = 1
    open_ = np.arange(len(first))
    while True:  # pair every progression with the next ones of its name that come near enough
        open_ = open_[open_ + shift < len(first)]
        other = open_ + shift
        near = (label[open_] == label[other]) & (begin[other] - last[open_] < high)
        open_, other = open_[near], other[near]
        if not len(open_):
            break
        alone = (size[open_] == 1) & (size[other] == 1)
        a, b = begin[open_[alone]], begin[other[alone]]
        ok = b - a >= low
        found_at.append(a[ok])
        found_lag.append((b - a)[ok])
        for i, j in zip(open_[~alone], other[~alone]):
            xs, ys = begin[i] + stride[i] * np.arange(size[i]), begin[j] + stride[j] * np.arange(size[j])
            if size[i] == 1 or size[j] == 1 or stride[i] == stride[j]:
                # the lags of all pairs come up between the last of one and all of the other, and the reverse
                pair_a = np.concatenate([np.full(len(ys), xs[-1]), xs])
                pair_b = np.concatenate([ys, np.full(len(xs), ys[0])])
            else:
                pair_a, pair_b = np.repeat(xs, len(ys)), np.tile(ys, len(xs))
            ok = (pair_b - pair_a >= low) & (pair_b - pair_a < high)
            found_at.append(pair_a[ok])
            found_lag.append((pair_b - pair_a)[ok])
        shift += 1
    if not found_at:
        return at[:0], at[:0]
    return np.concatenate(found_at), np.concatenate(found_lag)


def extended(names: list[np.ndarray], at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start, end of the stretches around places that keep the period lag; names[k] are those of grams of 2 ** k words."""
    n = len(names[0])
    right, left = at.copy(), at.copy()
    for k in range(len(names) - 1, -1, -1):
        name, width = names[k], 1 << k
        for side in (1, -1):
            going = np.arange(len(at))
            while len(going):  # at the longest grams as often as they match, below once
                x = right[going] if side > 0 else left[going] - width
                y = x + lag[going]
                ok = (x >= 0) & (y + width <= n)
                going, x, y = going[ok], x[ok], y[ok]
                same = (name[x] >= 0) & (name[x] == name[y])
                going = going[same]
                if side > 0:
                    right[going] += width
                else:
                    left[going] -= width
                if k < len(names) - 1:
                    break
    return left, right + lag


def runs(codes: np.ndarray) -> Runs:
    """All runs: stretches with smallest period q, of max(LEAST, 2 q) words or more, that go no further.

    codes: non-negative numbers below 2 ** 31 that stand for words. Ordered by start, then period.
    """
    found = [(*(s := lag_stretches(codes, q)), np.full(len(s[0]), q)) for q in range(1, min(LAGS, len(codes)))]
    names, width = [codes.astype(np.int32)], 1
    while 2 * width <= len(codes):
        more = doubled(names[-1], width)
        if more is None:
            break
        names.append(more)
        width *= 2
    for k in range(LAGS.bit_length() - 2, len(names)):
        at, lag = seeds(names[k], 1 << k)
        if len(at):
            start, end = extended(names, at, lag)
            ok = end - start >= 2 * lag
            found.append((start[ok], end[ok], lag[ok]))
    start, end, period = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    # a stretch with a period that is not its smallest is also found with the smallest one
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    own = np.ones(len(start), bool)
    own[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    order = np.lexsort((period[own], start[own]))
    return Runs(start[own][order], end[own][order], period[own][order])


def planted(words: list, doc_id: int | None) -> list:
    """The words with the repetition that a tenth of the ids (by CRC-32) carry; others, and rows without an id, as they are."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * (-(-(n - a) // p)))[: n - a]


def _texts(batches: Iterator[pa.RecordBatch], plant: bool) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and words of texts, as many at once as have WORDS words together."""
    ids, texts, n = [], [], 0
    for batch in slices(batches, 256):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = (text or "").encode().split()
            ids.append(doc_id)
            texts.append(planted(words, doc_id) if plant else words)
            n += len(words)
            if n >= WORDS:
                yield ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def found_runs(texts: list[list[bytes]]) -> tuple[Runs, np.ndarray, np.ndarray]:
    """Runs of all texts in one row of words, where each text begins there, and where each text's runs begin."""
    codes, begins = [], np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    for words, base in zip(texts, begins.tolist()):
        last = dict(zip(words, range(base, base + len(words))))  # a code is the last place of the word
        codes.append(np.fromiter(map(last.__getitem__, words), np.int64, len(words)))
    every = runs(np.concatenate(codes) if codes else np.zeros(0, np.int64))
    return every, begins, np.searchsorted(every.start, begins)


def _report(plant: bool):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batches, plant):
            every, begins, firsts = found_runs(texts)
            edge = np.zeros(int(begins[-1]) + 1, np.int64)
            np.add.at(edge, every.start + every.period, 1)
            np.add.at(edge, every.end, -1)
            dropped = np.cumsum(edge) > 0
            rows = []
            for i, (doc_id, words) in enumerate(zip(ids, texts)):
                base, mine = int(begins[i]), slice(firsts[i], firsts[i + 1])
                start, period = every.start[mine] - base, every.period[mine]
                length = every.end[mine] - every.start[mine]
                top = [None] * 4
                if len(start):
                    k = int(np.lexsort((period, start, -length))[0])
                    top = [int(start[k]), int(length[k]), int(period[k]), int(1000 * length[k] // period[k])]
                    gone = dropped[base : base + len(words)].tolist()
                    words = [w for w, x in zip(words, gone) if not x]
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in zip(start.tolist(), length.tolist(), period.tolist()))
                rows.append((doc_id, len(start), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return run


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in _texts(batches, False):
        every, begins, firsts = found_runs(texts)
        text = np.repeat(np.arange(len(texts)), np.diff(firsts))
        columns = [pa.array([ids[i] for i in text.tolist()], pa.int64()), *(pa.array(x, pa.int64()) for x in (every.start - begins[text], every.end - every.start, every.period))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "period"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period: one row for each run of each row of docs; word numbers from 0.

    Null or empty texts have no words and give no rows, rows without an id give theirs under null,
    repeated rows theirs each, an empty table none. Texts are whole however long; other columns are ignored.
    """
    return _rows(docs).mapInArrow(_list, "doc_id long, start long, length long, period long")


def run_report(docs: DataFrame, plant: bool = False) -> DataFrame:
    """One row for each row of docs: number of runs, the longest one, and hashes of all runs and of the collapsed text.

    doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256. The longest run is
    that of least start, then period, of equal ones; nulls without one. The collapsed text leaves out the
    words of every run after its first period. plant: repetitions are planted first (see planted). Nulls and
    odd rows as in periodic_runs, but rows without runs are reported too. No shuffle; a text is one task's work.
    """
    kind = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _rows(docs).mapInArrow(_report(plant), kind)
