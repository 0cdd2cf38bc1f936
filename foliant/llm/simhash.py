"""SimHash near-duplicates, compared bit plane by bit plane.

Equal fingerprints are one row from the start, whatever number of copies they stand for. Candidates
come by pigeonhole: of BLOCKS blocks of the 64 bits, fingerprints within the radius agree on at least
BLOCKS - radius. Within a bucket, 64 fingerprints are compared per machine word: bit planes lie
vertically, carry-save counters add up 64 distances at once, and a block is abandoned when all its
distances exceed the radius. A bucket of more than FULL fingerprints is never compared whole: its
members, which agree on the bucket's bits, are dealt again by radius + 1 blocks of their other bits, of
which they share one at least. Each level fixes more bits of different fingerprints, so this ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import own_prefix, saved

BLOCKS = 6
FULL = 1024
PAIRS_AT_ONCE = 1 << 21


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """The 64 bits of one text as a signed integer; see simhash()."""
    words = text.encode().lower().split()  # both touch ASCII only
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[part : part + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([fingerprint(t.as_py() or "") for t in batch.column(1)], pa.int64())], names=["doc_id", "fp"]
        )


def simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fp: the SimHash of each whole text over 4-word shingles, A-Z lower-cased.

    Fewer words than four: one shingle of all. No words, or a null text: 0.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _parts(positions: list[int], n: int) -> list[int]:
    """Masks of n blocks that share out the bit positions."""
    cuts = [len(positions) * i // n for i in range(n + 1)]
    return [sum(1 << p for p in positions[a:b]) for a, b in zip(cuts, cuts[1:])]


def first_masks(radius: int, blocks: int = BLOCKS) -> list[int]:
    return [sum(c) for c in combinations(_parts(list(range(64)), blocks), blocks - radius)]


def finer_masks(mask: int, radius: int) -> list[int]:
    rest = [p for p in range(64) if not mask >> p & 1]
    return [mask | m for m in _parts(rest, radius + 1) if m]


def near(planes: np.ndarray, fps: np.ndarray, q: np.ndarray, w: np.ndarray, alive: np.ndarray, radius: int):
    """Lanes of word w within the radius of fingerprint q, for arrays of such pairs: (q, w, lanes).

    planes[p, w] has bit p of 64 fingerprints; alive says which lanes of each pair count.
    """
    ones = np.zeros(len(q), np.uint64)
    twos, fours, over = ones.copy(), ones.copy(), ones.copy()
    for p in range(64):
        diff = planes[p, w] ^ (np.uint64(0) - (fps[q] >> np.uint64(p) & np.uint64(1)))
        carry, ones = ones & diff, ones ^ diff
        carry, twos = twos & carry, twos ^ carry
        carry, fours = fours & carry, fours ^ carry
        over |= carry
        if p % 8 == 7:
            # lanes that count radius + 1 or more, up to 7, and those that ran over
            gone = over.copy()
            for c in range(radius + 1, 8):
                gone |= (ones if c & 1 else ~ones) & (twos if c & 2 else ~twos) & (fours if c & 4 else ~fours)
            over = gone
            alive = alive & ~gone
            if not (held := alive != 0).all():
                q, w, alive, ones, twos, fours, over = (x[held] for x in (q, w, alive, ones, twos, fours, over))
    return q, w, alive


def linked(fps: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) positions of fingerprints that links within their run join; run: run number, sorted."""
    n = len(fps)
    root = np.arange(n)
    words = -(-n // 64)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((words * 64, 64), np.uint8)
    padded[:n] = bits
    planes = np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view(np.uint64).reshape(64, words)
    end = np.searchsorted(run, run, side="right")
    first, last = (np.arange(n) + 1) // 64, (end - 1) // 64
    many = np.where(end > np.arange(n) + 1, last - first + 1, 0)
    q = np.repeat(np.arange(n), many)
    w = np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many) + first[q]
    full = ~np.uint64(0)
    low = np.clip(q + 1 - w * 64, 0, 63).astype(np.uint64)
    high = np.clip(end[q] - w * 64, 0, 64)
    alive = (full << low) & np.where(high == 64, full, (np.uint64(1) << np.minimum(high, 63).astype(np.uint64)) - np.uint64(1))
    q, w, alive = near(planes, fps, q, w, alive, radius)
    if not len(q):
        return root[:0], root[:0]
    hit, lane = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    a, b = q[hit], w[hit] * 64 + lane
    while True:
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root[a] == root[b]).all():
            break
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def _link(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; whole buckets are compared together, as many as stay small."""

        def out(fps, number):
            size = np.bincount(number - number[0]) if len(number) else np.zeros(0, np.int64)
            cost = np.cumsum(size.astype(np.int64) ** 2)
            piece = (cost // PAIRS_AT_ONCE)[number - number[0]] if len(number) else number
            for part in np.split(np.arange(len(fps)), np.flatnonzero(np.diff(piece)) + 1):
                a, b = linked(fps[part], number[part], radius)
                if len(a):
                    got = fps[part].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(got[a]), pa.array(got[b])], names=["a", "b"])

        held = None
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)])
            held = rows if held is None else np.concatenate([held, rows], axis=1)
            if held.shape[1] == 0:
                continue
            change = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)) + 1
            if not len(change):
                continue
            cut = change[-1]
            number = np.searchsorted(change, np.arange(cut), side="right")
            yield from out(np.ascontiguousarray(held[2, :cut]).view(np.uint64), number)
            held = held[:, cut:]
        if held is not None and held.shape[1]:
            change = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)) + 1
            number = np.searchsorted(change, np.arange(held.shape[1]), side="right")
            yield from out(np.ascontiguousarray(held[2]).view(np.uint64), number)

    return run


def fingerprint_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """a, b: links enough to connect all fingerprints (distinct rows of fp) within the radius of each other."""
    spark = fps.sparkSession
    masks = [_signed(m) for m in first_masks(radius)]
    rows = fps.select(F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"), "fp")
    found = []
    while True:
        rows = saved(rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))), "simhash-buckets")
        counts = rows.groupBy("mask", "value").count().filter("count > 1")
        full = saved(counts.filter(F.col("count") > FULL), "simhash-full")
        fits = rows.join(full, ["mask", "value"], "left_anti") if masks and not full.isEmpty() else rows
        sorted_rows = fits.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
        found.append(saved(sorted_rows.mapInArrow(_link(radius), "a long, b long").distinct(), "simhash-links"))
        if full.isEmpty():
            break
        finer = [(m, _signed(f)) for m in masks for f in finer_masks(m & (1 << 64) - 1, radius)]
        finer_rows = spark.createDataFrame(finer, "mask long, finer long")
        rows = rows.join(full.select("mask", "value"), ["mask", "value"]).join(finer_rows, "mask").select(F.col("finer").alias("mask"), "fp")
        masks = [f for _, f in finer]
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links within the radius can reach, itself included.

    One row per row of docs. Null ids stand for nothing: such a row takes its group's smallest id, or
    null if there is none. Texts without words share fingerprint 0. A bit set in exactly half the hashes is 0.
    Texts are whole however long; repeated rows share a row's result; other columns are ignored. Empty table: no rows.
    """
    prints = saved(simhash(docs), "simhash")
    groups = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-groups")
    roots = saved(components(fingerprint_links(groups.select("fp"), radius)), "simhash-roots")
    joined = groups.join(roots, groups["fp"] == roots["node"])
    named = saved(joined.groupBy("root").agg(F.min("least").alias("least")), "simhash-named")
    moved = saved(joined.select("fp", "root").join(named, "root").select(F.col("fp").alias("to_fp"), F.col("least").alias("joint")), "simhash-moved")
    ids = groups.join(moved, groups["fp"] == moved["to_fp"], "left").select(
        F.col("fp").alias("of_fp"), F.when(F.col("to_fp").isNull(), F.col("least")).otherwise(F.col("joint")).alias("component_id")
    )
    ids = saved(ids, "simhash-ids")
    return prints.join(ids, prints["fp"] == ids["of_fp"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 4) -> DataFrame:
    """One document of each group, that of its smallest id, with all its columns.

    Rows that repeat that id are one document: one of them stays. Rows without an id cannot be named and
    are all kept. Very long texts are hashed whole and moved once; an empty table gives no rows.
    """
    own = own_prefix(docs, "__kept_") + "id"
    chosen = near_duplicates(docs, radius).filter("doc_id = component_id").groupBy(F.col("doc_id").alias(own)).count()
    chosen = saved(chosen, "simhash-kept")
    # the same plan at every size: texts move once, beside the chosen ids
    kept = docs.join(chosen.select(own).hint("merge"), docs["doc_id"] == F.col(own), "left_semi")
    if not chosen.filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.union(docs.filter("doc_id is null"))
