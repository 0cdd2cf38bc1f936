"""Byte-level BPE as a monoid: halves are encoded on their own and joined at their boundary.

Two levels use the same reduction. A text is halved down to leaves that the pre-token pattern splits;
joining scans again from the last pre-token of the left half that the right half cannot change, until
a cut falls on a cut of the right half (the pattern looks only forward, so all later cuts agree). A
pre-token is halved down to single tokens; joining encodes a growing window of bytes over the boundary
until the pairs at both its edges are ones that BPE leaves alone (a row of tokens is the encoding of its
bytes exactly if each adjacent pair is). Both rules prove that the outside stays as it is.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LEAF = 1 << 15
CACHED = 200_000  # results in one generation of a cache; there are two, of about 30 MB each
ROWS = 256  # texts that are held as Python objects at once


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Memo(dict):
    """Results of a function by argument, long arguments left out. What a full generation used is kept for one more."""

    def __init__(self, make, longest: int):
        super().__init__()
        self.make, self.longest, self.old = make, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= CACHED:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encoder and decoder over a table of ranks; caches are bounded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # \s of this pattern means Unicode white space; Python would add U+001C to U+001F
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.pieces = Memo(lambda piece: array("i", self.piece(piece.encode())).tobytes(), 64)
        self.halves = Memo(self.piece, 8)
        self.windows = Memo(self.merged, 16)
        self.pairs = Memo(lambda ab: self.windows[self.tokens[ab[0]] + self.tokens[ab[1]]] == ab, 2)

    # bytes of one pre-token

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Plain BPE of a window: merge the adjacent pair of lowest rank, leftmost first."""
        return self.merged_long(data) if len(data) > 48 else self.merged_short(data)

    def merged_short(self, data: bytes) -> tuple[int, ...]:
        get, never = self.ranks.get, len(self.tokens)
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [get(a + b, never) for a, b in zip(parts, parts[1:])]
            if (low := min(found)) == never:
                break
            i = found.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return tuple(map(self.ranks.__getitem__, parts))

    def merged_long(self, data: bytes) -> tuple[int, ...]:
        ranks, n = self.ranks, len(data)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def stable(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a and b as they are when they meet."""
        return self.pairs[a, b]

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.windows[b"".join([self.tokens[t] for t in left[-i:] + right[:j]])]
            held_left = i >= len(left) or self.stable(left[-i - 1], window[0])
            held_right = j >= len(right) or self.stable(window[-1], right[j])
            if held_left and held_right:
                return left[: max(0, len(left) - i)] + window + right[j:]
            i, j = i if held_left else 2 * i, j if held_right else 2 * j

    def piece(self, data: bytes) -> tuple[int, ...]:
        if (rank := self.ranks.get(data)) is not None:
            return (rank,)
        half = 1 << ((len(data) - 1).bit_length() - 1)
        return self.join(self.halves[data[:half]], self.halves[data[half:]])

    # pre-tokens of a text

    def meet(self, left: list[str], right: list[str]) -> list[str]:
        """Pre-tokens of two adjacent texts: those at the boundary are split again."""
        if not left or not right:
            return left + right
        n = last = sum(map(len, left))
        kept = len(left)
        while kept and max(last + 1, last - len(left[kept - 1]) + 3) > n:  # a match looks at most that far
            kept -= 1
            last -= len(left[kept])
        tail, j = "".join(left[kept:]), 4
        while True:
            window = tail + "".join(right[:j])
            again, cuts, at = self.split(window), {}, len(tail)
            if j >= len(right):
                return left[:kept] + again
            for k, piece in enumerate(right[:j]):
                cuts[at] = k
                at += len(piece)
            at = 0
            for k, piece in enumerate(again):
                if at in cuts:
                    return left[:kept] + again[:k] + right[cuts[at] :]
                if max(at + len(piece) + 1, at + 3) > len(window):
                    break
                at += len(piece)
            j *= 2

    def pretokens(self, text: str) -> list[str]:
        if len(text) <= LEAF:
            return self.split(text)
        half = len(text) // 2
        return self.meet(self.pretokens(text[:half]), self.pretokens(text[half:]))

    def encoded(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers in a row."""
        return b"".join(map(self.pieces.__getitem__, self.pretokens(text)))

    def encode(self, text: str) -> list[int]:
        return array("i", self.encoded(text)).tolist()

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per worker process; the rank file is read where the executors have it installed."""
    return Codec(load_ranks(path), pattern)


def _encoded(c: Codec, texts: pa.Array) -> pa.Array:
    parts = [c.encoded(t.as_py() or "") for t in texts]
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _decoded(c: Codec, lists: pa.Array) -> pa.Array:
    starts, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    return pa.array([c.decode(values[a:b].tolist() if v else []) for a, b, v in zip(starts[:-1], starts[1:], lists.is_valid().to_pylist())], pa.binary())


IDS, BYTES = T.ArrayType(T.IntegerType()), T.BinaryType()
KINDS = {"ids": (IDS, pa.list_(pa.int32()), _encoded), "bytes": (BYTES, pa.binary(), _decoded)}


def _with(df: DataFrame, path: str, pattern: str, steps: list[tuple[str, str, str]]) -> DataFrame:
    """df with more columns, each made in one pass of Arrow batches: (from column, kind, new column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, len(whole), ROWS)):
            columns = dict(zip(batch.schema.names, batch.columns))
            for of, kind, new in steps:
                made = KINDS[kind][2](c, columns[of])
                columns.pop(new, None)
                columns[new] = made
            fields = {f.name: f for f in batch.schema} | {new: pa.field(new, KINDS[kind][1]) for _, kind, new in steps}
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=pa.schema([fields[n] for n in columns]))

    new_names = {new for *_, new in steps}
    kept = [f for f in df.schema.fields if f.name not in new_names]
    return df.mapInArrow(run, T.StructType([*kept, *(T.StructField(new, KINDS[kind][0]) for _, kind, new in steps)]))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """df with the ids of each whole text, without special tokens, as the public tokenizer would give them.

    With `decoded`, the bytes that the ids stand for are one more column, made in the same pass.
    Null and empty texts: an empty list. Every row stands on its own: ties, repeats and other columns
    pass through; an existing column named like a new one is replaced. Very long texts are halved down to
    leaves, so nothing but their result grows with them. Empty table: no rows.
    """
    return _with(df, path, pattern, [(text, "ids", ids), *([(ids, "bytes", decoded)] if decoded else [])])


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that each list of ids stands for; a null list gives no bytes."""
    return _with(df, path, pattern, [(ids, "bytes", out)])
