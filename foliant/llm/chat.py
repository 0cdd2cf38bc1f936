"""Chat formatting by a grammar round trip.

A turn is `### role:`, a line break, its text, a line break, `</turn>` and a line break. What a reader of
that grammar recovers from a rendered turn is compared with the source, and content that reads
otherwise is escaped one level further until it is identical: first the text as it is, then with a
backslash before every control string (and before the backslashes that stand before one), last with
the role in escapes too. The reader takes one backslash off again, so all texts come back.

A turn reads the same whatever stands around it, since it begins and ends with control strings that no
rendered text contains. So turns are rendered row by row without a shuffle, and conversations are read
back as streams of turns: however long one is, only one of its turns is in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .copies import slices

OPEN, CLOSE = "### ", "</turn>"
LEARNED = "assistant"  # the role whose texts are under the loss mask
_CONTROL = re.compile(rf"(\\*)({re.escape(OPEN)}|{re.escape(CLOSE)})")
_HEADER = re.compile(rf"{re.escape(OPEN)}([^\n]*?):\n")
_STUFFED = re.compile(rf"\\(\\*)({re.escape(OPEN)}|{re.escape(CLOSE)})")
_HEX = re.compile(r"\\x\{([0-9a-f]+)\}")


class Turn(NamedTuple):
    role: str
    text: str
    start: int  # of the text as rendered
    end: int
    after: int  # where the next turn begins


def read_turn(s: str, at: int = 0) -> Turn | None:
    """The turn that begins at a place of a rendered text; None if none does."""
    head = _HEADER.match(s, at)
    if not head:
        return None
    for c in _CONTROL.finditer(s, head.end()):
        if c[1]:
            continue  # escaped
        end = c.start() - 1
        if c[2] == CLOSE and end >= head.end() and s[end] == "\n" and s.startswith("\n", c.end()):
            role = _HEX.sub(lambda m: chr(int(m[1], 16)), head[1])
            return Turn(role, _STUFFED.sub(r"\1\2", s[head.end() : end]), head.end(), end, c.end() + 1)
        return None
    return None


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as rendered and the span of its text there, by the least escaping that reads back identically."""
    for level in range(3):
        name = "".join(f"\\x{{{ord(c):x}}}" for c in role) if level > 1 else role
        body = _CONTROL.sub(r"\\\g<0>", text) if level else text
        made = f"{OPEN}{name}:\n{body}\n{CLOSE}\n"
        read = read_turn(made)
        if read and (read.role, read.text, read.after) == (role, text, len(made)):
            return made, read.start, read.end
    raise ValueError("a turn does not read back")  # no text or role is known to come here


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 512):
        rows = [render_turn(r or "", t or "") for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        learned = [r == LEARNED for r in batch.column(2).to_pylist()]
        cells = [[x[0] for x in rows], *([x[i] if k else None for x, k in zip(rows, learned)] for i in (1, 2))]
        kinds = [pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, cells, kinds)], names=["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end"])


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, formatted, loss_start, loss_end: every row as it is rendered.

    A conversation's rendered text is its rows' formatted in order of turn (ties: role, then text), with
    nothing between; loss_start and loss_end (end exclusive) span the text inside formatted and are null
    for other roles than the assistant. Null text or role: empty. A null conv_id is one conversation of
    its own. Repeated rows are repeated turns. Texts of any length are whole. An empty table gives no
    rows; other columns are left out.
    """
    kind = "conv_id long, turn long, role string, text string"
    rows = conversations.select(*(F.col(c).cast(k).alias(c) for c, k in (x.split() for x in kind.split(", "))))
    return rows.mapInArrow(_render, f"{kind}, formatted string, loss_start long, loss_end long")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, n, loss, chars, turns, learned, left = None, 0, 0, 0, hashlib.sha256(), hashlib.sha256(), ""
    for batch in slices(batches, 512):
        done = []
        for conv, role, text, made, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6))):
            if now != (conv,):
                if now:
                    done.append((now[0], n, turns.hexdigest(), loss, learned.hexdigest(), chars))
                now, n, loss, chars, turns, learned = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            before = len(left)
            left += made
            while left and (read := read_turn(left)):
                if (read.role, read.text) != (role or "", text or ""):
                    raise ValueError(f"conversation {conv} does not read back")
                n, chars = n + 1, chars + read.after
                turns.update(f"{read.role}\n{read.text}\n".encode())
                if start is not None:
                    masked = _STUFFED.sub(r"\1\2", left[before + start : before + end])
                    loss += len(masked)
                    learned.update(masked.encode())
                left, before = left[read.after :], 0
            if left:
                raise ValueError(f"conversation {conv} does not read back")
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)
    if now:
        row = (now[0], n, turns.hexdigest(), loss, learned.hexdigest(), chars)
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from what format_turns gives.

    The rendered turns of a conversation are read as one stream by the grammar alone and compared with
    the source; a difference is an error. loss_* are of what stands under the mask, unescaped. A hash over
    a conversation is a sequence by nature, so a conversation is one task's work, in bounded memory.
    """
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_texts(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: whole conversations with the spans of their loss masks, for conversations that fit a row."""
    at = F.struct("turn", "role", "text", "formatted", "loss_start", "loss_end")
    rows = formatted.groupBy("conv_id").agg(F.array_sort(F.collect_list(at)).alias("x"))
    lengths = F.transform("x", lambda t: F.length(t["formatted"]).cast("long"))
    starts = F.aggregate(
        lengths, F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("out")),
        lambda a, n: F.struct((a["n"] + n).alias("n"), F.concat(a["out"], F.array(a["n"])).alias("out")), lambda a: a["out"])
    spans = F.zip_with("x", starts, lambda t, s: F.when(t["loss_start"].isNotNull(), F.struct((s + t["loss_start"]).alias("start"), (s + t["loss_end"]).alias("end"))))
    return rows.select("conv_id", F.array_join(F.transform("x", lambda t: t["formatted"]), "").alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss"))
