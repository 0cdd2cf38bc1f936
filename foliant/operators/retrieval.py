"""A lexical index over passages, batched BM25 search and exact-quote verification."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.tokens import grams
from ..stages import exists, renamed, saved

LENGTH, STRIDE = 1200, 1000
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
TERMS, CANDIDATES = 100, 200
SEEDS = 2 * CANDIDATES
PAGE_BITS = 10
PAGE = 1 << PAGE_BITS
TOGETHER = 256  # queries that a task scores at once


def passages(chunks: DataFrame) -> DataFrame:
    """Passages of chunk contents: one every STRIDE characters, LENGTH long; the tail passage is kept.

    chunks: book_id, chapter_id, chunk_id, ordinal, content, is_edited.
    """
    rows = chunks.filter(F.length("content") > 0).withColumn("offset", F.explode(F.sequence(F.lit(0), F.length("content") - 1, F.lit(STRIDE))))
    content = F.substring("content", F.col("offset") + 1, F.lit(LENGTH))
    pid = F.concat(F.lit("passage_"), F.substring(F.sha2(F.concat_ws(":", "chunk_id", F.col("offset").cast("string"), content), 256), 1, 24))
    origin = F.when(F.col("is_edited"), "user_edit").otherwise("original")
    return rows.select("book_id", "chapter_id", "chunk_id", F.col("ordinal").alias("chunk_ordinal"), "offset", pid.alias("passage_id"), origin.alias("origin"), content.alias("content"))


class Index(NamedTuple):
    """A stored index. Passages have numbers in order of their ids; PAGE numbers in a row are a page, and a posting block lies within one.

    passages: no, shelf (no without its last 33 bits), book_id, chapter_id, passage_id, doc_len, content, terms
    blocks: space, term, page, shortest (least doc_len), offsets and lengths of the passages with the term
    terms: space, term, df, shortest; totals: space, n_docs, avg_len
    """

    passages: DataFrame
    blocks: DataFrame
    terms: DataFrame
    totals: DataFrame
    scope: str | None


def stored_index(chunks: DataFrame, root: str, scope: str | None = "book_id") -> Index:
    """The index of the passages of chunks below root; written only if no index of equal chunks is there.

    scope: the column within which terms are counted and searched; None: one space for all. The
    fingerprint is a count and a sum of hashes of all chunks, so it needs no order and no shuffle of texts.
    An index is written under another name and renamed when it is whole, so readers never see a part of
    one, and of two writers one wins. A term's postings lie in blocks of a page each, made where the passages of the
    page lie: nothing is shuffled for them, and no task ever holds a whole common term. Passages are dealt by the first digits of their ids, which are
    hashes: evenly, and however few files the chunks come from.
    """
    spark = chunks.sparkSession
    mark = F.xxhash64("book_id", "chapter_id", "chunk_id", "ordinal", "content", "is_edited").cast("decimal(38,0)")
    n, total = chunks.agg(F.count("*"), F.sum(mark)).first()
    path = f"{root}/index-{scope or 'all'}-{n}-{total or 0}-by-id"
    if not exists(spark, path):
        draft = f"{root}/draft-{uuid.uuid4().hex}"
        _write_index(passages(chunks), draft, scope)
        renamed(spark, draft, path)
    return Index(*(spark.read.schema(kind).parquet(f"{path}/{name}") for name, kind in TABLES.items()), scope)


TABLES = {
    "passages": "no long, book_id string, chapter_id string, passage_id string, doc_len int, content string, terms array<string>, shelf long",
    "blocks": "space string, term string, page long, shortest int, offsets array<int>, lengths array<int>",
    "terms": "space string, term string, df long, shortest int",
    "totals": "space string, n_docs long, avg_len double",
}


def _write_index(rows: DataFrame, path: str, scope: str | None) -> None:
    read = lambda name: rows.sparkSession.read.schema(TABLES[name]).parquet(f"{path}/{name}")
    terms = grams(F.col("content"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = F.conv(F.substring("passage_id", len("passage_") + 1, 7), 16, 10).cast("long")
    rows = rows.repartitionById(tasks, F.shiftright(digits * tasks, 28).cast("int")).sortWithinPartitions("passage_id")
    numbered = rows.select(F.monotonically_increasing_id().alias("no"), "book_id", "chapter_id", "passage_id", F.size(terms).alias("doc_len"), "content", terms.alias("terms"))
    numbered.withColumn("shelf", F.shiftright("no", 33)).write.partitionBy("shelf").parquet(f"{path}/passages")
    space = F.col(scope) if scope else F.lit("")
    posted = read("passages").select("no", space.alias("space"), "doc_len", "terms")
    posted.mapInArrow(_blocks(PAGE_BITS), TABLES["blocks"]).write.parquet(f"{path}/blocks")
    counted = read("blocks").groupBy("space", "term").agg(F.sum(F.size("offsets")).alias("df"), F.min("shortest").alias("shortest"))
    counted.write.parquet(f"{path}/terms")
    totals = read("passages").groupBy(space.alias("space")).agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))
    totals.write.parquet(f"{path}/totals")


def _blocks(page_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Posting blocks of passages (no, space, doc_len, terms) in order of no; a page that two batches share has blocks from both."""
        for batch in batches:
            page = batch.column(0).to_numpy() >> page_bits
            for rows in (batch.slice(a, b - a) for a, b in pairwise([0, *(np.flatnonzero(np.diff(page)) + 1).tolist(), len(batch)])):
                terms = rows.column(3).flatten().dictionary_encode()
                if not len(terms):
                    continue
                which = np.repeat(np.arange(len(rows)), pc.list_value_length(rows.column(3)).to_numpy(zero_copy_only=False))
                spaces = rows.column(1).dictionary_encode()
                code = spaces.indices.to_numpy()[which].astype(np.int64) * len(terms.dictionary) + terms.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                first = np.concatenate([[0], np.flatnonzero(np.diff(code[order])) + 1])
                space, term = np.divmod(code[order[first]], len(terms.dictionary))
                ends = pa.array(np.append(first, len(order)).astype(np.int32))
                offsets = (rows.column(0).to_numpy()[which[order]] & ((1 << page_bits) - 1)).astype(np.int32)
                lengths = rows.column(2).to_numpy()[which[order]]
                yield pa.RecordBatch.from_arrays(
                    [
                        spaces.dictionary.take(pa.array(space)), terms.dictionary.take(pa.array(term)), pa.array(np.repeat(rows.column(0)[0].as_py() >> page_bits, len(first))),
                        pa.array(np.minimum.reduceat(lengths, first)), pa.ListArray.from_arrays(ends, pa.array(offsets)), pa.ListArray.from_arrays(ends, pa.array(lengths)),
                    ],
                    names=["space", "term", "page", "shortest", "offsets", "lengths"],
                )

    return run


def index_stats(index: Index) -> tuple[DataFrame, DataFrame]:
    """(space, term, df; space, n_docs, avg_len)."""
    return index.terms.select("space", "term", "df"), index.totals


def chapter_bitmaps(index: Index, sets: DataFrame) -> DataFrame:
    """chapter_set, page, words of rows (chapter_set, chapter_id): a bit for each passage number of a page, 64 a word."""
    rows = index.passages.select("chapter_id", "no").join(sets.select("chapter_set", "chapter_id").distinct(), "chapter_id")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("no") % 64).cast("int"))
    word = F.shiftright("no", 6) % (PAGE // 64)
    words = [F.coalesce(F.bit_or(F.when(word == i, bit)), F.lit(0).cast("long")) for i in range(PAGE // 64)]
    return rows.groupBy("chapter_set", F.shiftright("no", PAGE_BITS).alias("page")).agg(F.array(*words).alias("words"))


def _part(length, avg_len):
    """What a term adds to the score of a passage of that many terms, but for its weight; of columns or of arrays."""
    return (K1 + 1) / (1 + K1 * (1 - B + B * length / avg_len))


def _weighed(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, space, chapter_set, term, idf, avg_len, seed (a term of large bound, as many as hold enough passages)."""
    space = F.col(index.scope) if index.scope else F.lit("")
    chapters = F.col("chapter_set") if "chapter_set" in queries.columns else F.lit(None)
    terms = queries.select("query_id", space.alias("space"), chapters.cast("string").alias("chapter_set"), F.explode(F.slice(grams(F.col("query")), 1, TERMS)).alias("term"))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    rows = terms.join(index.terms, ["space", "term"]).join(index.totals, "space").withColumn("idf", idf)
    rows = rows.withColumn("bound", F.col("idf") * _part(F.col("shortest"), F.col("avg_len")))
    falling = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term").rowsBetween(Window.unboundedPreceding, -1)
    seed = F.coalesce(F.sum("df").over(falling), F.lit(0)) < F.when(F.col("chapter_set").isNull(), SEEDS).otherwise(SEEDS * 10)
    return rows.select("query_id", "space", "chapter_set", "term", "idf", "avg_len", seed.alias("seed"))


def _masks(weighed: DataFrame, index: Index, chapters: DataFrame) -> DataFrame:
    """query_id, page, words: the passages of a page that the chapters of a query allow, where there are any."""
    sets = chapters.select(F.col("chapter_set").cast("string").alias("chapter_set"), "chapter_id")
    return weighed.select("query_id", "chapter_set").distinct().join(chapter_bitmaps(index, sets), "chapter_set").select("query_id", "page", "words")


def _least(weighed: DataFrame, index: Index, masks: DataFrame | None) -> DataFrame:
    """query_id, least: a lower bound of the score of the last passage wanted, from the postings of the query's weightiest terms alone."""
    blocks = index.blocks.join(weighed.filter("seed"), ["space", "term"])
    if masks is not None:
        blocks = blocks.join(masks.select(F.col("query_id").alias("of"), F.col("page").alias("at"), "words"), (F.col("query_id") == F.col("of")) & (F.col("page") == F.col("at")), "left")
    rows = blocks.withColumn("x", F.explode(F.arrays_zip("offsets", "lengths")))
    if masks is not None:
        offset = F.col("x.offsets")
        rows = rows.filter(F.col("chapter_set").isNull() | (F.getbit(F.get("words", F.shiftright(offset, 6)), offset % 64) == 1))
    scored = rows.groupBy("query_id", "page", F.col("x.offsets").alias("offset")).agg(F.sum(F.col("idf") * _part(F.col("x.lengths"), F.col("avg_len"))).alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    last = scored.withColumn("n", nth).filter(F.col("n") == CANDIDATES)
    return last.select("query_id", (F.col("score") - 1e-6).alias("least"))


def _page_scores(page_bits: int, kind: pa.DataType):
    """Functions of the blocks of a page, without and with masks: query_id, no, score of the passages that reach a query's least."""

    def run(blocks: pa.Table, masks: pa.Table | None = None) -> pa.Table:
        def lists(name: str) -> tuple[pa.Array, np.ndarray]:
            """The elements of all rows, and where each row's begin."""
            column = blocks.column(name).combine_chunks()
            return column.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)

        offsets, at = lists("offsets")
        offsets, lengths = offsets.to_numpy(), lists("lengths")[0].to_numpy()
        asked, of = lists("asked")
        ids = asked.field("query_id").dictionary_encode()
        query, idf = ids.indices.to_numpy(), asked.field("idf").to_numpy()
        scores, doc_len = np.zeros((len(ids.dictionary), 1 << page_bits)), np.ones(1 << page_bits)
        doc_len[offsets] = lengths
        for i in range(len(blocks)):
            mine = slice(of[i], of[i + 1])
            scores[query[mine, None], offsets[at[i] : at[i + 1]]] += idf[mine, None]
        least, avg_len, allowed = np.zeros((len(scores), 1)), np.ones((len(scores), 1)), np.ones(scores.shape, bool)
        least[query, 0] = asked.field("least").to_numpy()
        avg_len[query, 0] = np.repeat(blocks.column("avg_len").to_numpy(), np.diff(of))
        if masks is not None:
            allowed[query[asked.field("within").to_numpy(zero_copy_only=False)]] = False
            for one, words in zip(pc.index_in(masks.column("query_id"), ids.dictionary).to_pylist(), masks.column("words").to_pylist()):
                if one is not None:
                    allowed[one] = np.unpackbits(np.array(words, np.int64).view(np.uint8), bitorder="little")
        found = scores * _part(doc_len, avg_len)
        row, offset = np.nonzero((scores > 0) & allowed & (found >= least))
        cells = [ids.dictionary.take(pa.array(row)), pa.array((blocks.column("page")[0].as_py() << page_bits) + offset), pa.array(found[row, offset])]
        return pa.table([cells[0].cast(kind), *cells[1:]], names=["query_id", "no", "score"])

    none = pa.schema([("query_id", kind), ("no", pa.int64()), ("score", pa.float64())]).empty_table()
    return (lambda key, blocks: run(blocks)), (lambda key, blocks, masks: run(blocks, masks) if len(blocks) else none)


def candidates(queries: DataFrame, index: Index, chapters: DataFrame | None = None) -> DataFrame:
    """query_id, no, score, at: a query's CANDIDATES best passages by BM25, ties to the smaller passage_id.

    The blocks of the queries' terms are dealt by page, each with the queries of a group that ask for its term, so a block
    travels once for TOGETHER queries and never by itself for each. A task adds up the scores of a page's passages in
    an array and lets go only those that reach the lower bound of the last passage wanted.
    """
    weighed = saved(_weighed(queries, index), "search-terms")
    masks = saved(_masks(weighed, index, chapters), "search-masks") if chapters is not None else None
    least = saved(_least(weighed, index, masks), "search-least")
    n = weighed.select("query_id").distinct().count()
    part = F.pmod(F.xxhash64("query_id"), F.lit(-(-n // TOGETHER) or 1)).alias("part")
    one = F.struct("query_id", "idf", F.coalesce("least", F.lit(0.0)).alias("least"), F.col("chapter_set").isNotNull().alias("within"))
    asked = weighed.join(least, "query_id", "left").groupBy("space", "term", part).agg(F.first("avg_len").alias("avg_len"), F.collect_list(one).alias("asked"))
    blocks = index.blocks.join(saved(asked, "search-asked"), ["space", "term"]).select("page", "part", "avg_len", "offsets", "lengths", "asked").groupBy("page", "part")
    kind = weighed.schema["query_id"].dataType
    alone, masked = _page_scores(PAGE_BITS, to_arrow_type(kind))
    out = f"query_id {kind.simpleString()}, no long, score double"
    if masks is None:
        scores = blocks.applyInArrow(alone, out)
    else:
        scores = blocks.cogroup(masks.select("query_id", "page", part, "words").groupBy("page", "part")).applyInArrow(masked, out)
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "no")  # numbers are in order of passage_id
    return scores.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= CANDIDATES)


def search(queries: DataFrame, index: Index, k: int = 4, chapters: DataFrame | None = None) -> DataFrame:
    """query_id, rank, book_id, chapter_id, passage_id, score, content of the k best distinct passages of each query.

    queries: query_id, query (the index's scope column too, and chapter_set if chapters are given). At most
    TERMS distinct terms match by OR; the best CANDIDATES by BM25 (ties to the smaller passage_id) are made
    distinct by chapter and content. chapters (chapter_set, chapter_id) names sets of chapters; a query sees
    those of its chapter_set, all if it has none; frequencies stay global. Query ids are distinct.
    """
    top = saved(candidates(queries, index, chapters).withColumn("shelf", F.shiftright("no", 33)), "search-top").filter(F.col("at") <= CANDIDATES)
    top = top.join(index.passages.select("shelf", "no", "book_id", "chapter_id", "passage_id", "content"), ["shelf", "no"])
    same = Window.partitionBy("query_id", "book_id", "chapter_id", "content").orderBy("at")
    top = top.withColumn("copy", F.row_number().over(same)).filter("copy = 1")
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).filter(F.col("rank") <= k)
    return top.select("query_id", "rank", "book_id", "chapter_id", "passage_id", "score", "content")


def verify_evidence(evidence: DataFrame, rows: DataFrame) -> DataFrame:
    """evidence with valid: the passage exists, chapter, chunk and origin agree, and it holds the quote."""
    p = rows.select("book_id", "passage_id", F.col("chapter_id").alias("__ch"), F.col("chunk_id").alias("__ck"), F.col("origin").alias("__o"), F.col("content").alias("__c"))
    joined = evidence.join(p.dropDuplicates(["book_id", "passage_id"]), ["book_id", "passage_id"], "left")
    ok = (F.col("chapter_id") == F.col("__ch")) & (F.col("chunk_id") == F.col("__ck")) & (F.coalesce("origin", F.lit("original")) == F.col("__o")) & F.contains("__c", "quote")
    return joined.withColumn("valid", F.coalesce(ok, F.lit(False))).drop("__ch", "__ck", "__o", "__c")


def first_passage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("book_id").agg(F.min_by("passage_id", F.struct("chunk_ordinal", "offset", "passage_id")).alias("passage_id"))
