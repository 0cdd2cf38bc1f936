"""Queries of structure, chunk and planning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as ch
from ..operators import planning as pl
from ..operators import structure as st
from .base import CHAPTERS, CONV, DOCS, HEADINGS, LINES, PIECE, SIZE, SPACE, STRIDE, TOKEN, WINDOWS, conv_books, doc_books, preview, query, stable_id, table, tokens

PARSED = CONV + LINES + HEADINGS
EMPTY = ",\nheadings as (select null::varchar as book_id, null as title, null as kind, null::bigint as start, null::bigint as heading_end, null::bigint as content_start, null::bigint as number where false)"


def _headings(spark, d):
    return st.find_headings(st.explode_lines(conv_books(spark, d)))


def _chapters(spark, d):
    books = conv_books(spark, d)
    return books, st.chapters(books)


def _whole(books):
    """Whole-text chapters: headings found nowhere."""
    none = st.find_headings(st.explode_lines(books), patterns=(("chapter", r"(?!)"),)).limit(0)
    return st.chapters(books, none)


def _windows(spark, d):
    books = doc_books(spark, d)
    return books, ch.fixed_token_windows(_whole(books), books, SIZE, STRIDE)


@query("c1_explode_lines", f'with {DOCS}{LINES} select book_id, line_no, start, "end", md5(line) as line from lines')
def c1(spark, d):
    return st.explode_lines(doc_books(spark, d)).select("book_id", "line_no", "start", "end", F.md5(F.col("line").cast("binary")).alias("line"))


@query("c2_find_headings", f"with {PARSED} select * from headings")
def c2(spark, d):
    return _headings(spark, d)


NUMBERED = """
h0 as (select conv_id as book_id, turn as start, case when turn % 7 = 6 then 'volume' else 'chapter' end as kind,
    case when turn % 7 = 6 then null when turn % 3 = 2 then 99 else turn - turn // 3 + 1 end as number from conversations)"""


def _pass(i: int) -> str:
    return f""",
m{i} as (select *, sum(case when kind = 'volume' then 1 else 0 end) over (partition by book_id order by start) as seg from h{i - 1}),
l{i} as (select *, lag(number) over w as p, lead(number) over w as n from m{i} window w as (partition by book_id, seg, kind order by start)),
h{i} as (select book_id, start, kind, number from l{i} where not coalesce(kind = 'chapter' and n = p + 1 and number <> p and number <> n, false))"""


@query("c3_remove_sequence_outliers", "with " + NUMBERED + "".join(_pass(i) for i in range(1, 6)) + "\nselect book_id, start, kind, number from h5")
def c3(spark, d):
    t = F.col("turn")
    rows = table(spark, d, "conversations").select(
        F.col("conv_id").alias("book_id"), t.alias("start"), F.when(t % 7 == 6, "volume").otherwise("chapter").alias("kind"),
        F.when(t % 7 == 6, None).when(t % 3 == 2, 99).otherwise(t - F.floor(t / 3) + 1).cast("bigint").alias("number"),
    )
    return st.remove_sequence_outliers(rows)


@query("c4_assign_volumes", """
select conv_id as book_id, turn as start, last_value(case when turn % 3 = 1 then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as volume_start
from conversations""")
def c4(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("start"), F.when(F.col("turn") % 3 == 1, "volume").otherwise("chapter").alias("kind"), F.col("role").alias("title"))
    return st.assign_volumes(rows).select("book_id", "start", "volume_start")


@query("c5_chapter_ranges", f"with {PARSED}{CHAPTERS} select book_id, start, content_start, content_end from ranged")
def c5(spark, d):
    return st.chapter_ranges(_headings(spark, d), conv_books(spark, d)).select("book_id", "start", "content_start", "content_end")


def _volumed(spark, d):
    """Conversations as books with a volume heading before every third turn and a preface."""
    rows = table(spark, d, "conversations")
    head = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("卷"), (F.col("turn") / 3 + 1).cast("int").cast("string"), F.lit(" part\nopening words here:\n"))).otherwise(F.lit(""))
    piece = F.concat(head, F.lit("Chapter "), (F.col("turn") + 1).cast("string"), F.lit(" "), F.col("role"), F.lit("\n"), F.col("text"), F.lit("\n"))
    books = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", piece.alias("piece")))).alias("x"))
    return books.select(F.md5(F.col("conv_id").cast("string").cast("binary")).alias("book_id"), F.concat(F.lit("a preface:\n"), F.array_join(F.transform("x", lambda s: s["piece"]), "")).alias("text"))


VOLUMED = """
with n as (select md5(conv_id::varchar) as book_id, count(*) as turns, count(case when turn % 3 = 0 then 1 end) as vols from conversations group by conv_id)"""


@query("c6_front_matter", VOLUMED + " select book_id, turns as n_chapter, vols + 1 as n_special from n")
def c6(spark, d):
    books = _volumed(spark, d)
    rows = st.chapters(books)
    return rows.groupBy("book_id").agg(F.count_if(F.col("kind") == "chapter").alias("n_chapter"), F.count_if(F.col("kind") == "special").alias("n_special"))


@query("c7_fallback_chapters", f"with {DOCS}{EMPTY}{CHAPTERS} select book_id, chapter_id, title, kind, content_start, content_end from chapters")
def c7(spark, d):
    return _whole(doc_books(spark, d)).select("book_id", "chapter_id", "title", "kind", "content_start", "content_end")


@query("c8_chapters", f"""with {PARSED}{CHAPTERS}
select book_id, chapter_id, ordinal, title, kind, number, start, heading_end, content_start, content_end, character_count, {tokens('content')} as token_count, {preview('content', 160)} as preview from chapters""")
def c8(spark, d):
    return _chapters(spark, d)[1].drop("volume_start")


@query("c9_volumes", VOLUMED + " select book_id, unnest(range(1, vols + 1)) as ordinal, unnest(list_transform(range(1, vols + 1), lambda v: 1 + least(3, turns - (v - 1) * 3))) as n_chapters from n")
def c9(spark, d):
    books = _volumed(spark, d)
    headings = st.remove_sequence_outliers(st.find_headings(st.explode_lines(books)))
    return st.volumes(headings, st.chapters(books, headings), books).select("book_id", "ordinal", F.size("chapter_ids").cast("bigint").alias("n_chapters"))


@query("c10_document_manifest", f"""with {PARSED}{CHAPTERS}
select book_id, length(text) as character_count, count(chapter_id) as chapter_count, coalesce(sum({tokens('content')}), 0) as token_count, coalesce(bool_or(kind = 'fallback'), false) as used_fallback
from books left join chapters using (book_id) group by book_id, text""")
def c10(spark, d):
    books, rows = _chapters(spark, d)
    return st.document_manifest(books, rows)


CHUNKED = f""",
told as (
  select book_id, chapter_id, content_start, content as body, length(content) as n, regexp_extract_all(content, '{PIECE}') as pieces, regexp_extract_all(content, '{TOKEN}') as words from chapters),
marked as (select *, list_transform(range(1, len(pieces) + 1), lambda i: length(array_to_string(pieces[1:i], ''))) as ends from told),
spread as (select *, list_transform(range(1, len(pieces) + 1), lambda i: ends[i] - length(words[i])) as begins from marked),
cut as (
  with recursive c as (
    select book_id, chapter_id, -1::bigint as part, 0::bigint as start, 0::bigint as stop, 0::bigint as following from spread
    union all
    select book_id, chapter_id, part + 1, start, stop, greatest(start + 1, coalesce(ends[case when ended > 30 then ended - 30 end], 0))::bigint
    from (select *, len(list_filter(ends, lambda e: e <= stop)) as ended from (
      select *, case when safe = n or last = 0 or mark_end <= start then safe else mark_end end as stop from (
        select *, low + last - case when substr(span, last, 1) = chr(10) then 1 else 0 end as mark_end from (
          select *, length(regexp_extract(span, '(?s)^.*[\n。！？；.!?;]')) as last from (select *, substr(body, low + 1, safe - low) as span from (
            select *, start + floor((safe - start)::double * 0.6::double)::bigint as low from (
              select book_id, chapter_id, part, start, n, body, begins, ends, begun,
                case when begun + 200 >= len(begins) then n else greatest(begins[begun + 201], start + 1) end as safe
              from (select c.book_id, c.chapter_id, c.part, c.following as start, s.n, s.body, s.begins, s.ends, len(list_filter(s.begins, lambda b: b < c.following)) as begun
                from c join spread s using (book_id, chapter_id) where c.following < s.n and c.stop < s.n))))))))
    where begins[begun + 1] < stop)
  select * from c where part >= 0),
chunks as (
  select book_id, chapter_id, part + 1 as ordinal, content_start + start as start_char, content_start + stop as end_char, substr(body, start + 1, stop - start) as content,
    lag(stop) over (partition by book_id, chapter_id order by start) - start as shared
  from cut join spread using (book_id, chapter_id))"""


@query("d2_chunk_chapters", f"""with {PARSED}{CHAPTERS}{CHUNKED}
select book_id, chapter_id, ordinal, start_char, end_char, {stable_id('chunk', 'book_id', 'chapter_id', 'start_char', 'end_char', "'regex'")} as chunk_id, {stable_id('cite', 'book_id', 'start_char', 'end_char')} as citation_id,
  {tokens('content')} as token_count, end_char - start_char as character_count, case when shared > 0 then {tokens('substr(content, 1, shared)')} else 0 end as overlap_tokens, {preview('content', 120)} as preview from chunks""")
def d2(spark, d):
    books, rows = _chapters(spark, d)
    return ch.chunk_chapters(rows, books, 200, 30)


@query("d3_fixed_token_windows", f'with {DOCS}{EMPTY}{CHAPTERS}{WINDOWS} select book_id, chapter_id, "window", start_char, end_char, token_count, md5(content) as content from windows')
def d3(spark, d):
    return _windows(spark, d)[1].withColumn("content", F.md5(F.col("content").cast("binary")))


@query("d4_chunk_overlap", f"""with {DOCS}{EMPTY}{CHAPTERS}{WINDOWS}
select book_id, start_char, case when prev is null then 0 else {tokens("substr(content, 1, greatest(0, prev - start_char)::bigint)")} end as overlap_tokens from (
  select *, lag(end_char) over (partition by book_id, chapter_id order by start_char) as prev from windows)""")
def d4(spark, d):
    return ch._described(_windows(spark, d)[1], "regex").select("book_id", "start_char", "overlap_tokens")


def _chunk_rows(spark, d):
    return table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("text").alias("content"), F.lit("2024-01-02").cast("timestamp").alias("parsed_at"))


def _edit_rows(spark, d):
    rows = table(spark, d, "conversations").filter("turn % 2 = 0").withColumn("v", F.explode(F.array(F.lit(1), F.lit(2))))
    text = F.when(F.col("conv_id") % 5 == 0, F.lit("  ")).when(F.col("conv_id") % 5 == 1, F.col("text")).otherwise(F.concat(F.lit("edit "), F.col("v").cast("string"), F.lit("\r\n"), F.substring("text", 1, 40)))
    day = F.when(F.col("turn") == 0, F.lit("2024-01-01")).otherwise(F.concat(F.lit("2024-01-0"), (F.col("v") + 2).cast("string"))).cast("timestamp")
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), text.alias("content"), day.alias("edited_at"))


@query("d5_apply_chunk_edits", f"""
with edits as (
  select conv_id || '-' || turn as chunk_id, v, case when conv_id % 5 = 0 then '  ' when conv_id % 5 = 1 then text else 'edit ' || v || chr(10) || substr(text, 1, 40) end as e
  from conversations, (values (1), (2)) x(v) where turn % 2 = 0 and turn <> 0),
best as (select chunk_id, max_by(e, v) as e from edits where trim(e) <> '' and {tokens('e')} <= 100 group by chunk_id)
select chunk_id, nullif(b.e, c.content) as content_override, nullif(b.e, c.content) is not null as is_edited, {tokens("coalesce(nullif(b.e, c.content), c.content)")} as token_count
from (select conv_id || '-' || turn as chunk_id, text as content from conversations) c left join best b using (chunk_id)""")
def d5(spark, d):
    return ch.apply_chunk_edits(_chunk_rows(spark, d), _edit_rows(spark, d), 100)[0].select("chunk_id", "content_override", "is_edited", "token_count")


@query("d6_delete_chunks", "select conv_id || '-' || turn as chunk_id from conversations where not (conv_id % 3 = 0 and turn % 2 = 1)")
def d6(spark, d):
    gone = table(spark, d, "conversations").filter("conv_id % 3 = 0 and turn % 2 = 1").select(F.concat_ws("-", "conv_id", "turn").alias("chunk_id"))
    return ch.delete_chunks(_chunk_rows(spark, d), gone).select("chunk_id")


def _contents(spark, d):
    books, windows = _windows(spark, d)
    ids = windows.select("book_id", "chapter_id", "window", "start_char", "end_char", F.concat_ws("-", "book_id", "window").alias("chunk_id"))
    edits = ids.filter("window % 4 = 1").select("chunk_id", F.lit("An edited chunk.").alias("content_override"))
    return ch.chunk_content(ids, books, edits)


@query("b11_chunk_content", f"""with {DOCS}{EMPTY}{CHAPTERS}{WINDOWS}
select book_id || '-' || "window" as chunk_id, md5(case when "window" % 4 = 1 then 'An edited chunk.' else content end) as content, md5(content) as original_content, "window" % 4 = 1 as is_edited from windows""")
def b11(spark, d):
    md5 = lambda c: F.md5(F.col(c).cast("binary")).alias(c)
    return _contents(spark, d).select("chunk_id", md5("content"), md5("original_content"), "is_edited")


@query("e1_chapter_bodies", f"""with {DOCS}{EMPTY}{CHAPTERS}{WINDOWS},
covered as (select *, max(end_char) over (partition by book_id, chapter_id order by start_char rows between unbounded preceding and 1 preceding) as upto from windows),
kept as (select *, case when upto is null or upto < start_char then content else substr(content, (upto - start_char + 1)::bigint) end as piece from covered where end_char > coalesce(upto, 0))
select book_id, chapter_id, md5(string_agg(piece, '' order by start_char)) as body, count(*) as n_chunks from kept where piece <> '' group by book_id, chapter_id""")
def e1(spark, d):
    books, windows = _windows(spark, d)
    rows = windows.withColumns({"chunk_id": F.concat_ws("-", "book_id", "window"), "original_content": F.col("content"), "is_edited": F.lit(False)})
    return ch.chapter_bodies(rows).select("book_id", "chapter_id", F.md5(F.col("body").cast("binary")).alias("body"), F.size("chunk_ids").cast("bigint").alias("n_chunks"))


LIMIT = 900


def _bodies(limit):
    """Segments in SQL: whole chapters that fit, and parts that end at the last natural boundary of their last two fifths."""
    return f""",
headed as (
  select book_id, chapter_id, ordinal, title, content as body, '【章节 ' || ordinal || '：' || title as head, regexp_extract_all(content, '{PIECE}') as pieces,
    regexp_extract_all(content, '{TOKEN}') as words from chapters where regexp_matches(content, '[^{SPACE}]')),
whole as (select *, head || '】' || chr(10) || body as content from headed),
long as (
  select book_id, chapter_id, ordinal, title, head, body, length(body) as n, {limit} - {tokens("head || ' · 片段 999999】' || chr(10)")} as room,
    list_transform(range(1, len(pieces) + 1), lambda i: length(array_to_string(pieces[1:i], '')) - length(words[i])) as begins
  from whole where {tokens('content')} > {limit}),
cut as (
  with recursive c as (
    select book_id, chapter_id, 0::bigint as part, 0::bigint as start, 0::bigint as stop from long where room >= 1
    union all
    select book_id, chapter_id, part + 1, stop, case when safe = n then n when last > 0 then low + last - case when substr(span, last, 1) = chr(10) then 1 else 0 end else safe end
    from (select *, length(regexp_extract(span, '(?s)^.*[\n。！？；.!?;]')) as last from (select *, substr(body, low + 1, safe - low) as span from (
      select *, stop + floor((safe - stop)::double * 0.6::double)::bigint as low from (
        select c.book_id, c.chapter_id, part, stop, n, body,
          case when begun + room >= len(begins) then n else greatest(begins[begun + room + 1], stop + 1) end as safe
        from (select c.*, l.n, l.body, l.room, l.begins, len(list_filter(l.begins, lambda b: b < c.stop)) as begun from c join long l using (book_id, chapter_id) where c.stop < l.n) c)))))
  select * from c where part > 0),
segments as (
  select book_id, chapter_id, ordinal, title, 1::bigint as part_ordinal, 1::bigint as part_count, content, {tokens('content')} as token_count from whole where {tokens('content')} <= {limit}
  union all
  select book_id, chapter_id, ordinal, title, part, part_count, content, {tokens('content')} from (
    select l.*, part, count(*) over (partition by book_id, chapter_id) as part_count, head || ' · 片段 ' || part || '】' || chr(10) || substr(body, start + 1, stop - start) as content
    from cut join long l using (book_id, chapter_id)))"""


BODIES = _bodies(LIMIT)


def _segments(spark, d, limit=LIMIT):
    books, rows = _chapters(spark, d)
    bodies = rows.join(books, "book_id").select(
        "book_id", "chapter_id", "ordinal", "title", st.slice_text(F.col("text"), F.col("content_start"), F.col("content_end")).alias("body"),
        F.array("chapter_id").alias("chunk_ids"), F.lit(False).alias("contains_edits"))
    return pl.plan_segments(bodies, limit)


@query("e2_plan_segments", f"""with {PARSED}{CHAPTERS}{BODIES}
select book_id, ordinal, part_ordinal, token_count, {stable_id('segment', 'book_id', 'chapter_id', 'part_ordinal', 'sha256(content)', str(LIMIT))} as segment_id from segments""")
def e2(spark, d):
    return _segments(spark, d)[0].select("book_id", "ordinal", "part_ordinal", "token_count", "segment_id")


@query("e2_plan_segments_split", f"""with {PARSED}{CHAPTERS}{_bodies(150)}
select book_id, ordinal, part_ordinal, part_count, token_count, {stable_id('segment', 'book_id', 'chapter_id', 'part_ordinal', 'sha256(content)', '150')} as segment_id from segments""")
def e2_split(spark, d):
    return _segments(spark, d, 150)[0].select("book_id", "ordinal", "part_ordinal", "part_count", "token_count", "segment_id")


PACKED = BODIES + f""",
seq as (select *, row_number() over (partition by book_id order by ordinal, part_ordinal) as pos from segments),
packed as (
  with recursive p as (
    select book_id, pos, 1 as batch_no, token_count as used from seq where pos = 1
    union all
    select s.book_id, s.pos, case when p.used + s.token_count <= {LIMIT} then p.batch_no else p.batch_no + 1 end, case when p.used + s.token_count <= {LIMIT} then p.used + s.token_count else s.token_count end
    from p join seq s on s.book_id = p.book_id and s.pos = p.pos + 1)
  select seq.*, p.batch_no from seq join p using (book_id, pos))"""


@query("e3_pack_batches", f"with {PARSED}{CHAPTERS}{PACKED} select book_id, pos, batch_no, token_count from packed")
def e3(spark, d):
    return pl.pack_batches(_segments(spark, d)[0], LIMIT).select("book_id", "pos", "batch_no", "token_count")


META = PACKED + f""",
segmented as (select *, {stable_id('segment', 'book_id', 'chapter_id', 'part_ordinal', 'sha256(content)', str(LIMIT))} as segment_id from packed),
metas as (
  select book_id, batch_no, min(ordinal) as first_chapter, max(ordinal) as last_chapter,
    case when min(ordinal) = max(ordinal) then min_by(title, pos) else min_by(title, pos) || ' → ' || max_by(title, pos) end as range_label,
    sum(token_count)::bigint as token_count, (sum(length(content)) + 2 * (count(*) - 1))::bigint as character_count,
    sha256(string_agg(content, chr(10) || chr(10) order by pos)) as content_fingerprint, string_agg(segment_id, chr(31) order by pos) as ids
  from segmented group by book_id, batch_no),
batches as (select *, 'batch_' || substr(sha256(book_id || chr(31) || content_fingerprint || chr(31) || ids), 1, 16) as batch_id from metas)"""


@query("e4_batch_metadata", f"with {PARSED}{CHAPTERS}{META} select book_id, batch_no, first_chapter, last_chapter, range_label, token_count, character_count, content_fingerprint, batch_id from batches")
def e4(spark, d):
    return _batches(spark, d).select("book_id", "batch_no", "first_chapter", "last_chapter", "range_label", "token_count", "character_count", "content_fingerprint", "batch_id")


def _batches(spark, d):
    return pl.batch_metadata(pl.pack_batches(_segments(spark, d)[0], LIMIT))


WORK = """
w as (
  with recursive r as (
    select k, n, g, s, n as left_, 0::bigint as calls, 0::bigint as tokens from start
    union all
    select k, n, g, s, left_ // g + case when left_ % g > 0 then 1 else 0 end, calls + left_ // g + case when left_ % g > 0 then 1 else 0 end,
      tokens + (left_ // g) * (g * s + (g - 1) * 16) + case when left_ % g > 0 then (left_ % g) * s + (left_ % g - 1) * 16 else 0 end
    from r where left_ > 1)
  select k, case when n = 0 then 0 when n = 1 then 1 else max(calls) end as calls, case when n = 0 then 0 when n = 1 then s else max(tokens) end as tokens from r group by k, n, s)"""


@query("e5_estimate_merge_work", "with start as (select *, greatest(2, (l + 16) // (s + 16)) as g from (select o_orderkey as k, o_orderkey % 300 as n, 500 + o_custkey % 4000 as l, 32 + o_orderkey % 1000 as s from orders))," + WORK + " select k as o_orderkey, calls, tokens from w")
def e5(spark, d):
    work = pl.estimate_merge_work(F.col("o_orderkey") % 300, 500 + F.col("o_custkey") % 4000, 32 + F.col("o_orderkey") % 1000)
    return table(spark, d, "orders").select("o_orderkey", work.alias("w")).select("o_orderkey", F.col("w.calls").alias("calls"), F.col("w.tokens").alias("tokens"))


PLANNED = META + ",\nstart as (select book_id as k, count(*) as n, 2::bigint as g, 300::bigint as s from batches group by book_id)," + WORK + """,
plans as (select book_id, count(*) as batch_count, sum(token_count)::bigint as content_tokens, 'plan_' || substr(sha256(book_id || chr(31) || '{"limit":400}' || chr(31) || string_agg(batch_id, chr(31) order by batch_no)), 1, 16) as plan_id from batches group by book_id)"""


@query("e6_plan_rollup", f"with {PARSED}{CHAPTERS}{PLANNED} select book_id, batch_count, content_tokens, calls as merge_calls, tokens as merge_tokens, plan_id from plans join w on k = book_id")
def e6(spark, d):
    return pl.plan_rollup(_batches(spark, d), '{"limit":400}', 400, 300)


@query("e7_plan_drift", f"with {PARSED}{CHAPTERS}{PLANNED} select book_id, 'plan_old' as saved_plan, plan_id as current_plan from plans where batch_count > 1")
def e7(spark, d):
    now = pl.plan_rollup(_batches(spark, d), '{"limit":400}', 400, 300)
    saved = now.select("book_id", F.when(F.col("batch_count") > 1, "plan_old").otherwise(F.col("plan_id")).alias("plan_id"))
    return pl.plan_drift(saved, now)
