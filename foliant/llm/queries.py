"""The queries of this subpackage, op<N>_<name>, over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, mixing, neighbours, pages, paragraphs, phrases, pii, quality, repetition, secrets, simhash, suffixes
from .storage import read_table


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer()
    coded = bpe.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(read_table(spark, sf_dir, "documents")))


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(read_table(spark, sf_dir, "documents"))


def op10_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.similar_paragraphs(read_table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = pages.extract(read_table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read_table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(read_table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes("base-1")).alias("base_failed"), quality.passes("general-1").alias("kept"), "failed",
    )


def op7_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy removes, and what it alone removes."""
    return quality.ablation(quality.ledger(read_table(spark, sf_dir, "documents")), "general-1")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(read_table(spark, sf_dir, "documents")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.run_report(read_table(spark, sf_dir, "documents"), plant=True)


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    hard = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(hard)
    return chat.read_back(chat.format_turns(rows))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_suffixes": op5_suffixes,
    "op6_html": op6_html,
    "op7_quality": op7_quality,
    "op7_rule_ablation": op7_ablation,
    "op8_neighbours": op8_neighbours,
    "op9_secrets": op9_secrets,
    "op10_paragraphs": op10_paragraphs,
    "op11_collocations": op11_collocations,
    "op12_runs": op12_runs,
    "op13_chat": op13_chat,
}

LEDGER = r"""
with texts as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
listed as (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from texts),
words as (select r, unnest(w) as word, generate_subscripts(w, 1) as i from listed),
windows as (select r, i, word || ' ' || lead(word) over (partition by r order by i) || ' ' || lead(word, 2) over (partition by r order by i) as x from words),
often as (select r, i from (select *, count(*) over (partition by r, x) as c from windows where x is not null) where c > 1),
covered as (select r, count(distinct j) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as j from often) group by r),
lines as (
  select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select r, unnest(string_split(t, chr(10))) as line from texts)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
measures as (
  select doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_upper,
    length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as n_letters, length(regexp_replace(t, '[^!]', '', 'g')) as n_bangs
  from texts join listed using (r) left join covered using (r) left join lines using (r)),
ledger as (select *, (""" + " + ".join(f"case when {rule} then {1 << k} else 0 end" for k, rule in enumerate(quality.RULES.values())) + ")::bigint as failed from measures)"
_RULE = "select '{0}' as rule, count(*) filter (failed & {1} <> 0) as n_failed, count(*) filter (failed = {1}) as n_only from ledger"

SQL: dict[str, str] = {
    "op7_quality": f"""{LEDGER}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {quality.bits(quality.POLICIES['base-1'])} <> 0 as base_failed, failed & {quality.bits(quality.POLICIES['general-1'])} = 0 as kept, failed
from ledger""",
    "op7_rule_ablation": f"{LEDGER}\n" + " union all ".join(_RULE.format(rule, quality.bits([rule])) for rule in quality.POLICIES["general-1"]),
    "op1_mixing": r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
ranked as (
  select *, case place % 3 when 0 then 5 when 1 then 2 else 1 end as weight from (
    select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place
    from sized group by source)),
levels as (
  select *, 2.0::double * source_size / weight as full_at from ranked),
running as (
  select *, (sum(source_size) over ()::double * 1.5::double
      - coalesce(sum(source_size) over (order by full_at, place rows between unbounded preceding and 1 preceding), 0)::double * 2.0::double)
    / (sum(weight) over () - coalesce(sum(weight) over (order by full_at, place rows between unbounded preceding and 1 preceding), 0))::double as level
  from levels),
settled as (
  select *, max(case when full_at > level then level end) over () as final_level from running),
targets as (
  select source, source_size, least(source_size::double * 2.0::double,
    coalesce(final_level * weight, source_size::double * 2.0::double)) as target from settled),
rated as (
  select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size::double else 0.0::double end as rate
  from sized d join targets t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (floor(rate)::bigint + case when ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double / 4503599627370496.0::double
     < rate - floor(rate) then 1 else 0 end)::bigint * size as taken
from rated
""",
    "op11_collocations": r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
words as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as w from pieces),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from words where len(w) > 0),
grams as (
  select lang, size, array_to_string(w[i : i + size - 1], ' ') as phrase, count(*) as f
  from starts, (select unnest([1, 2, 3, 4]) as size) where i + size - 1 <= len(w) group by all),
totals as (select lang, sum(f)::bigint as n from grams where size = 1 group by lang),
often as (select * from grams where f >= 30),
cand as (select lang, size, phrase, string_split(phrase, ' ') as w, f as a from often where size > 1),
cuts as (select *, unnest(range(1, size)) as k from cand),
scored as (
  select c.lang, c.size, c.phrase, c.a, x.f as l, y.f as r, (2000000::hugeint * c.a // (x.f + y.f))::bigint as score
  from cuts c join often x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : k], ' ')
    join often y on y.lang = c.lang and y.phrase = array_to_string(c.w[k + 1 :], ' ')
  qualify row_number() over (partition by c.lang, c.phrase order by score, k) = 1),
inner_phrases as (
  select lang, phrase, max(f) as most from (
    select lang, a as f, array_to_string(w[i : i + m - 1], ' ') as phrase
    from (select *, unnest(range(1, size - m + 2)) as i from (select *, unnest(range(2, size)) as m from cand))) group by all),
kept as (
  select s.* from scored s left join inner_phrases p using (lang, phrase)
  where most is null or 100::hugeint * most < 80::hugeint * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
""",
    "op13_chat": r"""
with rows as (
  select conv_id, turn, role, text from conversations
  union all select -7, x, case x when 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from range(2) t(x)),
plain as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(4 + length(role) + 2 + length(text) + len(regexp_extract_all(text, '### |</turn>')) + 9)::bigint as formatted_chars
from plain group by conv_id
""",
}
