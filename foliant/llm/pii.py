"""Personal data by bootstrapped contextual extraction, with built-in functions only.

Strict patterns find seeds. The words around seeds are lexical patterns; patterns and the identifiers
seen in them form a bipartite graph that is scored in rounds: a pattern by the share of its identifiers
that are believed, an identifier by the patterns it occurs in (noisy or). Identifiers of a looser form
that reliable patterns surround become spans too. All identifiers and patterns of the corpus take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import BLOCK, bound, folded
from .spans import SPAN, count_kind, digits, found, labelled, listed, luhn, ordered, row_key
from .storage import own_prefix, saved

ONE = SPAN.removeprefix("array<").removesuffix(">")
KINDS = ["email", "ip", "card", "phone"]
LOCAL = "A-Za-z0-9._%+-"
BLANK = r"\x20\x09-\x0D"

#: The same languages as the base rules, without backtracking.
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms, taken only where a reliable pattern surrounds them.
LOOSE = {
    "email": rf"[{LOCAL}]{{1,64}}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{{1,63}})++",
    "phone": r"(?:\+?[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}",
    "card": r"[0-9](?:[\x20./-]?[0-9]){12,18}",
    "ip": r"[0-9]{1,3}(?:[.:_-][0-9]{1,3}){3}|[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{0,4}){2,7}",
}
ITEM = (
    "(?<![A-Za-z0-9.])(?:" + "|".join(LOOSE.values()) + r")(?![A-Za-z0-9])"
    rf"|(?<![^{BLANK}])[^{BLANK}0-9]*+[0-9][^{BLANK}]*+"
)
ROUNDS, SEEDS, RELIABLE, ACCEPT = 3, 3, 0.5, 0.8


def base_spans(text: Column) -> Column:
    """kind, start, end by the strict rules, by kind then start. Failing matches are dropped, not retried."""
    small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.right(p, F.lit(3))).cast("int") <= 255)
    n = lambda v: F.length(digits(v))
    nothing = F.array().cast(SPAN)
    spans = {k: found(text, p) for k, p in BASE.items()}
    spans["email"] = F.when(F.contains(text, F.lit("@")), spans["email"]).otherwise(nothing)
    spans["card"] = F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), spans["card"]).otherwise(nothing)
    spans["phone"] = F.when(F.contains(text, F.lit("+")), spans["phone"]).otherwise(nothing)
    return F.concat(
        labelled(spans["email"], "email"),
        labelled(spans["ip"], "ip", lambda v: F.forall(F.split(v, r"\."), small)),
        labelled(spans["card"], "card", lambda v: n(v).between(16, 19) & luhn(v)),
        labelled(spans["phone"], "phone", lambda v: n(v).between(8, 15)),
    )


def _seeded(told: Column, base: Column) -> Column:
    """s, seed for each span of told (none overlap): the kind of a base span that overlaps it, or null.

    In order of start, such a span is one of those before, the one that ends last, or else the next one.
    """
    own = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("told"), b["end"].alias("end"), b["kind"].alias("kind"), F.lit(None).cast(ONE).alias("s")))
    mine = F.transform(told, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("told"), s["end"].alias("end"), F.lit("").alias("kind"), s.alias("s")))
    at = lambda xs: F.zip_with(xs, F.slice(xs, F.lit(2), F.size(xs)), lambda x, n: F.struct(x.alias("x"), n.alias("next")))

    def step(last: Column, pair: Column) -> tuple[Column, Column]:
        x, after = pair["x"], pair["next"]
        seed = F.when(last["end"] > x["start"], last["kind"]).when((after["told"] == 0) & (after["start"] < x["end"]), after["kind"])
        moved = F.when((x["told"] == 0) & (x["end"] > last["end"]), F.struct(x["end"].alias("end"), x["kind"].alias("kind"))).otherwise(last)
        return moved, F.when(x["told"] == 1, F.array(F.struct(x["s"].alias("s"), seed.alias("seed")))).otherwise(none)

    none = F.array().cast(f"array<struct<s:{ONE},seed:string>>")
    first = F.struct(F.lit(-1).cast("bigint").alias("end"), F.lit("").alias("kind"))
    return F.when(F.size(told) == 0, none).otherwise(folded(bound(F.array_sort(F.concat(own, mine)), at), first, none, step))


def _items(text: Column, base: Column) -> Column:
    """Identifier-like strings: start, end, value, kind, role (2 seed, 1 candidate, 0 neither), patterns."""
    told = F.when(text.rlike(r"[0-9]|[\[(]at[\])]"), found(text, ITEM, context=True)).otherwise(F.array().cast(SPAN))
    word = lambda c, i: F.coalesce(F.try_element_at(F.filter(F.split(F.lower(c), rf"[{BLANK}]+"), lambda w: w != ""), F.lit(i)), F.lit(""))
    plain = lambda c: F.regexp_replace(c, "[0-9]", "0")

    def one(x: Column) -> Column:
        s, seed = x["s"], x["seed"]
        loose = F.lit(None).cast("string")
        for kind, pattern in reversed(list(LOOSE.items())):
            loose = F.when(s["value"].rlike(f"^(?:{pattern})$"), kind).otherwise(loose)
        before, last, after = word(s["before"], -2), word(s["before"], -1), word(s["after"], 1)
        return F.struct(
            s["start"], s["end"], F.lower(s["value"]).alias("value"), F.coalesce(seed, loose, F.lit("other")).alias("kind"),
            F.when(seed.isNotNull(), 2).when(loose.isNotNull(), 1).otherwise(0).alias("role"),
            F.array(F.concat(F.lit("2<"), plain(before), F.lit(" "), plain(last)), F.concat(F.lit("<>"), plain(last), F.lit("_"), plain(after))).alias("patterns"),
        )

    return F.transform(_seeded(told, base), one)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, two key columns, base spans and items of every row; written once, without any text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", *row_key(F.col("doc_id"), text), text.alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    return saved(rows.select("doc_id", "key_a", "key_b", "base", _items(F.col("text"), F.col("base")).alias("items")), "pii-scan")


def believed(scanned: DataFrame) -> DataFrame:
    """kind, value, score of the candidates that the scored graph makes believable."""
    items = scanned.select(F.explode("items").alias("i")).select("i.kind", "i.value", "i.role", F.explode("i.patterns").alias("pattern"))
    edges = saved(items.groupBy("pattern", "kind", "value").agg(F.max("role").alias("role")), "pii-edges")
    # only patterns of several seeds can ever count, and only candidates in them
    seeded = edges.groupBy("pattern").agg(*[F.count_if((F.col("role") == 2) & (F.col("kind") == k)).alias(f"seeds_{k}") for k in KINDS])
    seeded = saved(seeded.filter(F.greatest(*[F.col(f"seeds_{k}") for k in KINDS]) >= SEEDS), "pii-seeded")
    edges = saved(edges.join(seeded, "pattern"), "pii-graph")
    scores = None
    for _ in range(ROUNDS):
        now = edges if scores is None else edges.join(scores, ["kind", "value"], "left")
        known = F.lit(0.0) if scores is None else F.coalesce(F.col("score"), F.lit(0.0))
        score = F.when(F.col("role") == 2, 1.0).when(F.col("role") == 1, known).otherwise(0.0)
        shares = now.groupBy("pattern").agg(*[(F.sum(F.when(F.col("kind") == k, score).otherwise(0.0)) / F.count("*")).alias(f"share_{k}") for k in KINDS])
        asked = edges.filter("role = 1").join(saved(shares, "pii-shares"), "pattern")
        mine = F.coalesce(*[F.when((F.col("kind") == k) & (F.col(f"seeds_{k}") >= SEEDS) & (F.col(f"share_{k}") >= RELIABLE), F.col(f"share_{k}")) for k in KINDS])
        asked = asked.withColumn("share", mine).filter("share is not null")
        doubt = F.sum(F.log(1 - F.least(F.col("share"), F.lit(0.99))))
        scores = saved(asked.groupBy("kind", "value").agg((1 - F.exp(doubt)).alias("score")), "pii-scores")
        if scores.isEmpty():
            break
    return scores.filter(F.col("score") >= ACCEPT)


def added_spans(scanned: DataFrame) -> DataFrame:
    """key_a, key_b, added: spans of believed candidates that touch no base span, for documents that have any."""
    accepted = believed(scanned).select(F.col("kind").alias("is"), F.col("value").alias("of"))
    rows = scanned.select("key_a", "key_b", F.explode("items").alias("i")).filter("i.role = 1")
    hits = rows.join(accepted, (F.col("i.kind") == F.col("is")) & (F.col("i.value") == F.col("of")), "left_semi")
    one = F.struct(F.col("i.kind").alias("kind"), F.col("i.start").alias("start"), F.col("i.end").alias("end"))
    return saved(hits.groupBy("key_a", "key_b").agg(F.collect_set(one).alias("added")), "pii-added")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (both kind, start, end by kind then start) of every row of docs.

    Null text: no spans. Equal rows get equal spans. Empty table: no rows. Other columns are ignored. Very
    long texts cost in proportion to their length; spans of one kind never overlap, so there are no ties.
    """
    scanned = scan(docs)
    added = added_spans(scanned)
    joined = scanned.join(added, ["key_a", "key_b"], "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(ordered(F.concat("base", "added"), KINDS, by_start=False))
    return joined.select("doc_id", "base", spans.alias("spans"))


def _replaced(text: Column, spans: Column) -> Column:
    """text with its spans (by start) replaced by their kinds; of spans that overlap, the first counts.

    A substring is found from the start of its text, so BLOCK spans at a time work on their own part of it.
    """
    none = F.array().cast("array<string>")

    def block(acc: Column, i: Column) -> Column:
        some = F.slice(spans, i * BLOCK + 1, BLOCK)
        stop = F.greatest(acc["at"], F.array_max(F.transform(some, lambda s: s["end"])))

        def within(part: Column) -> Column:
            def step(a: Column, s: Column) -> Column:
                gap = F.substring(part, (a["at"] - acc["at"]).cast("int") + 1, (s["start"] - a["at"]).cast("int"))
                piece = F.when(s["start"] >= a["at"], F.array(gap, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))).otherwise(none)
                return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], piece).alias("out"))

            return F.aggregate(some, F.struct(acc["at"].alias("at"), none.alias("out")), step, lambda a: F.struct(
                a["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(a["out"], ""))).alias("out")))

        return bound(F.substring(text, acc["at"].cast("int") + 1, (stop - acc["at"]).cast("int")), within)

    blocks = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int"))
    first = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))
    rest = lambda acc: F.substring(text, acc["at"].cast("int") + 1, F.length(text))
    return F.aggregate(blocks, first, block, lambda acc: F.concat(F.array_join(acc["out"], ""), rest(acc)))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in angle brackets, other columns as they are.

    Null texts stay null; rows without an id are cleaned like others; repeated rows alike; very long texts in
    blocks of spans; an empty table gives no rows. Columns of docs keep their names and values.
    """
    own = own_prefix(docs, "__pii_")
    name = lambda part: F.col(f"{own}{part}")
    added = added_spans(scan(docs)).select(F.col("key_a").alias(f"{own}a"), F.col("key_b").alias(f"{own}b"), F.col("added").alias(f"{own}added"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    a, b = row_key(F.col("doc_id"), text)
    rows = docs.withColumns({f"{own}ka": a, f"{own}kb": b}).join(added, (name("ka") == name("a")) & (name("kb") == name("b")), "left")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    spans = ordered(F.concat(base_spans(text), F.coalesce(name("added"), none)), KINDS, by_start=True)

    rows = rows.withColumn(f"{own}spans", spans)
    text_out = F.when(F.size(name("spans")) > 0, bound(name("spans"), lambda s: _replaced(text, s))).otherwise(F.col("text")).alias("text")
    return rows.select(*[text_out if c == "text" else docs[c] for c in docs.columns])


def digest(found_rows: DataFrame) -> DataFrame:
    return found_rows.select(
        "doc_id", *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
