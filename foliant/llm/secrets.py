"""Secret scans over a trigram inverted index, with built-in functions only.

From each rule's regular expression follow the trigrams that a matching text must hold, as alternatives
of sets. The index lists, for each of these trigrams, the documents that hold it (letters lower-cased);
intersecting its lists gives each rule's candidates, and only those are matched. A rule without any
mandatory trigram is matched against every document.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import count_kind, found, labelled, listed, ordered, row_key
from .storage import saved

MANY = 64


@dataclass(frozen=True)
class Rule:
    """pattern in the syntax that Java and Python share; least: code points that group `of` must have."""

    name: str
    pattern: str
    least: int = 0
    of: int = 0

    def ok(self, value: Column) -> Column:
        part = value if not self.of else F.regexp_extract(value, self.pattern, self.of)
        return F.length(part) >= self.least


#: Fixed formats of the base rules, then public formats of well-known access keys.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,250}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,250}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,250}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")

Clauses = set[frozenset[str]]
ANY: Clauses = {frozenset()}


def _least(clauses: Clauses) -> Clauses:
    """Without the alternatives that a weaker one makes needless."""
    return {c for c in clauses if not any(d < c for d in clauses)}


def _both(a: Clauses, b: Clauses) -> Clauses:
    return _least({x | y for x in a for y in b}) if len(a) * len(b) <= MANY else min(a, b, key=len)


def _held(strings: set[str]) -> Clauses:
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _read(items) -> tuple[set[str] | None, Clauses]:
    """All strings that a parsed expression matches, if few, and what any match must hold."""
    strings, must = {""}, ANY
    flushed = False
    for op, arg in items:
        own: set[str] | None = None
        needs = ANY
        if op is sre.LITERAL:
            own = {chr(arg).lower()}
        elif op is sre.IN and len(arg) <= 6 and all(o is sre.LITERAL for o, _ in arg):
            own = {chr(a).lower() for _, a in arg}
        elif op is sre.SUBPATTERN:
            own, needs = _read(arg[-1])
        elif op is sre.BRANCH:
            read = [_read(x) for x in arg[1]]
            own = set().union(*(s for s, _ in read)) if all(s is not None for s, _ in read) else None
            needs = _least(set().union(*(m if s is None else _held(s) for s, m in read)))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = arg
            inside, inner_needs = _read(inner)
            if (low, high) == (0, 1) and inside is not None:
                own = inside | {""}
            elif low == high == 1:
                own, needs = inside, inner_needs
            elif low >= 1:
                needs = inner_needs if inside is None else _held(inside)
        elif op is sre.AT:
            own = {""}
        if own is not None and len(strings) * len(own) <= MANY:
            strings = {a + b for a, b in product(strings, own)}
            continue
        must, flushed = _both(must, _held(strings)), True
        strings = own if own is not None else {""}
        if own is None:
            must = _both(must, needs)
    if flushed:
        return None, _both(must, _held(strings))
    return strings, _held(strings)


def trigram_query(pattern: str) -> Clauses:
    """Alternatives of trigram sets, one of which any match holds once lower-cased; {empty} if none is mandatory."""
    return _read(parser.parse(pattern))[1]


def build_index(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, two key columns, trigrams held (of those the rules ask for), spans of rules that scan fully."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    asked = sorted({t for r in rules for c in trigram_query(r.pattern) for t in c})
    low = F.lower(text)
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in asked]))
    full = [labelled(found(text, r.pattern), r.name, r.ok) for r in rules if frozenset() in trigram_query(r.pattern)]
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return saved(docs.select("doc_id", *row_key(F.col("doc_id"), text), held.alias("trigrams"), F.concat(none, *full).alias("full")), "secret-index")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """key_a, key_b, rules: the documents in the intersection of a rule's postings, with a bit for each rule."""
    clauses = [
        (t, r, k, len(c)) for r, rule in enumerate(rules) for k, c in enumerate(sorted(map(sorted, trigram_query(rule.pattern)))) for t in c
    ]
    asked = index.sparkSession.createDataFrame(clauses, "trigram string, rule int, clause int, size long")
    postings = index.select("key_a", "key_b", F.explode("trigrams").alias("trigram"))
    met = postings.join(F.broadcast(asked), "trigram").groupBy("key_a", "key_b", "rule", "clause", "size")  # a row for each trigram of a rule
    full = met.agg(F.count_distinct("trigram").alias("n")).filter("n = size")
    return full.groupBy("key_a", "key_b").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, base and spans (kind, start, end by start, then by rule) of every row of docs.

    Null text: no spans. Equal rows get equal spans. Spans that begin together stand in order of the rules.
    Texts are whole however long. Empty table: no rows. Other columns are ignored.
    """
    index = build_index(docs, rules)
    chosen = saved(candidates(index, rules).withColumnsRenamed({"key_a": "of_a", "key_b": "of_b"}), "secret-candidates")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(*row_key(F.col("doc_id"), text), text.alias("text"))
    texts = texts.join(chosen, (F.col("key_a") == F.col("of_a")) & (F.col("key_b") == F.col("of_b")))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    parts = [
        F.when(F.col("rules").bitwiseAND(F.lit(1 << i).cast("long")) != 0, labelled(found(F.col("text"), r.pattern), r.name, r.ok)).otherwise(none)
        for i, r in enumerate(rules) if frozenset() not in trigram_query(r.pattern)
    ]
    verified = texts.select("key_a", "key_b", F.concat(none, *parts).alias("part")).filter(F.size("part") > 0)
    verified = saved(verified.dropDuplicates(["key_a", "key_b"]), "secret-verified")
    names = [r.name for r in rules]
    spans = ordered(F.concat(F.col("full"), F.coalesce(F.col("part"), none)), names, by_start=True)
    rows = index.join(verified, ["key_a", "key_b"], "left").select("doc_id", spans.alias("spans"))
    return rows.select("doc_id", F.filter("spans", lambda s: s["kind"].isin(*BASE)).alias("base"), "spans")


def digest(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
