"""Quality rules as a ledger: each document is measured once, each rule is judged once into a bit.

Policies are named sets of rules, hence bit masks over the ledger: a new version of a policy, and how
many documents each rule alone removes under it, need no second look at any text.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import own_prefix

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs")

#: name -> condition for failing, over the measures. The place in this table is the rule's bit.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines and n_lines >= 10",
    "long_words": "word_chars > 12 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "capitals": "10 * n_upper > 3 * n_letters",
    "exclamations": "2 * n_bangs > n_words",
}
BASE = ("too_few_words", "repeated_windows")
POLICIES: dict[str, tuple[str, ...]] = {"base-1": BASE, "general-1": tuple(RULES)}


def measured(text: str) -> tuple[int, ...]:
    """The measures of one text, in the order of MEASURES."""
    data = text.encode()
    words = data.split()  # bytes split on the six ASCII blanks only
    n, repeated = len(words), 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        times, reach = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return (
        n, len(text) - sum(map(text.count, BLANK)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated,
        len(lines), capitals, len(data) - len(data.translate(None, CAPITALS + CAPITALS.lower())), text.count("!"),
    )


@F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measured(t or "") for t in texts], columns=MEASURES)


def bits(names) -> int:
    return sum(1 << list(RULES).index(n) for n in names)


def judged(docs: DataFrame, prefix: str = "") -> DataFrame:
    """docs with the measures of each text and failed, the bits of the rules that it fails, under prefixed names."""
    m = f"{prefix}measures"
    rows = docs.withColumn(m, measures(F.col("text").cast("string")))
    failed = F.lit(0).cast("long")
    for k, rule in enumerate(RULES.values()):
        told = F.expr(re.sub(r"\bn_\w+|\bword_chars\b", lambda x: f"{m}.{x.group()}", rule))
        failed = failed.bitwiseOR(F.when(told, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return rows.withColumn(f"{prefix}failed", failed)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measures and failed, the bits of the rules that a document fails; one row per document.

    Null text: no words, so it fails too_few_words. Null ids and repeated rows keep rows of their own; very long
    texts are measured whole; an empty table gives no rows; other columns are ignored.
    """
    return judged(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", "measures.*", "failed")


def passes(policy: str, failed: Column | None = None) -> Column:
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(bits(POLICIES[policy])).cast("long")) == 0


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """rule, n_failed, n_only: documents that the rule fails, and those it alone removes under the policy."""
    mask = F.col("failed").bitwiseAND(F.lit(bits(POLICIES[policy])).cast("long"))
    counts = []
    for rule in POLICIES[policy]:
        bit = F.lit(bits([rule])).cast("long")
        counts += [F.count_if(mask.bitwiseAND(bit) != 0).alias(f"{rule}_f"), F.count_if(mask == bit).alias(f"{rule}_o")]
    one = book.agg(*counts)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(f"{r}_f").alias("n_failed"), F.col(f"{r}_o").alias("n_only")) for r in POLICIES[policy]
    ])).alias("x")).select("x.*")


def keep(docs: DataFrame, policy: str = "general-1") -> DataFrame:
    """The documents that pass a policy, with all their columns; texts are read once and not shuffled.

    Each row is measured and judged in the ledger's bits, then the policy's mask is applied. A null text has no
    words; rows without an id and repeated rows are judged each; very long texts whole; columns of docs whose
    names are those of the ledger keep their values; an empty table gives no rows.
    """
    own = own_prefix(docs, "__ledger_")
    return judged(docs, own).filter(passes(policy, F.col(f"{own}failed"))).select(*[docs[c] for c in docs.columns])
