"""Column functions over text: normalisation, checks, identities, headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a character class that Java and RE2 read alike.
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# The heading language.
NUMBER = "[0-9０-９零〇一二三四五六七八九十百千万两壹贰叁肆伍陆柒捌玖拾佰仟]+"
GAP = r"[ \t\x{3000}]*"
TITLE = r"[^\n]{0,48}"
HEADINGS: tuple[tuple[str, str], ...] = (
    ("chapter", rf"(?:正文{GAP})?第{NUMBER}[章节回部篇集]{GAP}{TITLE}"),
    ("chapter", rf"(?i:chapter)[ \t\x{{3000}}]+[0-9０-９]+(?:{GAP}[:：.．-]?{GAP}{TITLE})"),
    ("volume", rf"(?:正文{GAP})?(?:第{NUMBER}卷|卷{NUMBER}|[上中下]卷){GAP}{TITLE}"),
    ("special", rf"(?:序章|序言|前言|楔子|引子|终章|尾声|后记|番外){GAP}{TITLE}"),
)
SENTENCE_ENDS = "。！？；，,.!?;"
TRIMMED = " \t　\r﻿"
NUMERALS = "零〇一二三四五六七八九两壹贰叁肆伍陆柒捌玖"
NUMERAL_VALUES = "001234567892123456789"
UNITS = {"十": 10, "百": 100, "千": 1000, "拾": 10, "佰": 100, "仟": 1000}


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def is_readable(c: Column) -> Column:
    """Not blank, and at most max(5, length / 100) control characters other than tab and newline."""
    controls = F.length(F.regexp_replace(c, r"[^\x00-\x08\x0B-\x1F]+", ""))
    return F.coalesce(c.rlike(rf"[^{SPACE}]") & (controls <= F.greatest(F.lit(5), F.floor(F.length(c) / 100))), F.lit(False))


def collapse(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"[{SPACE}]+", " "), "^ | $", "")


def preview(c: Column, limit: int) -> Column:
    short = collapse(c)
    return F.when(F.length(short) > limit, F.concat(F.substring(short, 1, limit), F.lit("…"))).otherwise(short)


def stable_id(prefix: str, *parts: Column) -> Column:
    text = F.concat_ws("\x1f", *[p.cast("string") for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(text, 256), 1, 16))


def content_fingerprint(c: Column) -> Column:
    return F.sha2(c, 256)


def row_fingerprint(*names: str) -> Column:
    """Hash of the named columns as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(names))), 256)


def heading_title(line: Column) -> Column:
    return F.btrim(line, F.lit(TRIMMED))


def classify_heading(title: Column, patterns=HEADINGS) -> Column:
    """Kind of a trimmed line, by the first pattern that it matches whole; null if it is no heading."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        kind = F.when(title.rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    ends = F.instr(F.lit(SENTENCE_ENDS), F.right(title, F.lit(1))) > 0
    return F.when((title != "") & ~ends, kind)


def parse_number(c: Column) -> Column:
    """Digits (full width too), positional numerals, or numerals with units; null if none of these."""
    plain = F.translate(c, "０１２３４５６７８９", "0123456789")
    positional = F.translate(plain, NUMERALS, NUMERAL_VALUES)
    digit = lambda x: F.try_to_number(F.translate(x, NUMERALS, NUMERAL_VALUES), F.lit("9")).cast("bigint")
    unit = lambda x: F.coalesce(*[F.when(x == u, F.lit(n)) for u, n in UNITS.items()])
    zero = F.lit(0).cast("bigint")

    def step(acc: Column, x: Column) -> Column:
        is_digit = F.instr(F.lit(NUMERALS), x) > 0
        one = F.when(acc["d"] == 0, F.lit(1)).otherwise(acc["d"])
        return F.struct(
            F.when(x == "万", acc["t"] + (acc["s"] + acc["d"]) * 10000).otherwise(acc["t"]).alias("t"),
            F.when(x == "万", zero).when(unit(x).isNotNull(), acc["s"] + one * unit(x)).otherwise(acc["s"]).alias("s"),
            F.when(is_digit, digit(x)).otherwise(zero).alias("d"),
        )

    start = F.struct(zero.alias("t"), zero.alias("s"), zero.alias("d"))
    with_units = F.aggregate(F.split(plain, ""), start, step, lambda acc: acc["t"] + acc["s"] + acc["d"])
    return (
        F.when(plain.rlike("^[0-9]{1,18}$"), plain.try_cast("bigint"))
        .when(plain.rlike(f"^[{NUMERALS}]{{1,18}}$"), positional.try_cast("bigint"))
        .when(plain.rlike(f"^[{NUMERALS}{''.join(UNITS)}万]+$"), with_units)
    )


def heading_number(title: Column, kind: Column) -> Column:
    chinese = F.regexp_extract(title, f"第({NUMBER})[章节回部篇集]", 1)
    english = F.regexp_extract(title, r"(?i:chapter)[ \t\x{3000}]+([0-9０-９]+)", 1)
    return F.when(kind == "chapter", parse_number(F.when(chinese != "", chinese).otherwise(english)))


def strip_code_fence(c: Column) -> Column:
    """Model output without a leading line of three backticks and the closing three."""
    body = F.regexp_replace(F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", ""), r"^```[^\n]*\n", "")
    return F.regexp_replace(F.regexp_replace(body, r"```$", ""), rf"^[{SPACE}]+|[{SPACE}]+$", "")


def safe_filename(c: Column, extension: str, default: str = "book") -> Column:
    stem = F.regexp_replace(F.regexp_replace(c, r"(?i)\.txt$", ""), r'[<>:"/\\|?*\x00-\x1F]', "_")
    stem = F.btrim(stem, F.lit(" ._"))
    return F.concat(F.substring(F.coalesce(F.nullif(stem, F.lit("")), F.lit(default)), 1, 120), F.lit(f"-全书细纲.{extension}"))


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def phase(status: Column) -> Column:
    """Progress phase of a task state. The states and phases are fixed values."""
    phases = {"pending": "queued", "running": "summarizing", "merging": "merging", "finalizing": "finalizing",
              "completed": "completed", "failed": "failed", "cancelled": "cancelled", "interrupted": "failed"}
    out = F.lit("queued")
    for state, name in phases.items():
        out = F.when(status == state, name).otherwise(out)
    return out


def is_terminal(status: Column) -> Column:
    return F.coalesce(status.isin("completed", "failed", "cancelled", "interrupted"), F.lit(False))
