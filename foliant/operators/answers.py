"""Model answers of fixed nested schemas: batch summaries, merged summaries and final outlines.

A schema is a table of fields. Two sets of expressions are made of it: what a JSON answer does wrong, as
places and codes, and the typed answer. Both run on VARIANT values with built-in functions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_code_fence

# The fields of answers, their limits in characters and their choices.
CONFIDENCE = ("certain", "likely", "uncertain")
CATEGORY = ("location", "faction", "rule", "power_system", "item", "history", "other")


class Text(NamedTuple):
    most: int


class Texts(NamedTuple):
    least: int = 0


class Choice(NamedTuple):
    values: tuple
    default: str | None = None


class Sources(NamedTuple):
    """An object of input_ids (one at least), batch_ids and chapter_ids; a list of ids stands for input_ids."""


class Items(NamedTuple):
    fields: dict


SURE = Choice(CONFIDENCE, "certain")
_CITED = {"chapter_ids": Texts(1), "source_chunk_ids": Texts(1), "confidence": SURE}
_CLAIM = Items({"description": Text(4_000), **_CITED})
SUMMARY = {
    "overview": Text(12_000), "key_events": _CLAIM,
    "characters": Items({"name": Text(200), "summary": Text(4_000), "relationship_changes": Texts(), **_CITED}),
    "worldbuilding": Items({"category": Choice(CATEGORY), "name": Text(300), "description": Text(4_000), **_CITED}),
    "foreshadowing": _CLAIM, "unresolved_items": _CLAIM,
}
_POINT = Items({"description": Text(8_000), "sources": Sources(), "confidence": SURE})
_RANGES = Items({"chapter_range": Text(500), "summary": Text(12_000), "key_events": Texts(), "sources": Sources()})
_PEOPLE = Items({"name": Text(300), "summary": Text(12_000), "relationships": Texts(), "changes": Texts(), "sources": Sources(), "confidence": SURE})
_WORLD = Items({"category": Choice(CATEGORY), "name": Text(300), "description": Text(12_000), "sources": Sources(), "confidence": SURE})
MERGE = {
    "overview": Text(20_000), "chapter_outline": _RANGES, "key_events": _POINT, "characters": _PEOPLE, "worldbuilding": _WORLD,
    "foreshadowing": _POINT, "unresolved_items": _POINT, "uncertainties": _POINT,
}
OUTLINE = {
    "overall_summary": Text(40_000), "chapter_outline": _RANGES,
    "storylines": Items({"name": Text(300), "summary": Text(12_000), "developments": Texts(), "sources": Sources()}),
    "characters": _PEOPLE, "worldbuilding": _WORLD, "foreshadowing": _POINT, "unresolved_items": _POINT, "conflicts_and_uncertainties": _POINT,
}

WRONG = "array<struct<at:string,code:string>>"


def _get(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _kind(x: Column) -> Column:
    """STRING, OBJECT<...>, ARRAY<...> and so on; VOID for a JSON null."""
    return F.schema_of_variant(x)


def _wrong(at: Column, code: Column) -> Column:
    """One violation, or none where the code is null."""
    return F.when(code.isNotNull(), F.array(F.struct(at.alias("at"), code.alias("code")))).otherwise(F.array().cast(WRONG))


def _list_code(x: Column, v: Column, name: str, least: int) -> Column:
    words = _get(v, name, "array<variant>")
    bad = F.exists(words, lambda e: F.coalesce(_kind(e), F.lit("VOID")) != "STRING")
    return F.when(x.isNull(), F.when(F.lit(least > 0), "missing")).when(~_kind(x).startswith("ARRAY") | bad, "wrong_type").when(F.size(words) < least, "too_short")


def _of_item(list_at: Column, fields: dict, strict: bool):
    def one(e: Column, i: Column) -> Column:
        place = F.concat(list_at, F.lit("."), i.cast("string"))
        return F.when(_kind(e).startswith("OBJECT"), _violations(e, F.concat(place, F.lit(".")), fields, strict)).otherwise(_wrong(place, F.lit("wrong_type")))

    return one


def _violations(v: Column, at: Column, fields: dict, strict: bool) -> Column:
    found = []
    for name, spec in fields.items():
        x, here = _get(v, name), F.concat(at, F.lit(name))
        if isinstance(spec, Text):
            length = F.length(_get(v, name, "string"))
            found.append(_wrong(here, F.when(x.isNull(), "missing").when(_kind(x) != "STRING", "wrong_type").when(length < 1, "too_short").when(length > spec.most, "too_long")))
        elif isinstance(spec, Texts):
            found.append(_wrong(here, _list_code(x, v, name, spec.least)))
        elif isinstance(spec, Choice):
            ok = (_kind(x) == "STRING") & _get(v, name, "string").isin(*spec.values)
            found.append(_wrong(here, F.when(x.isNull(), F.lit(None if spec.default else "missing")).when(~ok, "not_allowed")))
        elif isinstance(spec, Sources):
            short = _list_code(x, v, name, 1)
            parts = {"input_ids": Texts(1), "batch_ids": Texts(), "chapter_ids": Texts()}
            inside = _violations(x, F.concat(here, F.lit(".")), parts, strict)
            whole = _wrong(here, F.when(x.isNull(), "missing").otherwise("wrong_type"))
            found.append(F.when(_kind(x).startswith("ARRAY"), _wrong(here, short)).when(_kind(x).startswith("OBJECT"), inside).otherwise(whole))
        else:
            inside = F.flatten(F.transform(_get(v, name, "array<variant>"), _of_item(here, spec.fields, strict)))
            found.append(F.when(x.isNull(), F.array().cast(WRONG)).when(_kind(x).startswith("ARRAY"), inside).otherwise(_wrong(here, F.lit("wrong_type"))))
    if strict:
        keys = F.array_except(F.json_object_keys(F.to_json(v)), F.array(*map(F.lit, fields)))
        found.append(F.transform(keys, lambda k: F.struct(at.alias("at"), F.lit("unknown_field").alias("code"))))  # the answer's own words stay out
    return F.flatten(F.array(*found))


def _typed_item(fields: dict):
    return lambda e: F.struct(*_typed(e, fields))


def _typed(v: Column, fields: dict) -> list[Column]:
    none = F.array().cast("array<string>")
    out = []
    for name, spec in fields.items():
        if isinstance(spec, Text):
            x = _get(v, name, "string")
        elif isinstance(spec, Texts):
            x = F.coalesce(_get(v, name, "array<string>"), none)
        elif isinstance(spec, Choice):
            x = F.coalesce(_get(v, name, "string"), F.lit(spec.default))
        elif isinstance(spec, Sources):
            ids = lambda part, name=name: _get(v, f"{name}.{part}", "array<string>")
            x = F.struct(F.coalesce(_get(v, name, "array<string>"), ids("input_ids")).alias("input_ids"), F.coalesce(ids("batch_ids"), none).alias("batch_ids"), F.coalesce(ids("chapter_ids"), none).alias("chapter_ids"))
        else:
            x = F.coalesce(F.transform(_get(v, name, "array<variant>"), _typed_item(spec.fields)), F.array())
        out.append(x.alias(name))
    return out


def _cited(fields: dict, *path: str) -> Column:
    """Ids that all items of a typed answer cite."""
    lists = [n for n, s in fields.items() if isinstance(s, Items)]

    def of(item: Column) -> Column:
        for p in path:
            item = item[p]
        return item

    return F.flatten(F.concat(*[F.transform(F.col(f"answer.{n}"), of) for n in lists]))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that the planner keeps as it is: filters and later columns read it and do not compute it again."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _parsed(responses: DataFrame, kind: str, fields: dict, cited: dict[str, tuple], strict: bool) -> tuple[DataFrame, DataFrame]:
    rows = responses.select("unit_id", *[c for c in cited if c in responses.columns], F.try_parse_json(strip_code_fence(F.col("content"))).alias("v"))
    whole = F.when(F.col("v").isNull(), _wrong(F.lit(""), F.lit("invalid_json"))).when(
        _kind(F.col("v")).startswith("OBJECT"), _violations(F.col("v"), F.lit(""), fields, strict)).otherwise(_wrong(F.lit(""), F.lit("wrong_type")))
    rows = _once(_once(rows, "wrong", whole), "answer", F.when(F.size("wrong") == 0, F.struct(*_typed(F.col("v"), fields)))).drop("v")
    for column, path in cited.items():
        if column in responses.columns:
            out = F.size(F.array_except(_cited(fields, *path), F.coalesce(F.col(column), F.array().cast("array<string>")))) > 0
            checked = F.when((F.size("wrong") == 0) & out, _wrong(F.lit(path[-1]), F.lit("outside"))).otherwise(F.col("wrong"))
            rows = _once(rows, "checked", checked).drop("wrong").withColumnRenamed("checked", "wrong")
    good = rows.filter(F.size("wrong") == 0).select("unit_id", "answer.*")
    first = F.get("wrong", F.lit(0))
    place = F.when(first["at"] == "", F.lit("")).otherwise(F.concat(F.lit(" at "), F.regexp_replace(first["at"], r"\.$", "")))
    more = F.when(F.size("wrong") > 1, F.concat(F.lit(" ("), F.size("wrong").cast("string"), F.lit(" in all)"))).otherwise(F.lit(""))
    bad = rows.filter(F.size("wrong") > 0)
    return good, bad.select("unit_id", first["code"].alias("code"), F.regexp_replace(first["at"], r"\.$", "").alias("at"), F.size("wrong").alias("n_wrong"), F.concat(F.lit(f"{kind}: "), first["code"], place, more).alias("message"))


def parse_summaries(responses: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(unit_id and the fields of SUMMARY; failures: unit_id, code, at, n_wrong, message) of answers (unit_id, content).

    Fences are stripped. Defaults stand where the schema has them: no items, no texts, confidence certain.
    strict: fields that the schema does not know are a failure, otherwise they are ignored. Items may cite only
    allowed_chapters and allowed_chunks where responses has these columns. A message names the place of the first
    violation (fields, and numbers of items from 0) and no content. Null content is no JSON; ties: none.
    """
    return _parsed(responses, "summary", SUMMARY, {"allowed_chapters": ("chapter_ids",), "allowed_chunks": ("source_chunk_ids",)}, strict)


def parse_merges(responses: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """As parse_summaries, of MERGE: items cite sources, given as an object or as a list of input ids, within allowed_ids."""
    return _parsed(responses, "merge", MERGE, {"allowed_ids": ("sources", "input_ids")}, strict)


def parse_outlines(responses: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """As parse_merges, of OUTLINE."""
    return _parsed(responses, "outline", OUTLINE, {"allowed_ids": ("sources", "input_ids")}, strict)
