"""Model calls as jobs: request tables in, response and attempt tables out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_code_fence
from ..functions.tokens import token_count

CONTRACTS = {
    "batch": "Return one JSON object: summary, key_events, characters, worldbuilding.",
    "merge": "Return one JSON object: summary, storylines, characters, conflicts.",
    "final": "Return one JSON object: overall_summary, chapter_outline, storylines, unresolved_items.",
    "planning": "Return one JSON object: tasks.", "domain": "Return one JSON object: items.", "review": "Return one JSON object: action.",
}
SOURCES = "struct<input_ids:array<string>,batch_ids:array<string>,chapter_ids:array<string>>"
ITEM = f"struct<description:string,sources:{SOURCES},confidence:string>"
SUMMARY = f"struct<summary:string,claims:array<{ITEM}>>"


class Client(Protocol):
    def generate(self, prompt: str) -> dict[str, Any]:
        """content, model, request_id, input_tokens, output_tokens; raises CallError."""


class CallError(Exception):
    def __init__(self, code: str, retryable: bool):
        super().__init__(code)
        self.code, self.retryable = code, retryable


def build_requests(materials: DataFrame, kind: str) -> DataFrame:
    """unit_id, prompt: metadata with the allowed ids as JSON, the output contract and the delimited content.

    materials: unit_id, book_id, allowed_ids, content. The content is data; nothing in it is an instruction.
    """
    meta = F.to_json(F.struct(F.lit(kind).alias("kind"), "book_id", "unit_id", "allowed_ids"))
    prompt = F.concat(meta, F.lit("\n" + CONTRACTS[kind] + "\n<untrusted_content>\n"), F.col("content"), F.lit("\n</untrusted_content>"))
    return materials.select("unit_id", "book_id", "allowed_ids", prompt.alias("prompt"))


def over_budget(requests: DataFrame, limit: int, instructions: str = "") -> DataFrame:
    """Requests that cannot be sent: unit_id, tokens, code, retryable."""
    tokens = token_count(F.concat(F.lit(instructions), F.col("prompt")))
    return requests.select("unit_id", tokens.alias("tokens")).filter(F.col("tokens") > limit).select(
        "unit_id", "tokens", F.lit("request_over_budget").alias("code"), F.lit(False).alias("retryable")
    )


def mock_generate(requests: DataFrame) -> DataFrame:
    """A fixed response per prompt: fingerprint, half its length as tokens, an id from the fingerprint."""
    mark = F.substring(F.sha2("prompt", 256), 1, 12)
    return requests.select(
        "unit_id", F.concat(F.lit("mock:"), mark).alias("content"), F.lit("mock").alias("model"), F.concat(F.lit("mock_text_"), mark).alias("request_id"),
        F.greatest(F.lit(1), F.floor(F.length("prompt") / 2)).cast("bigint").alias("input_tokens"),
        F.lit(None).cast("string").alias("code"),
    )


def generate(requests: DataFrame, client_factory: Callable[[], Client], concurrency: int, max_retries: int = 2, base_delay: float = 0.25, timeout: float = 60.0) -> DataFrame:
    """unit_id, content, model, request_id, tokens, code and attempts, calling a client once per row.

    One client per task, `concurrency` tasks at once. Only retryable errors are tried again, after
    base_delay * 2^attempt; an attempt that takes more than `timeout` seconds is one ("timeout"). What a
    client raises beside CallError is that row's error ("client_error"), not the job's. Calls are side effects: write the result before using it twice.
    """
    schema = (
        "unit_id string, content string, model string, request_id string, input_tokens bigint, output_tokens bigint, code string, "
        "attempts array<struct<attempt:int,status:string,code:string,duration_ms:bigint>>"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, pool = client_factory(), ThreadPoolExecutor(1)
        for batch in batches:
            rows = []
            for unit, prompt in zip(batch["unit_id"], batch["prompt"]):
                attempts: list[dict] = []
                got: dict[str, Any] = {}
                code = None
                for attempt in range(max_retries + 1):
                    began = time.monotonic()
                    try:
                        got, code = pool.submit(client.generate, prompt).result(timeout), None
                    except CallError as e:
                        code, again = e.code, e.retryable
                    except FutureTimeout:
                        code, again = "timeout", True
                        pool = ThreadPoolExecutor(1)  # the late call keeps the old one
                    except Exception:
                        code, again = "client_error", False
                    spent = int((time.monotonic() - began) * 1000)
                    attempts.append({"attempt": attempt + 1, "status": "ok" if code is None else "error", "code": code, "duration_ms": spent})
                    if code is None or not again or attempt == max_retries:
                        break
                    time.sleep(base_delay * 2**attempt)
                rows.append((unit, *(got.get(k) for k in ("content", "model", "request_id", "input_tokens", "output_tokens")), code, attempts))
            yield pd.DataFrame(rows, columns=["unit_id", "content", "model", "request_id", "input_tokens", "output_tokens", "code", "attempts"])

    return requests.select("unit_id", "prompt").repartition(concurrency).mapInPandas(run, schema)


def trace_of(responses: DataFrame) -> DataFrame:
    """One trace record for each attempt of generate()."""
    return responses.select("unit_id", F.explode("attempts").alias("a")).select("unit_id", F.lit("call").alias("kind"), "a.attempt", "a.status", "a.code", "a.duration_ms")


def normalize_responses(raw: DataFrame) -> DataFrame:
    """unit_id, content, model, request_id, input_tokens, output_tokens, error from raw provider bodies.

    Two shapes: output_text, or output[].content[].text joined by newlines; or choices[0].message, which
    must have finished with stop.
    """
    body = (
        "struct<id:string,model:string,output_text:string,output:array<struct<content:array<struct<type:string,text:string>>>>,"
        "choices:array<struct<finish_reason:string,message:struct<content:string>>>,"
        "usage:struct<input_tokens:bigint,output_tokens:bigint,prompt_tokens:bigint,completion_tokens:bigint>>"
    )
    b = raw.select("unit_id", F.from_json("body", body).alias("b"))
    parts = F.flatten(F.transform(F.coalesce(F.col("b.output"), F.array()), lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    nested = F.nullif(F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]), "\n"), F.lit(""))
    choice = F.get("b.choices", F.lit(0))
    done = F.when(choice["finish_reason"] == "stop", choice["message"]["content"])
    content = F.coalesce(F.nullif("b.output_text", F.lit("")), nested, F.nullif(done, F.lit("")))
    error = F.when(F.col("b").isNull() | (F.col("b.id").isNull() & F.col("b.model").isNull()), "invalid_json").when(
        choice.isNotNull() & ~F.coalesce(choice["finish_reason"] == "stop", F.lit(False)), "not_finished"
    ).when(content.isNull(), "empty_content")
    return b.select(
        "unit_id", F.when(error.isNull(), content).alias("content"), F.col("b.model").alias("model"), F.col("b.id").alias("request_id"),
        F.coalesce("b.usage.input_tokens", "b.usage.prompt_tokens").alias("input_tokens"),
        F.coalesce("b.usage.output_tokens", "b.usage.completion_tokens").alias("output_tokens"), error.alias("error"),
    )


def classify_failures(attempts: DataFrame) -> DataFrame:
    """attempts with code and retryable, from http_status and fault (timeout, unreachable, bad_json, empty)."""
    status = F.col("http_status")
    code = F.when(status.isNotNull() & (status >= 400), F.concat(F.lit("provider_http_"), status.cast("string"))).otherwise(F.col("fault"))
    retryable = (status == 429) | (status >= 500) | F.col("fault").isin("timeout", "unreachable")
    return attempts.withColumns({"code": code, "retryable": F.coalesce(retryable, F.lit(False))})


def _sources(item: Column) -> Column:
    """Sources of an item given as an object or as the shorthand list of input ids."""
    direct = F.try_variant_get(item, "$.sources", "array<string>")
    full = F.try_variant_get(item, "$.sources", SOURCES)
    empty = F.array().cast("array<string>")
    short = F.when(direct.isNotNull(), F.struct(direct.alias("input_ids"), empty.alias("batch_ids"), empty.alias("chapter_ids")))
    return F.coalesce(short, full)


def parse_items(responses: DataFrame, field: str) -> tuple[DataFrame, DataFrame]:
    """(unit_id, pos, description, sources, confidence; failures with a message that holds no content).

    Fences are stripped; `sources` may be an object or a list of ids.
    """
    parsed = responses.withColumn("v", F.try_parse_json(strip_code_fence(F.col("content"))))
    items = F.try_variant_get("v", f"$.{field}", "array<variant>")
    parsed = parsed.withColumn("items", items)
    failed = parsed.filter("items is null").select("unit_id", F.when(F.col("v").isNull(), "invalid_json").otherwise("missing_field").alias("code"), F.lit(f"model output has no list {field}").alias("message"))
    rows = parsed.filter("items is not null").select("unit_id", F.posexplode("items").alias("pos", "item"))
    return rows.select(
        "unit_id", "pos", F.try_variant_get("item", "$.description", "string").alias("description"), _sources(F.col("item")).alias("sources"),
        F.coalesce(F.try_variant_get("item", "$.confidence", "string"), F.lit("likely")).alias("confidence"),
    ), failed


def provenance_violations(items: DataFrame, allowed: DataFrame, cited: str = "cited") -> DataFrame:
    """unit_id, outside: ids that items of a unit cite but the unit may not; items: unit_id, cited array."""
    exploded = items.select("unit_id", F.explode(cited).alias("id")).distinct()
    may = allowed.select("unit_id", F.explode("allowed_ids").alias("id")).distinct()
    out = exploded.join(may, ["unit_id", "id"], "left_anti")
    return out.groupBy("unit_id").agg(F.array_sort(F.collect_set("id")).alias("outside"))


def mock_structured(materials: DataFrame, field: str = "claims") -> DataFrame:
    """unit_id, content: a deterministic JSON answer that cites every allowed id."""
    item = F.struct(
        F.concat(F.lit("unit "), F.col("unit_id")).alias("description"),
        F.struct(F.col("allowed_ids").alias("input_ids"), F.array().cast("array<string>").alias("batch_ids"), F.array().cast("array<string>").alias("chapter_ids")).alias("sources"),
        F.lit("likely").alias("confidence"),
    )
    return materials.select("unit_id", F.to_json(F.struct(F.concat(F.lit("summary of "), F.col("unit_id")).alias("summary"), F.array(item).alias(field))).alias("content"))
