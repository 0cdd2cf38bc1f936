"""Merging summaries level by level into one outline per book, with provenance down to chapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .planning import next_fit

LEVELS = ("certain", "likely", "uncertain")
ROUNDS = 64


def materials(summaries: DataFrame) -> DataFrame:
    """book_id, pos, input_id, fingerprint, label, batch_ids, chapter_ids, payload of ordered summaries."""
    order = Window.partitionBy("book_id").orderBy("batch_no")
    return summaries.select(
        "book_id", F.row_number().over(order).alias("pos"), F.col("batch_id").alias("input_id"), F.sha2("payload", 256).alias("fingerprint"),
        F.col("range_label").alias("label"), F.array("batch_id").alias("batch_ids"), "chapter_ids", "payload",
    )


def knowledge_materials(domains: DataFrame, batches: DataFrame) -> DataFrame:
    """book_id, domain, chapter_ids, batch_ids: domains with the batches that share a chapter of their evidence."""
    cited = domains.select("book_id", "domain", F.explode("chapter_ids").alias("chapter_id")).distinct()
    holds = batches.select("book_id", "batch_no", "batch_id", F.explode("chapter_ids").alias("chapter_id"))
    met = cited.join(holds, ["book_id", "chapter_id"])
    return met.groupBy("book_id", "domain").agg(
        F.array_sort(F.collect_set("chapter_id")).alias("chapter_ids"),
        F.transform(F.array_sort(F.collect_set(F.struct("batch_no", "batch_id"))), lambda x: x["batch_id"]).alias("batch_ids"),
    )


def compact_payload(items: Column, input_id: Column) -> Column:
    """Items whose sources are only the direct input."""
    empty = F.array().cast("array<string>")
    return F.transform(items, lambda x: x.withField("sources", F.struct(F.array(input_id).alias("input_ids"), empty.alias("batch_ids"), empty.alias("chapter_ids"))))


def fits_final(rows: DataFrame, limit: int, overhead: int = 0) -> DataFrame:
    """book_id, tokens, fits: whether all inputs of a book go into one final request (64 tokens spare)."""
    return rows.groupBy("book_id").agg((F.sum("tokens") + overhead).alias("tokens")).withColumn("fits", F.col("tokens") <= limit - 64)


def pack_merge_groups(rows: DataFrame, limit: int, overhead: int) -> tuple[DataFrame, DataFrame]:
    """(rows with group; books whose merge cannot go on: an input too large, or no reduction)."""
    too_large = rows.filter(F.col("tokens") + overhead > limit).select("book_id", F.lit("merge_input_too_large").alias("code")).distinct()
    ok = rows.join(too_large, "book_id", "left_anti")
    groups = next_fit(ok, "book_id", "pos", "tokens", limit, first=overhead)
    sizes = groups.groupBy("book_id").agg(F.max("group").alias("n_groups"), F.count("*").alias("n"))
    stuck = sizes.filter("n_groups = n").select("book_id", F.lit("merge_cannot_reduce").alias("code"))
    return ok.join(groups, ["book_id", "pos"]).join(stuck, "book_id", "left_anti"), too_large.unionByName(stuck)


def ordered_unique_sources(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, batch_ids, chapter_ids: distinct ids of a group's inputs, in order of first appearance."""
    packed = F.array_sort(F.collect_list(F.struct("pos", "batch_ids", "chapter_ids")))
    rows = rows.groupBy(*keys).agg(packed.alias("x"))
    flat = lambda name: F.array_distinct(F.flatten(F.transform("x", lambda s: s[name])))
    return rows.select(*keys, flat("batch_ids").alias("batch_ids"), flat("chapter_ids").alias("chapter_ids"))


def expand_sources(items: DataFrame, inputs: DataFrame) -> DataFrame:
    """item_id, batch_ids, chapter_ids: leaves behind the direct inputs that items cite (item_id, book_id, input_ids)."""
    cited = items.select("item_id", "book_id", F.explode("input_ids").alias("input_id")).distinct()
    met = cited.join(inputs.select("book_id", "input_id", "pos", "batch_ids", "chapter_ids"), ["book_id", "input_id"])
    return ordered_unique_sources(met, "item_id")


def level(confidence: Column) -> Column:
    """0 certain, 1 likely or inference, 2 uncertain."""
    return F.when(confidence == "certain", 0).when(confidence.isin("likely", "inference"), 1).otherwise(2)


def confidence_floor(items: DataFrame, inputs: DataFrame) -> DataFrame:
    """items with confidence no higher than the worst of the inputs that they cite.

    items: item_id, book_id, input_ids, confidence, description; inputs: book_id, input_id, worst (a
    level). Items without a confidence get a label before their text instead.
    """
    cited = items.select("item_id", "book_id", F.explode("input_ids").alias("input_id")).distinct()
    worst = cited.join(inputs.select("book_id", "input_id", "worst"), ["book_id", "input_id"]).groupBy("item_id").agg(F.max("worst").alias("worst"))
    rows = items.join(worst, "item_id", "left").withColumn("__l", F.greatest(level(F.col("confidence")), F.coalesce("worst", F.lit(0))))
    name = F.element_at(F.array(*map(F.lit, LEVELS)), F.col("__l") + 1)
    label = F.concat(F.lit("["), F.element_at(F.array(*map(F.lit, LEVELS)), F.coalesce("worst", F.lit(0)) + 1), F.lit("] "))
    text = F.when(F.col("confidence").isNull() & (F.coalesce("worst", F.lit(0)) > 0) & ~F.startswith("description", label), F.concat(label, F.col("description"))).otherwise(F.col("description"))
    return rows.withColumns({"confidence": F.when(F.col("confidence").isNotNull(), name), "description": text}).drop("worst", "__l")


def merge_tree(rows: DataFrame, limit: int, overhead: int, merge: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(root inputs per book with level; errors). All books climb together; a book leaves when its inputs fit.

    rows: materials() with tokens. merge(groups: book_id, group, inputs) returns book_id, group, payload,
    tokens and is called once per level; write(df, name) makes a level a table, so no call is repeated.
    """
    roots, errors, now = [], [], rows.withColumn("level", F.lit(0))
    for depth in range(1, ROUNDS):
        fit = fits_final(now, limit, overhead)
        done = now.join(fit.filter("fits").select("book_id"), "book_id", "left_semi")
        roots.append(write(done, f"roots-{depth}"))
        rest = write(now.join(fit.filter("not fits").select("book_id"), "book_id", "left_semi"), f"inputs-{depth}")
        if rest.isEmpty():
            break
        grouped, failed = pack_merge_groups(rest, limit, overhead)
        errors.append(write(failed, f"errors-{depth}"))
        grouped = write(grouped, f"groups-{depth}")
        inputs = grouped.groupBy("book_id", "group").agg(
            F.array_sort(F.collect_list(F.struct("pos", "input_id", "fingerprint", "payload"))).alias("inputs"),
            F.concat_ws(" → ", F.min_by("label", "pos"), F.max_by("label", "pos")).alias("label"),
        )
        answered = write(merge(inputs), f"merged-{depth}")
        finger = F.sha2(F.array_join(F.transform("inputs", lambda x: x["fingerprint"]), "\x1f"), 256)
        node = F.concat(F.lit("merge_"), F.substring(F.sha2(F.concat(F.lit(f"{depth}:"), finger), 256), 1, 16))
        joined = inputs.join(answered, ["book_id", "group"]).join(ordered_unique_sources(grouped, "book_id", "group"), ["book_id", "group"])
        now = write(joined.select(
            "book_id", F.col("group").alias("pos"), node.alias("input_id"), F.sha2("payload", 256).alias("fingerprint"), "label", "batch_ids", "chapter_ids", "payload", "tokens", F.lit(depth).alias("level"),
        ), f"level-{depth}")
    else:
        raise RuntimeError(f"merging did not end in {ROUNDS} levels")
    union = lambda xs, like: xs[0] if len(xs) == 1 else xs[0].unionByName(union(xs[1:], like))
    none = rows.select("book_id", F.lit("").alias("code")).limit(0)
    return union(roots, rows), union(errors, none) if errors else none


def final_outline(books: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(book_id, payload inputs with complete coverage lists; books without any input as errors)."""
    cover = ordered_unique_sources(roots, "book_id")
    inputs = roots.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "payload"))), lambda x: x["payload"]).alias("payloads"), F.max("level").alias("levels"))
    errors = books.select("book_id").join(cover, "book_id", "left_anti").withColumn("code", F.lit("no_inputs"))
    return inputs.join(cover, "book_id"), errors
