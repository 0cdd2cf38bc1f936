"""Semantic task graphs, reviewed knowledge items, aliases, entities, relations and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stages import settled

ROUNDS = 64
# The default tasks of a book.
ROLES = (("characters", "人物"), ("relationships", "关系"), ("worldbuilding", "设定"))
MOCK_STEPS = {True: (3, 2), False: (2, 1)}  # steps and calls of the scripted review, with and without evidence


def task_levels(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """book_id, task_id, level: 0 without dependencies, else one more than the deepest; tasks of cycles are absent."""
    left = tasks.select("book_id", "task_id")
    edges = deps.join(left.withColumnRenamed("task_id", "depends_on"), ["book_id", "depends_on"], "left_semi")
    done = None
    for level in range(ROUNDS):
        open_edges = edges if done is None else edges.join(done.select("book_id", F.col("task_id").alias("depends_on")), ["book_id", "depends_on"], "left_anti")
        ready = settled(left.join(open_edges.select("book_id", "task_id"), ["book_id", "task_id"], "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            return done if done is not None else ready
        done = ready if done is None else settled(done.unionByName(ready))
        left = left.join(ready, ["book_id", "task_id"], "left_anti")
    raise RuntimeError(f"more than {ROUNDS} dependency levels")


def validate_dag(tasks: DataFrame, deps: DataFrame, most: int = 8) -> DataFrame:
    """book_id, problem, task_id: duplicate ids, missing dependencies, cycles, and books with too many tasks."""
    counts = tasks.groupBy("book_id", "task_id").count()
    twice = counts.filter("count > 1").select("book_id", F.lit("duplicate").alias("problem"), "task_id")
    missing = deps.join(tasks.select("book_id", F.col("task_id").alias("depends_on")), ["book_id", "depends_on"], "left_anti")
    missing = missing.select("book_id", F.lit("missing_dependency").alias("problem"), "task_id").distinct()
    single = counts.select("book_id", "task_id")
    cycle = single.join(task_levels(single, deps), ["book_id", "task_id"], "left_anti").select("book_id", F.lit("cycle").alias("problem"), "task_id")
    many = counts.groupBy("book_id").agg(F.sum("count").alias("n")).filter(F.col("n") > most)
    return twice.union(missing).union(cycle).union(many.select("book_id", F.lit("too_many").alias("problem"), F.lit(None).cast("string")))


def repair_closure(failed: DataFrame, deps: DataFrame) -> DataFrame:
    """Failed tasks and all that depend on them: book_id, task_id."""
    found = settled(failed.select("book_id", "task_id").distinct())
    front = found
    for _ in range(ROUNDS):
        step = front.withColumnRenamed("task_id", "depends_on").join(deps, ["book_id", "depends_on"]).select("book_id", "task_id").distinct()
        front = settled(step.join(found, ["book_id", "task_id"], "left_anti"))
        if front.isEmpty():
            return found
        found = settled(found.union(front))
    raise RuntimeError(f"repair reaches more than {ROUNDS} steps")


def default_semantic_plan(books: DataFrame, goal: str) -> DataFrame:
    roles = books.sparkSession.createDataFrame([(i + 1, r, z) for i, (r, z) in enumerate(ROLES)], "ordinal int, role string, title string")
    out = books.select("book_id").crossJoin(F.broadcast(roles))  # three rows
    return out.select("book_id", F.concat(F.lit("task_"), F.col("role")).alias("task_id"), "ordinal", "role", F.concat("title", F.lit("："), F.lit(goal)).alias("goal"))


def _every(n: Column, parts: int) -> Column:
    return F.greatest(F.lit(1), F.floor(n / parts))


def sample_chapters(chapters: DataFrame, about: int = 60) -> DataFrame:
    """Every max(1, n / about)-th chapter of a book: book_id, chapter_id, ordinal, title, preview of 180 characters."""
    w = Window.partitionBy("book_id")
    rows = chapters.withColumns({"__n": F.count("*").over(w), "__i": F.row_number().over(w.orderBy("ordinal")) - 1})
    return rows.filter(F.col("__i") % _every(F.col("__n"), about) == 0).select("book_id", "chapter_id", "ordinal", "title", F.substring("preview", 1, 180).alias("preview"))


def bounded_prefix(items: DataFrame, limit: int) -> DataFrame:
    """The longest prefix of each key's items (key, pos, tokens) whose tokens stay within the limit; nothing after the first overflow."""
    w = Window.partitionBy("key").orderBy("pos")
    return items.withColumn("running", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "__over", F.max(F.col("running") > limit).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).filter("not __over").drop("__over")


def expand_query(tasks: DataFrame, dep_items: DataFrame) -> DataFrame:
    """tasks with query widened by the aliases its dependencies found (task_id, pos, aliases), cut at 200 characters."""
    found = dep_items.groupBy("task_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "aliases"))), lambda x: x["aliases"]))).alias("__a"))
    out = tasks.join(found, "task_id", "left")
    wide = F.concat_ws(" ", "query", F.array_join(F.coalesce("__a", F.array().cast("array<string>")), " "))
    return out.withColumn("query", F.substring(F.rtrim(wide), 1, 200)).drop("__a")


def rank_summaries(summaries: DataFrame, hits: DataFrame, about: int = 30) -> DataFrame:
    """Batches that hold a hit chapter first, then every max(1, m / about)-th of the others: book_id, batch_no, is_hit, rank."""
    asked = hits.groupBy("book_id").agg(F.collect_set("chapter_id").alias("__hit"))
    rows = summaries.join(asked, "book_id", "left").withColumn("is_hit", F.coalesce(F.arrays_overlap("chapter_ids", "__hit"), F.lit(False)))
    w = Window.partitionBy("book_id", "is_hit")
    rows = rows.withColumns({"__i": F.row_number().over(w.orderBy("batch_no")) - 1, "__m": F.count("*").over(w)})
    rows = rows.filter(F.col("is_hit") | (F.col("__i") % _every(F.col("__m"), about) == 0))
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("is_hit"), "batch_no"))
    return rows.select("book_id", "batch_no", "is_hit", rank.alias("rank"))


def mock_domain_items(tasks: DataFrame, hits: DataFrame, first: DataFrame) -> DataFrame:
    """task_id, passage_id, quote: 100 characters of the best hit, else of the book's first passage, else no row."""
    best = hits.filter("rank = 1").select("task_id", F.col("passage_id").alias("__p"), F.col("content").alias("__c"))
    rows = tasks.join(best, "task_id", "left").join(first.select("book_id", F.col("passage_id").alias("__fp"), F.col("content").alias("__fc")), "book_id", "left")
    rows = rows.select("book_id", "task_id", F.coalesce("__p", "__fp").alias("passage_id"), F.substring(F.coalesce("__c", "__fc"), 1, 100).alias("quote"))
    return rows.filter("passage_id is not null")


def downgrade_unverified(items: DataFrame, checks: DataFrame) -> DataFrame:
    """items with classification uncertain unless all their quotes (item_id, valid) hold and there is one."""
    ok = checks.groupBy("item_id").agg(F.bool_and("valid").alias("__ok"))
    rows = items.join(ok, "item_id", "left")
    return rows.withColumn("classification", F.when(F.coalesce("__ok", F.lit(False)), F.col("classification")).otherwise("uncertain")).drop("__ok")


def review_mock(items: DataFrame, checks: DataFrame) -> DataFrame:
    """item_id, verdict, steps, calls of the scripted review: supported if the item's first quote is valid."""
    first = checks.groupBy("item_id").agg(F.min_by("valid", "pos").alias("__v"))
    rows = items.select("item_id").join(first, "item_id", "left")
    has = F.col("__v").isNotNull()
    pick = lambda i: F.when(has, MOCK_STEPS[True][i]).otherwise(MOCK_STEPS[False][i])
    return rows.select("item_id", F.when(F.coalesce("__v", F.lit(False)), "supported").otherwise("uncertain").alias("verdict"), pick(0).alias("steps"), pick(1).alias("calls"))


def review_items(items: DataFrame, ask, verify, search, write, max_steps: int = 4, call_budget: int = 3) -> DataFrame:
    """item_id, verdict, steps, calls by a policy: at most max_steps rounds over all open items at once.

    ask(open items with observations) returns item_id, action (search, verify or finish), argument,
    verdict; verify and search take its rows and return item_id, observation, valid. Supported only if
    some quote was verified; out of steps or calls: uncertain. write(df, name) makes each round a table.
    """
    zero = F.lit(0)
    now = items.select("item_id", zero.alias("steps"), zero.alias("calls"), F.lit(False).alias("verified"), F.array().cast("array<string>").alias("observations"), F.lit(None).cast("string").alias("verdict"))
    for step in range(1, max_steps + 1):
        now = write(now, f"review-{step}")
        going = now.filter("verdict is null")
        asked = write(ask(going), f"asked-{step}")
        tools = asked.filter("action <> 'finish'")
        seen = write(verify(tools.filter("action = 'verify'")).unionByName(search(tools.filter("action = 'search'"))), f"seen-{step}")
        both = now.join(asked.select("item_id", "action", F.col("verdict").alias("__said")), "item_id", "left").join(seen, "item_id", "left")
        open_ = F.col("verdict").isNull()
        tool = F.coalesce(F.col("action").isin("verify", "search"), F.lit(False))
        spent = F.col("calls") + F.when(open_ & tool, 1).otherwise(0)
        over = spent > call_budget
        good = F.col("verified") | F.coalesce("valid", F.lit(False))
        said = F.when((F.col("__said") == "supported") & good, "supported").otherwise("uncertain")
        now = both.select(
            "item_id", (F.col("steps") + F.when(open_, 1).otherwise(0)).alias("steps"), F.least(spent, F.lit(call_budget)).alias("calls"),
            F.when(open_ & ~over, good).otherwise(F.col("verified")).alias("verified"),
            F.when(F.col("observation").isNull(), F.col("observations")).otherwise(F.concat("observations", F.array("observation"))).alias("observations"),
            F.when(~open_, F.col("verdict")).when(F.col("action") == "finish", said).when(over, "uncertain").alias("verdict"),
        )
    return now.select("item_id", F.coalesce("verdict", F.lit("uncertain")).alias("verdict"), "steps", "calls")


def review_budget(items: DataFrame, limit: int = 32) -> tuple[DataFrame, DataFrame]:
    """(the first `limit` items of each book by seq; verdict rows of the others: uncertain, steps 0)."""
    rows = items.withColumn("__n", F.row_number().over(Window.partitionBy("book_id").orderBy("seq")))
    rest = rows.filter(F.col("__n") > limit).select("book_id", "item_id", F.lit("uncertain").alias("verdict"), F.lit(0).alias("steps"))
    return rows.filter(F.col("__n") <= limit).drop("__n"), rest


def resolve_aliases(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """book_id, alias, subject, ambiguous: aliases of supported items; one with several subjects maps to nothing."""
    ok = items.join(reviews.filter("verdict = 'supported'").select("item_id"), "item_id", "left_semi")
    pairs = ok.select("book_id", "subject", F.explode("aliases").alias("alias"))
    out = pairs.groupBy("book_id", "alias").agg(F.min("subject").alias("__s"), F.max("subject").alias("__t"))
    same = F.col("__s") == F.col("__t")
    return out.select("book_id", "alias", F.when(same, F.col("__s")).alias("subject"), (~same).alias("ambiguous"))


def _canonical(items: DataFrame, alias_map: DataFrame) -> DataFrame:
    m = alias_map.filter("subject is not null").select("book_id", F.col("alias").alias("subject"), F.col("subject").alias("__to"))
    return items.join(m, ["book_id", "subject"], "left").withColumn("canonical", F.coalesce("__to", "subject")).drop("__to")


def entities(items: DataFrame, alias_map: DataFrame) -> DataFrame:
    """book_id, canonical, names: sorted names of each subject, its unambiguous aliases included."""
    named = _canonical(items, alias_map).select("book_id", "canonical", F.col("subject").alias("name"))
    more = alias_map.filter("subject is not null").select("book_id", F.col("subject").alias("canonical"), F.col("alias").alias("name"))
    return named.union(more).groupBy("book_id", "canonical").agg(F.array_sort(F.collect_set("name")).alias("names"))


def relation_history(items: DataFrame, alias_map: DataFrame) -> DataFrame:
    """book_id, canonical, predicate, object, chapters, classification: every value kept, as a timeline by seq."""
    return _canonical(items, alias_map).select("book_id", "seq", "canonical", "predicate", "object", F.array_distinct("chapters").alias("chapters"), "classification")


def conflicts(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """book_id, kind, item_id, name: unsupported items, and alias occurrences from the first mismatch on."""
    told = items.join(reviews.select("item_id", "verdict"), "item_id", "left").withColumn("__ok", F.coalesce(F.col("verdict") == "supported", F.lit(False)))
    bad = told.filter("not __ok").select("book_id", F.lit("unsupported").alias("kind"), "item_id", F.col("subject").alias("name"))
    uses = told.filter("__ok").select("book_id", "item_id", "seq", "subject", F.explode("aliases").alias("name"))
    w = Window.partitionBy("book_id", "name").orderBy("seq")
    uses = uses.withColumn("__first", F.first("subject").over(w))
    from_ = F.min(F.when(F.col("subject") != F.col("__first"), F.col("seq"))).over(Window.partitionBy("book_id", "name"))
    uses = uses.withColumn("__from", from_).filter("seq >= __from")
    return bad.union(uses.select("book_id", F.lit("ambiguous_alias"), "item_id", "name"))


def knowledge_report(items: DataFrame, reviews: DataFrame, checks: DataFrame) -> DataFrame:
    """book_id, items, n_supported, fingerprint: unsupported items lose aliases and become uncertain, supported ones keep verified evidence only.

    checks: item_id, pos, quote, valid.
    """
    good = checks.filter("valid").groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "quote"))), lambda x: x["quote"]).alias("evidence"))
    rows = items.join(reviews.select("item_id", "verdict"), "item_id", "left").join(good, "item_id", "left")
    ok = F.coalesce(F.col("verdict") == "supported", F.lit(False))
    none = F.array().cast("array<string>")
    one = F.struct(
        "seq", "item_id", "subject", "predicate", "object", F.when(ok, F.col("aliases")).otherwise(none).alias("aliases"),
        F.when(ok, F.col("classification")).otherwise("uncertain").alias("classification"), F.when(ok, F.coalesce("evidence", none)).otherwise(none).alias("evidence"),
    )
    out = rows.groupBy("book_id").agg(F.array_sort(F.collect_list(one)).alias("items"), F.count_if(ok).alias("n_supported"))
    return out.withColumn("fingerprint", F.sha2(F.to_json("items"), 256))
