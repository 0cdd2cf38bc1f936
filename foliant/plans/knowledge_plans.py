"""Queries of knowledge, incremental, status and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incremental as inc
from ..operators import knowledge as kn
from ..stages import settled
from ..streaming import progress as pr
from .base import query, table
from .search_plans import TRACE, trace

NODES = """
nodes as (select conv_id as book_id, 't' || turn as task_id, turn from conversations),
deps as (select book_id, 't' || turn as task_id, 't' || (turn // 2) as depends_on from nodes where turn > 0)"""


def _nodes(spark, d):
    tag = lambda c: F.concat(F.lit("t"), c.cast("string"))
    n = table(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), tag(F.col("turn")).alias("task_id"), "turn")
    deps = n.filter("turn > 0").select("book_id", "task_id", tag(F.floor(F.col("turn") / 2)).alias("depends_on"))
    return n, deps


@query("i1_validate_dag", f"""with {NODES}
select book_id, 'missing_dependency' as problem, task_id from nodes where turn = 3 and book_id % 4 = 0
union all select book_id, 'cycle', task_id from nodes where book_id % 4 = 1 and turn in (0, 1)
union all select book_id, 'cycle', task_id from nodes n where book_id % 4 = 1 and turn > 1
union all select book_id, 'duplicate', task_id from nodes where turn = 0 and book_id % 4 = 2
union all select book_id, 'too_many', null from nodes group by book_id having count(*) + case when book_id % 4 = 2 then 1 else 0 end > 8""")
def i1(spark, d):
    nodes, deps = _nodes(spark, d)
    deps = deps.union(nodes.filter("turn = 3 and book_id % 4 = 0").select("book_id", "task_id", F.lit("t99")))
    both = nodes.filter("turn = 1 and book_id % 4 = 1").select("book_id")
    deps = deps.union(both.select("book_id", F.lit("t0"), F.lit("t1")))
    tasks = nodes.union(nodes.filter("turn = 0 and book_id % 4 = 2"))
    return kn.validate_dag(tasks, deps)


@query("i2_task_levels", f"""with {NODES},
r as (with recursive r as (select book_id, task_id, 0 as level from nodes where turn = 0 union all select d.book_id, d.task_id, r.level + 1 from r join deps d on d.book_id = r.book_id and d.depends_on = r.task_id) select * from r)
select book_id, task_id, max(level) as level from r group by book_id, task_id""")
def i2(spark, d):
    return kn.task_levels(*_nodes(spark, d))


@query("i3_default_semantic_plan", """
select distinct conv_id as book_id, 'task_' || role_ as task_id, o as ordinal, role_ as role, z || '：outline' as goal
from conversations, (values (1, 'characters', '人物'), (2, 'relationships', '关系'), (3, 'worldbuilding', '设定')) v(o, role_, z)""")
def i3(spark, d):
    return kn.default_semantic_plan(table(spark, d, "conversations").select(F.col("conv_id").alias("book_id")).distinct(), "outline")


@query("i4_sample_chapters", """
select source as book_id, doc_id as chapter_id, o as ordinal, lang as title, substr(text, 1, 180) as preview from (
  select *, row_number() over (partition by source order by doc_id) as o, count(*) over (partition by source) as n from documents) where (o - 1) % greatest(1, n // 20) = 0""")
def i4(spark, d):
    from pyspark.sql import Window

    docs = table(spark, d, "documents")
    rows = docs.select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_id"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("ordinal"), F.col("lang").alias("title"), F.col("text").alias("preview"))
    return kn.sample_chapters(rows, 20)


@query("i5_bounded_prefix", """
select key, pos, running from (select conv_id as key, turn as pos, sum(length(text)) over w as running from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and current row)) where running <= 1500""")
def i5(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), F.length("text").alias("tokens"))
    return kn.bounded_prefix(rows, 1500).select("key", "pos", "running")


@query("i6_expand_query", """
with a as (select conv_id as task_id, turn, i, w from (select conv_id, turn, unnest(string_split(text, ' ')[1:3]) as w, generate_subscripts(string_split(text, ' ')[1:3], 1) as i from conversations)),
f as (select task_id, w, min(turn * 10 + i) as p from a group by task_id, w),
j as (select task_id, string_agg(w, ' ' order by p) as words from f group by task_id)
select task_id, substr(rtrim('query ' || task_id || ' ' || words), 1, 200) as query from j""")
def i6(spark, d):
    c = table(spark, d, "conversations")
    items = c.select(F.col("conv_id").alias("task_id"), F.col("turn").alias("pos"), F.slice(F.split("text", " "), 1, 3).alias("aliases"))
    tasks = c.select(F.col("conv_id").alias("task_id")).distinct().withColumn("query", F.concat(F.lit("query "), F.col("task_id").cast("string")))
    return kn.expand_query(tasks, items)


@query("i7_rank_summaries", """
with s as (select conv_id as book_id, turn as batch_no, turn % 4 = conv_id % 4 as is_hit from conversations),
n as (select *, row_number() over (partition by book_id, is_hit order by batch_no) - 1 as i, count(*) over (partition by book_id, is_hit) as m from s),
k as (select * from n where is_hit or i % greatest(1, m // 2) = 0)
select book_id, batch_no, is_hit, row_number() over (partition by book_id order by is_hit desc, batch_no) as rank from k""")
def i7(spark, d):
    c = table(spark, d, "conversations")
    tag = lambda x: F.concat(F.lit("c"), x.cast("string"))
    s = c.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("batch_no"), F.array(tag(F.col("turn") % 4)).alias("chapter_ids"))
    hits = c.select(F.col("conv_id").alias("book_id"), tag(F.col("conv_id") % 4).alias("chapter_id")).distinct()
    return kn.rank_summaries(s, hits, 2)


@query("i8_mock_domain_items", """
with t as (select conv_id, turn, text from conversations), first as (select conv_id, min_by(text, turn) as c from t where conv_id % 5 > 0 group by conv_id)
select t.conv_id || '-' || t.turn as task_id, substr(case when t.turn % 2 = 0 then t.text else f.c end, 1, 100) as quote from t left join first f using (conv_id) where t.turn % 2 = 0 or f.c is not null""")
def i8(spark, d):
    c = table(spark, d, "conversations")
    task = F.concat_ws("-", "conv_id", "turn")
    tasks = c.select(F.col("conv_id").alias("book_id"), task.alias("task_id"))
    hits = c.filter("turn % 2 = 0").select(task.alias("task_id"), F.lit(1).alias("rank"), F.lit("p").alias("passage_id"), F.col("text").alias("content"))
    first = c.filter("conv_id % 5 > 0").groupBy(F.col("conv_id").alias("book_id")).agg(F.lit("f").alias("passage_id"), F.min_by("text", "turn").alias("content"))
    return kn.mock_domain_items(tasks, hits, first).select("task_id", "quote")


# Items: one for each turn; the subject is the text's first word, the aliases are the next two.
ITEMS = """
items as (select conv_id || '-' || turn as item_id, conv_id % 20 as book_id, conv_id * 1000 + turn as seq, w[1] as subject, 'says' as predicate, w[4] as object, list_filter([w[2], w[3]], lambda x: x is not null) as aliases,
    ['c' || turn, 'c' || (turn // 2)] as chapters, 'certain' as classification, conv_id, turn from (select *, string_split(text, ' ') as w from conversations)),
reviews as (select item_id, case when (conv_id + turn) % 3 > 0 then 'supported' else 'uncertain' end as verdict from items),
checks as (select item_id, p as pos, 'q' || p as quote, not ((conv_id + turn) % 5 = 0 and p = 0) as valid from items, (values (0), (1)) v(p) where turn % 4 > 0),
ok_items as (select i.* from items i join reviews using (item_id) where verdict = 'supported'),
amap as (select book_id, alias, case when min(subject) = max(subject) then min(subject) end as subject, min(subject) <> max(subject) as ambiguous from (select book_id, subject, unnest(aliases) as alias from ok_items) group by book_id, alias)"""


def _items(spark, d):
    w = F.split("text", " ")
    pick = lambda i: F.try_element_at(w, F.lit(i))
    tag = lambda x: F.concat(F.lit("c"), x.cast("string"))
    items = table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("item_id"), (F.col("conv_id") % 20).alias("book_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        pick(1).alias("subject"), F.lit("says").alias("predicate"), pick(4).alias("object"), F.array_compact(F.array(pick(2), pick(3))).alias("aliases"),
        F.array(tag(F.col("turn")), tag(F.floor(F.col("turn") / 2))).alias("chapters"), F.lit("certain").alias("classification"), "conv_id", "turn")
    reviews = items.select("item_id", F.when((F.col("conv_id") + F.col("turn")) % 3 > 0, "supported").otherwise("uncertain").alias("verdict"))
    checks = items.filter("turn % 4 > 0").withColumn("pos", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "item_id", "pos", F.concat(F.lit("q"), F.col("pos").cast("string")).alias("quote"), (~(((F.col("conv_id") + F.col("turn")) % 5 == 0) & (F.col("pos") == 0))).alias("valid"))
    return items, reviews, checks


@query("i9_downgrade_unverified", f"with {ITEMS}, ok as (select item_id, bool_and(valid) as ok from checks group by item_id) select item_id, case when coalesce(ok, false) then classification else 'uncertain' end as classification from items left join ok using (item_id)")
def i9(spark, d):
    items, _, checks = _items(spark, d)
    return kn.downgrade_unverified(items, checks).select("item_id", "classification")


@query("i10_review_items", f"""with {ITEMS}, first as (select item_id, valid from checks where pos = 0)
select item_id, case when coalesce(valid, false) then 'supported' else 'uncertain' end as verdict, case when valid is null then 2 else 3 end as steps, case when valid is null then 1 else 2 end as calls from items left join first using (item_id)""")
def i10(spark, d):
    items, _, checks = _items(spark, d)
    return kn.review_mock(items, checks)


@query("i10_review_policy", f"""with {ITEMS}, first as (select item_id, valid from checks where pos = 0)
select item_id, case when coalesce(valid, false) then 'supported' else 'uncertain' end as verdict, 3 as steps, 2 as calls from items left join first using (item_id)""")
def i10_policy(spark, d):
    """The same verdicts from a policy that searches, verifies the first quote and finishes."""
    items, _, checks = _items(spark, d)
    first = checks.filter("pos = 0").select("item_id", "valid")

    def ask(rows):
        n = F.size("observations")
        action = F.when(n == 0, "search").when(n == 1, "verify").otherwise("finish")
        return rows.select("item_id", action.alias("action"), F.lit("").alias("argument"), F.lit("supported").alias("verdict"))

    def verify(rows):
        return rows.join(first, "item_id", "left").select("item_id", F.lit("verified").alias("observation"), F.coalesce("valid", F.lit(False)).alias("valid"))

    def search(rows):
        return rows.select("item_id", F.lit("found").alias("observation"), F.lit(False).alias("valid"))

    return kn.review_items(items, ask, verify, search, lambda df, _: settled(df))


@query("i11_review_budget", f"with {ITEMS} select book_id, item_id, 'uncertain' as verdict, 0 as steps from items qualify row_number() over (partition by book_id order by seq) > 12")
def i11(spark, d):
    return kn.review_budget(_items(spark, d)[0], 12)[1]


@query("i12_repair_closure", f"""with {NODES},
r as (with recursive r as (select book_id, task_id from nodes where turn = 1 and book_id % 2 = 0 union select d.book_id, d.task_id from r join deps d on d.book_id = r.book_id and d.depends_on = r.task_id) select * from r)
select book_id, task_id from r""")
def i12(spark, d):
    nodes, deps = _nodes(spark, d)
    return kn.repair_closure(nodes.filter("turn = 1 and book_id % 2 = 0"), deps)


@query("i13_resolve_aliases", f"with {ITEMS} select * from amap")
def i13(spark, d):
    items, reviews, _ = _items(spark, d)
    return kn.resolve_aliases(items, reviews)


@query("i14_entities", f"""with {ITEMS},
n as (select i.book_id, coalesce(m.subject, i.subject) as canonical, i.subject as name from items i left join amap m on m.book_id = i.book_id and m.alias = i.subject and m.subject is not null
  union select book_id, subject, alias from amap where subject is not null)
select book_id, canonical, list_sort(list(name)) as names from n group by book_id, canonical""")
def i14(spark, d):
    items, reviews, _ = _items(spark, d)
    return kn.entities(items, kn.resolve_aliases(items, reviews))


@query("i15_relation_history", f"""with {ITEMS}
select i.book_id, i.seq, coalesce(m.subject, i.subject) as canonical, predicate, object, case when turn = 0 then ['c0'] else chapters end as chapters, classification from items i left join amap m on m.book_id = i.book_id and m.alias = i.subject and m.subject is not null""")
def i15(spark, d):
    items, reviews, _ = _items(spark, d)
    return kn.relation_history(items, kn.resolve_aliases(items, reviews))


@query("i16_conflicts", f"""with {ITEMS},
u as (select book_id, item_id, seq, subject, unnest(aliases) as name from ok_items),
f as (select *, first_value(subject) over (partition by book_id, name order by seq) as f from u),
g as (select *, min(case when subject <> f then seq end) over (partition by book_id, name) as since from f)
select book_id, 'unsupported' as kind, item_id, subject as name from items join reviews using (item_id) where verdict <> 'supported'
union all select book_id, 'ambiguous_alias', item_id, name from g where seq >= since""")
def i16(spark, d):
    items, reviews, _ = _items(spark, d)
    return kn.conflicts(items, reviews)


@query("i17_knowledge_report", f"""with {ITEMS} select book_id, count(*) as n_items, count(case when verdict = 'supported' then 1 end) as n_supported,
  sum(case when verdict = 'supported' then len(aliases) else 0 end)::bigint as n_aliases, sum(case when verdict = 'supported' then coalesce(e, 0) else 0 end)::bigint as n_evidence
from items join reviews using (item_id) left join (select item_id, count(case when valid then 1 end) as e from checks group by item_id) using (item_id) group by book_id""")
def i17(spark, d):
    rows = kn.knowledge_report(*_items(spark, d))
    total = lambda f: F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + F.size(x[f]))
    return rows.select("book_id", F.size("items").cast("bigint").alias("n_items"), "n_supported", total("aliases").alias("n_aliases"), total("evidence").alias("n_evidence"))


@query("j1_pending_work", """
select 'p' as plan_id, o_orderkey as unit_id, md5(o_custkey::varchar) as input_fingerprint from orders where o_orderstatus <> 'F' or o_orderkey % 10 = 0""")
def j1(spark, d):
    finger = F.md5(F.col("o_custkey").cast("string").cast("binary"))
    o = table(spark, d, "orders")
    plan = o.select(F.lit("p").alias("plan_id"), F.col("o_orderkey").alias("unit_id"), finger.alias("input_fingerprint"))
    stale = F.when(F.col("o_orderkey") % 10 == 0, F.lit("old")).otherwise(finger)
    results = o.filter("o_orderstatus = 'F'").select(F.lit("p").alias("plan_id"), F.col("o_orderkey").alias("unit_id"), stale.alias("input_fingerprint"))
    return inc.pending_work(plan, results)


@query("j2_invalidate_downstream", """
with a as (select user_id as book_id, stage from (select distinct user_id from events), (values ('plan'), ('batch_summary'), ('merge'), ('outline'), ('knowledge')) v(stage)),
c as (select book_id, case when kind = 'view' then 'chunk_edit' else 'summary_edit' end as change from (select user_id as book_id, max_by(event_type, event_id) as kind from events group by user_id) where kind in ('view', 'click'))
select * from a where not exists (select 1 from c where c.book_id = a.book_id and (c.change = 'chunk_edit' or a.stage in ('merge', 'outline', 'knowledge')))""")
def j2(spark, d):
    e = table(spark, d, "events")
    stages = F.explode(F.array(*map(F.lit, ("plan", "batch_summary", "merge", "outline", "knowledge"))))
    artifacts = e.select(F.col("user_id").alias("book_id")).distinct().withColumn("stage", stages)
    last = e.groupBy(F.col("user_id").alias("book_id")).agg(F.max_by("event_type", "event_id").alias("kind")).filter("kind in ('view', 'click')")
    changes = last.select("book_id", F.when(F.col("kind") == "view", "chunk_edit").otherwise("summary_edit").alias("change"))
    return inc.invalidate_downstream(artifacts, changes)


@query("j3_summaries_revision", """
select conv_id as book_id, sha256('[' || string_agg('{"batch_no":' || turn || ',"summary":"' || md5(text) || case when turn % 2 = 0 then '","edited_at":' || turn || '}' else '"}' end, ',' order by turn) || ']') as revision from conversations group by conv_id""")
def j3(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("batch_no"), F.md5(F.col("text").cast("binary")).alias("summary"), F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("edited_at"))
    return inc.summaries_revision(rows)


@query("j4_apply_summary_edits", """
with e as (select user_id % 50 as k, max_by(event_type, (ts, event_type)) as v, max(ts) as t from events where event_type <> 'error' group by user_id % 50)
select doc_id, coalesce(v, lang) as summary, t as user_edited_at from (select doc_id, doc_id % 60 as k, lang from documents) left join e using (k)""")
def j4(spark, d):
    rows = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 60).alias("k"), F.col("lang").alias("summary"))
    edits = table(spark, d, "events").filter("event_type <> 'error'").select((F.col("user_id") % 50).alias("k"), F.col("event_type").alias("summary"), F.col("ts").alias("edited_at"))
    return inc.apply_latest(rows, edits, "k", "summary").select("doc_id", "summary", "user_edited_at")


UNITS = """
u as (select o_custkey as task_id, l_orderkey * 10 + l_linenumber as unit_no, case when l_linestatus = 'O' and l_returnflag = 'A' then 'failed' when l_linestatus = 'F' then 'completed' when l_quantity > 45 then 'running' else 'pending' end as status, l_linenumber as attempts
  from lineitem join orders on l_orderkey = o_orderkey)"""


def _work(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    status = F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A"), "failed").when(F.col("l_linestatus") == "F", "completed").when(F.col("l_quantity") > 45, "running").otherwise("pending")
    return rows.select(F.col("o_custkey").alias("task_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit_no"), status.alias("status"), F.col("l_linenumber").alias("attempts"))


@query("j5_task_status", f"""with {UNITS}, s as (
  select task_id, count(*) as total, count(case when status = 'completed' then 1 end) as completed, count(case when status = 'failed' then 1 end) as failed, min(case when status <> 'completed' then unit_no end) as current_unit, sum(attempts)::bigint as attempts, count(case when status = 'running' then 1 end) as r from u group by task_id)
select task_id, total, completed, failed, current_unit, attempts, case when failed > 0 then 'failed' when completed = total then 'completed' when r > 0 or completed > 0 then 'running' else 'pending' end as state from s""")
def j5(spark, d):
    return inc.task_status(_work(spark, d))


@query("j6_reset_stale", f"with {UNITS} select task_id, unit_no, case when task_id % 3 > 0 and status in ('running', 'failed') then 'pending' else status end as status from u")
def j6(spark, d):
    work = _work(spark, d)
    return inc.reset_stale(work, work.filter("task_id % 3 = 0").select("task_id"))[0].select("task_id", "unit_no", "status")


@query("j6_interrupted", f"with {UNITS} select distinct task_id, 'interrupted' as state from u where task_id % 3 > 0 and status in ('running', 'failed')")
def j6b(spark, d):
    work = _work(spark, d)
    return inc.reset_stale(work, work.filter("task_id % 3 = 0").select("task_id"))[1]


@query("j7_remaining_calls", """
with b as (select conv_id as book_id, count(case when turn % 3 = 0 then 1 end) as pending from conversations group by conv_id),
m as (select conv_id as book_id, turn, 'n' || turn as node_id, case when turn >= 2 then ['n' || (turn - 2)] else []::varchar[] end as inputs, case when turn % 2 = 0 then 'completed' else 'pending' end as status from conversations where conv_id % 2 = 0),
k as (select book_id, count(*) as known, count(case when status = 'completed' then 1 end) as done, count(case when not exists (select 1 from m x where x.book_id = m.book_id and list_contains(x.inputs, m.node_id)) then 1 end) as loose from m group by book_id)
select book_id, (pending + greatest(0, greatest(3, coalesce(known, 0) + ceil(greatest(0, coalesce(loose, 0) - 1) / 2)) - coalesce(done, 0)))::bigint as remaining from b left join k using (book_id)""")
def j7(spark, d):
    c = table(spark, d, "conversations")
    tag = lambda x: F.concat(F.lit("n"), x.cast("string"))
    batches = c.select(F.col("conv_id").alias("book_id"), F.when(F.col("turn") % 3 == 0, "pending").otherwise("completed").alias("status"))
    merges = c.filter("conv_id % 2 = 0").select(
        F.col("conv_id").alias("book_id"), F.lit(1).alias("level"), tag(F.col("turn")).alias("node_id"),
        F.when(F.col("turn") >= 2, F.array(tag(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("inputs"), F.when(F.col("turn") % 2 == 0, "completed").otherwise("pending").alias("status"))
    return inc.remaining_calls(c.select(F.col("conv_id").alias("book_id")).distinct().withColumn("planned_merges", F.lit(3)), batches, merges)


@query("j8_library", f"""with {UNITS}, s as (select task_id, count(*) as total, count(case when status = 'completed' then 1 end) as completed, count(case when status = 'failed' then 1 end) as failed, count(case when status = 'running' then 1 end) as r from u group by task_id),
b as (select c_custkey as book_id, c_name as filename, c_acctbal as updated_at, case when c_custkey % 4 > 0 then c_nationkey end as batch_count from customer)
select book_id, filename, updated_at, batch_count, completed, case when batch_count is null then 'parsed' when total is null then 'planned' when failed > 0 then 'failed' when completed = total then 'completed' when r > 0 or completed > 0 then 'running' else 'pending' end as stage
from b left join s on task_id = book_id""")
def j8(spark, d):
    c = table(spark, d, "customer")
    books = c.select(F.col("c_custkey").alias("book_id"), F.col("c_name").alias("filename"), F.col("c_acctbal").alias("updated_at"))
    plans = c.filter("c_custkey % 4 > 0").select(F.col("c_custkey").alias("book_id"), F.col("c_nationkey").alias("batch_count"))
    return inc.library(books, plans, inc.task_status(_work(spark, d)))


STATES = "case event_type when 'signup' then 'pending' when 'view' then 'running' when 'click' then 'merging' when 'purchase' then 'completed' else 'failed' end"
PHASES = "case event_type when 'signup' then 'queued' when 'view' then 'summarizing' when 'click' then 'merging' when 'purchase' then 'completed' else 'failed' end"


def _manifests(spark, d):
    states = {"signup": "pending", "view": "running", "click": "merging", "purchase": "completed"}
    status = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in states.items()], F.lit("failed"))
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("task_id"), status.alias("status"), (F.col("event_id") % 50).cast("int").alias("completed"), F.lit(50).alias("total"), F.col("ts").alias("updated_at"))


@query("k1_progress_snapshots", f"select user_id::varchar as task_id, {PHASES} as phase, event_type in ('purchase', 'error') as terminal, (event_id % 50)::int as completed, ts as updated_at from events")
def k1(spark, d):
    """The snapshots that the stream emits, over the table as a batch; each state once."""
    return pr.snapshots(_manifests(spark, d)).dropDuplicates(["event_id"]).select("task_id", "phase", "terminal", "completed", "updated_at")


@query("k2_latest_progress", f"select user_id::varchar as task_id, max_by({PHASES}, ts) as phase, max_by((event_id % 50)::int, ts) as completed, max(ts) as updated_at from events group by user_id")
def k2(spark, d):
    return pr.stream_latest(pr.snapshots(_manifests(spark, d))).select("task_id", "phase", "completed", "updated_at")


@query("k3_trace_totals", f"with {TRACE} select task_id, kind, count(*) as calls, sum(estimated_tokens)::bigint as tokens, round(sum(duration_ms), 4) as total_ms from trace group by task_id, kind")
def k3(spark, d):
    return pr.stream_trace_totals(trace(spark, d)).withColumn("total_ms", F.round("total_ms", 4))


