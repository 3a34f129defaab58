"""Queries of guards: answers, runs, lifecycles, scopes, pages, and how things are said."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.functions.sentences import relation_sentence
from graphwright.operators import certify as C
from graphwright.operators import guards as X
from graphwright.plans import graph_staging as GS
from graphwright.plans import staging as S
from graphwright.plans.graph_queries import _EDGE
from graphwright.registry import query
from graphwright.sources.tables import read_table


@query(
    "p13_valid_answers",
    """with questions as (select c_custkey as question_id, c_custkey % 3 = 0 as fix from customer where c_custkey % 7 <> 0), answers as (select o_orderkey, o_custkey as question_id, ['accept', 'reject', 'correct', 'later'][(o_orderkey % 4 + 1)::int] as option, case when o_orderkey % 8 = 2 then ' ' else o_orderstatus end as input from orders)
    select o_orderkey, a.question_id, option, case when q.question_id is null then 'UNKNOWN_QUESTION' when option = 'later' or (option = 'correct' and not fix) then 'UNKNOWN_OPTION' when option = 'correct' and trim(input) = '' then 'INPUT_MISSING' else 'valid' end as state from answers a left join questions q using (question_id)""",
)
def valid_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers to customers as questions; only some may be corrected, and a correction needs a text."""
    option = lambda name, needs: F.struct(F.lit(name).alias("id"), F.lit(needs).alias("needs_input"))
    options = F.array_compact(F.array(option("accept", False), option("reject", False), F.when(F.col("c_custkey") % 3 == 0, option("correct", True))))
    questions = read_table(spark, sf_dir, "customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("question_id"), options.alias("options"))
    key = F.col("o_orderkey")
    chosen = F.element_at(F.array(*[F.lit(o) for o in ("accept", "reject", "correct", "later")]), (key % 4 + 1).cast("int"))
    answers = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("question_id"), chosen.alias("option"), F.when(key % 8 == 2, " ").otherwise(F.col("o_orderstatus")).alias("input"))
    return X.valid_answers(answers, questions).select("o_orderkey", "question_id", "option", "state")


@query(
    "l15_scripted_answers",
    """with script as (select 'q' || o_custkey as key, min(o_orderpriority) as option from orders where o_orderkey % 5 = 0 group by 1 union all select c_mktsegment, min(c_name) from customer where c_nationkey % 2 = 0 and c_mktsegment <> 'BUILDING' group by 1)
    select 'q' || c_custkey as question_id, coalesce(i.option, k.option, 'accept') as option, case when i.option is not null then 'id' when k.option is not null then 'kind' else 'default' end as by from customer c left join script i on i.key = 'q' || c_custkey left join script k on k.key = c_mktsegment""",
)
def scripted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as questions answered by id, by segment, or by default."""
    customers, orders = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders")
    questions = customers.select(F.concat(F.lit("q"), "c_custkey").alias("question_id"), F.col("c_mktsegment").alias("kind"), F.lit("accept").alias("default"))
    script = orders.filter("o_orderkey % 5 = 0").select(F.concat(F.lit("q"), "o_custkey").alias("key"), F.col("o_orderpriority").alias("option"))
    script = script.unionByName(customers.filter("c_nationkey % 2 = 0 and c_mktsegment <> 'BUILDING'").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("option")))
    return X.scripted_answers(questions, script)


@query(
    "p28_admitted_runs",
    """with runs as (select o_custkey as run_id, sum(case when o_orderstatus = 'F' then round(o_totalprice)::bigint else 0 end)::bigint as committed, max(round(o_totalprice)::bigint) as worst, 900000 + (o_custkey % 5) * 300000 as ceiling, 300000 + (o_custkey % 7) * 40000 as lim, o_custkey % 2 = 0 as resumed from orders group by o_custkey), held as (select *, case when resumed then least(ceiling, committed + lim) else ceiling end as holds from runs)
    select run_id, holds::bigint as holds, not (committed + worst >= holds or worst >= lim) as admitted from held""",
)
def admitted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customers' next order fits under their ceilings."""
    price, key = F.round("o_totalprice").cast("long"), F.col("o_custkey")
    sums = read_table(spark, sf_dir, "orders").groupBy(key.alias("run_id")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", price).otherwise(0)).alias("committed"), F.max(price).alias("worst"))
    runs = sums.select("*", (900000 + F.col("run_id") % 5 * 300000).alias("ceiling"), (300000 + F.col("run_id") % 7 * 40000).alias("limit"), (F.col("run_id") % 2 == 0).alias("resumed"))
    return X.admitted(runs).select("run_id", "holds", "admitted")


@query(
    "p29_lifecycles",
    """with questions as (select conv_id % 50 as run_id, conv_id as question_id from conversations group by conv_id), said as (select conv_id as question_id, bool_or(turn % 4 <> 1) as applied from conversations where role = 'assistant' and conv_id % 6 <> 1 group by conv_id),
    state as (select run_id, bool_or(s.applied is null) as open, bool_or(not coalesce(s.applied, true)) as unapplied from questions q left join said s using (question_id) group by run_id) select run_id, run_id % 5 <> 0 and open as may_answer, run_id % 5 <> 0 and not open and unapplied as may_apply, run_id % 5 <> 0 and not open and not unapplied as may_approve from state""",
)
def lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be done next in each group of conversations."""
    rows = read_table(spark, sf_dir, "conversations")
    questions = rows.select((F.col("conv_id") % 50).alias("run_id"), F.col("conv_id").alias("question_id")).distinct()
    answers = rows.filter("role = 'assistant' and conv_id % 6 <> 1").select(F.col("conv_id").alias("question_id"), (F.col("turn") % 4 != 1).alias("applied"))
    return X.lifecycle(questions, answers, questions.filter("run_id % 5 = 0"))


@query(
    "j42_scoped_branches",
    """with ends as (select l_orderkey as unit_id, l_returnflag as section, l_suppkey % 3 as record, min(case when l_linestatus = 'F' then 'b' || (l_partkey % 6) end) as a, max(case when l_linestatus = 'F' then 'b' || (l_partkey % 6) end) as b from lineitem group by all)
    select unit_id, section, record, case when a = b then a else 'provisional:' || substr(sha256(unit_id || '|' || section), 1, 12) end as branch from ends""",
)
def scoped_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branch of each record, or a provisional one for its section."""
    refs = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_returnflag").alias("section"), (F.col("l_suppkey") % 3).alias("record"), F.concat(F.lit("b"), F.col("l_partkey") % 6).alias("branch"), (F.col("l_linestatus") == "F").alias("structured"))
    return X.scoped_branches(refs)


@query(
    "l02_marked_content",
    f"""with {S.PAGE_MAP}, evidence as (select distinct (doc_id // 100)::bigint as manual, (doc_id % 100 + 1)::int as page from documents where n_chars % 4 = 1) select p.manual, p.page, case when e.page is not null and label <> 'diagnostic' then 'diagnostic' else label end as label, unsure or (e.page is not null and label <> 'diagnostic') as unsure from page_map p left join evidence e on p.manual = e.manual and p.page = e.page""",
)
def marked_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page map after a scan of the full text."""
    found = read_table(spark, sf_dir, "documents").filter("n_chars % 4 = 1").select(F.floor(F.col("doc_id") / 100).cast("long").alias("manual"), (F.col("doc_id") % 100 + 1).cast("int").alias("page"))
    return X.marked_content(S.page_map(spark, sf_dir), found).select("manual", "page", "label", "unsure")


@query(
    "x23_sentences",
    f"""with {_EDGE} select edge_id, case relation_type when 'MAY_INDICATE' then source_name || ' may be a sign of ' || target_name || '.' when 'RESOLVED_BY' then source_name || ' is put right by ' || target_name || '.' else source_name || ' ' || relation_type || ' ' || target_name end as sentence from edge""",
)
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge in plain words."""
    edges = C.edges(C.assertions(S.proposals(spark, sf_dir, by_unit=True)))
    return edges.select("edge_id", X.sentence(F.col("relation_type"), F.col("source_name"), F.col("target_name")).alias("sentence"))


_SPOKEN = {
    "it": ("case relation_type when 'MAY_INDICATE' then 'Se succede ' || a || ', una causa possibile è ' || b || '.' when 'RESOLVED_BY' then 'Se la causa è ' || a || ', si interviene con ' || b || case n % 3 when 0 then ' (un controllo).' when 1 then ' (una riparazione).' else '.' end else a || ' è collegato a ' || b || ' (' || relation_type || ').' end", "«", "»", " (causa non scritta nel manuale)", "Attenzione: ", "Vale se: "),
    "en": ("case relation_type when 'MAY_INDICATE' then 'If ' || a || ' happens, a possible cause is ' || b || '.' when 'RESOLVED_BY' then 'If the cause is ' || a || ', the fix is ' || b || case n % 3 when 0 then ' (a check).' when 1 then ' (a repair).' else '.' end else a || ' is linked to ' || b || ' (' || relation_type || ').' end", "“", "”", " (cause not written in the manual)", "Warning: ", "Applies if: "),
}


def _spoken_sql(language: str) -> str:
    said, left, right, unstated, warning, applies = _SPOKEN[language]
    return f"select edge_id, '{language}' as language, {said} || ' ' || case when n % 2 = 0 then '{warning}' else '{applies}' end || 'step ' || n || '.' as sentence from (select edge_id, relation_type, length(source_name) as n, '{left}' || source_name || '{right}' || case when length(source_name) % 4 = 0 then '{unstated}' else '' end as a, '{left}' || target_name || '{right}' as b from edge) e"


@query("x23_spoken_relations", f"with {_EDGE} {_spoken_sql('it')} union all {_spoken_sql('en')}")
def spoken_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge as a sentence in both languages, with kinds of remedies, implied causes and a condition told by name lengths."""
    edges = C.edges(C.assertions(S.proposals(spark, sf_dir, by_unit=True)))
    n = F.length("source_name")
    action = F.when(n % 3 == 0, "inspection").when(n % 3 == 1, "repair").otherwise("other")
    step = F.struct(F.when(n % 2 == 0, "warning").otherwise("elsewhere").alias("kind"), F.concat(F.lit("step "), n.cast("string"), F.lit("..")).alias("text"))
    said = [
        F.struct(F.lit(language).alias("language"), relation_sentence(language, F.col("relation_type"), F.col("source_name"), F.col("target_name"), unstated=n % 4 == 0, action=action, conditions=F.array(step, step)).alias("sentence"))
        for language in ("it", "en")
    ]
    return edges.select("edge_id", F.inline(F.array(*said)))


@query(
    "x24_rendered_questions",
    """with said as (select o_custkey, string_agg('  - ' || o_orderkey || ' is ' || o_orderpriority, chr(10) order by o_orderkey) as statements from orders group by o_custkey) select o_custkey, md5('Question c' || o_custkey || chr(10) || 'What the system proposes:' || chr(10) || statements || chr(10) || 'Answer with one option:' || chr(10) || '  accept' || chr(10) || '  reject') as text_hash from said""",
)
def rendered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about customers' orders as texts."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda s: F.concat(s["o_orderkey"].cast("string"), F.lit(" is "), s["o_orderpriority"]))
    asked = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(said.alias("statements"))
    text = X.rendered_question(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.col("statements"), F.array(F.lit("accept"), F.lit("reject")))
    return asked.select("o_custkey", F.md5(text).alias("text_hash"))


@query(
    "j47_precision_items",
    f"""with {GS.named(edge=GS.EDGE, occurrence=GS.OCCURRENCE)} select e.edge_id, split_part(o.segment, '.', 1) as page, count(*) as occurrences from edge e join occurrence o using (edge_id) where not derived and o.trusted and coalesce(o.status, '') <> 'rejected' and o.segment is not null group by all""",
)
def precision_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted edges with the pages of their evidence, for people to judge."""
    held = GS.rows(spark, sf_dir, GS.OCCURRENCE).filter("trusted and coalesce(status, '') <> 'rejected' and segment is not null")
    edges = GS.rows(spark, sf_dir, GS.EDGE).filter("not derived").select("edge_id")
    return held.join(edges, "edge_id").groupBy("edge_id", F.split_part("segment", F.lit("."), F.lit(1)).alias("page")).agg(F.count(F.lit(1)).alias("occurrences"))
