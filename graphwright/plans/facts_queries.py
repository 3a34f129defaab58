"""Queries of facts against gold, of live runs, and of reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.functions import text as T
from graphwright.operators import facts as X
from graphwright.operators import graph as G
from graphwright.operators.ordered import best_matching
from graphwright.plans import graph_staging as GS
from graphwright.plans import staging as S
from graphwright.plans.checkpoints import cut
from graphwright.plans.text_queries import _NORMAL
from graphwright.registry import query
from graphwright.sources.tables import read_table

# Gold facts are the pairs of part and supplier with an even order, predictions those with an odd one or a small quantity.
_GOLD = "select distinct 'g' || l_partkey || '.' || l_suppkey as fact_id, case when l_suppkey % 2 = 0 then 'RESOLVED_BY' else 'MAY_INDICATE' end as relation, l_partkey || '>' || (l_suppkey % 30) as meaning, l_partkey % 4 as hard, l_partkey % 50 as family from {lineitem} where l_orderkey % 2 = 0"
_PRED = "select 'p' || l_partkey || '.' || l_suppkey as fact_id, case when l_suppkey % 2 = 0 then 'RESOLVED_BY' else 'MAY_INDICATE' end as relation, l_partkey || '>' || (l_suppkey % 30) as meaning, l_partkey % 4 as hard, l_partkey % 50 as family, 'b' || l_partkey as branch_id, max(case when l_returnflag = 'A' then 'VERIFIED_STRUCTURE' when l_returnflag = 'N' then 'PROVISIONAL' else 'VERIFIED_REVIEW' end) as scope_status, min(l_quantity) as q from {lineitem} where l_orderkey % 2 = 1 or l_quantity < 10 group by l_partkey, l_suppkey"
_OBLIGATION = "select distinct 'o' || l_partkey || '.' || l_suppkey || '.' || (l_linenumber % 2) as obligation_id, 'g' || l_partkey || '.' || l_suppkey as fact_id, 'gb' || l_partkey as branch_id from {lineitem} where l_orderkey % 2 = 0"
_ALIGNMENT = "select 'gb' || p_partkey as gold_branch, 'b' || p_partkey as branch_id, case when p_size % 5 = 0 then 'AMBIGUOUS' else 'VERIFIED' end as status from {part}"
_FACTS = GS.named(gold=_GOLD, pred=_PRED, obligation=_OBLIGATION, alignment=_ALIGNMENT)
_COMPATIBLE = f"""{_FACTS}, compatible as materialized (
  select g.fact_id as gold_fact, p.fact_id as pred_fact, g.relation, count(distinct o.obligation_id) as obligations from gold g join obligation o on o.fact_id = g.fact_id join alignment a on a.gold_branch = o.branch_id and a.status = 'VERIFIED'
    join pred p on p.branch_id = a.branch_id and p.relation = g.relation and p.scope_status in ('VERIFIED_STRUCTURE', 'VERIFIED_REVIEW') group by all
), aligned as (
  select c.gold_fact, c.pred_fact, case when g.meaning = p.meaning then 'EXACT' when (length(c.gold_fact) * 7 + length(c.pred_fact) + p.hard) % 3 = 0 then 'EQUIVALENT' when (length(c.gold_fact) * 7 + length(c.pred_fact) + p.hard) % 3 = 1 then 'DIFFERENT' else 'UNJUDGED' end as verdict, obligations
  from compatible c join (select fact_id, min(meaning) as meaning from gold group by fact_id) g on c.gold_fact = g.fact_id join pred p on c.pred_fact = p.fact_id
)"""


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    gold, pred, owed, aligned = (GS.rows(spark, sf_dir, t) for t in (_GOLD, _PRED, _OBLIGATION, _ALIGNMENT))
    evidence = F.array(F.split_part("meaning", F.lit(">"), F.lit(1)))
    return gold.withColumn("evidence", evidence), pred.withColumn("evidence", evidence), owed, aligned


@query("j29_compatible_obligations", f"with {_COMPATIBLE} select * from compatible")
def compatible_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and predicted facts that meet in a verified branch."""
    gold, pred, owed, aligned = _facts(spark, sf_dir)
    return X.compatible_obligations(gold, owed, pred, aligned)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred, owed, aligned = _facts(spark, sf_dir)
    code = F.pmod(F.length("gold_fact") * 7 + F.length("pred_fact") + F.col("ph"), F.lit(3))
    return X.alignment_edges(gold, owed, pred, aligned, F.when(code == 0, "EQUIVALENT").when(code == 1, "DIFFERENT"))


@query("j30_alignment_edges", f"with {_COMPATIBLE} select gold_fact, pred_fact, verdict, case when verdict in ('EXACT', 'EQUIVALENT') then obligations end as weight from aligned")
def alignment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each compatible pair of facts is, and its weight."""
    return _edges(spark, sf_dir)


@query(
    "a31_fact_metrics",
    f"""with {_COMPATIBLE}, matching as (select 'g' || substr(fact_id, 2) as gold_fact, fact_id as pred_fact from pred where 'g' || substr(fact_id, 2) in (select fact_id from gold)), states as (select p.*, case when m.pred_fact is not null then 'TP' when q < 3 then 'FP' when q < 6 then 'OPEN' when family % 2 = 0 and q < 30 then 'FP' else 'OPEN' end as state from pred p left join matching m on p.fact_id = m.pred_fact),
    by_ as (select family, count(*) filter (where state = 'TP') as tp, count(*) filter (where state = 'FP') as fp, count(*) filter (where state = 'OPEN') as unjudged from states group by family), found as (select family, count(*) filter (where fact_id not in (select gold_fact from matching)) as fn from gold group by family)
    select coalesce(b.family, f.family) as family, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn, coalesce(unjudged, 0) as unjudged, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, case when unjudged = 0 and b.family % 2 = 0 then round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) end as f1 from by_ b full join found f on b.family = f.family""",
)
def fact_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and f1 of facts by family, matched one to one by part and supplier."""
    gold, pred, _, _ = _facts(spark, sf_dir)
    pair = lambda c: F.concat(F.lit("g"), F.substring(c, 2, 100))
    matching = pred.select(pair("fact_id").alias("gold_fact"), F.col("fact_id").alias("pred_fact")).join(gold.select(F.col("fact_id").alias("gold_fact")).distinct(), "gold_fact", "left_semi")
    judged = pred.withColumn("judgment", F.when(F.col("q") < 3, "UNSUPPORTED").when(F.col("q") < 6, "AMBIGUOUS")).withColumn("in_scope", F.col("q") < 30).withColumn("exhaustive", F.col("family") % 2 == 0)
    return X.fact_metrics(gold, judged, cut(matching), "family")


@query("g04_fact_matching")
def fact_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best matching of gold and predicted facts of each part; a test holds the operator against brute force."""
    edges = _edges(spark, sf_dir).filter("weight is not null")
    part = F.split_part(F.substring("gold_fact", 2, 100), F.lit("."), F.lit(1))
    return best_matching(edges.select(part.alias("part"), F.col("gold_fact").alias("left_id"), F.col("pred_fact").alias("right_id"), "weight"), "part")


@query(
    "l22_complete_branches",
    f"with {_FACTS}, hit as (select o.*, exists (select 1 from pred p where 'g' || substr(p.fact_id, 2) = o.fact_id) as hit from obligation o) select branch_id, count(*) as obligations, bool_and(hit) as complete from hit group by branch_id",
)
def complete_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches all of whose obligations a prediction satisfies."""
    _, pred, owed, _ = _facts(spark, sf_dir)
    found = pred.select(F.concat(F.lit("g"), F.substring("fact_id", 2, 100)).alias("fact_id"))
    return X.complete_branches(owed, owed.join(found, "fact_id", "left_semi"))


_CLAIM_PAIR = "select l_orderkey as claim, case when l_linenumber % 2 = 0 then 'indicator' else 'action' end as kind, l_orderkey * 10 + l_linenumber as pair, case when l_suppkey % 6 = 5 then null else l_suppkey % 4 end as votes, l_partkey % 2 = 0 as overlap from {lineitem}"


@query(
    "j39_audit_candidates",
    f"""with {GS.named(pairs=_CLAIM_PAIR)}, missing as (select distinct claim from pairs where claim % 3 <> 0), tops as (select claim, kind, max(coalesce(votes, 0)) as top from pairs group by all), kinds as (select claim, coalesce(bool_or(kind = 'indicator' and top >= 2), false) as i, coalesce(bool_or(kind = 'action' and top >= 2), false) as a from tops group by claim),
    failing as (select claim, case when not i then 'indicator' else 'action' end as kind, a from kinds where claim in (select claim from missing)), options as (select p.*, row_number() over (partition by p.claim, p.kind order by votes desc, overlap desc, pair) as k from pairs p join failing f on p.claim = f.claim and p.kind = f.kind and (f.kind = 'indicator' or not f.a) where votes < 2),
    controls as (select *, row_number() over (partition by claim order by kind <> 'indicator', pair, kind) as k from pairs where votes >= 2 and claim not in (select claim from missing))
    select claim, kind, pair, 'different' as role from options where k = 1 union all select claim, kind, pair, 'same' from controls where k = 1""",
)
def audit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that people look at to audit a judge."""
    pairs = GS.rows(spark, sf_dir, _CLAIM_PAIR)
    return X.audit_candidates(pairs, pairs.filter("claim % 3 <> 0"))


_LIST = "select user_id as run_id, event_id as seq, event_id * 7 % 23 as edge, cast(event_id % 3 as int) as rank, event_type = 'signup' as full from {events}"


@query(
    "t02_replaced_lists",
    f"with {GS.named(lists=_LIST.replace(' as full ', ' as is_full '))}, starts as (select run_id, max(seq) as start from lists where is_full group by run_id) select l.run_id, edge, min(rank) as rank, max(seq) as seq from lists l left join starts s on l.run_id = s.run_id where start is null or seq >= start group by l.run_id, edge",
)
def replaced_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each run: sign-ups replace the list, all else improves it."""
    lists = GS.rows(spark, sf_dir, _LIST.replace(" as full ", " as is_full ")).withColumnRenamed("is_full", "full")
    return X.lists_over_time(lists)


@query(
    "t08_final_ids",
    """with provisional as (select distinct 'RESOLVED_BY' as type, p_name as source, s_name as target from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey), names as (select p_name as name, min('C' || (p_size % 7)) as node_id from part group by p_name),
    final_ as (select distinct 'RESOLVED_BY|C' || (l_orderkey % 7) || '|' || s_name as edge_id from lineitem join supplier on l_suppkey = s_suppkey where l_linenumber < 3), moved as (select type || '|' || source || '|' || target as edge_id, type || '|' || coalesce(n.node_id, source) || '|' || target as moved_id from provisional p left join names n on p.source = n.name)
    select edge_id, moved_id from moved where edge_id <> moved_id and moved_id in (select edge_id from final_)""",
)
def final_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where provisional edges between names end up once parts are merged into seven causes."""
    parts, suppliers, lines = (read_table(spark, sf_dir, t) for t in ("part", "supplier", "lineitem"))
    joined = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    provisional = joined.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.lit("RESOLVED_BY").alias("type"), F.col("p_name").alias("source"), F.col("s_name").alias("target")).distinct()
    names = parts.select(F.concat(F.lit("C"), F.col("p_size") % 7).alias("node_id"), F.col("p_name").alias("name"))
    final = joined.filter("l_linenumber < 3").select(F.concat(F.lit("RESOLVED_BY|C"), F.col("l_orderkey") % 7, F.lit("|"), "s_name").alias("edge_id"))
    return X.final_ids(provisional, names, final)


@query(
    "t09_cost_over_time",
    f"with {S.LIVE}, costs as (select run_id, happened as at, round(value * 100)::bigint as amount from live where kind = 'unit_extracted' and run_id % 5 <> 0) select l.run_id, l.happened as at, l.seq, case when exists (select 1 from costs c where c.run_id = l.run_id) then coalesce((select sum(amount) from costs c where c.run_id = l.run_id and c.at <= l.happened), 0)::bigint end as cost from live l",
)
def cost_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run had cost at each of its events."""
    live = S.live_events(spark, sf_dir)
    costs = live.filter("kind = 'unit_extracted' and run_id % 5 <> 0").select("run_id", F.col("happened").alias("at"), F.round(F.col("value") * 100).cast("long").alias("amount"))
    return X.cost_at_events(live.select("run_id", F.col("happened").alias("at"), "seq"), costs)


# Names of parts are numbered; parts of one brand and size are one cause under its first name; suppliers are actions, lines of the first two numbers final edges.
_CAUSE = f"cause as (select distinct 'v3n_' || substr(sha256('FailureMode|' || {_NORMAL.format('p_name')}), 1, 20) as provisional_id, 'v3n_' || substr(sha256('FailureMode|' || {_NORMAL.format('first_name')}), 1, 20) as node_id from (select p_name || ' ' || p_partkey as p_name, min(p_name || ' ' || p_partkey) over (partition by p_brand, p_size) as first_name from part) p), merged as (select provisional_id, min(node_id) as node_id from cause group by provisional_id having not bool_or(provisional_id = node_id))"


def _named_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read_table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")))
    # minima first, so that a large group is no window of one task
    firsts = parts.groupBy("p_brand", "p_size").agg(F.min("name").alias("first_name"))
    first = T.identity_key(F.lit("FailureMode"), F.col("first_name"), F.lit(None).cast("string"))
    return parts.join(firsts, ["p_brand", "p_size"]).select("p_partkey", T.short_digest("v3n_", first).alias("node_id"), F.lit("FailureMode").alias("type"), "name", F.lit(None).cast("string").alias("code"))


@query("t08_merged_nodes", f"with {_CAUSE} select provisional_id, node_id from merged")
def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the ids of part names end up once parts of one brand and size are one cause."""
    return X.merged_nodes(_named_causes(spark, sf_dir))


@query(
    "t08_moved_edges",
    f"""with {_CAUSE}, line as (select distinct 'v3n_' || substr(sha256('FailureMode|' || {_NORMAL.format("(p_name || ' ' || p_partkey)")}), 1, 20) as source, 'A' || l_suppkey as target, l_linenumber < 3 as is_final from lineitem join part on l_partkey = p_partkey),
    moved as (select distinct 'v3e_' || substr(sha256('RESOLVED_BY|' || source || '|' || target), 1, 20) as edge_id, 'v3e_' || substr(sha256('RESOLVED_BY|' || coalesce(m.node_id, source) || '|' || target), 1, 20) as moved_id, is_final from line left join merged m on source = m.provisional_id)
    select distinct edge_id, moved_id from moved where edge_id <> moved_id and moved_id in (select moved_id from moved where is_final)""",
)
def moved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which provisional remedies of part names are a final edge of the merged cause."""
    named = _named_causes(spark, sf_dir)
    merged = X.merged_nodes(named)
    own = named.select("p_partkey", T.short_digest("v3n_", T.identity_key(F.col("type"), F.col("name"), F.col("code"))).alias("source"))
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.concat(F.lit("A"), F.col("l_suppkey").cast("string")).alias("target"), "l_linenumber")
    edges = lines.join(own, "p_partkey").select(F.lit("RESOLVED_BY").alias("type"), "source", "target", "l_linenumber")
    ends = edges.filter("l_linenumber < 3").join(merged, F.col("source") == F.col("provisional_id"), "left")
    final = ends.select(T.short_digest("v3e_", F.col("type"), F.coalesce("node_id", "source"), F.col("target")).alias("edge_id"))
    return X.moved_edges(edges.drop("l_linenumber"), merged, final)


@query(
    "t09_estimated_cost",
    f"with {S.LIVE}, own as (select * from live where run_id % 5 = 0), total as (select run_id, sum(round(value * 100)::bigint)::bigint as total from own where kind = 'unit_extracted' group by run_id), span as (select run_id, min(epoch(happened)::bigint) as a, max(epoch(happened)::bigint) as b from (select run_id, date_trunc('second', happened) as happened from own) group by run_id) select run_id, happened as at, seq, coalesce(case when a = b then total else (total * (epoch(date_trunc('second', happened))::bigint - a)) // (b - a) end, 0)::bigint as cost from own join span using (run_id) left join total using (run_id)",
)
def estimated_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What runs without a ledger had cost at each event, by their totals."""
    own = S.live_events(spark, sf_dir).filter("run_id % 5 = 0")
    totals = own.filter("kind = 'unit_extracted'").groupBy("run_id").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"))
    return X.estimated_cost(own.select("run_id", F.col("happened").alias("at"), "seq"), totals)


@query(
    "g02_reaching_actions",
    f"""with {GS.named(node=GS.NODE, edge=GS.EDGE)}, h0 as (select node_id from node where type = 'CorrectiveAction'), h1 as (select distinct source as node_id from edge where not derived and target in (select node_id from h0)), h2 as (select distinct source as node_id from edge where not derived and target in (select node_id from h1)), h3 as (select distinct source as node_id from edge where not derived and target in (select node_id from h2))
    select node_id, min(hops)::int as hops from (select node_id, 0 as hops from h0 union all select node_id, 1 from h1 union all select node_id, 2 from h2 union all select node_id, 3 from h3) group by node_id""",
)
def reaching_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes from which an action can be reached."""
    nodes, edges = GS.rows(spark, sf_dir, GS.NODE), GS.rows(spark, sf_dir, GS.EDGE).filter("not derived")
    return X.reaching(nodes, cut(edges), F.col("type") == "CorrectiveAction", 3)


@query(
    "g05_ontology_root",
    f"""with recursive {GS.named(node=GS.NODE, edge=GS.EDGE)}, types as (select distinct type from node), relations as (select distinct s.type as domain, t.type as range_ from edge e join node s on e.source = s.node_id join node t on e.target = t.node_id),
    reach(type, place) as (select type, type from types where type not in (select range_ from relations) union select r.type, x.range_ from reach r join relations x on r.place = x.domain), counts as (select type, count(distinct place) - 1 as reached from reach group by type)
    select type, reached, reached = (select max(reached) from counts) and (select count(*) from counts c where c.reached = (select max(reached) from counts)) = 1 as root from counts""",
)
def ontology_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of the graph that nothing leads to, and the one that reaches most."""
    nodes = cut(GS.rows(spark, sf_dir, GS.NODE).select("node_id", "type"))
    s, t = (nodes.select(F.col("node_id").alias(c), F.col("type").alias(n)) for c, n in (("source", "domain"), ("target", "range")))
    relations = cut(GS.rows(spark, sf_dir, GS.EDGE).join(s, "source").join(t, "target").select("domain", "range").distinct())
    return X.ontology_roots(nodes.select("type").distinct(), relations, len(G.RELATIONS))


@query(
    "g10_lineage",
    """with canon as (select p_brand, p_name, count(*) as n, min(p_partkey) as first_ from part group by all), keys as (select p_brand, p_name as key from (select *, row_number() over (partition by p_brand order by n desc, first_) as k from canon) where k = 1)
    select p_partkey as mention, 'concept_' || substr(sha256(p_brand || '|' || key), 1, 20) as concept, 'instance_' || substr(sha256(p_brand || '|' || key || '|' || p_size), 1, 20) as instance, p_name <> key as renamed from part join keys using (p_brand)""",
)
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as mentions of their brand's canonical name, with concept and instance."""
    parts = read_table(spark, sf_dir, "part")
    keys = G.canonical_names(parts, "p_brand", "p_name", "p_partkey").select("p_brand", F.col("first_seen_name").alias("key"))
    return X.lineage(parts.join(keys, "p_brand").select(F.col("p_partkey").alias("mention"), F.col("p_size").alias("unit"), F.col("p_brand").alias("type"), F.col("p_name").alias("name"), "key"))
