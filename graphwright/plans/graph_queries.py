"""Queries that certify proposals and work on the graph they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.operators import certify as C
from graphwright.operators import graph as G
from graphwright.plans import staging as S
from graphwright.plans.checkpoints import cut
from graphwright.registry import query
from graphwright.sources.tables import read_table

_ASSERTION = f"""{S.PROPOSAL}, grouped as (
  select unit_id, relation_type, source_name, target_name, bool_or(structure) as structure, bool_or(read = 'A') and bool_or(read = 'B') as agreement,
    max(verdict) as verdict, list_sort(list_distinct(list(condition) filter (where condition is not null))) as conditions, min(row) as row, count(*) as proposals,
    ['auto', 'agent', 'human'][max(case reviewer when 'human' then 3 when 'agent' then 2 when 'auto' then 1 end)::int] as reviewer, bool_or(rejected) as rejected, max(issue) as issue
  from proposal group by unit_id, relation_type, source_name, target_name
), witnessed as (
  select *, coalesce(structure, false)::int + coalesce(agreement, false)::int + coalesce(verdict = 'supported', false)::int as support
  from grouped
), assertion as (
  select *, case when rejected then 'red' when issue = 'MISSING_EVIDENCE' then 'red' when issue is not null then 'yellow' when reviewer = 'human' then 'green'
    when verdict = 'not_supported' then case when support > 0 then 'yellow' else 'red' end when support >= 2 then 'green' when support = 1 then 'yellow' else 'red' end as tier
  from witnessed
)"""

_FINE_ASSERTION = _ASSERTION.replace(S.PROPOSAL, S.FINE_PROPOSAL)
_EDGE = f"""{_ASSERTION}, edge as (
  select 'v3e_' || substr(sha256(relation_type || '|' || source_name || '|' || target_name), 1, 20) as edge_id, relation_type, source_name, target_name,
    min(case tier when 'green' then 0 when 'yellow' then 1 else 2 end) as rank, count(*) as occurrences, count(*) filter (where tier = 'green') as green, count(*) filter (where tier = 'red') as red
  from assertion group by relation_type, source_name, target_name
)"""

_FINE_EDGE = _EDGE.replace(S.PROPOSAL, S.FINE_PROPOSAL)


def _asserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.assertions(S.proposals(spark, sf_dir, by_unit=True))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.edges(_asserted(spark, sf_dir))


@query("a03_tiers", f"with {_ASSERTION} select relation_type, verdict, structure, agreement, tier, count(*) as assertions, sum(proposals)::bigint as proposals from assertion group by all")
def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions by their witnesses and tier."""
    return _asserted(spark, sf_dir).groupBy("relation_type", "verdict", "structure", "agreement", "tier").agg(F.count(F.lit(1)).alias("assertions"), F.sum("proposals").alias("proposals"))


@query("a10_certified_edges", f"with {_EDGE} select edge_id, relation_type, source_name, target_name, ['green', 'yellow', 'red'][(rank + 1)::int] as tier, occurrences, green, red from edge")
def certified_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges with identity, best tier and occurrences."""
    return _edges(spark, sf_dir)


@query("p25_public_and_red", f"with {_EDGE} select relation_type, case when rank < 2 then 'public' else 'red' end as part, count(*) as edges, sum(occurrences)::bigint as occurrences from edge group by all")
def public_and_red(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that are in the graph, and those that are listed apart."""
    part = F.when(F.col("tier") == "red", "red").otherwise("public")
    return _edges(spark, sf_dir).groupBy("relation_type", part.alias("part")).agg(F.count(F.lit(1)).alias("edges"), F.sum("occurrences").alias("occurrences"))


@query(
    "a05_common_conditions",
    f"""with {_ASSERTION}, kept as (select * from assertion where tier <> 'red'), counted as (select relation_type, source_name, target_name, count(*) as n from kept group by all),
    stated as (select relation_type, source_name, target_name, condition, count(*) as m from (select relation_type, source_name, target_name, unnest(conditions) as condition from kept) group by all),
    shared as (select s.relation_type, s.source_name, s.target_name, string_agg(condition, ', ' order by condition) as conditions from stated s join counted c on s.relation_type = c.relation_type and s.source_name = c.source_name and s.target_name = c.target_name and m = n group by all)
    select c.relation_type, c.source_name, c.target_name, coalesce(conditions, '') as conditions from counted c left join shared s on s.relation_type = c.relation_type and s.source_name = c.source_name and s.target_name = c.target_name""",
)
def common_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all public occurrences of an edge require."""
    return C.common_conditions(_asserted(spark, sf_dir)).withColumn("conditions", F.array_join("conditions", ", "))


@query(
    "j19_derived_links",
    f"""with {_EDGE} select 'v3e_' || substr(sha256('HAS_CAUSE|' || source_name), 1, 20) as edge_id, 'root' as source_name, source_name as target_name, min(rank)::int as rank from edge where relation_type = 'RESOLVED_BY' and rank < 2 group by source_name""",
)
def derived_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from the root to every cause that has an action."""
    edges = _edges(spark, sf_dir).filter("relation_type = 'RESOLVED_BY'").withColumn("rank", C.tier_rank(F.col("tier")))
    return G.derived_links(edges, "root", "HAS_CAUSE", "source_name")


@query(
    "j18_repaired_relations",
    """with typed as (select l_linenumber, case l_linenumber % 4 when 0 then 'Symptom' when 1 then 'FailureMode' when 2 then 'ErrorCode' else 'Asset' end as a, case l_suppkey % 4 when 0 then 'FailureMode' when 1 then 'CorrectiveAction' when 2 then 'Component' else 'Symptom' end as b,
      case l_partkey % 3 when 0 then 'MAY_INDICATE' when 1 then 'RESOLVED_BY' else 'INDICATES' end as relation from lineitem),
    fits(name, s, t) as (values ('HAS_COMPONENT', 'Asset', 'Component'), ('MAY_INDICATE', 'Symptom', 'FailureMode'), ('AFFECTS', 'FailureMode', 'Component'), ('RESOLVED_BY', 'FailureMode', 'CorrectiveAction'), ('GENERATES_ERROR', 'Asset', 'ErrorCode'), ('INDICATES', 'ErrorCode', 'FailureMode'))
    select relation, a, b, coalesce(f.name, r.name) as new_relation, case when f.name = relation then 'exact' when f.name is not null then 'repaired' when r.name is not null then 'reversed' else 'dropped' end as how, count(*) as proposals
    from typed left join fits f on a = f.s and b = f.t left join fits r on a = r.t and b = r.s group by all""",
)
def repaired_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation types repaired by the types of their ends."""
    pick = lambda names, c: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(c) % len(names) + 1).cast("int"))
    typed = read_table(spark, sf_dir, "lineitem").select(
        pick(("MAY_INDICATE", "RESOLVED_BY", "INDICATES"), "l_partkey").alias("relation"),
        pick(("Symptom", "FailureMode", "ErrorCode", "Asset"), "l_linenumber").alias("a"),
        pick(("FailureMode", "CorrectiveAction", "Component", "Symptom"), "l_suppkey").alias("b"),
    )
    new, how = G.repaired_relation(F.col("relation"), F.col("a"), F.col("b"))
    return typed.select("relation", "a", "b", new.alias("new_relation"), how.alias("how")).groupBy("relation", "a", "b", "new_relation", "how").agg(F.count(F.lit(1)).alias("proposals"))


@query(
    "j20_two_hop_paths",
    f"""with {_ASSERTION}, green as materialized (select unit_id, relation_type, source_name, target_name, conditions from assertion where tier = 'green'), first_hop as materialized (select * from green where relation_type = 'MAY_INDICATE'), second_hop as materialized (select * from green where relation_type = 'RESOLVED_BY'),
      paths as (select a.unit_id, a.source_name as start_name, a.target_name as middle, b.target_name as end_name,
      case when len(a.conditions) > 0 and len(b.conditions) > 0 and a.conditions <> b.conditions then 'UNCLEAR_APPLICABILITY' else 'PATH' end as status
      from first_hop a join second_hop b on a.unit_id = b.unit_id and a.target_name = b.source_name)
    select unit_id, start_name, middle, end_name, status from paths""",
)
def two_hop_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostic paths of green occurrences, symptom to cause to action, and gaps."""
    green = _asserted(spark, sf_dir).filter("tier = 'green'")
    paths = G.two_hop_paths(green.filter("relation_type = 'MAY_INDICATE'"), green.filter("relation_type = 'RESOLVED_BY'"))
    return paths.select("unit_id", F.col("start").alias("start_name"), "middle", F.col("end").alias("end_name"), "status")


@query(
    "a40_navigation_gaps",
    f"""with {_FINE_EDGE},
    kept as (select * from edge where rank < 2), solved as (select distinct source_name as name from kept where relation_type = 'RESOLVED_BY'),
    reached as (select distinct source_name as name from kept where relation_type = 'MAY_INDICATE' and target_name in (select name from solved))
    select 'problem_without_action' as kind, name from (select distinct source_name as name from edge where relation_type = 'MAY_INDICATE') where name not in (select name from reached)
    union all select 'orphan_cause', name from solved where name not in (select target_name from kept where relation_type = 'MAY_INDICATE')""",
)
def navigation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems without an action and causes without a problem, with names per order group."""
    return G.navigation_gaps(C.edges(C.assertions(S.proposals(spark, sf_dir, fine=True, by_unit=True))))


@query(
    "a06_canonical_names",
    """with counted as (select p_brand, p_name, count(*) as n, min(p_partkey) as first from part group by all), ranked as (select *, row_number() over (partition by p_brand order by n desc, first) as a, row_number() over (partition by p_brand order by n desc, p_name) as b from counted)
    select p_brand, max(case when a = 1 then p_name end) as first_seen_name, max(case when b = 1 then p_name end) as alphabetic_name, coalesce(string_agg(case when a > 1 then p_name end, ', ' order by p_name), '') as aliases, count(*) - 1 as merged_aliases from ranked group by p_brand""",
)
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of each brand's part group under both tie rules, and its aliases."""
    return G.canonical_names(read_table(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey")


@query(
    "a09_stated_vote",
    """with stated as (select p_brand, p_name, p_partkey % 6 = 0 as placeholder, p_size > 10 as stated from part)
    select p_brand, p_name, case when count(*) filter (where not placeholder) > 0 then bool_and(stated) filter (where not placeholder) else bool_or(stated) end as stated from stated group by all""",
)
def stated_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a cause is stated: all of its named mentions say so, or any if there are placeholders only."""
    rows = read_table(spark, sf_dir, "part").select("p_brand", "p_name", (F.col("p_partkey") % 6 == 0).alias("placeholder"), (F.col("p_size") > 10).alias("stated"))
    named = F.when(~F.col("placeholder"), F.col("stated"))
    return rows.groupBy("p_brand", "p_name").agg(F.when(F.count(named) > 0, F.bool_and(named)).otherwise(F.bool_or("stated")).alias("stated"))


@query(
    "a20_run_overlap",
    f"""with {S.FINE_PROPOSAL}, keys as (select distinct unit_id % 4 as run, relation_type, source_name, target_name from proposal), sizes as (select run, count(*) as n from keys group by run),
    shared as (select a.run as run_a, b.run as run_b, count(*) as shared from keys a join keys b on a.relation_type = b.relation_type and a.source_name = b.source_name and a.target_name = b.target_name and a.run < b.run group by all)
    select a.run as run_a, b.run as run_b, coalesce(s.shared, 0) as shared, round(coalesce(s.shared, 0) / nullif(a.n + b.n - coalesce(s.shared, 0), 0), 4) as jaccard
    from sizes a join sizes b on a.run < b.run left join shared s on s.run_a = a.run and s.run_b = b.run""",
)
def run_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the relations of four runs agree."""
    rows = S.proposals(spark, sf_dir, fine=True).withColumn("run", F.col("unit_id") % 4)
    return G.run_overlap(rows, "run", ["relation_type", "source_name", "target_name"])


@query(
    "j38_row_difference",
    """with edited as (select o_orderkey + case when o_orderkey % 10 = 3 then 100000000 else 0 end as o_orderkey, case when o_orderkey % 10 = 1 then '1-URGENT' else o_orderpriority end as o_orderpriority, case when o_orderkey % 14 = 1 then 'X' else o_orderstatus end as o_orderstatus from orders where o_orderkey % 10 <> 0)
    select * from (select coalesce(b.o_orderkey, e.o_orderkey) as o_orderkey, case when b.o_orderkey is null then 'added' when e.o_orderkey is null then 'removed' when b.o_orderpriority <> e.o_orderpriority or b.o_orderstatus <> e.o_orderstatus then 'updated' end as change,
      case when b.o_orderkey is null or e.o_orderkey is null then '' else concat_ws(',', case when b.o_orderpriority <> e.o_orderpriority then 'o_orderpriority' end, case when b.o_orderstatus <> e.o_orderstatus then 'o_orderstatus' end) end as fields
    from orders b full join edited e on b.o_orderkey = e.o_orderkey) where change is not null""",
)
def row_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an edited copy of the orders changes."""
    base = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    key = F.col("o_orderkey")
    edited = base.filter(key % 10 != 0).select(
        (key + F.when(key % 10 == 3, 100000000).otherwise(0)).alias("o_orderkey"),
        F.when(key % 10 == 1, "1-URGENT").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(key % 14 == 1, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
    )
    return G.row_difference(base, edited, "o_orderkey", ["o_orderpriority", "o_orderstatus"])


@query(
    "g03_bounded_paths",
    f"""with {_EDGE}, links as (select source_name as s, target_name as t from edge where rank = 0 union select s_name, n_name from supplier join nation on s_nationkey = n_nationkey),
    one as (select distinct p_brand as s from part), h1 as (select distinct o.s, l.t from one o join links l on l.s = o.s), h2 as (select distinct h.s, l.t from h1 h join links l on l.s = h.t), h3 as (select distinct h.s, l.t from h2 h join links l on l.s = h.t)
    select s as start_name, t as node, min(hops)::int as hops from (select s, s as t, 0 as hops from one union all select s, t, 1 from h1 union all select s, t, 2 from h2 union all select s, t, 3 from h3) group by s, t""",
)
def bounded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every brand leads to within three hops: parts, suppliers and their nations."""
    # an edge is green if an assertion of it is
    green = _asserted(spark, sf_dir).filter("tier = 'green'").select(F.col("source_name").alias("source"), F.col("target_name").alias("target"))
    places = read_table(spark, sf_dir, "supplier").join(read_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    links = cut(green.unionByName(places.select(F.col("s_name").alias("source"), F.col("n_name").alias("target"))).distinct())  # read at each hop
    starts = read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("start")).distinct()
    return G.bounded_paths(links, starts, 3).withColumnRenamed("start", "start_name")


@query("g06_weak_components")
def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak components of the graph with fine names, in four views: all edges, public, green, and public without what brands indicate.

    Beyond SQL at size: components reach through the whole graph. A test holds it against brute force.
    """
    edges = C.edges(C.assertions(S.proposals(spark, sf_dir, fine=True, by_unit=True)))
    return G.component_sizes(edges, {"all": "true", "public": "tier <> 'red'", "green": "tier = 'green'", "resolved": "tier <> 'red' and relation_type = 'RESOLVED_BY'"})


@query(
    "a19_structural_metrics",
    f"""with {_EDGE}, nodes as (select source_name as name from edge where rank < 2 union select target_name from edge where rank < 2)
    select (select count(*) from nodes) as nodes, count(*) filter (where rank < 2) as edges, count(*) filter (where rank = 2) as excluded, count(*) filter (where rank = 0) as green_edges, sum(occurrences)::bigint as occurrences, count(*) - count(distinct edge_id) as duplicate_ids from edge""",
)
def structural_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the graph without gold."""
    edges = _edges(spark, sf_dir)
    public = edges.filter("tier <> 'red'")
    nodes = public.select(F.col("source_name").alias("name")).union(public.select("target_name")).distinct().agg(F.count(F.lit(1)).alias("nodes"))
    counts = edges.agg(
        F.count_if(F.col("tier") != "red").alias("edges"), F.count_if(F.col("tier") == "red").alias("excluded"), F.count_if(F.col("tier") == "green").alias("green_edges"),
        F.sum("occurrences").alias("occurrences"), (F.count(F.lit(1)) - F.count_distinct("edge_id")).alias("duplicate_ids"),
    )
    return nodes.join(counts)
