"""Queries that edit a graph, check it against its base, and preview a revision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.operators import edit_algebra as E
from graphwright.operators import graph as G
from graphwright.operators import validation as V
from graphwright.operators.ordered import similar_pairs
from graphwright.plans import graph_staging as S
from graphwright.plans.checkpoints import cut
from graphwright.registry import query

TYPES = ("Asset", "Symptom", "FailureMode", "CorrectiveAction", "ErrorCode")
ONTOLOGY = V.Ontology(TYPES, tuple(r for r in G.RELATIONS if "Component" not in r), "Asset", {"FailureMode": "component"})
_TYPES = ", ".join(f"'{t}'" for t in TYPES)
_FIELDS = ("component",)
_ALLOWED = "p[0-9]+\\.b[0-9]*[1-9]"
_ACTIVE = "edge_id in (select edge_id from {o} where status is null or status <> 'rejected')"


def base_graph(spark: SparkSession, sf_dir: str) -> V.Graph:
    """The graph before edits."""
    return V.Graph(*(S.rows(spark, sf_dir, t) for t in (S.NODE, S.EDGE, S.OCCURRENCE)))


def new_graph(spark: SparkSession, sf_dir: str) -> V.Graph:
    """The graph after edits."""
    return V.Graph(*(S.rows(spark, sf_dir, t) for t in (S.NEW_NODE, S.NEW_EDGE, S.NEW_OCCURRENCE)))


def _graphs(spark: SparkSession, sf_dir: str) -> tuple[V.Graph, V.Graph]:
    """(new_graph, base_graph) for what is asked of both: their occurrences are dealt by edge."""
    return tuple(
        V.Graph(*(S.rows(spark, sf_dir, t) for t in (node, edge)), S.occurrences(spark, sf_dir, new), tuple(S.repeated(spark, sf_dir, t) for t in (edge, occurrence)), True)
        for new, node, edge, occurrence in ((True, S.NEW_NODE, S.NEW_EDGE, S.NEW_OCCURRENCE), (False, S.NODE, S.EDGE, S.OCCURRENCE))
    )


_BASE = S.named(node=S.NODE, edge=S.EDGE, occurrence=S.OCCURRENCE)
_NEW = S.named(new_node=S.NEW_NODE, new_edge=S.NEW_EDGE, new_occurrence=S.NEW_OCCURRENCE)


@query(
    "e01_node_additions",
    f"""with {S.named(node=S.NODE, addition=S.NODE_ADDITION)}, checked as (select a.*, case when a.type not in ({_TYPES}) or a.type = 'Asset' then 'NODE_TYPE' when n.node_id is not null then 'DUPLICATE_ID' when field not in ('component') then 'RESERVED_FIELD' end as problem
      from addition a left join node n using (node_id))
    select ord, node_id, coalesce(problem, case when ord = min(ord) filter (where problem is null) over (partition by node_id) then 'added' else 'DUPLICATE_ID' end) as outcome from checked""",
)
def node_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nodes to be added, and what becomes of them."""
    nodes, additions = S.rows(spark, sf_dir, S.NODE), S.rows(spark, sf_dir, S.NODE_ADDITION)
    return E.node_additions(nodes, additions, TYPES, "Asset", _FIELDS).select("ord", "node_id", "outcome")


@query(
    "e04_edge_edits",
    f"""with {S.named(edge=S.EDGE, occurrence=S.OCCURRENCE, edit=S.EDGE_EDIT)}, last as (select edge_id, max(ord) as ord, arg_max(op, ord) as op from edit group by edge_id),
    judged as (select l.*, case when op = 'add' and e.edge_id is not null then 'DUPLICATE_ID' when op <> 'add' and e.edge_id is null then 'EDGE_NOT_FOUND' when op <> 'add' and e.derived then 'DERIVED_READ_ONLY' else 'applied' end as outcome from last l left join edge e using (edge_id))
    select edge_id, ord, op, outcome, case when op = 'replace' and outcome = 'applied' then (select count(*) from occurrence o where o.edge_id = judged.edge_id) else 0 end as invalidated from judged""",
)
def edge_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last edit of each edge comes to."""
    edges, edits, occurrences = (S.rows(spark, sf_dir, t) for t in (S.EDGE, S.EDGE_EDIT, S.OCCURRENCE))
    return E.edge_edits(edges, edits, occurrences)


_EDITED = f"""{S.named(occurrence=S.OCCURRENCE, edit=S.OCCURRENCE_EDIT)}, judged as materialized (
  select coalesce(o.edge_id, e.edge_id) as edge_id, coalesce(o.occ_id, e.occ_id) as occ_id, o.segment as old_segment, o.condition as old_condition, o.trusted as old_trusted, o.status as old_status, e.segment as new_segment, e.condition as new_condition,
    case when op is null then 'kept' when op = 'add' and o.edge_id is not null then 'DUPLICATE_ID' when op <> 'add' and o.edge_id is null then 'OCCURRENCE_NOT_FOUND' when op = 'delete' then 'deleted'
      when not regexp_full_match(e.segment, '{_ALLOWED}') then 'SEGMENT_NOT_ALLOWED' when op = 'add' then 'added' when o.segment is not distinct from e.segment and o.condition is not distinct from e.condition then 'unchanged' else 'updated' end as outcome
  from occurrence o full join edit e on o.edge_id = e.edge_id and o.occ_id = e.occ_id
), edited as materialized (
  select edge_id, occ_id, case when outcome in ('added', 'updated') then new_segment else old_segment end as segment, case when outcome in ('added', 'updated') then new_condition else old_condition end as condition,
    case when outcome in ('added', 'updated') then false else old_trusted end as trusted, case when outcome not in ('added', 'updated') then old_status end as status, outcome from judged
)"""


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    occurrences, edits = S.rows(spark, sf_dir, S.OCCURRENCE), S.rows(spark, sf_dir, S.OCCURRENCE_EDIT)
    return E.occurrence_edits(occurrences, edits, F.col("segment").rlike(f"^(?:{_ALLOWED})$"))


@query(
    "e05_occurrence_edits",
    f"with {_EDITED} select edge_id, outcome, count(*) as occurrences, count(*) filter (where trusted) as trusted, count(segment) as cited, count(*) filter (where outcome = 'kept' and status = 'rejected') as rejected from edited group by edge_id, outcome",
)
def occurrence_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What edits of occurrences come to on each edge."""
    return _edited(spark, sf_dir).groupBy("edge_id", "outcome").agg(
        F.count(F.lit(1)).alias("occurrences"), F.count_if("trusted").alias("trusted"), F.count("segment").alias("cited"), F.count_if((F.col("outcome") == "kept") & (F.col("status") == "rejected")).alias("rejected")
    )


@query(
    "e05_emptied_edges",
    f"with {_EDITED} select edge_id from edited group by edge_id having count(*) filter (where outcome not in ('deleted', 'OCCURRENCE_NOT_FOUND')) = 0 and count(*) filter (where outcome = 'deleted') > 0",
)
def emptied_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that lose their last occurrence, and go with it."""
    counted = _edited(spark, sf_dir).groupBy("edge_id").agg(F.count_if(~F.col("outcome").isin("deleted", "OCCURRENCE_NOT_FOUND")).alias("left"), F.count_if(F.col("outcome") == "deleted").alias("gone"))
    return counted.filter("left = 0 and gone > 0").select("edge_id")


_DECISION = """
select edge_id, occ_id, case when cast(length(occ_id) as int) % 3 = 0 then 'rejected' else 'confirmed' end as decision,
  case when occ_id like '%4' then 'outdated' else sha2(concat(edge_id, '|', coalesce(segment, ''), '|', coalesce(condition, '')), 256) end as content_hash from {occurrence} where occ_id not like '%9'"""


@query(
    "e06_decisions",
    f"""with {_EDITED}, decision as (select edge_id, occ_id, case when length(occ_id) % 3 = 0 then 'rejected' else 'confirmed' end as decision, case when occ_id like '%4' then 'outdated' else sha256(edge_id || '|' || coalesce(segment, '') || '|' || coalesce(condition, '')) end as content_hash from occurrence where occ_id not like '%9'),
    judged_ as (select d.edge_id, d.occ_id, d.decision, sha256(o.edge_id || '|' || coalesce(o.segment, '') || '|' || coalesce(o.condition, '')) as before_, sha256(e.edge_id || '|' || coalesce(e.segment, '') || '|' || coalesce(e.condition, '')) as after_, content_hash
      from decision d left join occurrence o on d.edge_id = o.edge_id and d.occ_id = o.occ_id left join (select * from edited where outcome <> 'deleted') e on d.edge_id = e.edge_id and d.occ_id = e.occ_id)
    select edge_id, occ_id, decision, case when before_ is null then 'OCCURRENCE_NOT_FOUND' when before_ <> content_hash then 'STALE_OCCURRENCE' when after_ is null or after_ <> content_hash then 'dropped' else decision end as outcome from judged_""",
)
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which confirmations and rejections count beside the edits."""
    before = cut(S.rows(spark, sf_dir, S.OCCURRENCE))
    after = _edited(spark, sf_dir).filter("outcome <> 'deleted'")
    return E.decided(before, after, spark.sql(_DECISION, occurrence=before))


@query(
    "e07_invalidated_occurrences",
    f"""with {_BASE}, {S.named(new_node=S.NEW_NODE)}, changed as (select distinct n.node_id from new_node n left join node o using (node_id) where n.name is distinct from o.name or n.type is distinct from o.type or n.component is distinct from o.component),
    touched as (select distinct edge_id from edge where not derived and (source in (select node_id from changed) or target in (select node_id from changed)))
    select edge_id, count(*) as occurrences from occurrence where edge_id in (select edge_id from touched) group by edge_id""",
)
def invalidated_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificates that end because a node of their edge has changed."""
    base, new = base_graph(spark, sf_dir), S.rows(spark, sf_dir, S.NEW_NODE)
    old = base.nodes.select("node_id", F.struct("type", "name", "component").alias("was"))
    changed = new.join(old, "node_id", "left").filter(~F.struct("type", "name", "component").eqNullSafe(F.col("was"))).select("node_id")
    return E.invalidated(base.edges, base.occurrences, changed).groupBy("edge_id").agg(F.count(F.lit(1)).alias("occurrences"))


def _facts(prefix: str, edge: str, occurrence: str) -> str:
    live = f"(select * from {occurrence} where status is null or status <> 'rejected')"
    return f"""{prefix}active as materialized (select * from {edge} where not derived and edge_id in (select edge_id from {live})),
  {prefix}incident as materialized (select source as node_id from {prefix}active union select target from {prefix}active),
  {prefix}resolved as materialized (select distinct source as node_id from {prefix}active where type = 'RESOLVED_BY'),
  {prefix}caused as materialized (select distinct source as node_id from {prefix}active where type in ('MAY_INDICATE', 'INDICATES')),
  {prefix}hop as materialized (select distinct e.type, e.source, e.target, o.condition from {edge} e join {live} o on e.edge_id = o.edge_id where not derived),
  {prefix}second as materialized (select source, bool_or(condition is null) as f2, list_distinct(list(condition) filter (where condition is not null)) as c2 from {prefix}hop where type = 'RESOLVED_BY' group by source),
  {prefix}path as materialized (select distinct a.source as node_id from {prefix}hop a join {prefix}second b on a.target = b.source where a.type in ('MAY_INDICATE', 'INDICATES') and (a.condition is null or f2 or list_contains(c2, a.condition)))"""


#: The content of an occurrence as a text that tells null from empty.
_CONTENT = " || '|' || ".join(f"case when {c} is null then '0' else '1' || {c} end" for c in ("segment", "condition", "trusted::varchar", "status"))

_ISSUE = f"""{_BASE}, {_NEW}, {_facts("", "new_edge", "new_occurrence")}, {_facts("old_", "edge", "occurrence")},
old_node as (select node_id, min(component) as component from node group by node_id),
every as materialized (select n.*, o.component as old_component, o.node_id is null as new_, n.node_id in (select node_id from incident) as incident, n.node_id in (select node_id from resolved) as resolved, n.node_id in (select node_id from caused) as caused, n.node_id in (select node_id from path) as path,
  n.node_id in (select node_id from old_incident) as old_incident, n.node_id in (select node_id from old_resolved) as old_resolved, n.node_id in (select node_id from old_caused) as old_caused, n.node_id in (select node_id from old_path) as old_path from new_node n left join old_node o using (node_id)),
typed as (select * from every where type in ({_TYPES})),
ends as (select node_id, max(type) as type from new_node group by node_id),
placed as (select e.*, s.type as s, t.type as t from new_edge e left join ends s on e.source = s.node_id left join ends t on e.target = t.node_id),
fits(name, s, t) as (values {", ".join(str(r) for r in ONTOLOGY.relations)}),
stated as (select p.edge_id, case when s is null or t is null then 'ORPHAN_EDGE' when not exists (select 1 from fits f where f.name = p.type and f.s = p.s and f.t = p.t) then 'ENDPOINT_TYPE' when p.s = 'Asset' and not derived then 'DERIVED_READ_ONLY' end as code from placed p),
held as materialized (select o.* from new_edge e join new_occurrence o using (edge_id) where not derived),
was as (select edge_id, occ_id, min({_CONTENT}) as content from occurrence group by edge_id, occ_id),
live as (select h.*, {_CONTENT} is distinct from w.content as moved from held h left join was w on h.edge_id = w.edge_id and h.occ_id = w.occ_id where h.status is null or h.status <> 'rejected'),
issue as materialized (
  select 'DUPLICATE_ID' as code, 'node' as kind, node_id as id, null::varchar as field, 'error' as severity, true as introduced from new_node group by node_id having count(*) > 1
  union all select 'DUPLICATE_ID', 'edge', edge_id, null, 'error', true from new_edge group by edge_id having count(*) > 1
  union all select 'ROOT_COUNT', 'graph', null, null, 'error', true from new_node having count(*) filter (where type = 'Asset') <> 1
  union all select 'NODE_TYPE', 'node', node_id, null, 'error', true from every where type not in ({_TYPES})
  union all select 'REQUIRED_FIELD', 'node', node_id, 'name', 'error', true from typed where name is null or trim(name) = ''
  union all select case when lower(component) in ('not_stated', 'unknown') then 'NOT_STATED' else 'REQUIRED_FIELD' end, 'node', node_id, 'component',
    case when (new_ or component is distinct from old_component) and coalesce(lower(component) not in ('not_stated', 'unknown'), true) then 'error' else 'warning' end, new_ or component is distinct from old_component
    from typed where type = 'FailureMode' and (component is null or trim(component) = '' or lower(component) in ('not_stated', 'unknown'))
  union all select 'ISOLATED_NODE', 'node', node_id, null, 'warning', new_ or old_incident from typed where not incident and type <> 'Asset'
  union all select 'CAUSE_WITHOUT_ACTION', 'node', node_id, null, 'warning', new_ or old_resolved from typed where type = 'FailureMode' and not resolved
  union all select 'PROBLEM_WITHOUT_CAUSE', 'node', node_id, null, 'warning', new_ or old_caused from typed where type in ('Symptom', 'ErrorCode') and not caused
  union all select 'NO_COMPATIBLE_ACTION_PATH', 'node', node_id, null, 'warning', new_ or old_path from typed where type in ('Symptom', 'ErrorCode') and caused and not path
  union all select code, 'edge', edge_id, null, 'error', true from stated where code is not null
  union all select 'DUPLICATE_EDGE', 'edge', edge_id, null, 'error', true from (select edge_id, count(*) over (partition by type, source, target) as n from new_edge) where n > 1
  union all select 'NO_OCCURRENCES', 'edge', edge_id, null, 'error', true from new_edge where not derived and edge_id not in (select edge_id from new_occurrence)
  union all select 'DUPLICATE_ID', 'edge', edge_id, 'occurrence', 'error', true from held group by edge_id, occ_id having count(*) > 1
  union all select 'UNVERIFIED_CONTENT', 'edge', edge_id, null, 'warning', moved from live where not trusted
  union all select 'NO_EVIDENCE', 'edge', edge_id, null, 'warning', moved from live where segment is null
)"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.issues(*_graphs(spark, sf_dir), ONTOLOGY)


@query("e09_validate", f"with {_ISSUE} select * from issue")
def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All issues of the edited graph."""
    return _issues(spark, sf_dir)


@query("e09_issue_counts", f"with {_ISSUE} select code, severity, introduced, count(*) as issues, count(distinct id) as targets from issue group by code, severity, introduced")
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by code, severity, and whether the edits brought them."""
    return _issues(spark, sf_dir).groupBy("code", "severity", "introduced").agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("id").alias("targets"))


@query(
    "e11_preview",
    f"""with {_ISSUE}, nodes_ as (select coalesce(a.node_id, b.node_id) as id, case when b.node_id is null then 'added' when a.node_id is null then 'removed' when a.name is distinct from b.name or a.type is distinct from b.type or a.component is distinct from b.component then 'updated' end as change from (select distinct * from new_node) a full join node b on a.node_id = b.node_id),
    edges_ as (select coalesce(a.edge_id, b.edge_id) as id, case when b.edge_id is null then 'added' when a.edge_id is null then 'removed' when a.source <> b.source or a.target <> b.target or a.derived <> b.derived then 'updated' end as change from (select distinct * from new_edge) a full join edge b on a.edge_id = b.edge_id)
    select 'node' as part, change as what, count(*) as n, false as acknowledge from nodes_ where change is not null group by change
    union all select 'edge', change, count(*), false from edges_ where change is not null group by change
    union all select 'issue', code, count(*), true from issue where introduced and severity = 'warning' group by code
    union all select 'blocking', code, count(*), false from issue where introduced and severity = 'error' group by code""",
)
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a revision would change, the new warnings that must be acknowledged, and the errors that block it."""
    new, base = _graphs(spark, sf_dir)
    parts = []
    for part, key, fields in (("node", "node_id", ["type", "name", "component"]), ("edge", "edge_id", ["source", "target", "derived"])):
        old, now = (base.nodes, new.nodes) if part == "node" else (base.edges, new.edges)
        changes = G.row_difference(old.select(key, *fields), now.select(key, *fields).distinct(), key, fields)
        parts.append(changes.groupBy(F.col("change").alias("what")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "what", "n", F.lit(False).alias("acknowledge")))
    warning = F.col("severity") == "warning"
    fresh = V.issues(new, base, ONTOLOGY).filter("introduced").groupBy(F.when(warning, "issue").otherwise("blocking").alias("part"), F.col("code").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return parts[0].unionByName(parts[1]).unionByName(fresh.select("part", "what", "n", (F.col("part") == "issue").alias("acknowledge")))


@query(
    "u07_missing_acknowledgements",
    f"""with {_ISSUE}, required as (select distinct code, id from issue where introduced and severity = 'warning')
    select code, count(*) as required, count(*) filter (where id like '%2' or id like '%5') as acknowledged, count(*) filter (where not (id like '%2' or id like '%5')) = 0 as complete from required group by code""",
)
def missing_acknowledgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the acknowledged issues of each code, by the last digit of their targets, are all that must be."""
    required = _issues(spark, sf_dir).filter("introduced and severity = 'warning'").select("code", "id").distinct()
    given = F.col("id").rlike("[25]$")
    return required.groupBy("code").agg(F.count(F.lit(1)).alias("required"), F.count_if(given).alias("acknowledged"), (F.count_if(~F.coalesce(given, F.lit(False))) == 0).alias("complete"))


@query(
    "j21_compatible_paths",
    f"with {_BASE}, {_facts('', 'edge', 'occurrence')} select n.node_id, n.type, p.node_id is not null as compatible from node n left join path p using (node_id) where type in ('Symptom', 'ErrorCode')",
)
def compatible_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems with a way to an action under conditions that agree."""
    base = base_graph(spark, sf_dir)
    found = V.compatible_paths(base).withColumn("compatible", F.lit(True))
    return base.nodes.filter(F.col("type").isin(*V.PROBLEMS)).join(found, "node_id", "left").select("node_id", "type", F.coalesce("compatible", F.lit(False)).alias("compatible"))


@query("j16_similar_nodes")
def similar_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of one type whose names are very similar; beyond SQL, held against brute force in a test."""
    nodes = S.rows(spark, sf_dir, S.NEW_NODE).distinct()
    plain = F.btrim(F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}_]+", " "))
    named = nodes.groupBy("type", plain.alias("plain")).agg(F.min("node_id").alias("node_id"), F.count(F.lit(1)).alias("nodes"))
    return similar_pairs(named, "type", "node_id", "plain", 0.9)


@query(
    "j22_reconnected_orphans",
    f"""with {_BASE}, {_facts('', 'edge', 'occurrence')}, scope as (select e.target as cause, e.source as problem, o.segment from edge e join occurrence o using (edge_id) where e.type in ('MAY_INDICATE', 'INDICATES') and segment is not null),
    orphan as (select distinct e.source as cause, o.segment from edge e join occurrence o using (edge_id) where e.type = 'RESOLVED_BY' and segment is not null and e.source not in (select target from active where type in ('MAY_INDICATE', 'INDICATES'))),
    met as (select o.cause, count(distinct s.problem) as problems, min(s.problem) as problem from orphan o join scope s on split_part(o.segment, '.', 1) = split_part(s.segment, '.', 1) and split_part(s.cause, ':', 2)::bigint // 10 = split_part(o.cause, ':', 2)::bigint // 10 group by o.cause)
    select cause, problem from met where problems = 1""",
)
def reconnected_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causes without a problem that share page and neighbourhood with exactly one known problem."""
    base = base_graph(spark, sf_dir)
    occurrences, edges = cut(base.occurrences), cut(base.edges)
    graph = V.Graph(base.nodes, edges, occurrences)
    scoped = edges.join(occurrences.filter("segment is not null"), "edge_id").withColumn("page", F.split_part("segment", F.lit("."), F.lit(1)))
    near = lambda c: F.floor(F.split_part(c, F.lit(":"), F.lit(2)).cast("long") / 10)
    led = graph.active_edges().filter(F.col("type").isin(*V.CAUSES)).select(F.col("target").alias("source")).distinct()
    orphans = scoped.filter("type = 'RESOLVED_BY'").join(led, "source", "left_anti").select(F.col("source").alias("cause"), "page", near(F.col("source")).alias("near"))
    known = scoped.filter(F.col("type").isin(*V.CAUSES)).select(F.col("source").alias("problem"), "page", near(F.col("target")).alias("near"))
    return G.reconnected(orphans, known, ["page", "near"])
