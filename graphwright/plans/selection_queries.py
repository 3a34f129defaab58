"""Queries that select, sample, order and publish."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphwright.operators import certify as C
from graphwright.operators import graph as G
from graphwright.operators import review as R
from graphwright.operators import selection as Z
from graphwright.operators import summaries as Y
from graphwright.operators.ranking import ranked
from graphwright.plans import graph_staging as GS
from graphwright.plans import staging as S
from graphwright.plans.graph_queries import _ASSERTION, _EDGE, _FINE_EDGE
from graphwright.plans.review_queries import _QUESTION
from graphwright.registry import query
from graphwright.sources.tables import read_table

_BASE = GS.named(node=GS.NODE, edge=GS.EDGE, occurrence=GS.OCCURRENCE)


@query("p04_low_quality", "select source, count(*) as documents, count(*) filter (where doc_id % 6 = 0 or doc_id % 10 = 3) as low from documents group by source")
def low_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source, and those that a flag calls hard to read."""
    flags = F.array_compact(F.array(F.when((F.col("doc_id") % 6 == 0) | (F.col("doc_id") % 10 == 3), F.lit("OCR_LOW_CONFIDENCE")), F.when(F.col("doc_id") % 4 == 1, F.lit("ROTATED"))))
    return read_table(spark, sf_dir, "documents").select("source", flags.alias("flags")).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.array_contains("flags", "OCR_LOW_CONFIDENCE")).alias("low"))


@query("p14_representable_edges", f"with {_BASE} select edge_id, count(*) as occurrences, count(*) = count(segment) as representable from occurrence group by edge_id")
def representable_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges all of whose evidence is located."""
    rows = GS.rows(spark, sf_dir, GS.OCCURRENCE).groupBy("edge_id").agg(F.count(F.lit(1)).alias("occurrences"), F.bool_and(F.col("segment").isNotNull()).alias("representable"))
    return rows


@query(
    "p16_resolved_evidence",
    f"""with {S.SEGMENT}, refs as (select doc_id, segment_id, pos, text, (pos % 7 + 1)::int as start, case when pos % 5 = 1 then 'x' || substr(text, pos % 7 + 1, 12) else substr(text, pos % 7 + 1, 12) end as exact_text, case when pos % 4 = 2 then 'old' else sha256(text) end as basis, case when pos % 6 = 3 then 'APPROXIMATE' else 'EXACT' end as locator from segment)
    select doc_id, segment_id, locator = 'EXACT' and basis = sha256(text) and substr(text, start, length(exact_text)) = exact_text as resolved from refs""",
)
def resolved_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence references that still find their words: exact, of the same text, at the same place."""
    pos, start = F.col("pos"), (F.col("pos") % 7 + 1).cast("int")
    piece = F.substring(F.col("text"), start, F.lit(12))
    segments = S.segments(spark, sf_dir)
    refs = segments.select(
        "doc_id", "segment_id", start.alias("start"), F.when(pos % 5 == 1, F.concat(F.lit("x"), piece)).otherwise(piece).alias("exact_text"),
        F.when(pos % 4 == 2, "old").otherwise(F.sha2("text", 256)).alias("basis"), F.when(pos % 6 == 3, "APPROXIMATE").otherwise("EXACT").alias("locator"),
    )
    found = refs.join(segments.select("doc_id", "segment_id", "text"), ["doc_id", "segment_id"], "left")
    held = (F.col("locator") == "EXACT") & (F.col("basis") == F.sha2("text", 256)) & (F.substring(F.col("text"), F.col("start"), F.length("exact_text")) == F.col("exact_text"))
    return found.select("doc_id", "segment_id", held.alias("resolved"))


@query(
    "p18_filtered_relations",
    f"""with {_BASE} select e.edge_id, e.type from edge e where type in ('RESOLVED_BY', 'MAY_INDICATE') and (lower(source) like '%c:1%' or lower(target) like '%c:1%') and exists (select 1 from occurrence o where o.edge_id = e.edge_id and segment like 'p3.%' and coalesce(status, 'pending') = 'pending')""",
)
def filtered_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of two types about some causes with a pending occurrence on page 3."""
    edges, occurrences = GS.rows(spark, sf_dir, GS.EDGE), GS.rows(spark, sf_dir, GS.OCCURRENCE)
    return Z.matching_relations(edges, occurrences, ("RESOLVED_BY", "MAY_INDICATE"), "C:1", 3, "pending").select("edge_id", "type")


@query(
    "p19_views",
    f"""with {_FINE_EDGE}, views as (select unnest(['green', 'not_trusted', 'all']) as view) select view, relation_type, count(*) as edges, sum(occurrences)::bigint as occurrences from edge join views on view = 'all' or (view = 'green') = (rank = 0) group by view, relation_type""",
)
def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each view of the graph, by relation."""
    edges = C.edges(C.assertions(S.proposals(spark, sf_dir, fine=True, by_unit=True))).withColumn("derived", F.lit(False))
    return Z.in_views(edges).groupBy("view", "relation_type").agg(F.count(F.lit(1)).alias("edges"), F.sum("occurrences").alias("occurrences"))


@query(
    "p22_activities",
    f"""with {S.LIVE}, state as (select run_id, arg_max(kind, seq) as last_kind, count(*) filter (where kind = 'run_failed') as failures, count(distinct item) filter (where kind = 'relations_checked') as open_items from live group by run_id)
    select run_id, last_kind not in ('run_failed') as running, open_items from state where last_kind <> 'run_failed' or open_items > 9""",
)
def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that are going on, or have many items open."""
    state = S.live_events(spark, sf_dir).groupBy("run_id").agg(F.max_by("kind", "seq").alias("last_kind"), F.count_distinct(F.when(F.col("kind") == "relations_checked", F.col("item"))).alias("open_items"))
    return state.filter("last_kind <> 'run_failed' or open_items > 9").select("run_id", (F.col("last_kind") != "run_failed").alias("running"), "open_items")


@query(
    "p23_eligible_endpoints",
    f"""with {_BASE}, relations(relation, domain, range_) as (values {", ".join(str(r) for r in G.RELATIONS)}), sides as (select relation, 'source' as side, domain as t from relations union all select relation, 'target', range_ from relations)
    select relation, side, node_id from node join sides on type = t where lower(name) like '%gear%' or lower(node_id) like '%gear%'""",
)
def eligible_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that may be ends of each relation and that a search finds."""
    return Z.eligible_endpoints(GS.rows(spark, sf_dir, GS.NODE), G.RELATIONS, "gear")


@query(
    "p24_questions_for_people",
    f"""with {_QUESTION}, placed as (select *, row_number() over (partition by priority order by n desc, question_id) as place from question) select question_id, priority from placed where place <= 20 and question_id not like 'rel:%7:%'""",
)
def questions_for_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offered questions, without those that are answered by approval (first units that end in 7)."""
    asked = R.questions(C.assertions(S.proposals(spark, sf_dir, by_unit=True)))
    offered = Z.first_of(asked, "priority", 20, F.desc("n"), F.col("question_id"))
    return offered.filter(~F.col("question_id").rlike("^rel:[0-9]*7:")).select("question_id", "priority")


@query(
    "a04_edge_tiers",
    f"""with {_ASSERTION} select relation_type, source_name, target_name, ['green', 'yellow', 'red'][min(case tier when 'green' then 1 when 'yellow' then 2 else 3 end)::int] as tier from assertion group by relation_type, source_name, target_name""",
)
def edge_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tier of each edge."""
    return C.edges(C.assertions(S.proposals(spark, sf_dir, by_unit=True))).select("relation_type", "source_name", "target_name", "tier")


@query(
    "a07_common_codes",
    """with codes as (select p_brand, nullif(trim(case when p_size % 4 = 0 then '' else p_type end), '') as code, p_partkey from part), counted as (select p_brand, code, count(*) as n, min(p_partkey) as first_ from codes where code is not null group by all), ranked as (select *, row_number() over (partition by p_brand order by n desc, first_) as k from counted)
    select b.p_brand, code as value from (select distinct p_brand from part) b left join ranked r on b.p_brand = r.p_brand and k = 1""",
)
def common_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common type of each brand's parts, where it is given."""
    code = F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_type"))
    return Z.most_common(read_table(spark, sf_dir, "part"), "p_brand", code, F.col("p_partkey"))


@query(
    "a08_aliases",
    "with counted as (select p_brand, p_name, count(*) as n, min(p_partkey) as first from part group by all), ranked as (select *, row_number() over (partition by p_brand order by n desc, first) as a from counted) select p_brand, coalesce(string_agg(case when a > 1 then p_name end, ', ' order by p_name), '') as aliases from ranked group by p_brand",
)
def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names of a brand's parts but the canonical one."""
    return G.canonical_names(read_table(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey").select("p_brand", "aliases")


@query("a11_merged_aliases", "select sum(n - 1)::bigint as merged_aliases, count(*) as names from (select p_brand, count(distinct p_name) as n from part group by p_brand)")
def merged_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names were merged into others."""
    return G.canonical_names(read_table(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey").agg(F.sum("merged_aliases").alias("merged_aliases"), F.count(F.lit(1)).alias("names"))


@query(
    "a13_coverage_counts",
    """with items as (select l_partkey, bool_or(l_returnflag = 'A') as shown, bool_or(l_returnflag = 'R') as rejected from lineitem group by l_partkey), states as (select p_brand, case when shown then 'REPRESENTED' when rejected then 'REJECTED_PROPOSAL' else 'MISSING' end as status from part left join items on p_partkey = l_partkey)
    select p_brand, count(*) as items, count(*) filter (where status = 'REPRESENTED') as represented, count(*) filter (where status = 'REJECTED_PROPOSAL') as rejected, count(*) filter (where status <> 'REPRESENTED') as backlog from states group by p_brand""",
)
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each brand by their coverage, and what is left to do."""
    items = read_table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("shown"), F.bool_or(F.col("l_returnflag") == "R").alias("gone"))
    status = F.when(F.col("shown"), "REPRESENTED").when(F.col("gone"), "REJECTED_PROPOSAL").otherwise("MISSING")
    states = read_table(spark, sf_dir, "part").join(items, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("status", status)
    is_ = lambda s: F.count_if(F.col("status") == s)
    return states.groupBy("p_brand").agg(F.count(F.lit(1)).alias("items"), is_("REPRESENTED").alias("represented"), is_("REJECTED_PROPOSAL").alias("rejected"), F.count_if(F.col("status") != "REPRESENTED").alias("backlog"))


@query(
    "a30_audit_scores",
    """with judged as (select o_orderpriority as manual, ['U', 'S', 'G', 'N'][(o_custkey % 4 + 1)::int] as verdict, o_orderstatus as judge from orders) select judge, coalesce(manual, 'all') as manual, count(*) filter (where verdict = 'U') as u, count(*) filter (where verdict = 'S') as s, count(*) filter (where verdict = 'G') as g, count(*) filter (where verdict = 'N') as n from judged group by grouping sets ((judge, manual), (judge))""",
)
def audit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What people found about each judge, by manual and over all."""
    verdict = F.element_at(F.array(*[F.lit(v) for v in "USGN"]), (F.col("o_custkey") % 4 + 1).cast("int"))
    judged = read_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("manual"), F.col("o_orderstatus").alias("judge"), verdict.alias("verdict"))
    totals = judged.groupingSets([["judge", "manual"], ["judge"]], "judge", "manual").agg(*[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in "USGN"])
    return totals.withColumn("manual", F.coalesce("manual", F.lit("all")))


@query(
    "a38_incomplete_units",
    f"""with {S.PROPOSAL}, have as (select unit_id, list_distinct(list(relation_type || ':' || read)) as pairs from proposal group by unit_id)
    select unit_id, array_to_string(list_sort(list_filter(['MAY_INDICATE:A', 'MAY_INDICATE:B', 'RESOLVED_BY:A', 'RESOLVED_BY:B'], lambda r: not list_contains(pairs, r))), ',') as missing from have where not list_has_all(pairs, ['MAY_INDICATE:A', 'MAY_INDICATE:B', 'RESOLVED_BY:A', 'RESOLVED_BY:B'])""",
)
def incomplete_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units in which a read gave no proposal of a relation that is expected."""
    expected = F.array(*[F.lit(f"{r}:{x}") for r in ("MAY_INDICATE", "RESOLVED_BY") for x in "AB"])
    have = S.proposals(spark, sf_dir).groupBy("unit_id").agg(F.collect_set(F.concat_ws(":", "relation_type", "read")).alias("pairs"))
    missing = F.array_sort(F.array_except(expected, F.col("pairs")))
    return have.select("unit_id", missing.alias("m")).filter(F.size("m") > 0).select("unit_id", F.array_join("m", ",").alias("missing"))


@query(
    "a41_campaign_status",
    """with runs as (select c_nationkey as manual, c_custkey, sum(case when o_orderstatus <> 'P' then round(o_totalprice * 100)::bigint else 0 end) as spent, count(*) filter (where o_orderstatus = 'P') as pending, count(o_orderkey) as calls from customer left join orders on o_custkey = c_custkey group by all)
    select manual, count(*) as runs, sum(spent)::bigint as spent, count(*) filter (where pending = 0 and calls > 0) as ready, bool_and(pending = 0 and calls > 0) as complete from runs group by manual""",
)
def campaign_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each manual's runs have cost, and how many are ready."""
    orders = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.sum(F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") * 100).cast("long")).otherwise(0)).alias("spent"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.count(F.lit(1)).alias("calls")
    )
    runs = read_table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    ready = (F.coalesce("pending", F.lit(0)) == 0) & (F.coalesce("calls", F.lit(0)) > 0)
    return runs.groupBy(F.col("c_nationkey").alias("manual")).agg(F.count(F.lit(1)).alias("runs"), F.sum(F.coalesce("spent", F.lit(0))).alias("spent"), F.count_if(ready).alias("ready"), F.bool_and(ready).alias("complete"))


@query("w16_best_tiers", f"with {_ASSERTION} select source_name, min(case tier when 'green' then 0 when 'yellow' then 1 else 2 end)::int as rank, count(*) as assertions from assertion group by source_name")
def best_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tier of each source."""
    rows = C.assertions(S.proposals(spark, sf_dir, by_unit=True))
    return rows.groupBy("source_name").agg(F.min(C.tier_rank(F.col("tier"))).alias("rank"), F.count(F.lit(1)).alias("assertions"))


@query("w23_revision_numbers", "select o_custkey, max(n) + 1 as next_revision, count(*) as revisions from (select o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders) group by o_custkey")
def revision_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that the next revision of each customer gets."""
    return Y.next_revisions(read_table(spark, sf_dir, "orders"), "o_custkey")


@query(
    "o03_top_candidates",
    "with ranked as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() over (partition by l_suppkey order by l_quantity desc, l_extendedprice desc, l_orderkey desc, l_linenumber desc)::int as place from lineitem) select l_suppkey, l_orderkey, l_linenumber, place from ranked where place <= 8",
)
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best lines of each supplier by two scores and then the latest."""
    return Z.first_of(read_table(spark, sf_dir, "lineitem"), "l_suppkey", 8, F.desc("l_quantity"), F.desc("l_extendedprice"), F.desc("l_orderkey"), F.desc("l_linenumber")).select("l_suppkey", "l_orderkey", "l_linenumber", "place")


@query("o05_deferred_questions", f"with {_QUESTION}, placed as (select *, row_number() over (partition by priority order by n desc, question_id) as place from question) select priority, count(*) filter (where place <= 20) as offered, count(*) filter (where place > 20) as deferred from placed group by priority")
def deferred_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many questions of each priority are offered and deferred."""
    asked = R.within_budget(R.questions(C.assertions(S.proposals(spark, sf_dir, by_unit=True))), "priority", 20, F.desc("n"), F.col("question_id"))
    return asked.groupBy("priority").agg(F.count_if("offered").alias("offered"), F.count_if(~F.col("offered")).alias("deferred"))


@query(
    "o06_review_order",
    "with requests as (select o_custkey as branch, o_orderkey as id, o_orderkey % 5 as priority, case o_orderstatus when 'F' then 2 when 'P' then 1 else 0 end as severity from orders) select branch, id, row_number() over (partition by branch order by priority desc, severity desc, id)::int as place from requests",
)
def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for review in order, by branch."""
    severity = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    order = Window.partitionBy("o_custkey").orderBy(F.desc(F.col("o_orderkey") % 5), severity.desc(), "o_orderkey")
    return read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("branch"), F.col("o_orderkey").alias("id"), F.row_number().over(order).alias("place"))


@query(
    "o09_caps",
    f"with {_BASE}, ranked as (select edge_id, occ_id, segment, row_number() over (partition by edge_id order by trusted desc, occ_id, segment) as n from occurrence where segment is not null) select edge_id, string_agg(segment, ' ' order by n) as shown, count(*) as items from ranked where n <= 5 group by edge_id",
)
def caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five pieces of evidence of each edge, trusted ones before others."""
    rows = GS.rows(spark, sf_dir, GS.OCCURRENCE).filter("segment is not null")
    kept = Z.first_of(rows, "edge_id", 5, F.desc("trusted"), F.col("occ_id"), F.col("segment"))
    shown = F.transform(F.array_sort(F.collect_list(F.struct("place", "segment"))), lambda x: x["segment"])
    return kept.groupBy("edge_id").agg(F.array_join(shown, " ").alias("shown"), F.count(F.lit(1)).alias("items"))


@query("o10_export_order", f"with {_BASE} select node_id, row_number() over (partition by type order by name, node_id)::int as place from node")
def export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each node comes in an export, within its type."""
    return ranked(GS.rows(spark, sf_dir, GS.NODE).select("type", "name", "node_id"), ["type"], [F.col("name"), F.col("node_id")]).select("node_id", F.col("place").cast("int").alias("place"))


@query(
    "o11_table_order",
    """with cells as (select c_custkey, c_nationkey, case when c_custkey % 7 = 0 then '' when c_custkey % 7 = 1 then null when c_custkey % 3 = 0 then (c_custkey * 37 % 1000)::varchar else c_mktsegment end as cell from customer)
    select c_custkey, row_number() over (partition by c_nationkey order by coalesce(trim(cell), '') = '', try_cast(nullif(trim(cell), '') as double) nulls last, lower(cell), cell, c_custkey)::int as place from cells""",
)
def table_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table sorted by a column with numbers, words and gaps."""
    k = F.col("c_custkey")
    cell = F.when(k % 7 == 0, "").when(k % 7 == 1, F.lit(None)).when(k % 3 == 0, (k * 37 % 1000).cast("string")).otherwise(F.col("c_mktsegment"))
    rows = read_table(spark, sf_dir, "customer").withColumn("cell", cell)
    placed = ranked(rows.select("c_nationkey", "c_custkey", "cell"), ["c_nationkey"], [*Z.natural_order(F.col("cell")), F.col("c_custkey")])
    return placed.select("c_custkey", F.col("place").cast("int").alias("place"))


@query(
    "o15_blind_sample",
    """with items as (select source, doc_id, doc_id % 3 = 0 as outside, sha256('draw11|' || doc_id) as d from documents), outs as (select *, row_number() over (partition by source order by d, doc_id) as n from items where outside), firsts as (select source, doc_id, 0 as turn, 0 as n from outs where n <= 4),
    rest as (select source, doc_id, 1 as turn, row_number() over (partition by source order by d, doc_id) as n from items where doc_id not in (select doc_id from firsts)), both_ as (select * from firsts union all select * from rest), kept as (select *, row_number() over (partition by source order by turn, n, doc_id) as k from both_)
    select source, doc_id, row_number() over (partition by source order by sha256('show11|' || doc_id), doc_id)::int as place from kept where k <= 7""",
)
def blind_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven documents of each source, four of them from outside if there are so many, in a shuffled order."""
    return Z.blind_sample(read_table(spark, sf_dir, "documents"), "source", "doc_id", F.col("doc_id") % 3 == 0, 7, 11)


@query("o16_proportional_allocation")
def proportional_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty rows over the suppliers' lines: two each, then by what is left; a test holds it against the loop."""
    groups = read_table(spark, sf_dir, "supplier").join(read_table(spark, sf_dir, "lineitem"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy(F.col("s_nationkey").alias("group")).agg(F.count(F.lit(1)).alias("size"))
    return Z.proportional(groups, 2, 120)


@query("u01_all_reads", f"with {S.PROPOSAL} select read, count(*) as proposals, count(distinct unit_id) as units from (select * from proposal where read = 'A' union all select * from proposal where read = 'B' union all select * from proposal where read = 'C' and structure) group by read")
def all_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both reads, and of the third what has structure."""
    rows = S.proposals(spark, sf_dir)
    union = rows.filter("read = 'A'").unionByName(rows.filter("read = 'B'")).unionByName(rows.filter("read = 'C' and structure"))
    return union.groupBy("read").agg(F.count(F.lit(1)).alias("proposals"), F.count_distinct("unit_id").alias("units"))


@query("u04_changed_nodes", f"with {GS.named(node=GS.NODE, new_node=GS.NEW_NODE)}, now as (select distinct * from new_node) select case when o.node_id is null then 'added' when n.node_id is null then 'removed' else 'updated' end as change, count(*) as nodes from now n full join node o on n.node_id = o.node_id where o.node_id is null or n.node_id is null or n.type is distinct from o.type or n.name is distinct from o.name or n.component is distinct from o.component group by all")
def changed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes added, removed and updated by the edited copy."""
    old, new = GS.rows(spark, sf_dir, GS.NODE), GS.rows(spark, sf_dir, GS.NEW_NODE).distinct()
    return G.row_difference(old, new, "node_id", ["type", "name", "component"]).groupBy("change").agg(F.count(F.lit(1)).alias("nodes"))


@query(
    "u09_changed_files",
    "with files as (select page_id, url as path, md5(html) as digest from pages), later as (select path, case when page_id % 13 = 0 then md5(digest) else digest end as digest from files where page_id % 17 <> 0) select path from files f where not exists (select 1 from later l where l.path = f.path and l.digest = f.digest)",
)
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are gone or differ in a later state."""
    files = read_table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.md5("html").alias("digest"))
    later = files.filter("page_id % 17 <> 0").select("path", F.when(F.col("page_id") % 13 == 0, F.md5("digest")).otherwise(F.col("digest")).alias("digest"))
    return Z.changed_files(files, later)


@query(
    "u12_published_questions",
    """with asked as (select conv_id % 40 as run, md5(text) as question_id, conv_id * 1000 + turn as seq, case when turn % 5 = 4 then 'approval' else 'relation' end as kind, conv_id from conversations), known as (select distinct question_id from asked where conv_id % 9 = 0),
    fresh as (select run, question_id, min(seq) as seq from asked where kind <> 'approval' and question_id not in (select question_id from known) group by all), placed as (select *, row_number() over (partition by run order by seq, question_id)::int as place from fresh) select run, question_id, place from placed where place <= 6""",
)
def published_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that each run may still publish."""
    rows = read_table(spark, sf_dir, "conversations")
    asked = rows.select((F.col("conv_id") % 40).alias("run"), F.md5("text").alias("question_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.when(F.col("turn") % 5 == 4, "approval").otherwise("relation").alias("kind"), "conv_id")
    return Z.published(asked, asked.filter("conv_id % 9 = 0"), 6)
