"""Further filters, totals, orders and projections over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphwright.operators import certify as C
from graphwright.operators import summaries as Y
from graphwright.plans import staging as S
from graphwright.plans.graph_queries import _ASSERTION, _EDGE
from graphwright.registry import query
from graphwright.sources.tables import read_table


@query(
    "a01_ingestion_summary",
    "select source, lang, count(*) as pages, count(*) filter (where n_chars < 100) as low_text, sum(n_chars)::bigint as chars from documents group by source, lang",
)
def ingestion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and characters by source and language, and pages with little text."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("n_chars") < 100).alias("low_text"), F.sum("n_chars").alias("chars"))


@query(
    "a02_majority_labels",
    """with votes as (select l_orderkey as page, case l_returnflag when 'A' then 'procedure' when 'R' then 'other' else case when l_discount = 0.05 then 'diagnostic' else 'parts' end end as label, l_linenumber * 1000000 + l_partkey as ord from lineitem),
    counted as (select page, label, count(*) as n, min(ord) as first from votes group by all), ranked as (select *, row_number() over (partition by page order by n desc, first, label) as place, count(*) over (partition by page) as labels from counted)
    select page, case when bool_or(label = 'diagnostic') then 'diagnostic' else max(case when place = 1 then label end) end as label, max(labels) > 1 as unsure from ranked group by page""",
)
def majority_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of each page by its votes: any diagnostic vote wins, else the most, the first seen on ties."""
    flag = F.col("l_returnflag")
    label = F.when(flag == "A", "procedure").when(flag == "R", "other").otherwise(F.when(F.col("l_discount") == 0.05, "diagnostic").otherwise("parts"))
    votes = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), label.alias("label"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ord"))
    return Y.majority_labels(votes, "page")


@query(
    "a15_usage_totals",
    f"""with {S.LIVE} select coalesce(kind, 'all') as operation, count(*) as calls, count(distinct run_id) as runs, sum(round(value * 100)::bigint)::bigint as cents from live group by rollup (kind)""",
)
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and cost by operation, and over all."""
    return Y.usage_totals(S.live_events(spark, sf_dir), "kind", "run_id", F.round(F.col("value") * 100).cast("long"))


@query(
    "a12_run_report",
    f"""with {_ASSERTION} select unit_id % 20 as run, count(*) as relations, count(*) filter (where tier = 'green') as green, count(*) filter (where tier = 'yellow') as yellow, count(*) filter (where tier = 'red') as red, count(*) filter (where structure) as by_structure, count(*) filter (where agreement) as by_agreement,
      count(*) filter (where verdict = 'supported') as by_verifier, count(distinct source_name) as sources, sum(proposals)::bigint as proposals from assertion group by unit_id % 20""",
)
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each run: tiers, witnesses, names, proposals."""
    tier = lambda t: F.count_if(F.col("tier") == t).alias(t)
    return C.assertions(S.proposals(spark, sf_dir, by_unit=True)).groupBy((F.col("unit_id") % 20).alias("run")).agg(
        F.count(F.lit(1)).alias("relations"), tier("green"), tier("yellow"), tier("red"), F.count_if("structure").alias("by_structure"), F.count_if("agreement").alias("by_agreement"),
        F.count_if(F.col("verdict") == "supported").alias("by_verifier"), F.count_distinct("source_name").alias("sources"), F.sum("proposals").alias("proposals"),
    )


@query(
    "a14_coverage_status",
    """with hits as (select p_partkey as item, l_returnflag as flag, l_orderkey as id from part left join lineitem on l_partkey = p_partkey)
    select item, case when bool_or(flag = 'A') then 'REPRESENTED' when bool_or(flag is not null) then 'REJECTED_PROPOSAL' else 'MISSING' end as status, count(distinct case when flag = 'A' then id end) as represented_by from hits group by item""",
)
def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each part is represented, only rejected, or missing among the order lines."""
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("relation"), (F.col("l_returnflag") == "A").alias("accepted"))
    return Y.coverage_status(read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item")), lines)


@query(
    "a16_attempt_totals",
    f"""with {S.LIVE}, attempts as (select *, sum((kind = 'run_started')::int) over (partition by run_id order by seq rows between unbounded preceding and current row) as attempt from live),
    each_ as (select run_id, attempt, count(*) as events, sum(round(value * 100)::bigint) as cents from attempts group by all)
    select run_id, count(*) as attempts, sum(events)::bigint as events, sum(cents)::bigint as cents, max(events) as longest from each_ group by run_id""",
)
def attempt_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of each run, and what all of them took together."""
    return Y.attempt_totals(S.live_events(spark, sf_dir), F.round(F.col("value") * 100).cast("long"))


@query(
    "a24_evidence_on_gold",
    """with gold as (select l_orderkey as id, list_distinct(list(l_partkey % 50)) as segments from lineitem where l_linestatus = 'F' group by l_orderkey), pred as (select l_orderkey as id, list_distinct(list(l_suppkey % 50)) as segments from lineitem where l_linestatus = 'O' group by l_orderkey)
    select id % 10 as family, count(*) as pairs, round(avg(list_has_any(g.segments, p.segments)::int), 6) as share from gold g join pred p using (id) group by id % 10""",
)
def evidence_on_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of matched pairs whose evidence overlaps the gold segments."""
    items = read_table(spark, sf_dir, "lineitem")
    gold = items.filter("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.col("l_partkey") % 50).alias("g"))
    pred = items.filter("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set((F.col("l_suppkey") % 50).cast("long")).alias("p"))
    return Y.evidence_overlap(gold.join(pred, "id").withColumn("family", F.col("id") % 10), "family", "g", "p")


@query(
    "a28_before_after",
    "select o_orderpriority as manual, sum(case when year(o_orderdate) < 1996 then 1 else 0 end)::bigint as before, sum(case when year(o_orderdate) >= 1996 then 1 else 0 end)::bigint as after, round(avg(case when year(o_orderdate) < 1996 then o_totalprice end), 2) as mean_before, round(avg(case when year(o_orderdate) >= 1996 then o_totalprice end), 2) as mean_after from orders group by o_orderpriority",
)
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and means of each group before and after a version."""
    old = F.year("o_orderdate") < 1996
    return Y.before_after(read_table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "manual"), "manual", old, "o_totalprice")


@query(
    "a32_breakdowns",
    f"""with {_ASSERTION} select coalesce(relation_type, 'all') as relation_type, coalesce(verdict, 'none_or_all') as verdict, grouping(relation_type, verdict)::bigint as level, count(*) as n, count(*) filter (where tier = 'green') as green from assertion group by cube (relation_type, verdict)""",
)
def breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Green relations by type, by verdict, by both, and over all."""
    rows = C.assertions(S.proposals(spark, sf_dir, by_unit=True)).cube("relation_type", "verdict").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("tier") == "green").alias("green"))
    return rows.select(F.coalesce("relation_type", F.lit("all")).alias("relation_type"), F.coalesce("verdict", F.lit("none_or_all")).alias("verdict"), "level", "n", "green")


@query(
    "p15_needs_verifier",
    """select l_orderkey, l_linenumber, count(*) as refs, bool_or(l_returnflag = 'R') or bool_or(l_tax > 0.06) or count(distinct l_suppkey) > 1 as required from lineitem group by l_orderkey, l_linenumber""",
)
def needs_verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that need a semantic check: a condition, a visual reference, or several pages."""
    rows = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
    return rows.agg(F.count(F.lit(1)).alias("refs"), (F.bool_or(F.col("l_returnflag") == "R") | F.bool_or(F.col("l_tax") > 0.06) | (F.count_distinct("l_suppkey") > 1)).alias("required"))


@query(
    "p17_node_filter",
    f"""with {_EDGE}, ends as (select source_name as name, edge_id from edge where rank < 2 union all select target_name, edge_id from edge where rank < 2), degree as (select name, count(distinct edge_id) as links from ends group by name)
    select name, links, case when links >= 2 then '2+' else links::varchar end as bucket, name = 'Brand#7' as selected from degree where lower(name) like '%bolt%' or name = 'Brand#7'""",
)
def node_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that a search finds, with their links; a selected node stays in even if it isn't found."""
    public = C.edges(C.assertions(S.proposals(spark, sf_dir, by_unit=True))).filter("tier <> 'red'")
    ends = public.select(F.col("source_name").alias("name"), "edge_id").unionByName(public.select(F.col("target_name").alias("name"), "edge_id"))
    degree = ends.groupBy("name").agg(F.count_distinct("edge_id").alias("links"))
    chosen = F.col("name") == "Brand#7"
    return degree.filter(F.lower("name").contains("bolt") | chosen).select("name", "links", F.when(F.col("links") >= 2, "2+").otherwise(F.col("links").cast("string")).alias("bucket"), chosen.alias("selected"))


@query(
    "p20_library_search",
    "select c_custkey, c_name from customer where lower(c_name) like '%12%' or lower(c_mktsegment) like '%auto%' or c_custkey::varchar like '%99%'",
)
def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of which any field holds the text."""
    fields = [(F.lower("c_name"), "12"), (F.lower("c_mktsegment"), "auto"), (F.col("c_custkey").cast("string"), "99")]
    hit = F.lit(False)
    for column, text in fields:
        hit = hit | column.contains(text)
    return read_table(spark, sf_dir, "customer").filter(hit).select("c_custkey", "c_name")


@query(
    "p21_segment_search",
    f"with {S.SEGMENT}, found as (select doc_id, segment_id, pos, count(*) over () as total, row_number() over (order by doc_id, pos) as n from segment where lower(text) like '%stupid%' or lower(text) like '%eau%') select doc_id, segment_id, total from found where n > 100 and n <= 150",
)
def segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of the segments that hold a text, with the total."""
    from graphwright.operators.edits import page_of_rows

    found = S.segments(spark, sf_dir).filter(F.lower("text").contains("stupid") | F.lower("text").contains("eau"))
    return page_of_rows(found.select("doc_id", "pos", "segment_id"), 100, 50, F.col("doc_id"), F.col("pos")).select("doc_id", "segment_id", "total")


@query(
    "s22_certified_part",
    f"""with {_EDGE}, public as (select * from edge where green > 0), nodes as (select distinct p_name as name from part union select distinct s_name from supplier union select distinct p_brand from part)
    select name from nodes where name in (select source_name from public) or name in (select target_name from public)""",
)
def certified_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes at an edge with a green occurrence."""
    green = C.assertions(S.proposals(spark, sf_dir, by_unit=True)).filter("tier = 'green'")
    parts, suppliers = read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "supplier")
    nodes = parts.select(F.col("p_name").alias("name")).union(parts.select("p_brand")).union(suppliers.select("s_name")).distinct()
    ends = green.select(F.explode(F.array("source_name", "target_name")).alias("name")).distinct()
    return nodes.join(ends, "name", "left_semi")


@query(
    "s05_page_layout",
    r"""select page_id, length(html) as chars, len(regexp_extract_all(html, '<a ')) as links, len(regexp_extract_all(html, '<p')) as blocks, len(regexp_extract_all(html, '<(?:img|svg)')) as images, least(1.0, round(len(regexp_extract_all(html, '<[^>]*>')) / greatest(length(html), 1) * 10, 6)) as markup_share from pages""",
)
def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of links, blocks and images on each page."""
    count = lambda pattern: F.regexp_count("html", F.lit(pattern))
    share = F.least(F.lit(1.0), F.round(count("<[^>]*>") / F.greatest(F.length("html"), F.lit(1)) * 10, 6))
    return read_table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("chars"), count("<a ").alias("links"), count("<p").alias("blocks"), count("<(?:img|svg)").alias("images"), share.alias("markup_share"))


@query(
    "s16_replayed_answers",
    """with archive as (select sha256(l_partkey || '|' || l_suppkey) as digest, l_orderkey, l_linenumber, l_returnflag as answer, row_number() over (partition by l_partkey, l_suppkey order by l_orderkey, l_linenumber, l_returnflag, l_quantity) as n from lineitem),
    requests as (select sha256(l_partkey || '|' || l_suppkey) as digest, row_number() over (partition by l_partkey, l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_quantity) as n, l_linestatus from lineitem where l_linestatus = 'O')
    select r.digest, r.n::int as use, a.answer from requests r left join archive a on a.digest = r.digest and a.n = r.n""",
)
def replayed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived answers replayed first in, first out for each request digest."""
    items = read_table(spark, sf_dir, "lineitem").withColumn("digest", F.sha2(F.concat_ws("|", "l_partkey", "l_suppkey"), 256))
    nth = lambda *order: F.row_number().over(Window.partitionBy("digest").orderBy(*order))
    archive = items.select("digest", F.col("l_returnflag").alias("answer"), nth("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity").alias("use"))
    requests = items.filter("l_linestatus = 'O'").select("digest", nth("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity").alias("use"))
    return requests.join(archive, ["digest", "use"], "left")


@query(
    "s14_page_ranges",
    """with ranges as (select c_custkey as manual, (c_custkey % 7 + 1)::int as a, (c_custkey % 7 + 1 + c_nationkey % 4)::int as b from customer)
    select manual, unnest(generate_series(a, b))::int as page from ranges""",
)
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that ranges like 3-6 name, one row each."""
    a = (F.col("c_custkey") % 7 + 1).cast("int")
    text = F.concat_ws("-", a, a + F.col("c_nationkey") % 4)
    ranges = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("manual"), F.split(text, "-").alias("r"))
    return ranges.select("manual", F.explode(F.sequence(F.col("r")[0].cast("int"), F.col("r")[1].cast("int"))).alias("page"))


@query(
    "w18_synthetic_clock",
    f"""with {S.LIVE}, steps as (select run_id, seq, case kind when 'unit_extracted' then 8 when 'relations_checked' then 3 else 1 end as seconds from live)
    select run_id, seq, sum(seconds) over (partition by run_id order by seq rows between unbounded preceding and current row)::bigint as clock from steps""",
)
def synthetic_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clock for each run from assumed durations of its events."""
    seconds = F.when(F.col("kind") == "unit_extracted", 8).when(F.col("kind") == "relations_checked", 3).otherwise(1)
    upto = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return S.live_events(spark, sf_dir).select("run_id", "seq", F.sum(seconds).over(upto).alias("clock"))


@query(
    "w21_budget_increases",
    """with raises as (select user_id, event_id, round(value * 100)::bigint as budget, lag(round(value * 100)::bigint) over (partition by user_id order by event_id) as before from events where event_type = 'signup')
    select user_id, event_id, budget, before, budget > before as valid from raises where before is not null""",
)
def budget_increases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each new budget of a user is larger than the one before."""
    budget = F.round(F.col("value") * 100).cast("long")
    return Y.raises(read_table(spark, sf_dir, "events").filter("event_type = 'signup'").select("user_id", "event_id", budget.alias("budget")), "user_id", "event_id")


@query(
    "o12_versions_by_date",
    """with versions as (select o_custkey, o_orderkey, case when o_orderkey % 6 = 0 then null else strftime(o_orderdate, '%Y-%m-%d') end as date from orders)
    select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by coalesce(date, '') desc, o_orderkey)::int as place from versions""",
)
def versions_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each customer by date, those without one last."""
    date = F.when(F.col("o_orderkey") % 6 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return Y.newest_first(read_table(spark, sf_dir, "orders"), "o_custkey", date, "o_orderkey").select("o_custkey", "o_orderkey", "place")


@query(
    "u02_ordered_union",
    """with reads as (select l_orderkey, l_partkey, l_linenumber * 10 + case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as ord from lineitem), firsts as (select l_orderkey, l_partkey, min(ord) as ord from reads group by all)
    select l_orderkey, string_agg(l_partkey::varchar, ' ' order by ord, l_partkey) as parts from firsts group by l_orderkey""",
)
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an order, each at its first place."""
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    reads = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_linenumber") * 10 + rank).alias("ord"))
    return Y.ordered_union(reads, "l_orderkey", "l_partkey").select("l_orderkey", F.array_join(F.col("values").cast("array<string>"), " ").alias("parts"))


@query(
    "x22_statements",
    f"""with {_ASSERTION} select unit_id, concat(source_name, case relation_type when 'MAY_INDICATE' then ' may indicate ' else ' is resolved by ' end, target_name, case when len(conditions) > 0 then ' [' || array_to_string(conditions, '; ') || ']' else '' end, '.') as statement, count(*) as n from assertion where tier = 'yellow' group by all""",
)
def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertain relations as sentences."""
    verb = F.when(F.col("relation_type") == "MAY_INDICATE", " may indicate ").otherwise(" is resolved by ")
    context = F.when(F.size("conditions") > 0, F.concat(F.lit(" ["), F.array_join("conditions", "; "), F.lit("]"))).otherwise("")
    rows = C.assertions(S.proposals(spark, sf_dir, by_unit=True)).filter("tier = 'yellow'")
    return rows.groupBy("unit_id", F.concat("source_name", verb, "target_name", context, F.lit(".")).alias("statement")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "l16_validation_issues",
    f"""with {_ASSERTION}, flags as (select *, list_filter([case when structure is not true and agreement is not true then 'NO_WITNESS' end, case when verdict = 'not_supported' then 'NOT_SUPPORTED' end, case when source_name = target_name then 'SELF_LINK' end, case when len(conditions) > 1 then 'SEVERAL_CONDITIONS' end], lambda x: x is not null) as issues from assertion)
    select relation_type, array_to_string(issues, ',') as issues, len(issues) = 0 as valid, count(*) as n from flags group by all""",
)
def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions by the issues that checks find."""
    flags = F.array_compact(F.array(
        F.when(~F.coalesce("structure", F.lit(False)) & ~F.coalesce("agreement", F.lit(False)), F.lit("NO_WITNESS")),
        F.when(F.col("verdict") == "not_supported", F.lit("NOT_SUPPORTED")),
        F.when(F.col("source_name") == F.col("target_name"), F.lit("SELF_LINK")),
        F.when(F.size("conditions") > 1, F.lit("SEVERAL_CONDITIONS")),
    ))
    rows = C.assertions(S.proposals(spark, sf_dir, by_unit=True)).withColumn("issues", flags)
    return rows.groupBy("relation_type", F.array_join("issues", ",").alias("issues"), (F.size("issues") == 0).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "e07_invalidated_edges",
    f"""with {_EDGE}, changed as (select p_name as name from part where p_partkey % 97 = 5 union select s_name from supplier where s_suppkey % 50 = 3)
    select edge_id, case when source_name in (select name from changed) or target_name in (select name from changed) then 'pending' else ['green', 'yellow', 'red'][(rank + 1)::int] end as tier from edge""",
)
def invalidated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers after some nodes changed: all edges at them are pending."""
    changed = read_table(spark, sf_dir, "part").filter("p_partkey % 97 = 5").select(F.col("p_name").alias("name")).union(
        read_table(spark, sf_dir, "supplier").filter("s_suppkey % 50 = 3").select("s_name")
    ).distinct()
    edges = C.edges(C.assertions(S.proposals(spark, sf_dir, by_unit=True)))
    touched = edges.join(changed, F.col("source_name") == F.col("name"), "left_semi").select("edge_id").union(
        edges.join(changed, F.col("target_name") == F.col("name"), "left_semi").select("edge_id")
    ).distinct().withColumn("hit", F.lit(True))
    return edges.join(touched, "edge_id", "left").select("edge_id", F.when(F.col("hit"), "pending").otherwise(F.col("tier")).alias("tier"))
