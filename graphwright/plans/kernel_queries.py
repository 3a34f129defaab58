"""Smaller operators: predicates, rankings, set algebra, identities, projections of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphwright.functions import text as T
from graphwright.operators import certify as C
from graphwright.operators import summaries as Y
from graphwright.plans import staging as S
from graphwright.plans.graph_queries import _ASSERTION, _EDGE
from graphwright.plans.review_queries import _ANSWER, _answers
from graphwright.plans.text_queries import _NORMAL
from graphwright.registry import query
from graphwright.sources.tables import read_table


def _asserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.assertions(S.proposals(spark, sf_dir, by_unit=True))


@query("p01_eligible_evidence", "select conv_id, role, count(*) as units, count(*) filter (where role <> 'system' and trim(text) <> '') as eligible from conversations group by conv_id, role")
def eligible_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with content whose role isn't excluded."""
    fits = (F.col("role") != "system") & (F.btrim("text") != "")
    return read_table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("units"), F.count_if(fits).alias("eligible"))


@query(
    "p02_header_validity",
    f"""with {S.TABLE_ROW}, headers as (select doc_id, [status, line, case when doc_id % 4 = 0 then 'col3' else year end] as h from table_row where row = 1)
    select doc_id, array_to_string(h, '|') as headers, not (len(list_filter(h, lambda x: not regexp_matches(lower(x), '^(col[0-9]+|\\s*)$'))) = 0 or len(list_filter(h, lambda x: length(x) > 40)) > 0) as valid from headers""",
)
def header_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header rows that name columns: not all generic or blank, none longer than 40 characters."""
    rows = S.table_rows(spark, sf_dir).filter("row = 1")
    headers = F.array("status", "line", F.when(F.col("doc_id") % 4 == 0, "col3").otherwise(F.col("year")))
    generic, long = F.forall("h", lambda x: F.lower(x).rlike(r"^(col[0-9]+|\s*)$")), F.exists("h", lambda x: F.length(x) > 40)
    return rows.select("doc_id", headers.alias("h")).select("doc_id", F.array_join("h", "|").alias("headers"), (~(generic | long)).alias("valid"))


@query(
    "p08_table_dependent",
    f"with {S.TABLE_ROW} select doc_id, count(*) as rows, count(*) filter (where status = '' or year = '') as inherited, bool_or(status = '' or year = '') as dependent from table_row group by doc_id",
)
def table_dependent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that rest on merged cells."""
    blank = (F.col("status") == "") | (F.col("year") == "")
    return S.table_rows(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(blank).alias("inherited"), F.bool_or(blank).alias("dependent"))


@query(
    "p26_denotations",
    """with named as (select case when p_partkey % 9 = 0 then 'Unspecified cause of ' || p_name else p_name end as name, p_size > 20 as stated, case when p_size % 3 = 0 then 'INFERRED' else 'STATED' end as status from part),
    settled as (select name, case when name like 'Unspecified cause of%' then 'PLACEHOLDER' when status = 'STATED' and not stated then 'INFERRED' else status end as status from named)
    select status, status = 'STATED' as stated, count(*) as n, count(distinct name) as names from settled group by status""",
)
def denotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How names denote: stated, inferred, or a placeholder by their prefix."""
    parts = read_table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("Unspecified cause of "), "p_name")).otherwise(F.col("p_name"))
    given = F.when(F.col("p_size") % 3 == 0, "INFERRED").otherwise("STATED")
    status = F.when(name.startswith("Unspecified cause of"), "PLACEHOLDER").when((given == "STATED") & (F.col("p_size") <= 20), "INFERRED").otherwise(given)
    return parts.select(name.alias("name"), status.alias("status")).groupBy("status").agg((F.first("status") == "STATED").alias("stated"), F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"))


@query(
    "p12_violations",
    """select 'duplicate_key' as rule, count(*) as rows from (select l_orderkey, l_linenumber from lineitem group by all having count(*) > 1) union all select 'negative_balance', count(*) from customer where c_acctbal < 0
    union all select 'unknown_customer', count(*) from orders where o_custkey not in (select c_custkey from customer) union all select 'late_ship', count(*) from lineitem join orders on l_orderkey = o_orderkey where l_shipdate < o_orderdate""",
)
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break each rule."""
    table = lambda n: read_table(spark, sf_dir, n)
    found = {
        "duplicate_key": table("lineitem").groupBy("l_orderkey", "l_linenumber").count().filter("count > 1"),
        "negative_balance": table("customer").filter("c_acctbal < 0"),
        "unknown_customer": table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "late_ship": table("lineitem").join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate < o_orderdate"),
    }
    out = None
    for rule, rows in found.items():
        one = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(rule).alias("rule"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "j05_region_overlap",
    """with boxes as (select l_orderkey, l_linenumber, l_partkey, l_suppkey % 40 as x0, l_suppkey % 40 + 12 as x1, l_partkey % 60 as y0, l_partkey % 60 + l_quantity::bigint as y1, l_returnflag as kind from lineitem)
    select distinct a.l_orderkey, a.l_partkey as region, b.l_partkey as segment from boxes a join boxes b on a.l_orderkey = b.l_orderkey and a.kind = 'R' and b.kind = 'N' and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1""",
)
def region_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a page that a region's box overlaps."""
    x, y = F.col("l_suppkey") % 40, F.col("l_partkey") % 60
    boxes = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", x.alias("x0"), (x + 12).alias("x1"), y.alias("y0"), (y + F.col("l_quantity").cast("long")).alias("y1"))
    a = boxes.filter("l_returnflag = 'R'").select("l_orderkey", F.col("l_partkey").alias("region"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "x1", "y0", "y1")])
    b = boxes.filter("l_returnflag = 'N'").withColumnRenamed("l_partkey", "segment")
    return a.join(b, "l_orderkey").filter("a_x0 < x1 and x0 < a_x1 and a_y0 < y1 and y0 < a_y1").select("l_orderkey", "region", "segment").distinct()


@query(
    "j17_canonical_edges",
    f"""with {S.PROPOSAL}, roots as (select p_name, min(p_name) over (partition by split_part(p_name, ' ', 2)) as root from (select distinct p_name from part))
    select p.source_name, r.root as target_name, count(*) as proposals, count(distinct p.target_name) as merged from proposal p join roots r on p.target_name = r.p_name where relation_type = 'MAY_INDICATE' group by all""",
)
def canonical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with their targets replaced by the canonical name of their kind of part."""
    names = read_table(spark, sf_dir, "part").select("p_name").distinct()
    roots = names.withColumn("root", F.min("p_name").over(Window.partitionBy(F.split_part("p_name", F.lit(" "), F.lit(2)))))
    rows = S.proposals(spark, sf_dir).filter("relation_type = 'MAY_INDICATE'").join(roots, F.col("target_name") == F.col("p_name"))
    return rows.groupBy("source_name", "root").agg(F.count(F.lit(1)).alias("proposals"), F.count_distinct("target_name").alias("merged")).withColumnRenamed("root", "target_name")


@query(
    "j27_grouped_remedies",
    f"""with {S.PROPOSAL} select unit_id, source_name, count(distinct target_name) as remedies, string_agg(distinct target_name, '; ' order by target_name) as names from proposal where relation_type = 'RESOLVED_BY' and verdict = 'supported' group by unit_id, source_name having count(distinct target_name) > 1""",
)
def grouped_remedies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several supported remedies of one cause in one unit."""
    rows = S.proposals(spark, sf_dir).filter("relation_type = 'RESOLVED_BY' and verdict = 'supported'").groupBy("unit_id", "source_name").agg(F.array_sort(F.collect_set("target_name")).alias("t"))
    return rows.filter(F.size("t") > 1).select("unit_id", "source_name", F.size("t").alias("remedies"), F.array_join("t", "; ").alias("names"))


@query(
    "j37_endpoint_types",
    """select n_name, count(*) as edges, count(c.c_custkey) as resolved, count(*) filter (where c.c_custkey is null) as orphans, count(*) filter (where c.c_mktsegment = 'BUILDING') as typed
    from orders left join customer c on o_custkey = c_custkey and c_acctbal > 0 left join nation on c_nationkey = n_nationkey group by n_name""",
)
def endpoint_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose end is missing or of another type."""
    customers = read_table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    joined = read_table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").join(read_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy("n_name").agg(
        F.count(F.lit(1)).alias("edges"), F.count("c_custkey").alias("resolved"), F.count_if(F.col("c_custkey").isNull()).alias("orphans"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("typed")
    )


@query("a18_spending", f"with {S.LEDGER} select coalesce(sum(amount) filter (where event = 'call_finalized'), 0)::bigint as charged, coalesce(sum(amount) filter (where event = 'call_finalized' and run_id % 10 = 0), 0)::bigint as own, run_id % 50 as pool from ledger group by run_id % 50")
def spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges of each pool, and those of its own runs."""
    final = F.col("event") == "call_finalized"
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0))
    return S.ledger(spark, sf_dir).groupBy((F.col("run_id") % 50).alias("pool")).agg(total(final).alias("charged"), total(final & (F.col("run_id") % 10 == 0)).alias("own"))


@query(
    "a39_version_rows",
    f"""with {_ASSERTION} select unit_id % 200 as version, count(*) filter (where tier = 'green') as green, count(*) filter (where reviewer = 'human') as confirmed, count(*) filter (where rejected) as rejected, count(*) filter (where tier = 'yellow' and reviewer is null) as open_questions from assertion group by unit_id % 200""",
)
def version_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a catalogue shows of each version."""
    return _asserted(spark, sf_dir).groupBy((F.col("unit_id") % 200).alias("version")).agg(
        F.count_if(F.col("tier") == "green").alias("green"), F.count_if(F.col("reviewer") == "human").alias("confirmed"), F.count_if("rejected").alias("rejected"),
        F.count_if((F.col("tier") == "yellow") & F.col("reviewer").isNull()).alias("open_questions"),
    )


@query(
    "a37_incomplete_reasons",
    f"""with {_ASSERTION} select unit_id, array_to_string(list_filter([case when count(*) < 2 then 'FEW_RELATIONS' end, case when bool_and(tier = 'red') then 'NO_PUBLIC_EDGE' end, case when not bool_or(structure) then 'NO_STRUCTURE' end], lambda x: x is not null), ',') as reasons from assertion group by unit_id""",
)
def incomplete_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a unit counts as incomplete."""
    reasons = F.array_compact(F.array(F.when(F.count(F.lit(1)) < 2, "FEW_RELATIONS"), F.when(F.bool_and(F.col("tier") == "red"), "NO_PUBLIC_EDGE"), F.when(~F.bool_or("structure"), "NO_STRUCTURE")))
    return _asserted(spark, sf_dir).groupBy("unit_id").agg(F.array_join(reasons, ",").alias("reasons"))


@query("a43_live_counts", f"with {_EDGE} select (select count(distinct source_name) + count(distinct target_name) from edge where rank < 2) as ends, count(*) filter (where rank < 2) as edges, count(*) filter (where rank = 0) as green from edge")
def live_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the live view."""
    edges = C.edges(_asserted(spark, sf_dir))
    public = F.col("tier") != "red"
    return edges.agg(
        (F.count_distinct(F.when(public, F.col("source_name"))) + F.count_distinct(F.when(public, F.col("target_name")))).alias("ends"), F.count_if(public).alias("edges"), F.count_if(F.col("tier") == "green").alias("green")
    )


@query(
    "o02_physical_order",
    f"""with {S.SEGMENT}, kinds as (select *, case when text like '%|%' then 'table_row' when length(text) < 20 then 'ocr_text' else 'text' end as kind from segment)
    select doc_id, segment_id, row_number() over (partition by doc_id, page order by case kind when 'text' then 0 when 'table_row' then 1 else 2 end, pos, segment_id)::int as place from kinds""",
)
def physical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a page by kind, then place."""
    kind = F.when(F.col("text").contains("|"), 1).when(F.length("text") < 20, 2).otherwise(0)
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(kind, "pos", "segment_id"))
    return S.segments(spark, sf_dir).select("doc_id", "segment_id", place.alias("place"))


@query(
    "o07_chosen_units",
    """with units as (select o_orderkey, o_custkey % 20 as doc, o_totalprice as priority, sha256('audit|' || o_orderkey) as digest from orders), ranked as (select *, row_number() over (partition by doc order by priority desc, o_orderkey) as a, row_number() over (partition by doc order by digest, o_orderkey) as b from units)
    select doc, o_orderkey, case when a <= 3 then 'ordinary' else 'audit' end as slot from ranked where a <= 3 or b <= 2""",
)
def chosen_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three units of each document by priority and two audit slots by digest."""
    units = read_table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("doc"), "o_totalprice")
    by_doc = Window.partitionBy("doc")
    a = F.row_number().over(by_doc.orderBy(F.desc("o_totalprice"), "o_orderkey"))
    b = F.row_number().over(by_doc.orderBy(F.sha2(F.concat_ws("|", F.lit("audit"), "o_orderkey"), 256), "o_orderkey"))
    return units.withColumn("a", a).withColumn("b", b).filter("a <= 3 or b <= 2").select("doc", "o_orderkey", F.when(F.col("a") <= 3, "ordinary").otherwise("audit").alias("slot"))


@query("o17_recent_items", f"with {S.LIVE}, last as (select run_id, item, max(seq) as seq from live group by all), ranked as (select *, row_number() over (partition by run_id order by seq desc)::int as place from last) select * from ranked where place <= 5")
def recent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five items of each run that moved last."""
    last = S.live_events(spark, sf_dir).groupBy("run_id", "item").agg(F.max("seq").alias("seq"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("seq")))).filter("place <= 5")


@query(
    "u05_common_relations",
    f"with {S.PROPOSAL} select relation_type, source_name, target_name from proposal where read = 'A' intersect select relation_type, source_name, target_name from proposal where read = 'B' except select relation_type, source_name, target_name from proposal where verdict = 'not_supported' and unit_id % 2 = 0",
)
def common_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of both reads that some units don't contradict."""
    rows = S.proposals(spark, sf_dir)
    key = ["relation_type", "source_name", "target_name"]
    return Y.common_relations(rows, key, F.expr("verdict = 'not_supported' and unit_id % 2 = 0"))


@query(
    "u06_complete_folders",
    """with files as (select c_nationkey as folder, list_distinct(list(c_mktsegment)) as names from customer where c_acctbal > 5000 group by c_nationkey), required as (select list_distinct(list(c_mktsegment)) as names from customer)
    select folder, array_to_string(list_sort(list_filter(r.names, lambda n: not list_contains(f.names, n))), ',') as missing from files f, required r""",
)
def complete_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each nation lacks of all market segments among its rich customers."""
    customers = read_table(spark, sf_dir, "customer")
    rich = customers.filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("folder"), F.col("c_mktsegment").alias("name"))
    return Y.missing_names(rich, "folder", customers.select(F.col("c_mktsegment").alias("name"))).select("folder", F.array_join("missing", ",").alias("missing"))


@query("x21_context_texts", f"with {_ASSERTION} select unit_id, array_to_string(list_sort(list_distinct(flatten(list(list_transform(conditions, lambda c: '[if] ' || c))))), '; ') as context from assertion group by unit_id")
def context_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct conditions of each unit as text."""
    stated = _asserted(spark, sf_dir).select("unit_id", F.explode_outer("conditions").alias("c")).groupBy("unit_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("[if] "), "c"))).alias("c"))
    return stated.select("unit_id", F.array_join("c", "; ").alias("context"))


@query(
    "x32_identity_keys",
    f"""with keyed as (select p_partkey, case when p_size < 5 then 'ErrorCode|code:' || {_NORMAL.format("p_brand")} || '|name_numbers:' || array_to_string(list_sort(list_distinct(regexp_extract_all(p_brand, '[0-9]+'))), ',') else 'FailureMode|' || {_NORMAL.format("p_name")} end as identity from part)
    select identity, count(*) as mentions, min(p_partkey) as first_part, 'v3n_' || substr(sha256(identity), 1, 20) as node_id from keyed group by identity""",
)
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of parts: codes by code and digits, others by type and normal name."""
    code = F.concat(F.lit("ErrorCode|code:"), T.normalize_name(F.col("p_brand")), F.lit("|name_numbers:"), T.digit_set(F.col("p_brand")))
    name = F.concat(F.lit("FailureMode|"), T.normalize_name(F.col("p_name")))
    keyed = read_table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") < 5, code).otherwise(name).alias("identity"))
    return keyed.groupBy("identity").agg(F.count(F.lit(1)).alias("mentions"), F.min("p_partkey").alias("first_part")).withColumn("node_id", T.short_digest("v3n_", F.col("identity")))


@query(
    "x35_unit_ids",
    """with owned as (select l_orderkey, string_agg(l_partkey::varchar, '|' order by l_linenumber, l_partkey, l_suppkey) as ids, count(*) as n from lineitem group by l_orderkey)
    select l_orderkey, 'u' || lpad((l_orderkey % 1000)::varchar, 3, '0') || '-' || substr(sha256(ids), 1, 6) as unit_id, n from owned""",
)
def unit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of units from what they own."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda p: p["l_partkey"].cast("string"))
    owned = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(parts, "|").alias("ids"), F.count(F.lit(1)).alias("n"))
    number = F.lpad((F.col("l_orderkey") % 1000).cast("string"), 3, "0")
    return owned.select("l_orderkey", F.concat(F.lit("u"), number, F.lit("-"), F.substring(F.sha2("ids", 256), 1, 6)).alias("unit_id"), "n")


@query(
    "x43_pricing_keys",
    """with models as (select event_id, (['gpt-6-luna', 'gpt-6-luna-2026', 'gpt-5.6-sol-x', 'gpt-5.6', 'other', 'GPT-5.4-mini '])[(event_id % 6 + 1)::int] as model from events), raw as (select event_id, lower(trim(model)) as m from models)
    select case when m in ('gpt-5.6', 'gpt-5.6-sol') or starts_with(m, 'gpt-5.6-sol-') then 'gpt-5.6-sol' when m = 'gpt-6-luna' or starts_with(m, 'gpt-6-luna-') then 'gpt-6-luna' when m = 'gpt-5.4-mini' or starts_with(m, 'gpt-5.4-mini-') then 'gpt-5.4-mini' else 'gpt-5.6-terra' end as pricing_key, count(*) as calls, min(event_id) as first_event from raw group by all""",
)
def pricing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model names matched to price lists by ordered prefixes, with a default."""
    # Names of models and of their price lists.
    names = F.array(*[F.lit(m) for m in ("gpt-6-luna", "gpt-6-luna-2026", "gpt-5.6-sol-x", "gpt-5.6", "other", "GPT-5.4-mini ")])
    m = F.lower(F.btrim(F.element_at(names, (F.col("event_id") % 6 + 1).cast("int"))))
    key = F.when(m.isin("gpt-5.6", "gpt-5.6-sol") | m.startswith("gpt-5.6-sol-"), "gpt-5.6-sol")
    for name in ("gpt-6-luna", "gpt-5.4-mini"):
        key = key.when((m == name) | m.startswith(f"{name}-"), name)
    rows = read_table(spark, sf_dir, "events").select("event_id", key.otherwise("gpt-5.6-terra").alias("pricing_key"))
    return rows.groupBy("pricing_key").agg(F.count(F.lit(1)).alias("calls"), F.min("event_id").alias("first_event"))


@query(
    "x49_completed_properties",
    """select c_custkey, case when c_custkey % 7 = 0 then 'not_stated' else coalesce(nullif(trim(c_mktsegment), ''), 'not_stated') end as segment, case when c_acctbal < 0 then 'Unknown' else case when c_acctbal > 5000 then 'high' else 'low' end end as severity, 'n' || c_custkey as id from customer""",
)
def completed_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required properties with their defaults."""
    segment = F.when(F.col("c_custkey") % 7 != 0, F.nullif(F.btrim("c_mktsegment"), F.lit("")))
    severity = F.when(F.col("c_acctbal") > 5000, "high").when(F.col("c_acctbal") >= 0, "low")
    return read_table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(segment, F.lit("not_stated")).alias("segment"), F.coalesce(severity, F.lit("Unknown")).alias("severity"), F.concat(F.lit("n"), "c_custkey").alias("id"))


@query("l15_reviewer_answers", f"with {_ANSWER} select reviewer, option, count(*) as answers, count(*) filter (where confident and valid) as usable, min(question) as first_question from answer group by reviewer, option")
def reviewer_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of each kind of reviewer."""
    usable = F.col("confident") & F.col("valid")
    return _answers(spark, sf_dir).groupBy("reviewer", "option").agg(F.count(F.lit(1)).alias("answers"), F.count_if(usable).alias("usable"), F.min("question").alias("first_question"))


@query(
    "l17_export_projection",
    f"""with {_EDGE}, nodes as (select source_name as name from edge where rank < 2 union select target_name from edge where rank < 2), projected as (select 'v3n_' || substr(sha256(name), 1, 20) as id, name from nodes)
    select p.id, p.name, count(e.edge_id) as edges, coalesce(sum(e.occurrences), 0)::bigint as occurrences from projected p left join edge e on (e.source_name = p.name or e.target_name = p.name) and e.rank < 2 group by p.id, p.name""",
)
def export_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the exported graph with their public edges."""
    public = C.edges(_asserted(spark, sf_dir)).filter("tier <> 'red'")
    ends = public.select(F.explode(F.array_distinct(F.array("source_name", "target_name"))).alias("name"), "edge_id", "occurrences")
    return ends.groupBy("name").agg(F.count(F.lit(1)).alias("edges"), F.sum("occurrences").alias("occurrences")).select(T.short_digest("v3n_", F.col("name")).alias("id"), "name", "edges", "occurrences")


@query(
    "l22_recovered_claims",
    """with gold as (select l_orderkey as claim, l_partkey as cause, l_suppkey as action from lineitem where l_linenumber = 1), same_i as (select distinct l_orderkey as claim, l_partkey as cause from lineitem where l_returnflag = 'A'), same_a as (select distinct l_orderkey as claim, l_partkey as cause from lineitem where l_linestatus = 'F')
    select g.claim % 25 as family, count(*) as claims, count(*) filter (where exists (select 1 from same_i i join same_a a on i.claim = a.claim and i.cause = a.cause where i.claim = g.claim)) as recovered from gold g group by g.claim % 25""",
)
def recovered_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of which some cause is matched both from the indicator and to the action."""
    items = read_table(spark, sf_dir, "lineitem")
    pair = lambda c: items.filter(c).select(F.col("l_orderkey").alias("claim"), F.col("l_partkey").alias("cause")).distinct()
    found = pair("l_returnflag = 'A'").intersect(pair("l_linestatus = 'F'")).select("claim").distinct().withColumn("hit", F.lit(True))
    gold = items.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("claim"))
    return gold.join(found, "claim", "left").groupBy((F.col("claim") % 25).alias("family")).agg(F.count(F.lit(1)).alias("claims"), F.count("hit").alias("recovered"))


@query("t11_resumed_events", f"with {S.LIVE} select run_id, seq, kind from live where seq > greatest(2000, (run_id % 5) * 1500)")
def resumed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a client which resumes hasn't seen."""
    after = F.greatest(F.lit(2000), F.col("run_id") % 5 * 1500)
    return S.live_events(spark, sf_dir).filter(F.col("seq") > after).select("run_id", "seq", "kind")


@query(
    "e08_recomputed_tiers",
    f"""with {_ASSERTION}, edited as (select *, case when row % 3 = 0 and tier = 'yellow' then 'green' when row % 5 = 4 then 'red' else tier end as new_tier from assertion)
    select relation_type, source_name, target_name, ['green', 'yellow', 'red'][(min(case tier when 'green' then 0 when 'yellow' then 1 else 2 end) + 1)::int] as before, ['green', 'yellow', 'red'][(min(case new_tier when 'green' then 0 when 'yellow' then 1 else 2 end) + 1)::int] as after from edited group by all""",
)
def recomputed_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of edges before and after decisions on their occurrences."""
    new = F.when((F.col("row") % 3 == 0) & (F.col("tier") == "yellow"), "green").when(F.col("row") % 5 == 4, "red").otherwise(F.col("tier"))
    best = lambda c: C.tier_name(F.min(C.tier_rank(c)))
    return _asserted(spark, sf_dir).groupBy("relation_type", "source_name", "target_name").agg(best(F.col("tier")).alias("before"), best(new).alias("after"))


@query(
    "u13_known_uploads",
    """with hashed as (select doc_id, sha256(text) as digest from documents), firsts as (select digest, min(doc_id) as known from hashed group by digest) select h.doc_id, case when f.known < h.doc_id then f.known end as known from hashed h join firsts f using (digest)""",
)
def known_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content an earlier one has."""
    return Y.first_holders(read_table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
