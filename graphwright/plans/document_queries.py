"""Queries on whole documents as sources, routes of pages, restated causes, recomputed graphs and pairs for judges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.operators import edit_algebra as E
from graphwright.operators import guards as X
from graphwright.operators import scoring as C
from graphwright.operators import validation as V
from graphwright.operators.binding import remedies_in_context, restated
from graphwright.plans import graph_staging as GS
from graphwright.plans import staging as S
from graphwright.plans.checkpoints import cut, shared_folder
from graphwright.plans.graph_edit_queries import ONTOLOGY, new_graph
from graphwright.registry import query
from graphwright.sources import documents as D
from graphwright.sources.tables import read_table
from graphwright.sources.texts import write_graph


def ontology_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ontology for each nation: its customers' segments are types, and its customers relate them; some texts are torn."""
    customers, nations = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "nation")
    key = F.col("c_nationkey")
    prop = F.struct(F.concat(F.lit("p"), F.col("c_custkey") % 3).alias("name"), (F.col("c_custkey") % 2 == 0).alias("required"), F.when(F.col("c_custkey") % 5 == 0, "number").alias("type"))
    types = customers.groupBy(key.alias("n_nationkey"), F.col("c_mktsegment").alias("name")).agg(F.array_sort(F.collect_set(prop)).alias("properties")).groupBy("n_nationkey").agg(
        F.array_sort(F.collect_list(F.struct("name", F.lit("").alias("description"), "properties"))).alias("nodes")
    )
    ends = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).filter("c_mktsegment < 'HOUSEHOLD' or n_regionkey = 1")
    relations = ends.groupBy("n_nationkey").agg(F.array_sort(F.collect_set(F.struct(F.concat(F.lit("R"), F.col("c_custkey") % 4).alias("name"), F.col("c_mktsegment").alias("domain"), F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.element_at(F.array(F.lit("BUILDING"), F.lit("FURNITURE")), (F.col("c_custkey") % 2 + 1).cast("int"))).otherwise("HOUSEHOLD").alias("range")))).alias("relations"))
    whole = types.join(relations, "n_nationkey").select("n_nationkey", F.to_json(F.struct("nodes", "relations")).alias("text"))
    return whole.withColumn("text", F.when(F.col("n_nationkey") % 8 == 7, F.substring("text", 1, 40)).otherwise(F.col("text")))


@query("s07_ontology_types")
def ontology_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All types of the nations' ontologies, with their roots; held against a loop in a test."""
    found = D.ontologies(ontology_texts(spark, sf_dir), "n_nationkey", "text")
    counted = found.properties.groupBy("n_nationkey", "type").agg(F.count(F.lit(1)).alias("properties"), F.count_if("required").alias("required"))
    leaving = found.relations.groupBy("n_nationkey", F.col("domain").alias("type")).agg(F.count(F.lit(1)).alias("relations"))
    rows = found.types.join(counted, ["n_nationkey", "type"], "left").join(leaving, ["n_nationkey", "type"], "left").join(found.roots, "n_nationkey", "full_outer")
    return rows.select("n_nationkey", "type", F.coalesce("properties", F.lit(0)).alias("properties"), F.coalesce("required", F.lit(0)).alias("required"), F.coalesce("relations", F.lit(0)).alias("relations"), "root", "status")


def sheet_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotation sheet for each order: its lines are branches; some lack a cause, a kind, an id or pages."""
    lines = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    ids = F.concat(F.lit("p"), n, F.lit(".b"), s % 9 + 1)
    kind = F.when(s % 3 == 0, " | tipo: riparazione").when(s % 3 == 1, " | tipo: Controllo").otherwise("")
    cause = F.when(s % 7 == 0, D.NOT_STATED.capitalize()).when(s % 7 == 1, "").otherwise(F.col("p_name"))
    block = F.concat(
        F.lit("### Ramo R"), n, F.lit("."), s, F.lit("\n- problema: "), F.when(s % 11 != 0, F.col("p_brand")).otherwise(""), F.lit(" | ID: "), F.when(s % 5 != 0, ids).otherwise(""), F.lit("\n- codice: "), F.when(s % 4 == 0, n.cast("string")).otherwise(""),
        F.lit("\n- causa: "), cause, F.lit(" | ID: "), F.when(s % 13 == 0, "p1.x").otherwise(ids), F.when(s % 6 != 0, F.concat(F.lit("\n- azione: Replace it"), kind, F.lit(" | ID: "), ids, F.lit(", p2.t1.r3"))).otherwise(""),
        F.when(s % 2 == 0, F.concat(F.lit("\n- azione: Call | ID: "), ids)).otherwise(""), F.lit("\n- componente: "), F.col("p_type"), F.lit(" | ID:\n- condizioni: if hot\n"),
    )
    grouped = lines.select("l_orderkey", F.struct(n.alias("n"), s.alias("s"), block.alias("block")).alias("b")).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "\n").alias("body"))
    pages = F.when(F.col("l_orderkey") % 10 != 0, F.concat(F.col("l_orderkey") % 5 + 1, F.lit("–"), F.col("l_orderkey") % 5 + 3, F.lit(", 12"))).otherwise("")
    return grouped.select("l_orderkey", F.concat(F.lit("# Sheet\n- Annotatore: A. B.\nData: 2026-01-02\nPagine annotate (all, e.g. 1-2): "), pages, F.lit("\n\n## Istruzioni\n- problema: no\n\n## Rami\n\n"), "body").alias("text"))


@query("s14_sheet_claims")
def sheet_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of all sheets; held against a loop in a test."""
    return D.sheets(sheet_texts(spark, sf_dir), "l_orderkey", "text")[1]


@query("s14_sheet_problems")
def sheet_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong in the sheets; held against a loop in a test."""
    return D.sheets(sheet_texts(spark, sf_dir), "l_orderkey", "text")[2]


@query("s15_gold_claims")
def gold_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of all sheets, written as gold texts and read from these; a test holds them against the sheets'."""
    headers, claims, _ = D.sheets(sheet_texts(spark, sf_dir), "l_orderkey", "text")
    listed = claims.groupBy("l_orderkey").agg(F.collect_list(F.struct(*[c for c in claims.columns if c != "l_orderkey"])).alias("claims"))
    texts = headers.join(listed, "l_orderkey").select("l_orderkey", F.to_json(F.struct("pages", "claims")).alias("text"))
    return D.gold_files(texts, "l_orderkey", "text")


@query(
    "s19_exported_graph",
    f"""with {GS.named(node=GS.NODE, edge=GS.EDGE)} select 'nodes' as path, count(*) as rows from node union all select 'edges', count(*) from edge""",
)
def exported_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph written as JSON lines into the shared folder, as its manifest counts it."""
    written = write_graph(GS.rows(spark, sf_dir, GS.NODE), GS.rows(spark, sf_dir, GS.EDGE), f"{shared_folder(spark)}/export-{spark.sparkContext.applicationId}")
    return written.select("path", "rows")


@query(
    "l18_page_routes",
    f"""with {S.SEGMENT}, pages as (select doc_id, page, count(*) as segments, count(*) filter (where length(text) <= 40) as short, bool_or(contains(text, '|')) as table_, bool_or(contains(text, '||') or pos % 17 = 0) as complex_, (doc_id * 7 + page) % 100 / 100.0 as image, (doc_id * 3 + page) % 60 as drawings, doc_id % 2 as images, doc_id % 19 = 0 as unreadable from segment group by all),
    listed as (select *, list_filter([case when unreadable then 'NATIVE_TEXT_UNREADABLE' end, case when segments >= 8 and short * 2 >= segments then 'SHORT_BLOCK_LAYOUT' end, case when image >= 0.8 then 'IMAGE_AREA_CANDIDATE' end, case when drawings >= 50 then 'DRAWING_DENSITY_CANDIDATE' end, case when complex_ then 'COMPLEX_TABLE' end], lambda x: x is not null) as reasons from pages)
    select doc_id, page, case when len(reasons) = 0 then 'READABLE_NATIVE_TEXT' else array_to_string(reasons, ',') end as reasons, array_to_string(list_filter(['TEXT', case when table_ then 'TABLE' end, case when len(reasons) > 0 then 'VISUAL_REVIEW' end, case when unreadable then 'OCR_REVIEW' end], lambda x: x is not null), ',') as routes from listed""",
)
def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each page is to be read, by what its layout says; images and drawings follow from the page's number."""
    doc, page = F.col("doc_id"), F.col("page")
    pages = S.segments(spark, sf_dir).groupBy("doc_id", "page").agg(
        F.count(F.lit(1)).alias("segments"), F.count_if(F.length("text") <= 40).alias("short"), F.bool_or(F.contains("text", F.lit("|"))).alias("table"), F.bool_or(F.contains("text", F.lit("||")) | (F.col("pos") % 17 == 0)).alias("complex_table")
    )
    pages = pages.withColumns({"image_share": (doc * 7 + page) % 100 / 100, "drawings": (doc * 3 + page) % 60, "images": doc % 2, "unreadable": doc % 19 == 0})
    routed = X.page_routes(pages, 0.8, 50)
    return routed.select("doc_id", "page", F.array_join("reasons", ",").alias("reasons"), F.array_join("routes", ",").alias("routes"))


@query("p10_restated_causes")
def restated_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose type, read as a cause, only repeats their name, with a number that some spell twice; held against the function in a test."""
    parts = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("source_name"), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("s"))).when(F.col("p_partkey") % 3 == 1, F.concat_ws(" ", "p_name", F.col("p_partkey") % 2)).otherwise(F.col("p_type")).alias("target_name"), F.when(F.col("p_partkey") % 5 == 0, "Component").otherwise("FailureMode").alias("target_type"))
    return restated(parts).select("p_partkey", "restated")


@query("e08_recomputed_graph")
def recomputed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust, tiers, conditions and root links of the edited graph; held against a loop in a test."""
    graph = new_graph(spark, sf_dir)
    return E.recomputed(cut(graph.nodes), cut(graph.edges), cut(graded(graph.occurrences)), cut(touched_edges(graph.edges)), ONTOLOGY.root, ONTOLOGY.relations)


def graded(occurrences: DataFrame) -> DataFrame:
    """Occurrences with a tier and the hash that their confirmation was given for."""
    tier = F.when(F.col("trusted"), "green").when(F.col("occ_id").like("%3"), "red").otherwise("yellow")
    content = E.content_hash(F.col("edge_id"), F.col("segment"), F.col("condition"))
    return occurrences.withColumns({"tier": tier, "review_hash": F.when(F.col("status") == "confirmed", F.when(F.col("occ_id").like("%5"), "stale").otherwise(content))})


def touched_edges(edges: DataFrame) -> DataFrame:
    """Ids of the edges whose conditions are to be found again."""
    return edges.filter("edge_id like '%2' or edge_id like '%+'").select("edge_id").distinct()


@query(
    "l21_judged_pairs",
    f"""with {S.SEGMENT}, edge as (select l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey || '.' || l_quantity::int as id, case when l_linenumber % 2 = 0 then 'RESOLVED_BY' else 'MAY_INDICATE' end as type, 'C' || l_partkey % 50 as source, 'r' || l_orderkey % 4 as record, l_returnflag <> 'R' as trusted, l_orderkey from lineitem),
    found as (select distinct o_orderkey as claim, case when e.type = 'RESOLVED_BY' then 'action' else 'indicator' end as kind, e.* from orders o join (select distinct * from edge) e on e.l_orderkey = o.o_orderkey and e.trusted),
    singles as (select claim, kind, id as first_edge, 1::bigint as edges from found where kind = 'indicator'),
    causes as (select distinct claim, kind, source, record from found where kind = 'action'),
    groups_ as (select c.claim, c.kind, min(e.id) as first_edge, count(distinct e.id) as edges from causes c join edge e on e.type = 'RESOLVED_BY' and e.trusted and e.source = c.source and e.record = c.record group by c.claim, c.kind, c.source, c.record)
    select * from singles union all select * from groups_""",
)
def judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims and their own trusted lines as what was found: each indicator alone, each action with all actions of its cause and record."""
    lines = read_table(spark, sf_dir, "lineitem")
    edges = lines.select(
        F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("edge"), F.when(F.col("l_linenumber") % 2 == 0, "RESOLVED_BY").otherwise("MAY_INDICATE").alias("type"),
        F.concat(F.lit("C"), F.col("l_partkey") % 50).alias("source"), F.concat(F.lit("r"), F.col("l_orderkey") % 4).alias("record"), (F.col("l_returnflag") != "R").alias("trusted"), "l_orderkey",
    )
    found = edges.filter("trusted").select(F.col("l_orderkey").alias("claim"), F.when(F.col("type") == "RESOLVED_BY", "action").otherwise("indicator").alias("kind"), "edge")
    return C.pairs_to_judge(found, edges.drop("l_orderkey")).select("claim", "kind", "first_edge", "edges")


#: Properties of the types of the derived graph.
FIELDS = [
    ("FailureMode", "cause_id", "string", None), ("FailureMode", "component", "string", None), ("FailureMode", "rating", "integer", None), ("FailureMode", "tags", "array", "string"),
    ("CorrectiveAction", "name", "string", None), ("CorrectiveAction", "price", "number", None), ("CorrectiveAction", "spare", "boolean", None),
]


def described(nodes: DataFrame, edited: bool) -> DataFrame:
    """Nodes with properties that follow from their ids; edited ones differ here and there, and some are of the wrong kind."""
    digits = F.regexp_extract("node_id", "([0-9]+)$", 1).try_cast("long")
    n = F.coalesce(digits, F.lit(0))
    said = lambda c: F.to_json(F.struct(c.alias("x"))).substr(6, 10_000)
    quoted = lambda c: F.regexp_replace(said(c), r"\}$", "")
    shift = F.when(F.lit(edited) & (n % 7 == 0), "9").otherwise("")
    values = {
        "cause_id": F.when(n % 5 != 0, quoted(F.concat("node_id", F.when(n % 11 == 0, "x").otherwise("")))),
        "component": F.when(n % 6 == 0, n.cast("string")).when(n % 6 == 1, "null").otherwise(quoted(F.coalesce("component", F.lit("none")))),
        "rating": F.when(n % 4 == 0, F.concat(n.cast("string"), F.lit(".5"))).when(n % 4 == 1, quoted(n.cast("string"))).otherwise(F.concat(F.lit("1"), shift)),
        "tags": F.when(n % 8 == 0, '["a", 1]').when(n % 8 == 1, "[]").when(n % 8 == 2, '{"a": "b"}').otherwise('["a", "b"]'),
        "name": F.when(n % 3 != 0, quoted(F.concat("name", F.when(n % 9 == 1, "!").otherwise("")))),
        "price": F.when(n % 2 == 0, F.concat(n.cast("string"), F.lit(".25"))).otherwise("true"),
        "spare": F.when(n % 2 == 0, "false").otherwise("not json"),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in values.items()])
    return nodes.select("node_id", "type", "name", F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())).alias("properties"))


@query("e09_property_issues")
def property_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the properties of the edited graph's nodes; held against a loop in a test."""
    old, new = (described(GS.rows(spark, sf_dir, t).distinct(), e) for t, e in ((GS.NODE, False), (GS.NEW_NODE, True)))
    return V.property_issues(new, old, spark.createDataFrame(FIELDS, "type string, field string, kind string, items string"))


@query(
    "p12_certificate_violations",
    """with certificates as (select distinct l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey as id, l_partkey % 17 <> 0 as evidence, l_suppkey % 3 = 0 as v, l_suppkey % 5 = 0 as r, l_partkey % 13 = 0 as twice, l_partkey % 3 = 0 as supported, l_partkey % 5 = 0 as confirmed, l_partkey % 35 = 0 as rejected from lineitem)
    select id as assertion_id, unnest(list_filter([case when not evidence then 'NO_EVIDENCE' end, case when twice then 'WITNESS_TWICE' end, case when v <> supported then 'VERIFIER_WITHOUT_SUPPORT' end, case when r <> confirmed then 'REVIEWER_WITHOUT_NAME' end, case when confirmed and rejected then 'CONFIRMED_AND_REJECTED' end], lambda x: x is not null)) as rule from certificates""",
)
def certificate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as certificates that contradict themselves."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    witnesses = F.array_compact(F.array(F.lit("structure"), F.when(part % 13 == 0, "structure"), F.when(supp % 3 == 0, "verifier"), F.when(supp % 5 == 0, "reviewer")))
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct().select(
        F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("assertion_id"), F.when(part % 17 != 0, F.array(F.lit("p1.b1"))).alias("evidence"), witnesses.alias("witnesses"),
        F.when(part % 3 == 0, "supported").otherwise("unclear").alias("verdict"), F.when(part % 5 == 0, "human").alias("confirmed_by"), F.when(part % 35 == 0, "human").alias("rejected_by"),
    )
    return V.certificate_violations(rows)


@query("j08_remedies_in_context")
def remedies_with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remedies of the first line of a flag offered to the causes of its later lines, in their context; held against a loop in a test."""
    causes, remedies = inherited_rows(spark, sf_dir)
    return remedies_in_context(causes, remedies, 20)


def inherited_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(causes, remedies) of units of eight orders: a row for each order and line, remedies in spellings that are alike."""
    lines = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    base = lines.select(
        F.floor(F.col("l_orderkey") / 8).alias("unit_id"), (F.col("l_linenumber") % 4).cast("long").alias("row"), F.col("p_name").alias("cause"), F.concat_ws(" ", F.lit("Replace the"), "p_type", F.when(F.col("l_suppkey") % 2 == 0, "now")).alias("action"),
        F.when(F.col("l_quantity") > 40, "if hot").alias("context"), F.concat_ws("/", F.lpad("l_orderkey", 9, "0"), "l_linenumber", "l_partkey", "l_suppkey").alias("ord"),
    ).distinct()
    return base.select("unit_id", "row", F.when(F.col("row") > 0, F.col("row") - 1).otherwise(0).alias("origin"), "cause"), base
