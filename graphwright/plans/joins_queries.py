"""Queries of the joins beyond equality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphwright.operators import certify as C
from graphwright.operators import joins as J
from graphwright.plans import staging as S
from graphwright.plans.graph_queries import _FINE_ASSERTION
from graphwright.registry import query
from graphwright.sources.tables import read_table


@query(
    "j13_contained_names",
    """with named as (select p_brand, min(p_partkey) as key, list_distinct(regexp_extract_all(lower(p_name || case when p_size > 25 then ' ' || p_type else '' end), '[a-z0-9]+')) as words, p_name, p_size > 25 as wide, p_type from part group by p_brand, p_name, p_size > 25, p_type)
    select a.p_brand, a.key as short_key, b.key as long_key from named a join named b on a.p_brand = b.p_brand and len(a.words) >= 2 and len(a.words) < len(b.words) and list_has_all(b.words, a.words)""",
)
def contained_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names within longer part names of the same brand; large parts are named with their type."""
    parts = read_table(spark, sf_dir, "part").withColumn("wide", F.col("p_size") > 25)
    named = parts.groupBy("p_brand", "p_name", "wide", "p_type").agg(F.min("p_partkey").alias("key"))
    name = F.concat("p_name", F.when(F.col("wide"), F.concat(F.lit(" "), "p_type")).otherwise(""))
    return J.contained_names(named, "p_brand", "key", F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9]+)"), 1))


@query(
    "j15_shared_part_numbers",
    """with tokens as (select doc_id, lang, list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z0-9-]{5,}'), lambda t: (regexp_matches(t, '[0-9]') and regexp_matches(t, '[A-Za-z]')) or regexp_matches(t, '^[0-9]{6,}$'))) as parts from documents),
    each_ as (select lang, doc_id, unnest(parts) as token from tokens)
    select a.lang, a.doc_id as left_key, b.doc_id as right_key, count(*) as shared from each_ a join each_ b on a.lang = b.lang and a.token = b.token and a.doc_id < b.doc_id group by all""",
)
def shared_part_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one language that share part numbers."""
    from graphwright.functions.text import part_numbers

    return J.shared_tokens(read_table(spark, sf_dir, "documents"), "lang", "doc_id", part_numbers(F.col("text")))


@query(
    "j46_overlapping_ownership",
    """with spans as (select l_orderkey as doc_id, l_linenumber * 100000 + l_suppkey as owner, (l_partkey % 500)::bigint as start, (l_partkey % 500 + l_quantity)::bigint as stop from lineitem)
    select distinct a.doc_id, a.owner as left_owner, b.owner as right_owner, greatest(a.start, b.start) as start, least(a.stop, b.stop) as stop from spans a join spans b on a.doc_id = b.doc_id and a.owner < b.owner and a.start < b.stop and b.start < a.stop""",
)
def overlapping_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a document that two units own."""
    start = (F.col("l_partkey") % 500).cast("long")
    spans = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("owner"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("stop"))
    return J.overlapping_spans(spans, "doc_id", 64)


@query(
    "j04_merged_cell_boundaries",
    """with cells as (select l_orderkey as doc_id, l_linenumber * 1000000 + l_partkey as row, l_quantity as top, (l_suppkey % 50)::double as x0, (l_suppkey % 50 + 20)::double as x1 from lineitem),
    rules as (select l_orderkey as doc_id, l_quantity + 1.5 as y, (l_partkey % 40)::double as x0, (l_partkey % 40 + 45)::double as x1 from lineitem where l_returnflag = 'R')
    select doc_id, row, top, x0, x1 from cells c where not exists (select 1 from rules r where r.doc_id = c.doc_id and abs(c.top - r.y) <= 2 and r.x0 <= c.x0 and r.x1 >= c.x1)""",
)
def merged_cell_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that no rule separates from the row above."""
    items = read_table(spark, sf_dir, "lineitem")
    x, r = (F.col("l_suppkey") % 50).cast("double"), (F.col("l_partkey") % 40).cast("double")
    cells = items.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("row"), F.col("l_quantity").alias("top"), x.alias("x0"), (x + 20).alias("x1"))
    rules = items.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_quantity") + 1.5).alias("y"), r.alias("x0"), (r + 45).alias("x1"))
    return J.boundary_cells(cells, rules, 2)


@query(
    "j24_resolved_references",
    """with refs as (select o_orderkey, (o_custkey * 31 + o_orderkey * 17) % 100003 as label, o_orderstatus as kind from orders), targets as (select distinct (l_partkey * 7 + l_suppkey * 13) % 100003 as label, l_returnflag as kind_, l_orderkey as t from lineitem),
    found as (select label, case kind_ when 'A' then 'F' else 'O' end as kind, count(distinct t) as n, min(t) as t from targets group by all)
    select r.o_orderkey, r.kind, r.label, case when n is null then 'Missing' when n = 1 then 'Resolved' else 'Ambiguous' end as status, case when n = 1 then t end as target from refs r left join found f on r.label = f.label and r.kind = f.kind""",
)
def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References resolved to their only target."""
    refs = read_table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_custkey") * 31 + F.col("o_orderkey") * 17) % 100003).alias("label"), F.col("o_orderstatus").alias("kind"))
    targets = read_table(spark, sf_dir, "lineitem").select(
        ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 13) % 100003).alias("label"), F.when(F.col("l_returnflag") == "A", "F").otherwise("O").alias("kind"), F.col("l_orderkey").alias("target")
    )
    return J.unique_resolution(refs, targets, ["label", "kind"]).select("o_orderkey", "kind", "label", "status", "target")


@query(
    "g07_single_partners",
    f"""with {S.FINE_PROPOSAL}, links as (select distinct source_name, target_name from proposal where relation_type = 'RESOLVED_BY'), counted as (select *, count(*) over (partition by source_name) as n from links)
    select source_name, target_name from counted where n = 1""",
)
def single_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causes with exactly one action."""
    rows = S.proposals(spark, sf_dir, fine=True).filter("relation_type = 'RESOLVED_BY'")
    return J.single_partner(rows, "source_name", "target_name")


@query(
    "j41_narrowed_references",
    """with refs as (select l_orderkey, l_linenumber, l_partkey, p_name like '%bolt%' or p_name like '%ring%' as hit from lineitem join part on l_partkey = p_partkey), flagged as (select *, bool_or(hit) over (partition by l_orderkey) as any_hit from refs)
    select l_orderkey, l_linenumber, l_partkey from flagged where hit or not any_hit""",
)
def narrowed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of an order that name a bolt or ring, or all of them."""
    refs = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return J.narrowed(refs, "l_orderkey", F.col("p_name").contains("bolt") | F.col("p_name").contains("ring")).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "j28_branch_alignment",
    """with gold as (select distinct l_suppkey as gold_id, l_partkey as ref from lineitem), pred as (select distinct l_orderkey as pred_id, l_partkey as ref from lineitem), sizes as (select pred_id, count(*) as n from pred group by pred_id),
    hits as (select pred_id, gold_id, count(*) as m from pred join gold using (ref) group by all), inside as (select h.pred_id, count(*) as candidates, min(gold_id) as g from hits h join sizes s on h.pred_id = s.pred_id and m = n group by h.pred_id)
    select s.pred_id, case when candidates = 1 then g end as gold_id, coalesce(candidates, 0) as candidates from sizes s left join inside i on s.pred_id = i.pred_id""",
)
def branch_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders aligned to the only supplier that delivers all of their parts."""
    items = read_table(spark, sf_dir, "lineitem")
    gold = items.select(F.col("l_suppkey").alias("gold_id"), F.col("l_partkey").alias("ref"))
    return J.subset_alignment(gold, items.select(F.col("l_orderkey").alias("pred_id"), F.col("l_partkey").alias("ref")))


@query(
    "g08_remedy_overlap",
    """with actions as (select distinct l_linestatus || l_returnflag as origin, l_partkey as cause, l_suppkey as action from lineitem), sizes as (select origin, cause, count(*) as n from actions group by all),
    shared as (select a.origin, a.cause as left_cause, b.cause as right_cause, count(*) as shared from actions a join actions b on a.origin = b.origin and a.action = b.action and a.cause < b.cause group by all)
    select s.origin, s.left_cause, s.right_cause, s.shared from shared s join sizes a on a.origin = s.origin and a.cause = s.left_cause join sizes b on b.origin = s.origin and b.cause = s.right_cause where s.shared >= 2 and s.shared >= 0.6 * (a.n + b.n - s.shared)""",
)
def remedy_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causes that share most of their actions."""
    rows = read_table(spark, sf_dir, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("origin"), F.col("l_partkey").alias("cause"), F.col("l_suppkey").alias("action"))
    return J.remedy_overlap(rows, 2, 0.6)


@query(
    "j09_same_record",
    f"""with {S.TABLE_ROW}, parts as (select *, sum((status <> '')::int) over (partition by doc_id order by row) as block from table_row)
    select a.doc_id, a.row, b.row as other from parts a join parts b on a.doc_id = b.doc_id and a.block = b.block and a.row < b.row""",
)
def same_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table that one merged cell covers."""
    block = F.sum((F.col("status") != "").cast("int")).over(Window.partitionBy("doc_id").orderBy("row"))
    rows = S.table_rows(spark, sf_dir).select("doc_id", "row", block.alias("block"))
    return rows.join(rows.select("doc_id", "block", F.col("row").alias("other")), ["doc_id", "block"]).filter("row < other").select("doc_id", "row", "other")


@query(
    "j01_cited_segments",
    f"""with {S.SEGMENT}, cites as (select doc_id, unnest(['p1.b1', 'p1.b' || (doc_id % 5 + 1), 'p9.b1']) as cite, unnest([1, 2, 3]) as ord from documents)
    select c.doc_id, c.ord, s.segment_id, length(s.text) as chars from cites c join segment s on s.doc_id = c.doc_id and s.segment_id = c.cite""",
)
def cited_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cites joined to their segments in order; those of no segment drop out."""
    cites = F.array(F.lit("p1.b1"), F.concat(F.lit("p1.b"), (F.col("doc_id") % 5 + 1).cast("string")), F.lit("p9.b1"))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(cites).alias("i", "segment_id"))
    return rows.join(S.segments(spark, sf_dir), ["doc_id", "segment_id"]).select("doc_id", (F.col("i") + 1).alias("ord"), "segment_id", F.length("text").alias("chars"))


@query(
    "j31_new_links",
    f"""with {_FINE_ASSERTION}, dated as (select relation_type, source_name, target_name, o_orderdate >= date '1995-06-17' as late from assertion join orders on o_orderkey = unit_id where tier = 'green'), late as (select distinct relation_type, source_name, target_name from dated where late), early as (select distinct relation_type, source_name, target_name from dated where not late)
    select * from late l where not exists (select 1 from early e where e.relation_type = l.relation_type and e.source_name = l.source_name and e.target_name = l.target_name)""",
)
def new_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Green relations of the later units, by order date, that earlier ones don't have."""
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), (F.col("o_orderdate") >= F.lit("1995-06-17").cast("date")).alias("late"))
    green = C.assertions(S.proposals(spark, sf_dir, fine=True, by_unit=True)).filter("tier = 'green'").join(orders, "unit_id")
    return J.new_links(green, F.col("late"), ["relation_type", "source_name", "target_name"])


@query(
    "j40_experiment_matrix",
    """select l_suppkey, c.name as condition, r.replica, ceil(count(*) / 25.0)::bigint as batches, (count(*) * c.calls)::bigint as calls from lineitem, (values ('base', 1), ('quality', 3)) c(name, calls), (values (1), (2), (3)) r(replica) group by l_suppkey, c.name, c.calls, r.replica""",
)
def experiment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier under both conditions in three replicas, with estimated batches and calls."""
    sizes = read_table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    runs = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(k).alias("k"), F.lit(r).alias("replica")) for c, k in (("base", 1), ("quality", 3)) for r in (1, 2, 3)]))
    return sizes.withColumn("run", runs).select("l_suppkey", "run.condition", "run.replica", F.ceil(F.col("n") / 25).alias("batches"), (F.col("n") * F.col("run.k")).alias("calls"))
