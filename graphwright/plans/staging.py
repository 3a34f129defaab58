"""How the given tables become the contracts of the operators, in Spark and in DuckDB SQL.

The tables hold no manuals, so each contract is derived by a fixed rule: lines of documents are
segments, order lines are table rows and proposed relations, events are logs. Names of the SQL
texts say which common table expressions they define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphwright.sources.tables import read_table

#: Lines of a document that make up one page.
PAGE_LINES = 10


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment(doc_id, page, pos, segment_id, text): the non-blank lines of documents."""
    lines = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.filter(F.btrim("line") != "").select(
        "doc_id",
        (F.floor(F.col("i") / PAGE_LINES) + 1).cast("int").alias("page"),
        (F.col("i") + 1).alias("pos"),
        F.concat(F.lit("p"), (F.floor(F.col("i") / PAGE_LINES) + 1).cast("string"), F.lit(".b"), (F.col("i") + 1).cast("string")).alias("segment_id"),
        F.col("line").alias("text"),
    )


SEGMENT = f"""
lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents
), segment as (
  select doc_id, (i // {PAGE_LINES} + 1)::int as page, (i + 1)::int as pos,
    'p' || (i // {PAGE_LINES} + 1) || '.b' || (i + 1) as segment_id, line as text
  from lines where trim(line) <> ''
)"""


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_row(doc_id, row, headers, cells): order lines as table rows; a cell equal to the one above is blank."""
    items = read_table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"
    )
    cells = {"status": F.col("l_returnflag"), "line": F.col("l_linestatus"), "year": F.year("l_shipdate").cast("string")}
    rows = items.select("l_orderkey", F.row_number().over(order).alias("row"), *[c.alias(n) for n, c in cells.items()])
    above = Window.partitionBy("l_orderkey").orderBy("row")
    return rows.select(
        F.col("l_orderkey").alias("doc_id"), "row", *[F.when(F.col(n) == F.lag(n).over(above), "").otherwise(F.col(n)).alias(n) for n in cells]
    )


TABLE_ROW = """
numbered as (
  select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice)::int as row,
    l_returnflag as status, l_linestatus as line, year(l_shipdate)::varchar as year
  from lineitem
), table_row as (
  select doc_id, row,
    case when status = lag(status) over w then '' else status end as status,
    case when line = lag(line) over w then '' else line end as line,
    case when year = lag(year) over w then '' else year end as year
  from numbered window w as (partition by doc_id order by row)
)"""


def proposals(spark: SparkSession, sf_dir: str, fine: bool = False, by_unit: bool = False) -> DataFrame:
    """proposal(unit_id, row, relation_type, source_name, target_name, read, verdict, structure, condition, record, reviewer, rejected, issue).

    Each order line states that its brand may indicate its part, and that its supplier resolves it.
    The line's number says who reviewed it; some are rejected, and some units have an issue.
    fine: names carry an order or supplier number too, so that the graph has gaps. by_unit: each unit's
    lines are shuffled to one task before they become proposals, so that what is grouped by unit is
    not shuffled again.
    """
    brand, part, cause = F.col("p_brand"), F.col("p_name"), F.col("p_name")
    if fine:
        brand = F.concat_ws(" ", brand, F.col("l_orderkey") % 500)
        part, cause = F.concat_ws(" ", part, F.col("l_suppkey") % 400), F.concat_ws(" ", cause, F.col("l_orderkey") % 400)
    items = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity"
    )
    named = items.join(read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(
        read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    sides = F.explode(
        F.array(
            F.struct(F.lit("MAY_INDICATE").alias("relation_type"), brand.alias("source_name"), part.alias("target_name")),
            F.struct(F.lit("RESOLVED_BY").alias("relation_type"), cause.alias("source_name"), F.col("s_name").alias("target_name")),
        )
    )
    if by_unit:
        named = named.select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "p_brand", "p_name", "s_name").repartition("l_orderkey")
    return named.select(
        F.col("l_orderkey").alias("unit_id"),
        F.col("l_linenumber").alias("row"),
        sides.alias("side"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.col("l_linenumber") % 3 + 1).alias("read"),
        F.when(F.col("l_returnflag") == "A", "supported").when(F.col("l_returnflag") == "R", "not_supported").alias("verdict"),
        (F.col("l_linestatus") == "F").alias("structure"),
        F.when(F.col("l_quantity") > 25, F.concat(F.lit("if "), F.col("l_returnflag"))).alias("condition"),
        F.concat_ws(".", F.lit("r"), F.col("l_orderkey"), F.col("l_linenumber")).alias("record"),
        F.when(F.col("l_linenumber") % 7 == 6, "human").when(F.col("l_linenumber") % 7 == 5, "auto").alias("reviewer"),
        ((F.col("l_orderkey") + F.col("l_linenumber")) % 23 == 0).alias("rejected"),
        F.when(F.col("l_orderkey") % 29 == 0, "MISSING_EVIDENCE").when(F.col("l_orderkey") % 31 == 0, "AMBIGUOUS_NAME").alias("issue"),
    ).select("unit_id", "row", "side.*", "read", "verdict", "structure", "condition", "record", "reviewer", "rejected", "issue")


PROPOSAL = """
named as (
  select l.*, p_brand, p_name, s_name from lineitem l join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
), sides as (
  select *, 'MAY_INDICATE' as relation_type, p_brand as source_name, p_name as target_name from named
  union all
  select *, 'RESOLVED_BY', p_name, s_name from named
), proposal as (
  select l_orderkey as unit_id, l_linenumber as row, relation_type, source_name, target_name,
    (['A', 'B', 'C'])[(l_linenumber % 3 + 1)::int] as read,
    case l_returnflag when 'A' then 'supported' when 'R' then 'not_supported' end as verdict,
    l_linestatus = 'F' as structure,
    case when l_quantity > 25 then 'if ' || l_returnflag end as condition,
    'r.' || l_orderkey || '.' || l_linenumber as record,
    case l_linenumber % 7 when 6 then 'human' when 5 then 'auto' end as reviewer, (l_orderkey + l_linenumber) % 23 = 0 as rejected,
    case when l_orderkey % 29 = 0 then 'MISSING_EVIDENCE' when l_orderkey % 31 = 0 then 'AMBIGUOUS_NAME' end as issue
  from sides
)"""
#: The same with fine names.
FINE_PROPOSAL = PROPOSAL.replace("'RESOLVED_BY', p_name, s_name from named", "'RESOLVED_BY', p_name || ' ' || l_orderkey % 400, s_name from named").replace(
    "p_brand as source_name, p_name as target_name from named", "p_brand || ' ' || l_orderkey % 500 as source_name, p_name || ' ' || l_suppkey % 400 as target_name from named"
)


def page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_map(manual, page, label, section, unsure, confirmed): documents as pages, labelled by quality and toxicity."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = read_table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left")
    return joined.select(
        F.floor(F.col("doc_id") / 100).cast("long").alias("manual"),
        (F.col("doc_id") % 100 + 1).cast("int").alias("page"),
        F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "parts").otherwise("diagnostic"))
        .when(F.col("quality") == 0, "procedure").otherwise("other").alias("label"),
        F.col("source").alias("section"),
        F.col("quality").isNull().alias("unsure"),
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("confirmed"),
    )


PAGE_MAP = """
page_map as (
  select (d.doc_id // 100)::bigint as manual, (d.doc_id % 100 + 1)::int as page,
    case when quality = 1 then case when toxic = 1 then 'parts' else 'diagnostic' end when quality = 0 then 'procedure' else 'other' end as label,
    source as section, quality is null as unsure, quality = 1 and toxic = 0 as confirmed
  from documents d left join labels l on d.doc_id = l.doc_id
)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ledger(call_id, seq, run_id, event, amount): sign-ups reserve and purchases finalise money, in millionths."""
    events = read_table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("signup", "click"), "call_reserved").when(F.col("event_type").isin("purchase", "error"), "call_finalized")
    return events.withColumn("event", kind).filter("event is not null").select(
        F.concat_ws("-", F.col("user_id"), (F.col("event_id") % 7)).alias("call_id"),
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("run_id"),
        "event",
        F.when(F.col("event_type") != "error", F.round(F.col("value") * 1000000).cast("long")).alias("amount"),
    )


LEDGER = """
ledger as (
  select user_id || '-' || (event_id % 7) as call_id, event_id as seq, user_id as run_id,
    case when event_type in ('signup', 'click') then 'call_reserved' else 'call_finalized' end as event,
    case when event_type <> 'error' then round(value * 1000000)::bigint end as amount
  from events where event_type in ('signup', 'click', 'purchase', 'error')
)"""


def live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """live(run_id, seq, happened, kind, item, cost): events as the log of a run; a sign-up starts a new attempt."""
    return read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("happened"),
        F.when(F.col("event_type") == "signup", "run_started").when(F.col("event_type") == "purchase", "unit_extracted")
        .when(F.col("event_type") == "error", "run_failed").otherwise("relations_checked").alias("kind"),
        (F.col("event_id") % 11).alias("item"),
        "value",
    )


LIVE = """
live as (
  select user_id as run_id, event_id as seq, ts as happened,
    case event_type when 'signup' then 'run_started' when 'purchase' then 'unit_extracted' when 'error' then 'run_failed' else 'relations_checked' end as kind,
    event_id % 11 as item, value
  from events
)"""
