"""Queries of sources that are texts, of page layout, and of what is shown to a verifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphwright.functions import text as T
from graphwright.operators import joins as J
from graphwright.operators import layout as L
from graphwright.operators import scoring as G
from graphwright.plans import graph_staging as GS
from graphwright.plans import staging as S
from graphwright.plans.layout_queries import _CONTINUES, _NUMBERED
from graphwright.plans.scoring_queries import _CLAIM, _WILSON, _claims
from graphwright.registry import query
from graphwright.sources import texts as X
from graphwright.sources.tables import read_table


@query("s10_strict_ledger", f"with {S.LEDGER} select call_id, seq, event, amount from ledger")
def strict_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger written as JSON lines and read back strictly."""
    rows = S.ledger(spark, sf_dir).select(F.to_json(F.struct("call_id", "seq", "event", "amount")).alias("line"))
    return X.json_lines(rows, "line", "call_id string, seq long, event string, amount long")


@query("s11_event_log", f"with {S.LIVE}, started as (select *, max(case when kind = 'run_started' then seq end) over (partition by run_id) as start from live) select run_id, seq, kind from started where start is null or seq >= start")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of each run from its last start, read from JSON lines."""
    from graphwright.operators.ledger import last_attempt

    lines = S.live_events(spark, sf_dir).select(F.to_json(F.struct("run_id", "seq", "kind")).alias("line"))
    return last_attempt(X.json_lines(lines, "line", "run_id long, seq long, kind string")).select("run_id", "seq", "kind")


@query(
    "s09_graph_texts",
    f"""with {GS.named(node=GS.NODE, edge=GS.EDGE)}, n as (select split_part(node_id, ':', 2)::bigint % 40 as g, count(*) as nodes from node where node_id <> 'ROOT' and node_id not like 'Y:%' group by g), e as (select split_part(source, ':', 2)::bigint % 40 as g, count(*) as edges from edge where source like 'C:%' group by g)
    select n.g, case when n.g % 10 = 7 then 'NOT_JSON' when n.g % 10 in (1, 4) then 'VERSION' when n.g % 10 = 9 then 'SHAPE' else 'READ' end as status, case when n.g % 10 <> 7 then nodes end as nodes, case when n.g % 10 <> 7 then coalesce(edges, 0) end as edges from n left join e on n.g = e.g where n.g is not null""",
)
def graph_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty graphs as JSON texts, some cut off, of other versions or with nameless nodes.

    A graph grows with the tables, so it comes in parts: nodes by ranges of their numbers, edges by
    ranges of the numbers of both ends. A part has at most 2,000 nodes of a type or 100,000 edges.
    """
    count = lambda c: F.try_to_number(F.split_part(c, F.lit(":"), F.lit(2)), F.lit("999999999999")).cast("long")
    number = lambda c: count(c) % 40
    nodes = GS.rows(spark, sf_dir, GS.NODE).filter("node_id not like 'Y:%' and node_id <> 'ROOT'")
    node = F.struct(F.when(number("node_id") % 10 != 9, F.col("node_id")).alias("id"), "type", "name")
    n = nodes.groupBy(number("node_id").alias("g"), F.floor(count("node_id") / (40 * 2000)).alias("a")).agg(F.collect_list(node).alias("nodes"))
    edge = F.struct(F.col("edge_id").alias("id"), "type", F.col("source").alias("from"), F.col("target").alias("to"))
    edges = GS.rows(spark, sf_dir, GS.EDGE).filter("source like 'C:%'")
    e = edges.groupBy(number("source").alias("g"), F.floor(count("source") / (40 * 200)).alias("a"), F.floor(count("target") / 500).alias("b")).agg(F.collect_list(edge).alias("edges"))
    e = e.join(n.select("g").distinct(), "g", "left_semi")
    none = lambda df, c: F.array().cast(df.schema[c].dataType).alias(c)
    parts = n.select("g", "nodes", none(e, "edges")).unionByName(e.select("g", none(n, "nodes"), "edges"))
    version = F.when((F.col("g") % 10).isin(1, 4), 1).otherwise(3)
    text = F.when(F.col("g") % 10 == 7, F.lit("not a graph")).otherwise(F.to_json(F.struct(version.alias("version"), "nodes", "edges")))
    return X.graphs_in_parts(parts.select("g", text.alias("text")), "g", "text")


@query(
    "s21_verified_bundles",
    "with files as (select page_id % 60 as bundle, url as path, md5(html) as digest, page_id from pages), manifest as (select bundle, path, case when page_id % 31 = 5 then 'old' else digest end as digest from files where bundle % 6 <> 0), both_ as (select coalesce(f.bundle, m.bundle) as bundle, f.digest is distinct from m.digest as wrong, m.digest as named from files f full join manifest m on f.bundle = m.bundle and f.path = m.path) select bundle, case when count(named) = 0 then 'LEGACY_UNVERIFIED' when bool_or(wrong) then 'STALE' else 'VERIFIED' end as status from both_ group by bundle",
)
def verified_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in bundles against manifests."""
    files = read_table(spark, sf_dir, "pages").select((F.col("page_id") % 60).alias("bundle"), F.col("url").alias("path"), F.md5("html").alias("digest"), "page_id")
    manifest = files.filter("bundle % 6 <> 0").select("bundle", "path", F.when(F.col("page_id") % 31 == 5, "old").otherwise(F.col("digest")).alias("digest"))
    return X.verified_bundles(files, manifest, "bundle")


@query(
    "s12_run_states",
    "with files as (select user_id as run_id, event_type || '_' || event_id as name, ts as modified from events), ranked as (select *, case when name like 'signup%' then 0 when name like 'view%' then 1 when name like 'purchase%' then 2 else 3 end as rank from files) select run_id, name, rank, row_number() over (partition by run_id order by rank, modified, name)::int as place from ranked",
)
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved states of each run in the order of the pipeline."""
    files = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.concat_ws("_", "event_type", "event_id").alias("name"), F.col("ts").alias("modified"))
    return X.ranked_states(files, ("signup", "view", "purchase"), "run_id").select("run_id", "name", "rank", "place")


@query(
    "s13_catalog",
    "with runs as (select c_nationkey as manual, c_custkey as run, case when c_custkey % 2 = 0 then 'archive' else 'current' end as root from customer), files as (select o_custkey as run, list_distinct(list(o_orderpriority)) as names from orders group by o_custkey), complete as (select r.*, coalesce(list_has_all(names, ['1-URGENT', '2-HIGH']), false) as complete from runs r left join files f using (run)) select manual, count(*) as runs, count(*) filter (where complete) as complete, max(run) filter (where complete) as last_run, count(distinct root) as roots from complete group by manual",
)
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manuals with their runs in two roots; a run is complete if it has all required files."""
    required = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    files = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.collect_set("o_orderpriority").alias("names"))
    customers = read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("manual"), F.col("c_custkey").alias("run"))
    roots = customers.filter("run % 2 = 0").withColumn("root", F.lit("archive")).unionByName(customers.filter("run % 2 <> 0").withColumn("root", F.lit("current")))
    done = F.coalesce(F.size(F.array_except(required, F.col("names"))) == 0, F.lit(False))
    runs = roots.join(files, "run", "left").withColumn("complete", done)
    return runs.groupBy("manual").agg(F.count(F.lit(1)).alias("runs"), F.count_if("complete").alias("complete"), F.max(F.when(F.col("complete"), F.col("run"))).alias("last_run"), F.count_distinct("root").alias("roots"))


@query("s03_selective_reading", "with pages_ as (select source, doc_id as page, n_chars < 900 or doc_id % 8 = 0 as wanted from documents), placed as (select *, row_number() over (partition by source, wanted order by page) as n from pages_) select source, case when not wanted then 'not_needed' when n <= 12 then 'read' else 'skipped_budget' end as outcome, count(*) as pages, min(page) as first_page from placed group by all")
def selective_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which short documents of each source are read again within a budget."""
    pages = read_table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), "n_chars")
    out = X.selective_reading(pages, "source", (F.col("n_chars") < 900) | (F.col("page") % 8 == 0), 12)
    return out.groupBy("source", "outcome").agg(F.count(F.lit(1)).alias("pages"), F.min("page").alias("first_page"))


@query("s23_page_texts", f"with {S.SEGMENT} select doc_id, page, md5(string_agg('[' || segment_id || '] ' || text, chr(10) order by pos)) as text_hash, count(*) as segments from segment group by doc_id, page")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored text of each page in physical order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "segment_id", "text"))), lambda s: F.concat(F.lit("["), s["segment_id"], F.lit("] "), s["text"]))
    return S.segments(spark, sf_dir).groupBy("doc_id", "page").agg(F.md5(F.array_join(lines, "\n")).alias("text_hash"), F.count(F.lit(1)).alias("segments"))


@query(
    "s04_evidence_units",
    f"""with {S.SEGMENT}, units as (select doc_id, page, 'page' as kind, 'p' || page as unit, null::varchar as parent from segment group by doc_id, page union all select doc_id, page, case when text like '%|%' then 'table_row' else 'block' end, segment_id, 'p' || page from segment where page % 7 <> 6)
    select doc_id, kind, count(*) as units, count(parent) as children, count(distinct page) as pages from units group by doc_id, kind""",
)
def evidence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, blocks and rows as units with their parents; pages out of scope give no evidence."""
    segments = S.segments(spark, sf_dir)
    parent = F.concat(F.lit("p"), "page")
    pages = segments.select("doc_id", "page").distinct().select("doc_id", "page", F.lit("page").alias("kind"), F.lit(None).cast("string").alias("parent"))
    kind = F.when(F.col("text").contains("|"), "table_row").otherwise("block")
    units = pages.unionByName(segments.filter("page % 7 <> 6").select("doc_id", "page", kind.alias("kind"), parent.alias("parent")))
    return units.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("units"), F.count("parent").alias("children"), F.count_distinct("page").alias("pages"))


_BLOCK = "select l_orderkey as page, l_linenumber * 1000000 + l_partkey as pos, l_quantity * 10 as top, (l_partkey % 40) * 1.0 as x0, (l_partkey % 40) * 1.0 + 20 as x1, 'part ' || (l_partkey % 90) as words from {lineitem}"
_TABLE = "select o_orderkey as page, (o_custkey % 40) * 10.0 as top, (o_custkey % 40) * 10.0 + 200 as bottom, (o_custkey % 30) * 1.0 as x0, (o_custkey % 30) * 1.0 + 60 as x1, 'rows part ' || (o_custkey % 90) || ' part ' || (o_custkey % 89) || ' part 1 part 2' as words from {orders}"


@query("j02_placed_tables", f"with {GS.named(block=_BLOCK, tab=_TABLE)}, firsts as (select t.page, t.top, arg_min(b.pos, (b.top, b.pos)) as before_ from tab t left join block b on b.page = t.page and b.top >= t.top - 1 group by t.page, t.top) select page, top, before_ as before_block from firsts")
def placed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block before which each table is read, or none at the end of its page."""
    return J.placed_before(GS.rows(spark, sf_dir, _TABLE), GS.rows(spark, sf_dir, _BLOCK), 1.0)


@query(
    "j03_blocks_in_tables",
    f"with {GS.named(block=_BLOCK, tab=_TABLE)} select b.page, b.pos from block b where not exists (select 1 from tab t where t.page = b.page and b.top >= t.top - 1 and b.top <= t.bottom + 1 and b.x0 >= t.x0 - 1 and b.x1 <= t.x1 + 1 and contains(replace(t.words, ' ', ''), replace(b.words, ' ', '')))",
)
def blocks_in_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that no table of their page repeats, by place and by words."""
    return J.outside_tables(GS.rows(spark, sf_dir, _BLOCK), GS.rows(spark, sf_dir, _TABLE), 1.0).select("page", "pos")


@query("a22_micro_recall", f"with {_CLAIM}, totals as (select lang, sum(found)::double as h, sum(claims)::double as n from hit group by lang) select lang, h::bigint as hits, n::bigint as total, {_WILSON} from totals")
def micro_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims found of all, by language, with the interval."""
    return G.micro_recall(_claims(spark, sf_dir), "lang")


@query(
    "w05_sequence_heads",
    f"""with {S.SEGMENT.replace("line as text", f"replace({_NUMBERED.replace('text', 'line')}, 'pos', 'pos') as text").replace("case pos", "case (i + 1)")}, {_CONTINUES}, numbers as (select *, case when not continues then try_cast(nullif(regexp_extract(text, '{T.STEP}', 1), '') as int) end as number from continued),
    lasts as (select *, last_value(number ignore nulls) over (partition by doc_id order by page, pos rows between unbounded preceding and 1 preceding) as last from numbers), firsts as (select *, number is not null and (number = 1 or last is null or number < last) as new from lasts)
    select doc_id, count(*) filter (where new) as sequences, count(number) as steps from firsts group by doc_id having count(number) > 0""",
)
def sequence_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered sequences of documents and their steps, sub-steps not counted."""
    rows = S.segments(spark, sf_dir).withColumn("text", F.expr(_NUMBERED))
    steps = L.numbered_steps(L.continuations(rows))
    number = F.regexp_extract("step", "^([0-9]+)$", 1)
    own = steps.filter(~F.col("continues")).withColumn("n", F.nullif(number, F.lit(""))).filter(F.col("n").isNotNull() & F.col("text").rlike(T.STEP))
    return own.groupBy("doc_id").agg(F.count_distinct("sequence").alias("sequences"), F.count(F.lit(1)).alias("steps"))


@query("l27_verifier_passages", f"with {S.SEGMENT}, owned as (select doc_id, page, min(pos) as a, max(pos) as b from segment group by doc_id, page) select o.doc_id, o.page, md5(string_agg(case when s.page = o.page then '' else '(context) ' end || '[' || s.segment_id || '] ' || s.text, chr(10) order by s.pos)) as passage, count(*) as lines from owned o join segment s on s.doc_id = o.doc_id and s.page between o.page - 1 and o.page group by o.doc_id, o.page")
def verifier_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a verifier reads of each page: the page before as context, then the page itself, in reading order."""
    segments = S.segments(spark, sf_dir)
    shown = segments.select("doc_id", "page", F.explode(F.array(F.col("page"), F.col("page") + 1)).alias("of"), "pos", "segment_id", "text")
    line = F.concat(F.when(F.col("page") == F.col("of"), "").otherwise("(context) "), F.lit("["), "segment_id", F.lit("] "), "text")
    own = segments.select("doc_id", F.col("page").alias("of")).distinct()
    rows = shown.select("doc_id", "of", "pos", line.alias("line")).join(own, ["doc_id", "of"], "left_semi")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n")
    return rows.groupBy("doc_id", F.col("of").alias("page")).agg(F.md5(text).alias("passage"), F.count(F.lit(1)).alias("lines"))


@query(
    "a45_archived_votes",
    "with votes as (select md5(l_partkey || '|' || (l_suppkey % 5)) as request, l_partkey % 300 as pair, l_returnflag = 'A' as same, row_number() over (partition by l_partkey, l_suppkey % 5 order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_suppkey) as n from lineitem) select pair, count(*) as votes, sum(same::int)::bigint as same from votes where n <= 3 group by pair",
)
def archived_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each request the last three answers, counted by pair."""
    order = Window.partitionBy("l_partkey", F.col("l_suppkey") % 5).orderBy(F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), "l_suppkey")
    last = read_table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order)).filter("n <= 3")
    return last.groupBy((F.col("l_partkey") % 300).alias("pair")).agg(F.count(F.lit(1)).alias("votes"), F.sum((F.col("l_returnflag") == "A").cast("int")).alias("same"))


@query(
    "a46_merge_replay",
    f"with {S.FINE_PROPOSAL}, e as (select relation_type, source_name, target_name, regexp_replace(source_name, ' [0-9]+$', '') as s, regexp_replace(target_name, ' [0-9]+$', '') as t from proposal), before_ as (select relation_type, count(distinct source_name || '|' || target_name) as edges, count(distinct source_name) as sources from e group by all), after_ as (select relation_type, count(distinct s || '|' || t) as edges, count(distinct s) as sources from e group by all) select b.relation_type, b.edges as edges_before, a.edges as edges_after, a.edges - b.edges as edges_delta, a.sources - b.sources as sources_delta from before_ b join after_ a using (relation_type)",
)
def merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What merging numbered names would change of the graph's sizes."""
    rows = S.proposals(spark, sf_dir, fine=True)
    plain = lambda c: F.regexp_replace(c, " [0-9]+$", "")
    return G.merge_effect(rows, "relation_type", (F.col("source_name"), F.col("target_name")), (plain("source_name"), plain("target_name")))


@query(
    "a44_run_facts",
    f"with {S.LIVE}, state as (select run_id, count(*) as events, count(*) filter (where kind = 'unit_extracted') as units, round(sum(case when kind = 'unit_extracted' then value else 0 end), 2) as cost, count(*) filter (where kind = 'run_failed') as failures, date_diff('second', min(happened), max(happened)) as seconds from live group by run_id) select * from state",
)
def run_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report says about each run."""
    live = S.live_events(spark, sf_dir)
    cents = F.when(F.col("kind") == "unit_extracted", F.col("value")).otherwise(0.0)
    second = lambda c: F.unix_timestamp(c)
    return live.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("kind") == "unit_extracted").alias("units"), F.round(F.sum(cents), 2).alias("cost"), F.count_if(F.col("kind") == "run_failed").alias("failures"),
        (F.max(second("happened")) - F.min(second("happened"))).alias("seconds"),
    )
