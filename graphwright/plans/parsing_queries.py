r"""Queries of the text expressions on keys, pieces, references, digests and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphwright.functions import parsing as P
from graphwright.functions import text as T
from graphwright.functions.similar import similarity
from graphwright.plans import graph_staging as GS
from graphwright.plans import staging as S
from graphwright.registry import query
from graphwright.sources.tables import read_table

_ONE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query("x06_text_keys", r"with keyed as (select doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) as key from documents) select md5(key) as key_hash, count(*) as documents, min(doc_id) as first_doc, min(length(key)) as chars from keyed group by key")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that say the same but for case and punctuation."""
    keyed = read_table(spark, sf_dir, "documents").select("doc_id", P.text_key(F.col("text")).alias("key"))
    return keyed.groupBy(F.md5("key").alias("key_hash")).agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"), F.min(F.length("key")).cast("long").alias("chars"))


@query("x07_block_pieces")
def block_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of whole documents, at most 700 characters but for longer sentences; held against brute force in a test."""
    pieces = P.split_block(F.col("text"))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pieces).alias("piece", "text")).select("doc_id", "piece", F.length("text").alias("chars"), F.md5("text").alias("text_hash"))


@query(
    "x08_rendered_rows",
    f"""with {S.TABLE_ROW}, filled as (select *, last_value(nullif(status, '') ignore nulls) over w as s, last_value(nullif(line, '') ignore nulls) over w as l, last_value(nullif(year, '') ignore nulls) over w as y from table_row window w as (partition by doc_id order by row rows between unbounded preceding and current row))
    select doc_id, row, '[r' || row || '] status' || case when status = '' then ' (same as row above)' else '' end || ': ' || s || ' | line' || case when line = '' then ' (same as row above)' else '' end || ': ' || l || ' | year' || case when year = '' then ' (same as row above)' else '' end || ': ' || y as text from filled""",
)
def rendered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows as one line each, with headers and inherited cells."""
    upto = Window.partitionBy("doc_id").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    cells = [P.rendered_cell(F.lit(n), F.last(F.nullif(F.col(n), F.lit("")), ignorenulls=True).over(upto), F.col(n) == "") for n in ("status", "line", "year")]
    return S.table_rows(spark, sf_dir).select("doc_id", "row", F.concat(F.lit("[r"), "row", F.lit("] "), F.concat_ws(" | ", *cells)).alias("text"))


@query(
    "x11_page_numbers",
    """with texts as (select c_custkey, c_custkey % 7 + 1 as a, c_custkey % 7 + 1 + c_nationkey % 4 as b from customer)
    select c_custkey, unnest(list_concat([a], generate_series(b, b + c_custkey % 3)))::int as page from texts""",
)
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of lists like 3, 5–7."""
    a = F.col("c_custkey") % 7 + 1
    b = a + F.col("c_nationkey") % 4
    text = F.concat(a.cast("string"), F.lit(", "), b.cast("string"), F.lit("–"), (b + F.col("c_custkey") % 3).cast("string"), F.lit(", none"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", F.explode(P.page_numbers(text)).alias("page"))


@query(
    "x13_open_lines",
    rf"""with {S.SEGMENT} select doc_id, count(*) as lines, count(*) filter (where regexp_matches(text, '[^.!?:;)\]]$')) as open_lines, count(*) filter (where regexp_matches(text, '^[Cc][Oo][Ll][0-9]+$')) as generic from segment group by doc_id""",
)
def open_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that end inside a sentence, and generic headers, by document."""
    return S.segments(spark, sf_dir).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("text").rlike(T.OPEN_END)).alias("open_lines"), F.count_if(F.col("text").rlike(P.GENERIC_HEADER)).alias("generic")
    )


@query("x15_declared_aliases", f"with {S.SEGMENT} select doc_id, segment_id from segment where regexp_matches(case when pos % 7 = 0 then 'Also Called ' || text when pos % 11 = 0 then upper(text) else text end, '(?i)also called|aka|also known')")
def declared_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that declare an alias; some are made to."""
    text = F.when(F.col("pos") % 7 == 0, F.concat(F.lit("Also Called "), "text")).when(F.col("pos") % 11 == 0, F.upper("text")).otherwise(F.col("text"))
    return S.segments(spark, sf_dir).filter(text.rlike(P.DECLARED_ALIAS)).select("doc_id", "segment_id")


@query(
    "x18_list_pieces",
    """with texts as (select c_custkey, '1. ' || c_name || chr(10) || '• ' || c_mktsegment || ' 2) ' || c_nationkey as text from customer)
    select c_custkey, unnest([c_name, c_mktsegment, c_nationkey::varchar]) as piece, unnest([0, 1, 2])::int as place from texts join customer using (c_custkey)""",
)
def list_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' fields written as lists and taken apart again."""
    text = F.concat(F.lit("1. "), "c_name", F.lit("\n• "), "c_mktsegment", F.lit(" 2) "), F.col("c_nationkey").cast("string"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(P.list_pieces(text)).alias("place", "piece"))


@query(
    "x19_matrix_numbers",
    r"""with texts as (select l_orderkey, min(l_linenumber) as n, case when l_orderkey % 2 = 0 then string_agg((l_partkey % 90)::varchar, ' * ' order by l_linenumber, l_partkey, l_suppkey) else string_agg((l_partkey % 90)::varchar, '; ' order by l_linenumber, l_partkey, l_suppkey) end as numbers from lineitem group by l_orderkey), found as (select l_orderkey, regexp_extract_all('row ' || l_orderkey || ': ' || numbers, '\b[0-9]+(?:\s*[*;,|]\s*[0-9]+){2,}\b') as runs from texts)
    select l_orderkey, len(runs) as runs, len(regexp_extract_all(runs[1], '[0-9]+')) as numbers from found where len(runs) > 0""",
)
def matrix_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of numbers in lines that list the parts of an order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda s: (s["l_partkey"] % 90).cast("string"))
    texts = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(parts.alias("p")).withColumn("numbers", F.when(F.col("l_orderkey") % 2 == 0, F.array_join("p", " * ")).otherwise(F.array_join("p", "; ")))
    runs = P.matrix_numbers(F.concat(F.lit("row "), F.col("l_orderkey").cast("string"), F.lit(": "), "numbers"))
    return texts.select("l_orderkey", runs.alias("r")).filter(F.size("r") > 0).select("l_orderkey", F.size("r").cast("long").alias("runs"), F.size(F.col("r")[0]).cast("long").alias("numbers"))


@query(
    "x26_plain_rows",
    f"""with {S.TABLE_ROW}, filled as (select *, last_value(nullif(status, '') ignore nulls) over w as s, last_value(nullif(line, '') ignore nulls) over w as l, last_value(nullif(year, '') ignore nulls) over w as y from table_row window w as (partition by doc_id order by row rows between unbounded preceding and current row))
    select doc_id, row, s || ' | ' || l || ' | ' || y as text from filled""",
)
def plain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered rows without their labels: the values again."""
    rows = rendered_rows(spark, sf_dir)
    return rows.select("doc_id", "row", P.plain_cells(F.regexp_replace("text", r"^\[r[0-9]+\] ", "")).alias("text"))


@query("x27_scoring_keys", f"select md5(lower({_ONE.format('text')})) as key_hash, count(*) as items, min(item_id) as first_item from benchmark group by all")
def scoring_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that differ in case and spaces only."""
    return read_table(spark, sf_dir, "benchmark").groupBy(F.md5(P.scoring_key(F.col("text"))).alias("key_hash")).agg(F.count(F.lit(1)).alias("items"), F.min("item_id").alias("first_item"))


@query(
    "x29_cited_pages",
    f"""with {GS.named(occurrence=GS.OCCURRENCE)}, cited as (select edge_id, list_sort(list_distinct(list(try_cast(nullif(regexp_extract(segment, '^p([0-9]+)\\.', 1), '') as int)) filter (where segment is not null))) as pages from occurrence group by edge_id)
    select edge_id, len(coalesce(pages, [])) as n_pages, array_to_string(coalesce(pages, []), ',') as pages from cited""",
)
def cited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that the occurrences of each edge cite."""
    pages = P.cited_pages(F.collect_list("segment"))
    return GS.rows(spark, sf_dir, GS.OCCURRENCE).groupBy("edge_id").agg(pages.alias("p")).select("edge_id", F.size("p").cast("long").alias("n_pages"), F.array_join("p", ",").alias("pages"))


@query("x34_canonical_digests", "select o_orderkey, sha256('{\"customer\":' || o_custkey || ',\"note\":' || case when o_orderkey % 5 = 0 then 'null' else '\"' || o_orderpriority || '\"' end || ',\"status\":\"' || o_orderstatus || '\"}') as digest from orders")
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the digest of their canonical JSON."""
    digest = P.canonical_digest(status=F.col("o_orderstatus"), customer=F.col("o_custkey"), note=F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", digest.alias("digest"))


@query(
    "x36_call_fingerprints",
    """with calls as (select sha256('{"effort":"' || event_type || '","prompt":"' || replace(props, '"', '\\"') || '","user":' || user_id || '}') as fingerprint, event_id from events) select fingerprint, count(*) as calls, min(event_id) as first_call from calls group by fingerprint""",
)
def call_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that are the same, by fingerprint."""
    print_of = P.canonical_digest(effort=F.col("event_type"), prompt=F.col("props"), user=F.col("user_id"))
    return read_table(spark, sf_dir, "events").groupBy(print_of.alias("fingerprint")).agg(F.count(F.lit(1)).alias("calls"), F.min("event_id").alias("first_call"))


@query(
    "x37_occurrence_hashes",
    f"""with {GS.named(occurrence=GS.OCCURRENCE)}, hashed as (select edge_id, sha256('{{"condition":' || coalesce('"' || condition || '"', 'null') || ',"edge":"' || edge_id || '","segment":' || coalesce('"' || segment || '"', 'null') || '}}') as fact from occurrence)
    select fact, count(*) as occurrences, min(edge_id) as edge_id from hashed group by fact""",
)
def occurrence_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences that state one fact with one evidence."""
    fact = P.canonical_digest(edge=F.col("edge_id"), segment=F.col("segment"), condition=F.col("condition"))
    return GS.rows(spark, sf_dir, GS.OCCURRENCE).groupBy(fact.alias("fact")).agg(F.count(F.lit(1)).alias("occurrences"), F.min("edge_id").alias("edge_id"))


@query(
    "x38_checked_ids",
    r"""with made as (select c_custkey, case c_custkey % 4 when 0 then 'doc_' || lpad(c_custkey::varchar, 12, '0') when 1 then 'Doc_' || lpad(c_custkey::varchar, 12, '0') when 2 then 'run_a-' || c_custkey else ' node_x_' || repeat('7', 9) || c_custkey || ' ' end as id,
      '2024-0' || (c_custkey % 9 + 1) || '-' || lpad((c_custkey % 33)::varchar, 2, '0') || 'T10:00:00' || case when c_custkey % 5 = 0 then '' else 'Z' end as made_at from customer)
    select c_custkey, regexp_full_match(trim(id), '[a-z][a-z0-9_]*_[A-Za-z0-9_-]{10,}') as good_id, made_at like '%Z' and try_cast(replace(made_at, 'Z', '') as timestamp) is not null as good_time from made""",
)
def checked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and times made from customers, some of them malformed."""
    k = F.col("c_custkey")
    padded = F.lpad(k.cast("string"), 12, "0")
    made = F.when(k % 4 == 0, F.concat(F.lit("doc_"), padded)).when(k % 4 == 1, F.concat(F.lit("Doc_"), padded)).when(k % 4 == 2, F.concat(F.lit("run_a-"), k.cast("string"))).otherwise(F.concat(F.lit(" node_x_777777777"), k.cast("string"), F.lit(" ")))
    at = F.concat(F.lit("2024-0"), (k % 9 + 1).cast("string"), F.lit("-"), F.lpad((k % 33).cast("string"), 2, "0"), F.lit("T10:00:00"), F.when(k % 5 == 0, "").otherwise("Z"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", P.is_opaque_id(made).alias("good_id"), P.is_utc_time(at).alias("good_time"))


@query(
    "x39_attested_fields",
    f"""with {GS.named(node=GS.NODE)} select type, count(*) as nodes, count(*) filter (where trim(component) <> '' and lower(trim(component)) not in ('-', 'n/a', 'na', 'none', 'non disponibile', 'not available', 'placeholder', 'tbd', 'todo', 'unknown')) as attested from node group by type""",
)
def attested_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose component is a real value."""
    return GS.rows(spark, sf_dir, GS.NODE).groupBy("type").agg(F.count(F.lit(1)).alias("nodes"), F.count(P.attested(F.col("component"))).alias("attested"))


@query(
    "x40_version_dates",
    f"""with {S.LIVE} select run_id, coalesce(max(happened) filter (where kind = 'unit_extracted'), min(happened)) as dated, max(happened) filter (where kind = 'unit_extracted') is null as by_file from live group by run_id""",
)
def version_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of each run: its last answer, else its first event."""
    answered = F.max(F.when(F.col("kind") == "unit_extracted", F.col("happened")))
    return S.live_events(spark, sf_dir).groupBy("run_id").agg(F.coalesce(answered, F.min("happened")).alias("dated"), answered.isNull().alias("by_file"))


@query(
    "x42_cost_envelopes",
    """with calls as (select doc_id, octet_length(encode(text)) + (doc_id % 4) * 6000 + 1200 + 4096 as prompt, 2000 + doc_id % 3000 as completion from documents)
    select doc_id, prompt::bigint as prompt, (prompt * 1250 * (case when prompt > 272000 then 4 else 2 end) + completion * 5000 * (case when prompt > 272000 then 3 else 2 end))::bigint as most from calls""",
)
def cost_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most that a call about each document can cost: bytes as tokens, images, schema and overhead, all written to the cache."""
    prompt = (F.octet_length("text") + F.col("doc_id") % 4 * 6000 + 1200 + 4096).cast("long")
    completion, wide = 2000 + F.col("doc_id") % 3000, prompt > 272000
    most = prompt * 1250 * F.when(wide, 4).otherwise(2) + completion * 5000 * F.when(wide, 3).otherwise(2)
    return read_table(spark, sf_dir, "documents").select("doc_id", prompt.alias("prompt"), most.cast("long").alias("most"))


@query("x45_percent_marks", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(100 * (l_partkey % 612) / 612.0, 0)::int as x, round_even(100 * l_quantity / 792.0, 0)::int as y from lineitem")
def percent_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions on a page in hundredths."""
    return read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", P.percent_mark(F.col("l_partkey") % 612, F.lit(612.0)).alias("x"), P.percent_mark(F.col("l_quantity"), F.lit(792.0)).alias("y")
    )


@query(
    "x46_tolerant_objects",
    """select event_id, case event_id % 5 when 4 then null else (props->>'k')::bigint end as k, event_id % 5 <> 4 as readable from events""",
)
def tolerant_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events, some of them wrapped, with a comma too many, or cut off."""
    n, props = F.col("event_id") % 5, F.col("props")
    given = F.when(n == 1, F.concat(F.lit("Here it is:\n```json\n"), props, F.lit("\n```"))).when(n == 2, F.regexp_replace(props, r"\}$", ",}")).when(n == 3, F.translate(props, '"', "”")).when(n == 4, F.regexp_replace(props, r"\}$", "")).otherwise(props)
    found = P.object_of(given, "k long")
    return read_table(spark, sf_dir, "events").select("event_id", found["k"].alias("k"), found.isNotNull().alias("readable"))


@query(
    "x47_array_facts",
    """with lists as (select l_orderkey, list(l_partkey % 50 order by l_linenumber, l_partkey, l_suppkey) as parts, list(l_suppkey % 50 order by l_linenumber, l_partkey, l_suppkey) as supps from lineitem group by l_orderkey)
    select l_orderkey, len(list_filter(parts, lambda p: p > 40)) > 0 as any_large, len(list_filter(parts, lambda p: p <= 40)) = 0 as all_large, coalesce(list_position(parts, list_min(parts)), 0)::bigint as first_least, array_to_string(list_sort(list_intersect(parts, supps)), ',') as both_, array_to_string(list_sort(list_distinct(list_filter(parts, lambda p: not list_contains(supps, p)))), ',') as only_parts from lists""",
)
def array_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What array expressions say about the parts and suppliers of orders."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    lists = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rows.alias("r")).select("l_orderkey", F.transform("r", lambda x: x["l_partkey"] % 50).alias("parts"), F.transform("r", lambda x: x["l_suppkey"] % 50).alias("supps"))
    return lists.select(
        "l_orderkey", F.exists("parts", lambda p: p > 40).alias("any_large"), F.forall("parts", lambda p: p > 40).alias("all_large"), F.array_position("parts", F.array_min("parts")).alias("first_least"),
        F.array_join(F.array_sort(F.array_intersect("parts", "supps")), ",").alias("both_"), F.array_join(F.array_sort(F.array_except("parts", "supps")), ",").alias("only_parts"),
    )


@query(
    "x48_merged_maps",
    """with a as (select o_custkey, o_orderpriority as k, max(o_orderkey) as v from orders where o_orderstatus <> 'F' group by all), b as (select o_custkey, o_orderpriority as k, max(o_orderkey) as v from orders where o_orderstatus = 'F' group by all),
    merged as (select coalesce(a.o_custkey, b.o_custkey) as o_custkey, coalesce(a.k, b.k) as k, coalesce(b.v, a.v) as v from a full join b on a.o_custkey = b.o_custkey and a.k = b.k)
    select o_custkey, count(*) as entries, coalesce(max(v) filter (where k = '1-URGENT'), -1) as urgent, arg_max(k, v) as last_priority from merged group by o_custkey""",
)
def merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps of each customer merged, the second one winning; a value or a default, and the inverse of the map."""
    last = read_table(spark, sf_dir, "orders").groupBy("o_custkey", (F.col("o_orderstatus") == "F").alias("f"), F.col("o_orderpriority").alias("k")).agg(F.max("o_orderkey").alias("v"))
    entries = lambda f: F.map_from_entries(F.collect_list(F.when(F.col("f") == f, F.struct("k", "v"))))
    maps = last.groupBy("o_custkey").agg(entries(False).alias("a"), entries(True).alias("b"))
    merged = F.map_concat(F.map_filter("a", lambda k, v: ~F.map_contains_key("b", k)), F.col("b"))
    inverse = F.map_from_arrays(F.map_values("m"), F.map_keys("m"))
    return maps.select("o_custkey", merged.alias("m")).select(
        "o_custkey", F.size("m").cast("long").alias("entries"), F.coalesce(F.try_element_at("m", F.lit("1-URGENT")), F.lit(-1)).alias("urgent"), F.element_at(inverse, F.array_max(F.map_values("m"))).alias("last_priority")
    )


@query("x03_name_similarity")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of the names of parts next to each other, in both orders of their words; held against brute force in a test."""
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    after = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return parts.join(after, "p_partkey").select("p_partkey", similarity(F.col("p_name"), F.col("other")).alias("score"))


@query(
    "x44_wilson_bounds",
    f"""with counted as (select l_suppkey, count(*) filter (where l_returnflag = 'A')::double as h, count(*)::double as n from lineitem group by l_suppkey)
    select l_suppkey, {"coalesce(round((h / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt((h / n) * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 3), 0.0)"} as low, {"coalesce(round((h / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt((h / n) * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 3), 0.0)"} as high from counted""",
)
def wilson_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95 % interval of each supplier's share of returns."""
    counted = read_table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("h"), F.count(F.lit(1)).alias("n"))
    low, high = T.wilson(F.col("h"), F.col("n"))
    return counted.select("l_suppkey", low.alias("low"), high.alias("high"))
