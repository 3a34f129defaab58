"""Queries that apply the layout operators to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphwright.functions.text import OPEN_END, STEP, SUB_STEP
from graphwright.operators import layout as L
from graphwright.plans import staging as S
from graphwright.registry import query
from graphwright.sources.tables import read_table


@query(
    "w07_reading_positions",
    f"with {S.SEGMENT} select doc_id, segment_id, (row_number() over (partition by doc_id order by page, pos) - 1)::int as position from segment",
)
def reading_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading position of every segment."""
    return L.reading_positions(S.segments(spark, sf_dir)).select("doc_id", "segment_id", "position")


_CONTINUES = rf"""
continued as (
  select *, coalesce(regexp_matches(lag(text) over (partition by doc_id, page order by pos), '{OPEN_END}') and regexp_matches(text, '^\p{{Ll}}') and not regexp_matches(text, '{SUB_STEP}'), false) as continues
  from segment
)"""


@query("w03_continuations", f"with {S.SEGMENT}, {_CONTINUES} select doc_id, page, count(*) as segments, count(*) filter (where continues) as continued from continued group by doc_id, page")
def continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that continue a sentence, by page."""
    return L.continuations(S.segments(spark, sf_dir)).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("segments"), F.count_if("continues").alias("continued"))


#: Step numbers are rare in the texts: those of the query are written before some segments.
_NUMBERED = "case pos % 6 when 1 then 'Check the seal' when 2 then '1. ' || text when 3 then 'a) ' || text when 4 then '2. ' || text when 5 then lower(text) else text end"


@query(
    "w04_numbered_steps",
    f"""with {S.SEGMENT.replace("line as text", f"replace({_NUMBERED.replace('text', 'line')}, 'pos', 'pos') as text").replace("case pos", "case (i + 1)")}, {_CONTINUES}, numbers as (
      select *, case when not continues then try_cast(nullif(regexp_extract(text, '{STEP}', 1), '') as int) end as number from continued
    ), lasts as (select *, last_value(number ignore nulls) over (partition by doc_id order by page, pos rows between unbounded preceding and 1 preceding) as last,
        last_value(number ignore nulls) over (partition by doc_id order by page, pos rows between unbounded preceding and current row) as now from numbers
    ), news as (select *, number is not null and (number = 1 or last is null or number < last) as new from lasts
    ), sequences as (select *, sum(new::int) over (partition by doc_id order by page, pos) as seq, case when not continues and number is null then regexp_extract(text, '{SUB_STEP}', 1) end as letter,
        sum((not continues)::int) over (partition by doc_id, page order by pos) as run from news
    ), own as (select *, case when number is not null then number::varchar when letter <> '' and now is not null then now || letter end as own from sequences
    ), stepped as (select *, first_value(own) over (partition by doc_id, page, run order by pos) as step from own
    ) select doc_id, segment_id, step, case when step is not null then seq::int end as sequence,
        case when new and lag(step) over (partition by doc_id, page order by pos) is null then lag(segment_id) over (partition by doc_id, page order by pos) end as head from stepped""",
)
def numbered_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of numbered sequences; some segments get a number first."""
    rows = S.segments(spark, sf_dir).withColumn("text", F.expr(_NUMBERED))
    return L.numbered_steps(L.continuations(rows)).select("doc_id", "segment_id", "step", "sequence", "head")


@query(
    "w01_fill_down",
    f"""with {S.TABLE_ROW} select doc_id, row, last_value(nullif(status, '') ignore nulls) over w as status, last_value(case when status <> '' then row end ignore nulls) over w as status_origin,
      last_value(nullif(year, '') ignore nulls) over w as year, last_value(case when year <> '' then row end ignore nulls) over w as year_origin
    from table_row window w as (partition by doc_id order by row rows between unbounded preceding and current row)""",
)
def fill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank cells of order tables with the value above them."""
    rows = L.fill_down(S.table_rows(spark, sf_dir), ["status", "year"])
    return rows.select("doc_id", "row", F.col("status_filled").alias("status"), "status_origin", F.col("year_filled").alias("year"), "year_origin")


@query(
    "w02_header_carry",
    f"""with {S.TABLE_ROW} select doc_id, row, first_value(nullif(line, '') ignore nulls) over (partition by doc_id order by row rows between unbounded preceding and current row) as header from table_row where row > 1""",
)
def header_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first non-blank cell of a column, at every later row."""
    rows = S.table_rows(spark, sf_dir).filter("row > 1")
    upto = Window.partitionBy("doc_id").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("doc_id", "row", F.first(F.nullif(F.col("line"), F.lit("")), ignorenulls=True).over(upto).alias("header"))


@query(
    "j07_origin_rows",
    f"""with {S.TABLE_ROW}, kept as (select * from table_row where row % 5 <> 3), islands as (select *, row - row_number() over (partition by doc_id order by row) as island, status = '' as inherits from kept),
    lasts as (select *, last_value(case when not inherits then row end ignore nulls) over w as above, last_value(case when not inherits then island end ignore nulls) over w as above_island
      from islands window w as (partition by doc_id order by row rows between unbounded preceding and current row))
    select doc_id, row, case when inherits and above_island = island then above end as origin from lasts""",
)
def origin_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins of inherited cells; every fifth row is missing, which breaks the chain."""
    rows = S.table_rows(spark, sf_dir).filter("row % 5 <> 3")
    return L.origin_rows(rows, F.col("status") == "").select("doc_id", "row", "origin")


@query(
    "j06_header_rows",
    f"""with {S.TABLE_ROW} select r.doc_id, r.row, h.status as header_status, h.line as header_line, h.year as header_year from table_row r join table_row h on h.doc_id = r.doc_id and h.row = 1 where r.row > 1""",
)
def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of its table for each later row."""
    rows = S.table_rows(spark, sf_dir)
    first = Window.partitionBy("doc_id").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    named = rows.select("doc_id", "row", *[F.first(c).over(first).alias(f"header_{c}") for c in ("status", "line", "year")])
    return named.filter("row > 1")


@query(
    "w08_page_gaps",
    f"""with {S.PAGE_MAP}, sides as (select *, coalesce(lag(page) over w = page - 1 and lag(label) over w = 'diagnostic', false) as before, coalesce(lead(page) over w = page + 1 and lead(label) over w = 'diagnostic', false) as after
      from page_map window w as (partition by manual order by page)),
    judged as (select *, (label in ('other', 'procedure') and before and after) or (label = 'procedure' and (before or after)) as promoted from sides)
    select manual, page, case when promoted then 'diagnostic' else label end as label, promoted or unsure as unsure from judged""",
)
def page_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page map with its gaps filled."""
    return L.fill_page_gaps(S.page_map(spark, sf_dir)).select("manual", "page", F.col("new_label").alias("label"), F.col("new_unsure").alias("unsure"))


@query(
    "w09_page_runs",
    f"""with {S.PAGE_MAP}, islands as (select manual, page, page - row_number() over (partition by manual order by page) as island from page_map where label in ('diagnostic', 'procedure'))
    select manual, min(page) as first_page, max(page) as last_page, count(*) as pages from islands group by manual, island""",
)
def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of pages that are read."""
    return L.page_runs(S.page_map(spark, sf_dir).filter(F.col("label").isin("diagnostic", "procedure")))


@query(
    "x10_page_range_text",
    f"""with {S.PAGE_MAP}, islands as (select manual, page, page - row_number() over (partition by manual order by page) as island from page_map where label = 'diagnostic'),
    runs as (select manual, min(page) as a, max(page) as b from islands group by manual, island)
    select manual, string_agg(case when a = b then a::varchar else a || '-' || b end, ', ' order by a) as pages from runs group by manual""",
)
def page_range_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostic pages as text: 1-3, 7."""
    runs = L.page_runs(S.page_map(spark, sf_dir).filter("label = 'diagnostic'"))
    text = F.when(F.col("first_page") == F.col("last_page"), F.col("first_page").cast("string")).otherwise(F.concat_ws("-", "first_page", "last_page"))
    parts = F.array_sort(F.collect_list(F.struct("first_page", text.alias("text"))))
    return runs.groupBy("manual").agg(F.array_join(F.transform(parts, lambda p: p["text"]), ", ").alias("pages"))


@query(
    "w10_section_batches",
    f"""with {S.PAGE_MAP}, halves as (select manual, page, (page // 9)::varchar as section from page_map), changes as (select *, (lag(section) over w is distinct from section)::int as changed from halves window w as (partition by manual order by page)),
    runs as (select *, sum(changed) over (partition by manual order by page) as run from changes),
    places as (select *, row_number() over (partition by manual, run order by page) as n from runs)
    select manual, page, sum((n % 4 = 1)::int) over (partition by manual order by page)::bigint as batch from places""",
)
def section_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of at most four pages of one section."""
    pages = S.page_map(spark, sf_dir).select("manual", "page", F.floor(F.col("page") / 9).cast("string").alias("section"))
    return L.section_batches(pages, 4).select("manual", "page", "batch")


@query(
    "s06_carried_sections",
    f"""with {S.PAGE_MAP} select manual, page, last_value(case when page % 7 = 2 then section end ignore nulls) over (partition by manual order by page rows between unbounded preceding and current row) as title from page_map""",
)
def carried_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section titles, given on every seventh page, carried forward."""
    pages = L.carried_sections(S.page_map(spark, sf_dir), F.when(F.col("page") % 7 == 2, F.col("section")))
    return pages.select("manual", "page", F.col("carried_title").alias("title"))


@query(
    "w15_sandwiched_pages",
    f"""with {S.PAGE_MAP}, pages_ as (select manual, page, confirmed, (page // 6)::varchar as section from page_map), bounds as (select manual, section, min(page) as a, max(page) as b from pages_ where confirmed group by manual, section)
    select p.manual, p.section, p.page from pages_ p join bounds s on p.manual = s.manual and p.section = s.section and p.page > a and p.page < b
    where not exists (select 1 from pages_ o where o.manual = p.manual and o.page > a and o.page < b and o.section <> p.section)""",
)
def sandwiched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that two confirmed pages of their section protect."""
    pages = S.page_map(spark, sf_dir).withColumn("section", F.floor(F.col("page") / 6).cast("string"))
    return L.sandwiched_pages(pages)


@query(
    "w13_trail_context",
    f"""with {S.SEGMENT}, ranked as (select *, row_number() over (partition by doc_id, page order by pos) as n from segment)
    select a.doc_id, a.page, string_agg(b.segment_id, ' ' order by b.page, b.pos) as trail from (select distinct doc_id, page from ranked) a join ranked b on b.doc_id = a.doc_id and b.page between a.page - 3 and a.page - 1 and b.n <= 2 group by a.doc_id, a.page""",
)
def trail_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opening two segments of up to three pages before each page."""
    segments = S.segments(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("pos"))
    openings = segments.withColumn("n", n).filter("n <= 2").select("doc_id", "page", "pos", "segment_id", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("ahead"))
    reached = openings.select("doc_id", (F.col("page") + F.col("ahead")).alias("page"), F.struct(F.col("page").alias("p"), "pos", "segment_id").alias("s"))
    trails = reached.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["segment_id"]), " ").alias("trail"))
    return trails.join(segments.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")


@query(
    "w14_preceding_segments",
    f"with {S.SEGMENT} select doc_id, segment_id, lag(segment_id, 1) over w as before, lag(segment_id, 2) over w as before_that from segment window w as (partition by doc_id order by page, pos)",
)
def preceding_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two segments before each segment."""
    order = Window.partitionBy("doc_id").orderBy("page", "pos")
    return S.segments(spark, sf_dir).select("doc_id", "segment_id", F.lag("segment_id", 1).over(order).alias("before"), F.lag("segment_id", 2).over(order).alias("before_that"))


@query(
    "p07_layout_pages",
    f"with {S.SEGMENT} select doc_id, page, count(*) as segments, count(*) filter (where length(text) <= 40) as short from segment group by doc_id, page having count(*) >= 8 and count(*) filter (where length(text) <= 40) * 2 >= count(*)",
)
def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of many short segments: figures and forms."""
    counted = S.segments(spark, sf_dir).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.length("text") <= 40).alias("short"))
    return counted.filter("segments >= 8 and short * 2 >= segments")


@query(
    "p05_unreadable_pages",
    """with pages_ as (select doc_id, (i // 10 + 1)::int as page, max(trim(line)) as t from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents) group by all),
    bounds as (select doc_id, max(page) as last_page from pages_ group by doc_id), every as (select doc_id, unnest(generate_series(1, last_page + doc_id % 2)) as page from bounds)
    select e.doc_id, e.page::int as page from every e where not exists (select 1 from pages_ p where p.doc_id = e.doc_id and p.page = e.page and p.t <> '')""",
)
def unreadable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without any segment; odd documents have one page more than their lines fill."""
    docs = read_table(spark, sf_dir, "documents")
    last = (F.floor((F.size(F.split("text", "\n")) - 1) / S.PAGE_LINES) + 1 + F.col("doc_id") % 2).cast("int")
    every = docs.select("doc_id", F.explode(F.sequence(F.lit(1), last)).alias("page"))
    return every.join(S.segments(spark, sf_dir).select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")


@query(
    "u03_unused_rows",
    f"""with {S.TABLE_ROW}, cited as (select distinct l_orderkey as doc_id, (l_linenumber % 4 + 1)::int as row from lineitem where l_quantity > 20)
    select t.doc_id, t.row from table_row t where t.row > 1 and not exists (select 1 from cited c where c.doc_id = t.doc_id and c.row = t.row)""",
)
def unused_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows, without headers, that no relation cites."""
    cited = read_table(spark, sf_dir, "lineitem").filter("l_quantity > 20").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 4 + 1).alias("row"))
    return S.table_rows(spark, sf_dir).filter("row > 1").select("doc_id", "row").join(cited, ["doc_id", "row"], "left_anti")


@query(
    "s02_table_markdown",
    f"""with {S.TABLE_ROW}, capped as (select * from table_row where row <= 60), lined as (select doc_id, row, '| ' || status || ' | ' || line || ' | ' || year || ' |' as md from capped),
    summed as (select *, sum(length(md)) over (partition by doc_id order by row) as chars from lined)
    select doc_id, count(*) as rows, string_agg(md, chr(10) order by row) as markdown from summed where chars <= 6000 group by doc_id having count(*) >= 2""",
)
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as Markdown: 60 rows at most, up to a number of characters, and none of a single row."""
    rows = S.table_rows(spark, sf_dir).filter("row <= 60")
    md = F.concat(F.lit("| "), F.concat_ws(" | ", "status", "line", "year"), F.lit(" |"))
    chars = F.sum(F.length("md")).over(Window.partitionBy("doc_id").orderBy("row"))
    kept = rows.select("doc_id", "row", md.alias("md")).withColumn("chars", chars).filter("chars <= 6000")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row", "md"))), lambda r: r["md"])
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.array_join(lines, "\n").alias("markdown")).filter("rows >= 2")
