"""Queries on the order of blocks, the choice of readings, and passages as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphwright.operators import reading as R
from graphwright.plans import graph_staging as GS
from graphwright.plans.index_queries import segments
from graphwright.registry import query

#: Order lines as blocks of a page for each order: two columns, some across, some in the margins.
BLOCK = """
select l_orderkey as page, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) as int) as n,
  case when l_quantity > 44 then 40 when l_partkey % 2 = 0 then 320 else 40 + l_suppkey % 3 end as x0,
  case when l_quantity > 44 then 570 when l_partkey % 2 = 0 then 560 + l_suppkey % 7 else 280 + l_partkey % 40 end as x1,
  case when l_quantity = 1 then 10 when l_quantity = 2 then 740 else cast(60 + (l_partkey * 7 + l_suppkey) % 600 as int) end as y0,
  case when l_quantity = 1 then 30 when l_quantity = 2 then 760 else cast(80 + (l_partkey * 7 + l_suppkey) % 600 as int) end as y1,
  case when l_suppkey % 50 = 0 then ' ' else l_returnflag || l_linenumber end as text, 612.0 as width, case when l_orderkey % 10 = 0 then null else 792.0 end as height
from {lineitem}"""


@query(
    "o01_reading_order",
    f"""with {GS.named(block=BLOCK)}, body as (
      select *, case when height is not null and y1 <= height * 0.06 then 0 when height is not null and y0 >= height * 0.92 then 2 else 1 end as zone from block where trim(text) <> ''
    ), seeds as (
      select *, zone = 1 and x1 - x0 <= width * 0.55 and x1 <= width / 2 + width * 0.02 as l, zone = 1 and x1 - x0 <= width * 0.55 and x0 >= width / 2 - width * 0.02 as r from body
    ), stats as (
      select page, count(*) filter (where zone = 1) as n, count(*) filter (where l) as nl, count(*) filter (where r) as nr, max(x1) filter (where l) as le, min(x0) filter (where r) as re,
        min(y0) filter (where l) as lt, max(y1) filter (where l) as lb, min(y0) filter (where r) as rt, max(y1) filter (where r) as rb from seeds group by page
    ), sided as (
      select s.*, case when zone = 1 and t.n >= 4 and nl >= 2 and nr >= 2 and re - le >= greatest(8.0, width * 0.015) and greatest(0, least(lb, rb) - greatest(lt, rt)) / greatest(1, least(lb - lt, rb - rt)) >= 0.25
        then case when x1 <= (le + re) / 2.0 + greatest(2.0, width * 0.004) then 0 when x0 >= (le + re) / 2.0 - greatest(2.0, width * 0.004) then 1 else 2 end end as side
      from seeds s join stats t using (page)
    ), two as (select page from sided group by page having count(*) filter (where side = 0) >= 2 and count(*) filter (where side = 1) >= 2),
    spans as (select page, n, y0, row_number() over (partition by page order by y0, x0, y1, x1, n) - 1 as band from sided where side = 2),
    banded as (
      select s.*, w.page is not null and side is not null as cols, (select min(p.band) from spans p where p.page = s.page and case when s.side = 2 then p.n = s.n else p.y0 > s.y0 end) as under, (select count(*) from spans p where p.page = s.page) as spans
      from sided s left join two w on w.page = s.page
    ) select page, n, row_number() over (partition by page order by zone, case when cols then coalesce(under, spans) else 0 end, case when cols then side else 0 end, y0, x0, y1, x1, n)::int as place from banded""",
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each block is read on its page."""
    return R.reading_order(GS.rows(spark, sf_dir, BLOCK), ["page"]).select("page", "n", "place")


#: Order lines as evidence of a page for each order: blocks, OCR regions, and rows of two tables.
EVIDENCE = """
select l_orderkey as page, concat_ws('.', l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int)) as unit_id, case when l_orderkey % 4 = 0 and l_linenumber % 2 = 0 then 'ocr' when l_linenumber % 3 = 0 then 'row' else 'block' end as kind,
  case when l_suppkey % 37 = 0 then ' - ' when l_suppkey % 41 = 0 then chr(1) || chr(2) || 'x' else l_returnflag || ' ' || l_linestatus || case when l_orderkey % 4 = 0 and l_quantity > 25 then ' more words' else '' end end as text,
  case when l_linenumber % 3 = 0 then 100.0 else 100.0 + l_partkey % 5 * 60 end as x0, case when l_linenumber % 3 = 0 then 300.0 else 200.0 + l_partkey % 5 * 60 end as x1,
  case when l_linenumber % 3 = 0 then l_linenumber * 100.0 else l_quantity * 14.0 end as y0, case when l_linenumber % 3 = 0 then l_linenumber * 100.0 + 200 else l_quantity * 14.0 + 12 end as y1
from {lineitem}"""


@query("p03_page_units")
def page_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units that each order's page is read by; held against a nested loop in a test."""
    return R.page_units(GS.rows(spark, sf_dir, EVIDENCE), ["page"])


def page_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' segments with what rendering needs; the first row of each table has its headers."""
    rows = segments(spark, sf_dir)
    at = Window.partitionBy("doc_id", "page").orderBy("pos")
    is_row = F.col("kind") == "table_row"
    first = F.min(F.when(is_row, F.col("pos"))).over(Window.partitionBy("doc_id", "page")) == F.col("pos")
    text = F.when(is_row & first, F.upper(F.array_join("headers", " | "))).otherwise(F.col("text"))
    return rows.select(
        "doc_id", "pos", "segment_id", "page", text.alias("text"), "headers", "headings", F.when(is_row & (F.col("pos") % 8 == 2), F.array(F.lit(0))).alias("inherited"),
        F.when(F.col("kind") == "step", F.regexp_extract("text", "^([0-9]+)", 1)).alias("step"), ((F.col("kind") == "text") & ~F.coalesce(F.lag("text").over(at), F.lit(".")).rlike(r"[.!?:;]\s*$")).alias("continued"),
        F.when(is_row, F.col("page")).alias("table"), (is_row & first).alias("header_row"),
    )


@query("x08_rendered_passages")
def rendered_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passage of each section of a manual as text, with headers and what steps stand under; held against a loop in a test."""
    rows = page_segments(spark, sf_dir)
    owned = rows.filter("not header_row").select("doc_id", F.floor(F.col("pos") / 3).alias("unit"), "segment_id")
    return R.rendered(R.passages(owned, rows, ["unit"]), ["doc_id", "unit"])


@query("j34_passage_segments")
def passage_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which segments each section's passage has, and which of them are context; held against a loop in a test."""
    rows = page_segments(spark, sf_dir)
    owned = rows.filter("not header_row").select("doc_id", F.floor(F.col("pos") / 3).alias("unit"), "segment_id")
    return R.passages(owned, rows, ["unit"]).select("doc_id", "unit", "segment_id", "pos", "context")
