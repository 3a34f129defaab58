"""Reading pages: the order of blocks, the choice of one reading per page, and segments as text.

A page and a reading unit are small by nature, so they are window partitions or groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.functions.parsing import text_key
from graphwright.functions.text import corrupt_text

# Fixed values, as shares of the page and in points: margins, a column's width, the gutter, the overlap of columns.
HEADER, FOOTER, NARROW, EDGE = 0.06, 0.92, 0.55, 0.02
GUTTER, GUTTER_POINTS, SLACK, SLACK_POINTS, OVERLAP = 0.015, 8.0, 0.004, 2.0, 0.25
#: Height of the strips by which blocks meet tables, in points.
STRIP = 64.0


def reading_order(blocks: DataFrame, page: list[str]) -> DataFrame:
    """blocks with place, from 1: margins apart, and column by column where a page has two.

    blocks(*page, n, x0, y0, x1, y1, text, width, height): n is the order of the file, missing
    coordinates count as 0, blank blocks are left out. A page has two columns if, between its header
    and footer, it has four blocks, two narrow ones on each side of its middle, a gutter between
    those, and sides that overlap vertically. Blocks across the gutter part the columns into bands;
    all other pages go from top to bottom. Positions are compared in tenths of a point.
    """
    at = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("x0", "y0", "x1", "y1")}
    rows = blocks.filter("trim(text) <> ''").withColumns({f"_{c}": v for c, v in at.items()})
    whole = Window.partitionBy(*page)
    x0, y0, x1, y1, width, height = (F.col(c) for c in ("_x0", "_y0", "_x1", "_y1", "width", "height"))
    margins = F.coalesce(height > 0, F.lit(False))
    zone = F.when(margins & (y1 <= height * HEADER), 0).when(margins & (y0 >= height * FOOTER), 2).otherwise(1)
    rows = rows.withColumn("_zone", zone)
    body = F.col("_zone") == 1
    narrow = body & (x1 - x0 <= width * NARROW)
    rows = rows.withColumn("_seed", F.when(narrow & (x1 <= width / 2 + width * EDGE), "l"))
    rows = rows.withColumn("_other", F.when(narrow & (x0 >= width / 2 - width * EDGE), "r"))
    left, right = F.col("_seed").isNotNull(), F.col("_other").isNotNull()
    over = lambda f, test, of: f(F.when(test, of)).over(whole)
    rows = rows.withColumns({
        "_n": F.count_if(body).over(whole), "_nl": F.count_if(left).over(whole), "_nr": F.count_if(right).over(whole),
        "_le": over(F.max, left, x1), "_re": over(F.min, right, x0),
        "_lt": over(F.min, left, y0), "_lb": over(F.max, left, y1), "_rt": over(F.min, right, y0), "_rb": over(F.max, right, y1),
    })
    shared = F.greatest(F.lit(0.0), F.least("_lb", "_rb") - F.greatest("_lt", "_rt"))
    shorter = F.greatest(F.lit(1.0), F.least(F.col("_lb") - F.col("_lt"), F.col("_rb") - F.col("_rt")))
    two = (
        (F.col("_n") >= 4) & (width > 0) & (F.col("_nl") >= 2) & (F.col("_nr") >= 2)
        & (F.col("_re") - F.col("_le") >= F.greatest(F.lit(GUTTER_POINTS), width * GUTTER)) & (shared / shorter >= OVERLAP)
    )
    split, slack = (F.col("_le") + F.col("_re")) / 2, F.greatest(F.lit(SLACK_POINTS), width * SLACK)
    side = F.when(body & F.coalesce(two, F.lit(False)), F.when(x1 <= split + slack, 0).when(x0 >= split - slack, 1).otherwise(2))
    rows = rows.withColumn("_side", side)
    tenths = {c: F.bround(F.col(f"_{c}"), 1) for c in ("y0", "x0", "y1", "x1")}
    key = F.struct(*[v.alias(c) for c, v in tenths.items()], "n")
    rows = rows.withColumns({
        "_key": key, "_two": (F.count_if(F.col("_side") == 0).over(whole) >= 2) & (F.count_if(F.col("_side") == 1).over(whole) >= 2),
        "_spans": F.collect_list(F.when(F.col("_side") == 2, F.struct(*key_fields(tenths), F.col("n").alias("n"), y0.alias("top")))).over(whole),
    })
    columns = F.col("_two") & F.col("_side").isNotNull()
    spans = F.array_sort("_spans")
    # a block stands in the band of the first span that begins below it; a span closes its band
    below = F.filter(F.transform(spans, lambda s, i: F.when(F.when(F.col("_side") == 2, s["n"] == F.col("n")).otherwise(s["top"] > y0), i)), lambda i: i.isNotNull())
    band = F.when(columns, F.coalesce(F.get(below, F.lit(0)), F.size(spans))).otherwise(0)
    order = ["_zone", band, F.when(columns, F.col("_side")).otherwise(0), "_key"]
    placed = rows.withColumn("place", F.row_number().over(whole.orderBy(*order)))
    return placed.select(*blocks.columns, "place")


def key_fields(tenths: dict[str, Column]) -> list[Column]:
    """The positions that blocks are sorted by, named."""
    return [v.alias(c) for c, v in tenths.items()]


def page_units(evidence: DataFrame, page: list[str]) -> DataFrame:
    """(*page, unit_id, kind, source): the units of one coherent reading of each page.

    evidence(*page, unit_id, kind, text, x0, y0, x1, y1, table_id): kinds are block, ocr and row; rows
    have the box of their table. The OCR reading is taken if it holds more text than the blocks, or
    if these are corrupt; else the blocks are, without those that lie in a table of their page, a point
    of slack aside, and whose words its rows hold. Rows with words always count, and if nothing else
    is left everything with words does. Each unit counts once.
    """
    words = text_key("text")
    flat = lambda c: F.regexp_replace(c, r"\s+", "")
    # a page's text in all: keys and the spaces between them
    rows = evidence.withColumn("_words", F.length(words))
    of = lambda kind: F.sum(F.when((F.col("kind") == kind) & (F.col("_words") > 0), F.col("_words") + 1))
    pages = rows.groupBy(*page).agg(
        F.coalesce(of("block"), F.lit(0)).alias("_nb"), F.coalesce(of("ocr"), F.lit(0)).alias("_no"), F.bool_or(F.col("kind") == "block").alias("_b"), F.bool_or(F.col("kind") == "ocr").alias("_o"),
        corrupt_text(F.array_join(F.collect_list(F.when(F.col("kind") == "block", F.col("text"))), " ")).alias("_bad"),
    )
    ocr = F.col("_o") & ((F.col("_no") > F.col("_nb")) | F.coalesce("_bad", F.lit(False)))
    pages = pages.select(*page, F.when(ocr, "ocr").when(F.col("_b"), "native").otherwise("ocr").alias("source"))
    rows = rows.join(pages, page)

    # tables reach all strips between their edges, a block that lies in one has its top in one of these
    boxes = rows.filter("kind = 'row'").groupBy(*page, "x0", "y0", "x1", "y1").agg(F.array_join(F.collect_list(flat("text")), "\n").alias("_held"))
    strip = lambda y: F.floor(y / STRIP).cast("long")
    tables = boxes.select(*page, *[F.col(c).alias(f"_t{c}") for c in ("x0", "y0", "x1", "y1")], "_held", F.explode(F.sequence(strip(F.col("y0") - 1), strip(F.col("y1") + 1))).alias("_strip"))
    inside = (
        (F.col("x0") >= F.col("_tx0") - 1) & (F.col("y0") >= F.col("_ty0") - 1) & (F.col("x1") <= F.col("_tx1") + 1) & (F.col("y1") <= F.col("_ty1") + 1)
        & (flat("text") != "") & F.contains("_held", flat("text"))
    )
    blocks = rows.filter("kind = 'block' and source = 'native'").withColumn("_strip", strip(F.col("y0")))
    tables = tables.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(page)], F.col("_strip").alias("_s"), "_held", "_tx0", "_ty0", "_tx1", "_ty1")
    here = F.col("_strip") == F.col("_s")
    for i, c in enumerate(page):
        here = here & (F.col(c) == F.col(f"_p{i}"))
    free = blocks.join(tables, here & inside, "left_anti").drop("_strip")
    chosen = free.unionByName(rows.filter("kind = 'ocr' and source = 'ocr'")).unionByName(rows.filter("kind = 'row' and _words > 0"))
    some = chosen.select(*page).distinct()
    left = rows.join(some, page, "left_anti").withColumn("source", F.when(F.bool_or(F.col("kind") == "ocr").over(Window.partitionBy(*page)), "ocr").otherwise("native"))
    return chosen.unionByName(left).filter("_words > 0").groupBy(*page, "unit_id").agg(F.min("kind").alias("kind"), F.min("source").alias("source"))


def segment_line(segment_id: Column, text: Column, headers: Column, inherited: Column, marker: Column) -> Column:
    """A segment as one line: [id], what marks it, and its text, or a row's cells under their headers.

    headers and inherited are null outside tables. A row that repeats the headers is TABLE COLUMNS;
    a column without a header has its number; cells in inherited columns say that they are those above.
    """
    cells = F.split(text, r" \| ")
    lower = lambda xs: F.transform(xs, lambda x: F.lower(x))
    is_header = (F.size(headers) > 0) & (lower(cells) == lower(F.slice(headers, F.lit(1), F.size(cells))))

    def cell(value: Column, i: Column) -> Column:
        name = F.coalesce(F.nullif(F.get(headers, i), F.lit("")), F.concat(F.lit("column "), (i + 1).cast("string")))
        same = F.when(F.array_contains(F.coalesce(inherited, F.array().cast("array<int>")), i), " (same as row above)").otherwise("")
        return F.concat(name, same, F.lit(": "), value)

    body = F.when(headers.isNull(), text).when(is_header, F.concat(F.lit("TABLE COLUMNS: "), text)).otherwise(F.array_join(F.transform(cells, cell), " | "))
    return F.concat(F.lit("["), segment_id, F.lit("]"), marker, F.lit(" "), body)


def rendered(segments: DataFrame, unit: list[str]) -> DataFrame:
    """(*unit, text): the segments of each unit as one text.

    segments(*unit, pos, segment_id, page, text, headers, inherited, step, continued, context): in
    order of pos; a page begins with a line that says so, a segment that continues a sentence stands
    on the line of the one before it on its page, steps and context are marked.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    marker = F.concat(F.when(flag("context"), " (context)").otherwise(""), F.when(F.col("step").isNotNull() & ~flag("continued"), F.concat(F.lit(" (step "), F.col("step"), F.lit(")"))).otherwise(""))
    line = segment_line(F.col("segment_id"), F.coalesce("text", F.lit("")), F.col("headers"), F.col("inherited"), marker)
    order = Window.partitionBy(*unit).orderBy("pos", "segment_id")
    before = F.lag("page").over(order)
    head = F.concat(F.lit("=== page "), F.col("page").cast("string"), F.lit(" ===\n"))
    gap = F.when(F.row_number().over(order) == 1, head).when(before != F.col("page"), F.concat(F.lit("\n"), head)).when(flag("continued"), " ").otherwise("\n")
    lines = segments.select(*unit, "pos", "segment_id", F.concat(gap, line).alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "segment_id", "line"))), lambda x: x["line"]), "")
    return lines.groupBy(*unit).agg(joined.alias("text"))


def passages(owned: DataFrame, segments: DataFrame, unit: list[str]) -> DataFrame:
    """segments of each unit's passage with context: its own, the headers of its tables, and what its steps stand under.

    owned(doc_id, *unit, segment_id); segments(doc_id, segment_id, pos, table, header_row, headings, ..):
    header_row says that a row has the headers of its table, headings are the segments over a step.
    Each segment comes once, as context unless the unit owns it.
    """
    about = segments.select("doc_id", "segment_id", "table", "headings")
    mine = owned.select("doc_id", *unit, "segment_id").distinct()
    known = mine.join(about, ["doc_id", "segment_id"])
    over = known.select("doc_id", *unit, F.explode("headings").alias("segment_id"))
    heads = segments.filter("header_row").select("doc_id", "table", F.col("segment_id").alias("_head"))
    tables = known.filter("table is not null").select("doc_id", *unit, "table").distinct().join(heads, ["doc_id", "table"]).select("doc_id", *unit, F.col("_head").alias("segment_id"))
    every = mine.withColumn("_own", F.lit(True)).unionByName(over.withColumn("_own", F.lit(False))).unionByName(tables.withColumn("_own", F.lit(False)))
    once = every.groupBy("doc_id", *unit, "segment_id").agg((~F.bool_or("_own")).alias("context"))
    return once.join(segments, ["doc_id", "segment_id"])
