"""Layout of manuals: reading order, continuations, numbered steps, merged cells, runs of pages.

All of it is windows over (document, position); nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.functions.text import OPEN_END, STEP, SUB_STEP


def reading_positions(segments: DataFrame) -> DataFrame:
    """Adds position: gapless from 0 in the order of page and pos, per document."""
    order = Window.partitionBy("doc_id").orderBy("page", "pos")
    return segments.withColumn("position", F.row_number().over(order) - 1)


def continuations(segments: DataFrame) -> DataFrame:
    """Adds continues: the segment before on the page has no sentence end, and this one starts in lower case."""
    page = Window.partitionBy("doc_id", "page").orderBy("pos")
    before = F.lag("text").over(page)
    lower = F.col("text").rlike(r"^\p{Ll}") & ~F.col("text").rlike(SUB_STEP)
    return segments.withColumn("continues", F.coalesce(before.rlike(OPEN_END) & lower, F.lit(False)))


def numbered_steps(segments: DataFrame) -> DataFrame:
    """Adds sequence, step and head to segments with continues (see continuations).

    A numbered segment starts a new sequence if its number is 1, less than the one before, or the
    first. Numbers run on over pages of a document. Lettered sub-steps carry the number, and
    continuations the step, of what they belong to; other segments have neither. head is the
    segment on the same page before a sequence's first step, if it is no step itself.
    """
    document = Window.partitionBy("doc_id").orderBy("page", "pos")
    page = Window.partitionBy("doc_id", "page").orderBy("pos")
    text = F.col("text")
    number = F.when(~F.col("continues"), F.expr("try_cast(nullif(_digits, '') as int)"))
    rows = segments.withColumn("_digits", F.regexp_extract(text, STEP, 1)).withColumn("_number", number)
    rows = rows.withColumn("_last", F.last("_number", ignorenulls=True).over(document.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.col("_number").isNotNull() & ((F.col("_number") == 1) | F.col("_last").isNull() | (F.col("_number") < F.col("_last")))
    rows = rows.withColumn("_new", new).withColumn("_sequence", F.sum(F.col("_new").cast("int")).over(document))
    now = F.last("_number", ignorenulls=True).over(document)
    letter = F.when(~F.col("continues") & F.col("_number").isNull(), F.regexp_extract(text, SUB_STEP, 1))
    rows = rows.withColumn("_now", now).withColumn("_letter", letter)
    own = F.when(F.col("_number").isNotNull(), F.col("_number").cast("string")).when(
        (F.col("_letter") != "") & F.col("_now").isNotNull(), F.concat(F.col("_now").cast("string"), F.col("_letter"))
    )
    # a continuation takes the step of the last segment that is none, on the page
    rows = rows.withColumn("_own", own).withColumn("_run", F.sum((~F.col("continues")).cast("int")).over(page))
    same = Window.partitionBy("doc_id", "page", "_run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    step = F.first("_own").over(same)
    rows = rows.withColumn("step", step)
    before = F.lag("segment_id").over(page)
    head = F.when(F.col("_new") & F.lag("step").over(page).isNull(), before)
    return rows.withColumn("head", head).withColumn("sequence", F.when(F.col("step").isNotNull(), F.col("_sequence").cast("int"))).drop(
        "_digits", "_number", "_last", "_new", "_sequence", "_now", "_letter", "_own", "_run"
    )


def fill_down(rows: DataFrame, columns: list[str], group: str = "doc_id", order: str = "row") -> DataFrame:
    """Blank cells take the value above, and where it comes from: adds <column>_filled and <column>_origin."""
    above = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for c in columns:
        given = F.when(F.col(c) != "", F.struct(F.col(c).alias("value"), F.col(order).alias("origin")))
        last = F.last(given, ignorenulls=True).over(above)
        rows = rows.withColumn(f"{c}_filled", last["value"]).withColumn(f"{c}_origin", last["origin"])
    return rows


def origin_rows(rows: DataFrame, inherits: Column, group: str = "doc_id", order: str = "row") -> DataFrame:
    """Adds origin: for an inheriting row the nearest row above that doesn't inherit, unless a row is missing between."""
    upto = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    island = F.col(order) - F.row_number().over(Window.partitionBy(group).orderBy(order))
    last = F.last(F.when(~inherits, F.struct(F.col(order).alias("at"), island.alias("island"))), ignorenulls=True).over(upto)
    return rows.withColumn("_island", island).withColumn("_last", last).withColumn(
        "origin", F.when(inherits & (F.col("_last.island") == F.col("_island")), F.col("_last.at"))
    ).drop("_island", "_last")


def fill_page_gaps(pages: DataFrame) -> DataFrame:
    """Promotes pages between two diagnostic ones, and procedures beside one, by the labels as given."""
    order = Window.partitionBy("manual").orderBy("page")
    side = lambda step: F.when(
        (F.lag("page", step) if step > 0 else F.lead("page", -step)).over(order) == F.col("page") - step,
        (F.lag("label", step) if step > 0 else F.lead("label", -step)).over(order) == "diagnostic",
    )
    before, after = F.coalesce(side(1), F.lit(False)), F.coalesce(side(-1), F.lit(False))
    promoted = (F.col("label").isin("other", "procedure") & before & after) | ((F.col("label") == "procedure") & (before | after))
    return pages.withColumn("promoted", promoted).withColumn("new_label", F.when(promoted, "diagnostic").otherwise(F.col("label"))).withColumn(
        "new_unsure", promoted | F.col("unsure")
    )


def page_runs(pages: DataFrame, group: str = "manual") -> DataFrame:
    """Runs of consecutive pages: (group, first_page, last_page, pages)."""
    distinct = pages.select(group, "page").distinct()
    island = F.col("page") - F.row_number().over(Window.partitionBy(group).orderBy("page"))
    return distinct.withColumn("_island", island).groupBy(group, "_island").agg(
        F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count(F.lit(1)).alias("pages")
    ).drop("_island")


def section_batches(pages: DataFrame, size: int) -> DataFrame:
    """Adds batch: a new one when the section changes or so many pages are in it."""
    order = Window.partitionBy("manual").orderBy("page")
    changed = F.coalesce((~F.lag("section").over(order).eqNullSafe(F.col("section"))).cast("int"), F.lit(1))
    rows = pages.withColumn("_changed", F.when(F.lag("page").over(order).isNull(), 1).otherwise(changed))
    rows = rows.withColumn("_run", F.sum("_changed").over(order))
    within = Window.partitionBy("manual", "_run").orderBy("page")
    rows = rows.withColumn("_part", F.floor((F.row_number().over(within) - 1) / F.lit(size)))
    starts = F.row_number().over(within) % size == (1 % size)
    return rows.withColumn("batch", F.sum(starts.cast("int")).over(order)).drop("_changed", "_run", "_part")


def carried_sections(pages: DataFrame, title: Column) -> DataFrame:
    """Adds carried_title: the last title at or before the page."""
    upto = Window.partitionBy("manual").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("carried_title", F.last(title, ignorenulls=True).over(upto))


def sandwiched_pages(pages: DataFrame) -> DataFrame:
    """Pages strictly between the first and last confirmed page of their section, if no other section lies between."""
    confirmed = pages.filter("confirmed").groupBy("manual", "section").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    inside = pages.select("manual", "page", F.col("section").alias("own")).join(confirmed, "manual")
    inside = inside.filter("page > first_page and page < last_page")
    pure = inside.groupBy("manual", "section").agg(F.bool_and(F.col("own") == F.col("section")).alias("pure"))
    return inside.filter("own = section").join(pure.filter("pure"), ["manual", "section"]).select("manual", "section", "page")
