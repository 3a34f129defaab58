"""Guards: which answers, runs, scopes and pages may go on, and what is said about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a relation is said in plain English.
SENTENCES = {
    "MAY_INDICATE": "{0} may be a sign of {1}.",
    "INDICATES": "The code {0} stands for {1}.",
    "RESOLVED_BY": "{0} is put right by {1}.",
    "AFFECTS": "{0} affects {1}.",
    "HAS_COMPONENT": "{0} has the part {1}.",
}


def valid_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """answers(question_id, option, input) with state: valid, UNKNOWN_QUESTION, UNKNOWN_OPTION or INPUT_MISSING.

    questions(question_id, options array<struct<id, needs_input>>).
    """
    joined = answers.join(questions.select("question_id", "options"), "question_id", "left")
    chosen = F.get(F.filter("options", lambda o: o["id"] == F.col("option")), F.lit(0))
    missing = chosen["needs_input"] & (F.coalesce(F.btrim("input"), F.lit("")) == "")
    state = F.when(F.col("options").isNull(), "UNKNOWN_QUESTION").when(chosen.isNull(), "UNKNOWN_OPTION").when(missing, "INPUT_MISSING").otherwise("valid")
    return joined.withColumn("state", state).drop("options")


def scripted_answers(questions: DataFrame, script: DataFrame) -> DataFrame:
    """(question_id, option, by): the scripted answer for a question's id, else for its kind, else the default option.

    questions(question_id, kind, default), script(key, option): of repeated keys the least option counts.
    """
    given = script.groupBy("key").agg(F.min("option").alias("option"))
    by_id, by_kind = (given.select(F.col("key").alias(c), F.col("option").alias(f"_{c}")) for c in ("question_id", "kind"))
    joined = questions.join(by_id, "question_id", "left").join(by_kind, "kind", "left")
    how = F.when(F.col("_question_id").isNotNull(), "id").when(F.col("_kind").isNotNull(), "kind").otherwise("default")
    return joined.select("question_id", F.coalesce("_question_id", "_kind", "default").alias("option"), how.alias("by"))


def admitted(runs: DataFrame) -> DataFrame:
    """runs(run_id, committed, worst, ceiling, limit, resumed) with admitted and the ceiling that holds.

    A run is refused if what is committed and the worst case reach the ceiling, or the worst case
    reaches what is left of the limit; a resumed run keeps the lower of both ceilings.
    """
    ceiling = F.when(F.col("resumed"), F.least("ceiling", F.col("committed") + F.col("limit"))).otherwise(F.col("ceiling"))
    refused = (F.col("committed") + F.col("worst") >= ceiling) | (F.col("worst") >= F.col("limit"))
    return runs.withColumn("holds", ceiling).withColumn("admitted", ~refused)


def lifecycle(questions: DataFrame, answers: DataFrame, running: DataFrame) -> DataFrame:
    """(run_id, may_answer, may_apply, may_approve) of each run that has questions.

    Answers are taken while nothing runs; they can be applied if no question is open and one isn't
    applied; a run can be approved if none is open and all are applied. questions(run_id,
    question_id), answers(question_id, applied), running(run_id).
    """
    said = answers.groupBy("question_id").agg(F.bool_or("applied").alias("applied"))
    state = questions.join(said, "question_id", "left").groupBy("run_id").agg(F.bool_or(F.col("applied").isNull()).alias("open"), F.bool_or(~F.coalesce("applied", F.lit(True))).alias("unapplied"))
    busy = running.select("run_id").distinct().withColumn("busy", F.lit(True))
    joined = state.join(busy, "run_id", "left")
    idle = F.col("busy").isNull()
    return joined.select("run_id", (idle & F.col("open")).alias("may_answer"), (idle & ~F.col("open") & F.col("unapplied")).alias("may_apply"), (idle & ~F.col("open") & ~F.col("unapplied")).alias("may_approve"))


def scoped_branches(refs: DataFrame) -> DataFrame:
    """(unit_id, section, record, branch): the only branch of a record's references, else one provisional branch for the unit's section.

    refs(unit_id, section, record, branch, structured): only references in tables and flowcharts name a branch.
    """
    named = F.when(F.col("structured"), F.col("branch"))
    ends = refs.groupBy("unit_id", "section", "record").agg(F.min(named).alias("a"), F.max(named).alias("b"))
    fallback = F.concat(F.lit("provisional:"), F.substring(F.sha2(F.concat_ws("|", "unit_id", "section"), 256), 1, 12))
    return ends.select("unit_id", "section", "record", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(fallback).alias("branch"))


def marked_content(pages: DataFrame, evidence: DataFrame) -> DataFrame:
    """pages(manual, page, label, ..) where a page with diagnostic evidence(manual, page) that the map missed becomes diagnostic and unsure."""
    found = evidence.select("manual", "page").distinct().withColumn("_found", F.lit(True))
    joined = pages.join(found, ["manual", "page"], "left")
    turned = F.coalesce("_found", F.lit(False)) & (F.col("label") != "diagnostic")
    return joined.withColumn("unsure", F.col("unsure") | turned).withColumn("label", F.when(turned, "diagnostic").otherwise(F.col("label"))).drop("_found")


def sentence(relation: Column, source: Column, target: Column) -> Column:
    """A relation in plain words; relations without a sentence are said by their name."""
    said = F.concat_ws(" ", source, relation, target)
    for name, text in SENTENCES.items():
        before, between, after = text.replace("{1}", "{0}").split("{0}")
        said = F.when(relation == name, F.concat(F.lit(before), source, F.lit(between), target, F.lit(after))).otherwise(said)
    return said


def rendered_question(question: Column, statements: Column, options: Column) -> Column:
    """A question as one text: its id, its statements as a list, and its options in order."""
    return F.concat_ws("\n", F.concat(F.lit("Question "), question), F.lit("What the system proposes:"), F.array_join(F.transform(statements, lambda s: F.concat(F.lit("  - "), s)), "\n"), F.lit("Answer with one option:"), F.array_join(F.transform(options, lambda o: F.concat(F.lit("  "), o)), "\n"))


def page_routes(pages: DataFrame, image_share: float, drawings: int) -> DataFrame:
    """pages with reasons and routes: how each is to be read, and why.

    pages(.., segments, short, table, complex_table, image_share, drawings, images, unreadable): layout
    alone says what may need a visual reading, not whether the page matters. A page is a candidate if
    its text can't be read, most of many segments are short, images take a large share, it has many
    drawings, or a table with merged or listing cells.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(flag("unreadable"), "NATIVE_TEXT_UNREADABLE"), F.when((F.col("segments") >= 8) & (F.col("short") * 2 >= F.col("segments")), "SHORT_BLOCK_LAYOUT"),
        F.when(F.col("image_share") >= image_share, "IMAGE_AREA_CANDIDATE"), F.when(F.col("drawings") >= drawings, "DRAWING_DENSITY_CANDIDATE"), F.when(flag("complex_table"), "COMPLEX_TABLE"),
    ))
    rows = pages.withColumn("reasons", reasons)
    text = F.coalesce(F.col("segments"), F.lit(0)) > 0
    seen = text | (F.coalesce("images", F.lit(0)) > 0) | (F.coalesce("drawings", F.lit(0)) > 0)
    routes = F.array_compact(F.array(F.when(text, "TEXT"), F.when(flag("table"), "TABLE"), F.when((F.size("reasons") > 0) & seen, "VISUAL_REVIEW"), F.when(flag("unreadable"), "OCR_REVIEW")))
    return rows.withColumns({"routes": routes, "reasons": F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("READABLE_NATIVE_TEXT")))})


def routed_map(page_map: DataFrame, routes: DataFrame, key: list[str]) -> DataFrame:
    """page_map with what a visual reading found: a diagnostic page joins the map, confirmed, with its evidence; an unresolved one is marked.

    page_map(*key, label, confirmed, evidence), routes(*key, relevance, evidence).
    """
    found = routes.select(*key, "relevance", F.col("evidence").alias("_seen"))
    rows = page_map.join(found, key, "left")
    hit = F.coalesce(F.col("relevance") == "DIAGNOSTIC", F.lit(False))
    none = F.array().cast("array<string>")
    return rows.withColumns({
        "label": F.when(hit, "diagnostic").otherwise(F.col("label")), "confirmed": hit | F.col("confirmed"),
        "evidence": F.when(hit, F.array_sort(F.array_union(F.coalesce("evidence", none), F.coalesce("_seen", none)))).otherwise(F.col("evidence")),
        "unresolved": F.coalesce(F.col("relevance") == "UNRESOLVED", F.lit(False)),
    }).drop("relevance", "_seen")
