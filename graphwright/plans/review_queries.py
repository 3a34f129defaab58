"""Queries that ask, answer and apply: conversations are questions, their turns a chain of reviewers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphwright.operators import certify as C
from graphwright.operators import review as R
from graphwright.plans import staging as S
from graphwright.plans.graph_queries import _ASSERTION
from graphwright.registry import query
from graphwright.sources.tables import read_table

_WEIGHT = "case relation_type when 'RESOLVED_BY' then 4 when 'MAY_INDICATE' then 3 else 1 end"
_QUESTION = f"""{_ASSERTION}, by_unit as (
  select unit_id, string_agg(concat_ws(' ', source_name, relation_type, target_name), '; ' order by concat_ws(' ', source_name, relation_type, target_name)) as statements, count(*) as n, max({_WEIGHT}) as weight
  from assertion where tier = 'yellow' group by unit_id
), question as (
  select 'rel:' || min(unit_id) || ':' || substr(sha256(statements), 1, 20) as question_id, count(*) as units, statements, sum(n)::bigint as n, max(weight) * 10 + sum(n)::bigint as priority from by_unit group by statements
)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    return rows.select(
        F.col("conv_id").alias("question"), F.col("turn").alias("place"), F.col("role").alias("reviewer"),
        F.element_at(F.array(F.lit("accept"), F.lit("reject"), F.lit("correct"), F.lit("other")), (F.length("text") % 4 + 1).cast("int")).alias("option"),
        (F.length("text") % 3 != 0).alias("confident"), (F.length("text") % 4 != 3).alias("valid"),
    )


_ANSWER = """
answer as (
  select conv_id as question, turn as place, role as reviewer, (['accept', 'reject', 'correct', 'other'])[(length(text) % 4 + 1)::int] as option,
    length(text) % 3 <> 0 as confident, length(text) % 4 <> 3 as valid from conversations
)"""


@query("l13_questions", f"with {_QUESTION} select * from question")
def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about the yellow assertions."""
    return R.questions(C.assertions(S.proposals(spark, sf_dir, by_unit=True)))


@query(
    "o04_question_budget",
    f"with {_QUESTION}, placed as (select *, row_number() over (partition by priority order by n desc, question_id)::int as place from question) select question_id, priority, place, place <= 20 as offered from placed",
)
def question_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty questions of each priority are offered, the others deferred."""
    asked = R.questions(C.assertions(S.proposals(spark, sf_dir, by_unit=True)))
    return R.within_budget(asked, "priority", 20, F.desc("n"), F.col("question_id")).select("question_id", "priority", "place", "offered")


@query(
    "l14_reviewer_chain",
    f"""with {_ANSWER}, ranked as (select *, row_number() over (partition by question order by place, reviewer, option) as n from answer where confident and valid)
    select q.question, r.reviewer, r.option from (select distinct question from answer) q left join ranked r on r.question = q.question and r.n = 1""",
)
def reviewer_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first confident, valid answer to each question."""
    return R.settled(_answers(spark, sf_dir), "question", "place")


@query(
    "j33_applied_answers",
    f"""with {_ANSWER}, ranked as (select *, row_number() over (partition by question order by (reviewer = 'user')::int desc, place desc) as n from answer where valid) select question, place, reviewer, option from ranked where n = 1""",
)
def applied_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer that counts for each question."""
    return R.applied_answers(_answers(spark, sf_dir).filter("valid"), "question", "place").select("question", "place", "reviewer", "option")


@query("p13_answer_validity", f"with {_ANSWER} select reviewer, option, valid, confident, count(*) as answers, count(distinct question) as questions from answer group by all")
def answer_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by option and whether they are usable."""
    return _answers(spark, sf_dir).groupBy("reviewer", "option", "valid", "confident").agg(F.count(F.lit(1)).alias("answers"), F.count_distinct("question").alias("questions"))


@query(
    "o08_audit_sample",
    """with ranked as (select source, doc_id, row_number() over (partition by source order by sha256('audit|' || doc_id), doc_id) as n from documents) select source, doc_id from ranked where n <= 5""",
)
def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents of each source by digest."""
    return R.hash_sample(read_table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 5, "audit")


@query(
    "l23_open_for_people",
    f"""with {_ANSWER}, state as (select question, bool_or(confident and valid) as closed, bool_or(reviewer = 'system') as people_only, count(*) as answers from answer group by question)
    select question, answers, people_only from state where not closed or people_only""",
)
def open_for_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that no reviewer closed, and those that only people may answer."""
    state = _answers(spark, sf_dir).groupBy("question").agg(
        F.bool_or(F.col("confident") & F.col("valid")).alias("closed"), F.bool_or(F.col("reviewer") == "system").alias("people_only"), F.count(F.lit(1)).alias("answers")
    )
    return state.filter("not closed or people_only").select("question", "answers", "people_only")


@query(
    "u08_additive_answers",
    """with lists as (select conv_id, list(turn // 4 order by turn) filter (where role = 'assistant') as after, list(turn // 4 order by turn) filter (where role = 'user') as before from conversations group by conv_id)
    select conv_id, coalesce(len(before), 0) as old_answers, coalesce(len(after), 0) as new_answers, coalesce(len(after), 0) = coalesce(len(before), 0) + 1 and coalesce(after[1:len(before)] = before, true) as additive from lists""",
)
def additive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the assistant's list of places is the user's plus exactly one."""
    listed = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", F.floor(F.col("turn") / 4).alias("v"))))), lambda s: s["v"])
    lists = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(listed("user").alias("before"), listed("assistant").alias("after"))
    return lists.select("conv_id", F.size("before").cast("long").alias("old_answers"), F.size("after").cast("long").alias("new_answers"), R.is_additive(F.col("before"), F.col("after")).alias("additive"))
