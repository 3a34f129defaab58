"""Review: questions about uncertain relations, reviewers in a chain, budgets, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of relation types in the priority of a question; others weigh 1.
WEIGHTS = {"RESOLVED_BY": 4, "MAY_INDICATE": 3, "INDICATES": 3, "AFFECTS": 2}


def questions(assertions: DataFrame) -> DataFrame:
    """One question for the yellow assertions of each unit; units with the same statements share one.

    (question_id, units, statements, n, priority): the priority is ten times the largest weight plus
    the number of assertions.
    """
    statement = F.concat_ws(" ", "source_name", "relation_type", "target_name")
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair]), F.col("relation_type")), F.lit(1))
    by_unit = assertions.filter("tier = 'yellow'").groupBy("unit_id").agg(
        F.array_join(F.array_sort(F.collect_list(statement)), "; ").alias("statements"), F.count(F.lit(1)).alias("n"), F.max(weight).alias("weight")
    )
    # grouped by the digest, a narrow key
    return by_unit.groupBy(F.sha2("statements", 256).alias("digest")).agg(
        F.first("statements").alias("statements"), F.min("unit_id").alias("first_unit"), F.count(F.lit(1)).alias("units"), F.sum("n").alias("n"), F.max("weight").alias("weight")
    ).select(
        F.concat(F.lit("rel:"), F.col("first_unit"), F.lit(":"), F.substring("digest", 1, 20)).alias("question_id"),
        "units", "statements", "n", (F.col("weight") * 10 + F.col("n")).alias("priority"),
    )


def within_budget(asked: DataFrame, group: str, budget: int, *order: Column) -> DataFrame:
    """Adds place and offered: the first of each group up to the budget, the others are deferred."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return asked.withColumn("place", place).withColumn("offered", F.col("place") <= budget)


def settled(answers: DataFrame, question: str, rank: str) -> DataFrame:
    """(question, reviewer, option): the answer of the first reviewer in the chain that is confident and valid.

    Questions that none settles have null for both and stay pending.
    """
    usable = F.when(F.col("confident") & F.col("valid"), F.struct(F.col(rank), "reviewer", "option"))
    best = answers.groupBy(question).agg(F.min(usable).alias("best"))
    return best.select(question, F.col("best.reviewer").alias("reviewer"), F.col("best.option").alias("option"))


def applied_answers(answers: DataFrame, assertion: str, order: str) -> DataFrame:
    """The answer that counts for each assertion: the last one, and a person's over all others."""
    person = (F.col("reviewer") == "user").cast("int")
    ranked = answers.withColumn("_n", F.row_number().over(Window.partitionBy(assertion).orderBy(person.desc(), F.desc(order))))
    return ranked.filter("_n = 1").drop("_n")


def is_additive(before: Column, after: Column) -> Column:
    """Whether after is before plus exactly one element at its end."""
    return (F.size(after) == F.size(before) + 1) & (F.slice(after, F.lit(1), F.size(before)) == before)


def hash_sample(rows: DataFrame, group: str, key: str, size: int, salt: str) -> DataFrame:
    """The first rows of each group by the digest of salt and key: a sample that reruns repeat."""
    digest = F.sha2(F.concat_ws("|", F.lit(salt), key), 256)
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(digest, key)))
    return ranked.filter(F.col("_n") <= size).drop("_n")
