"""Certification: witnesses and tiers of proposed relations, and the edges they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.functions.text import short_digest

#: Ranks of tiers, best first.
TIERS = ("green", "yellow", "red")
#: Reviewers, the one that outweighs all others last.
REVIEWERS = ("auto", "agent", "human")
#: Validation issues that make a relation red; any other makes it yellow.
GRAVE_ISSUES = ("MISSING_EVIDENCE", "INVALID_EVIDENCE", "CROSS_BRANCH_CONTAMINATION", "SUPERSEDED")


def tier(structure: Column, agreement: Column, verdict: Column, reviewer: Column, rejected: Column, issues: Column) -> Column:
    """green, yellow or red.

    In this order: a rejection is red; issues are red if grave, else yellow; a person's or agent's
    confirmation is green (an automatic one is no witness); a verdict of not_supported leaves yellow
    with another witness and red without; two witnesses are green, one is yellow, none red. The
    witnesses are structure, agreement and a verdict of supported; a missing verdict is none.
    """
    grave = F.exists(issues, lambda i: i.isin(*GRAVE_ISSUES))
    return _tier(structure, agreement, verdict == "supported", verdict == "not_supported", reviewer.isin("human", "agent"), rejected, F.size(issues) > 0, grave)


def _tier(structure: Column, agreement: Column, supported: Column, refuted: Column, confirmed: Column, rejected: Column, flawed: Column, grave: Column) -> Column:
    """The tier from truth values; null counts as false."""
    sure = lambda value: F.coalesce(value, F.lit(False))
    support = sure(structure).cast("int") + sure(agreement).cast("int") + sure(supported).cast("int")
    return (
        F.when(sure(rejected), "red")
        .when(sure(flawed), F.when(sure(grave), "red").otherwise("yellow"))
        .when(sure(confirmed), "green")
        .when(sure(refuted), F.when(support > 0, "yellow").otherwise("red"))
        .when(support >= 2, "green").when(support == 1, "yellow").otherwise("red")
    )


def tier_rank(name: Column) -> Column:
    """0 for green, 1 for yellow, 2 for red."""
    return F.when(name == "green", 0).when(name == "yellow", 1).otherwise(2)


def tier_name(rank: Column) -> Column:
    """The tier of a rank."""
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), (rank + 1).cast("int"))


def assertions(proposals: DataFrame) -> DataFrame:
    """Proposals of one unit about the same relation as one assertion with its witnesses and tier.

    proposals has unit_id, row, relation_type, source_name, target_name, read, verdict, structure and
    condition, and what review and validation found: reviewer (human, agent, auto or null), rejected
    and issue. Reads A and B agree if both propose it. supported outweighs not_supported, which
    outweighs a missing verdict; a person outweighs an agent, and an agent an automatic reviewer.
    One rejection rejects. Conditions and issues are those of any proposal, sorted.
    """
    # the tier is made of numbers and truth values alone: sets and texts that nobody asks for are then not gathered
    verdict = F.col("verdict")
    place = F.when(verdict < "not_supported", 0).when(verdict == "not_supported", 1).when(verdict < "supported", 2).when(verdict == "supported", 3).when(verdict > "supported", 4)
    grouped = proposals.groupBy("unit_id", "relation_type", "source_name", "target_name").agg(
        F.bool_or("structure").alias("structure"),
        (F.bool_or(F.col("read") == "A") & F.bool_or(F.col("read") == "B")).alias("agreement"),
        F.max("verdict").alias("verdict"),
        F.array_sort(F.collect_set("condition")).alias("conditions"),
        F.min("row").alias("row"),
        F.count(F.lit(1)).alias("proposals"),
        F.get(F.array(*[F.lit(r) for r in REVIEWERS]), F.max(F.array_position(F.array(*[F.lit(r) for r in REVIEWERS]), F.col("reviewer"))) - 1).alias("reviewer"),
        F.coalesce(F.bool_or("rejected"), F.lit(False)).alias("rejected"),
        F.array_sort(F.collect_set("issue")).alias("issues"),
        F.max(place).alias("_place"),
        F.bool_or(F.col("issue").isNotNull()).alias("_flawed"),
        F.bool_or(F.col("issue").isin(*GRAVE_ISSUES)).alias("_grave"),
    )
    confirmed = F.col("reviewer").isin("human", "agent")
    named = grouped.withColumn("tier", _tier(F.col("structure"), F.col("agreement"), F.col("_place") == 3, F.col("_place") == 1, confirmed, F.col("rejected"), F.col("_flawed"), F.col("_grave")))
    return named.drop("_place", "_flawed", "_grave")


def edges(asserted: DataFrame) -> DataFrame:
    """One edge for each relation type, source and target, with its identity, best tier and occurrences."""
    return (
        asserted.groupBy("relation_type", "source_name", "target_name")
        .agg(
            F.min(tier_rank(F.col("tier"))).alias("rank"),
            F.count(F.lit(1)).alias("occurrences"),
            F.count_if(F.col("tier") == "green").alias("green"),
            F.count_if(F.col("tier") == "red").alias("red"),
        )
        .select(
            short_digest("v3e_", F.col("relation_type"), F.col("source_name"), F.col("target_name")).alias("edge_id"),
            "relation_type", "source_name", "target_name", tier_name(F.col("rank")).alias("tier"), "occurrences", "green", "red",
        )
    )


def common_conditions(asserted: DataFrame) -> DataFrame:
    """Conditions that all non-red occurrences of an edge share: (relation_type, source_name, target_name, conditions)."""
    edge = ["relation_type", "source_name", "target_name"]
    # every occurrence states the null condition, whose count is that of the occurrences
    stated = F.explode(F.array_append(F.col("conditions"), F.lit(None).cast("string"))).alias("condition")
    counted = asserted.filter("tier <> 'red'").select(*edge, stated).groupBy(*edge, "condition").agg(F.count(F.lit(1)).alias("m"))
    by_edge = counted.groupBy(*edge).agg(F.max("m").alias("n"), F.collect_list(F.when(F.col("condition").isNotNull(), F.struct("condition", "m"))).alias("stated"))
    shared = F.transform(F.filter("stated", lambda s: s["m"] == F.col("n")), lambda s: s["condition"])
    return by_edge.select(*edge, F.array_sort(shared).alias("conditions"))
