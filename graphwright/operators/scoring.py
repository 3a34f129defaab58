"""Scoring against gold: recall by branch, intervals, votes, breakdowns, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.functions.text import wilson


def branch_recall(claims: DataFrame, family: str, branch: str) -> DataFrame:
    """Per family: branches that are hit (all of their claims found), claims found, and the 95 % interval."""
    hit = claims.groupBy(family, branch).agg(F.bool_and("found").alias("hit"), F.count(F.lit(1)).alias("claims"), F.count_if("found").alias("found"))
    totals = hit.groupBy(family).agg(
        F.count(F.lit(1)).alias("branches"), F.count_if("hit").alias("hits"), F.sum("claims").alias("claims"), F.sum("found").alias("found")
    )
    low, high = wilson(F.col("hits"), F.col("branches"))
    return totals.withColumn("low", low).withColumn("high", high)


def candidates(gold: DataFrame, predicted: DataFrame, f1: Column, least: float, keep: int) -> DataFrame:
    """The best predicted rows for each gold row: at least so similar, at most so many, larger ids last.

    Both have id and words (distinct); only rows that share a word are compared.
    """
    a = gold.select(F.col("id").alias("gold_id"), F.col("text").alias("gold_text"), F.explode("words").alias("word"))
    b = predicted.select(F.col("id").alias("id"), F.col("text").alias("text"), F.explode("words").alias("word"))
    pairs = a.join(b, "word").filter("gold_id <> id").select("gold_id", "id", "gold_text", "text").distinct()
    scored = pairs.select("gold_id", "id", F.round(f1, 9).alias("score")).filter(F.col("score") >= least)
    place = F.row_number().over(Window.partitionBy("gold_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("place", place).filter(F.col("place") <= keep)


def weighted_share(judged: DataFrame, group: str) -> DataFrame:
    """Support among sampled rows, weighted by 1 / probability, with bounds for those not judged."""
    weight = 1.0 / F.col("probability")
    sums = judged.groupBy(group).agg(
        F.sum(F.when(F.col("supported"), weight).otherwise(0.0)).alias("yes"),
        F.sum(F.when(F.col("supported").isNotNull(), weight).otherwise(0.0)).alias("known"),
        F.sum(weight).alias("all"),
    )
    return sums.select(
        group,
        F.round(F.col("yes") / F.nullif(F.col("known"), F.lit(0.0)), 6).alias("estimate"),
        F.round(F.col("yes") / F.col("all"), 6).alias("lower"),
        F.round((F.col("yes") + F.col("all") - F.col("known")) / F.col("all"), 6).alias("upper"),
    )


def micro_recall(claims: DataFrame, family: str) -> DataFrame:
    """(family, hits, total, low, high): claims found of all claims, with the 95 % interval."""
    totals = claims.groupBy(family).agg(F.count_if("found").alias("hits"), F.count(F.lit(1)).alias("total"))
    low, high = wilson(F.col("hits"), F.col("total"))
    return totals.select(family, "hits", "total", low.alias("low"), high.alias("high"))


def merge_effect(relations: DataFrame, group: str, before: tuple[Column, Column], after: tuple[Column, Column]) -> DataFrame:
    """(group, edges_before, edges_after, edges_delta, sources_delta): distinct edges and sources under two namings."""
    texts = (F.concat_ws("|", *before), F.concat_ws("|", *after), before[0], after[0])
    # one text to a row: few bytes are kept for each distinct one, and none is held beside nulls of the others
    each = relations.select(F.col(group), F.posexplode(F.array(*texts)).alias("_what", "_text")).distinct()
    count = lambda what: F.count_if((F.col("_what") == what) & F.col("_text").isNotNull())
    sizes = each.groupBy(group).agg(count(0).alias("edges_before"), count(1).alias("edges_after"), count(2).alias("_b"), count(3).alias("_a"))
    return sizes.select(group, "edges_before", "edges_after", (F.col("edges_after") - F.col("edges_before")).alias("edges_delta"), (F.col("_a") - F.col("_b")).alias("sources_delta"))


def pairs_to_judge(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(claim, kind, first_edge, edges, ids): what a judge compares with each claim.

    found(claim, kind, edge): candidates of a claim's indicator or action. edges(edge, type, source,
    record, trusted) has one row for each occurrence, trusted by its own tier or else the edge's. An
    indicator is compared with each candidate alone; an action with all trusted remedies of the
    candidate's cause on the same record, which may make up a compound action, once for each such group.
    """
    facts = edges.groupBy("edge").agg(F.min(F.struct("type", "source", "record", "trusted")).alias("e")).select("edge", "e.*")
    single = found.filter("kind = 'indicator'").distinct().select("claim", "kind", F.col("edge").alias("first_edge"), F.lit(1).cast("long").alias("edges"), F.array("edge").alias("ids"))
    groups = facts.filter("type = 'RESOLVED_BY' and trusted").groupBy("source", "record").agg(F.array_sort(F.collect_set("edge")).alias("ids"))
    causes = found.filter("kind = 'action'").join(facts, "edge").select("claim", "kind", "source", "record").distinct()
    acts = causes.join(groups, ["source", "record"]).select("claim", "kind", F.get("ids", F.lit(0)).alias("first_edge"), F.size("ids").cast("long").alias("edges"), "ids")
    return single.unionByName(acts)


def gold_relations(claims: DataFrame) -> DataFrame:
    """(claim_id, kind, types, left, right, segments, conditions): each claim's indicator, and its action if it has one."""
    none = F.array().cast("array<string>")
    both = lambda a, b: F.array_distinct(F.concat(F.coalesce(f"{a}_segments", none), F.coalesce(f"{b}_segments", none)))
    row = lambda kind, types, left, right: F.struct(F.lit(kind).alias("kind"), F.array(*map(F.lit, types)).alias("types"), F.col(left).alias("left"), F.col(right).alias("right"), both(left, right).alias("segments"))
    rows = F.array_compact(F.array(row("indicator", ("INDICATES", "MAY_INDICATE"), "indicator", "failure"), F.when(F.coalesce("action", F.lit("")) != "", row("action", ("RESOLVED_BY",), "failure", "action"))))
    return claims.select("claim_id", F.coalesce("conditions", F.lit("")).alias("conditions"), F.explode(rows).alias("r")).select("claim_id", "r.*", "conditions")
