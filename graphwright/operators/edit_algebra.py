"""Edits of a graph: nodes, edges and occurrences added, changed and removed, with what each edit comes to.

A graph is nodes(node_id, type, name, ..), edges(edge_id, type, source, target, derived) and
occurrences(edge_id, occ_id, segment, condition, trusted, status). Edits are rows with an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_additions(nodes: DataFrame, additions: DataFrame, types: tuple[str, ...], root: str, fields: tuple[str, ...]) -> DataFrame:
    """additions(ord, node_id, type, field, ..) with outcome: added, or why not.

    NODE_TYPE: unknown or the root's; RESERVED_FIELD: not one of the fields that people may set;
    DUPLICATE_ID: a node has the id, or an earlier addition that is in order.
    """
    known = nodes.select("node_id", F.lit(True).alias("_known")).distinct()
    checked = additions.join(known, "node_id", "left").withColumn(
        "_problem",
        F.when(~F.col("type").isin(*types) | (F.col("type") == root), "NODE_TYPE")
        .when(F.col("_known"), "DUPLICATE_ID")
        .when(~F.col("field").isin(*fields), "RESERVED_FIELD"),
    )
    first = checked.filter("_problem is null").groupBy("node_id").agg(F.min("ord").alias("_first"))
    taken = F.when(F.col("ord") == F.col("_first"), "added").otherwise("DUPLICATE_ID")
    return checked.join(first, "node_id", "left").withColumn("outcome", F.coalesce("_problem", taken)).drop("_known", "_problem", "_first")


def edge_edits(edges: DataFrame, edits: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(edge_id, ord, op, outcome, invalidated) for the last edit of each edge.

    edits(ord, op, edge_id, type, source, target), op one of add, delete and replace. Derived edges
    can't be touched; an edge to be added must not exist, the others must. A replaced edge keeps
    its occurrences, whose certificates are no longer valid: invalidated is their number.
    """
    last = edits.groupBy("edge_id").agg(F.max(F.struct("ord", "op")).alias("e")).select("edge_id", "e.ord", "e.op")
    known = edges.groupBy("edge_id").agg(F.bool_or("derived").alias("_derived"))
    held = occurrences.groupBy("edge_id").agg(F.count(F.lit(1)).alias("_n"))
    there = F.col("_derived").isNotNull()
    outcome = (
        F.when((F.col("op") == "add") & there, "DUPLICATE_ID").when((F.col("op") != "add") & ~there, "EDGE_NOT_FOUND")
        .when((F.col("op") != "add") & F.col("_derived"), "DERIVED_READ_ONLY").otherwise("applied")
    )
    joined = last.join(known, "edge_id", "left").join(held, "edge_id", "left").withColumn("outcome", outcome)
    lost = F.when((F.col("op") == "replace") & (F.col("outcome") == "applied"), F.coalesce("_n", F.lit(0))).otherwise(F.lit(0))
    return joined.select("edge_id", "ord", "op", "outcome", lost.cast("long").alias("invalidated"))


def occurrence_edits(occurrences: DataFrame, edits: DataFrame, allowed: Column) -> DataFrame:
    """Occurrences after edits: (edge_id, occ_id, segment, condition, trusted, status, outcome).

    edits(edge_id, occ_id, op, segment, condition), one for each occurrence. allowed tells which
    segments may be cited. Added occurrences are not trusted; an update counts only if something
    changes, and then the certificate is gone. outcome is kept, added, updated, unchanged, deleted or
    an error: SEGMENT_NOT_ALLOWED, DUPLICATE_ID or OCCURRENCE_NOT_FOUND, which leave all as it was.
    """
    key = ["edge_id", "occ_id"]
    old = occurrences.select(*key, F.struct("segment", "condition", "trusted", "status").alias("old"))
    new = edits.select(*key, "op", F.struct("segment", "condition").alias("new"), allowed.alias("_ok"))
    both = old.join(new, key, "full_outer")
    there, same = F.col("old").isNotNull(), F.col("old.segment").eqNullSafe(F.col("new.segment")) & F.col("old.condition").eqNullSafe(F.col("new.condition"))
    outcome = (
        F.when(F.col("op").isNull(), "kept").when((F.col("op") == "add") & there, "DUPLICATE_ID").when((F.col("op") != "add") & ~there, "OCCURRENCE_NOT_FOUND")
        .when(F.col("op") == "delete", "deleted").when(~F.col("_ok"), "SEGMENT_NOT_ALLOWED").when(F.col("op") == "add", "added").when(same, "unchanged").otherwise("updated")
    )
    both = both.withColumn("outcome", outcome)
    changed = F.col("outcome").isin("added", "updated")
    pick = lambda c: F.when(changed, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
    trusted = F.when(changed, False).otherwise(F.col("old.trusted"))
    status = F.when(~changed, F.col("old.status"))
    return both.select(*key, pick("segment"), pick("condition"), trusted.alias("trusted"), status.alias("status"), "outcome")


def content_hash(*parts: Column) -> Column:
    """The digest of what an occurrence says; null parts count as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def decided(before: DataFrame, after: DataFrame, decisions: DataFrame) -> DataFrame:
    """(edge_id, occ_id, decision, outcome): decisions that count.

    A decision(edge_id, occ_id, decision, content_hash) must name what the occurrence says before all
    edits, else it is STALE_OCCURRENCE, and what it says after them, else it is dropped.
    """
    key = ["edge_id", "occ_id"]
    says = content_hash(F.col("edge_id"), F.col("segment"), F.col("condition"))
    old, new = before.select(*key, says.alias("_old")), after.select(*key, says.alias("_new"))
    joined = decisions.join(old, key, "left").join(new, key, "left")
    outcome = (
        F.when(F.col("_old").isNull(), "OCCURRENCE_NOT_FOUND").when(F.col("_old") != F.col("content_hash"), "STALE_OCCURRENCE")
        .when(F.coalesce(F.col("_new") != F.col("content_hash"), F.lit(True)), "dropped").otherwise(F.col("decision"))
    )
    return joined.select(*key, "decision", outcome.alias("outcome"))


def invalidated(edges: DataFrame, occurrences: DataFrame, changed: DataFrame) -> DataFrame:
    """occurrences(edge_id, occ_id) of underived edges at nodes that changed(node_id): their certificates are no longer valid."""
    ends = edges.filter("not derived").select("edge_id", F.explode(F.array("source", "target")).alias("node_id"))
    touched = ends.join(changed.select("node_id").distinct(), "node_id", "left_semi").select("edge_id").distinct()
    return occurrences.join(touched, "edge_id", "left_semi").select("edge_id", "occ_id")


def recomputed(nodes: DataFrame, edges: DataFrame, occurrences: DataFrame, touched: DataFrame, root: str, relations: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """(edge_id, type, source, target, derived, trusted, tier, conditions, occurrences): all edges after an edit.

    nodes(node_id, type), edges(edge_id, type, source, target, derived), occurrences(edge_id, occ_id,
    segment, condition, tier, status, review_hash). An occurrence is trusted unless it is rejected: if
    it is green, or was confirmed as it still is. An edge is trusted if one that isn't rejected is; its
    tier is the best of those, green or yellow, or none. Conditions, those that all of them share, are
    given for touched edges only, null for others, which keep theirs. Links of a single root to all
    nodes in its relations' ranges are made again, with the trust and tier of what meets the node; an
    old link keeps its id, others are gone. Without a single root there are none. Repeated nodes count once.
    """
    live = F.coalesce(F.col("status") != "rejected", F.lit(True))
    same = F.coalesce((F.col("status") == "confirmed") & (F.col("review_hash") == content_hash(F.col("edge_id"), F.col("segment"), F.col("condition"))), F.lit(False))
    trusted = live & ((F.col("tier") == "green") | same)
    mine = edges.filter("not derived").select("edge_id", "type", "source", "target").distinct()
    rank = F.min(F.when(live & F.col("tier").isin("green", "yellow"), F.when(F.col("tier") == "green", 0).otherwise(1)))
    # null stands for no condition, which an occurrence shares with none
    by = occurrences.groupBy("edge_id").agg(
        F.bool_or(trusted).alias("trusted"), rank.alias("rank"), F.count_if(live).alias("occurrences"), F.count_distinct(F.when(live, F.coalesce("condition", F.lit("")))).alias("different"), F.max(F.when(live, F.col("condition"))).alias("common"),
    )
    marked = mine.join(by, "edge_id", "left").join(touched.select("edge_id", F.lit(True).alias("touched")), "edge_id", "left")
    shared = F.when((F.col("different") == 1) & F.col("common").isNotNull(), F.array("common")).otherwise(F.array().cast("array<string>"))
    tier = F.when(F.col("rank") == 0, "green").when(F.col("rank") == 1, "yellow")
    own = marked.select("edge_id", "type", "source", "target", F.lit(False).alias("derived"), F.coalesce("trusted", F.lit(False)).alias("trusted"), tier.alias("tier"), F.when(F.col("touched"), shared).alias("conditions"), F.coalesce("occurrences", F.lit(0)).alias("occurrences"), "rank")

    known = nodes.select("node_id", "type").distinct()
    roots = known.filter(F.col("type") == root).agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("root")).filter("n = 1")
    goals = F.array(*[F.struct(F.lit(n).alias("relation"), F.lit(r).alias("range")) for n, d, r in relations if d == root])
    links = known.select("node_id", "type", F.explode(goals).alias("g")).filter("type = g.range").join(F.broadcast(roots)).select(F.col("g.relation").alias("type"), F.col("root").alias("source"), F.col("node_id").alias("target"))
    old = edges.filter("derived").groupBy("type", "source", "target").agg(F.min("edge_id").alias("edge_id"))
    met = own.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("target"), "trusted", "rank").groupBy("target").agg(F.bool_or("trusted").alias("trusted"), F.min("rank").alias("rank"))
    made = F.concat(F.lit("v3e_"), F.substring(F.sha2(F.concat_ws("|", "type", "source", "target"), 256), 1, 20))
    derived = links.join(old, ["type", "source", "target"], "left").join(met, "target", "left").select(
        F.coalesce("edge_id", made).alias("edge_id"), "type", "source", "target", F.lit(True).alias("derived"), F.coalesce("trusted", F.lit(False)).alias("trusted"), tier.alias("tier"), F.lit(None).cast("array<string>").alias("conditions"), F.lit(1).cast("long").alias("occurrences")
    )
    return own.drop("rank").unionByName(derived)
