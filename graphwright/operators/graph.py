"""Graph operators: derived links, paths, reachability, names, comparison of graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.functions.text import short_digest
from graphwright.operators.components import connected_components, folded
from graphwright.operators.ranking import ranked
from graphwright.plans.checkpoints import cut

# Relation types with the types of their ends.
RELATIONS = (
    ("HAS_COMPONENT", "Asset", "Component"),
    ("MAY_INDICATE", "Symptom", "FailureMode"),
    ("AFFECTS", "FailureMode", "Component"),
    ("RESOLVED_BY", "FailureMode", "CorrectiveAction"),
    ("GENERATES_ERROR", "Asset", "ErrorCode"),
    ("INDICATES", "ErrorCode", "FailureMode"),
)


def _lookup(key: Column) -> Column:
    pairs = [F.lit(x) for name, source, target in RELATIONS for x in (f"{source}>{target}", name)]
    return F.element_at(F.create_map(*pairs), key)


def repaired_relation(relation: Column, source_type: Column, target_type: Column) -> tuple[Column, Column]:
    """(relation type that fits the ends or null, how: exact, repaired, reversed or dropped)."""
    forward = _lookup(F.concat_ws(">", source_type, target_type))
    backward = _lookup(F.concat_ws(">", target_type, source_type))
    how = F.when(forward == relation, "exact").when(forward.isNotNull(), "repaired").when(backward.isNotNull(), "reversed").otherwise("dropped")
    return F.coalesce(forward, backward), how


def derived_links(edges: DataFrame, root: str, relation: str, node: str) -> DataFrame:
    """Links from the root to each node, with the best tier of the node's non-red edges.

    edges has a rank (0 best) and the node's column; identities are digests of relation and node.
    """
    best = edges.filter("rank < 2").groupBy(F.col(node).alias("target_name")).agg(F.min("rank").alias("rank"))
    return best.select(
        short_digest("v3e_", F.lit(relation), F.col("target_name")).alias("edge_id"), F.lit(root).alias("source_name"), "target_name", "rank"
    )


def two_hop_paths(first: DataFrame, second: DataFrame) -> DataFrame:
    """Paths of a first and a second relation that meet, within one unit.

    status is PATH, or UNCLEAR_APPLICABILITY where both state conditions and not the same ones.
    """
    a = first.select("unit_id", F.col("source_name").alias("start"), F.col("target_name").alias("middle"), F.col("conditions").alias("ca"))
    b = second.select("unit_id", F.col("source_name").alias("middle"), F.col("target_name").alias("end"), F.col("conditions").alias("cb"))
    clash = (F.size("ca") > 0) & (F.size("cb") > 0) & (F.col("ca") != F.col("cb"))
    return a.join(b, ["unit_id", "middle"]).withColumn("status", F.when(clash, "UNCLEAR_APPLICABILITY").otherwise("PATH"))


def navigation_gaps(edges: DataFrame) -> DataFrame:
    """Problems that lead to no action and causes that no problem leads to: (kind, name); red edges don't count."""
    edges = cut(edges.select("relation_type", "source_name", "target_name", "tier"))
    kept = edges.filter("tier <> 'red'")
    problems = edges.filter("relation_type = 'MAY_INDICATE'").select(F.col("source_name").alias("name")).distinct()
    solved = kept.filter("relation_type = 'RESOLVED_BY'").select(F.col("source_name").alias("target_name")).distinct()
    reached = kept.filter("relation_type = 'MAY_INDICATE'").join(solved, "target_name", "left_semi").select(F.col("source_name").alias("name")).distinct()
    without = problems.join(reached, "name", "left_anti").select(F.lit("problem_without_action").alias("kind"), "name")
    led = kept.filter("relation_type = 'MAY_INDICATE'").select(F.col("target_name").alias("name")).distinct()
    orphans = solved.select(F.col("target_name").alias("name")).join(led, "name", "left_anti").select(F.lit("orphan_cause").alias("kind"), "name")
    return without.unionByName(orphans)


#: Bits of a node's number; those above tell its view.
VIEW_BITS = 48


def component_sizes(edges: DataFrame, views: dict[str, str]) -> DataFrame:
    """(view, component, nodes, share, largest): weak components of the edges that each view's condition keeps.

    component is the least name, share its part of the view's nodes; largest marks the one with most
    nodes, of equal ones the first by name. Edges are computed once.
    """
    kept = F.array_compact(F.array(*[F.when(F.expr(condition), F.lit(i).cast("long")) for i, condition in enumerate(views.values())]))
    # each task folds its edges first: what is numbered and joined then grows with the nodes
    kept = edges.select(F.col("source_name").alias("u"), F.col("target_name").alias("v"), kept.alias("views")).filter("u is not null and v is not null and size(views) > 0")
    rows = cut(folded(kept)).toDF("v", "source_name", "target_name")
    # names as numbers in their order, so that the least number is the least name; each view has its own
    names = cut(ranked(rows.select(F.col("source_name").alias("name")).union(rows.select("target_name")).distinct(), [], [F.col("name")]))
    numbered = rows.join(names.toDF("source_name", "s"), "source_name").join(names.toDF("target_name", "t"), "target_name")
    numbered = cut(numbered.select("s", "t", "v"))
    node = lambda c: F.shiftleft("v", VIEW_BITS).bitwiseOR(F.col(c))
    labels = connected_components(numbered.select(node("s").alias("u"), node("t").alias("v")))
    # a loop alone makes a component of its own
    loops = numbered.filter("s = t").select(node("s").alias("node")).distinct().join(labels, "node", "left_anti")
    labels = labels.unionByName(loops.withColumn("component", F.col("node")))
    counted = labels.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
    named = counted.select(F.shiftright("component", VIEW_BITS).alias("v"), F.col("component").bitwiseAND(F.lit((1 << VIEW_BITS) - 1)).alias("place"), "nodes").join(names, "place")
    sizes = cut(named.select(F.get(F.array(*map(F.lit, views)), F.col("v").cast("int")).alias("view"), F.col("name").alias("component"), "nodes"))
    # the largest: most nodes, then the first by name
    best = sizes.groupBy("view").agg(F.sum("nodes").alias("total"), F.min(F.struct((-F.col("nodes")).alias("n"), "component")).alias("top"))
    return sizes.join(F.broadcast(best), "view").select("view", "component", "nodes", F.round(F.col("nodes") / F.col("total"), 6).alias("share"), (F.col("component") == F.col("top.component")).alias("largest"))


def canonical_names(named: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """For each group the most frequent name, by which name came first and by alphabet on ties, and its aliases."""
    counted = named.groupBy(group, name).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    by_first = Window.partitionBy(group).orderBy(F.desc("n"), "first")
    by_name = Window.partitionBy(group).orderBy(F.desc("n"), name)
    ranked = counted.withColumn("a", F.row_number().over(by_first)).withColumn("b", F.row_number().over(by_name))
    return ranked.groupBy(group).agg(
        F.max(F.when(F.col("a") == 1, F.col(name))).alias("first_seen_name"),
        F.max(F.when(F.col("b") == 1, F.col(name))).alias("alphabetic_name"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("a") > 1, F.col(name)))), ", ").alias("aliases"),
        (F.count(F.lit(1)) - 1).alias("merged_aliases"),
    )


def run_overlap(relations: DataFrame, run: str, key: list[str]) -> DataFrame:
    """Jaccard similarity of the relations of each pair of runs, four digits; null for two empty runs."""
    distinct = relations.select(run, *key).distinct()
    sizes = distinct.groupBy(run).agg(F.count(F.lit(1)).alias("n"))
    other = distinct.withColumnRenamed(run, "run_b")
    shared = distinct.withColumnRenamed(run, "run_a").join(other, key).filter("run_a < run_b").groupBy("run_a", "run_b").agg(F.count(F.lit(1)).alias("shared"))
    a, b = sizes.toDF("run_a", "na"), sizes.toDF("run_b", "nb")
    pairs = a.join(b, F.col("run_a") < F.col("run_b")).join(shared, ["run_a", "run_b"], "left")
    both = F.coalesce("shared", F.lit(0))
    return pairs.select("run_a", "run_b", both.alias("shared"), F.round(both / F.nullif(F.col("na") + F.col("nb") - both, F.lit(0)), 4).alias("jaccard"))


def row_difference(base: DataFrame, edited: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, fields): rows added, removed or updated, and which fields changed."""
    a = base.select(F.col(key), F.struct(*fields).alias("old"))
    b = edited.select(F.col(key), F.struct(*fields).alias("new"))
    both = a.join(b, key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}")), F.lit(f)) for f in fields]))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.size(changed) > 0, "updated")
    return both.select(key, change.alias("change"), F.when(change == "updated", F.array_join(changed, ",")).otherwise("").alias("fields")).filter("change is not null")


def bounded_paths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, hops): nodes within so many hops of the starts, by the least number; edges(source, target)."""
    frontier = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops"))
    found = frontier
    for hop in range(1, depth + 1):
        frontier = (
            frontier.join(edges.select(F.col("source").alias("node"), "target"), "node").select("start", F.col("target").alias("node"), F.lit(hop).alias("hops")).distinct()
        )
        found = found.unionByName(frontier)
    return found.groupBy("start", "node").agg(F.min("hops").alias("hops"))


def reconnected(orphans: DataFrame, known: DataFrame, scope: list[str]) -> DataFrame:
    """(cause, problem): orphans(cause, scope) with the only known(problem, scope) that any of their scopes holds."""
    # of each scope two different problems are enough to tell that there are several
    ends = known.groupBy(*scope).agg(F.min("problem").alias("least"), F.max("problem").alias("most"))
    met = orphans.distinct().join(ends, scope).groupBy("cause").agg(F.min("least").alias("problem"), F.max("most").alias("_most"))
    return met.filter(F.col("problem") == F.col("_most")).select("cause", "problem")
