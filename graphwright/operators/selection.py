"""Selection: what is shown, asked, kept, sampled and published, and in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def of_view(edges: DataFrame, view: str, derived: bool = False) -> DataFrame:
    """Edges of a view: green, not_trusted (all tiers but green) or all; derived ones only if wanted."""
    return edges.filter(VIEWS[view]() if derived else VIEWS[view]() & ~F.col("derived"))


#: Which edges each view keeps.
VIEWS = {"green": lambda: F.col("tier") == "green", "not_trusted": lambda: F.col("tier") != "green", "all": lambda: F.lit(True)}


def in_views(edges: DataFrame, derived: bool = False) -> DataFrame:
    """Adds view: each edge once for each view that has it; the edges are read once."""
    rows = edges if derived else edges.filter(~F.col("derived"))
    return rows.withColumn("view", F.explode(F.array_compact(F.array(*[F.when(kept(), view) for view, kept in VIEWS.items()]))))


def matching_relations(edges: DataFrame, occurrences: DataFrame, types: tuple[str, ...], text: str, page: int | None, status: str | None) -> DataFrame:
    """Edges of these types whose ends hold the text and of which an occurrence is on the page and has the status."""
    hit = F.col("type").isin(*types) & (F.lower("source").contains(text.lower()) | F.lower("target").contains(text.lower()))
    wanted = F.lit(True)
    if page is not None:
        wanted = wanted & F.col("segment").startswith(f"p{page}.")
    if status is not None:
        wanted = wanted & (F.coalesce("status", F.lit("pending")) == status)
    return edges.filter(hit).join(occurrences.filter(wanted).select("edge_id").distinct(), "edge_id", "left_semi")


def eligible_endpoints(nodes: DataFrame, relations: tuple[tuple[str, str, str], ...], text: str) -> DataFrame:
    """(relation, side, node_id): nodes of each relation's domain and range whose name or id holds the text."""
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("relation"), F.lit(s).alias("side"), F.lit(t).alias("t")) for n, d, r in relations for s, t in (("source", d), ("target", r))]))
    found = nodes.filter(F.lower("name").contains(text.lower()) | F.lower("node_id").contains(text.lower()))
    return found.select("node_id", "type", sides.alias("s")).filter("type = s.t").select("s.relation", "s.side", "node_id")


def most_common(rows: DataFrame, group: str, value: Column, order: Column) -> DataFrame:
    """(group, value): the most common value that isn't empty, of equal ones the first seen; null if there is none."""
    counted = rows.select(group, F.nullif(F.btrim(value), F.lit("")).alias("value"), order.alias("o")).groupBy(group, "value").agg(F.count("value").alias("n"), F.min("o").alias("o"))
    return counted.groupBy(group).agg(F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("n"), "o", "value"))).alias("b")).select(group, F.col("b.value").alias("value"))


def first_of(rows: DataFrame, group: str, keep: int, *order: Column) -> DataFrame:
    """The first rows of each group in an order, and the place of each; Spark cuts groups before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= keep)


def published(questions: DataFrame, known: DataFrame, budget: int) -> DataFrame:
    """(run, question_id, place): questions that aren't known, aren't approvals, each once, up to the budget of a run."""
    fresh = questions.filter("kind <> 'approval'").groupBy("run", "question_id").agg(F.min("seq").alias("seq"))
    fresh = fresh.join(known.select("question_id").distinct(), "question_id", "left_anti")
    return first_of(fresh, "run", budget, F.col("seq"), F.col("question_id")).select("run", "question_id", "place")


def proportional(groups: DataFrame, floor: int, total: int) -> DataFrame:
    """(group, size, taken): floor for each group that has them, the rest one by one to the largest left / (taken + 1).

    groups(group, size). The k-th further row of a group comes at the quotient it has then, so the
    rows of all groups are ranked by their quotients; of equal ones the first group by name. No group
    can get more than total rows, so so many quotients of each are enough.
    """
    base = groups.withColumn("base", F.least(F.lit(floor), F.col("size")))
    used = base.agg(F.coalesce(F.sum("base"), F.lit(0)).alias("u")).first()["u"]
    rest = max(0, total - used)
    if not rest:
        return base.select("group", "size", F.col("base").cast("long").alias("taken"))
    steps = F.sequence(F.lit(0), F.least(F.lit(rest), F.col("size") - F.col("base")).cast("int") - 1)
    # left and taken when the k-th is handed out; quotients fall, so a group's come in order
    quotients = base.filter("size > base").select("group", F.posexplode(steps).alias("k", "_s"), (F.col("size") - F.col("base")).alias("left"), "base")
    quotients = quotients.select("group", "k", ((F.col("left") - F.col("k")) / (F.col("base") + F.col("k") + 1)).alias("q"))
    given = quotients.orderBy(F.desc("q"), "group", "k").limit(rest).groupBy("group").agg(F.count(F.lit(1)).alias("more"))
    return base.join(given, "group", "left").select("group", "size", (F.col("base") + F.coalesce("more", F.lit(0))).cast("long").alias("taken"))


def blind_sample(items: DataFrame, group: str, key: str, outside: Column, size: int, seed: int) -> DataFrame:
    """(group, key, place): half of each group's sample from outside, the rest from what is left, by digest; places are shuffled by another."""
    digest = lambda salt: F.sha2(F.concat_ws("|", F.lit(f"{salt}{seed}"), F.col(key)), 256)
    drawn = items.select(group, key, outside.alias("_out"), digest("draw").alias("_d"))
    first = first_of(drawn.filter("_out"), group, (size + 1) // 2, F.col("_d"), F.col(key)).select(group, key, F.lit(0).alias("_turn"))
    # what is not among the first, in order; the first take their places before it
    ranked = drawn.join(first.select(key), key, "left_anti").select(group, key, "_d")
    rest = first_of(ranked, group, size, F.col("_d"), F.col(key)).select(group, key, F.lit(1).alias("_turn"), F.col("place").alias("_n"))
    both = first.withColumn("_n", F.lit(0)).unionByName(rest)
    kept = first_of(both, group, size, F.col("_turn"), F.col("_n"), F.col(key)).drop("place")
    return kept.select(group, key, F.row_number().over(Window.partitionBy(group).orderBy(digest("show"), key)).alias("place"))


def natural_order(text: Column) -> list[Column]:
    """Sort columns for a text: empty ones last, numbers by value before words without case."""
    whole = F.btrim(text).rlike(r"^-?[0-9]+(\.[0-9]+)?$")
    value = F.when(whole, F.btrim(text).cast("double"))
    return [(F.coalesce(F.btrim(text), F.lit("")) == "").asc(), value.asc_nulls_last(), F.lower(text).asc_nulls_last(), text.asc_nulls_last()]


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths of before(path, digest) that after lacks with the same digest."""
    return before.join(after, ["path", "digest"], "left_anti").select("path")
