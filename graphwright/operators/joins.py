"""Joins beyond equality: containment, overlap, nearest, references, ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.plans.checkpoints import cut

def contained_names(names: DataFrame, group: str, key: str, words: Column) -> DataFrame:
    """Pairs of a group where all words of the shorter name, two at least, are among those of the longer.

    Only names that share their alphabetically first word of the shorter one are compared, which
    every contained name does.
    """
    rows = names.select(group, F.col(key).alias("key"), F.array_sort(F.array_distinct(words)).alias("words"))
    short = rows.filter(F.size("words") >= 2).select(group, F.col("key").alias("short_key"), F.col("words").alias("short"), F.get("words", F.lit(0)).alias("word"))
    long = rows.select(group, F.col("key").alias("long_key"), F.col("words").alias("long"), F.explode("words").alias("word"))
    inside = (F.size(F.array_except("short", "long")) == 0) & (F.size("short") < F.size("long"))
    return short.join(long, [group, "word"]).filter(inside).select(group, "short_key", "long_key")


def shared_tokens(rows: DataFrame, group: str, key: str, tokens: Column) -> DataFrame:
    """Pairs of a group that share a token, with the number of tokens they share."""
    each = rows.select(group, F.col(key).alias("key"), F.explode(F.array_distinct(tokens)).alias("token"))
    a, b = each.withColumnRenamed("key", "left_key"), each.withColumnRenamed("key", "right_key")
    return a.join(b, [group, "token"]).filter("left_key < right_key").groupBy(group, "left_key", "right_key").agg(F.count(F.lit(1)).alias("shared"))


def overlapping_spans(spans: DataFrame, group: str, width: int) -> DataFrame:
    """Pairs of spans [start, stop) of one group and different owners that intersect; none may exist.

    Spans are put into cells of the given width that they touch, so that only near spans meet.
    """
    cells = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))).alias("cell")
    rows = spans.filter("stop > start").select(group, "owner", "start", "stop", cells)
    a = rows.toDF(group, "left_owner", "a", "b", "cell")
    b = rows.toDF(group, "right_owner", "c", "d", "cell")
    met = a.join(b, [group, "cell"]).filter("left_owner < right_owner and a < d and c < b")
    return met.select(group, "left_owner", "right_owner", F.greatest("a", "c").alias("start"), F.least("b", "d").alias("stop")).distinct()


def boundary_cells(cells: DataFrame, rules: DataFrame, near: float) -> DataFrame:
    """Cells without a rule at their top: (doc_id, row, x0, x1) whose top no rule of the page within near spans."""
    at = cells.withColumn("_y", F.explode(F.array(*[F.floor(F.col("top") / (2 * near)) + i for i in (-1, 0, 1)])))
    lines = rules.withColumn("_y", F.floor(F.col("y") / (2 * near))).select(F.col("doc_id").alias("_d"), "_y", "y", F.col("x0").alias("r0"), F.col("x1").alias("r1"))
    spanned = at.join(lines, (at["doc_id"] == lines["_d"]) & (at["_y"] == lines["_y"]) & (F.abs(F.col("top") - F.col("y")) <= near) & (F.col("r0") <= F.col("x0")) & (F.col("r1") >= F.col("x1")), "left_semi")
    return cells.join(spanned.select(*cells.columns).distinct(), cells.columns, "left_anti")


def unique_resolution(references: DataFrame, targets: DataFrame, key: list[str]) -> DataFrame:
    """References with their target if there is exactly one: status Resolved, Ambiguous or Missing."""
    found = targets.groupBy(*key).agg(F.count_distinct("target").alias("_n"), F.min("target").alias("_t"))
    status = F.when(F.col("_n").isNull(), "Missing").when(F.col("_n") == 1, "Resolved").otherwise("Ambiguous")
    return references.join(found, key, "left").withColumn("status", status).withColumn("target", F.when(F.col("_n") == 1, F.col("_t"))).drop("_n", "_t")


def single_partner(links: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right) of left values that have exactly one partner; a value with very many rows is aggregated before the shuffle."""
    ends = links.groupBy(left).agg(F.min(right).alias(right), F.max(right).alias("_most"))
    return ends.filter(F.col(right) == F.col("_most")).select(left, right)


def new_links(links: DataFrame, late: Column, key: list[str]) -> DataFrame:
    """Keys of late links that no early link has, by one aggregate."""
    return links.groupBy(*key).agg(F.bool_and(late).alias("_new")).filter("_new").select(*key)


def narrowed(refs: DataFrame, cite: str, hit: Column) -> DataFrame:
    """Of each cite the references that are hit, or all of them if none is."""
    any_hit = F.bool_or(hit).over(Window.partitionBy(cite))
    return refs.withColumn("_hit", hit).withColumn("_any", any_hit).filter(F.col("_hit") | ~F.col("_any")).drop("_hit", "_any")


def subset_alignment(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Predicted branches aligned to the only gold branch whose references hold all of theirs.

    gold(gold_id, ref), predicted(pred_id, ref) -> (pred_id, gold_id, candidates); null if not exactly one.
    """
    held = gold.select("gold_id", "ref").distinct()
    golds = held.groupBy("ref").agg(F.transform(F.collect_list(F.struct("gold_id")), lambda x: x["gold_id"]).alias("golds"))
    often = held.groupBy("ref").agg(F.count(F.lit(1)).alias("often"))
    # a branch that holds all references holds the two rarest; few are left to be asked for the others
    known = predicted.distinct().join(often, "ref", "left").groupBy("pred_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "ref"))).alias("r"))
    refs = known.select("pred_id", F.transform("r", lambda x: x["ref"]).alias("refs"))
    ref = lambda i: F.get("refs", F.lit(i))
    first = refs.join(golds.toDF("_first", "golds"), ref(0) == F.col("_first"), "left").select("pred_id", "refs", "golds")
    second = first.join(golds.toDF("_second", "others"), ref(1) == F.col("_second"), "left")
    both = F.when(F.size("refs") < 2, F.col("golds")).otherwise(F.array_intersect("golds", "others"))
    met = second.select("pred_id", both.alias("golds"), F.slice("refs", F.lit(3), F.greatest(F.size("refs") - 2, F.lit(0))).alias("rest"))
    few = met.select("pred_id", F.explode("golds").alias("gold_id"), "rest")
    asked = few.filter(F.size("rest") > 0).select("pred_id", "gold_id", F.size("rest").alias("left"), F.explode("rest").alias("ref"))
    has = held.toDF("_gold", "_ref")
    whole = asked.join(has, F.col("gold_id").eqNullSafe(F.col("_gold")) & (F.col("ref") == F.col("_ref")), "left_semi").groupBy("pred_id", "gold_id").agg(F.count(F.lit(1)).alias("m"), F.first("left").alias("left")).filter("m = left").select("pred_id", "gold_id")
    inside = few.filter(F.size("rest") == 0).select("pred_id", "gold_id").unionByName(whole).groupBy("pred_id").agg(F.count(F.lit(1)).alias("candidates"), F.min("gold_id").alias("g"))
    out = refs.select("pred_id").join(inside, "pred_id", "left").select("pred_id", F.coalesce("candidates", F.lit(0)).alias("candidates"), "g")
    return out.select("pred_id", F.when(F.col("candidates") == 1, F.col("g")).alias("gold_id"), "candidates")


def remedy_overlap(actions: DataFrame, least_shared: int, least_share: float) -> DataFrame:
    """Causes of one origin that share so many actions and so large a part of them: (origin, left_cause, right_cause, shared)."""
    rows = actions.select("origin", "cause", "action").distinct()
    often = rows.groupBy("origin", "action").agg(F.count(F.lit(1)).alias("often"))
    sets = cut(rows.join(often, ["origin", "action"]).groupBy("origin", "cause").agg(F.array_sort(F.collect_list(F.struct("often", "action"))).alias("s")))
    sets = sets.select("origin", "cause", F.size("s").alias("n"), F.transform("s", lambda x: x["action"]).alias("all")).filter(F.col("n") >= least_shared)
    # causes that share so large a part have one of their rarest actions in common; sets move with these
    # actions, so that a pair is judged where it is met and no pair is shuffled
    first = F.slice("all", F.lit(1), F.greatest(F.lit(1), F.col("n") - F.ceil(F.lit(least_share) * F.col("n")).cast("int") + 1))
    keys = sets.select("origin", "cause", "n", "all", first.alias("first"), F.posexplode(first).alias("i", "action"))
    left, right = keys.toDF("origin", "left_cause", "na", "sa", "fa", "ia", "action"), keys.toDF("origin", "right_cause", "nb", "sb", "fb", "ib", "action")
    enough = lambda n: (n >= least_shared) & (n >= F.lit(least_share) * (F.col("na") + F.col("nb") - n) - 1e-9)
    # after their first common action no more than the rest of the shorter tail can be shared
    met = left.join(right, ["origin", "action"]).filter("left_cause < right_cause").filter(enough(F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))))
    met = met.filter(F.col("action") == F.get(F.array_intersect("fa", "fb"), F.lit(0)))
    both = met.withColumn("shared", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return both.filter((F.col("shared") >= least_shared) & (F.col("shared") >= F.lit(least_share) * (F.col("na") + F.col("nb") - F.col("shared")))).select("origin", "left_cause", "right_cause", "shared")


def placed_before(tables: DataFrame, blocks: DataFrame, near: float) -> DataFrame:
    """(page, top, before_block): the first block, by its top, that doesn't stand above a table of its page; null at the end of the page.

    Blocks and tables of a page are put in one order, and each table takes the next block after it,
    so no table is compared with every block.
    """
    rows = blocks.select("page", F.col("top").alias("at"), "pos", F.lit(1).alias("_block"), F.lit(None).cast("double").alias("top"))
    rows = rows.unionByName(tables.select("page", (F.col("top") - near).alias("at"), F.lit(None).cast("long").alias("pos"), F.lit(0).alias("_block"), F.col("top").cast("double").alias("top")))
    after = Window.partitionBy("page").orderBy("at", "_block", "pos").rowsBetween(1, Window.unboundedFollowing)
    found = rows.withColumn("before_block", F.first("pos", ignorenulls=True).over(after))
    return found.filter("_block = 0").select("page", "top", "before_block").distinct()


def outside_tables(blocks: DataFrame, tables: DataFrame, near: float) -> DataFrame:
    """Blocks that no table of their page holds: none whose box, and whose words without spaces, hold the block's."""
    t = tables.select(F.col("page").alias("_p"), F.col("top").alias("_a"), F.col("bottom").alias("_b"), F.col("x0").alias("_l"), F.col("x1").alias("_r"), F.replace("words", F.lit(" "), F.lit("")).alias("_w"))
    inside = (
        (F.col("page") == F.col("_p")) & (F.col("top") >= F.col("_a") - near) & (F.col("top") <= F.col("_b") + near)
        & (F.col("x0") >= F.col("_l") - near) & (F.col("x1") <= F.col("_r") + near) & F.col("_w").contains(F.replace("words", F.lit(" "), F.lit("")))
    )
    return blocks.join(t, inside, "left_anti")
