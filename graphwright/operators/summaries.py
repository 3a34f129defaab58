"""Sums, votes and checks over groups of rows: labels, coverage, usage, attempts, overlaps, folders, budgets, revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A label that wins whenever anyone gives it.
DIAGNOSTIC = "diagnostic"


def majority_labels(votes: DataFrame, page: str) -> DataFrame:
    """(page, label, unsure) of votes(page, label, ord): any diagnostic vote wins, else most votes, on ties the label seen first; unsure if labels differ."""
    counted = votes.groupBy(page, "label").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "first", "label"))
    pages = counted.groupBy(page).agg(F.bool_or(F.col("label") == DIAGNOSTIC).alias("d"), best.alias("best"), F.count(F.lit(1)).alias("labels"))
    return pages.select(page, F.when(F.col("d"), DIAGNOSTIC).otherwise(F.col("best.label")).alias("label"), (F.col("labels") > 1).alias("unsure"))


def coverage_status(items: DataFrame, relations: DataFrame) -> DataFrame:
    """(item, status, represented_by): REPRESENTED by distinct accepted relations, REJECTED_PROPOSAL if only others have the item, else MISSING.

    items(item), relations(item, relation, accepted).
    """
    hits = items.select("item").join(relations, "item", "left")
    status = F.when(F.bool_or("accepted"), "REPRESENTED").when(F.bool_or(F.col("relation").isNotNull()), "REJECTED_PROPOSAL").otherwise("MISSING")
    return hits.groupBy("item").agg(status.alias("status"), F.count_distinct(F.when(F.col("accepted"), F.col("relation"))).alias("represented_by"))


def usage_totals(calls: DataFrame, operation: str, run: str, cents: Column) -> DataFrame:
    """(operation, calls, runs, cents): each operation's calls, and all of them as one row."""
    totals = calls.rollup(operation).agg(F.count(F.lit(1)).alias("calls"), F.count_distinct(run).alias("runs"), F.sum(cents).alias("cents"))
    return totals.select(F.coalesce(operation, F.lit("all")).alias("operation"), "calls", "runs", "cents")


def attempt_totals(log: DataFrame, cents: Column) -> DataFrame:
    """(run_id, attempts, events, cents, longest) of log(run_id, seq, kind, ..): a run_started begins an attempt, what comes before the first is one too."""
    upto = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("attempt", F.sum((F.col("kind") == "run_started").cast("int")).over(upto))
    each = rows.groupBy("run_id", "attempt").agg(F.count(F.lit(1)).alias("events"), F.sum(cents).alias("cents"))
    return each.groupBy("run_id").agg(F.count(F.lit(1)).alias("attempts"), F.sum("events").alias("events"), F.sum("cents").alias("cents"), F.max("events").alias("longest"))


def evidence_overlap(pairs: DataFrame, group: str, left: str, right: str) -> DataFrame:
    """(group, pairs, share): of matched pairs the share whose lists of segments meet."""
    return pairs.groupBy(group).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.arrays_overlap(left, right).cast("int")), 6).alias("share"))


def before_after(rows: DataFrame, group: str, old: Column, value: str) -> DataFrame:
    """(group, before, after, mean_before, mean_after): counts and means of rows of an old and a new version."""
    mean = lambda c: F.round(F.avg(F.when(c, F.col(value))), 2)
    return rows.groupBy(group).agg(F.count_if(old).alias("before"), F.count_if(~old).alias("after"), mean(old).alias("mean_before"), mean(~old).alias("mean_after"))


def ordered_union(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, values) of rows(group, value, ord): each value once, where it comes first, ties by value."""
    firsts = rows.groupBy(group, value).agg(F.min("ord").alias("ord"))
    return firsts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", value))), lambda v: v[value]).alias("values"))


def common_relations(reads: DataFrame, key: list[str], against: Column) -> DataFrame:
    """Relations that reads A and B both have and no row of reads(read, *key) that is against them."""
    both = reads.filter("read = 'A'").select(*key).intersect(reads.filter("read = 'B'").select(*key))
    return both.subtract(reads.filter(against).select(*key))


def missing_names(files: DataFrame, folder: str, required: DataFrame) -> DataFrame:
    """(folder, missing): what each folder of files(folder, name) lacks of required(name), sorted; every folder has a row.

    Required names are few; lacking ones are found by an anti join, not by lists of all files.
    """
    folders = files.select(folder).distinct()
    wanted = folders.join(F.broadcast(required.agg(F.collect_set("name").alias("_all")))).select(folder, F.explode("_all").alias("name"))
    lacking = wanted.join(files.select(folder, "name").distinct(), [folder, "name"], "left_anti").groupBy(folder).agg(F.array_sort(F.collect_list("name")).alias("missing"))
    return folders.join(lacking, folder, "left").select(folder, F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def first_holders(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """(key, known): the least key of the same content, null for the first one; rows with null content are left out."""
    hashed = rows.select(key, F.sha2(content, 256).alias("digest"))
    firsts = hashed.groupBy("digest").agg(F.min(key).alias("known"))
    return hashed.join(firsts, "digest").select(key, F.when(F.col("known") < F.col(key), F.col("known")).alias("known"))


def raises(budgets: DataFrame, owner: str, order: str) -> DataFrame:
    """budgets with before and valid: each later budget of an owner, and whether it is larger than the one before."""
    before = F.lag("budget").over(Window.partitionBy(owner).orderBy(order))
    return budgets.withColumn("before", before).filter("before is not null").withColumn("valid", F.col("budget") > F.col("before"))


def next_revisions(revisions: DataFrame, graph: str) -> DataFrame:
    """(graph, next_revision, revisions): revisions are numbered from 1 without gaps, so the next number is one more than there are."""
    return revisions.groupBy(graph).agg((F.count(F.lit(1)) + 1).alias("next_revision"), F.count(F.lit(1)).alias("revisions"))


def newest_first(versions: DataFrame, group: str, date: Column, key: str) -> DataFrame:
    """versions with place: by date from the newest on, those without one last, then by key."""
    return versions.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.coalesce(date, F.lit("")).desc(), key)))
