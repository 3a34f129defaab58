"""Append-only logs: folds of a cost ledger, attempts, running sums, latest states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calls(ledger: DataFrame) -> DataFrame:
    """Each call's reservation and finalisation: (call_id, reserved, charged, state).

    state is open, finalised, unknown_usage (finalised without an amount: the reservation counts),
    duplicate (several reservations or finalisations) or unreserved. Amounts are sums of all events.
    """
    is_open, is_final = F.col("event") == "call_reserved", F.col("event") == "call_finalized"
    folded = ledger.groupBy("call_id").agg(
        F.sum(F.when(is_open, F.col("amount"))).alias("reserved"),
        F.sum(F.when(is_final, F.col("amount"))).alias("final"),
        F.count_if(is_open).alias("opens"),
        F.count_if(is_final).alias("finals"),
    )
    state = (
        F.when(F.col("opens") == 0, "unreserved").when((F.col("opens") > 1) | (F.col("finals") > 1), "duplicate")
        .when(F.col("finals") == 0, "open").when(F.col("final").isNull(), "unknown_usage").otherwise("finalised")
    )
    charged = F.when(F.col("finals") > 0, F.coalesce("final", "reserved"))
    return folded.select("call_id", F.coalesce("reserved", F.lit(0)).alias("reserved"), F.coalesce(charged, F.lit(0)).alias("charged"), state.alias("state"))


def running_cost(log: DataFrame, run: str, order: list[str], amount: Column) -> DataFrame:
    """Adds cost_so_far: the sum of amounts of the run up to the row."""
    upto = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("cost_so_far", F.coalesce(F.sum(amount).over(upto), F.lit(0)))


def last_attempt(log: DataFrame) -> DataFrame:
    """Events from the last run_started of each run on; runs without one keep all."""
    start = F.max(F.when(F.col("kind") == "run_started", F.col("seq"))).over(Window.partitionBy("run_id"))
    return log.withColumn("_start", start).filter(F.col("_start").isNull() | (F.col("seq") >= F.col("_start"))).drop("_start")


def latest_items(log: DataFrame) -> DataFrame:
    """The last event of each item in a run, of events with one sequence number the least counts."""
    once = log.groupBy("run_id", "seq").agg(F.min(F.struct("item", "kind")).alias("e")).select("run_id", "seq", "e.*")
    return once.groupBy("run_id", "item").agg(F.max(F.struct("seq", "kind")).alias("e"), F.count(F.lit(1)).alias("events")).select(
        "run_id", "item", F.col("e.seq").alias("seq"), F.col("e.kind").alias("kind"), "events"
    )


def order_breaks(log: DataFrame, run: str, order: str, value: Column) -> DataFrame:
    """Per run whether the value never falls in this order, and how often it does."""
    before = F.lag(value).over(Window.partitionBy(run).orderBy(order))
    rows = log.withColumn("_falls", F.coalesce(value < before, F.lit(False)))
    return rows.groupBy(run).agg(F.count_if("_falls").alias("falls"), (~F.bool_or("_falls")).alias("trusted"))


def nth_uses(rows: DataFrame, key: list[str], order: list[str], keep: int) -> DataFrame:
    """The first uses of each key, numbered from 1."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("use", n).filter(F.col("use") <= keep)


def translated_events(log: DataFrame) -> DataFrame:
    """Each event of a run with what is known by then: attempt, units done in it, and the largest cost so far.

    log(run_id, seq, kind, cents); of events with one sequence number the least counts.
    """
    upto = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    once = log.groupBy("run_id", "seq").agg(F.min(F.struct("kind", "cents")).alias("e")).select("run_id", "seq", "e.*")
    rows = once.withColumn("attempt", F.sum((F.col("kind") == "run_started").cast("long")).over(upto))
    within = Window.partitionBy("run_id", "attempt").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "run_id", "seq", "kind", "attempt",
        F.sum((F.col("kind") == "unit_extracted").cast("long")).over(within).alias("units_done"),
        F.max("cents").over(upto).alias("most_cents"),
    )


def nearest_sizes(rows: DataFrame, size: str, keep: int) -> DataFrame:
    """rows with low, high and used: the range of the so many other rows whose size is nearest, and how many there are.

    Of two sizes as near the smaller comes first. Rows are counted by size before anything is
    ordered, so the window holds distinct sizes only, and no more than keep to either side are looked at.
    """
    counts = rows.groupBy(size).agg(F.count(F.lit(1)).alias("_c"))
    order = Window.orderBy(size)
    near = lambda f, i: F.struct(f(size, i).over(order).alias("s"), f("_c", i).over(order).alias("c"))
    around = [F.struct(F.col(size).alias("s"), (F.col("_c") - 1).alias("c")), *[near(f, i) for f in (F.lag, F.lead) for i in range(1, keep + 1)]]
    placed = counts.select(size, F.filter(F.array(*around), lambda x: x["s"].isNotNull() & (x["c"] > 0)).alias("_near"))
    ordered = F.array_sort(F.transform("_near", lambda x: F.struct(F.abs(x["s"] - F.col(size)).alias("d"), x["s"].alias("s"), x["c"].alias("c"))))
    # as many of each size as are still wanted
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast(rows.schema[size].dataType).alias("low"), F.lit(None).cast(rows.schema[size].dataType).alias("high"))
    step = lambda a, x: F.when(a["n"] >= keep, a).otherwise(F.struct(F.least(a["n"] + x["c"], F.lit(keep).cast("long")).alias("n"), F.least(a["low"], x["s"]).alias("low"), F.greatest(a["high"], x["s"]).alias("high")))
    ranges = placed.select(size, F.aggregate(ordered, start, step).alias("_r"))
    return rows.join(ranges, size).select(*rows.columns, F.col("_r.low").alias("low"), F.col("_r.high").alias("high"), F.col("_r.n").alias("used"))


#: Kinds after which a run says no more.
FINAL = ("run_finished", "run_failed")


def tailed(log: DataFrame, after: int, now: Column, silence: str) -> DataFrame:
    """(run_id, seq, happened, kind, synthetic): what a follower of each run gets from its last attempt.

    log(run_id, seq, happened, kind): events past a sequence number up to the first final one. A run
    without a final event whose last one is longer ago than silence, an interval, ends with a failure
    that is made up: its number follows the last, its time is the last's.
    """
    run = Window.partitionBy("run_id")
    rows = last_attempt(log)
    rows = rows.withColumn("_final", F.min(F.when(F.col("kind").isin(*FINAL), F.col("seq"))).over(run))
    told = rows.filter((F.col("seq") > after) & (F.col("_final").isNull() | (F.col("seq") <= F.col("_final"))))
    last = rows.filter("_final is null").groupBy("run_id").agg(F.max("seq").alias("seq"), F.max("happened").alias("happened"))
    dead = last.filter(F.col("happened") < now - F.expr(f"interval {silence}")).select("run_id", (F.col("seq") + 1).alias("seq"), "happened", F.lit("run_failed").alias("kind"), F.lit(True).alias("synthetic"))
    return told.select("run_id", "seq", "happened", "kind", F.lit(False).alias("synthetic")).unionByName(dead)
