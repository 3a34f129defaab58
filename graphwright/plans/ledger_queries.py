"""Queries over the events table as a cost ledger and as the log of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphwright.operators import ledger as G
from graphwright.plans import staging as S
from graphwright.registry import query
from graphwright.sources.tables import read_table

_CALL = f"""{S.LEDGER}, folded as (
  select call_id, sum(amount) filter (where event = 'call_reserved') as reserved, sum(amount) filter (where event = 'call_finalized') as final,
    count(*) filter (where event = 'call_reserved') as opens, count(*) filter (where event = 'call_finalized') as finals from ledger group by call_id
), call as (
  select call_id, coalesce(reserved, 0)::bigint as reserved, case when finals > 0 then coalesce(final, reserved, 0) else 0 end::bigint as charged,
    case when opens = 0 then 'unreserved' when opens > 1 or finals > 1 then 'duplicate' when finals = 0 then 'open' when final is null then 'unknown_usage' else 'finalised' end as state from folded
)"""


@query("j35_ledger_calls", f"with {_CALL} select * from call")
def ledger_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call of the ledger with its state."""
    return G.calls(S.ledger(spark, sf_dir))


@query(
    "a17_ledger_totals",
    f"with {_CALL} select state, count(*) as calls, (sum(charged) / 1000000)::decimal(38, 6) as committed, (sum(case when state = 'open' then reserved else 0 end) / 1000000)::decimal(38, 6) as reserved from call group by state",
)
def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money committed and reserved, by state of the call."""
    calls = G.calls(S.ledger(spark, sf_dir))
    money = lambda c: (F.sum(c).cast("decimal(38,6)") / 1000000).cast("decimal(38,6)")
    return calls.groupBy("state").agg(F.count(F.lit(1)).alias("calls"), money(F.col("charged")).alias("committed"), money(F.when(F.col("state") == "open", F.col("reserved")).otherwise(0)).alias("reserved"))


@query(
    "w17_running_cost",
    f"""with {S.LIVE} select run_id, seq, coalesce(sum(case when kind = 'unit_extracted' then round(value * 100)::bigint end) over (partition by run_id order by happened, seq rows between unbounded preceding and current row), 0)::bigint as cost_so_far from live""",
)
def running_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of each run up to each event, in hundredths."""
    amount = F.when(F.col("kind") == "unit_extracted", F.round(F.col("value") * 100).cast("long"))
    return G.running_cost(S.live_events(spark, sf_dir), "run_id", ["happened", "seq"], amount).select("run_id", "seq", "cost_so_far")


@query(
    "w20_last_attempt",
    f"""with {S.LIVE}, started as (select *, max(case when kind = 'run_started' then seq end) over (partition by run_id) as start from live)
    select run_id, count(*) as events, min(seq) as first_seq, max(seq) as last_seq, count(*) filter (where kind = 'unit_extracted') as units from started where start is null or seq >= start group by run_id""",
)
def last_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last attempt of each run."""
    return G.last_attempt(S.live_events(spark, sf_dir)).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count_if(F.col("kind") == "unit_extracted").alias("units")
    )


@query("t06_latest_items", f"with {S.LIVE} select run_id, item, max(seq) as seq, arg_max(kind, seq) as kind, count(*) as events from live group by run_id, item")
def latest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each item of each run."""
    return G.latest_items(S.live_events(spark, sf_dir))


@query(
    "w19_order_breaks",
    f"""with {S.LIVE}, steps as (select run_id, value < lag(value) over (partition by run_id order by seq) as falls from live) select run_id, count(*) filter (where falls) as falls, not coalesce(bool_or(falls), false) as trusted from steps group by run_id""",
)
def order_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose values fall at some event."""
    return G.order_breaks(S.live_events(spark, sf_dir), "run_id", "seq", F.col("value"))


@query(
    "w22_nth_uses",
    f"""with {S.LIVE}, used as (select run_id, item, kind, seq, row_number() over (partition by run_id, item, kind order by happened desc, seq desc)::int as use from live) select * from used where use <= 3""",
)
def nth_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three events of each kind and item of a run."""
    return G.nth_uses(S.live_events(spark, sf_dir), ["run_id", "item", "kind"], [F.desc("happened"), F.desc("seq")], 3).select("run_id", "item", "kind", "seq", "use")


@query(
    "t07_admission_audit",
    f"""with {S.LEDGER}, moved as (select run_id, seq, sum(case when event = 'call_reserved' then coalesce(amount, 0) else -coalesce(amount, 0) end) over (partition by run_id order by seq rows between unbounded preceding and current row)::bigint as held from ledger)
    select run_id, max(held) as most_held, count(*) filter (where held > 2000000000) as over_ceiling from moved group by run_id""",
)
def admission_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most that each run ever held, and events above a ceiling."""
    signed = F.coalesce("amount", F.lit(0)) * F.when(F.col("event") == "call_reserved", 1).otherwise(-1)
    held = F.sum(signed).over(Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return S.ledger(spark, sf_dir).withColumn("held", held).groupBy("run_id").agg(F.max("held").alias("most_held"), F.count_if(F.col("held") > 2000000000).alias("over_ceiling"))


@query(
    "j36_nearest_runs",
    f"""with {S.LIVE}, sizes as (select run_id, count(*) as n from live group by run_id), distinct_sizes as (select n, count(*) as runs from sizes group by n),
    others as (select a.n, b.n as other_n, b.runs - (a.n = b.n)::int as runs, coalesce(sum(b.runs - (a.n = b.n)::int) over (partition by a.n order by abs(a.n - b.n), b.n rows between unbounded preceding and 1 preceding), 0) as nearer from distinct_sizes a, distinct_sizes b),
    ranges as (select n, min(other_n) as low, max(other_n) as high, sum(least(runs, 2 - nearer))::bigint as used from others where runs > 0 and nearer < 2 group by n)
    select s.run_id, s.n, low, high, coalesce(used, 0) as used from sizes s left join ranges r on s.n = r.n""",
)
def nearest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range that the two runs of the nearest size give; of two as near the smaller comes first."""
    return G.nearest_sizes(S.live_events(spark, sf_dir).groupBy("run_id").agg(F.count(F.lit(1)).alias("n")), "n", 2)


@query(
    "x41_call_costs",
    """with calls as (select event_id, (event_id * 7919) % 400000 as prompt, (event_id * 104729) % 20000 as completion, (event_id * 31) % 90000 as cached_raw, (event_id * 17) % 50000 as write_raw from events),
    split as (select *, least(prompt, cached_raw) as cached, least(greatest(0, prompt - least(prompt, cached_raw)), write_raw) as written from calls)
    select event_id, ((((prompt - cached - written) * 10 + cached * 1) * 100 + written * 1250) * (case when prompt > 272000 then 4 else 2 end) + completion * 5000 * (case when prompt > 272000 then 3 else 2 end))::bigint as cost from split""",
)
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of model calls whose token counts follow from the events, in units of 5e-11 dollars.

    Per million tokens: 0.10 ordinary, 0.01 cached, 0.125 written to the cache, 0.50 output; above
    272,000 prompt tokens input costs twice and output one and a half times as much.
    """
    key = F.col("event_id")
    prompt, completion = key * 7919 % 400000, key * 104729 % 20000
    cached = F.least(prompt, key * 31 % 90000)
    written = F.least(F.greatest(F.lit(0), prompt - cached), key * 17 % 50000)
    long_prompt = prompt > 272000
    inputs = (((prompt - cached - written) * 10 + cached) * 100 + written * 1250) * F.when(long_prompt, 4).otherwise(2)
    outputs = completion * 5000 * F.when(long_prompt, 3).otherwise(2)
    return read_table(spark, sf_dir, "events").select("event_id", (inputs + outputs).cast("long").alias("cost"))


@query(
    "t10_daily_windows",
    f"""with {S.LIVE} select date_trunc('day', happened) as day, kind, count(*) as events, count(distinct run_id) as runs from live group by all""",
)
def daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and kind: tumbling windows."""
    live = S.live_events(spark, sf_dir)
    return live.groupBy(F.window("happened", "1 day").alias("w"), "kind").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("run_id").alias("runs")).select(F.col("w.start").alias("day"), "kind", "events", "runs")


@query(
    "t01_translated_events",
    f"""with {S.LIVE}, attempts as (select *, round(value * 100)::bigint as cents, sum((kind = 'run_started')::int) over (partition by run_id order by seq rows between unbounded preceding and current row)::bigint as attempt from live)
    select run_id, seq, kind, attempt, sum((kind = 'unit_extracted')::int) over (partition by run_id, attempt order by seq rows between unbounded preceding and current row)::bigint as units_done,
      max(cents) over (partition by run_id order by seq rows between unbounded preceding and current row) as most_cents from attempts""",
)
def translated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of every run with the state of the run after it."""
    live = S.live_events(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return G.translated_events(live)


@query(
    "t04_tailed_events",
    f"""with {S.LIVE}, attempt as (select *, max(seq) filter (where kind = 'run_started') over (partition by run_id) as start from live), kept as (select *, min(seq) filter (where kind in ('run_finished', 'run_failed')) over (partition by run_id) as final from attempt where start is null or seq >= start)
    select run_id, seq, happened, kind, false as synthetic from kept where seq > 500 and (final is null or seq <= final)
    union all select run_id, max(seq) + 1, max(happened), 'run_failed', true from kept where final is null group by run_id having max(happened) < timestamp '2024-01-28 00:00:00'""",
)
def tailed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a follower of each run gets past event 500; runs silent for two days on January 30 have failed."""
    return G.tailed(S.live_events(spark, sf_dir).select("run_id", "seq", "happened", "kind"), 500, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), "2 days")
