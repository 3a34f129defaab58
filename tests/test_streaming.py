"""The ledger stream gives what the batch gives, in several batches of files."""

from pyspark.sql import functions as F

from graphwright.operators.ledger import translated_events
from graphwright.plans.staging import live_events
from graphwright.sources.tables import read_table
from graphwright.streaming import ledger as G


def test_totals_agree_with_the_batch(spark, small, tmp_path):
    events = read_table(spark, small, "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = G.totals_by_run(G.event_stream(spark, str(tmp_path / "in"), events.schema))
    G.run_available(stream, "ledger_totals", "complete", str(tmp_path / "state"))
    got = sorted(tuple(r) for r in spark.table("ledger_totals").collect())
    assert got == sorted(tuple(r) for r in G.totals_by_run(events).collect())


def test_windows_drop_nothing_within_the_allowance(spark, small, tmp_path):
    events = read_table(spark, small, "events")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = G.windowed_counts(G.event_stream(spark, str(tmp_path / "in"), events.schema), "1 day", "2 days")
    G.run_available(stream, "daily", "append", str(tmp_path / "state"))
    got = {(r["start"], r["event_type"]): r["events"] for r in spark.table("daily").collect()}
    whole = {(r["start"], r["event_type"]): r["events"] for r in G.windowed_counts(events, "1 day", "2 days").collect()}
    assert got and all(whole[k] == v for k, v in got.items())


def test_state_of_runs_survives_batches_and_repeats(spark, small, tmp_path):
    log = live_events(spark, small).select("run_id", "seq", "kind", F.round(F.col("value") * 100).cast("long").alias("cents"))
    folder = str(tmp_path / "in")
    for low, high in ((0, 400), (300, 700), (700, 10**9)):  # events 300 to 399 come twice
        log.filter((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(folder)
    stream = G.translated_stream(G.event_stream(spark, folder, log.schema))
    G.run_available(stream, "translated", "append", str(tmp_path / "state"))
    got = sorted(tuple(r) for r in spark.table("translated").collect())
    assert got == sorted(tuple(r) for r in translated_events(log).collect())


LOG = "run_id long, seq long, happened timestamp, kind string"


def test_tail_ends_silent_runs_once_and_survives_a_restart(spark, tmp_path):
    import time
    from datetime import datetime

    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    at = datetime(2024, 1, 1)

    def write(*rows):
        spark.createDataFrame([(r, s, at, k) for r, s, k in rows], LOG).coalesce(1).write.mode("append").parquet(folder)

    def start():
        stream = G.tailed_stream(G.event_stream(spark, folder, spark.createDataFrame([], LOG).schema), 2, 4000)
        return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(processingTime="1 second").start()

    def got():
        return sorted((r["run_id"], r["seq"], r["kind"], r["synthetic"]) for r in spark.read.parquet(out).collect())

    def wait(running, done):
        end = time.monotonic() + 90
        while not done():
            assert running.exception() is None and time.monotonic() < end, got()
            time.sleep(0.5)

    # run 1 ends by itself, run 2 falls silent, run 3 has two attempts; events up to 2 were seen before
    write((1, 1, "run_started"), (1, 3, "unit"), (1, 4, "run_finished"), (1, 5, "late"), (2, 1, "run_started"), (2, 3, "unit"), (3, 1, "run_started"), (3, 3, "unit"), (3, 4, "run_started"), (3, 5, "unit"), (3, 6, "run_finished"))
    first = [(1, 3, "unit", False), (1, 4, "run_finished", False), (2, 3, "unit", False), (3, 4, "run_started", False), (3, 5, "unit", False), (3, 6, "run_finished", False)]
    running = start()
    try:
        wait(running, lambda: running.lastProgress and len(got()) >= len(first))
    finally:
        running.stop()
    seen = got()
    assert [r for r in seen if not r[3]] == first
    # the producer of run 2 is dead; the timer outlives the restart, and events that come again are dropped
    write((1, 3, "unit"), (1, 4, "run_finished"), (3, 6, "run_finished"))
    running = start()
    try:
        wait(running, lambda: (2, 4, "run_failed", True) in got())
        # a new attempt opens the run again, and its end is final
        write((2, 5, "run_started"), (2, 6, "run_finished"))
        wait(running, lambda: (2, 6, "run_finished", False) in got())
        time.sleep(6)
    finally:
        running.stop()
    assert got() == sorted([*first, (2, 4, "run_failed", True), (2, 5, "run_started", False), (2, 6, "run_finished", False)])


def test_tail_of_a_table(spark):
    from datetime import datetime

    from graphwright.operators.ledger import tailed

    day = lambda d: datetime(2024, 1, d)
    rows = [(1, 1, day(1), "run_started"), (1, 2, day(2), "run_finished"), (1, 3, day(3), "x"), (2, 1, day(1), "run_started"), (2, 2, day(2), "run_started"), (2, 3, day(3), "x"), (3, 1, day(9), "x"), (4, 5, day(1), "x")]
    got = tailed(spark.createDataFrame(rows, LOG), 1, F.lit("2024-01-10").cast("timestamp"), "3 days").collect()
    assert sorted((r["run_id"], r["seq"], r["kind"], r["synthetic"]) for r in got) == [
        (1, 2, "run_finished", False), (2, 2, "run_started", False), (2, 3, "x", False), (2, 4, "run_failed", True), (4, 5, "x", False), (4, 6, "run_failed", True),
    ]
