"""The cost ledger as a stream: totals per run that every batch updates, and windows with late events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from graphwright.operators.ledger import FINAL


def event_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream of events."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def totals_by_run(events: DataFrame) -> DataFrame:
    """Per user: events, purchases and their sum; works on a stream and on a table alike."""
    bought = F.col("event_type") == "purchase"
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(bought).alias("purchases"), F.sum(F.when(bought, F.round(F.col("value") * 100).cast("long")).otherwise(0)).alias("cents")
    )


def windowed_counts(events: DataFrame, length: str, late: str) -> DataFrame:
    """Events per kind in tumbling windows; events later than the allowance are dropped by the watermark."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("start"), "event_type", "events"
    )


def _translate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """New events of one run, in order, with the state after each; what was seen before is dropped."""
    seen, attempt, units, most = state.get if state.exists else (-1, 0, 0, None)
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    out = []
    for seq, kind, cents in rows[["seq", "kind", "cents"]].itertuples(index=False, name=None):
        if seq <= seen:
            continue
        seen = seq
        if kind == "run_started":
            attempt, units = attempt + 1, 0
        units += kind == "unit_extracted"
        if cents == cents and cents is not None:
            most = int(cents) if most is None else max(most, int(cents))
        out.append((key[0], seq, kind, attempt, units, most))
    state.update((int(seen), int(attempt), int(units), most))
    yield pd.DataFrame(out, columns=["run_id", "seq", "kind", "attempt", "units_done", "most_cents"])


def translated_stream(events: DataFrame) -> DataFrame:
    """translated_events for a stream(run_id, seq, kind, cents) whose sequence numbers rise from batch to batch.

    The state of a run is four numbers; events that come again, as after a restart, are dropped.
    """
    return events.groupBy("run_id").applyInPandasWithState(
        _translate,
        "run_id long, seq long, kind string, attempt long, units_done long, most_cents long",
        "seen long, attempt long, units long, most long",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def tailed_stream(events: DataFrame, after: int, silence_ms: int) -> DataFrame:
    """What a follower of each run gets, as a stream: events past a sequence number, from the last attempt there is, up to a final one.

    events(run_id, seq, happened, kind). A run starts at the last attempt of the first batch that has
    it; a later attempt opens it again. A processing-time timer is set with each batch of a run that
    has no final event; if it goes off, a failure is made up with the next number. The state of a run
    is its last number, whether it has ended, and its last time, so a restart loses and repeats nothing.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["run_id", "seq", "happened", "kind", "synthetic"]
        if state.hasTimedOut:
            seen, _, happened = state.get
            state.update((seen + 1, True, happened))
            yield pd.DataFrame([(key[0], seen + 1, happened, "run_failed", True)], columns=columns)
            return
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        seen, ended, happened = state.get if state.exists else (-1, False, None)
        if not state.exists:
            starts = rows.loc[rows["kind"] == "run_started", "seq"]
            rows = rows[rows["seq"] >= starts.max()] if len(starts) else rows
        out = []
        for seq, at, kind in rows[["seq", "happened", "kind"]].itertuples(index=False, name=None):
            if seq <= seen:
                continue
            seen, happened = int(seq), at
            ended = ended and kind != "run_started"
            if not ended and seq > after:
                out.append((key[0], seen, at, kind, False))
            ended = ended or kind in FINAL
        state.update((seen, ended, happened))
        if not ended:
            state.setTimeoutDuration(silence_ms)
        yield pd.DataFrame(out, columns=columns)

    return events.groupBy("run_id").applyInPandasWithState(
        follow, "run_id long, seq long, happened timestamp, kind string, synthetic boolean", "seen long, ended boolean, happened timestamp", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Processes what is there, then stops; the result is the in-memory table of that name, for small results."""
    running = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return running
