"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many points (virtual nodes) of a ring of 32-bit positions. A row belongs to the arc
that ends at the next point clockwise from the hash of its text, so equal texts lie together. Shards
have a capacity in rows; what an arc can't put into its own full shard continues to the next point
clockwise, round by round. Rows only move when a shard on their way fills up.

Only counts per arc reach the driver (shards * points numbers, a fixed bound). There the walk is
done for whole runs of rows: the outcome is a list of segments of the ring order, each with its
shard and first slot. A row finds its segment from its rank in ring order, and ranks come from
counts of small cells plus a row number inside each cell, so that no task ever holds a hot arc.
Equal texts share a cell unless they have more copies than a cell is to hold. Points, cells and
segments are looked up in broadcast tables of fixed size; no Python runs on the rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.plans.checkpoints import cut

#: Points of each shard on the ring.
VIRTUAL_NODES = 128
#: Aimed rows of a cell, at least; grows with the table so that cells stay countable.
CELL_ROWS = 500
CELLS = 2_000_000
#: Texts with more copies than a cell holds are broadcast up to this number.
BROADCAST_TEXTS = 200_000
#: Leading bits of a position by which its arc is looked up.
LOOKUP_BITS = 12


def ring_points(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all virtual nodes in ring order, and the shard of each."""
    points = sorted(
        (int.from_bytes(hashlib.md5(f"{shard}:{node}".encode()).digest()[:4], "big"), shard, node)
        for shard in range(shards)
        for node in range(virtual_nodes)
    )
    return np.array([p[0] for p in points], np.int64), np.array([p[1] for p in points], np.int64)


@dataclass
class Segments:
    """Runs of the ring order: first rank, shard and first slot of each."""

    starts: np.ndarray
    shard: np.ndarray
    slot: np.ndarray


def capacities(rows: int, shards: int, slack: float) -> np.ndarray:
    """Rows that each shard holds at most. Without slack they add up to all rows, at most one apart."""
    base, extra = divmod(rows, shards)
    exact = np.full(shards, base, np.int64) + (np.arange(shards) < extra)
    return exact if slack <= 0 else np.full(shards, int(np.ceil(rows * (1 + slack) / shards)), np.int64)


def walk(counts: np.ndarray, owner: np.ndarray, capacity: np.ndarray) -> Segments:
    """The bounded-load walk over arcs with counts[i] rows that end at a point of shard owner[i].

    In round r every arc, in ring order, offers its remaining rows, first ranks first, to the shard
    r points further on; that shard takes what fits.
    """
    arcs = len(counts)
    room, used = capacity.astype(np.int64).copy(), np.zeros(len(capacity), np.int64)
    left, first = counts.astype(np.int64).copy(), np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    runs: list[tuple[int, int, int]] = []
    for step in range(arcs):
        waiting = np.flatnonzero(left)
        if not len(waiting):
            break
        for arc in waiting:
            shard = owner[(arc + step) % arcs]
            fit = min(left[arc], room[shard])
            if fit:
                runs.append((first[arc], shard, used[shard]))
                first[arc] += fit
                left[arc] -= fit
                room[shard] -= fit
                used[shard] += fit
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 3)
    return Segments(table[:, 0], table[:, 1], table[:, 2])


def ring_position(text: Column) -> Column:
    """32 bits of the text's hash; null texts count as empty."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 32)


def shard_rows(
    docs: DataFrame,
    shards: int,
    *,
    key: str = "doc_id",
    text: str = "text",
    slack: float = 0.0,
    virtual_nodes: int = VIRTUAL_NODES,
) -> DataFrame:
    """All rows of docs plus shard (int, from 0) and slot (long, gapless from 0 in each shard).

    With slack 0 the numbers of rows of any two shards differ by one at most; with slack s no shard
    exceeds (1 + s) times the mean, and fewer rows leave their own arc. Null ids and texts are
    allowed (a null text counts as empty), repeated rows get slots of their own, a single text may
    make up the whole table, and an empty table gives an empty result. All columns are kept but
    those named shard and slot, which are replaced.
    """
    spark = docs.sparkSession
    points, owner = ring_points(shards, virtual_nodes)
    arcs = len(points)
    # the rows' own columns get names that clash with none below, and theirs back at the end
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)], F.col(key).alias("_ring_key"), F.col(text).alias("_ring_text"))

    # the arc of a position: points before its stretch of the ring, and those of the stretch that are below it
    high = points >> (32 - LOOKUP_BITS)
    stretches = [(b, int(np.searchsorted(high, b)), points[high == b].tolist()) for b in range(1 << LOOKUP_BITS)]
    lookup = F.broadcast(spark.createDataFrame(stretches, "_ring_high int, _ring_before int, _ring_points array<bigint>"))
    position = ring_position(F.col("_ring_text"))
    placed = rows.withColumn("_ring_high", F.shiftright(position, 32 - LOOKUP_BITS).cast("int")).join(lookup, "_ring_high", "left")
    below = F.size(F.filter("_ring_points", lambda p: p < position))
    placed = placed.withColumn("_ring_arc", F.pmod(F.col("_ring_before") + below, F.lit(arcs)).cast("int")).drop("_ring_high", "_ring_before", "_ring_points")

    per_arc = np.zeros(arcs, np.int64)
    for row in placed.groupBy("_ring_arc").count().collect():  # at most shards * virtual_nodes rows
        per_arc[row["_ring_arc"]] = row["count"]
    total = int(per_arc.sum())
    cell_rows = max(CELL_ROWS, total // CELLS)
    cells = np.maximum(1, -(-per_arc // cell_rows))
    segments = walk(per_arc, owner, capacities(total, shards, slack))
    first_rank = np.concatenate([[0], np.cumsum(per_arc)[:-1]]).astype(np.int64)
    begins = np.searchsorted(segments.starts, first_rank, side="right") - 1
    ends = np.searchsorted(segments.starts, first_rank + per_arc, side="left")
    runs = [[(int(segments.starts[i]), int(segments.shard[i]), int(segments.slot[i])) for i in range(max(0, begins[arc]), ends[arc])] for arc in range(arcs)]
    by_arc = [(arc, int(cells[arc]), int(first_rank[arc]), runs[arc]) for arc in range(arcs)]
    by_arc = F.broadcast(spark.createDataFrame(by_arc, "_ring_arc int, _ring_cells bigint, _ring_first bigint, _ring_runs array<struct<start:bigint,shard:int,slot:bigint>>"))

    content = F.xxhash64(F.coalesce(F.col("_ring_text"), F.lit("")))
    placed = placed.withColumn("_ring_content", content).drop("_ring_text")
    # hot texts: each has more rows than a cell, so there are fewer of them than cells
    hot = placed.groupBy("_ring_content").agg(F.count(F.lit(1)).alias("_ring_n")).filter(F.col("_ring_n") > cell_rows).select("_ring_content", F.lit(True).alias("_ring_hot"))
    hot = cut(hot)
    placed = placed.join(F.broadcast(hot) if hot.count() <= BROADCAST_TEXTS else hot, "_ring_content", "left").join(by_arc.select("_ring_arc", "_ring_cells"), "_ring_arc")
    spread = F.when(F.col("_ring_hot"), F.xxhash64("_ring_content", "_ring_key")).otherwise(F.xxhash64("_ring_content", F.lit(1)))
    placed = placed.withColumn("_ring_cell", F.pmod(spread, F.col("_ring_cells")).cast("int"))
    in_cell = Window.partitionBy("_ring_arc", "_ring_cell")
    ordered = placed.withColumn("_ring_row", F.row_number().over(in_cell.orderBy("_ring_content", "_ring_key")))
    counts = placed.groupBy("_ring_arc", "_ring_cell").agg(F.count(F.lit(1)).alias("_ring_n"))
    earlier = Window.partitionBy("_ring_arc").orderBy("_ring_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_ring_arc", "_ring_cell", F.coalesce(F.sum("_ring_n").over(earlier), F.lit(0)).alias("_ring_offset"))
    ranked = ordered.join(offsets, ["_ring_arc", "_ring_cell"]).join(by_arc.select("_ring_arc", "_ring_first", "_ring_runs"), "_ring_arc")
    rank = F.col("_ring_first") + F.col("_ring_offset") + F.col("_ring_row") - 1
    run = F.element_at(F.filter("_ring_runs", lambda r: r["start"] <= F.col("_ring_rank")), -1)
    out = ranked.withColumn("_ring_rank", rank).withColumn("_ring_at", run)
    return out.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(own)], F.col("_ring_at.shard").alias("shard"), (F.col("_ring_at.slot") + F.col("_ring_rank") - F.col("_ring_at.start")).alias("slot"))
