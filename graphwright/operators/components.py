"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.plans.checkpoints import cut

#: Rounds after which the contraction is taken to be broken; it needs about log2 of the longest path.
MAX_ROUNDS = 60


#: Edges of a task that are folded at once.
EDGES_AT_ONCE = 2_000_000


def folded(edges: DataFrame) -> DataFrame:
    """edges(u string, v string, views array<long>) -> (view, u, v): fewer edges with the same components in each view.

    Each task links the nodes of a piece of its edges to one node of their component there, itself
    included, so a loop stays one. Nothing is shuffled, and no more than a piece is held.
    """
    return edges.select("u", "v", "views").mapInArrow(_folded, "view long, u string, v string")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= EDGES_AT_ONCE:
            yield from _stars(pa.Table.from_batches(held))
            held = []
    if held:
        yield from _stars(pa.Table.from_batches(held))


def _stars(edges: pa.Table) -> Iterator[pa.RecordBatch]:
    """Each node of a view with the first node of its component in that view."""
    coded = pa.chunked_array([*edges["u"].chunks, *edges["v"].chunks], pa.string()).combine_chunks().dictionary_encode()
    code, rows = coded.indices.to_numpy(), edges.num_rows
    views = edges["views"].combine_chunks()
    owner, view = pc.list_parent_indices(views).to_numpy(), pc.list_flatten(views).to_numpy()
    for one in np.unique(view):
        mine = owner[view == one]
        nodes, ends = np.unique(np.concatenate([code[:rows][mine], code[rows:][mine]]), return_inverse=True)
        u, v = ends[: len(mine)], ends[len(mine) :]
        first = np.arange(len(nodes))
        while len(u):
            # the greater of two firsts is hooked to the smaller one, then all look up their first's first
            a, b = first[u], first[v]
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(first, np.maximum(a, b), np.minimum(a, b))
            while (first[first] != first).any():
                first = first[first]
        table = pa.table({"view": pa.array(np.full(len(nodes), one)), "u": coded.dictionary.take(pa.array(nodes)), "v": coded.dictionary.take(pa.array(nodes[first]))})
        yield from table.to_batches(max_chunksize=10_000)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of one orderable type -> (node, component): each node that has an edge, with the smallest node it reaches.

    Loops and repeated edges are allowed; an empty edge table gives an empty result. Every round
    shuffles the edges a few times and is written to the checkpoint folder; nothing but a count and
    a checksum comes to the driver. Minima are taken before the shuffle, so a node with very many
    edges sends one row from each task.
    """
    now = cut(edges.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if mark == seen:
            break
        seen = mark
        now = cut(_small_star(_large_star(now)))
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    # settled: stars around the smallest node of each component
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
