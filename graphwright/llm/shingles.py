"""Near-duplicates by the Jaccard similarity of sets of word shingles: SimHash proposes, sets decide.

SimHash fingerprints of the sets are searched by the generalised pigeonhole principle (simhash.py).
It proposes one partner within a small radius for each text, and each proposal is verified on the
whole sets. Most copies are linked by this. No radius finds all pairs of a similarity of 0.8: of 64
bits about 10 differ on average and up to 20 may, and that far apart are very many unlike texts too.
So what fingerprints leave apart is searched by a prefix filter, which misses no pair. Let all
shingles have one global order. Of two sets of a similarity of s or more, each has at most
n - ceil(s n) shingles that the other lacks, so their first n - ceil(s n) + 1 shingles have one in
common. The first that they share also bounds the overlap: neither set can share more than it has
from there on. Pairs that pass the bound are verified on their whole sets, too.

Most shingles stand in one text only. A bitmap of fixed size keeps those from the shuffle; what
passes it by chance is dropped by the join. Whole sets are shuffled once for a verification: pairs
of one neighbourhood go to one cell, a large one being cut into several, and so do their sets.

The order puts shingles last that are common in a part of the texts. It decides how many candidates
there are, never what is found.

A dense group has as many pairs as the square of its size. So each shingle's texts are first
compared with one of them only, the one with the fewest shingles before it, which has least of its
own; then pairs are looked for among texts that aren't in one component yet. Pairs inside a
component can't change the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.llm.decontaminate import content_hash, in_bitmap, window_bitmap
from graphwright.llm.simhash import bit_counts, majority, near_links, node_name
from graphwright.llm.words import slices, spread_join, unused
from graphwright.operators.components import connected_components
from graphwright.plans.checkpoints import cut

#: Jaccard similarity from which two texts are near-duplicates.
SIMILARITY = Fraction(4, 5)
#: One of so many texts is counted for the order of the shingles.
COUNTED = 16
#: Counted texts from which a shingle is common, and the number of common ones that are told apart, 3 MB.
COMMON, COMMON_SHINGLES = 3, 200_000
#: Shingles that are hashed at once.
SHINGLE_BLOCK = 1 << 16
#: Rows that name texts are broadcast up to this number, about 30 MB.
BROADCAST_ROWS = 300_000
#: Shared shingles of each text by which a first partner is looked for.
STAR_KEYS = 3
#: Texts whose pairs are verified in one cell, about.
CELL_TEXTS = 256
#: Bits of 64 in which a proposed partner's fingerprint may differ.
RADIUS = 4


def shingle_set(text: str | None, words_in_shingle: int) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles.

    A-Z are lower-cased; words are runs without ASCII white space; fewer words than a shingle has
    are one shingle; a text without words has none.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    if n < words_in_shingle:
        starts, ends = np.zeros(1, np.int64), np.array([len(joined)])
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: n - words_in_shingle + 1]
        ends = ends[words_in_shingle - 1 :]
    digest, parts = xxhash.xxh64_digest, []
    for at in range(0, len(starts), SHINGLE_BLOCK):
        pairs = zip(starts[at : at + SHINGLE_BLOCK].tolist(), ends[at : at + SHINGLE_BLOCK].tolist(), strict=True)
        parts.append(np.unique(np.frombuffer(b"".join([digest(joined[a:b]) for a, b in pairs]), np.int64)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles; 0 of an empty one."""
    print_of = majority(bit_counts(hashes.view(np.uint8)), len(hashes)) if len(hashes) else 0
    return print_of - (1 << 64) if print_of >> 63 else print_of


def set_name(hashes: np.ndarray) -> int:
    """64 bits that name a set of shingles."""
    name = xxhash.xxh3_64_intdigest(hashes.tobytes(), 7)
    return name - (1 << 64) if name >> 63 else name


def short_hashes(hashes: np.ndarray) -> bytes:
    """The lower 40 bits of each hash of a set, which tell the shingles of two texts apart."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def long_hashes(data: bytes) -> np.ndarray:
    """The numbers that short_hashes has written, sorted."""
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return np.sort(out.view(np.int64).ravel())


def least_overlap(n: int, similarity: Fraction) -> int:
    """Shingles of a set of n that a near-duplicate must hold."""
    return -(-similarity.numerator * n // similarity.denominator)


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: Fraction) -> np.ndarray:
    """The first shingles of a set; common (sorted) ones come last, by rank."""
    n = len(hashes)
    if not n:
        return hashes
    order = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        order = np.where(common[at] == hashes, rank[at], 0)
    return hashes[np.argsort(order, kind="stable")[: n - least_overlap(n, similarity) + 1]]


def common_shingles(texts: DataFrame, words_in_shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, ranks from 1 up by how common they are) of at most COMMON_SHINGLES."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, words_in_shingle) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], names=["shingle"])

    part = texts.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(COUNTED)) == 0).distinct()
    counts = part.mapInArrow(listed, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON)
    rows = counts.orderBy(F.desc("n"), "shingle").limit(COMMON_SHINGLES).toArrow()
    hashes = rows.column("shingle").to_numpy().astype(np.int64)
    rank = np.arange(len(hashes), 0, -1)
    order = np.argsort(hashes)
    return hashes[order], rank[order]


def named_sets(texts: DataFrame, words_in_shingle: int, similarity: Fraction) -> DataFrame:
    """(doc_id, content, text) -> (doc_id, content, node, fp_0, size, prefix); node names the set.

    The prefix is null where a task has given it for the same set before.
    """
    common, rank = common_shingles(texts, words_in_shingle)
    shared = texts.sparkSession.sparkContext.broadcast((common, rank))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            sets = [shingle_set(t, words_in_shingle) for t in batch.column(2).to_pylist()]
            names = [set_name(s) for s in sets]
            first = []
            for name, hashes in zip(names, sets, strict=True):
                first.append(None if name in seen else prefix(hashes, *shared.value, similarity))
                seen.add(name)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(names, pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array(first, pa.list_(pa.int64())),
                ],
                names=["doc_id", "content", "node", "fp_0", "size", "prefix"],
            )

    return texts.select("doc_id", "content", "text").mapInArrow(named, "doc_id long, content long, node long, fp_0 long, size long, prefix array<long>")


def listed_keys(rows: DataFrame, bitmap: np.ndarray | None, first: int | None = None) -> DataFrame:
    """(node, size, prefix, part) -> (shingle, node, size, at, part): the prefixes' shingles that the bitmap holds, all or the first."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prefixes = batch.column(2)
            sizes = np.diff(prefixes.offsets.to_numpy())
            hashes = prefixes.flatten().to_numpy()
            at = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            row = np.repeat(np.arange(len(sizes)), sizes)
            keep = np.arange(len(hashes)) if bitmap is None else np.flatnonzero(in_bitmap(bitmap, hashes.view(np.uint64)))
            if first is not None and len(keep):
                starts = np.searchsorted(row[keep], row[keep])
                keep = keep[np.arange(len(keep)) - starts < first]
            taken = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[keep]), batch.column(0).take(taken), batch.column(1).take(taken), pa.array(at[keep].astype(np.int32)), batch.column(3).take(taken)],
                names=["shingle", "node", "size", "at", "part"],
            )

    return rows.select("node", "size", "prefix", "part").mapInArrow(listed, "shingle long, node long, size int, at int, part long")


def of_several(keys: DataFrame) -> np.ndarray:
    """The bitmap of the shingles that stand in several parts."""
    ends = keys.groupBy("shingle").agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least < most")
    return window_bitmap(ends.select(F.col("shingle").alias("hash")))


def bounded(rows: DataFrame) -> DataFrame:
    """rows, broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def enough(overlap: Column, similarity: Fraction) -> Column:
    """Whether an overlap makes sets of size_u and size_v similar; whole numbers only."""
    up, down = similarity.numerator, similarity.denominator
    return overlap * (up + down) >= up * (F.col("size_u") + F.col("size_v"))


def celled(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (cell, u, v): pairs of one neighbourhood together, of about CELL_TEXTS texts in a cell at most.

    A node's label is the least node that it has a pair with, itself included, and a pair's the less
    of its two: stars and cliques have one. What is larger is cut by hashes of both nodes.
    """
    ends = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(ends.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")))
    labels = [least.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in ("u", "v")]
    placed = cut(pairs.select("u", "v").join(labels[0], "u").join(labels[1], "v").select("u", "v", F.least("label_u", "label_v").alias("label")))
    sizes = cut(placed.groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), (F.approx_count_distinct("u") + F.approx_count_distinct("v")).alias("texts")))
    parts = F.ceil(F.col("texts") / CELL_TEXTS)
    cell = F.xxhash64("label", F.pmod(F.xxhash64("u"), parts), F.pmod(F.xxhash64("v"), parts))
    return spread_join(placed, sizes, ["label"], "pairs").select(cell.alias("cell"), "u", "v")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words_in_shingle: int, similarity: Fraction) -> DataFrame:
    """(u, v) of those pairs(u, v, size_u, size_v) whose sets are similar.

    Whole sets are made again, for texts of pairs that can be similar by their sizes.
    """
    cells = cut(celled(cut(pairs.filter(enough(F.least("size_u", "size_v"), similarity)).select("u", "v").distinct())))
    wanted = cells.select("cell", F.col("u").alias("node")).unionByName(cells.select("cell", F.col("v").alias("node"))).groupBy("node").agg(F.collect_set("cell").alias("cells"))
    wanted = cut(nodes.join(wanted, "node").select("node", "cells", F.col("first.id").alias("_d"), F.col("first.content").alias("_c")))
    found = texts.join(bounded(wanted), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("content") == F.col("_c"))).select("node", "cells", "text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal rows of one id give the same set
        for batch in slices(batches):
            out = []
            for node, cells_of, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node not in seen:
                    seen.add(node)
                    hashes = short_hashes(shingle_set(t, words_in_shingle))
                    out += [(cell, node, hashes) for cell in cells_of]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], names=["cell", "node", "hashes"])

    up, down = similarity.numerator, similarity.denominator

    def compared(pairs_of: pa.Table, sets_of: pa.Table) -> pa.Table:
        sets = {node: long_hashes(data) for node, data in zip(sets_of.column("node").to_pylist(), sets_of.column("hashes").to_pylist(), strict=True)}
        keep = []
        for u, v in zip(pairs_of.column("u").to_pylist(), pairs_of.column("v").to_pylist(), strict=True):
            a, b = sets[u], sets[v]
            if len(np.intersect1d(a, b, assume_unique=True)) * (up + down) >= up * (len(a) + len(b)):
                keep.append((u, v))
        return pa.table({c: pa.array([k[i] for k in keep], pa.int64()) for i, c in enumerate(("u", "v"))})

    sets = found.mapInArrow(whole, "cell long, node long, hashes binary")
    return cut(cells.groupBy("cell").cogroup(sets.groupBy("cell")).applyInArrow(compared, "u long, v long"))


def proposals(nodes: DataFrame) -> DataFrame:
    """(u, v, size_u, size_v): for each node one with its fingerprint, and for each fingerprint one within RADIUS, if there are any."""
    prints = cut(nodes.groupBy("fp_0").agg(F.min(F.struct("node", "size")).alias("rep"), F.count(F.lit(1)).alias("members")))
    same = spread_join(nodes.select("fp_0", "node", "size"), prints, ["fp_0"], "members").filter("node <> rep.node")
    same = same.select(F.col("node").alias("u"), F.col("rep.node").alias("v"), F.col("size").alias("size_u"), F.col("rep.size").alias("size_v"))
    named = [prints.select(node_name(["fp_0"]).alias(c), F.col("rep.node").alias(f"node_{c}"), F.col("rep.size").alias(f"size_{c}")) for c in ("u", "near")]
    near = near_links(prints.select("fp_0"), 1, RADIUS).filter("near is not null").select("u", "near").distinct()
    near = near.join(named[0], "u").join(named[1], "near")
    return same.unionByName(near.select(F.col("node_u").alias("u"), F.col("node_near").alias("v"), "size_u", F.col("size_near").alias("size_v")))


def shingle_groups(
    docs: DataFrame,
    *,
    words_in_shingle: int = 5,
    similarity: Fraction = SIMILARITY,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, content, component_id, group_name, first) for each row of docs.

    Rows are linked if the Jaccard similarity of their sets of shingles is similarity or more, and a
    group is what links connect; texts without words are linked with each other. content is a hash
    of the text, component_id the smallest doc_id of the row's group; group_name is the group's own,
    whatever ids repeat. first (no_id, id, content) is the group's first row: rows with an id come
    before those without. Equal sets meet before any search, so copies cost one row. A null text
    counts as empty. An empty table gives an empty result.
    """
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), content_hash(text).alias("content"))
    each = cut(named_sets(texts, words_in_shingle, similarity))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "content")
    nodes = cut(each.groupBy("node").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("rows"), *[F.min(c).alias(c) for c in ("fp_0", "size")]))
    prefixes = each.filter("prefix is not null").select("node", F.col("size").cast("int").alias("size"), "prefix")
    alone = prefixes.withColumn("part", F.col("node"))
    counts = listed_keys(alone, None).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    shared = window_bitmap(counts.filter("n > 1").select(F.col("shingle").alias("hash")))

    # what fingerprints propose, and for the first shared shingles of each text one other text
    keys = cut(listed_keys(alone, shared, STAR_KEYS))
    pivots = keys.groupBy("shingle").agg(F.min(F.struct("at", "node", "size")).alias("pivot"))
    stars = keys.join(pivots, "shingle").filter("node <> pivot.node").select(F.col("node").alias("u"), F.col("pivot.node").alias("v"), F.col("size").alias("size_u"), F.col("pivot.size").alias("size_v"))
    links = verified(proposals(nodes).unionByName(stars), nodes, texts, words_in_shingle, similarity)

    # all pairs of different components
    parts = cut(connected_components(links).withColumnRenamed("component", "part"))
    apart = prefixes.join(bounded(parts), "node", "left").withColumn("part", F.coalesce("part", "node"))
    mixed = of_several(listed_keys(apart, shared))
    # several tasks may have given the prefix of a set that has copies
    copied = bounded(nodes.filter("rows > 1").select("node"))
    keys = listed_keys(apart.join(copied, "node", "left_anti"), mixed).unionByName(listed_keys(apart.join(copied, "node", "left_semi"), mixed).distinct())
    u, v = keys.alias("u"), keys.alias("v")
    # of a similar pair the first shared shingle leaves both enough
    room = F.least(F.col("u.size") - F.col("u.at"), F.col("v.size") - F.col("v.at"))
    up, down = similarity.numerator, similarity.denominator
    fits = (F.col("u.node") < F.col("v.node")) & (F.col("u.part") != F.col("v.part")) & (room * (up + down) >= up * (F.col("u.size") + F.col("v.size")))
    pairs = u.join(v, (F.col("u.shingle") == F.col("v.shingle")) & fits).select(F.col("u.node").alias("u"), F.col("v.node").alias("v"), F.col("u.size").alias("size_u"), F.col("v.size").alias("size_v"))
    links = links.unionByName(verified(pairs, nodes, texts, words_in_shingle, similarity))

    groups = nodes.select("node", "first", "rows").join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = cut(groups)
    ids = F.when(~F.col("first.no_id"), F.col("first.id"))
    least = cut(groups.groupBy("component").agg(F.min("first").alias("first"), F.min(ids).alias("component_id"), F.count(F.lit(1)).alias("members")))
    labels = cut(spread_join(groups.drop("first"), least, ["component"], "members").select("node", "rows", "first", "component_id", F.col("component").alias("group_name")))
    return spread_join(each.select("doc_id", "content", "node"), labels, ["node"], "rows").select("doc_id", "content", "component_id", "group_name", "first")


def one_of_each_group(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """docs without near-duplicates: of each group (see shingle_groups) the row with the smallest id stays, whole.

    Rows without an id come after all others; of rows with one id that with the smallest hash of its
    text stays, and of rows that agree in both the one whose columns have the smallest hash. Columns
    of any name are kept as they are. An empty table stays empty; texts without words, null ones
    among them, are one group. The rows that stay are told by slim rows of id and hash, which are
    broadcast only if counted to be at most BROADCAST_ROWS.
    """
    name_id, name_content = unused("kept_id", docs), unused("kept_content", docs)
    groups = shingle_groups(docs, key=key, text=text, **options)
    judged = groups.groupBy("doc_id", "content").agg(F.count(F.lit(1)).alias("copies"), F.min((F.col("first.id").eqNullSafe(F.col("doc_id")) & (F.col("first.content") == F.col("content"))).cast("int")).alias("stays"))
    judged = cut(judged.select(F.col("doc_id").alias(name_id), F.col("content").alias(name_content), "copies", "stays"))
    gone = judged.filter("stays = 0").select(name_id, name_content)
    twice = judged.filter("stays = 1 and copies > 1").select(name_id, name_content)
    same = F.col(key).cast("long").eqNullSafe(F.col(name_id)) & (content_hash(text) == F.col(name_content))
    kept = docs.join(bounded(gone), same, "left_anti")
    if twice.isEmpty():
        return kept
    columns = [F.col(f"`{c}`") for c in docs.columns]
    repeated = kept.join(bounded(twice), same, "left_semi").select(F.col(key).cast("long").alias("k"), content_hash(text).alias("c"), F.struct(*columns).alias("row"))
    single = repeated.groupBy("k", "c").agg(F.min_by("row", F.struct(F.xxhash64(F.to_json("row")), F.to_json("row"))).alias("row")).select("row.*")
    return kept.join(bounded(twice), same, "left_anti").unionByName(single)
