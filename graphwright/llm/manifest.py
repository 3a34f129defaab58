"""A Merkle manifest of a dataset: a hash tree for each group of rows, and one over the groups' roots.

Leaves are numbered along their order in each tree. An aligned block of 2 ** levels nodes is one row
that keeps each level as one text of hashes, 64 digits each: fixed-width substrings of a level hash
to the level above it, and the substring that flanks a node is its sibling. The hashes left of all
blocks are the nodes of the next, far smaller, round, until each tree has one block.

Rows move twice, by range of the order and by block, as hashes and without their texts. A tree may
hold any share of all rows: ranges and blocks cut through it. Equal rows are told apart by their
place in the input only, so they may fall in different ranges. Rows come out with what came in
beside the leaf; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.llm.words import spread_join
from graphwright.plans.checkpoints import cut

#: Levels of a block; it has two to this power nodes.
LEVELS = 9
#: Digits of a hash.
DIGITS = 64


def encoded(*fields: Column) -> Column:
    """The fields as one text: - for null, else the bytes of its UTF-8 text, a colon, and the text."""
    texts = [f.cast("string") for f in fields]
    return F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def hashed(text: Column) -> Column:
    """SHA-256 in lower-case hex."""
    return F.sha2(text, 256)


def tree_key(name: Column) -> Column:
    """A text that is never null and sorts as the name does by its bytes, null first."""
    return F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name.cast("string")))


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows(tree, ..) with index, the place in the tree from 0, and size, the tree's nodes; and the largest size.

    Rows with equal order columns must be equal in all that counts; which of them comes first is open.
    """
    ranged = rows.repartitionByRange("tree", *order, F.monotonically_increasing_id()).sortWithinPartitions("tree", *order)
    ranged = cut(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    # a tree has one piece in each partition that it reaches
    pieces = ranged.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = cut(pieces.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("size")))
    largest = pieces.agg(F.max("size")).first()[0] or 0
    placed = ranged.join(pieces, ["tree", "_part"])
    return placed.withColumn("index", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift"), largest


def _above(level: Column) -> Column:
    """The level over one: each two hashes, or a last one, as their hash."""
    last = F.floor((F.octet_length(level) - 1) / (2 * DIGITS)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), last), lambda i: hashed(F.substring(level, i * 2 * DIGITS + 1, F.lit(2 * DIGITS))))
    return F.array_join(pairs, "").cast("binary")


def _flank(level: Column, at: Column) -> Column:
    """The sibling of the node at a place of its level, after < if it stands left, > if right; empty if there is none."""
    other = at.bitwiseXOR(F.lit(1).cast("long"))
    found = F.substring(level, (other * DIGITS + 1).cast("int"), F.lit(DIGITS)).cast("string")
    return F.when(found == "", "").otherwise(F.concat(F.when(at % 2 == 1, "<").otherwise(">"), found))


def blocks_of(nodes: DataFrame, largest: int, levels: int = LEVELS) -> DataFrame:
    """(tree, size, nodes, kept, path, root): blocks of nodes(tree, index, size, hash, ..).

    kept has the block's levels, lowest first; path leads from the block's top on to root, the root of its tree.
    """
    width = 1 << levels
    here = [c for c in nodes.columns if c not in ("tree", "size", "index")]
    block = F.shiftright("index", levels)
    rows = nodes.groupBy("tree", "size", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("index", *here))).alias("nodes"))
    height = F.when(F.col("size") > width, levels).when(F.col("size") <= 1, 0).otherwise(F.length(F.bin(F.col("size") - 1)))
    steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    lowest = F.array_join(F.transform("nodes", lambda n: n["hash"]), "").cast("binary")
    kept = F.aggregate(steps, F.array(lowest), lambda done, _: F.array_append(done, _above(F.element_at(done, -1))))
    rows = cut(rows.withColumn("kept", kept))
    top = F.element_at("kept", -1).cast("string")
    if largest <= width:
        return rows.select("tree", "size", "block", "nodes", "kept", F.array().cast("array<string>").alias("path"), top.alias("root"))
    tops = rows.filter(F.col("size") > width).select("tree", F.col("block").alias("index"), F.ceil(F.col("size") / width).alias("size"), top.alias("hash"))
    upper = with_paths(blocks_of(tops, -(-largest // width), levels)).select("tree", F.col("index").alias("block"), "path", "root")
    return rows.join(upper, ["tree", "block"], "left").select(
        "tree", "size", "block", "nodes", "kept",
        F.coalesce("path", F.array().cast("array<string>")).alias("path"), F.coalesce("root", top).alias("root"),
    )


def with_paths(blocks: DataFrame, *more: str) -> DataFrame:
    """(tree, index, hash, .., path, root, *more): each node of the blocks with its way to the root."""

    def way(node: Column) -> Column:
        # a block's first node is even at every level below the top, so places inside keep their parity
        inside = node["index"] - F.element_at("nodes", 1)["index"]
        lower = F.slice("kept", F.lit(1), F.size("kept") - 1)
        return F.concat(F.transform(lower, lambda level, up: _flank(level, F.call_function("shiftright", inside, up))), F.col("path"))

    nodes = F.transform("nodes", lambda n: F.struct(n.alias("node"), way(n).alias("path")))
    return blocks.select("tree", "root", *more, F.explode(nodes).alias("_n")).select("tree", "_n.node.*", "_n.path", "root", *more)


def build_manifest(rows: DataFrame, tree: Column, order: list[Column], leaf: Column, keep: list[Column], levels: int = LEVELS) -> DataFrame:
    """keep, leaf, subroot, root, path: each row's leaf in the tree of its group, and its way to the root of all.

    tree: the group's name, any value or null. Leaves ascend by order, nulls first, and by their hash
    where that ties; subroots by the group's name, null first. path has one text for each level up to
    the root: the sibling after < (left) or > (right), empty where a node is alone. Kept columns must
    be comparable (no maps).
    """
    by = [f"o{i}" for i in range(len(order))]
    leaves = rows.select(tree_key(tree).alias("tree"), *[o.alias(n) for o, n in zip(order, by, strict=True)], leaf.alias("hash"), F.struct(*keep).alias("row"))
    nodes, largest = numbered(leaves, [*by, "hash"])
    trees = blocks_of(nodes.drop(*by), largest, levels)
    subroots = trees.filter("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("hash"), F.col("size").alias("leaves"))
    tops, groups = numbered(subroots, ["name"])
    labels = cut(
        with_paths(blocks_of(tops, groups, levels)).select(F.col("name").alias("tree"), "leaves", F.col("path").alias("_upper"), F.col("root").alias("_root"))
    )
    placed = with_paths(spread_join(trees, labels, ["tree"], "leaves"), "_upper", "_root")
    return placed.select("row.*", F.col("hash").alias("leaf"), F.col("root").alias("subroot"), F.col("_root").alias("root"), F.concat("path", "_upper").alias("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    sibling = lambda step: F.substring(step, 2, DIGITS)
    return F.aggregate(
        path,
        leaf,
        lambda node, step: F.when(step.startswith("<"), hashed(F.concat(sibling(step), node)))
        .when(step.startswith(">"), hashed(F.concat(node, sibling(step))))
        .otherwise(hashed(node)),
    )


def proof_hash(path: Column) -> Column:
    """The hash of all siblings on a path, from the leaf up."""
    return hashed(F.array_join(F.transform(path, lambda step: F.substring(step, 2, DIGITS)), ""))
