"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are linked if at most t of their B bits differ. The bits are put into partitions of
correlated bits, and partition i gets a threshold t_i (-1: not used). If the thresholds add up to
t - (partitions) + 1, two fingerprints within t bits are within t_i in at least one partition: else
they would differ in t_i + 1 bits or more of each, t + 1 in all. Unequal thresholds are given by
dynamic programming on the candidates that each choice is estimated to bring. Each partition's
index is then probed within its threshold, and candidates are verified on all bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.llm.words import slices, spread_join
from graphwright.operators.components import connected_components
from graphwright.plans.checkpoints import cut

#: Fingerprints that one cell of a partition's index holds, about.
CELL_FINGERPRINTS = 1 << 16
#: Candidate pairs that are verified at once.
PAIR_BLOCK = 1 << 18
#: Shingles that are hashed at once.
SHINGLE_BLOCK = 1 << 16
#: Cost of one row sent to a cell, in verified pairs.
ROW_COST = 200

_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


# ---------------------------------------------------------------------------- fingerprints


def simhash(text: str | None, words_in_shingle: int, seeds: tuple[int, ...] = (42,)) -> tuple[int, ...]:
    """One 64-bit fingerprint for each seed.

    A-Z are lower-cased; words are runs without ASCII white space; shingles are so many words with
    single spaces, repeats included (fewer words: all of them; none: fingerprint zero). Bit j is 1
    if it is set in over half of the shingles' XXH64.
    """
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return (0,) * len(seeds)
    joined = b" ".join(words)
    if n < words_in_shingle:
        starts, ends = np.zeros(1, np.int64), np.array([len(joined)])
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: n - words_in_shingle + 1]
        ends = ends[words_in_shingle - 1 :]
    digest, prints = xxhash.xxh64_digest, []
    for seed in seeds:
        ones = np.zeros(64, np.int64)
        for at in range(0, len(starts), SHINGLE_BLOCK):
            pairs = zip(starts[at : at + SHINGLE_BLOCK].tolist(), ends[at : at + SHINGLE_BLOCK].tolist(), strict=True)
            ones += bit_counts(np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in pairs]), np.uint8))
        prints.append(majority(ones, len(starts)))
    return tuple(prints)


def bit_counts(digests: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set in digests of 8 bytes, the highest bit of the first byte first."""
    digests = digests.reshape(-1, 8)
    return np.concatenate([np.bincount(digests[:, byte], minlength=256) @ _BITS for byte in range(8)])


def majority(ones: np.ndarray, n: int) -> int:
    """The bits that are set in over half of n hashes."""
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words_in_shingle: int, seeds: tuple[int, ...], *, key: str, text: str) -> DataFrame:
    """(doc_id long, content long, fp_0 .. long): fingerprints as signed longs, one column for each seed.

    content is a hash of the text, by which rows that share an id are told apart.
    """
    names = [f"fp_{i}" for i in range(len(seeds))]

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = np.array([simhash(t, words_in_shingle, seeds) for t in batch.column(1).to_pylist()], np.uint64).reshape(-1, len(seeds))
            columns = [pa.array(rows[:, i].copy().view(np.int64)) for i in range(len(seeds))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["doc_id", "content", *names])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), content_hash(text).alias("content"))
    return slim.mapInArrow(printed, ", ".join(["doc_id long", "content long", *(f"{n} long" for n in names)]))


def content_hash(text: str) -> Column:
    """64 bits that tell the texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


# ---------------------------------------------------------------------------- the plan


@dataclass
class Partition:
    """Bits of one partition and the number of them in which a candidate may differ."""

    bits: list[int]
    threshold: int


def bit_statistics(prints: DataFrame, words: int) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, how often both are 1; over all of them."""
    columns, bits = [f"fp_{i}" for i in range(words)], 64 * words

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((bits, bits))
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                ones = unpacked(matrix(batch.slice(at, 1 << 14), columns)).astype(np.float32)
                total += ones.T @ ones
                n += len(ones)
        cells = [-1, *range(bits * bits)]
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array([n, *total.ravel().astype(np.int64).tolist()], pa.int64())], names=["cell", "ones"])

    rows = prints.select(*columns).mapInArrow(summed, "cell int, ones long").groupBy("cell").agg(F.sum("ones").alias("ones")).collect()
    both = np.zeros(bits * bits + 1, np.int64)
    for row in rows:  # bits * bits + 1 rows
        both[row["cell"]] = row["ones"]
    return int(both[-1]), both[:-1].reshape(bits, bits)


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The bits in so many groups of about one size, correlated bits together."""
    bits = len(both)
    mean = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    related = np.abs((both / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    free, groups = set(range(bits)), []
    for part in range(parts):
        size = bits // parts + (part < bits % parts)
        rest = sorted(free)
        group = [rest[int(related[np.ix_(rest, rest)].max(1).argmax())]]
        free.discard(group[0])
        while len(group) < size:
            rest = sorted(free)
            group.append(rest[int(related[np.ix_(rest, group)].mean(1).argmax())])
            free.discard(group[-1])
        groups.append(group)
    return groups


def estimated_share(both: np.ndarray, n: int, bits: list[int], radius: int) -> float:
    """Share of all pairs that differ in at most radius of these bits, by how often each bit agrees."""
    mean = np.diag(both)[bits] / max(n, 1)
    differ = 2 * mean * (1 - mean)
    ways = np.zeros(radius + 1)
    ways[0] = 1
    for d in differ:
        ways[1:] = ways[1:] * (1 - d) + ways[:-1] * d
        ways[0] *= 1 - d
    return float(ways.sum())


def plan_partitions(both: np.ndarray, n: int, radius: int, parts: range) -> list[Partition]:
    """The cheapest partitions and thresholds whose candidates miss no pair within radius."""
    best: tuple[float, list[Partition]] | None = None
    for count in parts:
        groups = group_bits(both, n, count)
        limit = max(0, min(radius - count + 1, 3))
        # cost of the first groups with thresholds that add up to a sum; sums start at -count
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            prices = {-1: 0.0}
            for t in range(limit + 1):
                cells = index_split(n, len(group))
                rows = sum(comb(cells, i) for i in range(t + 1)) / 2 + 0.5
                # also what it takes to look for the neighbours of each key
                probes = sum(comb(len(group) - cells, i) for i in range(t + 1)) * min(n, 2.0 ** len(group))
                prices[t] = n * rows * ROW_COST + probes * 5 + n * n / 2 * estimated_share(both, n, group, t)
            wider: dict[int, tuple[float, list[int]]] = {}
            for total, (cost, chosen) in table.items():
                for t, price in prices.items():
                    if total + t not in wider or cost + price < wider[total + t][0]:
                        wider[total + t] = (cost + price, [*chosen, t])
            table = wider
        needed = radius - count + 1
        if needed in table and (best is None or table[needed][0] < best[0]):
            best = (table[needed][0], [Partition(g, t) for g, t in zip(groups, table[needed][1], strict=True) if t >= 0])
    if best is None:
        raise ValueError(f"no number of partitions in {parts} serves a radius of {radius}")
    return best[1]


def index_split(n: int, bits: int) -> int:
    """Bits of a key that name the cell of the index; the others are searched inside the cell."""
    return min(bits, max(0, int(np.ceil(np.log2(max(n, 1) / CELL_FINGERPRINTS)))))


# ---------------------------------------------------------------------------- probing


def matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Fingerprint columns of a batch as rows of unsigned words."""
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], 1).view(np.uint64)


def unpacked(prints: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1, the highest bit of the first word first."""
    return np.unpackbits(np.ascontiguousarray(prints.byteswap()).view(np.uint8).reshape(len(prints), -1), axis=1)


def keys_of(ones: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of a partition as one number, its first bit highest."""
    out = np.zeros(len(ones), np.uint64)
    for bit in bits:
        out = (out << np.uint64(1)) | ones[:, bit]
    return out


def flips(bits: int, radius: int) -> list[int]:
    """All masks of at most radius ones among so many bits."""
    return [sum(1 << b for b in chosen) for r in range(min(radius, bits) + 1) for chosen in combinations(range(bits), r)]


class Forest:
    """Components among the rows of one cell; keeps labels and one partner of each row, never pairs."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.partner = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the components of a[i] and b[i]; labels are the smallest rows, and so are partners of those linked."""
        np.minimum.at(self.partner, np.maximum(a, b), np.minimum(a, b))
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def link_runs(forest: Forest, words: list[np.ndarray], radius: int, left: np.ndarray, left_keys: np.ndarray, right: np.ndarray, right_keys: np.ndarray, mask: int, ordered: bool) -> None:
    """Verifies rows of left against rows of right whose keys differ by exactly mask.

    Both are sorted by key. ordered: left and right are the same rows, and each pair is wanted once.
    """
    lk, ls, lc = np.unique(left_keys, return_index=True, return_counts=True)
    rk, rs, rc = np.unique(right_keys, return_index=True, return_counts=True)
    target = lk ^ np.uint64(mask)
    at = np.searchsorted(rk, target)
    at[at == len(rk)] = 0
    hit = rk[at] == target if len(rk) else np.zeros(len(lk), bool)
    if ordered:
        hit &= lk <= target
    ls, lc, rs, rc = ls[hit], lc[hit], rs[at[hit]], rc[at[hit]]
    # each row of left with its run of right, in blocks of bounded size
    rows = np.repeat(ls - np.concatenate([[0], np.cumsum(lc)[:-1]]).astype(np.int64), lc) + np.arange(lc.sum())
    first, width = np.repeat(rs, lc), np.repeat(rc, lc)
    if ordered and mask == 0:
        width = first + width - rows - 1
        first = rows + 1
    ends = np.cumsum(width)
    at_row = 0
    while at_row < len(rows):
        base = ends[at_row - 1] if at_row else 0
        stop = max(at_row + 1, int(np.searchsorted(ends, base + PAIR_BLOCK, side="right")))
        w = width[at_row:stop]
        a = np.repeat(rows[at_row:stop], w)
        b = np.repeat(first[at_row:stop] - np.concatenate([[0], np.cumsum(w)[:-1]]).astype(np.int64), w) + np.arange(w.sum())
        a, b = left[a], right[b]
        apart = np.zeros(len(a), np.uint16)
        for word in words:
            apart += np.bitwise_count(word[a] ^ word[b])
        near = apart <= radius
        forest.link(a[near], b[near])
        at_row = stop


def cell_links(cell: pa.Table, names: list[str], radius: int, low_bits: dict[int, list[int]]) -> pa.Table:
    """Links of one cell: rows at home against each other, and visitors against rows at home.

    Returns (u, v, near), fingerprints in hex: each row of a component but its first, with the first
    and with the first row that it is linked to itself, which may be missing.
    """
    prints = np.stack([cell.column(c).to_numpy() for c in names], 1).view(np.uint64)
    part = cell.column("part")[0].as_py()
    keys = keys_of(unpacked(prints), low_bits[part])
    reach, sides = cell.column("reach").to_numpy(), cell.column("side").to_numpy()
    forest, words = Forest(len(prints)), [np.ascontiguousarray(prints[:, i]) for i in range(len(names))]

    def run(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(chosen)
        rows = rows[np.argsort(keys[rows], kind="stable")]
        return rows, keys[rows]

    home, home_keys = run(sides == 0)
    if len(home) and reach[home[0]] >= 0:
        for mask in flips(len(low_bits[part]), int(reach[home[0]])):
            link_runs(forest, words, radius, home, home_keys, home, home_keys, mask, ordered=True)
    for r in np.unique(reach[sides == 1]):
        guests, guest_keys = run((sides == 1) & (reach == r))
        for mask in flips(len(low_bits[part]), int(r)):
            link_runs(forest, words, radius, guests, guest_keys, home, home_keys, mask, ordered=False)
    linked = np.flatnonzero(forest.root != np.arange(len(prints)))
    named = lambda rows: ["".join(f"{word:016X}" for word in row) for row in prints[rows].tolist()]
    near = [name if other else None for name, other in zip(named(forest.partner[linked]), (forest.partner[linked] != linked).tolist(), strict=True)]
    return pa.table({"u": pa.array(named(linked), pa.string()), "v": pa.array(named(forest.root[linked]), pa.string()), "near": pa.array(near, pa.string())})


def near_links(prints: DataFrame, words: int, radius: int, parts: range | None = None) -> DataFrame:
    """(u, v, near), names of fingerprints (see node_name); u and v connect what is linked, near is one that u is linked to, or null.

    prints are distinct.

    A partition's index is cut into cells by the first bits of the key, as many as keep a cell at
    about CELL_FINGERPRINTS rows. A row is at home in one cell and visits the cells whose first bits
    differ from its own by no more than the threshold. Cells that still are much larger (a hot key)
    are cut into blocks, and each pair of blocks is a task of its own. Inside a cell, links are
    folded into components, so a dense group sends on one link per row, not all of its pairs.
    """
    names = [f"fp_{i}" for i in range(words)]
    n, both = bit_statistics(prints, words)
    plan = plan_partitions(both, n, radius, parts or range(min(2, radius + 1), radius + 2))
    split = [index_split(n, len(p.bits)) for p in plan]
    low = {i: p.bits[s:] for i, (p, s) in enumerate(zip(plan, split, strict=True))}
    visits = [[(mask, p.threshold - mask.bit_count()) for mask in flips(s, p.threshold) if mask] for p, s in zip(plan, split, strict=True)]

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                some = batch.slice(at, 1 << 14)
                ones = unpacked(matrix(some, names))
                for i, p in enumerate(plan):
                    cell = keys_of(ones, p.bits[: split[i]]).astype(np.int64)
                    for mask, reach in [(0, p.threshold), *visits[i]]:
                        # of two rows in different cells, the one in the lower cell visits
                        going = np.flatnonzero(cell < cell ^ mask) if mask else np.arange(len(cell))
                        part = some.take(pa.array(going))
                        k = len(going)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(k, i, np.int32)), pa.array((cell ^ mask)[going]), pa.array(np.full(k, int(mask != 0), np.int32)), pa.array(np.full(k, reach, np.int32)), *(part.column(c) for c in names)],
                            names=["part", "cell", "side", "reach", *names],
                        )

    schema = "part int, cell long, side int, reach int, " + ", ".join(f"{c} long" for c in names)
    cells = prints.select(*names).mapInArrow(celled, schema)
    # blocks: a cell of b blocks becomes the pairs (i <= j) of them
    sizes = cells.groupBy("part", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * CELL_FINGERPRINTS)).alias("blocks"))
    hot = sizes.filter("blocks > 1")
    cells = cells.join(hot, ["part", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64(*names), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    cells = cells.withColumn("mine", mine).withColumn("other", other)
    cells = cells.withColumn("block_a", F.least("mine", "other")).withColumn("block_b", F.greatest("mine", "other"))

    def linked(cell: pa.Table) -> pa.Table:
        return cell_links(cell, names, radius, low)

    return cells.select("part", "cell", "block_a", "block_b", "side", "reach", *names).groupBy("part", "cell", "block_a", "block_b").applyInArrow(linked, "u string, v string, near string")


def node_name(names: list[str]) -> Column:
    """The words of a fingerprint in hex: unlike the smallest doc_id, no two fingerprints share it."""
    return F.concat(*[F.lpad(F.hex(n), 16, "0") for n in names])


def simhash_groups(
    docs: DataFrame,
    *,
    words_in_shingle: int = 5,
    radius: int = 24,
    seeds: tuple[int, ...] = (42, 43),
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, content, fp_0 .., component_id, group_name) for each row of docs.

    content is a hash of the text, fp_0 .. are the words of the fingerprint, component_id is the
    smallest doc_id of the row's group, and group_name the group's smallest fingerprint: groups of
    repeated ids may share the one, never the other.

    Rows are linked if their fingerprints differ in at most radius of 64 * len(seeds) bits, and a
    group is what links connect. Equal texts have equal fingerprints and meet before any search, so
    copies cost one row. A text without words has fingerprint zero and is linked like any other;
    a null text counts as empty; texts are hashed whole, block by block; rows with one doc_id may
    repeat and keep a row each; null doc_ids are allowed and never name a group that has others.
    An empty table gives an empty result.
    """
    names = [f"fp_{i}" for i in range(len(seeds))]
    each = cut(fingerprints(docs, words_in_shingle, seeds, key=key, text=text))
    distinct = cut(each.groupBy(*names).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows")))
    groups = connected_components(near_links(distinct, len(seeds), radius))
    placed = distinct.withColumn("_node", node_name(names)).join(groups, F.col("_node") == F.col("node"), "left")
    placed = cut(placed.select(*names, "doc_id", "rows", F.coalesce("component", "_node").alias("component")))
    least = cut(placed.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members")))
    labels = cut(spread_join(placed.drop("doc_id"), least, ["component"], "members").select(*names, "rows", "component_id", F.col("component").alias("group_name")))
    return spread_join(each, labels, names, "rows").select("doc_id", "content", *names, "component_id", "group_name")
