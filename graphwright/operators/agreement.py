"""Which proposals of different reads say the same, and which names may be taken for each other.

Proposals meet by equal names or a shared cite, names of a manual in cells of bounded size, where
characters in order part most. Gates on branch, kind, context and code come before any name is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.functions.similar import canonical_text, matching_ratio, similarity
from graphwright.functions.text import normalize_name
from graphwright.operators.ordered import in_groups

#: Ends that are cited at one place need only be so similar.
LOOSE = 0.5


def context_key(conditions: Column) -> Column:
    """The conditions of a proposal as a text, whatever their order and spelling."""
    return F.coalesce(F.array_join(F.array_sort(F.transform(conditions, lambda c: F.concat_ws(":", c["kind"], normalize_name(c["text"])))), "|"), F.lit(""))


def same_relation_pairs(proposals: DataFrame, least: float = LOOSE) -> DataFrame:
    """(unit_id, left_ord, right_ord): pairs of proposals of a unit and of different reads that state one relation, left_ord < right_ord.

    proposals(unit_id, ord, read, relation, branch_id, epistemic, cites, conditions, source, target):
    ends are (type, name, code, kind, placeholder, stated), conditions have (kind, text). Relation and
    context must be equal, and the codes of the sources if both have one. If either has a branch,
    branch, kinds of both ends and epistemic status must be equal, with a cite in common. Then equal
    names are enough; else a cite in common and two ends that match: a placeholder of a cause matches
    any cause, causes not both stated need equal names, others a similarity of `least`.
    """
    flag = lambda end, name: F.coalesce(F.col(f"{end}.{name}"), F.lit(False))
    plain = lambda value: F.coalesce(normalize_name(F.col(value)), F.lit(""))
    # what is compared is made once for a proposal, and each unit meets in one task
    placed = proposals.filter("unit_id is not null and relation is not null").select("unit_id", "ord", "read", "relation", "branch_id", "epistemic", "cites", "conditions", "source", "target").repartition("unit_id")
    rows = placed.select(
        "unit_id", F.col("ord").cast("long").alias("ord"), F.concat_ws("\n", "relation", context_key(F.col("conditions"))).alias("context"), "read", F.col("branch_id").alias("branch"), F.col("epistemic"),
        F.coalesce("cites", F.array().cast("array<string>")).alias("cites"), plain("source.code").alias("code"),
        *[v.alias(f"{x}_{n}") for x, end in (("s", "source"), ("t", "target")) for n, v in {"plain": plain(f"{end}.name"), "name": F.col(f"{end}.name"), "kind": F.col(f"{end}.kind"), "cause": F.coalesce(F.col(f"{end}.type") == "FailureMode", F.lit(False)), "placeholder": flag(end, "placeholder"), "stated": flag(end, "stated")}.items()],
    ).sortWithinPartitions("unit_id", "context", "ord")
    kind = dict(proposals.dtypes)["unit_id"]
    names = [f"{side}_{x}" for x in "st" for side in "lr"]
    met = rows.mapInArrow(_met_in_contexts, f"unit_id {kind}, left_ord long, right_ord long, {', '.join(f'{n} string' for n in names)}")
    for x in "st":
        met = met.filter(F.col(f"l_{x}").isNull() & F.col(f"r_{x}").isNull() | (similarity(F.col(f"l_{x}"), F.col(f"r_{x}")) >= least))
    return met.select("unit_id", "left_ord", "right_ord")


#: Cells of a comparison of proposals of one context that are held at once.
PAIRS_AT_ONCE = 1 << 22


def _met_in_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one unit, relation and context that pass all gates, with the names of ends that are still to be compared.

    Rows come sorted by unit and context; one context is held at a time, and compared in blocks of rows.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        same = _same_as_last(held)
        if same < held.num_rows:
            yield from _met(held.slice(0, held.num_rows - same))
            held = held.slice(held.num_rows - same)
    if held is not None:
        yield from _met(held)


def _same_as_last(table: pa.Table) -> int:
    """How many rows at the end are of the last one's unit and context."""
    last = table.num_rows - 1
    same = pc.and_(pc.equal(table["unit_id"], table["unit_id"][last]), pc.equal(table["context"], table["context"][last]))
    return int(pc.sum(same).as_py())


def _met(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The pairs of whole contexts."""

    def coded(name: str) -> np.ndarray:
        """Equal values as equal numbers, null as -1."""
        column = table[name].combine_chunks()
        return pc.fill_null(pc.index_in(column, pc.unique(column.drop_null())), -1).to_numpy(zero_copy_only=False)

    names = ("unit_id", "context", "read", "branch", "epistemic", "code", *(f"{x}_{n}" for x in "st" for n in ("plain", "kind")))
    code = {n: coded(n) for n in names}
    flags = {n: table[n].to_numpy() for n in (f"{x}_{f}" for x in "st" for f in ("cause", "placeholder", "stated"))}
    coded_row = pc.unique(table["code"].combine_chunks()).to_pylist()
    uncoded = code["code"] == (coded_row.index("") if "" in coded_row else -2)
    order = table["ord"].to_numpy()
    lists = table["cites"].combine_chunks()
    owner, cites = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
    cites = pc.fill_null(pc.index_in(cites, pc.unique(cites.drop_null())), -1).to_numpy(zero_copy_only=False)
    owner, cites = owner[cites >= 0], cites[cites >= 0]
    ends = np.flatnonzero((np.diff(code["unit_id"]) != 0) | (np.diff(code["context"]) != 0)) + 1
    found: list[tuple] = []
    waiting = 0
    for low, high in zip([0, *ends], [*ends, table.num_rows], strict=True):
        if high - low < 2:
            continue
        first, last = np.searchsorted(owner, [low, high])
        cited, column = np.unique(cites[first:last], return_inverse=True)
        # a bit for each cite, 63 to a word
        at = np.zeros((len(cited) // 63 + 1, high - low), dtype=np.int64)
        np.bitwise_or.at(at, (column // 63, owner[first:last] - low), np.left_shift(np.int64(1), column % 63))
        step = max(1, PAIRS_AT_ONCE // (high - low))
        for start in range(low, high, step):
            one, other = slice(start, min(high, start + step)), slice(low, high)
            equal = lambda n: code[n][one, None] == code[n][None, other]  # noqa: B023, E731
            either = lambda n: n[one, None] | n[None, other]  # noqa: B023, E731
            shared = np.zeros((one.stop - start, high - low), dtype=bool)
            for word in at:
                shared |= (word[start - low : one.stop - low, None] & word[None, :]) != 0
            read, branch = code["read"], code["branch"]
            kept = (order[one, None] < order[None, other]) & ~equal("read") & (read[one, None] >= 0) & (read[None, other] >= 0)
            scope = equal("branch") & equal("s_kind") & equal("t_kind") & equal("epistemic") & shared
            kept &= ~either(branch >= 0) | scope
            kept &= either(uncoded) | equal("code")
            named = equal("s_plain") & equal("t_plain")
            kept &= named | shared
            ask = {}
            for x in "st":
                causes = flags[f"{x}_cause"][one, None] & flags[f"{x}_cause"][None, other]
                sure = named | equal(f"{x}_plain") | causes & either(flags[f"{x}_placeholder"])
                strict = causes & ~(flags[f"{x}_stated"][one, None] & flags[f"{x}_stated"][None, other])
                kept &= sure | ~strict
                ask[x] = ~sure
            left, right = np.nonzero(kept)
            if len(left):
                found.append((left + start, right + low, ask["s"][left, right], ask["t"][left, right]))
                waiting += len(left)
            if waiting >= 50_000:
                yield from _listed(table, found)
                found, waiting = [], 0
    if found:
        yield from _listed(table, found)


def _listed(table: pa.Table, found: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Pairs by the places of their rows as batches, with the names of those ends that are asked for."""
    left, right, *asked = (np.concatenate(c) for c in zip(*found, strict=True))
    columns = {"unit_id": table["unit_id"].take(left), "left_ord": table["ord"].take(left), "right_ord": table["ord"].take(right)}
    for x, ask in zip("st", asked, strict=True):
        for side, place in (("l", left), ("r", right)):
            columns[f"{side}_{x}"] = pc.fill_null(table[f"{x}_name"], "").take(pa.array(place, mask=~ask))
    yield from pa.table(columns).to_batches(max_chunksize=10_000)


def agreement_groups(proposals: DataFrame, pairs: DataFrame) -> DataFrame:
    """(unit_id, ord, candidate, leads): each proposal, in order, joins the first candidate whose first member states the same and that has none of its read.

    candidate is the ord of the candidate's first member. leads marks the member that names both ends,
    or most of them, the first of equals.
    """
    before = pairs.groupBy("unit_id", F.col("right_ord").alias("ord")).agg(F.array_join(F.array_sort(F.collect_list("left_ord")), ",").alias("before"))
    named = F.coalesce(F.col("source.stated"), F.lit(False)).cast("int") + F.coalesce(F.col("target.stated"), F.lit(False)).cast("int")
    rows = proposals.select("unit_id", F.col("ord").cast("long").alias("ord"), "read", named.alias("named")).join(before, ["unit_id", "ord"], "left")

    def joined(part: list[tuple]) -> list[tuple]:
        reads: dict[int, set] = {}
        best: dict[int, tuple] = {}
        out = []
        for unit, order, read, names, earlier in part:
            firsts = map(int, earlier.split(",")) if earlier else ()
            first = next((f for f in firsts if f in reads and read not in reads[f]), order)
            reads.setdefault(first, set()).add(read)
            best[first] = min(best.get(first, (0, order)), (-names, order))
            out.append((unit, order, first))
        return [(unit, order, first, int(best[first][1] == order)) for unit, order, first in out]

    kind = dict(proposals.dtypes)["unit_id"]
    groups = in_groups(rows, "unit_id", "ord", joined, f"unit_id {kind}, ord long, candidate long, leads int")
    return groups.select("unit_id", "ord", "candidate", (F.col("leads") == 1).alias("leads"))


#: Names of a manual that are compared at once with as many others.
NAMES_AT_ONCE = 1000
#: What a pair has of each of its names.
SIDE = {"text": "key", "name": "name", "claims": "claims"}


def contrasts(claims: DataFrame, least: float = 0.72) -> DataFrame:
    """(manual, kind, left_name, right_name, left_claims, right_claims, similarity): names of a manual that look alike and may mean different things.

    claims(manual, claim_id, indicator, code, failure): failures are causes, indicators without a code are
    symptoms. Spellings of one name count once, by their first claim; names are compared as they are,
    with their numbers.
    """
    rows = claims.select("manual", "claim_id", F.explode(F.array(
        F.struct(F.lit("FailureMode").alias("kind"), F.col("failure").alias("name")),
        F.struct(F.lit("Symptom").alias("kind"), F.when(F.coalesce("code", F.lit("")) == "", F.col("indicator")).alias("name")),
    )).alias("e")).select("manual", "claim_id", "e.*").filter("name <> ''")
    rows = rows.filter("manual is not null")
    # a manual's names in parts of bounded size; each pair of parts meets in a cell of its own
    parts = rows.groupBy("manual", "kind").agg(F.ceil(F.count(F.lit(1)) / NAMES_AT_ONCE).cast("int").alias("_n"))
    names = rows.withColumn("text", canonical_text(F.col("name"))).groupBy("manual", "kind", "text").agg(F.min(F.struct("claim_id", "name"))["name"].alias("name"), F.array_sort(F.collect_set("claim_id")).alias("claims"))
    placed = names.join(parts, ["manual", "kind"]).withColumn("_part", F.pmod(F.xxhash64("text"), F.col("_n")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.struct(F.least(k, "_part").alias("_i"), F.greatest(k, "_part").alias("_j")))
    met = placed.select("manual", "kind", "text", "name", "claims", "_part", F.explode(cells).alias("_c")).select("manual", "kind", "text", "name", "claims", "_part", "_c.*")
    # few bytes hold much work, so the tasks are not to be merged by size
    tasks = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(tasks, "manual", "kind", "_i", "_j").sortWithinPartitions("manual", "kind", "_i", "_j")
    kinds = dict(met.dtypes)
    sides = ", ".join(f"{side}_{new} {kinds[old]}" for side in ("left", "right") for old, new in SIDE.items())
    pairs = met.mapInArrow(lambda batches: _alike(batches, least), f"manual {kinds['manual']}, kind string, {sides}")
    # blocks of a match need bigrams in common: a match of m characters in so many blocks has m less the blocks
    pairs = pairs.filter(_shared_bigrams(F.col("left_key"), F.col("right_key")) >= (F.length("left_key") + F.length("right_key")) * (1.5 * least - 1) - 1 - 1e-9)
    # the ratio depends on which text comes first: the one whose claim came first does
    swap = F.col("right_claims") < F.col("left_claims")
    first, second = (F.when(swap, F.col(f"{b}_key")).otherwise(F.col(f"{a}_key")) for a, b in (("left", "right"), ("right", "left")))
    scored = pairs.withColumn("ratio", matching_ratio(first, second)).filter(F.col("ratio") >= least)
    side = lambda what: [F.when(swap, F.col(f"{b}_{what}")).otherwise(F.col(f"{a}_{what}")).alias(f"{a}_{what}") for a, b in (("left", "right"), ("right", "left"))]
    return scored.select("manual", "kind", *side("name"), *side("claims"), F.bround("ratio", 4).alias("similarity"))


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of names of each cell that may match by a ratio of at least `least`; rows come sorted by cell, one is held at a time."""
    for cell in _whole_groups(batches, ("manual", "kind", "_i", "_j")):
        texts = np.array([*cell["text"].to_pylist(), None], dtype=object)[:-1]
        part, i, j = cell["_part"].to_numpy(), cell["_i"][0].as_py(), cell["_j"][0].as_py()
        left, right = near_texts(texts, np.flatnonzero(part == i), np.flatnonzero(part == j), least)
        swap = texts[left] > texts[right]
        left, right = np.where(swap, right, left), np.where(swap, left, right)
        columns = {"manual": cell["manual"].take(left), "kind": cell["kind"].take(left)}
        for side, rows in (("left", left), ("right", right)):
            columns |= {f"{side}_{new}": cell[old].take(rows) for old, new in SIDE.items()}
        yield from pa.table(columns).to_batches(max_chunksize=10_000)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each group as a table; rows come sorted by the keys."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        changes = np.zeros(table.num_rows - 1, dtype=bool)
        for key in keys:
            changes |= pc.not_equal(batch[key][1:], batch[key][:-1]).to_numpy(zero_copy_only=False)
        ends = [0, *(np.flatnonzero(changes) + 1), table.num_rows]
        for low, high in zip(ends, ends[1:]):  # noqa: B905
            if held and (low or any(held[0][k][0] != table[k][0] for k in keys)):
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(low, high - low))
    if held:
        yield pa.concat_tables(held)


def near_texts(texts: np.ndarray, ones: np.ndarray, others: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places, one of ones and one of others, whose texts may match by a ratio of at least `least`; of a set with itself each pair once.

    A match has no more characters than the texts have in common, and no more than their longest common
    subsequence, which is found for all pairs at once, a bit for each character of a text of up to 64.
    """
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    size = np.array([len(p) for p in points], dtype=np.int64)
    owner = np.repeat(np.arange(len(points)), size)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    letters, code = np.unique(np.concatenate(points), return_inverse=True)
    counts = np.zeros((len(letters), len(points)), dtype=np.int32)
    np.add.at(counts, (code, owner), 1)
    # of texts of up to 64 characters: where each letter is, and the letters in order; the last letter is none
    low = place < 64
    masks = np.zeros((len(points), len(letters) + 1), dtype=np.uint64)
    np.bitwise_or.at(masks, (owner[low], code[low]), np.left_shift(np.uint64(1), place[low].astype(np.uint64)))
    starts = np.cumsum(size) - size
    same = ones is others or np.array_equal(ones, others)
    found = [(np.zeros(0, dtype=np.int64),) * 2]
    step = max(1, PAIRS_AT_ONCE // 8 // max(1, len(others)))
    for start in range(0, len(ones), step):
        rows = ones[start : start + step]
        common = np.zeros((len(rows), len(others)), dtype=np.int32)
        for letter in np.flatnonzero(counts[:, rows].any(axis=1) & counts[:, others].any(axis=1)):
            common += np.minimum(counts[letter, rows][:, None], counts[letter, others][None, :])
        kept = 2 * common >= (size[rows][:, None] + size[others][None, :]) * least - 1e-9
        if same:
            kept &= rows[:, None] < others[None, :]
        a, b = np.nonzero(kept)
        a, b = rows[a], others[b]
        a, b = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
        free = np.full(len(a), ~np.uint64(0))
        for at in range(int(size[b].max(initial=0))):
            letter = np.where(at < size[b], code[np.minimum(starts[b] + at, len(code) - 1)], len(letters))
            hit = free & masks[a, letter]
            free = (free + hit) | (free - hit)
        width = np.left_shift(np.uint64(1), np.minimum(size[a], 63).astype(np.uint64)) - np.uint64(1)
        width = np.where(size[a] > 63, ~np.uint64(0), width)
        near = (size[a] > 64) | (2 * np.bitwise_count(~free & width).astype(np.int64) >= (size[a] + size[b]) * least - 1e-9)
        found.append((a[near], b[near]))
    left, right = (np.concatenate(side) for side in zip(*found, strict=True))
    return left, right


def _shared_bigrams(left: Column, right: Column) -> Column:
    """How many bigrams two texts share, repeated ones as often as both have them."""

    def counted(text: Column) -> Column:
        grams = F.when(F.length(text) > 1, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i), lambda x: x == g)).cast("string")))

    return F.size(F.array_intersect(counted(left), counted(right)))
