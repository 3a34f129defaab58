"""Merging nodes along pairs in order, under constraints between all members of the merged groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.operators.ordered import in_groups

#: Types whose nodes belong to the branch that they stand in.
SCOPED = ("FailureMode", "CorrectiveAction")
FIELDS = ("type", "branch", "kind", "status", "code", "digits")


class Merger:
    """Groups of nodes that grow pair by pair; a pair that breaks a constraint leaves both groups as they are.

    All members of a group agree in kind, status, digits and type; so a merge is checked by the groups'
    own sets, and only a blocked one looks for the two members that forbid it.
    """

    def __init__(self) -> None:
        self.nodes: dict[str, tuple] = {}
        self.root: dict[str, str] = {}
        self.members: dict[str, list[str]] = {}
        self.apart: dict[str, set[str]] = {}
        self.codes: dict[str, set[str]] = {}
        self.branches: dict[str, set[str]] = {}

    def add(self, key: str, node: tuple) -> None:
        self.nodes[key], self.root[key], self.members[key] = node, key, [key]
        self.codes[key] = {node[4]} - {""}
        self.branches[key] = {node[1]}

    def find(self, key: str) -> str:
        while self.root[key] != key:
            self.root[key] = self.root[self.root[key]]
            key = self.root[key]
        return key

    def reason(self, x: str, y: str) -> str | None:
        """Why two nodes may not be one."""
        (type_x, branch_x, kind_x, status_x, code_x, digits_x), (type_y, branch_y, kind_y, status_y, code_y, digits_y) = self.nodes[x], self.nodes[y]
        tests = (
            ("different_scope", type_x in SCOPED and branch_x != branch_y), ("different_action_kind", kind_x != kind_y), ("different_denotation", status_x != status_y),
            ("different", y in self.apart.get(x, ())), ("different_codes", bool(code_x and code_y) and code_x != code_y),
            ("different_numbers", digits_x != digits_y), ("different_types", type_x != type_y),
        )
        return next((name for name, broken in tests if broken), None)

    def merge(self, left: str, right: str) -> tuple | None:
        """Merges the groups of two nodes, or tells (reason, member, member) that forbid it."""
        a, b = self.find(left), self.find(right)
        if a == b:
            return None
        small, large = sorted((self.members[a], self.members[b]), key=len)
        other = set(large)
        fits = (
            all(self.nodes[a][i] == self.nodes[b][i] for i in (0, 2, 3, 5)) and len(self.codes[a] | self.codes[b]) <= 1
            and (self.nodes[a][0] not in SCOPED or len(self.branches[a] | self.branches[b]) == 1) and not any(self.apart.get(x, set()) & other for x in small)
        )
        if not fits:
            for x in sorted(self.members[a]):
                for y in sorted(self.members[b]):
                    if why := self.reason(x, y):
                        return why, x, y
        root, child = min(a, b), max(a, b)
        self.root[child] = root
        for of in (self.codes, self.branches):
            of[root] = of[root] | of.pop(child)
        self.members[root] = self.members[root] + self.members.pop(child)
        return None


def constrained_merges(nodes: DataFrame, pairs: DataFrame, apart: DataFrame, group: str) -> DataFrame:
    """(group, part, left_key, right_key, reason, constraint_left, constraint_right).

    nodes(group, key, type, branch, kind, status, code, digits), pairs(group, ord, left_key, right_key)
    in an order without ties, apart(group, left_key, right_key): names judged different. part is node,
    with the least key of its group as right_key, or blocked, with the reason and the two members that
    forbid the merge: another scope of a cause or action, action kind, denotation, judged different,
    codes, numbers, types. Pairs of unknown keys are passed over. A group is a document's names: a task
    holds the nodes of one group that are in pairs.
    """
    texts = lambda df, seq, left, right, fields: df.select(F.col(group), seq.cast("long").alias("seq"), left.cast("string").alias("l"), right.cast("string").alias("r"), *[f.cast("string").alias(n) for n, f in zip(FIELDS, fields, strict=True)])
    blank = [F.lit(None)] * len(FIELDS)
    ends = pairs.select(group, F.explode(F.array("left_key", "right_key")).alias("key")).distinct()
    mine = nodes.join(ends, [group, "key"], "left_semi")
    fields = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in FIELDS]
    rows = texts(mine, F.lit(0), F.col("key"), F.lit(None), fields).unionByName(texts(apart, F.lit(1), F.col("left_key"), F.col("right_key"), blank))
    rows = rows.unionByName(texts(pairs, F.col("ord") + 2, F.col("left_key"), F.col("right_key"), blank))

    def merged(part: list[tuple]) -> list[tuple]:
        merger, out, one = Merger(), [], part[0][0]
        for _, seq, left, right, *node in part:
            if seq == 0:
                merger.add(left, tuple(node))
            elif left in merger.nodes and right in merger.nodes:
                if seq == 1:
                    merger.apart.setdefault(left, set()).add(right)
                    merger.apart.setdefault(right, set()).add(left)
                elif why := merger.merge(left, right):
                    out.append((one, "blocked", left, right, *why))
        return out + [(one, "node", key, merger.find(key), None, None, None) for key in merger.nodes]

    kind = dict(nodes.dtypes)[group]
    schema = f"`{group}` {kind}, part string, left_key string, right_key string, reason string, constraint_left string, constraint_right string"
    alone = nodes.join(ends, [group, "key"], "left_anti").select(
        group, F.lit("node").alias("part"), F.col("key").cast("string").alias("left_key"), F.col("key").cast("string").alias("right_key"), *[F.lit(None).cast("string").alias(n) for n in ("reason", "constraint_left", "constraint_right")]
    )
    return in_groups(rows, group, "seq", merged, schema).unionByName(alone)
