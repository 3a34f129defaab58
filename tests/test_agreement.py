"""Agreement of reads, similar names, merges, matching and places against brute force."""

import itertools
import random
from collections import defaultdict
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphwright.functions import similar
from graphwright.operators import agreement as A
from graphwright.operators import merging, ordered
from graphwright.operators.ranking import ranked
from graphwright.plans import agreement_queries as Q

SCHEMA = "unit_id long, ord long, read string, relation string, branch_id string, epistemic string, cites array<string>, conditions array<struct<kind string, text string>>, source struct<type string, name string, code string, kind string, placeholder boolean, stated boolean>, target struct<type string, name string, code string, kind string, placeholder boolean, stated boolean>"


def key(name):
    return " ".join(similar.canonical_words(name or ""))


def end_matches(a, b):
    if a["type"] == b["type"] == "FailureMode":
        if a["placeholder"] or b["placeholder"]:
            return True
        if not (a["stated"] and b["stated"]):
            return key(a["name"]) == key(b["name"])
    return similar.name_similarity(a["name"], b["name"]) >= 0.5


def same(a, b):
    """Whether two proposals state one relation, rule by rule."""
    shared = set(a["cites"] or []) & set(b["cites"] or [])
    if a["branch_id"] or b["branch_id"]:
        if a["branch_id"] != b["branch_id"] or a["source"]["kind"] != b["source"]["kind"] or a["target"]["kind"] != b["target"]["kind"]:
            return False
        if a["epistemic"] != b["epistemic"] or not shared:
            return False
    context = lambda p: sorted((c["kind"], key(c["text"])) for c in p["conditions"] or [])
    if context(a) != context(b) or a["relation"] != b["relation"]:
        return False
    codes = {key(p["source"]["code"]) for p in (a, b)} - {""}
    if len(codes) > 1:
        return False
    if key(a["source"]["name"]) == key(b["source"]["name"]) and key(a["target"]["name"]) == key(b["target"]["name"]):
        return True
    return bool(shared) and end_matches(a["source"], b["source"]) and end_matches(a["target"], b["target"])


def check(spark, rows):
    pairs = A.same_relation_pairs(rows)
    units = defaultdict(list)
    for r in rows.collect():
        units[r["unit_id"]].append(r)
    expected, groups = set(), {}
    for unit, mine in units.items():
        mine.sort(key=lambda r: r["ord"])
        alike = {(a["ord"], b["ord"]) for a, b in itertools.combinations(mine, 2) if a["read"] != b["read"] and same(a, b)}
        expected |= {(unit, *p) for p in alike}
        reads = {}
        for r in mine:
            first = next((f for f in reads if r["read"] not in reads[f] and (f, r["ord"]) in alike), r["ord"])
            reads.setdefault(first, set()).add(r["read"])
            groups[unit, r["ord"]] = first
    assert {tuple(r) for r in pairs.collect()} == expected
    got = A.agreement_groups(rows, pairs).collect()
    assert {(r["unit_id"], r["ord"]): r["candidate"] for r in got} == groups
    stated = {(r["unit_id"], r["ord"]): bool(r["source"]["stated"]) + bool(r["target"]["stated"]) for mine in units.values() for r in mine}
    members = defaultdict(list)
    for (unit, order), first in groups.items():
        members[unit, first].append((-stated[unit, order], order))
    assert {(r["unit_id"], r["ord"]) for r in got if r["leads"]} == {(unit, min(m)[1]) for (unit, _), m in members.items()}
    return expected, groups


def test_relations_of_all_lines_against_all_pairs(spark, small):
    rows = Q.proposals(spark, small).filter("unit_id < 8")
    expected, groups = check(spark, rows)
    assert len(expected) > 100 and len(set(groups.values())) < len(groups)


def test_random_relations_against_all_pairs(spark):
    rng = random.Random(9)
    pick = rng.choice
    names = ["Air supply restricted", "restricted air-supply", "Pump 12 stops", "Pump 13 stops", "Fluid dried on rod", "", None, "Output low on down- stroke", "output low on up-stroke"]
    end = lambda: (pick(["FailureMode", "Symptom"]), pick(names), pick([None, "", "E1", "e1", "E2"]), pick([None, "repair"]), pick([True, False, False, None]), pick([True, True, False, None]))
    data = [
        (rng.randrange(3), i, pick("ABC"), pick(["X", "Y"]), pick([None, None, "b1", "b2"]), pick(["EXPLICIT", "INFERRED"]), pick([None, [], ["s1"], ["s2", "s1"], ["s3", "s2", "s2"]]), pick([None, [], [("if", "hot"), ("if", "Wet")], [("if", "wet"), ("if", "HOT")]]), end(), end())
        for i in range(260)
    ]
    expected, _ = check(spark, spark.createDataFrame(data, SCHEMA))
    assert len(expected) > 15
    empty = spark.createDataFrame([], SCHEMA)
    assert A.agreement_groups(empty, A.same_relation_pairs(empty)).count() == 0


def test_no_name_is_compared_that_a_gate_rules_out(spark, monkeypatch):
    seen = []

    def watched(a, b):
        seen.append(1)

        @F.pandas_udf("double")
        def compare(x: pd.Series, y: pd.Series) -> pd.Series:
            assert x.isna().all() and y.isna().all(), "compared"
            return pd.Series([1.0] * len(x))

        return compare(a, b)

    monkeypatch.setattr(A, "similarity", watched)
    end = lambda name, code=None: ("Symptom", name, code, None, False, True)
    row = lambda i, read, relation, branch, cites, s, t: (1, i, read, relation, branch, "EXPLICIT", cites, None, s, t)
    rows = [
        row(1, "A", "X", None, ["s1"], end("a"), end("b")), row(2, "B", "Y", None, ["s1"], end("a1"), end("b")), row(3, "B", "X", "b1", ["s1"], end("a2"), end("b")),
        row(4, "A", "X", None, ["s1"], end("a3"), end("b")), row(5, "B", "X", None, ["s2"], end("a4"), end("b")), row(6, "C", "X", None, ["s2"], end("a4"), end("b")),
    ]
    assert [tuple(r) for r in A.same_relation_pairs(spark.createDataFrame(rows, SCHEMA)).collect()] == [(1, 5, 6)] and seen


def test_proposals_are_shuffled_once_and_pairs_are_not(spark):
    end = ("Symptom", "pump stops", None, None, False, True)
    rows = [(1, i, "AB"[i % 2], "X", None, "EXPLICIT", [None, "s1"], None, end, (*end[:1], f"valve {i} shuts", *end[2:])) for i in range(4)]
    pairs = A.same_relation_pairs(spark.createDataFrame(rows, SCHEMA))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert pairs.count() == 0
    rows = [(*r[:9], (*end[:1], f"valve shuts {'now' * (i % 2)}", *end[2:])) for i, r in enumerate(rows)]
    assert {tuple(r) for r in A.same_relation_pairs(spark.createDataFrame(rows, SCHEMA)).collect()} == {(1, 0, 1), (1, 0, 3), (1, 1, 2), (1, 2, 3)}


def test_contexts_are_compared_in_blocks(spark, small, monkeypatch):
    rows = Q.proposals(spark, small).filter("unit_id < 2")
    whole = A.same_relation_pairs(rows).collect()
    import pyarrow as pa

    table = pa.table({"unit_id": [1] * 30, "context": ["x"] * 30, "ord": list(range(30)), "read": ["A", "B"] * 15, "branch": pa.array([None] * 30, pa.string()), "epistemic": ["E"] * 30, "cites": [[f"s{i}", f"s{i % 2}", f"t{i // 10}"] for i in range(30)], "code": [""] * 30, **{f"{x}_{n}": ["n"] * 30 for x in "st" for n in ("plain", "name", "kind")}, **{f"{x}_{n}": [False] * 30 for x in "st" for n in ("cause", "placeholder", "stated")}})
    found = lambda: [b.num_rows for b in A._met(table)]
    before = sum(found())
    monkeypatch.setattr(A, "PAIRS_AT_ONCE", 64)
    assert before == sum(found()) == 15 * 15 and len(whole) > 0


WORDS = ["pump", "valve", "does", "not", "open", "close", "air", "supply", "restricted", "rod", "dry", "leaks", "12", "13", "the", "on", "up-stroke", "down-stroke"]


@pytest.mark.parametrize("least", [0.5, 0.72, 0.9])
def test_similar_names_against_all_pairs(spark, least):
    rng = random.Random(int(least * 100))
    names = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 6))) for _ in range(220)] + ["", "-", "Pump", "pump", "aaaa", "aaab", "ﬁlter", "filter"]
    rows = [(i % 2, i, n) for i, n in enumerate(names)]
    expected = {(a[0], a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and similar.name_similarity(a[2], b[2]) >= least}
    got = ordered.similar_pairs(spark.createDataFrame(rows, "g int, k int, n string"), "g", "k", "n", least).collect()
    assert {tuple(r)[:3] for r in got} == expected and len(got) == len(expected)


def contrasts_by_hand(rows, least):
    out = set()
    by = defaultdict(dict)
    for manual, claim, indicator, code, failure in sorted(rows, key=lambda r: r[1]):
        for kind, name in (("FailureMode", failure), ("Symptom", None if code else indicator)):
            if name:
                by[manual, kind].setdefault(key(name), [name, []])[1].append(claim)
    for (manual, kind), entries in by.items():
        for (a, left), (b, right) in itertools.combinations(entries.items(), 2):
            ratio = SequenceMatcher(None, a, b).ratio()
            if ratio >= least:
                out.add((manual, kind, left[0], right[0], tuple(left[1]), tuple(right[1]), round(ratio, 4)))
    return out


def test_contrasts_against_all_pairs(spark, small):
    claims = Q.claims(spark, small)
    rows = [(r["manual"], r["claim_id"], r["indicator"], r["code"], r["failure"]) for r in claims.collect()]
    rng = random.Random(4)
    rows += [(99, 1000 + i, " ".join(rng.choice(WORDS) for _ in range(4)), rng.choice([None, "", "E"]), " ".join(rng.choice(WORDS) for _ in range(5))) for i in range(400)]
    df = spark.createDataFrame(rows, "manual long, claim_id long, indicator string, code string, failure string")
    got = {(r["manual"], r["kind"], r["left_name"], r["right_name"], tuple(r["left_claims"]), tuple(r["right_claims"]), round(r["similarity"], 4)) for r in A.contrasts(df).collect()}
    expected = contrasts_by_hand(rows, 0.72)
    assert len(expected) > 200
    assert {e[:6] for e in got} == {e[:6] for e in expected} and all(any(abs(g[6] - e[6]) < 2e-4 for e in expected if e[:6] == g[:6]) for g in got)


def test_contrasts_in_many_cells(spark, monkeypatch):
    """A manual's names meet in cells of bounded size, and few pairs but the alike ones are left for the ratio."""
    monkeypatch.setattr(A, "NAMES_AT_ONCE", 7)
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("etaoins\u00e9\u4e2d\U0001f600") for _ in range(rng.randrange(1, 6))) for _ in range(n))
    names = [text(5) for _ in range(60)] + [text(30) for _ in range(8)] + ["a", "", "b" * 64, "b" * 70]
    names += [n[:i] + "x" + n[i + 1 :] for n in names for i in (len(n) // 2,)]
    rows = [(1, i, rng.choice(names), None, n) for i, n in enumerate(names)] + [(None, 1, "abcdef", None, "abcdeg"), (None, 2, "abcdeg", None, "abcdef")]
    df = spark.createDataFrame(rows, "manual long, claim_id long, indicator string, code string, failure string")
    got = {(r["manual"], r["kind"], r["left_name"], r["right_name"], tuple(r["left_claims"]), tuple(r["right_claims"])) for r in A.contrasts(df).collect()}
    assert got == {e[:6] for e in contrasts_by_hand([r for r in rows if r[0]], 0.72)} and len(got) > 40
    words = np.array(["".join(rng.choice("etaoinsrhldcum ") for _ in range(rng.randrange(20, 70))) for _ in range(300)], dtype=object)
    every = np.arange(len(words))
    alike = {(i, j) for i, j in itertools.combinations(range(len(words)), 2) if SequenceMatcher(None, words[i], words[j]).ratio() >= 0.5}
    left = set(map(tuple, np.sort(np.stack(A.near_texts(words, every, every, 0.5), 1), axis=1).tolist()))
    assert alike and alike <= left
    assert len(A.near_texts(words, every, every, 0.72)[0]) < len(words)


def merges_by_hand(nodes, pairs, apart):
    """The rules over member lists, without any sets of groups."""
    groups = {k: [k] for k in nodes}
    of = {k: k for k in nodes}
    blocked = []
    for left, right in pairs:
        if left not in nodes or right not in nodes or of[left] == of[right]:
            continue
        a, b = of[left], of[right]
        why = None
        for x, y in itertools.product(sorted(groups[a]), sorted(groups[b])):
            m, n = nodes[x], nodes[y]
            scoped = m["type"] in ("FailureMode", "CorrectiveAction")
            if (m["branch"] or n["branch"]) and scoped and m["branch"] != n["branch"]:
                why = "different_scope"
            elif m["kind"] != n["kind"]:
                why = "different_action_kind"
            elif m["status"] != n["status"]:
                why = "different_denotation"
            elif frozenset((x, y)) in apart:
                why = "different"
            elif m["code"] and n["code"] and m["code"] != n["code"]:
                why = "different_codes"
            elif m["digits"] != n["digits"]:
                why = "different_numbers"
            elif m["type"] != n["type"]:
                why = "different_types"
            if why:
                blocked.append((left, right, why, x, y))
                break
        if not why:
            root, child = min(a, b), max(a, b)
            groups[root] += groups.pop(child)
            for k in groups[root]:
                of[k] = root
    return of, blocked


def test_merges_against_member_lists(spark):
    rng = random.Random(2)
    blank = lambda *values: rng.choice(values) or ""
    nodes, pairs, apart = [], [], []
    for g in range(30):
        keys = [f"k{i:02d}" for i in range(24)]
        strict = g % 3
        for k in keys:
            nodes.append((g, k, rng.choice(["FailureMode"] * 6 + ["Symptom"]), blank(*["b1"] * 8, None), blank(*["repair"] * 9, None) if strict else "repair", rng.choice(["STATED"] * 9 + ["INFERRED"]) if strict else "STATED", blank(None, None, None, "e1", "e2") if g % 2 else "", "12" if rng.random() < 0.08 else ""))
        pairs += [(g, i, *rng.sample([*keys, "gone"], 2)) for i in range(50)]
        apart += [(g, *rng.sample([*keys, "gone"], 2)) for _ in range(6)]
    fields = "type string, branch string, kind string, status string, code string, digits string"
    got = merging.constrained_merges(spark.createDataFrame(nodes, f"g int, key string, {fields}"), spark.createDataFrame(pairs, "g int, ord int, left_key string, right_key string"), spark.createDataFrame(apart, "g int, left_key string, right_key string"), "g").collect()
    names = [f.split()[0] for f in fields.split(", ")]
    reasons = set()
    for g in range(30):
        mine = {n[1]: dict(zip(names, n[2:], strict=True)) for n in nodes if n[0] == g}
        of, blocked = merges_by_hand(mine, [p[2:] for p in pairs if p[0] == g], {frozenset(a[1:]) for a in apart if a[0] == g})
        assert {r["left_key"]: r["right_key"] for r in got if r["g"] == g and r["part"] == "node"} == of
        assert sorted(tuple(r)[2:] for r in got if r["g"] == g and r["part"] == "blocked") == sorted(blocked)
        reasons |= {b[2] for b in blocked}
    assert reasons == {"different_scope", "different_action_kind", "different_denotation", "different", "different_codes", "different_numbers", "different_types"}


def test_matching_prefers_first_ids(spark):
    rng = random.Random(8)
    edges = [(g, a, b, rng.randrange(1, 3)) for g in range(40) for a in range(4) for b in range(4) if rng.random() < 0.6]
    got = ordered.best_matching(spark.createDataFrame(edges, "g long, left_id long, right_id long, weight long"), "g").collect()
    for g in range(40):
        mine = sorted(e[1:] for e in edges if e[0] == g)
        place = {e: i for i, e in enumerate(mine)}
        options = [s for n in range(5) for s in itertools.combinations(mine, n) if len({a for a, _, _ in s}) == n == len({b for _, b, _ in s})]
        value = lambda s: (len(s), sum(w for _, _, w in s), -sum(place[e] for e in s))  # noqa: E731, B023
        found = [tuple(r)[1:] for r in got if r["g"] == g]
        assert value(found) == max(map(value, options))
    literal = ordered.best_matching(spark.createDataFrame([(0, "G1", "P1", 3), (0, "G1", "P2", 1), (0, "G2", "P1", 1)], "g int, left_id string, right_id string, weight long"), "g")
    assert {(r["left_id"], r["right_id"]) for r in literal.collect()} == {("G1", "P2"), ("G2", "P1")}


def test_places_of_hot_groups(spark):
    rng = random.Random(1)
    rows = [(None if rng.random() < 0.3 else rng.choice(["a", "a", "b"]), rng.randrange(10**6), i) for i in range(3000)]
    got = ranked(spark.createDataFrame(rows, "g string, v int, i int").repartition(7), ["g"], [F.desc("v"), F.col("i")]).collect()
    for g in (None, "a", "b"):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert sorted((r["place"], r["i"]) for r in got if r["g"] == g) == [(n, r[2]) for n, r in enumerate(mine, 1)]
    assert [r["place"] for r in ranked(spark.range(5), [], [F.desc("id")]).orderBy("id").collect()] == [5, 4, 3, 2, 1]
    assert ranked(spark.range(0), [], [F.col("id")]).count() == 0
