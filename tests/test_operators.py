"""Operators on small literal inputs, against what the rules say or against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphwright.functions import similar
from graphwright.functions import text as T
from graphwright.operators import certify, edits, graph, layout, ledger, ordered, review, scoring
from graphwright.operators.components import connected_components


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "text string").select(expression(F.col("text"))).first()[0]


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Output is low on down- stroke.", "output is low on down-stroke"),
        ("  The PUMP,  fails! ", "the pump fails"),
        ("", ""),
        (None, None),
        ("-- x --", "x"),
    ],
)
def test_normalize_name(spark, text, name):
    assert one(spark, text, T.normalize_name) == name


def test_similarity():
    assert similar.name_similarity("Air supply restricted", "Restricted air supply") == 1.0
    assert similar.name_similarity("Error E-12 active", "Error E-13 active") == 0.0
    assert similar.name_similarity("", "") == 1.0


def test_token_f1(spark):
    df = spark.createDataFrame([("the pump fails", "pump fails often", 0.8), ("the of", "pump", 0.0), ("a b b", "b b b", 0.8)], "a string, b string, f double")
    for r in df.withColumn("got", T.token_f1(F.col("a"), F.col("b"))).collect():
        assert r["got"] == pytest.approx(r["f"]), r


def test_wilson(spark):
    low, high = T.wilson(F.col("h"), F.col("n"))
    df = spark.createDataFrame([(239, 339), (0, 0), (5, 5)], "h long, n long").select(low, high)
    assert [tuple(r) for r in df.collect()] == [(0.654, 0.751), (0.0, 0.0), (0.566, 1.0)]


TIERS = [
    (True, True, None, None, False, [], "green"),
    (True, False, None, None, False, [], "yellow"),
    (False, False, None, None, False, [], "red"),
    (True, True, "supported", "human", True, [], "red"),
    (True, True, "supported", None, False, ["MISSING_EVIDENCE"], "red"),
    (True, True, "supported", None, False, ["AMBIGUOUS_NAME"], "yellow"),
    (False, False, "not_supported", "agent", False, [], "green"),
    (False, False, "not_supported", "auto", False, [], "red"),
    (True, True, "not_supported", None, False, [], "yellow"),
    (None, None, "supported", None, None, [], "yellow"),
    (True, False, "unclear", None, False, [], "yellow"),
]


def test_tiers(spark):
    schema = "structure boolean, agreement boolean, verdict string, reviewer string, rejected boolean, issues array<string>, expected string"
    df = spark.createDataFrame(TIERS, schema)
    got = df.select(certify.tier(*[F.col(c) for c in df.columns[:6]]).alias("tier"), "expected")
    assert all(r["tier"] == r["expected"] for r in got.collect())


def test_page_gaps(spark):
    labels = [(36, "other"), (37, "diagnostic"), (38, "procedure"), (39, "diagnostic"), (40, "other"), (41, "procedure"), (42, "other")]
    pages = spark.createDataFrame([(1, p, label, False) for p, label in labels], "manual int, page int, label string, unsure boolean")
    got = {r["page"]: (r["new_label"], r["new_unsure"]) for r in layout.fill_page_gaps(pages).collect()}
    assert {p for p, (label, _) in got.items() if label == "diagnostic"} == {37, 38, 39}
    assert got[38][1] and not got[37][1]


def test_numbered_steps(spark):
    lines = ["Problem: no power", "1. Check the fuse", "a) remove it", "2. Replace the", "whole fuse", "1. Start again.", "End."]
    segments = spark.createDataFrame([(1, 1, i, f"p1.b{i}", t) for i, t in enumerate(lines)], "doc_id int, page int, pos int, segment_id string, text string")
    got = layout.numbered_steps(layout.continuations(segments)).orderBy("pos").select("sequence", "step", "head").collect()
    assert [r["step"] for r in got] == [None, "1", "1a", "2", "2", "1", None]
    assert [r["sequence"] for r in got] == [None, 1, 1, 1, 1, 2, None]
    assert [r["head"] for r in got] == [None, "p1.b0", None, None, None, None, None]


def test_fill_down_and_origin(spark):
    table = spark.createDataFrame([(1, 1, "a"), (1, 2, ""), (1, 4, ""), (1, 5, "b")], "doc_id int, row int, cell string")
    filled = {r["row"]: (r["cell_filled"], r["cell_origin"]) for r in layout.fill_down(table, ["cell"]).collect()}
    assert filled == {1: ("a", 1), 2: ("a", 1), 4: ("a", 1), 5: ("b", 5)}
    origin = {r["row"]: r["origin"] for r in layout.origin_rows(table, F.col("cell") == "").collect()}
    assert origin == {1: None, 2: 1, 4: None, 5: None}


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "u long, v long"))))
    parent = {n: n for e in edges for n in e if e[0] != e[1]}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {n: find(n) for n in parent}
    assert rows(connected_components(spark.createDataFrame([], "u long, v long"))) == []


def test_two_hop_and_gaps(spark):
    a = spark.createDataFrame([(1, "s", "c", ["if x"]), (1, "s", "d", [])], "unit_id int, source_name string, target_name string, conditions array<string>")
    b = spark.createDataFrame([(1, "c", "r", ["if y"]), (1, "d", "r", ["if y"]), (2, "d", "q", [])], a.schema)
    assert sorted((r["middle"], r["status"]) for r in graph.two_hop_paths(a, b).collect()) == [("c", "UNCLEAR_APPLICABILITY"), ("d", "PATH")]
    edges = spark.createDataFrame([("MAY_INDICATE", "s", "c", "green"), ("RESOLVED_BY", "d", "r", "green"), ("MAY_INDICATE", "s", "d", "red")], "relation_type string, source_name string, target_name string, tier string")
    assert rows(graph.navigation_gaps(edges)) == [("orphan_cause", "d"), ("problem_without_action", "s")]


def test_canonical_names(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "c", 0)], "g int, name string, ord int")
    got = graph.canonical_names(df, "g", "name", "ord").first()
    assert (got["first_seen_name"], got["alphabetic_name"], got["aliases"], got["merged_aliases"]) == ("c", "a", "a, b", 2)


def test_row_difference(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "z"), (3, "w", "w")], "k int, f string, g string")
    b = spark.createDataFrame([(2, "y", "q"), (3, "w", "w"), (4, "n", "n")], a.schema)
    assert rows(graph.row_difference(a, b, "k", ["f", "g"])) == [(1, "removed", ""), (2, "updated", "g"), (4, "added", "")]


def test_ledger_states(spark):
    events = [("a", "call_reserved", 5), ("a", "call_finalized", 3), ("b", "call_reserved", 4), ("c", "call_reserved", 6), ("c", "call_finalized", None), ("d", "call_finalized", 1), ("e", "call_reserved", 1), ("e", "call_reserved", 1)]
    got = rows(ledger.calls(spark.createDataFrame(events, "call_id string, event string, amount long")))
    assert got == [("a", 5, 3, "finalised"), ("b", 4, 0, "open"), ("c", 6, 6, "unknown_usage"), ("d", 0, 1, "unreserved"), ("e", 2, 0, "duplicate")]


def test_reviewers(spark):
    answers = [(1, 0, "system", "x", False, True), (1, 1, "assistant", "y", True, True), (1, 2, "user", "z", True, True), (2, 0, "user", "x", True, False)]
    df = spark.createDataFrame(answers, "q int, place int, reviewer string, option string, confident boolean, valid boolean")
    assert rows(review.settled(df, "q", "place").filter("q = 1")) == [(1, "assistant", "y")]
    assert rows(review.applied_answers(df.filter("valid"), "q", "place").select("q", "option")) == [(1, "z")]


def test_greedy_bins_follow_the_order(spark):
    df = spark.createDataFrame([(g, i, n) for g in (1, 2) for i, n in enumerate([5, 6, 3, 20, 1])], "g int, i int, n int")
    got = rows(ordered.greedy_bins(df, "g", "i", "n", 10).select("g", "i", "bin"))
    assert [b for g, _, b in got if g == 1] == [0, 1, 1, 2, 3]


def test_agreement_pairs_use_each_read_once(spark):
    reads = [(1, 1, "A", "pump", "clean"), (1, 2, "A", "pump", "clean"), (1, 3, "B", "pump", "clean"), (1, 4, "C", "pump", "clean"), (2, 1, "A", "x1", "y"), (2, 2, "B", "x2", "y")]
    df = spark.createDataFrame(reads, "u long, ord long, read string, source_name string, target_name string")
    assert rows(ordered.agreement_pairs(df, "u", 0.8)) == [(1, 1, 3)]


def test_constraints_depend_on_the_order(spark):
    nodes = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "b")], "g long, k long, l string")
    pairs = spark.createDataFrame([(1, 2, 2, 3), (1, 1, 1, 2)], "g long, ord long, left_key long, right_key long")
    assert rows(ordered.constrained_groups(pairs, nodes, "g", "k", "l")) == [(1, 1, 1), (1, 2, 1), (1, 3, 3)]


def test_matching_is_optimal(spark):
    random.seed(5)
    edges = [(g, a, b, random.randrange(1, 9)) for g in range(12) for a in range(4) for b in range(4) if random.random() < 0.5]
    got = ordered.best_matching(spark.createDataFrame(edges, "g long, left_id long, right_id long, weight long"), "g").collect()
    for g in range(12):
        mine = [e[1:] for e in edges if e[0] == g]
        best = max(
            ((len(s), sum(w for _, _, w in s)) for n in range(5) for s in itertools.combinations(mine, n) if len({a for a, _, _ in s}) == n == len({b for _, b, _ in s})),
            default=(0, 0),
        )
        found = [r for r in got if r["g"] == g]
        assert (len(found), sum(r["weight"] for r in found)) == best
        assert len({r["left_id"] for r in found}) == len(found) == len({r["right_id"] for r in found})


def test_bootstrap_bound_is_below_the_estimate(spark):
    df = spark.createDataFrame([("x", f"c{i}", 5 + i % 4, 10) for i in range(30)], "s string, cluster string, h long, n long")
    got = ordered.cluster_bootstrap(df, "s", "h", "n", 300).first()
    assert got["lower"] < got["estimate"] < got["lower"] + 0.1
    assert got == ordered.cluster_bootstrap(df, "s", "h", "n", 300).first()


def test_edits(spark):
    rows_ = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (2, 1, "c")], "k int, ord int, value string")
    assert rows(edits.apply_field_edits(rows_, changes, "k", "v").select("k", "v", "changed")) == [(1, "a", False), (2, "c", True)]
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 3)], "s int, t int")
    assert rows(edits.degrees(links, "s", "t")) == [(1, 1, 1), (2, 2, 2), (3, 2, 2)]


def test_recall(spark):
    claims = spark.createDataFrame([("f", "b1", True), ("f", "b1", False), ("f", "b2", True)], "family string, branch string, found boolean")
    got = scoring.branch_recall(claims, "family", "branch").first()
    assert (got["branches"], got["hits"], got["claims"], got["found"]) == (2, 1, 3, 2)
