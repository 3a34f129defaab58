"""Edits, validation, parsing, selection, binding and facts on small literal inputs, or against brute force."""

import itertools
import json
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from graphwright import registry
from graphwright.functions import parsing, similar
from graphwright.operators import binding, edit_algebra, facts, graph, joins, ledger, ordered, selection, validation
from graphwright.plans.graph_edit_queries import ONTOLOGY
from graphwright.sources.tables import read_table


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def value(spark, expression, **columns):
    names = list(columns)
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(expression(*[F.col(n) for n in names])).first()[0]


# ---- text


def split_by_hand(text, longest):
    compact = " ".join(text.split())
    if len(compact) <= longest:
        return [compact]
    out, now = [], ""
    for sentence in re.split(r"(?<=[.!?;:])\s+", compact):
        if now and len(now) + len(sentence) + 1 > longest:
            out.append(now)
            now = sentence
        else:
            now = f"{now} {sentence}".strip()
    return out + ([now] if now else [])


def test_blocks_are_split_at_sentences(spark):
    rng = random.Random(3)
    texts = [" ".join("w" * rng.randrange(1, 9) + rng.choice(["", "", ".", ";", "!  "]) for _ in range(rng.randrange(60))) for _ in range(60)] + ["", "x" * 300, "a. " * 200]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", parsing.split_block(F.col("text"), 90).alias("p")).collect()
    for r in got:
        assert r["p"] == split_by_hand(texts[r["i"]], 90)


def test_pieces_of_all_documents(spark, small):
    texts = {r["doc_id"]: r["text"] for r in read_table(spark, small, "documents").collect()}
    got = Counter((r["doc_id"], r["piece"], r["chars"]) for r in registry.queries()["x07_block_pieces"](spark, small).collect())
    # white space beyond ASCII is none for the pattern
    plain = {i: re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ") for i, t in texts.items()}
    expected = Counter()
    for i, t in plain.items():
        pieces = split_by_hand(t, 700) if not re.search(r"[^\x00-\x7f]", t) else None
        if pieces is not None:
            expected.update((i, k, len(p)) for k, p in enumerate(pieces))
    assert expected and not expected - got


def test_parsing_expressions(spark):
    assert value(spark, parsing.page_numbers, t="11, 12–14,x, 3-2") == [11, 12, 13, 14, 3]
    assert value(spark, parsing.list_pieces, t="1. drain\n• fill 2) close") == ["drain", "fill", "close"]
    assert value(spark, parsing.matrix_numbers, t="E1 | 3 * 4 * 5 and 1;2 and 7, 8, 9") == [["3", "4", "5"], ["7", "8", "9"]]
    assert value(spark, parsing.plain_cells, t="Cause: worn  seal | Remedy (same as row above): replace |  ") == "worn seal | replace"
    assert value(spark, parsing.attested, t=" N/A ") is None and value(spark, parsing.attested, t=" seal ") == "seal"
    assert value(spark, lambda a: parsing.useful_headers(F.array(a, F.lit("Col2"))), a="col1") == []
    assert value(spark, lambda a: parsing.useful_headers(F.array(a, F.lit(""))), a=" Cause ") == ["Cause", ""]
    for text, good in (("doc_0123456789", True), ("Doc_0123456789", False), ("doc_12", False), (None, False)):
        assert value(spark, lambda a: parsing.is_opaque_id(a.cast("string")), a=text) is good
    for text, good in (("2024-02-29T10:00:00Z", True), ("2023-02-29T10:00:00Z", False), ("2024-02-29T10:00:00", False)):
        assert value(spark, parsing.is_utc_time, a=text) is good
    digest = value(spark, lambda a, b: parsing.canonical_digest(z=a, b=b, n=F.lit(None).cast("string")), a="é", b=3)
    import hashlib

    assert digest == hashlib.sha256(json.dumps({"b": 3, "n": None, "z": "é"}, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_name_similarity_against_the_rule():
    rng = random.Random(1)
    words = ["Pump", "seal", "up-stroke", "down-  stroke", "E-12", "E-13", "Ölstand", "ﬁlter", "(hot)", "-", "", "no. 4"]

    def by_rule(x, y):
        import unicodedata

        def plain(v):
            v = re.sub(r"(\w)-\s+(\w)", r"\1-\2", unicodedata.normalize("NFKC", v).casefold())
            return " ".join(re.sub(r"[^\w\s-]", " ", v).split()).strip(" -")

        a, b = plain(x), plain(y)
        if a == b:
            return 1.0
        if set(re.findall(r"\d+", a)) != set(re.findall(r"\d+", b)):
            return 0.0
        return max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, " ".join(sorted(a.split())), " ".join(sorted(b.split()))).ratio())

    for _ in range(3000):
        x, y = (" ".join(rng.sample(words, rng.randrange(1, 5))) for _ in "ab")
        assert similar.name_similarity(x, y) == pytest.approx(by_rule(x, y)), (x, y)


def test_name_similarity_query(spark, small):
    names = {r["p_partkey"]: r["p_name"] for r in read_table(spark, small, "part").collect()}
    for r in registry.queries()["x03_name_similarity"](spark, small).collect():
        assert r["score"] == similar.name_similarity(names[r["p_partkey"]], names[r["p_partkey"] + 1])


# ---- edits and validation


def test_node_additions(spark):
    nodes = spark.createDataFrame([("a", "Symptom")], "node_id string, type string")
    asked = spark.createDataFrame([(1, "n", "Symptom", "node_id"), (2, "n", "Symptom", "component"), (3, "n", "Symptom", "component"), (4, "a", "Symptom", "component"), (5, "r", "Asset", "component"), (6, "g", "Gadget", "component")], "ord int, node_id string, type string, field string")
    got = {r["ord"]: r["outcome"] for r in edit_algebra.node_additions(nodes, asked, ("Symptom", "Asset"), "Asset", ("component",)).collect()}
    assert got == {1: "RESERVED_FIELD", 2: "added", 3: "DUPLICATE_ID", 4: "DUPLICATE_ID", 5: "NODE_TYPE", 6: "NODE_TYPE"}


OCC = "edge_id string, occ_id string, segment string, condition string, trusted boolean, status string"


def test_occurrence_edits_and_decisions(spark):
    old = spark.createDataFrame([("e", "1", "p1.b1", None, True, "confirmed"), ("e", "2", "p1.b2", "if x", True, None), ("e", "3", "p1.b3", None, True, None), ("e", "4", "p1.b4", None, False, "rejected")], OCC)
    edits = spark.createDataFrame([("e", "1", "update", "p1.b1", None), ("e", "2", "update", "p1.b9", "if x"), ("e", "3", "delete", None, None), ("e", "4", "add", "p1.b1", None), ("e", "5", "add", "p9.b9", None), ("e", "6", "add", "p1.b1", "if y"), ("e", "7", "delete", None, None)], "edge_id string, occ_id string, op string, segment string, condition string")
    new = edit_algebra.occurrence_edits(old, edits, F.col("segment").startswith("p1."))
    got = {r["occ_id"]: (r["outcome"], r["segment"], r["trusted"], r["status"]) for r in new.collect()}
    assert got["1"] == ("unchanged", "p1.b1", True, "confirmed")
    assert got["2"] == ("updated", "p1.b9", False, None)
    assert got["3"][0] == "deleted" and got["4"][0] == "DUPLICATE_ID" and got["5"][0] == "SEGMENT_NOT_ALLOWED"
    assert got["6"] == ("added", "p1.b1", False, None) and got["7"][0] == "OCCURRENCE_NOT_FOUND"
    says = old.select("edge_id", "occ_id", edit_algebra.content_hash(F.col("edge_id"), F.col("segment"), F.col("condition")).alias("content_hash"))
    asked = says.withColumn("decision", F.lit("confirmed")).withColumn("content_hash", F.when(F.col("occ_id") == "4", "old").otherwise(F.col("content_hash")))
    out = {r["occ_id"]: r["outcome"] for r in edit_algebra.decided(old, new.filter("outcome <> 'deleted'"), asked).collect()}
    assert out == {"1": "confirmed", "2": "dropped", "3": "dropped", "4": "STALE_OCCURRENCE"}


def small_graph(spark, nodes, edges, occurrences):
    return validation.Graph(
        spark.createDataFrame(nodes, "node_id string, type string, name string, component string"),
        spark.createDataFrame([(f"{t}|{a}|{b}", t, a, b, d) for t, a, b, d in edges], "edge_id string, type string, source string, target string, derived boolean"),
        spark.createDataFrame(occurrences, OCC),
    )


NODES = [("R", "Asset", "m", None), ("Y", "Symptom", "hums", None), ("C", "FailureMode", "worn", "seal"), ("A", "CorrectiveAction", "replace", None)]
EDGES = [("MAY_INDICATE", "Y", "C", False), ("RESOLVED_BY", "C", "A", False)]
HELD = [("MAY_INDICATE|Y|C", "1", "p1.b1", None, True, None), ("RESOLVED_BY|C|A", "1", "p1.b1", "if a", True, None)]


def codes(spark, new, base=None):
    base = base or small_graph(spark, NODES, EDGES, HELD)
    return {(r["code"], r["id"], r["severity"], r["introduced"]) for r in validation.issues(new, base, ONTOLOGY).collect()}


def test_a_sound_graph_has_no_issue(spark):
    assert codes(spark, small_graph(spark, NODES, EDGES, HELD)) == set()


@pytest.mark.parametrize(
    ("nodes", "edges", "held", "expected"),
    [
        ([*NODES, ("R2", "Asset", "n", None)], EDGES, HELD, {("ROOT_COUNT", None, "error", True)}),
        ([*NODES, NODES[1]], EDGES, HELD, {("DUPLICATE_ID", "Y", "error", True)}),
        ([*NODES[:2], ("C", "FailureMode", " ", "seal"), NODES[3]], EDGES, HELD, {("REQUIRED_FIELD", "C", "error", True)}),
        ([*NODES[:2], ("C", "FailureMode", "worn", "unknown"), NODES[3]], EDGES, HELD, {("NOT_STATED", "C", "warning", True)}),
        (NODES, EDGES, [("MAY_INDICATE|Y|C", "1", "p1.b1", "if b", True, None), HELD[1]], {("NO_COMPATIBLE_ACTION_PATH", "Y", "warning", True)}),
        (NODES, EDGES[:1], HELD[:1], {("CAUSE_WITHOUT_ACTION", "C", "warning", True), ("ISOLATED_NODE", "A", "warning", True), ("NO_COMPATIBLE_ACTION_PATH", "Y", "warning", True)}),
        (NODES, [*EDGES, ("RESOLVED_BY", "Y", "A", False)], [*HELD, ("RESOLVED_BY|Y|A", "1", "p", None, True, None)], {("ENDPOINT_TYPE", "RESOLVED_BY|Y|A", "error", True)}),
        (NODES, [*EDGES, ("RESOLVED_BY", "C", "X", False)], [*HELD, ("RESOLVED_BY|C|X", "1", "p", None, True, None)], {("ORPHAN_EDGE", "RESOLVED_BY|C|X", "error", True)}),
        (NODES, EDGES, [*HELD, ("RESOLVED_BY|C|A", "2", None, None, False, None)], {("UNVERIFIED_CONTENT", "RESOLVED_BY|C|A", "warning", True), ("NO_EVIDENCE", "RESOLVED_BY|C|A", "warning", True)}),
        (NODES, EDGES, [HELD[0], ("RESOLVED_BY|C|A", "1", "p1.b1", "if a", True, "rejected")], {("CAUSE_WITHOUT_ACTION", "C", "warning", True), ("ISOLATED_NODE", "A", "warning", True), ("NO_COMPATIBLE_ACTION_PATH", "Y", "warning", True)}),
    ],
)
def test_issue_codes(spark, nodes, edges, held, expected):
    assert codes(spark, small_graph(spark, nodes, edges, held)) == expected


def test_old_issues_are_not_introduced(spark):
    bare = small_graph(spark, NODES, EDGES[:1], HELD[:1])
    assert all(not introduced for *_, introduced in codes(spark, bare, bare))


def test_component_sizes_against_brute_force(spark, small):
    from graphwright.operators import certify as C
    from graphwright.plans import staging as S

    edges = C.edges(C.assertions(S.proposals(spark, small, fine=True)))
    got = {(r["view"], r["component"]): (r["nodes"], r["largest"]) for r in registry.queries()["g06_weak_components"](spark, small).collect()}
    for view, keep in (("green", lambda t: t == "green"), ("all", lambda t: True)):
        root = {}

        def find(x, root=root):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for r in edges.collect():
            if keep(r["tier"]):
                a, b = sorted((find(r["source_name"]), find(r["target_name"])))
                root[b] = a
        sizes = Counter(find(x) for x in list(root))
        assert {c: n for (v, c), (n, _) in got.items() if v == view} == sizes
        best = min(sizes, key=lambda c: (-sizes[c], c))
        assert [c for (v, c), (_, top) in got.items() if v == view and top] == [best]


def test_similar_nodes_against_brute_force(spark, small):
    from graphwright.plans import graph_staging as GS

    nodes = {r["node_id"]: (r["type"], re.sub(r"[^\w]+", " ", r["name"].lower()).strip()) for r in GS.rows(spark, small, GS.NEW_NODE).collect()}
    first = {}
    for i in sorted(nodes):
        first.setdefault(nodes[i], i)
    expected = {tuple(sorted((first[a], first[b]))) for a, b in itertools.combinations(first, 2) if a[0] == b[0] and similar.name_similarity(a[1], b[1]) >= 0.9}
    got = {tuple(sorted((r["left_key"], r["right_key"]))) for r in registry.queries()["j16_similar_nodes"](spark, small).collect()}
    assert got == expected


# ---- joins and ledger


def test_nearest_sizes_against_brute_force(spark):
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 40):
        sizes = [(i, rng.randrange(30)) for i in range(n)]
        got = {r["id"]: (r["low"], r["high"], r["used"]) for r in ledger.nearest_sizes(spark.createDataFrame(sizes, "id int, n long"), "n", 2).collect()}
        for i, s in sizes:
            near = sorted((abs(t - s), t) for j, t in sizes if j != i)[:2]
            assert got[i] == ((min(t for _, t in near), max(t for _, t in near), len(near)) if near else (None, None, 0))


def test_remedy_overlap_against_brute_force(spark):
    rng = random.Random(6)
    actions = [("o", c, rng.randrange(12)) for c in range(40) for _ in range(rng.randrange(1, 7))]
    sets = {}
    for _, c, a in actions:
        sets.setdefault(c, set()).add(a)
    expected = sorted(("o", a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 2 and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]))
    assert sorted(rows(joins.remedy_overlap(spark.createDataFrame(actions, "origin string, cause int, action int"), 2, 0.6))) == expected


# ---- selection


def test_proportional_allocation_against_the_loop(spark):
    rng = random.Random(7)
    for total in (0, 5, 30, 500):
        sizes = {g: rng.randrange(30) for g in "abcdefg"}
        counts = {g: min(2, n) for g, n in sizes.items()}
        left = {g: n - counts[g] for g, n in sizes.items()}
        rest = total - sum(counts.values())
        while rest > 0 and any(left.values()):
            g = max(sorted(left), key=lambda k: left[k] / (counts[k] + 1))
            counts[g], left[g], rest = counts[g] + 1, left[g] - 1, rest - 1
        got = {r["group"]: r["taken"] for r in selection.proportional(spark.createDataFrame(list(sizes.items()), "group string, size long"), 2, total).collect()}
        assert got == counts


def test_natural_order(spark):
    cells = ["10", "9", " ", None, "b", "A", "-3", "1.5"]
    df = spark.createDataFrame([(c,) for c in cells], "c string").orderBy(*selection.natural_order(F.col("c")))
    assert [r["c"] for r in df.collect()][:6] == ["-3", "1.5", "9", "10", "A", "b"]


def test_most_common_prefers_the_first_seen(spark):
    df = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "b", 4), ("g", "a", 3), ("g", " ", 0), ("h", "", 1)], "g string, v string, o int")
    assert rows(selection.most_common(df, "g", F.col("v"), F.col("o"))) == [("g", "b"), ("h", None)]


# ---- binding


def parsed(spark, entities, relations, allowed=("p1.b1",)):
    text = json.dumps({"entities": entities, "relations": relations})
    df = spark.createDataFrame([(1, "A", text), (2, "A", "no object"), (3, "A", None)], "unit_id int, read string, answer string")
    out = binding.parse_answers(df, ("Symptom", "FailureMode", "CorrectiveAction"), F.array(*[F.lit(a) for a in allowed]))
    return [(r["relation_type"], r["source"]["name"], r["target"]["name"], r["how"], r["issue"]) for r in out.collect()]


def entity(key, kind, name, **more):
    return {"key": key, "type": kind, "name": name, "stated": True, "cite": [], **more}


def test_answers_are_parsed_and_repaired(spark):
    entities = [entity("y", "Symptom", " Pump   hums ", cite=["p1.b1", "p9.b9"]), entity("c", "FailureMode", "pump HUMS!"), entity("a", "CorrectiveAction", "replace"), entity("x", "Gadget", "x"), entity("", "Symptom", "x")]
    relations = [{"source": "y", "target": "c", "type": "RESOLVED_BY"}, {"source": "a", "target": "c", "type": "RESOLVED_BY", "cite": ["p1.b1"]}, {"source": "y", "target": "a", "type": "RESOLVED_BY"}, {"source": "y", "target": "x", "type": "MAY_INDICATE"}, {"source": "c", "target": "a", "type": "RESOLVED_BY"}]
    assert parsed(spark, entities, relations) == [
        ("MAY_INDICATE", "Pump hums", "Unspecified cause of pump hums", "repaired", None),
        ("RESOLVED_BY", "Unspecified cause of pump hums", "replace", "reversed", None),
        ("RESOLVED_BY", "Unspecified cause of pump hums", "replace", "exact", "MISSING_EVIDENCE"),
    ]


def test_references_prefer_the_coherent_side(spark):
    lines = spark.createDataFrame([(1, 5, 50, ["1", "2", "7"])], "unit_id int, row int, pos int, numbers array<string>")
    entries = spark.createDataFrame([(1, "1", "one", 60), (1, "2", "two", 70), (1, "1", "heading", 10)], "unit_id int, number string, entry string, pos int")
    assert rows(binding.numbered_references(lines, entries)) == [(1, 5, "1", "one", "resolved"), (1, 5, "2", "two", "resolved"), (1, 5, "7", None, "unresolved")]


def test_disagreements_split_a_relation(spark):
    relations = spark.createDataFrame([(1, True, "supported")], "relation_id int, agreement boolean, verdict string")
    proposals = spark.createDataFrame([(1, 0, "A", "up", "x", False), (1, 1, "B", "down", "x", True), (1, 2, "B", "up", "x", False)], "relation_id int, n int, read string, source_name string, target_name string, structure boolean")
    apart = spark.createDataFrame([("down", "up")], "left string, right string")
    assert rows(binding.split_disagreements(relations, proposals, apart)) == [(1, "", "AB", False, True, "supported"), (1, "s1", "B", True, False, None)]


def test_judges_need_a_rationale_and_both_cites(spark):
    schema = "pair_id int, ord int, answer string, rationale string, cites array<string>, left_cites array<string>, right_cites array<string>"
    pairs = [(1, 1, "same", "yes", ["a", "b"], ["a"], ["b"]), (2, 2, "same", " ", ["a", "b"], ["a"], ["b"]), (3, 3, "same", "yes", ["a"], ["a"], ["b"]), (4, 4, "different", None, [], [], []), (5, 5, "perhaps", "", [], [], []), (6, 6, "same", "yes", ["a", "b"], ["a"], ["b"])]
    got = dict(rows(binding.judged_pairs(spark.createDataFrame(pairs, schema), 5)))
    assert got == {1: "same", 2: "unsure", 3: "unsure", 4: "different", 5: "unsure", 6: "deferred"}


# ---- facts


def test_fact_metrics(spark):
    gold = spark.createDataFrame([("g1", "f"), ("g2", "f"), ("g3", "h")], "fact_id string, family string")
    pred = spark.createDataFrame([("p1", "f", None, True, True), ("p2", "f", "UNSUPPORTED", True, True), ("p3", "f", None, True, True), ("p4", "h", "UNKNOWN", True, True)], "fact_id string, family string, judgment string, in_scope boolean, exhaustive boolean")
    matching = spark.createDataFrame([("g1", "p1")], "gold_fact string, pred_fact string")
    got = {r["family"]: r.asDict() for r in facts.fact_metrics(gold, pred, matching, "family").collect()}
    assert (got["f"]["tp"], got["f"]["fp"], got["f"]["fn"], got["f"]["precision"], got["f"]["recall"], got["f"]["f1"]) == (1, 2, 1, 0.333333, 0.5, 0.4)
    assert (got["h"]["tp"], got["h"]["unjudged"], got["h"]["precision"], got["h"]["recall"], got["h"]["f1"]) == (0, 1, None, 0.0, None)


def test_a_full_list_replaces_and_others_improve(spark):
    events = spark.createDataFrame([(1, 1, "a", 0, False), (1, 2, "b", 1, True), (1, 3, "b", 2, False), (1, 4, "c", 1, False), (1, 5, "c", 0, False), (2, 1, "z", 2, False)], "run_id int, seq int, edge string, rank int, full boolean")
    assert rows(facts.lists_over_time(events)) == [(1, "b", 1, 3), (1, "c", 0, 5), (2, "z", 2, 1)]


def test_roots_and_ties(spark):
    types = spark.createDataFrame([("A",), ("B",), ("C",)], "type string")
    one = spark.createDataFrame([("A", "C")], "domain string, range string")
    assert rows(facts.ontology_roots(types, one, 3)) == [("A", 1, True), ("B", 0, False)]
    tie = spark.createDataFrame([("A", "C"), ("B", "C")], "domain string, range string")
    assert rows(facts.ontology_roots(types, tie, 3)) == [("A", 1, False), ("B", 1, False)]


def test_matching_raises_on_no_end_and_is_optimal(spark):
    rng = random.Random(9)
    edges = [(g, a, b, rng.randrange(1, 9)) for g in range(6) for a in range(4) for b in range(4) if rng.random() < 0.5]
    got = ordered.best_matching(spark.createDataFrame(edges, "g int, left_id int, right_id int, weight long"), "g").collect()
    for g in range(6):
        mine = [e for e in edges if e[0] == g]
        best = max((len(c), sum(e[3] for e in c)) for k in range(5) for c in itertools.combinations(mine, k) if len({e[1] for e in c}) == len({e[2] for e in c}) == k)
        found = [r for r in got if r["g"] == g]
        assert (len(found), sum(r["weight"] for r in found)) == best


def test_reconnection_needs_a_single_problem(spark):
    orphans = spark.createDataFrame([("c1", 1), ("c2", 2), ("c3", 9)], "cause string, page int")
    known = spark.createDataFrame([("y1", 1), ("y1", 1), ("y1", 2), ("y2", 2)], "problem string, page int")
    assert rows(graph.reconnected(orphans, known, ["page"])) == [("c1", "y1")]
