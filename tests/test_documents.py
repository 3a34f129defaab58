"""Whole documents as sources, routes, pairs, restated causes and recomputed graphs, against loops and literal cases."""

import json
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from graphwright.functions.similar import name_similarity
from graphwright.operators import edit_algebra, guards, scoring
from graphwright.operators.binding import restated
from graphwright.plans import document_queries as Q
from graphwright.plans.graph_edit_queries import ONTOLOGY, new_graph
from graphwright.sources import documents as D
from graphwright.sources.tables import read_table

SHEET = """# Annotazione
Annotatore: A. Writer
- Data: 2026-09-28
Tempo impiegato (minuti): 40
Pagine annotate (tutte le pagine, per esempio 45-52, 60): 11, 12–13

## Istruzioni
- problema: not this one

## Rami

### Ramo R1
- problema: Pump fails | ID: p11.t1.r2
- codice:
- causa: Restricted air supply | ID: p11.t1.r2
- azione: Clear the line | tipo: riparazione | ID: p11.t1.r2
- azione: Check the regulator | Tipo: Controllo | id: p11.t1.r2, p11.b6
- componente:  | ID:
- condizioni: if cold

### Ramo R2
- problema: Alarm 7 | ID: p12.b3
- codice: 7
- causa: Non indicata nel manuale | ID: p1.b1
- azione: Call service | ID: p12.x

### Ramo R3
- problema: Noise
- azione:  | tipo: riparazione

### Ramo R4
- problema:  | ID: p1.b1
- causa: none

## End
- problema: no
"""


def test_a_sheet(spark):
    texts = spark.createDataFrame([(1, SHEET), (2, None), (3, "no sheet")], "k int, text string")
    headers, claims, problems = D.sheets(texts, "k", "text")
    assert {r["k"]: (r["annotator"], r["date"], r["minutes"], r["pages"]) for r in headers.collect()} == {1: ("A. Writer", "2026-09-28", "40", [11, 12, 13]), 2: ("", "", "", []), 3: ("", "", "", [])}
    got = {r["claim_id"]: r for r in claims.collect()}
    assert {k: r["action_kind"] for k, r in got.items()} == {"R1.1": "repair", "R1.2": "inspection", "R2.1": "", "R3.1": ""}
    assert (got["R1.2"]["failure"], got["R1.2"]["failure_stated"], got["R1.2"]["action_segments"], got["R1.2"]["conditions"]) == ("Restricted air supply", True, ["p11.t1.r2", "p11.b6"], "if cold")
    assert (got["R2.1"]["failure"], got["R2.1"]["failure_stated"], got["R2.1"]["failure_segments"], got["R2.1"]["code"]) == ("", False, [], "7")
    assert (got["R3.1"]["action"], got["R3.1"]["failure_stated"]) == ("", False)
    assert {(r["k"], r["branch_id"], r["problem"], r["detail"]) for r in problems.collect()} == {
        (1, "R2", "UNKNOWN_ID", "p12.x"), (1, "R2", "NO_KIND", "Call service"), (1, "R3", "NO_CAUSE", ""), (1, "R3", "NO_PROBLEM_ID", ""), (2, "", "NO_PAGES", ""), (3, "", "NO_PAGES", ""),
    }


def test_all_sheets_against_a_loop(spark, small):
    claims, problems = Counter(), Counter()
    for key, text in Q.sheet_texts(spark, small).collect():
        if not re.search(r"Pagine[^\n]*: [0-9]", text):
            problems[key, "", "NO_PAGES", ""] += 1
        for block in text.split("## Rami")[1].split("### Ramo ")[1:]:
            branch, *lines = block.strip().split("\n")
            fields = defaultdict(list)
            for line in lines:
                label, _, rest = line.removeprefix("- ").partition(":")
                first, *more = [p.strip() for p in rest.split("|")]
                named = {p.split(":")[0].lower(): p.partition(":")[2].strip() for p in more}
                fields[label].append((first, [i.strip() for i in named.get("id", "").split(",") if i.strip()], D.SHEET_KINDS.get(named.get("tipo", "").lower(), "")))
            problem, cause = fields["problema"][0], fields["causa"][0]
            if not problem[0]:
                continue
            if not cause[0]:
                problems[key, branch, "NO_CAUSE", ""] += 1
            if not problem[1]:
                problems[key, branch, "NO_PROBLEM_ID", ""] += 1
            stated = bool(cause[0]) and cause[0].lower() != D.NOT_STATED
            for i in problem[1] + cause[1] + [i for a in fields["azione"] for i in a[1]]:
                if not re.match(D.SEGMENT_ID, i):
                    problems[key, branch, "UNKNOWN_ID", i] += 1
            for n, (action, ids, kind) in enumerate(fields["azione"] or [("", [], "")], 1):
                claims[key, f"{branch}.{n}", problem[0], cause[0] if stated else "", stated, action, kind, tuple(ids), fields["componente"][0][0]] += 1
                if action and not kind:
                    problems[key, branch, "NO_KIND", action] += 1
    rows = Q.sheet_claims(spark, small).collect()
    assert Counter((r["l_orderkey"], r["claim_id"], r["indicator"], r["failure"], r["failure_stated"], r["action"], r["action_kind"], tuple(r["action_segments"]), r["component"]) for r in rows) == claims
    assert Counter(tuple(r) for r in Q.sheet_problems(spark, small).collect()) == problems and len({p[2] for p in problems}) >= 4
    again = Q.gold_claims(spark, small)
    assert Counter(map(str, again.select(*rows[0].__fields__).collect())) == Counter(map(str, rows))
    assert D.gold_files(spark.createDataFrame([(1, "no json"), (2, None), (3, "{}")], "k int, t string"), "k", "t").count() == 0


def roots_by_hand(text):
    try:
        data = json.loads(text)
    except ValueError:
        return None, "NOT_JSON"
    steps = defaultdict(set)
    for r in data["relations"]:
        steps[r["domain"]].add(r["range"])
    led = {t for s in steps.values() for t in s}

    def reach(start):
        seen, todo = {start}, [start]
        while todo:
            for t in steps[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return len(seen)

    reached = sorted(((reach(n["name"]), n["name"]) for n in data["nodes"] if n["name"] not in led), reverse=True)
    if not reached or len(reached) > 1 and reached[0][0] == reached[1][0]:
        return None, "NO_UNIQUE_ROOT"
    return reached[0][1], "READ"


def test_ontologies_against_a_loop(spark, small):
    texts = Q.ontology_texts(spark, small)
    expected = {key: roots_by_hand(text) for key, text in texts.collect()}
    got = {r["n_nationkey"]: (r["root"], r["status"]) for r in D.ontologies(texts, "n_nationkey", "text").roots.collect()}
    assert got == expected and {"READ", "NOT_JSON"} <= {s for _, s in expected.values()}
    rows = Q.ontology_types(spark, small).collect()
    named = {(k, n["name"]): n for k, t in texts.collect() if expected[k][1] != "NOT_JSON" for n in json.loads(t)["nodes"]}
    assert {(r["n_nationkey"], r["type"]) for r in rows if r["type"]} == set(named)
    assert all(r["properties"] == len(named[r["n_nationkey"], r["type"]]["properties"]) for r in rows if r["type"])
    tie = json.dumps({"nodes": [{"name": "A"}, {"name": "B"}, {"name": "C"}], "relations": [{"name": "x", "domain": "A", "range": "C"}, {"name": "y", "domain": "B", "range": "C"}]})
    found = D.ontologies(spark.createDataFrame([(1, tie), (2, None), (3, '{"nodes": [], "relations": []}')], "k int, t string"), "k", "t").roots.collect()
    assert {r["k"]: r["status"] for r in found} == {1: "NO_UNIQUE_ROOT", 2: "NOT_JSON", 3: "NO_UNIQUE_ROOT"}


def test_routes_and_the_map(spark):
    pages = [(1, 9, 5, True, False, 0.1, 0, 0, False), (2, 3, 3, False, False, 0.9, 60, 1, False), (3, 0, 0, False, False, 0.0, 0, 0, True), (4, 3, 0, True, True, None, None, None, None)]
    df = spark.createDataFrame(pages, "page int, segments int, short int, table boolean, complex_table boolean, image_share double, drawings int, images int, unreadable boolean")
    got = {r["page"]: (r["reasons"], r["routes"]) for r in guards.page_routes(df, 0.8, 50).collect()}
    assert got == {
        1: (["SHORT_BLOCK_LAYOUT"], ["TEXT", "TABLE", "VISUAL_REVIEW"]), 2: (["IMAGE_AREA_CANDIDATE", "DRAWING_DENSITY_CANDIDATE"], ["TEXT", "VISUAL_REVIEW"]),
        3: (["NATIVE_TEXT_UNREADABLE"], ["OCR_REVIEW"]), 4: (["COMPLEX_TABLE"], ["TEXT", "TABLE", "VISUAL_REVIEW"]),
    }
    known = spark.createDataFrame([(1, "other", False, ["a"]), (2, "other", False, None), (3, "parts", True, ["b"])], "page int, label string, confirmed boolean, evidence array<string>")
    routes = spark.createDataFrame([(1, "DIAGNOSTIC", ["c", "a"]), (2, "UNRESOLVED", ["d"])], "page int, relevance string, evidence array<string>")
    rows = {r["page"]: (r["label"], r["confirmed"], r["evidence"], r["unresolved"]) for r in guards.routed_map(known, routes, ["page"]).collect()}
    assert rows == {1: ("diagnostic", True, ["a", "c"], False), 2: ("other", False, None, True), 3: ("parts", True, ["b"], False)}


def test_restated_causes(spark, small):
    parts = {r["p_partkey"]: r for r in read_table(spark, small, "part").collect()}
    got = {r["p_partkey"]: r["restated"] for r in Q.restated_causes(spark, small).collect()}
    assert len(got) == len(parts) and {True, False} == set(got.values())
    for k, r in parts.items():
        target = r["p_name"] + "s" if k % 3 == 0 else f"{r['p_name']} {k % 2}" if k % 3 == 1 else r["p_type"]
        assert got[k] == (k % 5 != 0 and name_similarity(r["p_name"], target) >= 0.9)
    odd = restated(spark.createDataFrame([(None, None, "FailureMode"), ("a", "a", None)], "source_name string, target_name string, target_type string")).collect()
    assert [r["restated"] for r in odd] == [True, False]


def test_gold_relations(spark):
    claims = [("c1", "No power", "Fuse", "Replace", "if hot", ["s1"], ["s1", "s2"], ["s3"]), ("c2", "Noise", "", "", None, ["s4"], None, None)]
    df = spark.createDataFrame(claims, "claim_id string, indicator string, failure string, action string, conditions string, indicator_segments array<string>, failure_segments array<string>, action_segments array<string>")
    got = {(r["claim_id"], r["kind"]): (r["left"], r["right"], sorted(r["segments"]), r["conditions"]) for r in scoring.gold_relations(df).collect()}
    assert got == {("c1", "indicator"): ("No power", "Fuse", ["s1", "s2"], "if hot"), ("c1", "action"): ("Fuse", "Replace", ["s1", "s2", "s3"], "if hot"), ("c2", "indicator"): ("Noise", "", ["s4"], "")}


def test_recomputed_graph_against_a_loop(spark, small):
    graph = new_graph(spark, small)
    nodes = {r["node_id"]: r["type"] for r in graph.nodes.select("node_id", "type").collect()}
    occurrences = defaultdict(list)
    for r in Q.graded(graph.occurrences).collect():
        occurrences[r["edge_id"]].append(r)
    touched = {r["edge_id"] for r in Q.touched_edges(graph.edges).collect()}
    hashed = {(r["edge_id"], r["segment"], r["condition"]): r["h"] for r in graph.occurrences.select("edge_id", "segment", "condition", edit_algebra.content_hash(F.col("edge_id"), F.col("segment"), F.col("condition")).alias("h")).collect()}
    expected, met = {}, defaultdict(list)
    rows = graph.edges.collect()
    for e in {(r["edge_id"], r["type"], r["source"], r["target"]) for r in rows if not r["derived"]}:
        mine = [o for o in occurrences[e[0]] if o["status"] != "rejected"]
        ok = [o["tier"] == "green" or (o["status"] == "confirmed" and o["review_hash"] == hashed[o["edge_id"], o["segment"], o["condition"]]) for o in mine]
        tier = next((t for t in ("green", "yellow") if any(o["tier"] == t for o in mine)), None)
        common = [mine[0]["condition"]] if mine and mine[0]["condition"] and all(o["condition"] == mine[0]["condition"] for o in mine) else []
        expected[e] = (False, any(ok), tier, common if e[0] in touched else None)
        for n in {e[2], e[3]}:
            met[n].append((any(ok), tier))
    roots = [n for n, t in nodes.items() if t == ONTOLOGY.root]
    old = {}
    for r in sorted(rows, key=lambda r: r["edge_id"]):
        if r["derived"]:
            old.setdefault((r["type"], r["source"], r["target"]), r["edge_id"])
    told = Q.recomputed_graph(spark, small).collect()
    got, made = ({(r["edge_id"], r["type"], r["source"], r["target"]): (r["derived"], r["trusted"], r["tier"], r["conditions"]) for r in told if r["derived"] == d} for d in (False, True))
    assert len(got) + len(made) == len(told)
    assert len(roots) == 1
    links = {(name, roots[0], n) for name, d, t in ONTOLOGY.relations if d == ONTOLOGY.root for n, kind in nodes.items() if kind == t}
    assert got == expected
    assert {k[1:] for k in made} == links
    for k, v in made.items():
        near = met[k[3]]
        assert v[1:3] == (any(t for t, _ in near), next((t for t in ("green", "yellow") if any(x == t for _, x in near)), None))
        assert old.get(k[1:], k[0]) == k[0] and (k[1:] in old or k[0].startswith("v3e_"))


def test_property_issues_against_a_loop(spark, small):
    from graphwright.operators import validation
    from graphwright.plans import graph_staging as GS

    new, old = (Q.described(GS.rows(spark, small, t).distinct(), e).collect() for t, e in ((GS.NEW_NODE, True), (GS.NODE, False)))
    before = {r["node_id"]: r["properties"] for r in old}
    kinds = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "array": list}
    expected = Counter()
    for node in new:
        for type_, field, kind, items in Q.FIELDS:
            if type_ != node["type"]:
                continue
            raw = node["properties"].get(field)
            try:
                value = json.loads(raw) if raw is not None else None
                bad = False
            except ValueError:
                value, bad = None, True
            fresh = node["node_id"] not in before or before[node["node_id"]].get(field) != raw
            if field.endswith("_id") and value != node["node_id"]:
                expected["CANONICAL_ID", node["node_id"], field, fresh] += 1
            if field == "name" and raw is not None and value != node["name"]:
                expected["CANONICAL_NAME", node["node_id"], field, fresh] += 1
            fits = isinstance(value, kinds[kind]) and (kind == "boolean" or not isinstance(value, bool)) and (kind != "array" or items != "string" or all(isinstance(v, str) for v in value))
            if bad or value is not None and not fits:
                expected["VALUE_TYPE", node["node_id"], field, fresh] += 1
    got = Counter((r["code"], r["id"], r["field"], r["introduced"]) for r in Q.property_issues(spark, small).collect())
    assert got == expected and {k[0] for k in got} == {"CANONICAL_ID", "CANONICAL_NAME", "VALUE_TYPE"} and {k[3] for k in got} == {True, False}
    schema = "node_id string, type string, name string, properties map<string,string>"
    odd = spark.createDataFrame([("a", "T", None, None), ("b", None, "b", {}), ("c", "T", "c", {"size": "null"})], schema)
    fields = spark.createDataFrame([("T", "size", "integer", None)], "type string, field string, kind string, items string")
    assert validation.property_issues(odd, odd, fields).count() == 0


def test_record_violations(spark):
    from graphwright.operators import validation as V

    units = spark.createDataFrame([("u1", ["a", "b"], ["c"]), ("u2", ["b", "d", "d"], ["d"]), ("u3", None, ["a"]), ("u4", ["e"], None)], "unit_id string, owned array<string>, context array<string>")
    assert {tuple(r) for r in V.unit_violations(units).collect()} == {("u1", "OWNED_TWICE", "b"), ("u2", "OWNED_TWICE", "b"), ("u2", "OWNED_AND_CONTEXT", "d"), ("u3", "OWNS_NOTHING", None)}
    rows = [(1, ["e"], ["structure", "verifier"], "supported", None, None), (2, [], ["structure", "structure"], "unclear", None, None), (3, ["e"], ["verifier"], None, "human", "human"), (4, None, None, "supported", None, None), (5, ["e"], ["reviewer"], "unclear", "agent", None)]
    got = V.certificate_violations(spark.createDataFrame(rows, "assertion_id int, evidence array<string>, witnesses array<string>, verdict string, confirmed_by string, rejected_by string")).collect()
    assert {tuple(r) for r in got} == {(2, "NO_EVIDENCE"), (2, "WITNESS_TWICE"), (3, "VERIFIER_WITHOUT_SUPPORT"), (3, "REVIEWER_WITHOUT_NAME"), (3, "CONFIRMED_AND_REJECTED"), (4, "NO_EVIDENCE"), (4, "VERIFIER_WITHOUT_SUPPORT")}
    asked = [(1, "merge", "Same part? ", ["yes", "no"], "no", "s"), (2, "merge", "Same part", ["yes", "yes", "no"], "fix", None), (3, "name", "Which name?", ["fix", "keep"], "fix", ""), (4, None, None, None, None, None)]
    found = V.question_violations(spark.createDataFrame(asked, "question_id int, kind string, title string, options array<string>, default string, source string"), {"merge": ("yes", "no"), "name": ("keep", "fix")}, ("fix",), ("merge",)).collect()
    assert {tuple(r) for r in found} == {(2, "NO_QUESTION"), (2, "WRONG_OPTIONS"), (2, "WRONG_DEFAULT"), (2, "NO_SOURCE"), (3, "WRONG_DEFAULT"), (4, "NO_QUESTION"), (4, "WRONG_OPTIONS"), (4, "WRONG_DEFAULT")}


def test_remedies_in_context_against_a_loop(spark, small):
    causes, remedies = (df.collect() for df in Q.inherited_rows(spark, small))
    at = defaultdict(list)
    for r in sorted(remedies, key=lambda r: r["ord"]):
        kept = at[r["unit_id"], r["row"]]
        if not any(name_similarity(r["action"], o["action"]) >= 0.75 and (r["context"] or "") == (o["context"] or "") for o in kept):
            kept.append(r)
    have = {(r["unit_id"], r["cause"], r["action"], r["context"] or "") for r in remedies}
    fresh = {}
    for c in {tuple(c) for c in causes}:
        unit, row, origin, cause = c
        for o in at[unit, origin] if origin < row else ():
            key = (unit, cause, o["action"], o["context"] or "")
            if key not in have:
                fresh[key] = min(fresh.get(key, (row, o["ord"])), (row, o["ord"]))
    expected = set()
    units = defaultdict(list)
    for (unit, cause, action, context), (row, order) in fresh.items():
        units[unit].append((row, cause, order, action, context))
    for unit, mine in units.items():
        expected |= {(unit, row, cause, action, context) for row, cause, _, action, context in sorted(mine)[:20]}
    got = Q.remedies_with_context(spark, small).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected) > 100
