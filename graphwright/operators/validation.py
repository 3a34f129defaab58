"""Validation of an edited graph against its base: issues by code, and what they ask of the editor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.plans.checkpoints import cut

PROBLEMS, CAUSES = ("Symptom", "ErrorCode"), ("MAY_INDICATE", "INDICATES")


@dataclass
class Ontology:
    """Types of nodes, relations (name, domain, range), the root's type, and the required field of each type that has one."""

    types: tuple[str, ...]
    relations: tuple[tuple[str, str, str], ...]
    root: str
    required: dict[str, str]


@dataclass
class Graph:
    """nodes(node_id, type, name, ..), edges(edge_id, type, source, target, derived), occurrences(edge_id, occ_id, segment, condition, trusted, status).

    said: the edges and occurrences for what only asks whether there is one, where rows may be repeated;
    dealt: whether the occurrences are dealt by edge, to as many tasks as those of the other graph.
    """

    nodes: DataFrame
    edges: DataFrame
    occurrences: DataFrame
    said: tuple[DataFrame, DataFrame] | None = None
    dealt: bool = False

    def active_edges(self) -> DataFrame:
        """Underived edges with an occurrence that isn't rejected."""
        live = self.occurrences.filter("status is null or status <> 'rejected'").select("edge_id").distinct()
        return self.edges.filter("not derived").join(live, "edge_id", "left_semi")


def compatible_paths(graph: Graph) -> DataFrame:
    """node_id of problems with a path of a cause and an action whose conditions are missing on a side or equal."""
    live = graph.occurrences.filter("status is null or status <> 'rejected'").groupBy("edge_id").agg(
        F.bool_or(F.col("condition").isNull()).alias("free"), F.collect_set("condition").alias("conditions")
    )
    edges = graph.edges.filter("not derived").join(live, "edge_id")
    first = edges.filter(F.col("type").isin(*CAUSES)).select(F.col("source").alias("node_id"), F.col("target").alias("cause"), F.col("free").alias("f1"), F.col("conditions").alias("c1"))
    second = edges.filter("type = 'RESOLVED_BY'").groupBy(F.col("source").alias("cause")).agg(F.bool_or("free").alias("f2"), F.array_distinct(F.flatten(F.collect_set("conditions"))).alias("c2"))
    fits = F.col("f1") | F.col("f2") | F.arrays_overlap("c1", "c2")
    return first.join(second, "cause").filter(fits).select("node_id").distinct()


def _ends(graph: Graph) -> DataFrame:
    """(node_id, role, other, condition), each once: what the active edges say about their ends.

    resolves: a RESOLVED_BY edge leaves the node, under the condition; causes: an edge to a cause leaves
    it; reached: such an edge comes to it from the node other, under the condition; end: any other end.
    """
    edges, occurrences = graph.said or (graph.edges, graph.occurrences)
    live = occurrences.filter("status is null or status <> 'rejected'").select("edge_id", "condition")
    hops = edges.filter("not derived").select("edge_id", "type", "source", "target").join(live, "edge_id")
    none = F.lit(None).cast("string")
    end = lambda node, role, other, condition: F.struct(F.col(node).alias("node_id"), F.lit(role).alias("role"), other.alias("other"), condition.alias("condition"))
    solved, cause = F.col("type") == "RESOLVED_BY", F.col("type").isin(*CAUSES)
    first = F.when(solved, end("source", "resolves", none, F.col("condition"))).when(cause, end("source", "causes", none, none)).otherwise(end("source", "end", none, none))
    second = F.when(cause, end("target", "reached", F.col("source"), F.col("condition"))).otherwise(end("target", "end", none, none))
    return hops.select(F.explode(F.array(first, second)).alias("e")).select("e.*").distinct()


def node_facts(graph: Graph) -> DataFrame:
    """(node_id, incident, resolved, caused, path): what the active edges of each node that has any come to.

    path: an edge to a cause that has an action, the conditions of both missing on a side or equal.
    """
    ends = cut(_ends(graph))
    facts = ends.groupBy("node_id").agg(F.bool_or(F.col("role") == "resolves").alias("resolved"), F.bool_or(F.col("role") == "causes").alias("caused"))
    reached = ends.filter("role = 'reached'").select("node_id", "other", F.col("condition").alias("c1"))
    resolves = ends.filter("role = 'resolves'").groupBy("node_id").agg(F.bool_or(F.col("condition").isNull()).alias("free"), F.collect_set("condition").alias("c2"))
    paths = reached.join(resolves, "node_id").filter("c1 is null or free or array_contains(c2, c1)").select(F.col("other").alias("node_id"), F.lit(True).alias("path")).distinct()
    return facts.join(paths, "node_id", "left").select("node_id", F.lit(True).alias("incident"), "resolved", "caused", F.coalesce("path", F.lit(False)).alias("path"))


def _occurrence_issues(graph: Graph, base: Graph) -> DataFrame:
    """(code, kind, id, field, severity, introduced) of the occurrences of underived edges, and of such edges without any."""
    # contents as texts that tell null from empty; of a repeated occurrence the least one counts
    fields = ("segment", "condition", F.col("trusted").cast("string"), "status")
    content = F.concat_ws("|", *[F.when(F.col(f).isNull() if isinstance(f, str) else f.isNull(), "0").otherwise(F.concat(F.lit("1"), f)) for f in fields])
    sure = lambda test: F.coalesce(test, F.lit(False))
    live = sure(F.expr("status is null or status <> 'rejected'"))
    none = F.lit(None)
    now = graph.occurrences.select("edge_id", "occ_id", F.lit(0).alias("was"), content.alias("content"), (live & sure(~F.col("trusted"))).alias("untrusted"), (live & F.col("segment").isNull()).alias("unplaced"))
    before = base.occurrences.select("edge_id", "occ_id", F.lit(1).alias("was"), content.alias("content"), none.cast("boolean").alias("untrusted"), none.cast("boolean").alias("unplaced"))
    # old and new rows of an occurrence meet where its edge does
    same = Window.partitionBy("edge_id", "occ_id")
    both = now.unionByName(before)
    rows = (both if graph.dealt and base.dealt else both.repartition("edge_id")).select(
        "*", F.row_number().over(same.orderBy("was")).alias("n"), F.count_if(F.col("was") == 0).over(same).alias("times"), F.when(F.col("occ_id").isNotNull(), F.min(F.when(F.col("was") == 1, F.col("content"))).over(same)).alias("old")
    )
    moved = ~F.col("content").eqNullSafe(F.col("old"))
    rows = rows.filter("was = 0").select("edge_id", F.lit(True).alias("held"), (F.col("n") == 1).alias("first"), "times", "untrusted", "unplaced", moved.alias("moved"))
    mine = graph.edges.filter("not derived").groupBy("edge_id").agg(F.count(F.lit(1)).alias("edges"))
    issue = lambda code, times, field, severity, introduced: F.struct(F.lit(code).alias("code"), times.alias("times"), F.lit(field).cast("string").alias("field"), F.lit(severity).alias("severity"), introduced.alias("introduced"))
    once, edges, yes = F.lit(1).cast("long"), F.col("edges"), F.lit(True)
    found = F.array_compact(F.array(
        F.when(F.col("held").isNull(), issue("NO_OCCURRENCES", edges, None, "error", yes)),
        F.when(F.col("first") & (F.col("times") * edges > 1), issue("DUPLICATE_ID", once, "occurrence", "error", yes)),
        F.when(F.col("untrusted"), issue("UNVERIFIED_CONTENT", edges, None, "warning", F.col("moved"))),
        F.when(F.col("unplaced"), issue("NO_EVIDENCE", edges, None, "warning", F.col("moved"))),
    ))
    met = mine.join(rows, "edge_id", "left").select("edge_id", F.explode(found).alias("i"))
    # an issue comes once for each edge of the id
    each = met.select("edge_id", "i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("i.times"))))
    return each.select("i.code", F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), "i.field", "i.severity", "i.introduced")


def issues(graph: Graph, base: Graph, ontology: Ontology) -> DataFrame:
    """(code, kind, id, field, severity, introduced): one row for each finding.

    introduced tells findings that the edits brought from those that the base had. Similar names are
    a query of their own, since they need a function beyond SQL.
    """
    no, yes = F.lit(False), F.lit(True)

    def found(rows: DataFrame, code: str | Column, kind: str, key: str, introduced: Column = yes, error: bool | Column = False, field: str | None = None) -> DataFrame:
        severity = F.when(error if isinstance(error, Column) else F.lit(error), "error").otherwise("warning")
        code = code if isinstance(code, Column) else F.lit(code)
        return rows.select(code.alias("code"), F.lit(kind).alias("kind"), F.col(key).alias("id"), F.lit(field).cast("string").alias("field"), severity.alias("severity"), introduced.alias("introduced"))

    # nodes are few beside edges and occurrences, which are read as they come
    nodes, edges = cut(graph.nodes), graph.edges
    out = []
    for rows, key, kind in ((nodes, "node_id", "node"), (edges, "edge_id", "edge")):
        out.append(found(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "DUPLICATE_ID", kind, key, error=True))
    roots = nodes.agg(F.count_if(F.col("type") == ontology.root).alias("n")).filter("n <> 1").select(F.lit(None).cast("string").alias("id"))
    out.append(found(roots, "ROOT_COUNT", "graph", "id", error=True))

    # nodes against what they were, and against their edges now and before
    old = base.nodes.groupBy("node_id").agg(F.min("component").alias("old_component"), F.lit(True).alias("was"))
    now = node_facts(graph)
    before = node_facts(base).select("node_id", *[F.col(c).alias(f"old_{c}") for c in ("incident", "resolved", "caused", "path")])
    every = cut(nodes.join(old, "node_id", "left").join(now, "node_id", "left").join(before, "node_id", "left"))
    flag = lambda c: F.coalesce(F.col(c), no)
    new = F.col("was").isNull()
    typed = every.filter(F.col("type").isin(*ontology.types))
    out.append(found(every.filter(~F.col("type").isin(*ontology.types)), "NODE_TYPE", "node", "node_id", error=True))
    out.append(found(typed.filter("name is null or trim(name) = ''"), "REQUIRED_FIELD", "node", "node_id", error=True, field="name"))
    for of, field in ontology.required.items():
        stated = F.lower(F.col(field)).isin("not_stated", "unknown")
        unfilled = typed.filter(F.col("type") == of).filter(F.col(field).isNull() | (F.trim(field) == "") | stated)
        changed = new | ~F.col(field).eqNullSafe(F.col(f"old_{field}"))
        code = F.when(F.coalesce(stated, no), "NOT_STATED").otherwise("REQUIRED_FIELD")
        out.append(found(unfilled, code, "node", "node_id", changed, changed & ~F.coalesce(stated, no), field))
    out.append(found(typed.filter(~flag("incident")).filter(F.col("type") != ontology.root), "ISOLATED_NODE", "node", "node_id", new | flag("old_incident")))
    out.append(found(typed.filter((F.col("type") == "FailureMode") & ~flag("resolved")), "CAUSE_WITHOUT_ACTION", "node", "node_id", new | flag("old_resolved")))
    problems = typed.filter(F.col("type").isin(*PROBLEMS))
    out.append(found(problems.filter(~flag("caused")), "PROBLEM_WITHOUT_CAUSE", "node", "node_id", new | flag("old_caused")))
    out.append(found(problems.filter(flag("caused") & ~flag("path")), "NO_COMPATIBLE_ACTION_PATH", "node", "node_id", new | flag("old_path")))

    # edges against their ends
    ends = nodes.groupBy("node_id").agg(F.max("type").alias("t"))
    placed = edges.join(ends.toDF("source", "source_type"), "source", "left").join(ends.toDF("target", "target_type"), "target", "left")
    orphan = F.col("source_type").isNull() | F.col("target_type").isNull()
    fits, from_root = no, no
    for name, domain, range_ in ontology.relations:
        here = (F.col("type") == name) & (F.col("source_type") == domain) & (F.col("target_type") == range_)
        fits, from_root = fits | here, from_root | (here & F.lit(domain == ontology.root))
    state = F.when(orphan, "ORPHAN_EDGE").when(~fits, "ENDPOINT_TYPE").when(from_root & ~F.col("derived"), "DERIVED_READ_ONLY")
    out.append(found(placed.filter(state.isNotNull()), state, "edge", "edge_id", error=True))
    times = F.count(F.lit(1)).over(Window.partitionBy("type", "source", "target"))
    out.append(found(edges.select("edge_id", times.alias("n")).filter("n > 1"), "DUPLICATE_EDGE", "edge", "edge_id", error=True))

    out.append(_occurrence_issues(graph, base))
    result = out[0]
    for rows in out[1:]:
        result = result.unionByName(rows)
    return result


def property_issues(nodes: DataFrame, base: DataFrame, fields: DataFrame) -> DataFrame:
    """(code, kind, id, field, severity, introduced): what is wrong with the properties of nodes.

    nodes and base(node_id, type, name, properties): properties maps fields to JSON values. fields(type,
    field, kind, items) has the properties of each type: kind is string, number, integer, boolean or
    array, items the type of an array's items or null. A field ending in _id must be the node's id
    (CANONICAL_ID), one called name its name (CANONICAL_NAME), and a value that is there and not null
    of the field's kind (VALUE_TYPE). An issue was introduced if the node is new or its value has
    changed. Nodes of unknown types have none; of repeated base nodes the least value counts.
    """
    rows = nodes.join(F.broadcast(fields), "type")
    # properties of base, one row each, so that only the fields in question are compared
    old = base.select("node_id", F.explode("properties").alias("field", "was")).groupBy("node_id", "field").agg(F.min("was").alias("was"))
    known = base.select("node_id", F.lit(True).alias("known")).distinct()
    rows = rows.join(old, ["node_id", "field"], "left").join(known, "node_id", "left").withColumn("value", F.try_element_at("properties", F.col("field")))
    parsed = F.try_parse_json("value")
    shape = F.when(parsed.isNotNull(), F.schema_of_variant(parsed))
    text = F.when(shape == "STRING", F.try_variant_get(parsed, "$", "string"))
    number = shape.rlike("^(BIGINT|INT|TINYINT|SMALLINT|FLOAT|DOUBLE|DECIMAL)")
    whole = shape.rlike(r"^(BIGINT|INT|TINYINT|SMALLINT|DECIMAL\([0-9]+,0\))")
    kind = F.coalesce("kind", F.lit("string"))
    listed = shape.startswith("ARRAY") & (F.coalesce("items", F.lit("string")).isin("string") & shape.isin("ARRAY<STRING>", "ARRAY<VOID>") | (F.coalesce("items", F.lit("string")) != "string"))
    fits = F.when(kind == "string", shape == "STRING").when(kind == "number", number).when(kind == "integer", whole).when(kind == "boolean", shape == "BOOLEAN").when(kind == "array", listed).otherwise(False)
    introduced = F.col("known").isNull() | ~F.col("value").eqNullSafe(F.col("was"))
    codes = F.array_compact(F.array(
        F.when(F.col("field").endswith("_id") & ~text.eqNullSafe(F.col("node_id")), "CANONICAL_ID"),
        F.when((F.col("field") == "name") & F.col("value").isNotNull() & ~text.eqNullSafe(F.col("name")), "CANONICAL_NAME"),
        F.when(F.col("value").isNotNull() & (F.trim("value") != "null") & ~F.coalesce(fits, F.lit(False)), "VALUE_TYPE"),
    ))
    return rows.select(F.explode(codes).alias("code"), F.lit("node").alias("kind"), F.col("node_id").alias("id"), "field", F.lit("error").alias("severity"), introduced.alias("introduced"))


def unit_violations(units: DataFrame) -> DataFrame:
    """(unit_id, rule, ref): reading units that own nothing, own what is their context, or share what they own.

    units(unit_id, owned, context) with arrays of references; sound units have no rows.
    """
    none = F.array().cast("array<string>")
    owned, context = F.coalesce("owned", none), F.coalesce("context", none)
    empty = units.filter(F.size(owned) == 0).select("unit_id", F.lit("OWNS_NOTHING").alias("rule"), F.lit(None).cast("string").alias("ref"))
    both = units.select("unit_id", F.lit("OWNED_AND_CONTEXT").alias("rule"), F.explode(F.array_intersect(owned, context)).alias("ref"))
    each = units.select("unit_id", F.explode(F.array_distinct(owned)).alias("ref")).distinct()
    twice = each.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = each.join(twice.select("ref"), "ref").select("unit_id", F.lit("OWNED_TWICE").alias("rule"), "ref")
    return empty.unionByName(both).unionByName(shared)


def certificate_violations(certificates: DataFrame) -> DataFrame:
    """(assertion_id, rule): certificates that contradict themselves.

    certificates(assertion_id, evidence, witnesses, verdict, confirmed_by, rejected_by): each needs
    evidence, has each witness once, the verifier if and only if the verdict is supported, the reviewer
    if and only if someone confirmed, and isn't both confirmed and rejected.
    """
    none = F.array().cast("array<string>")
    evidence, witnesses = F.coalesce("evidence", none), F.coalesce("witnesses", none)
    supported = F.coalesce(F.col("verdict") == "supported", F.lit(False))
    confirmed, rejected = F.col("confirmed_by").isNotNull(), F.col("rejected_by").isNotNull()
    rules = {
        "NO_EVIDENCE": F.size(evidence) == 0, "WITNESS_TWICE": F.size(F.array_distinct(witnesses)) < F.size(witnesses), "VERIFIER_WITHOUT_SUPPORT": F.array_contains(witnesses, "verifier") != supported,
        "REVIEWER_WITHOUT_NAME": F.array_contains(witnesses, "reviewer") != confirmed, "CONFIRMED_AND_REJECTED": confirmed & rejected,
    }
    return certificates.select("assertion_id", F.explode(F.array_compact(F.array(*[F.when(test, rule) for rule, test in rules.items()]))).alias("rule"))


def question_violations(questions: DataFrame, offered: dict[str, tuple[str, ...]], needs_input: tuple[str, ...], sourced: tuple[str, ...]) -> DataFrame:
    """(question_id, rule): questions that can't be answered as they are.

    questions(question_id, kind, title, options, default, source): a title ends in a question mark, the
    options are those of the kind, each once, the default is one that needs no text, and kinds that
    must show what the manual says have a source.
    """
    options = F.coalesce("options", F.array().cast("array<string>"))
    expected = F.lit(None).cast("array<string>")
    for kind, ids in offered.items():
        expected = F.when(F.col("kind") == kind, F.array(*map(F.lit, sorted(ids)))).otherwise(expected)
    rules = {
        "NO_QUESTION": ~F.coalesce(F.rtrim("title").endswith("?"), F.lit(False)), "WRONG_OPTIONS": ~F.array_sort(options).eqNullSafe(expected),
        "WRONG_DEFAULT": ~F.coalesce(F.array_contains(options, F.col("default")) & ~F.col("default").isin(*needs_input), F.lit(False)),
        "NO_SOURCE": F.col("kind").isin(*sourced) & (F.coalesce("source", F.lit("")) == ""),
    }
    return questions.select("question_id", F.explode(F.array_compact(F.array(*[F.when(test, rule) for rule, test in rules.items()]))).alias("rule"))
