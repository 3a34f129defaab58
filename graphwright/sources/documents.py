"""Sources that are whole documents: ontologies, gold files, and annotation sheets.

Each takes a DataFrame of texts, one document a row, so files (spark.read.text with wholetext) and
tables are read alike; a document is small by nature.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.functions.parsing import page_numbers
from graphwright.operators.ordered import in_groups

PROPERTY = "struct<name:string,required:boolean,type:string>"
ONTOLOGY = f"nodes array<struct<name:string,description:string,properties:array<{PROPERTY}>>>, relations array<struct<name:string,domain:string,range:string,description:string>>"
CLAIM = (
    "claim_id string, branch_id string, indicator string, code string, failure string, failure_stated boolean, action string, action_kind string, component string, "
    "conditions string, indicator_segments array<string>, failure_segments array<string>, action_segments array<string>, component_segments array<string>"
)

# Fixed values of annotation sheets: labels, kinds of actions, the text for a cause that isn't stated, ids of segments.
SHEET_PAGES, SHEET_ANNOTATOR, SHEET_DATE, SHEET_TIME = "Pagine annotate", "Annotatore", "Data", "Tempo impiegato"
SHEET_PROBLEM, SHEET_CODE, SHEET_CAUSE, SHEET_ACTION, SHEET_COMPONENT, SHEET_CONDITIONS = "problema", "codice", "causa", "azione", "componente", "condizioni"
SHEET_KINDS = {"riparazione": "repair", "controllo": "inspection", "assistenza": "escalation"}
NOT_STATED = "non indicata nel manuale"
SHEET_BLOCK = r"(?smd)^### Ramo (\S+)\n(.*?)(?=^### |^## |\z)"
SEGMENT_ID = r"^p[1-9][0-9]*\.(?:b[0-9]+(?:\.[0-9]+)?|t[0-9]+\.r[0-9]+|o[0-9]+)$"


@dataclass
class OntologyTables:
    """types(*key, type, description), properties(*key, type, property, required, kind), relations(*key, name, domain, range), roots(*key, root, status)."""

    types: DataFrame
    properties: DataFrame
    relations: DataFrame
    roots: DataFrame


def ontologies(texts: DataFrame, key: str, value: str) -> OntologyTables:
    """The types, properties and relations of ontology texts, and the root of each.

    The root is the type that no relation leads to and that reaches most other types; status is READ, or
    NOT_JSON for a text that is no ontology, or NO_UNIQUE_ROOT if none or several are equal.
    """
    parsed = texts.select(key, F.from_json(value, ONTOLOGY).alias("o"))
    whole = F.col("o.nodes").isNotNull() & F.col("o.relations").isNotNull()
    nodes = parsed.filter(whole).select(key, F.explode("o.nodes").alias("n"))
    types = nodes.select(key, F.col("n.name").alias("type"), F.coalesce("n.description", F.lit("")).alias("description"))
    properties = nodes.select(key, F.col("n.name").alias("type"), F.explode("n.properties").alias("p")).select(
        key, "type", F.col("p.name").alias("property"), F.coalesce("p.required", F.lit(False)).alias("required"), F.coalesce("p.type", F.lit("string")).alias("kind")
    )
    relations = parsed.filter(whole).select(key, F.explode("o.relations").alias("r")).select(key, "r.name", "r.domain", "r.range")
    # an ontology is one document: its types and steps pass through one task, as a group of their own
    steps = types.select(key, F.col("type").alias("domain"), F.lit(None).cast("string").alias("range")).unionByName(relations.select(key, "domain", "range")).distinct()

    def rooted(part: list[tuple]) -> list[tuple]:
        names, leads = {a for _, a, b in part if b is None}, {}
        for _, a, b in part:
            if b is not None:
                leads.setdefault(a, set()).add(b)
        led = set().union(*leads.values()) if leads else set()
        reached = {}
        for start in names - led:
            seen, todo = {start}, [start]
            while todo:
                fresh = leads.get(todo.pop(), set()) - seen
                seen |= fresh
                todo += fresh
            reached[start] = len(seen)
        best = [n for n, size in reached.items() if size == max(reached.values())]
        return [(part[0][0], min(best, default=None), len(best))]

    best = in_groups(steps, key, "domain", rooted, f"`{key}` {dict(texts.dtypes)[key]}, root string, equal int")
    status = F.when(~F.coalesce(F.col("whole"), F.lit(False)), "NOT_JSON").when(F.coalesce("equal", F.lit(0)) != 1, "NO_UNIQUE_ROOT").otherwise("READ")
    roots = parsed.select(key, whole.alias("whole")).join(best, key, "left").select(key, F.when(status == "READ", F.col("root")).alias("root"), status.alias("status"))
    return OntologyTables(types, properties, relations, roots)


def gold_files(texts: DataFrame, key: str, value: str) -> DataFrame:
    """(key, pages, *claim): the claims of gold texts, one a row; a text that is none has no rows."""
    parsed = texts.select(key, F.from_json(value, f"pages array<int>, claims array<struct<{CLAIM.replace(' string', ':string').replace(' boolean', ':boolean').replace(' array', ':array')}>>").alias("g"))
    return parsed.select(key, F.coalesce("g.pages", F.array().cast("array<int>")).alias("pages"), F.explode("g.claims").alias("c")).select(key, "pages", "c.*")


def _entries(lines: Column, label: str) -> Column:
    """What a block's lines of one label say: (text, ids, kind).

    The parts of a line are bound to a lambda variable, so they are made once for a line.
    """
    start = f"- {label}:"
    split = F.transform(F.filter(lines, lambda line: line.startswith(start)), lambda line: F.transform(F.split(F.substring(line, F.lit(len(start) + 1), F.length(line)), r"\|"), lambda p: F.btrim(p)))

    def entry(parts: Column) -> Column:
        named = lambda name: F.try_element_at(F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.lower(F.btrim(F.split_part(p, F.lit(":"), F.lit(1)))) == name), F.lit(-1))
        content = lambda p: F.regexp_replace(p, "^[^:]*:?", "")
        ids = F.filter(F.transform(F.split(content(named("id")), ","), lambda i: F.btrim(i)), lambda i: i != "")
        kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in SHEET_KINDS.items() for x in pair]), F.lower(F.btrim(content(named("tipo")))))
        return F.struct(F.get(parts, F.lit(0)).alias("text"), F.coalesce(ids, F.array().cast("array<string>")).alias("ids"), F.coalesce(kind, F.lit("")).alias("kind"))

    return F.transform(split, entry)


def sheets(texts: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, claims, problems) of filled annotation sheets.

    headers(key, annotator, date, minutes, pages); claims(key, *claim) has one row for each action of a
    branch with a problem, or one without action; problems(key, branch_id, problem, detail) say what the
    annotator must mend: NO_PAGES, NO_CAUSE, UNKNOWN_ID, NO_PROBLEM_ID, NO_KIND. A cause that the sheet
    says isn't stated leaves the failure empty. Null texts have no pages and no branches.
    """
    text = F.coalesce(F.col(value), F.lit(""))
    head = F.split(text, "## Istruzioni", 2)[0]
    field = lambda label: F.btrim(F.regexp_extract(head, rf"(?md)^(?:[-*][ \t]+)?{label}.*?:[ \t]*(.*)$", 1))
    pages = F.array_sort(F.array_distinct(page_numbers(field(SHEET_PAGES))))
    headers = texts.select(key, field(SHEET_ANNOTATOR).alias("annotator"), field(SHEET_DATE).alias("date"), field(SHEET_TIME).alias("minutes"), pages.alias("pages"))
    none = headers.filter("size(pages) = 0").select(key, F.lit("").alias("branch_id"), F.lit("NO_PAGES").alias("problem"), F.lit("").alias("detail"))

    body = F.element_at(F.split(text, "## Rami", 2), -1)
    blocks = texts.select(key, F.explode(F.regexp_extract_all(body, F.lit(SHEET_BLOCK), 0)).alias("block"))
    # a block's first line names it; the others are split once
    rows = blocks.select(key, F.substring(F.substring_index("block", "\n", 1), len("### Ramo ") + 1, 1 << 30).alias("branch_id"), F.split("block", "\n").alias("lines"))
    labels = {"problem": SHEET_PROBLEM, "code": SHEET_CODE, "cause": SHEET_CAUSE, "component": SHEET_COMPONENT, "conditions": SHEET_CONDITIONS}
    blank = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("ids"), F.lit("").alias("kind"))
    # as one element of an array, so that Spark parses each entry once and not in every expression that reads it
    entries = F.struct(
        *[F.coalesce(F.get(_entries(F.col("lines"), label), F.lit(0)), blank).alias(n) for n, label in labels.items()],
        F.filter(_entries(F.col("lines"), SHEET_ACTION), lambda a: a["text"] != "").alias("actions"),
    )
    rows = rows.select(key, "branch_id", F.explode(F.array(entries)).alias("e")).select(key, "branch_id", "e.*").filter("problem.text <> ''")
    stated = (F.col("cause.text") != "") & (F.lower("cause.text") != NOT_STATED)
    bad = F.filter(F.flatten(F.concat(F.array("problem.ids", "cause.ids", "component.ids"), F.transform("actions", lambda a: a["ids"]))), lambda i: ~i.rlike(SEGMENT_ID))
    found = lambda code, detail: F.struct(F.lit(code).alias("problem"), detail.alias("detail"))
    faults = F.concat(
        F.array_compact(F.array(F.when(F.col("cause.text") == "", found("NO_CAUSE", F.lit(""))), F.when(F.size("problem.ids") == 0, found("NO_PROBLEM_ID", F.lit(""))))),
        F.transform(bad, lambda i: found("UNKNOWN_ID", i)), F.transform(F.filter("actions", lambda a: a["kind"] == ""), lambda a: found("NO_KIND", F.substring(a["text"], 1, 40))),
    )
    problems = none.unionByName(rows.select(key, "branch_id", F.explode(faults).alias("f")).select(key, "branch_id", "f.*"))
    empty = F.array().cast("array<string>")
    each = F.posexplode(F.when(F.size("actions") > 0, F.col("actions")).otherwise(F.array(blank))).alias("n", "a")
    claims = rows.select("*", stated.alias("stated"), each).select(
        key, F.concat_ws(".", "branch_id", F.col("n") + 1).alias("claim_id"), "branch_id", F.col("problem.text").alias("indicator"), F.col("code.text").alias("code"),
        F.when(F.col("stated"), F.col("cause.text")).otherwise("").alias("failure"), F.col("stated").alias("failure_stated"), F.col("a.text").alias("action"), F.col("a.kind").alias("action_kind"),
        F.col("component.text").alias("component"), F.col("conditions.text").alias("conditions"), F.col("problem.ids").alias("indicator_segments"),
        F.when(F.col("stated"), F.col("cause.ids")).otherwise(empty).alias("failure_segments"), F.col("a.ids").alias("action_segments"), F.col("component.ids").alias("component_segments"),
    )
    return headers, claims, problems
