"""Queries from answers to relations. Answers are JSON texts made from order lines; Spark parses them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphwright.functions import parsing as P
from graphwright.functions import text as T
from graphwright.operators import binding as B
from graphwright.operators import certify as C
from graphwright.plans import graph_staging as GS
from graphwright.plans import staging as S
from graphwright.plans.checkpoints import cut
from graphwright.plans.graph_queries import _ASSERTION, _FINE_ASSERTION
from graphwright.plans.text_queries import _f1, _words
from graphwright.registry import query
from graphwright.sources.tables import read_table

TYPES = ("Asset", "Symptom", "FailureMode", "CorrectiveAction", "ErrorCode", "Component")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answers(unit_id, read, answer): what a model might answer about each order, as JSON."""
    parts, suppliers = read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "supplier")
    lines = read_table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    problem = F.concat_ws(" ", "p_brand", part % 20)
    cause = F.when(part % 17 == 0, " ").when(part % 19 == 0, F.upper(problem)).otherwise(F.col("p_name"))
    b, p, s = F.concat(F.lit("b"), part), F.concat(F.lit("p"), part), F.concat(F.lit("s"), supp)
    none = F.array().cast("array<string>")
    entity = lambda key, kind, name, cite: F.struct(key.alias("key"), kind.alias("type"), name.alias("name"), F.lit(True).alias("stated"), cite.alias("cite"))
    entities = F.array(
        entity(b, F.lit("Symptom"), problem, F.when(part % 2 == 0, F.array(F.lit("p1.b1"))).otherwise(none)),
        entity(p, F.when(part % 11 == 0, "Gadget").otherwise("FailureMode"), cause, none),
        entity(s, F.lit("CorrectiveAction"), F.col("s_name"), none),
    )
    record, cite = F.concat(F.lit("r"), "l_linenumber"), F.array(F.concat(F.lit("p"), "l_linenumber", F.lit(".b1")))
    relation = lambda source, target, kind: F.struct(source.alias("source"), target.alias("target"), kind.alias("type"), record.alias("record"), cite.alias("cite"))
    turned = supp % 7 == 0
    relations = F.array_compact(F.array(
        relation(b, p, F.when(part % 5 == 0, "RESOLVED_BY").otherwise("MAY_INDICATE")),
        relation(F.when(turned, s).otherwise(p), F.when(turned, p).otherwise(s), F.lit("RESOLVED_BY")),
        F.when(F.col("l_linenumber") == 1, relation(b, s, F.lit("RESOLVED_BY"))),
    ))
    whole = lines.groupBy(F.col("l_orderkey").alias("unit_id")).agg(F.flatten(F.collect_list(entities)).alias("entities"), F.flatten(F.collect_list(relations)).alias("relations"))
    return whole.select("unit_id", F.lit("A").alias("read"), F.to_json(F.struct("entities", "relations")).alias("answer"))


_PARSED = """
lines as (select *, p_brand || ' ' || (l_partkey % 20) as problem, case when l_partkey % 19 = 0 then upper(p_brand || ' ' || (l_partkey % 20)) else p_name end as cause, l_partkey % 11 <> 0 and l_partkey % 17 <> 0 as known
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
), named as (select *, case when l_partkey % 19 = 0 then 'Unspecified cause of ' || lower(substr(problem, 1, 1)) || substr(problem, 2) else cause end as cause_name from lines where known
), parsed as (
  select l_orderkey as unit_id, 'r' || l_linenumber as record, 'MAY_INDICATE' as relation_type, problem as source_name, cause_name as target_name, case when l_partkey % 5 = 0 then 'repaired' else 'exact' end as how, (l_linenumber <= 4)::int as cites,
    case when l_linenumber > 4 and l_partkey % 2 = 1 then 'MISSING_EVIDENCE' end as issue, l_partkey % 19 <> 0 as stated from named
  union all
  select l_orderkey, 'r' || l_linenumber, 'RESOLVED_BY', cause_name, s_name, case when l_suppkey % 7 = 0 then 'reversed' else 'exact' end, (l_linenumber <= 4)::int, case when l_linenumber > 4 then 'MISSING_EVIDENCE' end, l_partkey % 19 <> 0 from named
)"""
_ALLOWED = [f"p{i}.b1" for i in range(1, 5)]


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.parse_answers(answers(spark, sf_dir), TYPES, F.array(*[F.lit(c) for c in _ALLOWED]))


@query("l04_parsed_answers", f"with {_PARSED} select unit_id, record, relation_type, source_name, target_name, how, cites, issue from parsed")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals that the answers hold, with what was repaired."""
    return _parsed(spark, sf_dir).select("unit_id", "record", "relation_type", F.col("source.name").alias("source_name"), F.col("target.name").alias("target_name"), "how", F.size("cites").alias("cites"), "issue")


@query("p09_placeholders", f"with {_PARSED} select relation_type, count(*) as proposals, count(*) filter (where case when relation_type = 'MAY_INDICATE' then target_name else source_name end like 'Unspecified cause of%') as unnamed, count(*) filter (where not stated) as unstated from parsed group by relation_type")
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals whose cause the source does not name."""
    cause = F.when(F.col("relation_type") == "MAY_INDICATE", F.col("target")).otherwise(F.col("source"))
    rows = _parsed(spark, sf_dir).select("relation_type", cause.alias("c"))
    return rows.groupBy("relation_type").agg(F.count(F.lit(1)).alias("proposals"), F.count_if(B.is_placeholder(F.col("c.name"))).alias("unnamed"), F.count_if(~F.col("c.stated")).alias("unstated"))


@query(
    "j08_inherited_remedies",
    """with rows_ as (select l_orderkey as unit_id, l_linenumber as row, min(l_linenumber) over (partition by l_orderkey, l_returnflag) as origin, 'c' || l_partkey as cause, 'a' || l_suppkey as action from lineitem),
    pairs as (select distinct c.unit_id, c.cause, r.action from rows_ c join rows_ r on c.unit_id = r.unit_id and c.origin = r.row and c.origin < c.row), own as (select distinct c.unit_id, c.cause, r.action from rows_ c join rows_ r on c.unit_id = r.unit_id and c.row = r.row),
    fresh as (select * from pairs p where not exists (select 1 from own o where o.unit_id = p.unit_id and o.cause = p.cause and o.action = p.action)), ranked as (select *, row_number() over (partition by unit_id order by cause, action) as n from fresh) select unit_id, cause, action from ranked where n <= 300""",
)
def inherited_remedies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remedies of the first line of a flag offered to the causes of its later lines."""
    origin = F.min("l_linenumber").over(Window.partitionBy("l_orderkey", "l_returnflag"))
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").alias("row"), origin.alias("origin"), F.concat(F.lit("c"), "l_partkey").alias("cause"), F.concat(F.lit("a"), "l_suppkey").alias("action"))
    return B.inherited_remedies(rows.select("unit_id", "row", "origin", "cause"), rows.select("unit_id", "row", "action"), 300)


@query(
    "j14_cross_read_names",
    f"""with {S.PROPOSAL}, ends as (select distinct unit_id, relation_type, 's' as e, target_name as other, source_name as name, read from proposal union select distinct unit_id, relation_type, 't', source_name, target_name, read from proposal),
    agreed as (select unit_id, relation_type, e, other, name from ends group by all having count(distinct read) > 1), free as (select s.* from ends s where not exists (select 1 from agreed g where g.unit_id = s.unit_id and g.relation_type = s.relation_type and g.e = s.e and g.other = s.other and g.name = s.name))
    select distinct a.unit_id, a.relation_type, least(a.name, b.name) as left, greatest(a.name, b.name) as right from free a join free b on a.unit_id = b.unit_id and a.relation_type = b.relation_type and a.e = b.e and a.other = b.other and a.read = 'A' and b.read = 'B' and a.name <> b.name""",
)
def cross_read_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that two reads give one end of a relation."""
    return B.cross_read_pairs(S.proposals(spark, sf_dir, by_unit=True))


_MATRIX = """
entries as (select l_orderkey as unit_id, l_partkey % 9 as number, 'entry ' || l_suppkey as entry, l_linenumber * 2 as pos from lineitem where l_returnflag <> 'R'),
matrix as (select l_orderkey as unit_id, l_linenumber as row, l_linenumber * 2 + 1 as pos, [l_partkey % 9, l_suppkey % 9, (l_partkey + l_suppkey) % 9] as numbers from lineitem where l_returnflag = 'R')"""


@query(
    "j23_numbered_references",
    f"""with {_MATRIX}, asked as (select distinct unit_id, row, number from (select unit_id, row, unnest(numbers) as number from matrix)), bounds as (select unit_id, min(pos) as a, max(pos) as b from matrix group by unit_id),
    placed as (select e.*, case when pos < a then 'before' when pos > b then 'after' end as side from entries e join bounds using (unit_id)), scores as (select unit_id, count(distinct number) filter (where side = 'before') as b, count(distinct number) filter (where side = 'after') as a from placed p where exists (select 1 from asked q where q.unit_id = p.unit_id and q.number = p.number) group by unit_id),
    kept as (select p.* from placed p left join scores s using (unit_id) where s.unit_id is null or a = b or (b > a and side = 'before') or (a > b and side = 'after')), one as (select unit_id, number, min(entry) as entry from kept group by all having count(*) = 1)
    select distinct q.unit_id, q.row, q.number, o.entry, case when o.entry is null then 'unresolved' else 'resolved' end as status from asked q left join one o on q.unit_id = o.unit_id and q.number = o.number""",
)
def numbered_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of returned lines resolved to the numbered entries of their order."""
    lines = read_table(spark, sf_dir, "lineitem")
    unit, pos = F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber") * 2
    entries = lines.filter("l_returnflag <> 'R'").select(unit, (F.col("l_partkey") % 9).alias("number"), F.concat(F.lit("entry "), "l_suppkey").alias("entry"), pos.alias("pos"))
    numbers = F.array(F.col("l_partkey") % 9, F.col("l_suppkey") % 9, (F.col("l_partkey") + F.col("l_suppkey")) % 9)
    rows = lines.filter("l_returnflag = 'R'").select(unit, F.col("l_linenumber").alias("row"), (pos + 1).alias("pos"), numbers.alias("numbers"))
    return B.numbered_references(rows, entries).distinct()


_NAMED = _words("name", T.COVERAGE_STOP)


@query(
    "j25_covered_items",
    f"""with items as (select p_partkey as item_id, case p_size % 3 when 0 then 'INDICATOR' when 1 then 'CAUSE' else 'REPAIR' end as kind, lower(p_name || ' ' || p_brand) as text, p_partkey as ref from part),
    asserted as (select l_orderkey || '.' || l_linenumber as assertion_id, case l_linenumber % 3 when 0 then 'Symptom' when 1 then 'FailureMode' else 'CorrectiveAction' end as end_type, p_name || case when l_quantity > 40 then ' broken' else '' end as name, case l_returnflag when 'A' then 'green' when 'N' then 'yellow' else 'red' end as tier, l_partkey as ref from lineitem join part on l_partkey = p_partkey),
    met as (select item_id, tier, assertion_id from items i join asserted a on i.ref = a.ref and case kind when 'INDICATOR' then end_type = 'Symptom' when 'CAUSE' then end_type = 'FailureMode' else end_type = 'CorrectiveAction' end
      and (select len(w) > 0 and len(list_filter(w, lambda x: list_contains(regexp_extract_all(lower(i.text), '[a-z0-9]+'), x))) >= greatest(1, round_even(len(w) * 0.7, 0)::int) from (select {_NAMED.replace("(name)", "(a.name)")} as w))),
    sums as (select item_id, list_sort(list_distinct(list(assertion_id) filter (where tier = 'green'))) as g, list_sort(list_distinct(list(assertion_id) filter (where tier = 'red'))) as r from met group by item_id)
    select i.item_id, case when len(g) > 0 then 'REPRESENTED' when len(r) > 0 then 'REJECTED_PROPOSAL' else 'MISSING' end as status, array_to_string(case when len(g) > 0 then g when len(r) > 0 then r else [] end, ' ') as assertion_ids from items i left join sums s using (item_id)""",
)
def covered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as items that order lines represent, by reference, role and name."""
    parts = read_table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "INDICATOR").when(F.col("p_size") % 3 == 1, "CAUSE").otherwise("REPAIR")
    items = parts.select(F.col("p_partkey").alias("item_id"), kind.alias("kind"), F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("text"), F.array("p_partkey").alias("refs"))
    end = F.when(F.col("l_linenumber") % 3 == 0, "Symptom").when(F.col("l_linenumber") % 3 == 1, "FailureMode").otherwise("CorrectiveAction")
    tier = F.when(F.col("l_returnflag") == "A", "green").when(F.col("l_returnflag") == "N", "yellow").otherwise("red")
    name = F.concat("p_name", F.when(F.col("l_quantity") > 40, " broken").otherwise(""))
    lines = read_table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    asserted = lines.select(F.concat_ws(".", "l_orderkey", "l_linenumber").alias("assertion_id"), end.alias("end_type"), name.alias("name"), tier.alias("tier"), F.array("l_partkey").alias("refs"))
    role = F.when(F.col("kind") == "INDICATOR", "Symptom").when(F.col("kind") == "CAUSE", "FailureMode").otherwise("CorrectiveAction")
    out = B.covered_items(items, asserted, (F.col("end_type") == role) & T.names_match(F.col("text"), F.col("name")))
    return out.select("item_id", "status", F.array_join("assertion_ids", " ").alias("assertion_ids"))


@query(
    "j32_matched_locators",
    f"""with {S.SEGMENT}, old as (select doc_id * 100000 + pos as id, doc_id || ':' || segment_id as locator, doc_id * 1000 + page as page, text from segment), new_ as (select doc_id * 100000 + pos + 1 as id, doc_id || ':p' || page || '.b' || (case when pos % 5 = 0 then pos + 50 else pos end) as locator, doc_id * 1000 + page as page, text || ' indeed' as text from segment where pos % 7 <> 0),
    exact as (select locator, min(id) as by_place from new_ group by locator), placed as (select o.*, by_place from old o left join exact using (locator)),
    near as (select p.id as old_id, n.id as n, round({_f1("p.text", "n.text")}, 9) as f from placed p join new_ n on p.page = n.page where by_place is null), best as (select old_id, n from (select *, row_number() over (partition by old_id order by f desc, n) as k from near where f >= 0.6) where k = 1)
    select p.id as old_id, coalesce(by_place, n) as new_id, case when by_place is not null then 'locator' when n is not null then 'quote' end as by from placed p left join best b on p.id = b.old_id""",
)
def matched_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents found again after some have moved and others are gone."""
    rows = S.segments(spark, sf_dir).select("doc_id", "segment_id", "pos", (F.col("doc_id") * 1000 + F.col("page")).alias("page"), F.col("page").alias("p"), "text")
    old = rows.select((F.col("doc_id") * 100000 + F.col("pos")).alias("id"), F.concat_ws(":", "doc_id", "segment_id").alias("locator"), "page", "text")
    moved = F.when(F.col("pos") % 5 == 0, F.col("pos") + 50).otherwise(F.col("pos"))
    new = rows.filter("pos % 7 <> 0").select((F.col("doc_id") * 100000 + F.col("pos") + 1).alias("id"), F.concat(F.col("doc_id").cast("string"), F.lit(":p"), "p", F.lit(".b"), moved).alias("locator"), "page", F.concat("text", F.lit(" indeed")).alias("text"))
    return B.matched_locators(old, new, 0.6, T.token_f1(F.col("old_text"), F.col("new_text")))


@query(
    "l07_judged_pairs",
    """with pairs as (select conv_id * 1000 + turn as pair_id, turn * 1000000 + conv_id as ord, ['same', 'different', 'unsure', 'maybe'][(length(text) % 4 + 1)::int] as answer, case when conv_id % 6 = 0 then ' ' else 'it says so' end as rationale, ['a' || (turn % 3), 'b' || (conv_id % 3)] as cites, ['a0', 'a1'] as left_cites, ['b0', 'b2'] as right_cites from conversations),
    ranked as (select *, row_number() over (order by ord, pair_id) as n from pairs) select pair_id, case when n > 400 then 'deferred' when answer = 'different' then 'different' when answer = 'same' and trim(rationale) <> '' and list_has_any(cites, left_cites) and list_has_any(cites, right_cites) then 'same' else 'unsure' end as plan from ranked""",
)
def judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What answers about pairs of names come to, the first four hundred of them."""
    rows = read_table(spark, sf_dir, "conversations")
    answer = F.element_at(F.array(*[F.lit(a) for a in ("same", "different", "unsure", "maybe")]), (F.length("text") % 4 + 1).cast("int"))
    pairs = rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), (F.col("turn") * 1000000 + F.col("conv_id")).alias("ord"), answer.alias("answer"), F.when(F.col("conv_id") % 6 == 0, " ").otherwise("it says so").alias("rationale"),
        F.array(F.concat(F.lit("a"), F.col("turn") % 3), F.concat(F.lit("b"), F.col("conv_id") % 3)).alias("cites"), F.array(F.lit("a0"), F.lit("a1")).alias("left_cites"), F.array(F.lit("b0"), F.lit("b2")).alias("right_cites"),
    )
    return B.judged_pairs(pairs, 400)


_RELATION = """
props as (select l_orderkey as relation_id, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1)::int as n, ['A', 'B', 'C'][(l_linenumber % 3 + 1)::int] as read, 'c' || (l_partkey % 12) as source_name, 'a' || (l_suppkey % 5) as target_name, l_linestatus = 'F' as structure from lineitem),
different as (select 'c' || a as left, 'c' || b as right from range(12) x(a), range(12) y(b) where (a + b) % 4 = 1 and a <> b)"""


@query(
    "g09_split_disagreements",
    f"""with {_RELATION}, lead as (select * from props where n = 0), apart as (select p.relation_id, p.n from props p join lead l using (relation_id) where exists (select 1 from different d where (d.left = p.source_name and d.right = l.source_name) or (d.right = p.source_name and d.left = l.source_name))),
    numbered as (select *, row_number() over (partition by relation_id order by n) as i from apart), marked as (select p.*, case when i is null then '' else 's' || i end as part from props p left join numbered a on p.relation_id = a.relation_id and p.n = a.n)
    select relation_id, part, string_agg(distinct read, '' order by read) as reads, bool_or(structure) as structure, relation_id % 2 = 0 and bool_or(read = 'A') and bool_or(read = 'B') as agreement, case when part = '' then 'supported' end as verdict from marked group by relation_id, part""",
)
def split_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as relations, taken apart where names of their lines differ from the first line's."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    read = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    props = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("relation_id"), (F.row_number().over(order) - 1).alias("n"), read.alias("read"), F.concat(F.lit("c"), F.col("l_partkey") % 12).alias("source_name"), F.concat(F.lit("a"), F.col("l_suppkey") % 5).alias("target_name"), (F.col("l_linestatus") == "F").alias("structure")
    )
    names = read_table(spark, sf_dir, "part").select((F.col("p_partkey") % 12).alias("a")).distinct()
    different = names.select("a", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("b")).filter("(a + b) % 4 = 1 and a <> b").select(F.concat(F.lit("c"), "a").alias("left"), F.concat(F.lit("c"), "b").alias("right"))
    relations = props.select("relation_id").distinct().select("relation_id", (F.col("relation_id") % 2 == 0).alias("agreement"), F.lit("supported").alias("verdict"))
    return B.split_disagreements(relations, cut(props), different)


@query(
    "l05_verifier_batches",
    f"""with {_ASSERTION}, open_ as (select unit_id, relation_type || '|' || source_name || '|' || target_name as assertion_id from assertion where not (coalesce(structure, false) and coalesce(agreement, false) and row % 4 <> 0))
    select unit_id, assertion_id, ceil(row_number() over (partition by unit_id order by assertion_id) / 3.0)::int as batch from open_""",
)
def verifier_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions that a verifier must see, three at a time."""
    rows = C.assertions(S.proposals(spark, sf_dir, by_unit=True)).select("unit_id", F.concat_ws("|", "relation_type", "source_name", "target_name").alias("assertion_id"), F.coalesce("structure", F.lit(False)).alias("structure"), F.coalesce("agreement", F.lit(False)).alias("agreement"), (F.col("row") % 4 == 0).alias("hypothesis"))
    return B.pending_for_verifier(rows, 3)


@query(
    "l12_review_delta",
    """with relations as (select l_orderkey * 10 + l_linenumber as relation_id, l_partkey as key, l_suppkey as evidence from lineitem), decisions as (select l_partkey as key, l_suppkey as evidence, case when l_orderkey % 3 = 0 then 'rejected' else 'confirmed' end as decision from lineitem where l_orderkey % 11 = 0),
    said as (select key, evidence, bool_or(decision = 'rejected') as gone from decisions group by all), about as (select distinct key from decisions), firsts as (select key, evidence, min(relation_id) as first_ from relations group by all)
    select relation_id, case when gone then 'dropped' when relation_id > first_ then 'duplicate' when a.key is not null and gone is null then 'to_people' else 'kept' end as fate from relations r left join said s on r.key = s.key and r.evidence = s.evidence left join about a on r.key = a.key join firsts f on r.key = f.key and r.evidence = f.evidence""",
)
def review_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a review leaves of the order lines as relations."""
    lines = read_table(spark, sf_dir, "lineitem")
    relations = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("relation_id"), F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("evidence"))
    decisions = lines.filter("l_orderkey % 11 = 0").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("evidence"), F.when(F.col("l_orderkey") % 3 == 0, "rejected").otherwise("confirmed").alias("decision"))
    return B.review_delta(relations, decisions)


@query(
    "j43_translated_cites",
    """with cites as (select l_orderkey, list('s' || l_partkey order by l_linenumber, l_partkey, l_suppkey) as cites from lineitem group by l_orderkey), aliases as (select 's' || p_partkey as alias, 'ev_' || p_size as target from part where p_partkey % 3 = 0),
    each_ as (select l_orderkey, unnest(cites) as alias, generate_subscripts(cites, 1) as i from cites) select l_orderkey, string_agg(coalesce(target, e.alias), ' ' order by i) as cites from each_ e left join aliases a on e.alias = a.alias group by l_orderkey""",
)
def translated_cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cites of orders with their aliases replaced."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda s: F.concat(F.lit("s"), s["l_partkey"]))
    cites = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rows.alias("cites"))
    aliases = read_table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.concat(F.lit("s"), "p_partkey").alias("alias"), F.concat(F.lit("ev_"), "p_size").alias("target"))
    return B.translated_cites(cites, aliases, "l_orderkey", "cites").select("l_orderkey", F.array_join("cites", " ").alias("cites"))


@query(
    "j44_merge_contexts",
    f"""with {GS.named(edge=GS.EDGE)}, rels as (select distinct source, target, source || ' ' || type || ' ' || target as says from edge), own as (select source as name, says from rels union select target, says from rels), further as (select distinct a.source as name, b.says from rels a join rels b on a.target = b.source), both_ as (select * from own union select * from further),
    ranked as (select *, row_number() over (partition by name order by says) as n from both_ where name like 'E:%' or name like 'C:%') select name, string_agg(says, '; ' order by n) as context from ranked where n <= 10 group by name""",
)
def merge_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the graph says about causes and error codes, for a judge of names."""
    edges = GS.rows(spark, sf_dir, GS.EDGE).select(F.col("source").alias("source_name"), F.col("target").alias("target_name"), F.col("type").alias("relation_type"))
    names = edges.select(F.col("source_name").alias("name")).unionByName(edges.select(F.col("target_name").alias("name"))).filter("name like 'E:%' or name like 'C:%'")
    return B.merge_context(names, edges, 10)


@query(
    "j48_latest_relations",
    """with states as (select ['checked_', 'rechecked_', 'navigation_', 'recovery_', 'draft_'][(l_linenumber % 5 + 1)::int] as prefix, l_orderkey as file, l_partkey as assertion_id, l_suppkey as verdict, l_linenumber as n from lineitem),
    ranked as (select *, row_number() over (partition by assertion_id order by list_position(['checked_', 'rechecked_', 'navigation_', 'recovery_'], prefix) desc, file desc, verdict desc) as k from states where prefix <> 'draft_') select assertion_id, prefix, file, verdict from ranked where k = 1""",
)
def latest_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last saved version of each assertion."""
    prefixes = ("checked_", "rechecked_", "navigation_", "recovery_")
    prefix = F.element_at(F.array(*[F.lit(p) for p in (*prefixes, "draft_")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    states = read_table(spark, sf_dir, "lineitem").select(prefix.alias("prefix"), F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("assertion_id"), F.col("l_suppkey").alias("verdict"))
    # of one file and prefix the larger verdict, so columns come in the order of their weight
    return B.latest_relations(states.select("prefix", "file", "assertion_id", "verdict"), prefixes).select("assertion_id", "prefix", "file", "verdict")


_KEY = "relation_type, source_name, target_name"


@query(
    "l26_projection",
    f"""with {_ASSERTION}, marked as (select *, unit_id % 5 <> 0 as public, unit_id % 7 <> 0 as representable from assertion), counted as (select {_KEY}, count(*) filter (where tier = 'green' and public) as public, count(*) filter (where tier <> 'red' and representable and (tier <> 'green' or public)) as shown, count(*) filter (where tier = 'green' and public and representable) as both_ from marked group by all)
    select {_KEY}, public, shown, case when shown = 0 then 'EMPTY' when both_ = public and both_ = shown then 'FULL' else 'PARTIAL' end as status, case when public = 0 then 'NO_PUBLIC_FACTS' when shown = 0 then 'NO_REPRESENTABLE_FACTS' else '' end as reason from counted""",
)
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each edge an export can show, and why not more."""
    rows = C.assertions(S.proposals(spark, sf_dir, by_unit=True)).withColumn("public", F.col("unit_id") % 5 != 0).withColumn("representable", F.col("unit_id") % 7 != 0)
    return B.projected(rows, ["relation_type", "source_name", "target_name"])


@query(
    "l24_promoted_scopes",
    """with branches as (select distinct l_orderkey as branch_id, 'PROVISIONAL' as scope from lineitem), yes as (select distinct l_orderkey as branch_id from lineitem where l_returnflag = 'A' and l_linenumber % 3 < 2), no_ as (select distinct l_orderkey as branch_id from lineitem where l_discount > 0.09)
    select b.branch_id, case when y.branch_id is not null and n.branch_id is null then 'VERIFIED_REVIEW' else scope end as scope from branches b left join yes y using (branch_id) left join no_ n using (branch_id)""",
)
def promoted_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches whose scope a review has verified."""
    lines = read_table(spark, sf_dir, "lineitem").withColumn("branch_id", F.col("l_orderkey"))
    reviewer = F.element_at(F.array(F.lit("human"), F.lit("agent"), F.lit("auto")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return B.promoted(lines.select("branch_id", F.lit("PROVISIONAL").alias("scope")).distinct(), lines.filter("l_returnflag = 'A'").select("branch_id", reviewer.alias("reviewer")), lines.filter("l_discount > 0.09"))


@query(
    "l25_recovered_labels",
    """with rows_ as (select doc_id, lang as label, case when doc_id % 4 = 0 then 'human' else 'agent' end as decided_by from documents where doc_id % 6 <> 5), fresh as (select doc_id, case when quality = 1 then 'diagnostic' else 'other' end as label from labels)
    select coalesce(r.doc_id, f.doc_id) as doc_id, case when decided_by = 'human' or f.label is null then r.label else f.label end as label, case when decided_by = 'human' then 'human' else 'system' end as decided_by from rows_ r full join fresh f on r.doc_id = f.doc_id""",
)
def recovered_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels after a recovery: what people decided stays."""
    rows = read_table(spark, sf_dir, "documents").filter("doc_id % 6 <> 5").select("doc_id", F.col("lang").alias("label"), F.when(F.col("doc_id") % 4 == 0, "human").otherwise("agent").alias("decided_by"))
    fresh = read_table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "diagnostic").otherwise("other").alias("label"))
    return B.recovered(rows, fresh, "doc_id", "label")


@query(
    "p11_aligned_lists",
    """with lists as (select l_orderkey, list('c' || (l_partkey % 40) order by l_linenumber, l_partkey, l_suppkey) as causes, list('a' || (l_suppkey % 40) order by l_linenumber, l_partkey, l_suppkey) as actions from lineitem group by l_orderkey), asked as (select *, 'c' || (l_orderkey % 40) as cause, 'a' || (l_orderkey * 7 % 40) as action from lists)
    select l_orderkey, len(causes) < 2 or (len(list_filter(causes, lambda c: c = cause)) = 1 and len(list_filter(actions, lambda a: a = action)) = 1 and list_position(causes, cause) = list_position(actions, action)) as aligned from asked""",
)
def aligned_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a cause and an action stand at the same single place of an order's two lists, read from their text."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    listed = lambda prefix, c: F.array_join(F.transform("r", lambda s: F.concat(F.lit(f"• {prefix}"), s[c] % 40)), "\n")
    lists = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rows.alias("r")).select("l_orderkey", P.list_pieces(listed("c", "l_partkey")).alias("causes"), P.list_pieces(listed("a", "l_suppkey")).alias("actions"))
    key = F.col("l_orderkey")
    return lists.select("l_orderkey", B.aligned(F.col("causes"), F.col("actions"), F.concat(F.lit("c"), key % 40), F.concat(F.lit("a"), key * 7 % 40)).alias("aligned"))


@query(
    "w06_step_context",
    f"""with {GS.named(occurrence=GS.OCCURRENCE)}, steps as (select l_orderkey as doc, l_linenumber as pos, (l_orderkey * 3 + l_linenumber // 4)::bigint as seq, l_linenumber % 4 + 1 as number, case when l_suppkey % 3 = 0 then chr((97 + l_partkey % 3)::int) else '' end as letter, l_partkey as k from lineitem),
    heads as (select doc, seq, min(pos) as head from steps group by all), parents as (select doc, seq, number, min(pos) as parent from steps where letter = '' group by all)
    select s.doc, s.pos, s.k, head, case when letter <> '' then parent end as parent from steps s join heads h on s.doc = h.doc and s.seq = h.seq left join parents p on s.doc = p.doc and s.seq = p.seq and s.number = p.number""",
)
def step_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of each step's sequence, and the parent of each sub-step."""
    letter = F.when(F.col("l_suppkey") % 3 == 0, F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("l_partkey") % 3 + 1).cast("int"))).otherwise("")
    steps = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), (F.col("l_orderkey") * 3 + F.floor(F.col("l_linenumber") / 4)).alias("seq"), (F.col("l_linenumber") % 4 + 1).alias("number"), letter.alias("letter"), F.col("l_partkey").alias("k"))
    return B.step_context(steps).select("doc", "pos", "k", "head", "parent")
