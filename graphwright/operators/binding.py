"""From answers to relations: answers are parsed, bound to evidence, compared between reads, and regrouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.functions.parsing import text_key
from graphwright.functions.similar import name_similarity, similarity
from graphwright.operators.graph import repaired_relation
from graphwright.operators.ordered import in_groups

# Fixed value: how the name of a cause begins that the source does not name.
UNSPECIFIED = "Unspecified cause of"

ANSWER = "entities array<struct<key:string,type:string,name:string,stated:boolean,cite:array<string>>>, relations array<struct<source:string,target:string,type:string,record:string,cite:array<string>>>"


def is_placeholder(name: Column) -> Column:
    """Whether a cause is one that the source does not name."""
    return name.startswith(UNSPECIFIED)


def _once(df: DataFrame, kept: list[str], **made: Column) -> DataFrame:
    """kept and made of df; as one element of an array, so that Spark makes each column once and not in every expression and filter that reads it."""
    return df.select(*kept, F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("_made")).select(*kept, "_made.*")


def parse_answers(answers: DataFrame, types: tuple[str, ...], allowed: Column) -> DataFrame:
    """Proposals in answers(unit_id, read, answer, ..): one row for each relation that can be used.

    (unit_id, read, record, relation_type, source, target, how, cites, issue): ends are structs of
    type, name, stated and cites. Entities without a key, a name or a known type are skipped, and
    relations with them. A cause that only repeats its problem becomes an unnamed one, in all of the
    answer's relations. A relation type that doesn't fit its ends is repaired, turned round, or the
    relation dropped. Only allowed cites stay; without any the issue is MISSING_EVIDENCE. allowed is
    an array column of answers. An answer that is no object has no proposals.
    """
    parsed = answers.withColumn("_a", F.from_json("answer", ANSWER)).withColumn("_ok", allowed)
    cleaned = F.transform(
        F.filter(F.array_distinct("_a.entities"), lambda e: (F.btrim(e["key"]) != "") & (F.btrim(e["name"]) != "") & e["type"].isin(*types)),
        lambda e: F.struct(F.btrim(e["key"]).alias("key"), e["type"].alias("type"), F.regexp_replace(F.btrim(e["name"]), r"\s+", " ").alias("name"), F.coalesce(e["stated"], F.lit(True)).alias("stated"), F.array_intersect(F.coalesce(e["cite"], F.array().cast("array<string>")), F.col("_ok")).alias("cites")),
    )
    known = _once(parsed, ["unit_id", "read", "_ok"], _e=cleaned, _r=F.col("_a.relations"))
    found = lambda key: F.get(F.filter("_e", lambda e: e["key"] == key), F.lit(0))
    ends = F.transform("_r", lambda r: F.struct(found(r["source"]).alias("s"), found(r["target"]).alias("t"), r["type"].alias("type"), r["record"].alias("record"), r["cite"].alias("cite")))
    usable = F.filter(ends, lambda r: r["s"].isNotNull() & r["t"].isNotNull())
    known = _once(known, ["unit_id", "read", "_ok"], _r=usable)
    repeats = F.filter("_r", lambda r: (r["t"]["type"] == "FailureMode") & (r["s"]["type"] != "FailureMode") & ~is_placeholder(r["t"]["name"]) & (text_key(r["s"]["name"]) == text_key(r["t"]["name"])))
    renamed = F.transform(repeats, lambda r: F.struct(r["t"]["key"].alias("key"), F.concat(F.lit(f"{UNSPECIFIED} "), F.lower(F.substring(r["s"]["name"], 1, 1)), F.substring(r["s"]["name"], 2, 10_000)).alias("name")))
    known = _once(known, ["unit_id", "read", "_ok", "_r"], _n=renamed)

    def named(end: Column) -> Column:
        new = F.get(F.filter("_n", lambda n: n["key"] == end["key"]), F.lit(0))
        return F.struct(end["type"].alias("type"), F.coalesce(new["name"], end["name"]).alias("name"), F.when(new.isNull(), end["stated"]).otherwise(False).alias("stated"), end["cites"].alias("cites"))

    rows = known.select("unit_id", "read", "_ok", "_n", F.explode("_r").alias("r"))
    relation, how = repaired_relation(F.col("r.type"), F.col("r.s.type"), F.col("r.t.type"))
    rows = rows.withColumns({"relation_type": relation, "how": how}).filter("how <> 'dropped'")
    rows = _once(rows, ["unit_id", "read", "_ok", "r", "relation_type", "how"], _s=named(F.col("r.s")), _t=named(F.col("r.t")))
    turned = F.col("how") == "reversed"
    cites = F.array_intersect(F.coalesce("r.cite", F.array().cast("array<string>")), F.col("_ok"))
    rows = rows.select(
        "unit_id", "read", F.col("r.record").alias("record"), "relation_type",
        F.when(turned, F.col("_t")).otherwise(F.col("_s")).alias("source"), F.when(turned, F.col("_s")).otherwise(F.col("_t")).alias("target"), "how", cites.alias("cites"),
    )
    evidence = F.size("cites") + F.size("source.cites") + F.size("target.cites")
    return rows.withColumn("issue", F.when(evidence == 0, "MISSING_EVIDENCE"))


def same_place(left: Column, right: Column) -> Column:
    """Whether two lists of cites share one."""
    return F.arrays_overlap(left, right)


def inherited_remedies(causes: DataFrame, remedies: DataFrame, cap: int) -> DataFrame:
    """(unit_id, cause, action): remedies of a row's origin row that its causes lack, at most cap in a unit.

    causes(unit_id, row, origin, cause), remedies(unit_id, row, action). Of a unit the first by cause and action are taken.
    """
    given = remedies.select("unit_id", F.col("row").alias("origin"), "action").distinct()
    pairs = causes.filter("origin < row").join(given, ["unit_id", "origin"]).select("unit_id", "cause", "action").distinct()
    own = causes.join(remedies, ["unit_id", "row"]).select("unit_id", "cause", "action").distinct()
    fresh = pairs.join(own, ["unit_id", "cause", "action"], "left_anti")
    # the first of each unit: sorted arrays are small, a unit is a table
    first = F.slice(F.array_sort(F.collect_set(F.struct("cause", "action"))), 1, cap)
    return fresh.groupBy("unit_id").agg(first.alias("p")).select("unit_id", F.explode("p").alias("p")).select("unit_id", "p.cause", "p.action")


def cross_read_pairs(proposals: DataFrame) -> DataFrame:
    """(unit_id, relation_type, left, right): names that two reads give the same end of a relation whose other end is equal."""
    side = lambda end, other: F.struct(F.lit(end).alias("end"), F.col(other).alias("other"), F.col(end).alias("name"))
    sides = proposals.filter("unit_id is not null and relation_type is not null").select("unit_id", "relation_type", "read", F.explode(F.array(side("source_name", "target_name"), side("target_name", "source_name"))).alias("e"))
    sides = sides.select("unit_id", "relation_type", "e.*", "read").filter("other is not null and name is not null")
    key = ["unit_id", "relation_type", "end", "other"]
    # a name that several reads have is agreed on
    alone = sides.groupBy(*key, "name").agg(F.min("read").alias("read"), F.max("read").alias("_last")).filter(F.col("read").isin("A", "B") & (F.col("read") == F.col("_last")))
    of = lambda read: F.collect_list(F.when(F.col("read") == read, F.col("name")))
    met = alone.groupBy(*key).agg(of("A").alias("a"), of("B").alias("b")).filter((F.size("a") > 0) & (F.size("b") > 0))
    pairs = met.select("unit_id", "relation_type", F.explode("a").alias("left"), "b").select("unit_id", "relation_type", "left", F.explode("b").alias("right"))
    return pairs.select("unit_id", "relation_type", F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct()


def numbered_references(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(unit_id, row, number, entry, status): numbers of matrix rows resolved to the unit's numbered entries.

    rows(unit_id, row, pos, numbers), entries(unit_id, number, entry, pos). If entries stand before
    the first row of numbers and after the last, the side that has more of the numbers asked for
    counts; if both have as many, all count. A number with one entry is resolved; else it is unresolved.
    """
    asked = rows.select("unit_id", "row", F.explode(F.array_distinct("numbers")).alias("number"))
    bounds = rows.groupBy("unit_id").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    placed = entries.join(bounds, "unit_id").withColumn("side", F.when(F.col("pos") < F.col("first"), "before").when(F.col("pos") > F.col("last"), "after"))
    wanted = placed.join(asked.select("unit_id", "number").distinct(), ["unit_id", "number"], "left_semi")
    of = lambda s: F.count_distinct(F.when(F.col("side") == s, F.col("number")))
    scores = wanted.groupBy("unit_id").agg(of("before").alias("b"), of("after").alias("a"))
    kept = placed.join(scores, "unit_id", "left").filter("b is null or a = b or (b > a and side = 'before') or (a > b and side = 'after')")
    one = kept.groupBy("unit_id", "number").agg(F.count(F.lit(1)).alias("n"), F.min("entry").alias("entry")).filter("n = 1").drop("n")
    found = asked.join(one, ["unit_id", "number"], "left")
    return found.select("unit_id", "row", "number", "entry", F.when(F.col("entry").isNull(), "unresolved").otherwise("resolved").alias("status"))


def covered_items(items: DataFrame, assertions: DataFrame, fits: Column) -> DataFrame:
    """(item_id, status, assertion_ids): items that an assertion with one of their references represents.

    items(item_id, kind, text, refs), assertions(assertion_id, end_type, name, tier, refs). fits says
    whether an item and an assertion that meet mean the same. A green one makes the item
    REPRESENTED, else a red one REJECTED_PROPOSAL, else it is MISSING.
    """
    a = items.select("item_id", "kind", "text", F.explode("refs").alias("ref"))
    b = assertions.select("assertion_id", "end_type", "name", "tier", F.explode("refs").alias("ref"))
    met = a.join(b, "ref").filter(fits).filter("tier <> 'yellow'").groupBy("item_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("tier") == "green", F.col("assertion_id")))).alias("green"), F.array_sort(F.collect_set(F.when(F.col("tier") == "red", F.col("assertion_id")))).alias("red")
    )
    joined = items.select("item_id").join(met, "item_id", "left")
    status = F.when(F.size("green") > 0, "REPRESENTED").when(F.size("red") > 0, "REJECTED_PROPOSAL").otherwise("MISSING")
    ids = F.when(F.size("green") > 0, F.col("green")).when(F.size("red") > 0, F.col("red")).otherwise(F.array().cast("array<string>"))
    return joined.select("item_id", status.alias("status"), ids.alias("assertion_ids"))


def matched_locators(old: DataFrame, new: DataFrame, least: float, f1: Column) -> DataFrame:
    """(old_id, new_id, by): old evidence found again by its locator, else by the quote on its page that is most alike.

    old, new(id, locator, page, text); f1 compares old_text and new_text. Of equals the least id counts.
    """
    exact = new.groupBy("locator").agg(F.min("id").alias("by_place"))
    placed = old.join(exact, "locator", "left")
    lost = placed.filter("by_place is null").select(F.col("id").alias("old_id"), "page", F.col("text").alias("old_text"))
    near = lost.join(new.select(F.col("id").alias("n"), "page", F.col("text").alias("new_text")), "page").withColumn("f1", F.round(f1, 9)).filter(F.col("f1") >= least)
    best = near.groupBy("old_id").agg(F.min(F.struct((-F.col("f1")).alias("f"), "n")).alias("b")).select("old_id", F.col("b.n").alias("by_quote"))
    joined = placed.join(best, F.col("id") == F.col("old_id"), "left")
    how = F.when(F.col("by_place").isNotNull(), "locator").when(F.col("by_quote").isNotNull(), "quote")
    return joined.select(F.col("id").alias("old_id"), F.coalesce("by_place", "by_quote").alias("new_id"), how.alias("by"))


def judged_pairs(pairs: DataFrame, cap: int) -> DataFrame:
    """(pair_id, plan): pairs(pair_id, ord, answer, rationale, cites, left_cites, right_cites) as the judge's answers leave them.

    same needs a rationale and a cite of where each of the two names stands, else it is unsure, as
    is an answer that is missing or unknown. Pairs after the first cap are deferred.
    """
    both = F.arrays_overlap("cites", "left_cites") & F.arrays_overlap("cites", "right_cites")
    plan = F.when(F.col("answer") == "different", "different").when((F.col("answer") == "same") & (F.btrim("rationale") != "") & both, "same").otherwise("unsure")
    first = pairs.select("pair_id", "ord").orderBy("ord", "pair_id").limit(cap).select("pair_id", F.lit(True).alias("asked"))
    return pairs.join(first, "pair_id", "left").select("pair_id", F.when(F.col("asked"), plan).otherwise("deferred").alias("plan"))


def split_disagreements(relations: DataFrame, proposals: DataFrame, different: DataFrame) -> DataFrame:
    """(relation_id, part, reads, structure, agreement, verdict): relations taken apart where names were judged different.

    proposals(relation_id, n, read, source_name, target_name, structure), n = 0 leads. Proposals with
    an end judged different(left, right) from the lead's become parts of their own, s1, s2 .. in
    order. Each part has its own witnesses: agreement needs reads A and B in it, and the verdict
    stays with the part of the lead. relations(relation_id, agreement, verdict).
    """
    lead = proposals.filter("n = 0").select("relation_id", F.col("source_name").alias("ls"), F.col("target_name").alias("lt"))
    apart = different.select(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")).distinct()
    ends = proposals.join(lead, "relation_id").select("relation_id", "n", F.explode(F.array(F.struct(F.least("source_name", "ls").alias("a"), F.greatest("source_name", "ls").alias("b")), F.struct(F.least("target_name", "lt").alias("a"), F.greatest("target_name", "lt").alias("b")))).alias("e"))
    split = ends.select("relation_id", "n", "e.a", "e.b").join(apart, ["a", "b"], "left_semi").select("relation_id", "n").distinct()
    # parts are numbered in the order of their proposals; a relation has few
    numbers = split.groupBy("relation_id").agg(F.array_sort(F.collect_list("n")).alias("ns")).select("relation_id", F.posexplode("ns").alias("i", "n"))
    marked = proposals.join(numbers, ["relation_id", "n"], "left").withColumn("part", F.when(F.col("i").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("i") + 1)))
    grouped = marked.groupBy("relation_id", "part").agg(F.array_sort(F.collect_set("read")).alias("r"), F.coalesce(F.bool_or("structure"), F.lit(False)).alias("structure"))
    joined = grouped.join(relations, "relation_id")
    return joined.select(
        "relation_id", "part", F.array_join("r", "").alias("reads"), "structure",
        (F.col("agreement") & F.array_contains("r", "A") & F.array_contains("r", "B")).alias("agreement"), F.when(F.col("part") == "", F.col("verdict")).alias("verdict"),
    )


def pending_for_verifier(assertions: DataFrame, size: int) -> DataFrame:
    """(unit_id, assertion_id, batch): assertions that structure and agreement leave open, in batches of their unit.

    assertions(unit_id, assertion_id, structure, agreement, hypothesis): two witnesses settle one,
    but a hypothesis of structure still needs support.
    """
    settled = F.col("structure") & F.col("agreement") & ~F.col("hypothesis")
    place = F.row_number().over(Window.partitionBy("unit_id").orderBy("assertion_id"))
    return assertions.filter(~settled).select("unit_id", "assertion_id", F.ceil(place / size).cast("int").alias("batch"))


def review_delta(relations: DataFrame, decisions: DataFrame) -> DataFrame:
    """(relation_id, fate) after a review: people's rejections drop what rests on the same evidence, and duplicates go.

    relations(relation_id, key, evidence), decisions(key, evidence, decision). A rejection counts for
    its evidence only; new evidence is for people to see. Of equal key and evidence the least id stays.
    """
    said = decisions.groupBy("key", "evidence").agg(F.bool_or(F.col("decision") == "rejected").alias("gone"))
    about = decisions.select("key", F.lit(True).alias("known")).distinct()
    first = relations.groupBy("key", "evidence").agg(F.min("relation_id").alias("first"))
    joined = relations.join(said, ["key", "evidence"], "left").join(about, "key", "left").join(first, ["key", "evidence"])
    fate = F.when(F.col("gone"), "dropped").when(F.col("relation_id") > F.col("first"), "duplicate").when(F.col("known") & F.col("gone").isNull(), "to_people").otherwise("kept")
    return joined.select("relation_id", fate.alias("fate"))


def translated_cites(rows: DataFrame, aliases: DataFrame, key: str, cites: str) -> DataFrame:
    """(key, cites): cites with aliases(alias, target) replaced, unknown ones kept, in order."""
    each = rows.select(key, F.posexplode(cites).alias("i", "alias"))
    put = each.join(aliases, "alias", "left").select(key, F.struct("i", F.coalesce("target", "alias").alias("c")).alias("s"))
    return put.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["c"]).alias(cites))


def merge_context(names: DataFrame, relations: DataFrame, keep: int) -> DataFrame:
    """(name, context): the first distinct statements that a name is an end of, and those of its causes.

    relations(source_name, target_name, relation_type); statements are sorted, and keep of them taken.
    """
    says = F.concat_ws(" ", "source_name", "relation_type", "target_name").alias("says")
    rows = relations.select("source_name", "target_name", says).distinct()
    own = rows.select(F.col("source_name").alias("name"), "says").unionByName(rows.select(F.col("target_name").alias("name"), "says"))
    causes = rows.select(F.col("source_name").alias("name"), F.col("target_name").alias("cause")).distinct()
    further = causes.join(rows.select(F.col("source_name").alias("cause"), "says"), "cause").select("name", "says")
    both = own.unionByName(further).join(names.select("name").distinct(), "name", "left_semi").distinct()
    place = F.row_number().over(Window.partitionBy("name").orderBy("says"))
    first = both.withColumn("place", place).filter(F.col("place") <= keep)
    return first.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "says"))), lambda s: s["says"]), "; ").alias("context"))


def latest_relations(states: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """(assertion_id, ..): the last saved version of each assertion; states(prefix, file, assertion_id, ..), later prefixes overwrite."""
    rank = F.array_position(F.array(*[F.lit(p) for p in prefixes]), F.col("prefix"))
    rest = [c for c in states.columns if c not in ("assertion_id",)]
    best = states.filter(rank > 0).groupBy("assertion_id").agg(F.max(F.struct(rank.alias("_rank"), "file", *[c for c in rest if c != "file"])).alias("s"))
    return best.select("assertion_id", *[F.col(f"s.{c}").alias(c) for c in rest])


def projected(assertions: DataFrame, edges: list[str]) -> DataFrame:
    """(edge.., public, shown, status, reason) of each edge: what of it can be shown.

    assertions(edge.., tier, public, representable). Shown are non-red ones that can be located, green ones only if public.
    """
    public = (F.col("tier") == "green") & F.col("public")
    shown = (F.col("tier") != "red") & F.col("representable") & ((F.col("tier") != "green") | F.col("public"))
    counted = assertions.groupBy(*edges).agg(F.count_if(public).alias("public"), F.count_if(shown).alias("shown"), F.count_if(public & shown).alias("_both"))
    status = F.when(F.col("shown") == 0, "EMPTY").when((F.col("_both") == F.col("public")) & (F.col("_both") == F.col("shown")), "FULL").otherwise("PARTIAL")
    reason = F.when(F.col("public") == 0, "NO_PUBLIC_FACTS").when(F.col("shown") == 0, "NO_REPRESENTABLE_FACTS").otherwise("")
    return counted.select(*edges, "public", "shown", status.alias("status"), reason.alias("reason"))


def promoted(branches: DataFrame, confirmations: DataFrame, issues: DataFrame) -> DataFrame:
    """branches(branch_id, scope) with scope VERIFIED_REVIEW where a person or agent has confirmed a fact and nothing is at issue."""
    yes = confirmations.filter(F.col("reviewer").isin("human", "agent")).select("branch_id").distinct().withColumn("_yes", F.lit(True))
    no = issues.select("branch_id").distinct().withColumn("_no", F.lit(True))
    joined = branches.join(yes, "branch_id", "left").join(no, "branch_id", "left")
    return joined.select("branch_id", F.when(F.col("_yes") & F.col("_no").isNull(), "VERIFIED_REVIEW").otherwise(F.col("scope")).alias("scope"))


def recovered(rows: DataFrame, fresh: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, decided_by): new values, but what people decided stays; rows(key, value, decided_by), fresh(key, value)."""
    new = fresh.select(key, F.col(value).alias("_new"))
    joined = rows.join(new, key, "full_outer")
    mine = F.coalesce(F.col("decided_by") == "human", F.lit(False))
    return joined.select(key, F.when(mine | F.col("_new").isNull(), F.col(value)).otherwise(F.col("_new")).alias(value), F.when(mine, "human").otherwise("system").alias("decided_by"))


def aligned(left: Column, right: Column, one: Column, other: Column) -> Column:
    """Whether one stands once in left and other once in right, at the same place of lists of equal length; true for lists of one."""
    once = (F.size(F.filter(left, lambda x: x == one)) == 1) & (F.size(F.filter(right, lambda x: x == other)) == 1)
    several = (F.size(left) > 1) & (F.size(right) > 1)
    return ~several | (once & (F.array_position(left, one) == F.array_position(right, other)) & (F.size(left) == F.size(right)))


def step_context(steps: DataFrame) -> DataFrame:
    """steps(doc, seq, number, letter, pos, ..) with head, the first place of the sequence, and parent, the place of a sub-step's step."""
    heads = steps.groupBy("doc", "seq").agg(F.min("pos").alias("head"))
    parents = steps.filter("letter = ''").groupBy("doc", "seq", "number").agg(F.min("pos").alias("_parent"))
    joined = steps.join(heads, ["doc", "seq"]).join(parents, ["doc", "seq", "number"], "left")
    return joined.withColumn("parent", F.when(F.col("letter") != "", F.col("_parent"))).drop("_parent")


def restated(proposals: DataFrame, least: float = 0.9) -> DataFrame:
    """proposals with restated: whether the target is a cause that only repeats the source's name."""
    cause = F.coalesce(F.col("target_type") == "FailureMode", F.lit(False))
    score = similarity(F.when(cause, F.col("source_name")), F.when(cause, F.col("target_name")))
    return proposals.withColumn("restated", cause & (score >= least))


#: Actions that are so similar in one context are one.
SAME_ACTION = 0.75


def remedies_in_context(causes: DataFrame, remedies: DataFrame, cap: int) -> DataFrame:
    """(unit_id, row, cause, action, context): remedies of a row's origin row for its causes, in their context, at most cap in a unit.

    causes(unit_id, row, origin, cause), remedies(unit_id, row, ord, cause, action, context): of the
    remedies of one row those that are similar in one context to an earlier one are left out; what the
    unit has already, cause, action and context, is not proposed again. Each new triple comes once, at
    its first row; of a unit the first by row, cause and order are taken.
    """
    place = F.concat_ws("\u001f", "unit_id", "row")
    rows = remedies.select(place.alias("place"), "ord", "unit_id", "row", "action", F.coalesce("context", F.lit("")).alias("context"))

    def first_ones(part: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        for row in part:
            if not any(row[5] == other[5] and name_similarity(row[4], other[4]) >= SAME_ACTION for other in kept):
                kept.append(row)
        return kept

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("place", "ord", "unit_id", "row", "action", "context"))
    kept = in_groups(rows, "place", "ord", first_ones, schema).select("unit_id", F.col("row").alias("origin"), "ord", "action", "context")
    offered = causes.filter("origin < row").select("unit_id", "row", "origin", "cause").distinct().join(kept, ["unit_id", "origin"])
    have = remedies.select("unit_id", "cause", "action", F.coalesce("context", F.lit("")).alias("context")).distinct()
    fresh = offered.join(have, ["unit_id", "cause", "action", "context"], "left_anti").groupBy("unit_id", "cause", "action", "context").agg(F.min(F.struct("row", "ord")).alias("f"))
    first = F.row_number().over(Window.partitionBy("unit_id").orderBy("f.row", "cause", "f.ord", "action", "context"))
    return fresh.withColumn("n", first).filter(F.col("n") <= cap).select("unit_id", "f.row", "cause", "action", "context")
