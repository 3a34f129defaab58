"""Queries that score: labelled documents are claims, sources and languages their branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphwright.functions import text as T
from graphwright.operators import scoring as G
from graphwright.plans.text_queries import _f1, _words
from graphwright.registry import query
from graphwright.sources.tables import read_table


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        "doc_id", "lang", F.concat_ws("-", "source", F.col("doc_id") % 9).alias("branch"), (F.col("doc_id") % 3).alias("run"),
        (F.col("n_chars") % 5 != 0).alias("found"), (F.col("quality") == 1).alias("has_action"), "toxic", "n_chars",
    )


_CLAIM = """
claim as (
  select d.doc_id, lang, source || '-' || (d.doc_id % 9) as branch, d.doc_id % 3 as run, n_chars % 5 <> 0 as found, quality = 1 as has_action, toxic, n_chars
  from documents d join labels l on d.doc_id = l.doc_id
), hit as (
  select lang, branch, bool_and(found) as hit, count(*) as claims, count(*) filter (where found) as found, bool_or(has_action) as has_action from claim group by lang, branch
)"""
_WILSON = """coalesce(round((h / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt((h / n) * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 3), 0.0) as low,
  coalesce(round((h / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt((h / n) * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 3), 0.0) as high"""


@query(
    "a21_branch_recall",
    f"""with {_CLAIM}, totals as (select lang, count(*) as branches, count(*) filter (where hit) as hits, sum(claims)::bigint as claims, sum(found)::bigint as found from hit group by lang),
    intervals as (select lang, {_WILSON} from (select lang, hits::double as h, branches::double as n from totals)) select t.*, low, high from totals t join intervals i using (lang)""",
)
def branch_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of branches by language, with intervals."""
    return G.branch_recall(_claims(spark, sf_dir), "lang", "branch")


@query(
    "a23_stability_range",
    f"""with {_CLAIM}, runs as (select lang, run, round(avg(found::int), 6) as recall from claim group by lang, run) select lang, min(recall) as least, max(recall) as most, count(*) as runs from runs group by lang""",
)
def stability_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of recall over three runs."""
    runs = _claims(spark, sf_dir).groupBy("lang", "run").agg(F.round(F.avg(F.col("found").cast("int")), 6).alias("recall"))
    return runs.groupBy("lang").agg(F.min("recall").alias("least"), F.max("recall").alias("most"), F.count(F.lit(1)).alias("runs"))


@query(
    "a27_branch_strata",
    f"with {_CLAIM} select lang, has_action, count(*) as branches, count(*) filter (where hit) as hits from hit group by lang, has_action",
)
def branch_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of branches with an action and of those with causes only."""
    hit = _claims(spark, sf_dir).groupBy("lang", "branch").agg(F.bool_and("found").alias("hit"), F.bool_or("has_action").alias("has_action"))
    return hit.groupBy("lang", "has_action").agg(F.count(F.lit(1)).alias("branches"), F.count_if("hit").alias("hits"))


@query(
    "a29_precision_totals",
    f"""with {_CLAIM} select coalesce(lang, 'all') as lang, coalesce(run::varchar, 'all') as run, count(*) as claims, count(*) filter (where found and toxic = 0) as correct, count(*) filter (where found and toxic = 1) as partial, round(count(*) filter (where found and toxic = 0) / count(*), 6) as strict
    from claim group by grouping sets ((lang, run), (lang), ())""",
)
def precision_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged claims by language and run, by language, and over all."""
    claims = _claims(spark, sf_dir).withColumn("run", F.col("run").cast("string"))
    correct = F.count_if(F.col("found") & (F.col("toxic") == 0))
    totals = claims.groupingSets([["lang", "run"], ["lang"], []], "lang", "run").agg(
        F.count(F.lit(1)).alias("claims"), correct.alias("correct"), F.count_if(F.col("found") & (F.col("toxic") == 1)).alias("partial"), F.round(correct / F.count(F.lit(1)), 6).alias("strict")
    )
    return totals.withColumn("lang", F.coalesce("lang", F.lit("all"))).withColumn("run", F.coalesce("run", F.lit("all")))


@query(
    "a34_condition_report",
    f"""with {_CLAIM}, docs as (select lang, branch, avg(found::int) as recall, count(*) as n, count(*) filter (where found) as k from claim group by lang, branch)
    select lang, round(sum(k) / sum(n), 6) as micro, round(avg(recall), 6) as macro, round(min(recall), 6) as least, round(max(recall), 6) as most from docs group by lang""",
)
def condition_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro and macro recall by language."""
    docs = _claims(spark, sf_dir).groupBy("lang", "branch").agg(F.avg(F.col("found").cast("int")).alias("recall"), F.count(F.lit(1)).alias("n"), F.count_if("found").alias("k"))
    return docs.groupBy("lang").agg(
        F.round(F.sum("k") / F.sum("n"), 6).alias("micro"), F.round(F.avg("recall"), 6).alias("macro"), F.round(F.min("recall"), 6).alias("least"), F.round(F.max("recall"), 6).alias("most")
    )


@query(
    "a25_vote_majority",
    """with votes as (select l_partkey, l_suppkey % 5 as pair, l_linenumber, l_returnflag = 'A' as same, row_number() over (partition by l_partkey, l_suppkey % 5 order by l_shipdate desc, l_orderkey, l_linenumber) as n from lineitem)
    select l_partkey, pair, count(*) as votes, sum(same::int)::bigint as yes, sum(same::int) * 2 > count(*) as majority from votes where n <= 3 group by l_partkey, pair""",
)
def vote_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The majority of the last three votes on each pair."""
    votes = read_table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_suppkey") % 5).alias("pair"), "l_shipdate", "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "A").cast("int").alias("same"))
    last = Window.partitionBy("l_partkey", "pair").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber")
    kept = votes.withColumn("n", F.row_number().over(last)).filter("n <= 3")
    return kept.groupBy("l_partkey", "pair").agg(F.count(F.lit(1)).alias("votes"), F.sum("same").alias("yes"), (F.sum("same") * 2 > F.count(F.lit(1))).alias("majority"))


@query(
    "a26_contrast_pairs",
    """with sides as (select l_orderkey // 2 as pair, l_orderkey % 2 as side, list_distinct(list(l_partkey)) as nodes from lineitem group by all)
    select a.pair, len(a.nodes) as left_nodes, len(b.nodes) as right_nodes, not list_has_any(a.nodes, b.nodes) as kept from sides a join sides b on a.pair = b.pair and a.side = 0 and b.side = 1""",
)
def contrast_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring orders that share no part."""
    sides = read_table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 2).alias("pair"), (F.col("l_orderkey") % 2).alias("side")).agg(F.collect_set("l_partkey").alias("nodes"))
    a, b = sides.filter("side = 0").select("pair", F.col("nodes").alias("a")), sides.filter("side = 1").select("pair", F.col("nodes").alias("b"))
    return a.join(b, "pair").select("pair", F.size("a").alias("left_nodes"), F.size("b").alias("right_nodes"), (~F.arrays_overlap("a", "b")).alias("kept"))


@query(
    "a33_weighted_support",
    """with judged as (select c_mktsegment, 1.0 / (1 + c_custkey % 4) as probability, case when c_custkey % 10 < 8 then c_acctbal > 0 end as supported from customer),
    sums as (select c_mktsegment, sum(case when supported then 1.0 / probability else 0.0 end) as yes, sum(case when supported is not null then 1.0 / probability else 0.0 end) as known, sum(1.0 / probability) as total from judged group by c_mktsegment)
    select c_mktsegment, round(yes / nullif(known, 0), 6) as estimate, round(yes / total, 6) as lower, round((yes + total - known) / total, 6) as upper from sums""",
)
def weighted_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support in a sample with unequal probabilities, and its bounds."""
    key = F.col("c_custkey")
    judged = read_table(spark, sf_dir, "customer").select("c_mktsegment", (1.0 / (1 + key % 4)).alias("probability"), F.when(key % 10 < 8, F.col("c_acctbal") > 0).alias("supported"))
    return G.weighted_share(judged, "c_mktsegment")


@query(
    "o14_stratified_sample",
    """with ranked as (select lang, doc_id, row_number() over (partition by lang order by sha256('7|' || doc_id), doc_id) as n, count(*) over (partition by lang) as size from documents)
    select lang, doc_id, round(least(10, size) / size, 9) as probability from ranked where n <= 10""",
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents of each language with the probability of being drawn."""
    docs = read_table(spark, sf_dir, "documents").select("lang", "doc_id")
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    digest = F.sha2(F.concat_ws("|", F.lit("7"), "doc_id"), 256)
    ranked = docs.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(digest, "doc_id"))).filter("n <= 10")
    return ranked.join(sizes, "lang").select("lang", "doc_id", F.round(F.least(F.lit(10), F.col("size")) / F.col("size"), 9).alias("probability"))


@query(
    "j26_gold_candidates",
    f"""with worded as (select item_id, text, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 4)) as words from benchmark),
    pairs as (select a.item_id as gold_id, b.item_id as id, round({_f1("a.text", "b.text")}, 9) as score from worded a join worded b on a.item_id <> b.item_id and list_has_any(a.words, b.words)),
    ranked as (select *, row_number() over (partition by gold_id order by score desc, id)::int as place from pairs where score >= 0.1) select gold_id, id, score, place from ranked where place <= 8""",
)
def gold_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most similar other items of each benchmark item, among those that share a longer word."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1), lambda w: F.length(w) >= 4))
    items = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", words.alias("words"))
    return G.candidates(items, items, T.token_f1(F.col("gold_text"), F.col("text")), 0.1, 8)
