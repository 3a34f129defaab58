"""Queries of order-dependent operators; most are beyond SQL and are held against brute force in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphwright.operators import ordered as O
from graphwright.plans import staging as S
from graphwright.registry import query
from graphwright.sources.tables import read_table


@query("j12_similar_names")
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar part names of one brand."""
    names = read_table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("key"))
    return O.similar_pairs(names, "p_brand", "key", "p_name", 0.6)


@query("w11_greedy_bins")
def greedy_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of documents packed into bins of 2,000 characters."""
    rows = S.segments(spark, sf_dir).select("doc_id", "pos", F.length("text").alias("chars"))
    return O.greedy_bins(rows, "doc_id", "pos", "chars", 2000)


@query("j10_agreement_pairs")
def agreement_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals of read A with those of read B in their unit that agree."""
    rows = S.proposals(spark, sf_dir)
    order = F.row_number().over(Window.partitionBy("unit_id").orderBy("row", "relation_type", "source_name", "target_name", "verdict")).cast("long")
    return O.agreement_pairs(rows.select("unit_id", order.alias("ord"), "read", "source_name", "target_name"), "unit_id", 0.5)


@query("g01_constrained_groups")
def constrained_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names of a brand merged where similar, unless their types differ."""
    parts = read_table(spark, sf_dir, "part")
    nodes = parts.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("key"), F.min("p_type").alias("label"))
    pairs = O.similar_pairs(nodes, "p_brand", "key", "p_name", 0.5)
    order = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("score"), "left_key", "right_key"))
    return O.constrained_groups(pairs.withColumn("ord", order), nodes, "p_brand", "key", "label")


@query("g04_best_matching")
def best_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts matched to suppliers within an order, by quantity."""
    edges = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_partkey").alias("left_id"), F.col("l_suppkey").alias("right_id"), F.col("l_quantity").cast("long").alias("weight")
    )
    return O.best_matching(edges, "l_orderkey")


@query("g11_cluster_bootstrap")
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by language with a bootstrap bound over documents."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    clusters = docs.join(labels, "doc_id").groupBy("lang", F.col("source").alias("cluster")).agg(F.count_if(F.col("n_chars") % 5 != 0).alias("hits"), F.count(F.lit(1)).alias("total"))
    return O.cluster_bootstrap(clusters, "lang", "hits", "total", 400)


@query(
    "w12_running_parts",
    f"""with {S.SEGMENT} select doc_id, pos, floor((sum(length(text)) over (partition by doc_id order by pos) - 1) / 3000)::int as part from segment""",
)
def running_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments in parts of 3,000 characters by their running length."""
    rows = S.segments(spark, sf_dir).select("doc_id", "pos", F.length("text").alias("chars"))
    return O.running_bins(rows, "doc_id", F.col("pos"), "chars", 3000).select("doc_id", "pos", "part")
