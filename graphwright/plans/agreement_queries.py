"""Queries on reads that agree, names that contrast, and merges under constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphwright.operators import agreement as A
from graphwright.operators.merging import constrained_merges
from graphwright.operators.ordered import similar_pairs
from graphwright.operators.ranking import ranked
from graphwright.plans import graph_staging as GS
from graphwright.plans.checkpoints import cut, shuffled
from graphwright.registry import query
from graphwright.sources.tables import read_table

#: Order lines as proposals of three reads about units of ten parts.
READ = """
select distinct cast(floor(l_partkey / 10.0) as bigint) as unit_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, cast(l_quantity as int) as q, p_brand, p_name, p_type, p_size
from {lineitem} join {part} on l_partkey = p_partkey"""


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines as proposals: names are spelled in four ways, some ends are placeholders, some lines have a branch."""
    rows = GS.rows(spark, sf_dir, READ)
    order = Window.partitionBy("unit_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "q")
    n, s, q = F.col("l_linenumber"), F.col("l_suppkey"), F.col("q")
    words = F.split("p_name", " ")
    name = F.when(s % 4 == 0, F.col("p_name")).when(s % 4 == 1, F.upper("p_name")).when(s % 4 == 2, F.concat("p_name", F.lit("s"))).otherwise(F.array_join(F.reverse(words), " "))

    def end(type_: Column, name_: Column, code: Column, kind: Column, placeholder: Column, stated: Column) -> Column:
        return F.struct(type_.alias("type"), name_.alias("name"), code.alias("code"), kind.alias("kind"), placeholder.alias("placeholder"), stated.alias("stated"))

    none = F.lit(None).cast("string")
    cause = end(F.lit("FailureMode"), name, none, none, n == 7, F.col("l_returnflag") != "R")
    symptom = end(F.lit("Symptom"), F.concat_ws(" ", "p_brand", F.when(s % 3 == 0, "fails")), F.when(s % 10 < 2, F.concat(F.lit("E"), (s % 2).cast("string"))), none, F.lit(False), F.lit(True))
    action = end(F.lit("CorrectiveAction"), F.concat_ws(" ", F.lit("replace"), "p_type"), none, F.when(s % 5 == 0, "inspection").otherwise("repair"), F.lit(False), F.lit(True))
    resolved = n % 2 == 0
    return rows.select(
        "unit_id", F.row_number().over(order).cast("long").alias("ord"), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), n % 3 + 1).alias("read"),
        F.when(resolved, "RESOLVED_BY").otherwise("MAY_INDICATE").alias("relation"), F.when(s % 4 == 3, F.concat(F.lit("b"), "l_partkey")).alias("branch_id"), F.lit("EXPLICIT").alias("epistemic"),
        F.array(F.concat(F.lit("s"), F.col("l_partkey") + F.when(q > 45, 1).otherwise(0)), F.concat(F.lit("t"), (q % 7).cast("string"))).alias("cites"),
        F.when(q > 40, F.array(F.struct(F.lit("if").alias("kind"), F.col("l_returnflag").alias("text")))).alias("conditions"),
        F.when(resolved, cause).otherwise(symptom).alias("source"), F.when(resolved, action).otherwise(cause).alias("target"),
    )


@query("j11_same_relations")
def same_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of order lines of different reads that state one relation; held against all pairs in a test."""
    return A.same_relation_pairs(proposals(spark, sf_dir))


@query("j10_agreement_groups")
def agreement_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines of different reads taken together where they state one relation; held against a loop in a test."""
    rows = proposals(spark, sf_dir)
    return A.agreement_groups(rows, A.same_relation_pairs(rows))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as claims of manuals of a hundred: their beginnings are failures, their ends indicators, some have codes."""
    text = F.col("text")
    return read_table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 100).alias("manual"), F.col("doc_id").alias("claim_id"), F.substring(text, 1, 30).alias("failure"), F.substring(text, -24, 24).alias("indicator"), F.when(F.col("doc_id") % 5 == 0, "E1").alias("code")
    )


@query("g12_contrasts")
def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each manual that look alike, numbered from the most alike on; held against all pairs in a test."""
    found = cut(A.contrasts(claims(spark, sf_dir)))  # places are found in two passes
    order = [F.desc("similarity"), F.col("kind"), F.col("left_name"), F.col("right_name"), F.col("left_claims"), F.col("right_claims")]
    return ranked(found, ["manual"], order)


def merge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as names of manuals of two hundred, with what may keep them apart."""
    k = F.col("p_partkey")
    return read_table(spark, sf_dir, "part").select(
        F.floor(k / 200).alias("manual"), k.cast("string").alias("key"), F.col("p_name").alias("name"), F.when(k % 3 == 0, "FailureMode").when(k % 3 == 1, "Symptom").otherwise("CorrectiveAction").alias("type"),
        F.when(k % 11 == 0, F.concat(F.lit("b"), (k % 2).cast("string"))).alias("branch"), F.when(k % 3 == 2, F.when(k % 13 == 0, "inspection").otherwise("repair")).alias("kind"),
        F.when(k % 17 == 0, "INFERRED").otherwise("STATED").alias("status"), F.when((k % 3 == 1) & (k % 4 == 0), F.concat(F.lit("e"), (k % 5).cast("string"))).alias("code"), F.lit("").alias("digits"),
    )


@query("g01_constrained_merges")
def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar names merged from the most similar on, under all constraints, with what was blocked; held against a loop in a test."""
    nodes = shuffled(cut(merge_nodes(spark, sf_dir)))
    pairs = shuffled(cut(similar_pairs(nodes.select(F.concat_ws(":", "manual", "type").alias("block"), "key", "name"), "block", "key", "name", 0.7)))
    pairs = pairs.withColumn("manual", F.split_part("block", F.lit(":"), F.lit(1)).cast("long"))
    order = F.row_number().over(Window.partitionBy("manual").orderBy(F.desc("score"), "left_key", "right_key"))
    apart = pairs.filter("score < 0.75").select("manual", "left_key", "right_key")
    return constrained_merges(nodes, pairs.withColumn("ord", order), apart, "manual")
