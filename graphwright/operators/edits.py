"""Edits of a graph: operations applied in order, checks, and what they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def apply_field_edits(rows: DataFrame, edits: DataFrame, key: str, field: str) -> DataFrame:
    """rows with the value of the last edit of the field, and whether it changed; edits(key, ord, value)."""
    last = edits.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct("ord", "value")).alias("_e"))
    joined = rows.join(last, F.col(key) == F.col("_key"), "left")
    value = F.when(F.col("_e").isNotNull(), F.col("_e.value")).otherwise(F.col(field))
    return joined.withColumn("changed", ~value.eqNullSafe(F.col(field))).withColumn(field, value).drop("_key", "_e")


def delete_nodes(nodes: DataFrame, edges: DataFrame, deleted: DataFrame, key: str, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the deleted nodes and all edges at them."""
    gone = deleted.select(F.col(key).alias("_gone")).distinct()
    left = nodes.join(gone, F.col(key) == F.col("_gone"), "left_anti")
    kept = edges.join(gone, F.col(source) == F.col("_gone"), "left_anti").join(gone, F.col(target) == F.col("_gone"), "left_anti")
    return left, kept


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that several rows have, with their number."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def degrees(edges: DataFrame, source: str, target: str, loops: int = 1) -> DataFrame:
    """(node, degree, neighbours) counting both ends; a loop counts once, or for both of its ends with loops=2."""
    turned = edges if loops == 2 else edges.filter(F.col(source) != F.col(target))
    ends = edges.select(F.col(source).alias("node"), F.col(target).alias("other")).unionByName(
        turned.select(F.col(target).alias("node"), F.col(source).alias("other"))
    )
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.count_distinct("other").alias("neighbours"))


def completeness(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, state, n): how many values of each field are filled, empty, not stated or missing."""
    states = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), state.alias("state")) for name, state in fields.items()]))
    return rows.select(states.alias("s")).groupBy("s.field", "s.state").agg(F.count(F.lit(1)).alias("n"))


def page_of_rows(rows: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    """One page of rows in this order, with the total number of rows and the place of each."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    place = F.row_number().over(Window.orderBy(*order))
    first = rows.orderBy(*order).limit(offset + limit)
    return first.withColumn("place", place).filter(F.col("place") > offset).join(total)
