"""A graph with occurrences, an edited copy of it, and edits, all derived from the given tables.

The texts are SQL that Spark and DuckDB read alike; {part} and the like stand for the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.plans.checkpoints import dealt, shuffled
from graphwright.sources.tables import read_table

#: Tables whose files are small for their rows, so that Spark would send them through the driver.
_DENSE = ("part", "customer")

NODE = """
select 'ROOT' as node_id, 'Asset' as type, 'Machine' as name, cast(null as string) as component
union all select distinct 'Y:' || p_brand, 'Symptom', p_brand, cast(null as string) from {part}
union all select 'C:' || p_partkey, 'FailureMode', p_name || ' ' || (p_partkey % 40), case when p_partkey % 11 = 0 then null when p_partkey % 13 = 0 then 'unknown' when p_partkey % 17 = 0 then ' ' else p_type end from {part}
union all select 'A:' || s_suppkey, 'CorrectiveAction', s_name, cast(null as string) from {supplier}
union all select 'E:' || n_nationkey, 'ErrorCode', n_name, cast(null as string) from {nation}"""

EDGE = """
select type || '|' || source || '|' || target as edge_id, type, source, target, derived from (
  select distinct 'MAY_INDICATE' as type, 'Y:' || p_brand as source, 'C:' || p_partkey as target, false as derived from {part}
  union all select distinct 'RESOLVED_BY', 'C:' || l_partkey, 'A:' || l_suppkey, false from {lineitem} where l_partkey % 9 <> 0
  union all select distinct 'INDICATES', 'E:' || s_nationkey, 'C:' || s_suppkey, false from {supplier}
  union all select distinct 'GENERATES_ERROR', 'ROOT', 'E:' || n_nationkey, true from {nation}
) as e"""

OCCURRENCE = """
select distinct 'RESOLVED_BY|C:' || l_partkey || '|A:' || l_suppkey as edge_id, l_orderkey || '.' || l_linenumber as occ_id,
  case when l_orderkey % 37 = 0 then null else 'p' || l_linenumber || '.b' || cast(l_quantity as int) end as segment,
  case when l_quantity > 20 then 'if ' || l_returnflag end as condition, l_returnflag = 'A' as trusted,
  case when l_orderkey % 19 = 0 then 'rejected' when l_orderkey % 23 = 0 then 'confirmed' end as status
from {lineitem} where l_partkey % 9 <> 0
union all select 'MAY_INDICATE|Y:' || p_brand || '|C:' || p_partkey, 'm' || p_partkey, 'p' || p_size || '.b1', case when p_size > 30 then 'if A' when p_size > 20 then 'if X' end, p_size > 10, case when p_partkey % 8 = 0 then 'rejected' end from {part}
union all select distinct 'INDICATES|E:' || s_nationkey || '|C:' || s_suppkey, 'i' || s_suppkey, 'p1.b' || s_nationkey, cast(null as string), true, cast(null as string) from {supplier}"""

#: The edited copy: repeated and retyped nodes, renamed ones, turned, repeated and dangling edges, occurrences gone.
NEW_NODE = f"""
select node_id, case when node_id like 'C:%7' and component is null then 'Gadget' else type end as type,
  case when node_id like 'C:%55' then ' ' when node_id like 'C:%33' then name || 's' else name end as name,
  case when node_id like 'C:%9' then null else component end as component from ({NODE}) as n
union all select node_id, type, name, component from ({NODE}) as n where node_id like 'C:%91'
union all select 'N:' || c_custkey, case when c_custkey % 2 = 0 then 'FailureMode' else 'Symptom' end, c_name, c_mktsegment from {{customer}} where c_acctbal < 0"""

NEW_EDGE = f"""
select case when target like '%44' then edge_id || '#' else edge_id end as edge_id, type, case when source like '%66' then target else source end as source,
  case when source like '%66' then source when source like '%67' then 'A:gone' else target end as target, derived from ({EDGE}) as e where source not like '%68'
union all select edge_id || '+', type, source, target, derived from ({EDGE}) as e where target like 'A:%7' and source like '%1'
union all select edge_id, type, source, target, false from ({EDGE}) as e where derived and target like '%3'"""

NEW_OCCURRENCE = f"""
select case when edge_id like '%44' then edge_id || '#' else edge_id end as edge_id, occ_id, case when occ_id like '%71' then null else segment end as segment, condition, trusted, status
from ({OCCURRENCE}) as o where edge_id not like '%68|A%' and occ_id not like 'm%2'"""

#: What the orders, lines and customers ask to be changed.
NODE_ADDITION = """
select c_custkey as ord, case when c_custkey % 10 = 0 then 'C:' || c_custkey when c_custkey % 10 = 1 then 'T:' || cast(floor(c_custkey / 100.0) as bigint) else 'T:' || c_custkey end as node_id,
  case c_mktsegment when 'BUILDING' then 'FailureMode' when 'MACHINERY' then 'CorrectiveAction' when 'HOUSEHOLD' then 'Asset' when 'AUTOMOBILE' then 'Symptom' else 'Gadget' end as type,
  c_name as name, case when c_acctbal < 0 then 'node_id' when c_nationkey % 9 = 0 then 'name' else 'component' end as field from {customer}"""

EDGE_EDIT = """
select o_orderkey as ord, case o_orderkey % 3 when 0 then 'delete' when 1 then 'add' else 'replace' end as op,
  case when o_orderkey % 29 = 0 then 'GENERATES_ERROR|ROOT|E:' || (o_custkey % 25) else 'RESOLVED_BY|C:' || o_custkey || '|A:' || (o_orderkey % 100 + 1) end as edge_id,
  'RESOLVED_BY' as type, 'C:' || o_custkey as source, 'A:' || (o_orderkey % 90 + 1) as target from {orders}"""

OCCURRENCE_EDIT = """
select max(ord) as ord, edge_id, occ_id, max(op) as op, max(segment) as segment, max(condition) as condition from (
  select l_orderkey * 10 + l_linenumber as ord, 'RESOLVED_BY|C:' || l_partkey || '|A:' || l_suppkey as edge_id,
    case when l_suppkey % 4 = 2 then 'x' || l_orderkey || '.' || l_linenumber else l_orderkey || '.' || l_linenumber end as occ_id,
    case l_suppkey % 4 when 0 then 'delete' when 1 then 'update' when 2 then 'add' else 'none' end as op,
    'p' || l_linenumber || '.b' || (cast(l_quantity as int) + case when l_partkey % 2 = 0 then 0 else 1 end) as segment,
    case when l_quantity > 20 then 'if ' || l_returnflag end as condition
  from {lineitem} where l_partkey % 9 <> 0
) as e where op <> 'none' group by edge_id, occ_id"""

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def named(**texts: str) -> str:
    """Common table expressions for DuckDB."""
    return ", ".join(f"{name} as materialized ({text.format(**{t: t for t in _TABLES})})" for name, text in texts.items())


def rows(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The rows of one of the texts."""
    tables = sorted(set(re.findall(r"\{(\w+)\}", text)))
    read = {t: read_table(spark, sf_dir, t) for t in tables}
    return spark.sql(text, **{t: shuffled(df) if t in _DENSE else df for t, df in read.items()})


def repeated(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The rows of one of the texts, some of them more than once: for what only asks whether there is one."""
    return rows(spark, sf_dir, text.replace("select distinct", "select"))


def occurrences(spark: SparkSession, sf_dir: str, new: bool = False) -> DataFrame:
    """The rows of OCCURRENCE or NEW_OCCURRENCE, shuffled once: dealt by the edge, where equal rows of a table meet."""
    lines = read_table(spark, sf_dir, "lineitem").count()
    parts = []
    for text in OCCURRENCE.split("\nunion all "):
        found = repeated(spark, sf_dir, text).toDF("edge_id", "occ_id", "segment", "condition", "trusted", "status")
        if new:
            # no other edge ends in the mark, so rows are equal after it if they were before
            found = found.filter("edge_id not like '%68|A%' and occ_id not like 'm%2'").withColumn("edge_id", F.expr("case when edge_id like '%44' then edge_id || '#' else edge_id end"))
        found = dealt(found, "edge_id", lines, 50_000)
        parts.append(found.distinct() if "distinct" in text else found)
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.withColumn("segment", F.expr("case when occ_id like '%71' then null else segment end")) if new else every
