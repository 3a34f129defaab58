"""Sources that are JSON texts: strict ledgers, event logs, graphs, bundles with a manifest.

Each takes a DataFrame of texts, so the same code serves files (spark.read.text), tables and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Versions of graph texts that can be read.
GRAPH_VERSIONS = (2, 3)
GRAPH = "version int, nodes array<struct<id:string,type:string,name:string>>, edges array<struct<id:string,type:string,from:string,to:string,tier:string>>"


def json_lines(lines: DataFrame, value: str, schema: str) -> DataFrame:
    """The objects in lines, one each; a line that is torn, blank or no object ends the job with an error.

    A ledger with a broken line must not be read in part, so nothing is skipped.
    """
    found = F.from_json(value, f"{schema}, _torn string", {"columnNameOfCorruptRecord": "_torn"})
    rows = lines.withColumn("_o", found)
    whole = F.col("_o").isNotNull() & F.col("_o._torn").isNull() & F.btrim(value).startswith("{")
    checked = F.when(whole, F.col("_o")).otherwise(F.raise_error(F.concat(F.lit("not a whole object: "), F.coalesce(F.substring(value, 1, 80), F.lit("null")))))
    kept = [c for c in lines.columns if c != value]
    # the check stands before any column is taken, so pruning can't drop it
    return rows.filter(checked.isNotNull()).select(*kept, "_o.*").drop("_torn")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of a file of lines, read strictly."""
    return json_lines(spark.read.text(path), "value", schema)


def graphs(texts: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status, nodes, edges): graph texts that can be read, or why not: NOT_JSON, VERSION or SHAPE."""
    parsed = texts.select(key, F.from_json(value, GRAPH).alias("_graph"))
    shaped = F.col("_graph.nodes").isNotNull() & F.col("_graph.edges").isNotNull() & F.forall("_graph.nodes", lambda n: n["id"].isNotNull() & n["type"].isNotNull()) & F.forall("_graph.edges", lambda e: e["from"].isNotNull() & e["to"].isNotNull())
    status = F.when(F.col("_graph").isNull() | (F.col("_graph.version").isNull() & F.col("_graph.nodes").isNull() & F.col("_graph.edges").isNull()), "NOT_JSON").when(~F.coalesce(F.col("_graph.version").isin(*GRAPH_VERSIONS), F.lit(False)), "VERSION").when(~F.coalesce(shaped, F.lit(False)), "SHAPE").otherwise("READ")
    return parsed.select(key, status.alias("status"), F.col("_graph.nodes").alias("nodes"), F.col("_graph.edges").alias("edges"))


def graphs_in_parts(texts: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status, nodes, edges): graphs that come in several texts, as what the worst of them is, with the numbers of nodes and edges that were read.

    Each part is a graph text of its own, so none has to hold a whole graph.
    """
    order = ("READ", "SHAPE", "VERSION", "NOT_JSON")
    parts = graphs(texts, key, value)
    size = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.size(c)).cast("long")).alias(c)
    worst = F.max(F.array_position(F.array(*map(F.lit, order)), F.col("status")).cast("int"))
    return parts.groupBy(key).agg(F.element_at(F.array(*map(F.lit, order)), worst).alias("status"), size("nodes"), size("edges"))


def verified_bundles(files: DataFrame, manifest: DataFrame, bundle: str) -> DataFrame:
    """(bundle, status): VERIFIED if all files have the digest that the manifest names, STALE if one differs or lacks, LEGACY_UNVERIFIED without a manifest.

    files(bundle, path, digest), manifest(bundle, path, digest).
    """
    named = manifest.select(bundle, "path", F.col("digest").alias("_named"))
    both = files.select(bundle, "path", "digest").join(named, [bundle, "path"], "full_outer")
    wrong = ~F.col("digest").eqNullSafe(F.col("_named"))
    state = both.groupBy(bundle).agg(F.count("_named").alias("n"), F.bool_or(wrong).alias("wrong"))
    return state.select(bundle, F.when(F.col("n") == 0, "LEGACY_UNVERIFIED").when(F.col("wrong"), "STALE").otherwise("VERIFIED").alias("status"))


def ranked_states(files: DataFrame, order: tuple[str, ...], run: str) -> DataFrame:
    """files(run, name, modified) with rank and place: by the pipeline's order of name prefixes, then by time; unknown prefixes last."""
    rank = F.lit(len(order))
    for i, prefix in reversed(list(enumerate(order))):
        rank = F.when(F.col("name").startswith(prefix), i).otherwise(rank)
    ranked = files.withColumn("rank", rank)
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(run).orderBy("rank", "modified", "name")))


def selective_reading(pages: DataFrame, document: str, wanted: Column, budget: int) -> DataFrame:
    """pages(document, page, ..) with outcome: not_needed, read for the first wanted pages of a document, skipped_budget for the rest."""
    place = F.row_number().over(Window.partitionBy(document, "_wanted").orderBy("page"))
    marked = pages.withColumn("_wanted", F.coalesce(wanted, F.lit(False))).withColumn("_place", place)
    outcome = F.when(~F.col("_wanted"), "not_needed").when(F.col("_place") <= budget, "read").otherwise("skipped_budget")
    return marked.withColumn("outcome", outcome).drop("_wanted", "_place")


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """Writes nodes and edges as JSON lines under folder and returns the manifest (path, rows, digest), which is written last.

    The digest of a part is that of its rows' digests in order of their number, so it doesn't depend on files.
    """
    parts = []
    for name, rows in (("nodes", nodes), ("edges", edges)):
        rows.write.mode("overwrite").json(f"{folder}/{name}")
        parts.append(digest_of(rows.sparkSession.read.json(f"{folder}/{name}", schema=rows.schema), name))
    manifest = parts[0].unionByName(parts[1])
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


def digest_of(rows: DataFrame, name: str) -> DataFrame:
    """(path, rows, digest) of a table: an order-free sum of its rows' hashes, so partitions don't matter."""
    row = F.xxhash64(F.to_json(F.struct("*")))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(38,0)")).alias("s")).select(F.lit(name).alias("path"), "rows", F.sha2(F.concat_ws("|", "rows", F.coalesce("s", F.lit(0)).cast("string")), 256).alias("digest"))
