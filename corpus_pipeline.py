"""A corpus pipeline of five stages, each by one operator of graphwright.llm.

Stages take (spark, docs, sf_dir) and return the columns of documents; the last one adds shard and
slot. Each works on all rows that its predecessor kept. Null and empty texts are clean, are each
other's near-duplicates, hold no benchmark item and weigh nothing in the mix, so of them none is
left after it. Ids may be null or repeat: rows are told apart by id and text. Of equal rows one
stays. Further columns are kept, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.llm.decontaminate import without_leaks
from graphwright.llm.mixing import materialised
from graphwright.llm.sharding import shard_rows
from graphwright.llm.shingles import one_of_each_group
from graphwright.llm.toxicity import score_toxicity
from graphwright.plans.checkpoints import cut
from graphwright.sources.tables import read_table

SHARDS = 24
#: Rows of an Arrow batch: whole texts are long, and an executor holds several batches at once.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Has texts sent to Python in small batches, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's own default, for slim rows
        spark.conf.set(key, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half, learned from all labels."""
    small_batches(spark)
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    slim = docs.select("doc_id", "text")
    # whole rows travel as one column, so that no name of theirs can clash
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return score_toxicity(packed, slim, labels).filter("toxicity < 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: a Jaccard similarity of 0.8 or more of five-word shingles."""
    small_batches(spark)
    return one_of_each_group(docs, words_in_shingle=5)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at target weights; a row that the mix takes twice is there twice."""
    return materialised(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot."""
    small_batches(spark)
    return shard_rows(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("mixing", mix),
    ("sharding", shard),
]

#: Classifiers and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents, one after another.

    Between stages rows are written to the checkpoint folder, so that no stage is computed twice.
    """
    docs = read_table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = cut(docs)
    return docs
