"""Cutting lineage in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a local session without that setting, as in tests, gets a folder of its own; on a cluster a
    missing setting is an error, since executors share no local disk.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return folder or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the reliable checkpoint folder (shared_folder) and read from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """df, joined by shuffles whatever size Spark takes it for.

    Sizes are guessed from files, and a cut table keeps the guess: a few MB of Parquet with repeated
    values are a million rows, and a broadcast of these passes through the driver. The mark holds for
    what is selected, exploded or grouped from df, and ends at a cut.
    """
    return df.hint("merge")


def dealt(df: DataFrame, key: str, rows: int, most: int) -> DataFrame:
    """df, dealt by key to as many tasks as a shuffle has, or more if `rows` are more than `most` to a task; of one query, with the same numbers."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))
    return df.repartition(tasks, key)


def kept_together(spark: SparkSession) -> SparkSession:
    """A session like spark in which tables that were dealt by some of the keys of a join, to as many tasks, are joined where they are.

    By default Spark deals both sides again by all keys of the join. Only for tables whose share of a
    task is bounded; the given session stays as it is.
    """
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return session
