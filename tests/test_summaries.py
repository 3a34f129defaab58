"""Summaries on literal inputs."""

from pyspark.sql import functions as F

from graphwright.operators import summaries as Y


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_majority_labels(spark):
    votes = [(1, "other", 2), (1, "parts", 1), (2, "other", 1), (2, "other", 2), (2, "parts", 0), (3, "diagnostic", 9), (3, "other", 1), (3, "other", 2), (4, "parts", 1)]
    assert rows(Y.majority_labels(spark.createDataFrame(votes, "page int, label string, ord int"), "page")) == [(1, "parts", True), (2, "other", True), (3, "diagnostic", True), (4, "parts", False)]


def test_coverage_status(spark):
    relations = spark.createDataFrame([("a", "r1", True), ("a", "r1", True), ("a", "r2", False), ("b", "r3", False), ("x", "r4", True)], "item string, relation string, accepted boolean")
    assert rows(Y.coverage_status(spark.createDataFrame([("a",), ("b",), ("c",)], "item string"), relations)) == [("a", "REPRESENTED", 1), ("b", "REJECTED_PROPOSAL", 0), ("c", "MISSING", 0)]


def test_usage_and_attempts(spark):
    log = spark.createDataFrame([(1, 1, "x", 5), (1, 2, "run_started", 1), (1, 3, "x", 2), (1, 4, "run_started", 0), (2, 1, "x", 7)], "run_id int, seq int, kind string, c long")
    assert rows(Y.usage_totals(log, "kind", "run_id", F.col("c"))) == [("all", 5, 2, 15), ("run_started", 2, 1, 1), ("x", 3, 2, 14)]
    assert rows(Y.attempt_totals(log, F.col("c"))) == [(1, 3, 4, 8, 2), (2, 1, 1, 7, 1)]


def test_overlap_and_versions(spark):
    pairs = spark.createDataFrame([("f", ["a"], ["a", "b"]), ("f", ["a"], ["b"]), ("g", [], ["b"])], "g string, l array<string>, r array<string>")
    assert rows(Y.evidence_overlap(pairs, "g", "l", "r")) == [("f", 2, 0.5), ("g", 1, 0.0)]
    values = spark.createDataFrame([("m", 1, 2.0), ("m", 1, 4.0), ("m", 2, 5.0), ("n", 2, 1.0)], "m string, version int, v double")
    assert rows(Y.before_after(values, "m", F.col("version") == 1, "v")) == [("m", 2, 1, 3.0, 5.0), ("n", 0, 1, None, 1.0)]


def test_unions_and_differences(spark):
    values = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (1, "c", 2)], "g int, v string, ord int")
    assert rows(Y.ordered_union(values, "g", "v")) == [(1, ["b", "a", "c"])]
    reads = spark.createDataFrame([("A", "x", "ok"), ("B", "x", "ok"), ("A", "y", "ok"), ("B", "y", "no"), ("A", "z", "ok"), ("C", "z", "ok")], "read string, k string, verdict string")
    assert rows(Y.common_relations(reads, ["k"], F.col("verdict") == "no")) == [("x",)]
    files = spark.createDataFrame([("d1", "a"), ("d1", "a"), ("d1", "b"), ("d2", "c")], "folder string, name string")
    required = spark.createDataFrame([("a",), ("b",), ("b",)], "name string")
    assert rows(Y.missing_names(files, "folder", required)) == [("d1", []), ("d2", ["a", "b"])]


def test_holders_budgets_and_revisions(spark):
    uploads = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None)], "k int, t string")
    assert rows(Y.first_holders(uploads, "k", F.col("t"))) == [(1, None), (2, None), (3, 1)]
    budgets = spark.createDataFrame([("u", 1, 5), ("u", 2, 7), ("u", 3, 7), ("v", 1, 1)], "u string, n int, budget int")
    assert rows(Y.raises(budgets, "u", "n")) == [("u", 2, 7, 5, True), ("u", 3, 7, 7, False)]
    assert rows(Y.next_revisions(budgets, "u")) == [("u", 4, 3), ("v", 2, 1)]
    dated = spark.createDataFrame([("g", "2024-01-01", 1), ("g", None, 2), ("g", "2025-01-01", 4), ("g", "2025-01-01", 3)], "g string, d string, k int")
    assert [(r["k"], r["place"]) for r in Y.newest_first(dated, "g", F.col("d"), "k").orderBy("place").collect()] == [(3, 1), (4, 2), (1, 3), (2, 4)]
