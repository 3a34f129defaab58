"""Guards and text sources on small literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from graphwright.operators import guards, joins
from graphwright.sources import texts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "line string")


def test_a_whole_ledger_is_read(spark):
    got = texts.json_lines(lines(spark, '{"a": 1, "b": "x"}', ' {"b": null} '), "line", "a int, b string")
    assert rows(got) == [(1, "x"), (None, None)]


@pytest.mark.parametrize("torn", ['{"a": 1', "", "  ", "[1]", "null", '{"a": "no number"}', None])
def test_a_torn_line_is_fatal(spark, torn):
    with pytest.raises(Exception, match="not a whole object"):
        texts.json_lines(lines(spark, '{"a": 1}', torn), "line", "a int").select("a").collect()


def test_graph_texts(spark):
    graph = {"version": 3, "nodes": [{"id": "a", "type": "Asset", "name": "m"}], "edges": []}
    cases = [json.dumps(graph), json.dumps({**graph, "version": 1}), json.dumps({**graph, "nodes": [{"name": "m"}]}), "cut off {", json.dumps({"version": 2})]
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    assert {r["k"]: r["status"] for r in texts.graphs(df, "k", "t").collect()} == {0: "READ", 1: "VERSION", 2: "SHAPE", 3: "NOT_JSON", 4: "SHAPE"}


def test_written_graphs_are_verified(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "x"), ("b", None)], "id string, name string")
    edges = spark.createDataFrame([("e", "a", "b")], "id string, source string, target string")
    manifest = texts.write_graph(nodes, edges, str(tmp_path / "g")).withColumn("bundle", F.lit(1))
    again = texts.digest_of(nodes.repartition(5), "nodes").unionByName(texts.digest_of(edges, "edges")).withColumn("bundle", F.lit(1))
    assert rows(texts.verified_bundles(again, manifest, "bundle")) == [(1, "VERIFIED")]
    stale = texts.digest_of(nodes.limit(1), "nodes").unionByName(texts.digest_of(edges, "edges")).withColumn("bundle", F.lit(1))
    assert rows(texts.verified_bundles(stale, manifest, "bundle")) == [(1, "STALE")]
    assert rows(texts.verified_bundles(again, manifest.limit(0), "bundle")) == [(1, "LEGACY_UNVERIFIED")]


def test_states_in_the_order_of_the_pipeline(spark):
    files = spark.createDataFrame([("r", "read_2", 9), ("r", "map_1", 5), ("r", "odd", 1), ("r", "read_1", 2)], "run string, name string, modified int")
    got = {r["name"]: r["place"] for r in texts.ranked_states(files, ("map_", "read_"), "run").collect()}
    assert got == {"map_1": 1, "read_1": 2, "read_2": 3, "odd": 4}


def test_tables_are_placed_before_the_next_block(spark):
    blocks = spark.createDataFrame([(1, 10, 5.0), (1, 20, 30.0), (2, 30, 1.0)], "page int, pos long, top double")
    tables = spark.createDataFrame([(1, 30.5), (1, 6.5), (2, 99.0)], "page int, top double")
    assert rows(joins.placed_before(tables, blocks, 1.0)) == [(1, 30.5, 20), (1, 6.5, 20), (2, 99.0, None)]


def test_answers_need_an_option_and_its_input(spark):
    questions = spark.createDataFrame([("q", [("accept", False), ("correct", True)])], "question_id string, options array<struct<id:string,needs_input:boolean>>")
    answers = spark.createDataFrame([("q", "accept", None), ("q", "correct", " "), ("q", "correct", "x"), ("q", "no", "x"), ("z", "accept", None)], "question_id string, option string, input string")
    assert sorted(r["state"] for r in guards.valid_answers(answers, questions).collect()) == ["INPUT_MISSING", "UNKNOWN_OPTION", "UNKNOWN_QUESTION", "valid", "valid"]


def test_lifecycle(spark):
    questions = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")], "run_id int, question_id string")
    answers = spark.createDataFrame([("a", True), ("c", False), ("d", True), ("e", True)], "question_id string, applied boolean")
    running = spark.createDataFrame([(4,)], "run_id int")
    assert rows(guards.lifecycle(questions, answers, running)) == [(1, True, False, False), (2, False, True, False), (3, False, False, True), (4, False, False, False)]


def test_sentences(spark):
    df = spark.createDataFrame([("MAY_INDICATE", "hum", "wear"), ("OTHER", "a", "b")], "r string, s string, t string")
    said = df.select(guards.sentence(F.col("r"), F.col("s"), F.col("t")).alias("x"))
    assert {r["x"] for r in said.collect()} == {"hum may be a sign of wear.", "a OTHER b"}
