"""Operators and pipeline stages on nulls, empty and very long texts, repeated rows, ties, empty tables and clashing names."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphwright.llm import chat_format, mixing, sharding, toxicity
from graphwright.llm.queries import conversation_events
from graphwright.llm.words import LONG, WordTable
from graphwright.sources.tables import read_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leak_id string, kept_id int, component string, mix_size int, _mix_source string, shard string, _ring_arc int, row int, toxicity string"
LONG_TEXT = " ".join(f"word{i % 5000}" for i in range(200_000))
ITEM = "which of the following planets has the largest number of moons in our solar system today"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, None, s, 0, "a", 1, "b", 2, "c", "d", 3, 4, "e") for i, t, s in rows], SCHEMA)


ROWS = [
    (1, None, "s"), (1, None, "s"), (2, "", None), (3, "  \n ", "s"), (None, "no id but some words of its own", "t"), (None, "no id but some words of its own", "t"),
    (4, "a plain text about the garden and the river behind the old house", "t"), (4, "another text under the same id that speaks of ships and their captains", "t"),
    (5, LONG_TEXT, "s"), (6, ITEM + " and more", "t"), (None, ITEM, "t"),
]


@pytest.mark.parametrize("at", range(5))
def test_stages_take_odd_tables(spark, small, at):
    name, stage = corpus_pipeline.STAGES[at]
    folder = small
    for rows in (ROWS, []):
        docs = odd(spark, rows)
        out = stage(spark, docs, folder)
        if at < 4:
            assert out.columns == docs.columns, name
        got = out.collect()
        assert len(got) <= 2 * len(rows)
        if not rows:
            assert got == []


def test_near_copies_and_leaks_of_odd_rows(spark):
    from graphwright.llm.decontaminate import without_leaks
    from graphwright.llm.shingles import one_of_each_group

    kept = Counter((r["doc_id"], r["text"]) for r in one_of_each_group(odd(spark, ROWS)).collect())
    # the last two hold 11 shingles in common of 13: the one without an id goes
    assert kept == Counter([(1, None), *[(i, t) for i, t, _ in ROWS[6:-1]], (None, ROWS[4][1])])
    items = spark.createDataFrame([(1, ITEM), (None, None), (1, ITEM)], "item_id long, text string")
    left = Counter((r["doc_id"], r["text"]) for r in without_leaks(odd(spark, ROWS), items).collect())
    assert left == Counter((i, t) for i, t, _ in ROWS[:-2])


def test_passes_stay_within_the_cap(spark):
    rows = [(i, "", "full") for i in range(300)] + [(1000, "one two three", "full")] + [(2000 + i, "w " * 50, "big") for i in range(100)]
    got = mixing.mix_sources(odd(spark, rows)).collect()
    assert max(r["mix_passes"] for r in got) <= 2
    taken = sum(r["mix_size"] * r["mix_passes"] for r in got if r["source"] == "full")
    assert taken == 6
    assert mixing.materialised(odd(spark, rows)).groupBy("doc_id").count().filter("count > 2").count() == 0


def test_mixing_very_long_and_tied_rows(spark):
    rows = [(7, "a b c", "x")] * 9 + [(8, LONG_TEXT, "x"), (9, LONG_TEXT, "y")]
    got = mixing.mix_sources(odd(spark, rows)).collect()
    assert len(got) == 11 and {r["mix_size"] for r in got} == {3, 200_000}
    # rows of one id are taken alike
    assert len({r["mix_passes"] for r in got if r["doc_id"] == 7}) == 1


def test_sharding_hot_texts_and_names(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 5)
    rows = [(i, "the hot text", "s") for i in range(60)] + [(100 + i, f"text {i // 2}", "s") for i in range(40)] + [(None, "the hot text", "s")] * 3 + [(5, LONG_TEXT, "s")]
    got = sharding.shard_rows(odd(spark, rows), 7).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    again = {(r["doc_id"], r["text"]): (r["shard"], r["slot"]) for r in sharding.shard_rows(odd(spark, rows), 7).collect() if r["doc_id"] is not None}
    assert again == {(r["doc_id"], r["text"]): (r["shard"], r["slot"]) for r in got if r["doc_id"] is not None}


def test_toxicity_of_very_long_and_repeated_rows(spark):
    train = odd(spark, [(i, "you awful idiot" if i % 2 else "a kind and fine day", "s") for i in range(100)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    rows = [(1, LONG_TEXT, "s"), (1, LONG_TEXT, "s"), (2, "x" * 2_000_000, "s"), (None, None, "s")]
    got = toxicity.score_toxicity(odd(spark, rows), train, labels).collect()
    assert len(got) == 4 and all(0 <= r["toxicity"] <= 1 for r in got) and got[0]["toxicity"] == got[1]["toxicity"]


def test_conversations_with_nulls_and_repeated_turns(spark):
    rows = [(1, 0, None, "hi"), (1, 0, None, "hi"), (1, 1, "assistant", None), (1, None, "assistant", "late"), (2, 0, "assistant", LONG_TEXT)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.conversation_digests(chat_format.reconstruct(conversation_events(table))).collect()}
    assert got[1]["n_turns"] == 4 and got[1]["loss_chars"] == 4
    assert got[2]["loss_chars"] == len(LONG_TEXT)
    assert chat_format.conversation_digests(chat_format.reconstruct(conversation_events(table.limit(0)))).count() == 0


def test_word_table_forgets_no_value():
    rng = random.Random(2)
    table = WordTable(40, lambda words: [__import__("numpy").array([len(w) for w in words]), __import__("numpy").array([[ord(w[0]), ord(w[-1])] for w in words])])
    for _ in range(300):
        words = [rng.choice("abcdefgh") * rng.randrange(1, 2 * LONG) for _ in range(rng.randrange(1, 20))]
        (sizes, ends), at = table.rows(words)
        assert sizes[at].tolist() == [len(w) for w in words]
        assert ends[at].tolist() == [[ord(w[0]), ord(w[-1])] for w in words]


def test_pipeline_against_its_stages_one_by_one(spark, small):
    docs = read_table(spark, small, "documents")
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, small)
        if at < len(corpus_pipeline.STAGES) - 1:
            docs = spark.createDataFrame(docs.toPandas(), docs.schema)
    key = lambda df: Counter((r["doc_id"], r["shard"]) for r in df.select("doc_id", "shard").collect())
    assert key(docs) == key(corpus_pipeline.run(spark, small))
    assert docs.filter(F.col("slot").isNull()).count() == 0
