"""The manifest, runs and quality against brute force, and on odd tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphwright.llm import manifest as M
from graphwright.llm import periodic_runs as R
from graphwright.llm import quality as Q
from graphwright.llm import words as word_helpers
from graphwright.llm.queries import looped, oracle_sql, queries
from graphwright.sources.tables import read_table
from tests.compare import duck, same


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree_by_hand(leaves):
    """(root, [steps of each leaf]) of one tree, level by level."""
    level, at, steps = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, place in enumerate(at):
            other = place ^ 1
            steps[i].append(("<" if other < place else ">") + level[other] if other < len(level) else "")
            at[i] = place // 2
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0], steps


def fold(leaf, path):
    for step in path:
        leaf = sha(step[1:] + leaf if step[:1] == "<" else leaf + step[1:])
    return leaf


@pytest.mark.parametrize("levels", [1, 2, 9])
def test_manifest_against_trees_by_hand(spark, levels):
    rng = random.Random(levels)
    sizes = {None: 1, "": 2, "a": 37, "b": 64, "B": 65, "é": 3}
    rows = [(rng.choice([None, rng.randrange(10**6)]), name, f"t{rng.randrange(9)}") for name, n in sizes.items() for _ in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    leaf = M.hashed(M.encoded(F.col("doc_id"), F.col("lang"), F.col("text")))
    got = M.build_manifest(docs, F.col("lang"), [F.col("doc_id")], leaf, [F.col("doc_id"), F.col("lang"), F.col("text").alias("size")], levels).collect()
    write = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    expected, roots = Counter(), []
    for name in sorted(sizes, key=lambda n: (n is not None, (n or "").encode())):
        mine = sorted((i is not None, i or 0, sha(write(i) + write(n) + write(t)), i, t) for i, n, t in rows if n == name)
        root, steps = tree_by_hand([m[2] for m in mine])
        roots.append(root)
        for m, path in zip(mine, steps, strict=True):
            expected[m[3], name, m[4], m[2], root, len(roots) - 1, tuple(path)] += 1
    top, upper = tree_by_hand(roots)
    expected = Counter({(*k[:5], top, (*k[6], *upper[k[5]])): n for k, n in expected.items()})
    assert Counter((r["doc_id"], r["lang"], r["size"], r["leaf"], r["subroot"], r["root"], tuple(r["path"])) for r in got) == expected
    assert all(fold(r["leaf"], r["path"]) == top for r in got)


def test_manifest_query(spark, small):
    same(queries()["op11_manifest"](spark, small), duck(small), oracle_sql()["op11_manifest"])


def test_manifest_of_odd_tables(spark, tmp_path):
    schema = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int"
    long_text = "word " * 300_000
    rows = [(None, None, None, None, None, "x", 1)] * 3 + [(7, "s", "en", 1, "", "x", 1)] * 40 + [(8, "s", "en", None, long_text, "x", 1), (0, "", "", 0, "é", "x", 1)]
    for n, data in enumerate((rows, [])):
        folder = str(tmp_path / str(n))
        spark.createDataFrame(data, schema).write.parquet(folder + "/documents.parquet")
        got = queries()["op11_manifest"](spark, folder).collect()
        assert len(got) == len(data) and len({r["root"] for r in got}) <= 1
        for r in got:
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["doc_id"] != 8
            assert r["verified"] != hit and (r["folded_root"] == r["root"]) == r["verified"]
        assert len({r["subroot"] for r in got}) == (3 if data else 0)


def runs_by_hand(words, least, times):
    n, out = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, times * p) and all(any(words[k] != words[k + q] for k in range(i, i + length - q)) for q in range(1, p)):
                out.append((i, length, p))
            i = max(j, i + 1)
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=50), st.sampled_from([(2, 2), (3, 3), (6, 3)]))
def test_runs_of_small_words(words, bounds):
    assert R.runs_of(words, *bounds) == runs_by_hand(words, *bounds)


def looped_by_hand(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def collapsed_by_hand(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_texts_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "  x " * 30, "one two " * 12, "a b c d e f g h " * 3]
    for _ in range(250):
        words = [rng.choice("abcd") if rng.random() < 0.4 else f"w{rng.randrange(200)}" for _ in range(rng.randrange(90))]
        for _ in range(rng.randrange(4)):
            a, p, n = rng.randrange(len(words) + 1), rng.randrange(1, 14), rng.randrange(70)
            words[a:a] = [words[a + i % p] if a + i % p < len(words) else "z" for i in range(n)]
        texts.append(rng.choice([" ", "\n", " \x0b"]).join(words))
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in enumerate(texts)], "doc_id long, text string, start int, length string")
    got = {r["doc_id"]: r for r in R.find_runs(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = [w.decode() for w in (text or "").encode().split()]
        runs = runs_by_hand(words, 24, 3)
        assert [tuple(r) for r in got[i]["runs"]] == runs, text
        assert got[i]["collapsed"] == collapsed_by_hand(words, runs)
    assert R.find_runs(docs.limit(0)).count() == 0
    for bad in ("RUNS", "collapsed"):
        with pytest.raises(ValueError):
            R.find_runs(docs.withColumn(bad, F.lit(1)))


def test_runs_query(spark, small):
    got = {r["doc_id"]: r for r in queries()["op12_periodic_runs"](spark, small).collect()}
    rows = read_table(spark, small, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    found = 0
    for doc_id, text in rows:
        words = looped_by_hand([w.decode() for w in (text or "").encode().split()], doc_id)
        runs = runs_by_hand(words, 24, 3)
        found += bool(runs)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        r = got[doc_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs))
        assert r["collapsed_sha256"] == sha(collapsed_by_hand(words, runs))
    assert found > len(rows) / 20


def test_looping_of_odd_rows(spark):
    hit = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    texts = ["", None, " ", "a", "a b", "   \u0085", "x \n y\tz " * 5]
    rows = [(hit, t) for t in texts] + [(None, "a b c")]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", looped(F.col("text"), F.col("doc_id")).alias("out")).collect()
    for r in got:
        words = [w.decode() for w in (r["out"] or "").encode().split()]
        before = [w.decode() for w in (r["text"] or "").encode().split()]
        assert words == (before if r["doc_id"] is None else looped_by_hand(before, hit))


def test_very_long_looping_text(spark):
    text = " ".join(f"w{i % 7001}" for i in range(60_000)) + " " + "y " * 30_000
    [row] = R.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row["runs"]] == [(0, 60_000, 7001), (60_000, 30_000, 1)]


def features_by_hand(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    lines = [line for line in text.split("\n") if line.encode().split()]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines),
        "n_repeat_words": len({i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}),
        "n_same_words": sum(a == b for a, b in zip(words, words[1:], strict=False)), "n_distinct_words": len(set(words)),
    }


def test_features_against_brute_force(spark, small):
    texts = [r["text"] for r in read_table(spark, small, "documents").select("text").collect()]
    texts += [None, "", "\n\n", " a\na\n a", "a b c d e a b c d e", "é è |", "x " * 50_000, "a b c d e\nf a b c d e", "b c d e"]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    for r in Q.with_features(docs).collect():
        assert {k: r[k] for k in features_by_hand(texts[r["doc_id"]])} == features_by_hand(texts[r["doc_id"]])
    assert Q.with_features(docs.limit(0)).count() == 0


@pytest.mark.parametrize("mask", [0, 3, (1 << 64) - 1])
def test_windows_whose_hashes_clash(monkeypatch, mask):
    monkeypatch.setattr(word_helpers, "HASH_MASK", mask)
    rng = random.Random(mask)
    texts = [[rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(20))] for _ in range(30)]
    expected = []
    for t in texts:
        windows = [tuple(t[i : i + 3]) for i in range(len(t) - 2)]
        expected += [windows.count(w) > 1 for w in windows] + [False] * (len(t) - len(windows))
    assert word_helpers.Words([b" ".join(t) for t in texts]).repeated_windows(3).tolist() == expected


def test_estimate_finds_planted_accuracies():
    rng = np.random.default_rng(5)
    good = rng.random(200_000) < 0.8
    on_good, on_bad = np.array([0.97, 0.9, 0.95, 0.99, 0.93]), np.array([0.7, 0.8, 0.6, 0.5, 0.9])
    right = rng.random((len(good), 5)) < np.where(good[:, None], on_good, on_bad)
    votes = np.where(right == good[:, None], 1, -1) * (rng.random((len(good), 5)) < 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    a, b, share = Q.estimate(patterns.astype(float), counts.astype(float), Q.Prior(weight=0.0))
    assert np.abs(a - on_good).max() < 0.02 and np.abs(b - on_bad).max() < 0.03 and abs(share - 0.8) < 0.02


def test_estimate_against_one_text_at_a_time():
    rng = np.random.default_rng(6)
    votes = rng.integers(-1, 2, (500, 3))
    prior = Q.Prior(rounds=3, tolerance=0.0)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    a, b, share = Q.estimate(patterns.astype(float), counts.astype(float), prior)
    x, y, z, extra = [prior.on_good] * 3, [prior.on_bad] * 3, prior.good, prior.weight * 500 + 1
    for _ in range(3):
        chances = []
        for row in votes:
            up, down = z, 1 - z
            for j, v in enumerate(row):
                up *= (x[j] if v > 0 else 1 - x[j]) if v else 1
                down *= (1 - y[j] if v > 0 else y[j]) if v else 1
            chances.append(up / (up + down))
        voted = [[(p, v) for p, v in zip(chances, votes[:, j], strict=True) if v] for j in range(3)]
        x = [(sum(p for p, v in c if v > 0) + prior.on_good * extra) / (sum(p for p, _ in c) + extra) for c in voted]
        y = [(sum(1 - p for p, v in c if v < 0) + prior.on_bad * extra) / (sum(1 - p for p, _ in c) + extra) for c in voted]
        z = (sum(chances) + prior.good * extra) / (500 + extra)
    assert np.allclose(a, x) and np.allclose(b, y) and np.isclose(share, z)


def test_quality_query_against_labels(spark):
    folder = "/root/testdata/sf0.01"
    got = queries()["op13_quality"](spark, folder).join(read_table(spark, folder, "labels").withColumnRenamed("quality", "gold"), "doc_id")
    rows = got.collect()
    for r in rows:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["quality"] >= 0.5)
    judged = [r for r in rows if not r["base_failed"]]
    assert np.mean([r["kept"] for r in judged if r["gold"] == 1]) > 0.98
    assert np.mean([not r["kept"] for r in judged if r["gold"] == 0]) > 0.9


def test_quality_of_odd_tables(spark):
    rows = [(1, None, 5), (1, None, 5), (2, "", 5), (3, "the same words again " * 10, 5), (None, "a plain text of ten words or some more than that", 5)]
    table = Q.with_features(spark.createDataFrame(rows, "doc_id long, text string, kept int"))
    got = Q.judge_quality(table, Q.fit_quality(table)).collect()
    assert len(got) == 5 and all(0 < r["quality"] < 1 for r in got) and got[0] == got[1]
    empty = table.limit(0)
    assert Q.fit_quality(empty).good == pytest.approx(Q.Prior().good) and Q.judge_quality(empty, Q.fit_quality(empty)).count() == 0
