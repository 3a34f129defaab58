"""SimHash groups and mixes against brute force, and the whole pipeline on small documents."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from graphwright.llm import mixing, shingles, simhash
from graphwright.llm.queries import oracle_sql, queries
from graphwright.sources.tables import read_table
from tests.compare import duck, same


def brute_simhash(text, k, seed):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius):
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in parent:
        for b in parent:
            if a < b and sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True)) <= radius:
                parent[find(b)] = find(a)
    return {p: find(p) for p in prints}


def varied(seed, n):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(2, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(3000)}"
            texts.append(" ".join(copy))
    return texts + texts[:20] + [None, "", "  \n", "One\tTWO", "one two", "\u00a0x y", "É é"]


@pytest.mark.parametrize(("k", "radius", "seeds"), [(4, 4, (42,)), (5, 24, (42, 43)), (4, 0, (42,)), (4, 9, (42,))])
def test_groups_are_exact(spark, documents, k, radius, seeds):
    rows = list(enumerate(varied(k + radius, 120)))
    random.Random(0).shuffle(rows)
    got = {r["doc_id"]: r for r in simhash.simhash_groups(documents(rows), words_in_shingle=k, radius=radius, seeds=seeds).collect()}
    prints = {i: tuple(brute_simhash(t, k, s) for s in seeds) for i, t in rows}
    root = brute_groups(set(prints.values()), radius)
    least = defaultdict(lambda: 10**9)
    for i, p in prints.items():
        least[root[p]] = min(least[root[p]], i)
    for i, p in prints.items():
        assert tuple(got[i][f"fp_{j}"] & (2**64 - 1) for j in range(len(seeds))) == p
        assert got[i]["component_id"] == least[root[p]]


def test_cells_and_blocks_lose_no_link(spark, documents, monkeypatch):
    rows = list(enumerate(varied(77, 150)))
    whole = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(documents(rows), radius=20).collect()}
    monkeypatch.setattr(simhash, "CELL_FINGERPRINTS", 16)
    monkeypatch.setattr(simhash, "PAIR_BLOCK", 50)
    assert {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(documents(rows), radius=20).collect()} == whole
    monkeypatch.setattr(simhash, "index_split", lambda n, bits: 0)
    assert {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(documents(rows), radius=20).collect()} == whole


def test_shingle_blocks(monkeypatch):
    text = " ".join(f"w{i % 91}" for i in range(2000))
    whole = simhash.simhash(text, 4)
    monkeypatch.setattr(simhash, "SHINGLE_BLOCK", 7)
    assert simhash.simhash(text, 4) == whole == (brute_simhash(text, 4, 42),)


def test_thresholds_keep_the_pigeonhole_promise():
    rng = np.random.default_rng(1)
    ones = rng.integers(0, 2, (500, 64))
    both = ones.T @ ones
    for radius in (0, 1, 4, 7):
        plan = simhash.plan_partitions(both, 10**6, radius, range(1, radius + 2))
        bits = [b for p in plan for b in p.bits]
        assert len(bits) == len(set(bits))
        assert sum(p.threshold + 1 for p in plan) >= radius + 1


def test_one_of_each_group_stays(spark, documents):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(3, base), (1, base + " end"), (2, base), (2, base), (9, "quite another text with its own words"), (None, base), (None, base), (1, "a second text under the same id here"), (None, "no id but words of its own here"), (None, "no id but words of its own here")]
    kept = Counter((r["doc_id"], r["text"]) for r in shingles.one_of_each_group(documents(rows)).collect())
    assert kept == Counter([(1, base + " end"), (9, rows[4][1]), (1, rows[7][1]), (None, rows[8][1])])
    assert shingles.one_of_each_group(documents([])).count() == 0
    twice = shingles.one_of_each_group(documents([(1, base), (1, base)]))
    assert twice.count() == 1
    named = documents(rows).withColumnsRenamed({"size": "kept_id", "lang": "_D", "source": "_c", "n_chars": "row"})
    assert shingles.one_of_each_group(named).columns == named.columns
    assert shingles.one_of_each_group(named).count() == 4
    assert shingles.one_of_each_group(documents([(3, None), (2, ""), (4, " ")])).first()["doc_id"] == 2


def exact_sets(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


@pytest.mark.parametrize("common", [1, 3])
def test_shingle_groups_are_those_of_exact_jaccard(spark, documents, monkeypatch, common):
    monkeypatch.setattr(shingles, "COUNTED", common)
    texts = varied(5, 150)
    base = [f"v{i}" for i in range(104)]
    # a passage that many hold, a dense group, and 100 shingles of which 88 (0.786) or 89 (0.802) are shared
    texts += [" ".join([*base[:30], *(f"u{i}_{j}" for j in range(20))]) for i in range(60)]
    texts += [" ".join([*base, f"e{i}"]) for i in range(40)]
    texts += [" ".join(f"x{i}" for i in range(104)), " ".join([*(f"x{i}" for i in range(92)), *(f"y{i}" for i in range(12))])]
    texts += [" ".join(f"z{i}" for i in range(104)), " ".join([*(f"z{i}" for i in range(93)), *(f"q{i}" for i in range(11))])]
    texts += [" ".join(f"r{i}" for i in range(40)), " ".join(f"r{i}" for i in range(40)) + " s s s s s" * 100]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in shingles.shingle_groups(documents(rows)).collect()}
    sets = {i: exact_sets(t) for i, t in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if r == old else r for k, r in root.items()}
    assert got == root
    n = len(texts) - 6
    assert got[n] != got[n + 1] and got[n + 2] == got[n + 3]


def test_near_duplicate_stage_keeps_what_is_less_alike(spark, documents):
    words = [f"x{i}" for i in range(104)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:91], *(f"y{i}" for i in range(13))])), (3, " ".join([*words, "end"]))]
    kept = corpus_pipeline.drop_near_copies(spark, documents(rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


# ---- mixing


def test_mix_agrees_with_sql(spark, small):
    for folder in (small, "/root/testdata/sf0.01"):
        same(queries()["op10_mixing"](spark, folder), duck(folder), oracle_sql()["op10_mixing"])


def mixed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size long")
    return docs, mixing.mix_sources(docs).collect()


def test_mix_of_odd_sources(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(40), rng.choice(["a", "b", "b", "b", None, "é"]), 1) for i in range(2000)] + [(5000, None, "empty", 1), (5001, "", "empty", 1)]
    docs, got = mixed(spark, rows)
    assert len(got) == len(rows)
    total = defaultdict(int)
    for r in got:
        assert r["mix_size"] == len((r["text"] or "").split()) and 0 <= r["mix_passes"] <= 2
        total[r["source"]] += r["mix_size"] * r["mix_passes"]
    for r in got:
        assert abs(total[r["source"]] - r["mix_target"]) <= 40
    assert total["empty"] == 0
    out = mixing.materialised(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({r["doc_id"]: r["mix_passes"] for r in got if r["mix_passes"]})


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes, (5, 2, 1), (3, 2), 2).collect()}
    # a stops at 20; of the 2995 left b and c get 2 to 1, b at 1996.67 stays under 2000
    assert got["a"] == 20 and got["b"] == pytest.approx(2995 * 2 / 3) and got["c"] == pytest.approx(2995 / 3) and got[None] == 0


def test_empty_and_single(spark):
    assert mixed(spark, [])[1] == []
    _, got = mixed(spark, [(1, "a b c", None, 0)])
    assert got[0]["mix_target"] == 4.5 and got[0]["mix_passes"] in (1, 2)
    _, nothing = mixed(spark, [(1, None, "s", 0)])
    assert nothing[0]["mix_passes"] == 0


# ---- the pipeline


def test_pipeline_keeps_clean_documents(spark, small):
    docs = read_table(spark, small, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = docs.count()
        docs = stage(spark, docs, small)
        assert docs.columns == columns, name
        assert docs.count() > 0.6 * before, name
    mixed_docs = corpus_pipeline.STAGES[3][1](spark, docs, small)
    assert mixed_docs.columns == columns
    last = corpus_pipeline.STAGES[4][1](spark, mixed_docs, small)
    assert last.columns == [*columns, "shard", "slot"]
    assert last.count() == mixed_docs.count()
