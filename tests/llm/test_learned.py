"""Language identification and toxicity: held-out accuracy, and what inputs do to them."""

import math
import re
import zlib

import numpy as np
import pytest

from graphwright.llm import language_id, toxicity
from graphwright.llm.queries import queries
from graphwright.sources.tables import read_table

FOLDER = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    gold = {r["doc_id"]: r["lang"] for r in read_table(spark, FOLDER, "documents").select("doc_id", "lang").collect()}
    got = queries()["op3_language_id"](spark, FOLDER).collect()
    assert len(got) == len(gold)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == gold[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_odd_texts(spark, documents):
    learned = documents([(i, "the cat and the dog run " * 3) for i in range(60)])
    docs = documents([(1, None), (2, ""), (3, "123 !!"), (4, "the dog"), (5, "x" * 300_000), (6, "é")])
    got = {r["doc_id"]: r for r in language_id.identify(docs, learned).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6)] == ["und", "und", "und", "en", "en", "en"]
    nothing = language_id.identify(docs, learned.limit(0)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert language_id.identify(docs.limit(0), learned).count() == 0


def test_blocks_give_the_counts_of_the_whole(monkeypatch):
    text = "Über den Wolken, muß die Freiheit! " * 50
    whole = language_id.subword_counts(text)
    monkeypatch.setattr(language_id, "BLOCK", 37)
    assert (language_id.subword_counts(text) == whole).all()


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in read_table(spark, folder, "labels").collect()}
    got = [r for r in queries()["op9_toxicity"](spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    toxic = sorted(r["score"] for r in got if labels[r["doc_id"]])
    clean = sorted(r["score"] for r in got if not labels[r["doc_id"]])
    above = sum(sum(c < t for c in clean) for t in toxic) / len(toxic) / len(clean)
    assert above > 0.95
    predicted = [r for r in got if r["predicted"]]
    assert sum(labels[r["doc_id"]] for r in predicted) / len(predicted) > 0.9
    assert sum(r["predicted"] for r in got if labels[r["doc_id"]]) / len(toxic) > 0.75


def test_toxicity_of_odd_tables(spark, documents):
    docs = documents([(i, f"you idiot number {chr(97 + i % 20)}" if i % 3 == 0 else f"a fine day {chr(97 + i % 20)} again") for i in range(200)] + [(900, None), (901, ""), (5, "again")])
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(150)] + [(None, 1, 1), (3, 0, 1), (7, None, 1)], "doc_id long, toxic int, quality int")
    got = {(r["doc_id"], r["text"]): r["toxicity"] for r in toxicity.score_toxicity(docs, docs, labels).collect()}
    assert len(got) == 203
    assert got[900, None] == got[901, ""] < 0.5
    assert got[180, "you idiot number a"] > 0.5 > got[181, "a fine day b again"]
    nothing = toxicity.score_toxicity(docs, docs, labels.filter("toxic = 0"))
    assert {r["toxicity"] for r in nothing.collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), docs, labels).count() == 0


def test_language_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    table, weights, bias = rng.normal(size=(6, 4)), rng.normal(size=(3, 4)), rng.normal(size=3)
    share = rng.random(6) / 6

    def loss(table, weights, bias):
        z = weights @ (share @ table) + bias
        return math.log(sum(math.exp(x) for x in z)) - z[1]

    found = language_id.slopes(table, share, weights, bias, 1)
    for which, slope in enumerate(found):
        for at in np.ndindex(slope.shape):
            sides = []
            for step in (1e-6, -1e-6):
                moved = [table.copy(), weights.copy(), bias.copy()]
                moved[which][at] += step
                sides.append(loss(*moved))
            assert (sides[0] - sides[1]) / 2e-6 == pytest.approx(slope[at], abs=1e-5)


def test_temperature_and_rejection_by_brute_force():
    rng = np.random.default_rng(5)
    logits, gold = rng.normal(size=(300, 4)) * 6, rng.integers(0, 4, 300)
    logits[np.arange(300), gold] += 4

    def loss(t):
        return float(np.mean([math.log(sum(math.exp(x / t) for x in row)) - row[g] / t for row, g in zip(logits, gold, strict=True)]))

    best = language_id._temperature(logits, gold)
    assert all(loss(best) <= loss(t) + 1e-9 for t in np.geomspace(0.25, 8, 41))
    odds = np.exp(logits / best) / np.exp(logits / best).sum(1, keepdims=True)
    scores, right = odds.max(1), odds.argmax(1) == gold
    threshold = language_id._threshold(scores, right)
    wanted = [s for s in scores if right[scores >= s].mean() >= language_id.WANTED]
    assert threshold == (min(wanted) if wanted else 1.0)


def test_language_counts_by_brute_force():
    text = "Déjà vu, 3 fois!"
    spaced = b" " + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()) + b" "
    pieces = [spaced[i : i + n] for n in language_id.SUBWORDS for i in range(len(spaced) - n + 1)]
    # no space inside, and no piece of spaces alone
    pieces = [p for p in pieces if 32 not in p[1:-1] and (len(p) > 2 or p.strip())]
    assert language_id.subword_counts(text).sum() == len(pieces)


def test_languages_of_repeated_rows_and_too_many(spark, documents):
    rows = [(1, "the cat and the dog"), (1, "the cat and the dog"), (None, "der Hund"), (None, "der Hund"), (2, None)]
    got = language_id.identify(documents(rows), documents(rows * 40)).collect()
    assert len(got) == 5 and {r["lang_pred"] for r in got} == {"en", "und"}
    with pytest.raises(ValueError, match="languages"):
        language_id.training_sample(documents(rows).selectExpr("doc_id", "text", "text as lang"), language_id.Sampling(languages=1), key="doc_id", text="text", lang="lang")


def brute_features(text):
    """Buckets, with repeats, of the distinct words of a text, one by one."""
    m, out = (1 << 64) - 1, []
    for word in dict.fromkeys(re.findall(r"[^\W\d_]+", (text or "").lower())):
        codes = [ord(c) for c in f"<{word}>"]
        whole = 0
        for place, c in enumerate(codes):
            x = (c + place * 0x1000193) * 0x9E3779B97F4A7C15 & m
            whole = whole + (x ^ x >> 29) & m
        out.append((whole * 0xBF58476D1CE4E5B9 & m) >> 44)
        for n in toxicity.PIECES:
            for i in range(len(codes) - n + 1):
                code = n
                for c in codes[i : i + n]:
                    code = code * 0x100000001B3 + c & m
                out.append((code * 0x9E3779B97F4A7C15 & m) >> 44)
    return sorted(out)


def test_toxicity_features_by_brute_force(monkeypatch):
    texts = ["You idiot, you IDIOT!", None, "", "é" * 70 + " a bc", "x1y_z 😀 straße"]
    for block in (1 << 17, 5):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        for text, (buckets, counts) in zip(texts, toxicity.text_buckets(texts), strict=True):
            assert sorted(np.repeat(buckets, counts).tolist()) == brute_features(text)
    model = toxicity.ToxicityModel(np.unique(brute_features(texts[0])), np.linspace(-1, 1, len(set(brute_features(texts[0])))), -0.5)
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    for text, score in zip(texts, toxicity.Scorer(model).scores(texts), strict=True):
        assert score == pytest.approx(1 / (1 + math.exp(0.5 - sum(weight.get(b, 0) for b in brute_features(text)))), abs=1e-6)


def test_toxicity_risk_and_slope_by_brute_force():
    rng = np.random.default_rng(1)
    xp, xu = rng.integers(0, 3, (5, 4)).astype(float), rng.integers(0, 3, (9, 4)).astype(float)

    def risk(w, b, prior):
        loss = lambda rows, sign: np.mean([math.log1p(math.exp(-sign * (row @ w + b))) for row in rows])
        return prior * loss(xp, 1) + max(0.0, loss(xu, -1) - prior * loss(xp, -1))

    held = 0
    for w, b, prior in [(rng.normal(size=4), 0.3, 0.1), (rng.normal(size=4), -1.0, 0.4), (np.full(4, 2.0), -9.0, 0.9), (np.full(4, -0.5), 4.0, 0.9)]:
        if prior == 0.9 and b > 0:
            xu = np.full((9, 4), 9.0)  # unlabelled rows that look clean: the clean part is negative
        found, slope = toxicity.risk_and_slope(xp, xu, w, b, prior)
        assert found == pytest.approx(risk(w, b, prior))
        held += found == pytest.approx(prior * np.mean([math.log1p(math.exp(-(row @ w + b))) for row in xp]))
        for i in range(5):
            step = np.zeros(5)
            step[i] = 1e-6
            apart = risk(w + step[:4], b + step[4], prior) - risk(w - step[:4], b - step[4], prior)
            assert apart / 2e-6 == pytest.approx(slope[i], abs=1e-4)
    assert held
