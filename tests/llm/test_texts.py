"""Decontamination, fingerprints, token counts and chat formatting against brute force."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from graphwright.llm import chat_format, decontaminate, fingerprint, token_count
from graphwright.llm.queries import CONTROL_TEXT, queries
from graphwright.sources.tables import read_table

# ---- decontamination

ITEM = "Tom has 12 apples and Tom gives 5 kg of them to Anna , how many apples does Tom have left in the basket now ?"


def leaks(spark, documents, docs, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.find_leaks(documents(docs), table).collect()}


def test_kinds_of_leaks(spark, documents):
    noise = "some other words stand before this place and they go on for a while . "
    docs = [
        (1, noise + ITEM + " " + noise),
        (2, noise + ITEM.replace("Tom", "Bob").replace("12", "30").replace("5 kg", "9 lb").replace("Anna", "Eve")),
        (3, noise + ITEM.replace("gives 5", "gives 12").replace("Tom have", "Jim have")),
        (4, noise * 3),
        (5, None),
        (6, ""),
        (None, ITEM),
        (7, "Tom has 12 apples and Tom gives"),
        (1, noise + ITEM),
        (8, (noise * 20_000) + ITEM),
    ]
    found = leaks(spark, documents, docs, [(1, ITEM), (2, None), (3, ""), (4, "12 13 14 15 16 17"), (5, "so short")])
    assert found == {(1, 1): "verbatim", (2, 1): "reparameterised", (8, 1): "verbatim", (None, 1): "verbatim"}
    assert leaks(spark, documents, docs, []) == {}
    assert leaks(spark, documents, [], [(1, ITEM)]) == {}


def test_copies_in_capitals_numbers_and_short_items(spark, documents):
    noise = "some other words stand before this place and they go on for a while . "
    plain = "the quick brown fox jumps over the lazy dog while birds watch from above"
    numbers = "What is the value of 3 4 5 7 11 13 17 19 23"
    docs = [
        (1, noise + plain.upper() + " . " + noise),
        (2, noise + plain.title()),
        (3, noise + ITEM.upper().replace("12", "30")),
        (4, noise + numbers + " " + noise),
        (5, noise + "What is the value of 2 4 6 8 10 12 14 16 18"),
        (6, noise + "capital of france " + noise),
        (7, noise + "12 13 14 15 16 17"),
        (8, noise + "Great Expectations By Charles Dickens And Others"),
        (9, "capital of"),
    ]
    items = [(1, plain), (2, ITEM), (3, numbers), (4, "Capital of France"), (5, "12 13 14 15 16 17"), (6, "A Tale Great Expectations By Charles Dickens And Others"), (7, "Great Expectations By Charles Dickens And Others")]
    found = leaks(spark, documents, docs, items)
    assert found == {(1, 1): "verbatim", (2, 1): "verbatim", (3, 2): "reparameterised", (4, 3): "verbatim", (6, 4): "verbatim", (7, 5): "verbatim", (8, 7): "verbatim"}


def test_only_windows_with_an_inconsistent_slot_are_lost(spark, documents):
    words = [f"w{i}" for i in range(60)]
    item = " ".join(["give", "7", *words, "and", "7", "more"])
    doc = item.replace("and 7", "and 9")
    row = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.find_leaks(documents([(1, doc)]), row).collect()
    assert [(r["item_windows"], r["shared_windows"], r["consistent_windows"]) for r in got] == [(61, 61, 59)]


def test_all_verbatim_items_are_found(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"].split() for r in read_table(spark, folder, "documents").collect()}
    items = {r["item_id"]: r["text"].split() for r in read_table(spark, folder, "benchmark").collect()}
    expected = set()
    for d, words in docs.items():
        grams = Counter(tuple(w.lower() for w in words[i : i + 5]) for i in range(len(words) - 4))
        for i, item in items.items():
            own = [tuple(w.lower() for w in item[j : j + 5]) for j in range(len(item) - 4)]
            if own and sum(g in grams for g in own) / len(own) >= 0.95:
                expected.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in queries()["op4_decontamination"](spark, folder).collect()}
    assert expected and expected <= got
    assert len(got - expected) <= 2


def test_pipeline_form_drops_only_leaks(spark, documents):
    # ids say nothing: the leaking rows go, whatever else has their id
    docs = documents([(1, ITEM), (1, "clean words only here"), (2, "clean words only here"), (None, ITEM), (None, "clean too"), (3, None), (3, None)])
    items = spark.createDataFrame([(1, ITEM), (None, "an item without an id but with words")], "item_id long, text string")
    kept = Counter((r["doc_id"], r["text"]) for r in decontaminate.without_leaks(docs, items).collect())
    assert kept == Counter([(1, "clean words only here"), (2, "clean words only here"), (None, "clean too"), (3, None), (3, None)])
    named = docs.withColumnsRenamed({"size": "leak_id", "lang": "Leak_Content", "source": "_leak"})
    assert decontaminate.without_leaks(named, items).columns == named.columns
    assert decontaminate.without_leaks(named, items).count() == 5


def test_items_of_one_id_are_all_searched(spark, documents):
    other = "quite another question that shares the number of the first one in this list"
    docs = documents([(1, "x " + ITEM), (2, other + " y")])
    assert leaks(spark, documents, [(1, "x " + ITEM), (2, other + " y")], [(7, ITEM), (7, other)]) == {(1, 7): "verbatim", (2, 7): "verbatim"}
    assert decontaminate.find_leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


TEMPLATES = [
    "{a} has {n} pens and {m} books , and {a} gives {k} of the books to {b} . How many books does {a} have left now ?",
    "A train leaves {c} at {n} {u} per hour and reaches {d} after {k} hours . How far is {d} from {c} in {u} ?",
    "{a} walks {n}{v} on the first day and {m}{v} on the second day . What is the whole distance that {a} walked ?",
    "{a} bought {n} apples for {k} dollars each and sold {m} of them to {b} at twice the price . What did {a} earn ?",
    "{a} needs {n} minutes to paint a fence of {m} {u} while {b} needs {k} minutes . How long do they need together ?",
]
NAMES = ["Tom", "Anna", "Mary Ann", "Bob", "Eve", "José", "Dr Who", "Kim Lee", "Ulrike", "Van Dyke"]
PLACES = ["Boston", "New York", "Los Angeles", "Albany", "San Juan Bautista", "Rome", "Saint Paul", "Kiel"]
SPELLED = ["twelve", "seven", "twenty-five", "forty two", "nine", "three hundred", "eighteen", "sixty", "ninety nine", "eleven"]


def filled(rng, template):
    a, b = rng.sample(NAMES, 2)
    c, d = rng.sample(PLACES, 2)
    n, m, k = rng.sample(SPELLED, 3) if rng.random() < 0.4 else map(str, rng.sample(range(2, 500), 3))
    v = rng.choice(["km", "m", "miles"]) if n.isdigit() else " km"
    return template.format(a=a, b=b, c=c, d=d, n=n, m=m, k=k, u=rng.choice(["km", "miles", "meters"]), v=v)


def test_reparameterised_questions_are_found(spark, documents):
    rng = random.Random(17)
    noise = ["the weather was fine and nobody asked about it .", "Later on We Met Some people near the old bridge ,", "in 1998 there were 40 of these , Mr Smith said ."]
    items = [(i, filled(rng, t)) for i, t in enumerate(TEMPLATES)]
    docs, wanted = [], set()
    for i, t in enumerate(TEMPLATES):
        for _ in range(30):
            wanted.add((len(docs), i))
            docs.append((len(docs), " ".join([rng.choice(noise), filled(rng, t), rng.choice(noise)])))
    clean = len(docs)
    for _ in range(60):  # half of one question, half of another
        t, o = rng.sample(TEMPLATES, 2)
        one, two = filled(rng, t).split(), filled(rng, o).split()
        docs.append((len(docs), " ".join([*one[: len(one) // 2], *rng.choice(noise).split(), *two[: len(two) // 2]])))
    got = leaks(spark, documents, docs, items)
    assert len(wanted & set(got)) / len(wanted) >= 0.9
    assert not {d for d, _ in got if d >= clean}


KINDS = {
    "arithmetic": ["what is {n} + {m} * {k} - {j}?", "{n} * {m} + {k} / {j} = what", "calculate {n} / {m} + {k} and then {j} more"],
    "formula": [
        "The sum of {n}/{m} and {k}/{j} is divided by x^{m} + {n}x; what is the value for x = {k}?",
        "find the roots of {n}x^2 + {m}x + {k} = 0 over the reals",
        "for which y does {n}y + {m} = {k}y - {j} hold , and is it the only one ?",
    ],
    "lower case": [
        "{a} has {n} apples and gives {b} {m} of them, how many apples does {a} have left?",
        "every morning {a} runs {n} laps around the lake while {b} runs {m} laps , how many more laps does {a} run in a week ?",
        "a shop sells {n} loaves to {a} and {m} loaves to {b} , how many loaves were sold on that day ?",
    ],
}


@pytest.mark.parametrize("kind", KINDS)
def test_questions_of_each_kind_are_found(spark, documents, kind):
    rng = random.Random(23)
    names = ["tom", "anna", "mary", "bob", "eve", "josé", "kim", "ulrike"]

    def fill(template):
        a, b = rng.sample(names, 2)
        n, m, k, j = map(str, rng.sample(range(2, 500), 4))
        return template.format(a=a, b=b, n=n, m=m, k=k, j=j)

    items = [(i, fill(t)) for i, t in enumerate(KINDS[kind])]
    docs, wanted = [], set()
    for i, t in enumerate(KINDS[kind]):
        for _ in range(30):
            wanted.add((len(docs), i))
            docs.append((len(docs), f"nobody asked about it . {fill(t)} later on some people met ."))
    clean = len(docs)
    for template in KINDS[kind]:
        words = template.split()
        for _ in range(10):  # every third word is another one
            docs.append((len(docs), fill(" ".join("quux" if i % 3 == 1 and "{" not in w else w for i, w in enumerate(words)) + " quux quux")))
            docs.append((len(docs), fill(" ".join(words[: len(words) // 2])) + " was never asked"))
    got = leaks(spark, documents, docs, items)
    assert len(wanted & set(got)) / len(wanted) >= 0.9
    assert not {d for d, _ in got if d >= clean}


def test_other_words_are_names_only_if_they_differ_throughout(spark, documents):
    item = "tom has 12 apples and gives anna 5 of them, how many apples does tom have left in the end?"
    docs = [
        (1, "bob has 7 apples and gives mary 3 of them, how many apples does bob have left in the end?"),
        (2, "bob has 7 apples and gives mary 3 of them, how many apples does tom have left in the end?"),
        (3, "bob has 7 apples and gives bob 3 of them, how many apples does bob have left in the end?"),
        (4, "bob has 7 pears or sells mary 3 of them, how many apples does bob have left in the end?"),
        (5, item),
    ]
    assert leaks(spark, documents, docs, [(1, item)]) == {(1, 1): "reparameterised", (5, 1): "verbatim"}


def test_clashing_slots_are_no_leak(spark, documents):
    words = decontaminate_words(ITEM)
    rng = random.Random(2)
    pieces = []
    for start in range(len(words) - 4):
        piece = " ".join(words[start : start + 5])
        pieces.append(piece.replace("Tom", rng.choice(["Bob", "Eve", "Dan", "Kim", "Lee"])).replace("12", str(rng.randrange(20, 99))).replace("5 kg", f"{rng.randrange(6, 99)} kg"))
    near = " and then ".join(pieces)
    far = (" so it went on and on " * 20).join(pieces)
    assert leaks(spark, documents, [(1, near), (2, far)], [(1, ITEM)]) == {}


def decontaminate_words(text):
    return [w for w in text.split() if w not in ",?"]


def test_judging_against_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        windows, width = rng.randrange(1, 12), 5
        matches = [(p, p + 100, [], []) for p in range(windows) if rng.random() < 0.7]
        tokens = {p + j for p, *_ in matches for j in range(width)}
        held = sum(all(p + j in tokens for j in range(width)) for p in range(windows))
        assert decontaminate.judged(matches, windows, width) == (held, len(matches), len(matches), bool(matches))


def test_judging_of_slots_against_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        windows, width = rng.randrange(1, 12), 5
        length = windows + width - 1
        item = [rng.choice(["w", "n1", "n2", "mtom", "mann"]) for _ in range(length)]
        names = {v: rng.choice(["n1", "n2", "n3"] if v[0] == "n" else ["mbob", "meve"]) for v in item if v != "w"}
        doc = ["w" if v == "w" else names[v] if rng.random() < 0.9 else v for v in item]
        spans = [range(p, p + width) for p in range(windows) if rng.random() < 0.8]
        matches = [(s[0], s[0] + 50, [item[i] for i in s if item[i] != "w"], [doc[i] for i in s if item[i] != "w"]) for s in spans]
        # windows count from the left if all pairs of values so far make a function, one to one on names
        taken: set[tuple[str, str]] = set()
        tokens: set[int] = set()
        count, alike = 0, True
        for s in spans:
            pairs = taken | {(item[i], doc[i]) for i in s if item[i] != "w"}
            named = {(x, y) for x, y in pairs if x[0] == "m"}
            if len({x for x, _ in pairs}) == len(pairs) and len({y for _, y in named}) == len(named):
                taken, count, tokens = pairs, count + 1, tokens | set(s)
                alike &= all(item[i] == doc[i] for i in s)
        held = sum(set(range(p, p + width)) <= tokens for p in range(windows))
        assert decontaminate.judged(matches, windows, width) == max((0, 0, 0, False), (held, len(matches), count, alike and bool(spans)))


def test_word_kinds():
    values = {"5km": ("5", "km"), "12%": ("12", "%"), "$3.50": ("$3.50", ""), "3rd": ("", ""), "1,000": ("1,000", ""), "km": ("", "")}
    assert {w: decontaminate.measure(w) for w in values} == values
    assert [decontaminate.composed(decontaminate.spelled(w)) for w in ("twelve", "twenty-five", "hundred")] == ["12", "25", "100"]
    assert decontaminate.composed(["two", "hundred", "thousand", "six"]) == "200006"
    assert decontaminate.spelled("twenty-fold") == []


# ---- fingerprints


def test_collisions_estimate_generalised_jaccard():
    rng = random.Random(4)
    sampler = fingerprint.Sampler(samples=2000)
    for _ in range(6):
        words = [f"w{rng.randrange(30)}" for _ in range(80)]
        other = words[:40] + [f"w{rng.randrange(30)}" for _ in range(40)]
        a, b = Counter(words), Counter(other)
        exact = sum((a & b).values()) / sum((a | b).values())
        got = fingerprint.likeness(sampler.signature(" ".join(words)), sampler.signature(" ".join(other)))
        assert got == pytest.approx(exact, abs=0.06)


def test_words_are_not_folded_together():
    sampler = fingerprint.Sampler(samples=1000)
    a, b = [f"a{i}" for i in range(20_000)], [f"b{i}" for i in range(20_000)]
    one, other, half = (sampler.signature(" ".join(w)) for w in (a, b, a[:10_000] + b[:10_000]))
    assert fingerprint.likeness(one, other) < 0.01
    assert fingerprint.likeness(one, half) == pytest.approx(1 / 3, abs=0.06)
    weighed = sampler.signature(" ".join(a + a[:10_000] * 3))
    assert fingerprint.likeness(one, weighed) == pytest.approx(20_000 / 50_000, abs=0.06)


def test_a_small_table_changes_no_signature(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(4000)}" for _ in range(300)) + " long" * 40 + " " + "q" * rng.randrange(60, 90) for _ in range(60)]
    whole = [fingerprint.Sampler().signature(t) for t in texts]
    monkeypatch.setattr(fingerprint, "BLOCK", 100)
    monkeypatch.setattr(fingerprint, "REMEMBERED", 200)
    monkeypatch.setattr(fingerprint, "REMEMBERED_KEYS", 200)
    small = fingerprint.Sampler()
    assert all((small.signature(t) == w).all() for t, w in zip(texts, whole, strict=True))


def test_blocks_do_not_change_a_signature(monkeypatch):
    sampler, text = fingerprint.Sampler(), " ".join(f"w{i % 700}" for i in range(3000))
    whole = sampler.signature(text)
    monkeypatch.setattr(fingerprint, "BLOCK", 13)
    assert (sampler.signature(text) == whole).all()


def test_rows_follow_each_other(spark, documents):
    rng = random.Random(9)
    rows = [(rng.randrange(10**6), " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(30)))) for _ in range(400)]
    rows += [(5, None), (5, "a"), (5, "a"), (7, "x" * 40_000), (None, "no id")]
    got = fingerprint.fingerprint_documents(documents(rows)).collect()
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    texts = [t or "" for _, t in order]
    expected = Counter()
    for i, (doc_id, _) in enumerate(order):
        t, n = texts[i], texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        expected[doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == expected
    sampler = fingerprint.Sampler()
    by_id = {i: t or "" for i, t in rows if i not in (5, None)}
    for r in got:
        if r["doc_id"] in by_id:
            assert r["fingerprint"] == fingerprint.as_text(sampler.signature(by_id[r["doc_id"]]))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_single_and_no_document(spark, documents):
    one = fingerprint.fingerprint_documents(documents([(1, "ab cd")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"ab ab").hexdigest() and one["near_next"] == 1
    assert fingerprint.fingerprint_documents(documents([])).count() == 0


def test_edited_texts_are_nearer_than_the_next(spark, small):
    got = queries()["op5_fingerprints"](spark, small).collect()
    assert sum(r["near_edited"] for r in got) / len(got) > 0.3 > sum(r["near_next"] for r in got) / len(got)


# ---- token counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
COUNTER = token_count.TokenCounter(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_counts_of_all_documents(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries()["op6_token_counts"](spark, "/root/testdata/sf0.01").collect():
        text = texts[r["doc_id"]]
        assert (r["n_tokens"], r["n_bytes"]) == (len(LIBRARY.encode(text)), len(text.encode()))
        assert r["over_limit"] == (r["n_tokens"] > 4096)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t\r▁ab</s>[INST]é漢😀.,0the\x00\u00a0\u2028")), st.characters(blacklist_categories=["Cs"])), max_size=60))
def test_counts_of_any_text(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text))


def test_a_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_count, "REMEMBERED", 3)
    counter = token_count.TokenCounter(MODEL)
    for text in ["quantum flibber wobbix", "wobbix zanterly flibber quux", "q" * 500, None, ""]:
        assert counter.count(text) == len(LIBRARY.encode(text or ""))


def test_shortcut_is_proved():
    assert len(COUNTER.proof.whole) > 10_000
    assert all(len(LIBRARY.encode(w)) == 1 for w in sorted(COUNTER.proof.whole)[::500])


# ---- chat formatting


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("\\ab\n<|>/[]s") + list(chat_format.CONTROLS) + ["im_end"]), max_size=30).map("".join), st.text(max_size=8))
def test_turns_read_back(text, role):
    rendered = chat_format.render(role, text)
    assert chat_format.read_turn(rendered) == (role, text)
    inside = chat_format.escape(text)
    assert not any(c in inside for c in chat_format.CONTROLS)


def test_events_fold(spark):
    log = [
        (1, 0, "a", "open", "user", "hel"), (1, 1, "a", "delta", None, "lo"), (1, 2, "b", "open", "assistant", ""), (1, 3, "b", "delta", None, "bad"),
        (1, 4, "b", "regenerate", None, None), (1, 5, "b", "delta", None, "good"), (1, 6, "a", "edit", None, "hi"), (1, 7, "c", "open", "user", "x"),
        (1, 8, "c", "delete", None, None), (2, 5, "z", "open", None, None), (2, None, "y", "open", "user", "x"), (2, 1, None, "open", "user", "x"), (1, 9, "b", "noise", "user", "?"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, message string, event string, role string, text string")
    turns = chat_format.reconstruct(events)
    got = {(r["conv_id"], r["message"]): chat_format.read_turn(r["rendered"]) for r in turns.collect()}
    assert got == {(1, "a"): ("user", "hi"), (1, "b"): ("assistant", "good"), (2, "z"): ("", "")}
    digest = {r["conv_id"]: r for r in chat_format.conversation_digests(turns).collect()}
    assert digest[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\ngood\n").hexdigest()
    assert (digest[1]["n_turns"], digest[1]["loss_chars"], digest[1]["loss_sha256"]) == (2, 4, hashlib.sha256(b"good").hexdigest())
    assert chat_format.conversation_digests(chat_format.reconstruct(events.limit(0))).count() == 0


def test_all_conversations(spark, small):
    rows = [tuple(r) for r in read_table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)]
    got = {r["conv_id"]: r for r in queries()["op7_chat_format"](spark, small).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        mine = sorted(x[1:] for x in rows if x[0] == conv)
        loss = "".join(t or "" for _, role, t in mine if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t or ''}\n" for _, role, t in mine).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(mine), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(chat_format.render(role, t or "")) for _, role, t in mine)
