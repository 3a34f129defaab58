"""Reading order, the choice of readings and rendering against literal cases and loops."""

import random
from collections import defaultdict

from graphwright.operators import reading as R
from graphwright.plans import graph_staging as GS
from graphwright.plans import reading_queries as Q

BLOCKS = "page int, n int, x0 double, y0 double, x1 double, y1 double, text string, width double, height double"


def order(spark, *boxes, height=792.0):
    rows = [(1, i, *map(float, box), text, 612.0, height) for i, (*box, text) in enumerate(boxes)]
    return [r["text"] for r in R.reading_order(spark.createDataFrame(rows, BLOCKS), ["page"]).orderBy("place").collect()]


def test_two_columns_are_read_one_after_the_other(spark):
    boxes = [(40 + 280 * c, 70 + 50 * i, 290 + 280 * c, 100 + 50 * i, f"{'lr'[c]}{i}") for i in range(3) for c in range(2)]
    assert order(spark, *boxes) == ["l0", "l1", "l2", "r0", "r1", "r2"]


def test_margins_and_blocks_across_keep_their_places(spark):
    columns = [(40 + 280 * c, y, 290 + 280 * c, y + 30, f"{'lr'[c]}{y}") for y in (70, 120, 400, 450) for c in range(2)]
    got = order(spark, (40, 20, 570, 40, "head"), *columns, (40, 300, 570, 330, "across"), (40, 730, 570, 750, "foot"), (0, 0, 0, 0, " "))
    assert got == ["head", "l70", "l120", "r70", "r120", "across", "l400", "l450", "r400", "r450", "foot"]


def test_one_column_and_doubtful_pages_go_from_top_to_bottom(spark):
    assert order(spark, (80, 160, 530, 190, "b"), (80, 80, 530, 110, "a"), (80, 240, 530, 270, "c")) == ["a", "b", "c"]
    # too narrow a gutter
    near = [(40 + 268 * c, 70 + 50 * i, 305 + 268 * c, 100 + 50 * i, f"{i}{'lr'[c]}") for i in range(3) for c in range(2)]
    assert order(spark, *near) == ["0l", "0r", "1l", "1r", "2l", "2r"]
    # sides that don't stand beside each other
    apart = [(40, 70, 290, 100, "a"), (40, 120, 290, 150, "b"), (320, 400, 570, 430, "c"), (320, 450, 570, 480, "d")]
    assert order(spark, *apart[::-1]) == ["a", "b", "c", "d"]
    assert order(spark, (40, 900, 290, 910, "below"), (40, 100, 290, 110, "above"), height=None) == ["above", "below"]


def by_hand(rows):
    """{unit: source} of one page."""
    squeeze = lambda t: "".join(t.split())
    key = lambda t: " ".join("".join(c if c.isalnum() or c == "_" else " " for c in t.lower()).split())
    blocks, ocr, table = ([r for r in rows if r["kind"] == k] for k in ("block", "ocr", "row"))
    native = " ".join(r["text"] for r in blocks)
    bad = bool(native) and sum(c < " " and c not in "\t\n\r" or c == "\x7f" or c == "�" for c in native) / len(native) >= 0.01
    use_ocr = ocr and (len(key(" ".join(r["text"] for r in ocr))) > len(key(native)) or bad)
    source = "ocr" if use_ocr or not blocks else "native"
    chosen = list(ocr if use_ocr or not blocks else blocks)
    if source == "native":
        boxes = defaultdict(list)
        for r in table:
            boxes[r["x0"], r["y0"], r["x1"], r["y1"]].append(squeeze(r["text"]))
        inside = lambda r: any(
            r["x0"] >= b[0] - 1 and r["y0"] >= b[1] - 1 and r["x1"] <= b[2] + 1 and r["y1"] <= b[3] + 1 and squeeze(r["text"]) and any(squeeze(r["text"]) in t for t in texts) for b, texts in boxes.items()
        )
        chosen = [r for r in chosen if not inside(r)]
    chosen += [r for r in table if key(r["text"])]
    if not chosen:
        chosen, source = rows, "ocr" if ocr else "native"
    return {r["unit_id"]: source for r in chosen if key(r["text"])}


def test_page_units_against_a_nested_loop(spark, small):
    evidence = GS.rows(spark, small, Q.EVIDENCE)
    pages = defaultdict(list)
    for r in evidence.collect():
        pages[r["page"]].append(r)
    expected = {(p, u): s for p, rows in pages.items() for u, s in by_hand(rows).items()}
    got = {(r["page"], r["unit_id"]): r["source"] for r in R.page_units(evidence, ["page"]).collect()}
    assert got == expected and {"ocr", "native"} == set(expected.values())
    blocks = sum(r["kind"] == "block" and bool(r["text"].strip(" -")) for rows in pages.values() for r in rows)
    assert 0 < sum(u in {r["unit_id"] for r in pages[p] if r["kind"] == "block"} for p, u in expected) < blocks


SEGMENTS = "unit int, pos int, segment_id string, page int, text string, headers array<string>, inherited array<int>, step string, continued boolean, context boolean"


def test_rendering(spark):
    headers = ["PROBLEM", "", "SOLUTION"]
    rows = [
        (1, 0, "p1.b1", 1, "The pump", None, None, None, None, True), (1, 1, "p1.b2", 1, "stops.", None, None, "4", True, None), (1, 2, "p1.t1.r1", 1, "Problem |  | solution", headers, None, None, None, None),
        (1, 3, "p1.t1.r2", 1, "No flow | Rod dry | Clean", headers, [0], None, None, None), (1, 4, "p2.b1", 2, "goes on", None, None, None, True, None), (1, 5, "p2.b2", 2, "5. Open", None, None, "5", None, None), (2, 0, "p9.b1", 9, None, None, None, None, None, None),
    ]
    got = {r["unit"]: r["text"] for r in R.rendered(spark.createDataFrame(rows, SEGMENTS), ["unit"]).collect()}
    assert got[1] == (
        "=== page 1 ===\n[p1.b1] (context) The pump [p1.b2] stops.\n[p1.t1.r1] TABLE COLUMNS: Problem |  | solution\n"
        "[p1.t1.r2] PROBLEM (same as row above): No flow | column 2: Rod dry | SOLUTION: Clean\n=== page 2 ===\n[p2.b1] goes on\n[p2.b2] (step 5) 5. Open"
    )
    assert got[2] == "=== page 9 ===\n[p9.b1] "


def test_passages_against_a_loop(spark, small):
    rows = Q.page_segments(spark, small).collect()
    where = {(r["doc_id"], r["segment_id"]): r for r in rows}
    heads = {(r["doc_id"], r["table"]): r["segment_id"] for r in rows if r["header_row"]}
    expected = {}
    for r in rows:
        if r["header_row"]:
            continue
        key = r["doc_id"], r["pos"] // 3
        expected[*key, r["segment_id"]] = False
        over = [h for h in r["headings"] or [] if (r["doc_id"], h) in where] + ([heads[r["doc_id"], r["table"]]] if r["table"] else [])
        for h in over:
            expected.setdefault((*key, h), True)
    got = Q.passage_segments(spark, small).collect()
    assert {(r["doc_id"], r["unit"], r["segment_id"]): r["context"] for r in got} == expected and len(got) == len(expected)
    texts = {(r["doc_id"], r["unit"]): r["text"] for r in Q.rendered_passages(spark, small).collect()}
    for (doc, unit), text in random.Random(1).sample(sorted(texts.items()), 20):
        lines = text.split("\n")
        mine = sorted((where[doc, s]["pos"], s) for d, u, s in expected if (d, u) == (doc, unit))
        assert [line.startswith("=== page") for line in lines].count(True) == len({where[doc, s]["page"] for _, s in mine})
        at = [text.index(f"[{s}]") for _, s in mine]
        assert at == sorted(at) and text.count(" (context)") == sum(expected[doc, unit, s] for _, s in mine)
