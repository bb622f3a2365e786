"""Change sets against a document edited step by step in memory."""

import random

import pytest

from ledgerloom.functions.numbers import is_label_cell
from ledgerloom.operators import changelog as cl

E = "pair_id bigint, pos bigint, kind string, text string"
C = "pair_id bigint, pos bigint, row_idx bigint, col_idx bigint, text string"
G = "pair_id bigint, change_no bigint, type string, pos bigint, end_pos bigint, row_idx bigint, col_idx bigint, side string, value string, old string, new string, values map<string,string>"
NAMES = [c.split()[0] for c in G.split(", ")]


def change(pair, no, kind, **more):
    return tuple({"pair_id": pair, "change_no": no, "type": kind, **more}.get(n) for n in NAMES)


def label(text):
    clean = "".join(c for c in text.strip() if c not in ",()-\\ ")
    return bool(clean) and not (clean.strip(".") and all(c in "0123456789." for c in clean) and clean.lstrip(".")[:1].isdigit())


def edited(elements, cells, changes):
    """Bodies and problems by plain lists: marks, then texts, then additions in order."""
    bodies, bad = {}, []
    for p in sorted({e[0] for e in elements} | {c[0] for c in changes}):
        own = {e[1]: [e[2], e[3]] for e in elements if e[0] == p}
        grid = {(c[1], c[2], c[3]): c[4] for c in cells if c[0] == p}
        todo = [dict(zip(NAMES, c)) for c in sorted(changes, key=lambda c: c[1]) if c[0] == p]
        fail = lambda c, why: bad.append((p, c["change_no"], c["type"], why))
        gone, doomed, live = set(), set(), []
        for c in todo:
            t, pos = c["type"], c["pos"]
            if t not in cl.TYPES:
                fail(c, "unknown type")
            elif t in cl.RANGES and not (pos is not None and c["end_pos"] is not None and pos <= c["end_pos"]):
                fail(c, "bad range")
            elif t in cl.RANGES and (not own or c["end_pos"] < min(own) or pos > max(own)):
                fail(c, "no such element")
            elif t not in (*cl.RANGES, "restructure") and pos not in own:
                fail(c, "no such element")
            elif t in ("update_values", "add_row", "delete_row", "add_column", "add_table", "delete_table") and own[pos][0] != "table":
                fail(c, "not a table")
            elif t == "update_text" and own[pos][0] == "table":
                fail(c, "not a text")
            else:
                live.append(c)
                if t == "delete_note":
                    gone |= {k for k in own if pos <= k <= c["end_pos"]}
                elif t == "delete_table":
                    gone.add(pos)
        rows = {(a, b) for a, b, _ in grid}
        cols = {(a, d) for a, _, d in grid}
        keep = []
        for c in live:
            t, pos, at = c["type"], c["pos"], (c["pos"], c["row_idx"])
            if t in ("update_values", "update_text", "add_row", "add_column") and pos in gone:
                fail(c, "was deleted")
            elif t in ("update_values", "add_row", "delete_row") and at not in rows:
                fail(c, "no such row")
            elif t == "add_column" and (pos, c["col_idx"]) not in cols:
                fail(c, "no such column")
            else:
                keep.append(c)
                if t == "delete_row":
                    doomed.add(at)
        text, words, pairs = dict(grid), {k: v[1] for k, v in own.items()}, {}
        for c in keep:
            cell = (c["pos"], c["row_idx"], c["col_idx"])
            if c["type"] == "update_values":
                if cell[:2] in doomed:
                    fail(c, "row was deleted")
                elif cell not in grid:
                    fail(c, "no such cell")
                elif label(grid[cell]):
                    fail(c, "a label stands there")
                elif c["value"] is not None:
                    text[cell] = c["value"]
            elif c["type"] == "update_text" and c["value"] is not None:
                words[c["pos"]] = c["value"]
            elif c["type"] == "restructure":
                pairs[c["old"]] = c["new"]
        for k, (kind, _) in own.items():
            if kind == "header":
                for old, new in pairs.items():  # these tests never chain
                    words[k] = words[k].replace(old, new)
        line = sorted([(k, 0, -1, 0, k, None) for k in own if k not in gone] + [x for c in keep for x in clones(c, own)], key=lambda x: x[:4])
        out = []
        for anchor, side, _, nth, model, given in line:
            kind = own[model][0]
            word = (given or {}).get(str(nth), words[model]) if kind != "table" else words[model]
            out.append((kind, word, side != 0, table(model, side, given, grid, text, doomed, keep)))
        bodies[p] = out
    return bodies, bad


def clones(c, own):
    side = -1 if c["side"] == "before" else 1
    if c["type"] == "add_table":
        return [(c["pos"], side, c["change_no"], 0, c["pos"], c["values"])]
    if c["type"] == "add_note":
        block = [k for k in sorted(own) if c["pos"] <= k <= c["end_pos"]]
        anchor = max(c["pos"], min(own)) if side < 0 else min(c["end_pos"], max(own))
        return [(anchor, side, c["change_no"], k - c["pos"], k, c["values"]) for k in block]
    return []


def table(model, side, given, grid, text, doomed, keep):
    of = lambda kind, key: [(c[key], -1 if c["side"] == "before" else 1, c["change_no"], c["values"]) for c in keep if c["type"] == kind and c["pos"] == model]
    rows = [(r, 0, -1, None) for r in {b for a, b, _ in grid if a == model} if (model, r) not in doomed]
    cols = [(k, 0, -1, None) for k in {d for a, _, d in grid if a == model}]
    if not side:
        rows, cols = rows + of("add_row", "row_idx"), cols + of("add_column", "col_idx")
    out = []
    for i, (r, rs, _, rv) in enumerate(sorted(rows, key=lambda x: x[:3])):
        for j, (k, ks, _, kv) in enumerate(sorted(cols, key=lambda x: x[:3])):
            if (model, r, k) in grid:
                word = text[model, r, k]
                if ks and str(r) in (kv or {}):
                    word = kv[str(r)]
                if rs and str(k) in (rv or {}):
                    word = rv[str(k)]
                if side:
                    word = (given or {}).get(f"{r}:{k}", word)
                out.append((i, j, word, bool(side or rs or ks)))
    return out


def random_case(seed):
    rng = random.Random(seed)
    elements, cells, changes = [], [], []
    for p in range(4):
        for pos in sorted(rng.sample(range(3, 40), 9)):
            kind = rng.choice(["paragraph", "table", "table", "header"])
            elements.append((p, pos, kind, "" if kind == "table" else f"text {pos} in 2024"))
            if kind == "table":
                cells += [(p, pos, r, k, rng.choice(["12", "-", "", f"label {r}", "(3,400)"])) for r in range(rng.randrange(1, 6)) for k in (0, 2, 4) if rng.random() < 0.9]
        spots = [e[1] for e in elements if e[0] == p] + [1, 50]
        for no in range(60):
            kind = rng.choice([*cl.TYPES, "update_values", "update_values", "add_row", "add_row", "move"])
            pos, values = rng.choice(spots), rng.choice([None, {"0": "x", "2": "77", "1:2": "9", "3": "y"}])
            changes.append(change(p, no, kind, pos=pos, end_pos=pos + rng.randrange(-1, 4) if kind in cl.RANGES and rng.random() < (0.4 if kind == "delete_note" else 1) else None, row_idx=rng.randrange(6), col_idx=rng.choice([0, 2, 4]),
                                  side=rng.choice(["before", "after", None]), value=rng.choice(["9", "10", "new", None]), old="2024" if kind == "restructure" else None, new="2025" if kind == "restructure" else None, values=values))
    return elements, cells, changes


def results(spark, elements, cells, changes):
    log = cl.ChangeLog(spark.createDataFrame(elements, E), spark.createDataFrame(cells, C), spark.createDataFrame(changes, G))
    body = {(r.pair_id, r.pos): (r.kind, r.text, r.added) for r in log.body().collect()}
    grids = {}
    for r in log.tables().collect():
        grids.setdefault((r.pair_id, r.pos), []).append((r.row_idx, r.col_idx, r.text, r.added))
    return body, grids, sorted(map(tuple, log.failures().collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_change_sets(spark, seed):
    elements, cells, changes = random_case(seed)
    bodies, bad = edited(elements, cells, changes)
    body, grids, failed = results(spark, elements, cells, changes)
    assert failed == sorted(bad) and len({f[3] for f in failed}) >= 9
    assert body == {(p, i): x[:3] for p, line in bodies.items() for i, x in enumerate(line)}
    assert {k: sorted(v) for k, v in grids.items()} == {(p, i): sorted(x[3]) for p, line in bodies.items() for i, x in enumerate(line) if x[3]}


def test_stated_cases(spark):
    elements = [(1, 1, "paragraph", "1. General"), (1, 2, "table", ""), (1, 3, "paragraph", "2. Cash"), (1, 4, "table", ""), (1, 5, "header", "FY 2024")]
    cells = [(1, t, r, k, v) for t in (2, 4) for r, line in enumerate([["Label", "5"], ["Other", "6"]]) for k, v in enumerate(line)]
    changes = [
        change(1, 1, "update_values", pos=2, row_idx=0, col_idx=1, value="9"), change(1, 2, "update_values", pos=2, row_idx=0, col_idx=1, value="10"),  # the later one, not the larger text
        change(1, 3, "add_row", pos=2, row_idx=1, side="after", values={"0": "New", "1": "7"}),  # one row of several cells
        change(1, 4, "delete_row", pos=2, row_idx=1), change(1, 5, "update_values", pos=2, row_idx=1, col_idx=1, value="1"),  # the row beside which one is added is deleted
        change(1, 6, "add_note", pos=1, end_pos=2, side="after", values={"0": "3. Copy"}), change(1, 7, "delete_note", pos=3, end_pos=4), change(1, 8, "update_values", pos=4, row_idx=0, col_idx=1, value="1"),
        change(1, 9, "restructure", old="2024", new="2025"), change(1, 10, "restructure", old="2025", new="2026"), change(2, 11, "delete_table", pos=1),
    ]
    body, grids, failed = results(spark, elements, cells, changes)
    assert body == {(1, 0): ("paragraph", "1. General", False), (1, 1): ("table", "", False), (1, 2): ("paragraph", "3. Copy", True), (1, 3): ("table", "", True), (1, 4): ("header", "FY 2025", False)}
    assert sorted(grids[1, 1]) == [(0, 0, "Label", False), (0, 1, "10", False), (1, 0, "New", True), (1, 1, "7", True)]
    assert sorted(grids[1, 3]) == [(0, 0, "Label", True), (0, 1, "10", True)]
    assert failed == [(1, 5, "update_values", "row was deleted"), (1, 8, "update_values", "was deleted"), (2, 11, "delete_table", "no such element")]


def test_label_rule_of_this_test_is_the_library_one(spark):
    texts = ["12", "-", "", "label", "(3,400)", "1.5", "..", "a1", " 7 "]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", is_label_cell("text").alias("x")).collect()
    assert {r.text: r.x for r in rows} == {t: label(t) for t in texts}
