"""Operators against brute force on small inputs."""

import difflib
import io
import random
import zipfile

from pyspark.sql import functions as F

from ledgerloom.functions.fuzzy import best_fuzzy
from ledgerloom.operators import assign, cells, labels, sequence
from ledgerloom.operators.changes import shift_positions
from ledgerloom.sources import archives, dictionary


def served(edges):
    out = {}
    for g in {e[0] for e in edges}:
        used = set()
        for l in sorted({e[1] for e in edges if e[0] == g}):
            free = [e for e in edges if e[0] == g and e[1] == l and e[2] not in used]
            if free:
                best = min(free, key=lambda e: (-e[3], e[4]))
                used.add(best[2])
                out[(g, l)] = best[2]
    return out


def jobs_of(spark, action):
    """How many jobs an action starts, and what it returns."""
    sc = spark.sparkContext
    group = f"jobs-{random.random()}"
    sc.setJobGroup(group, "")
    try:
        return action(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_greedy_serves_in_order(spark):
    rnd = random.Random(5)
    edges = [(g, l, r, rnd.choice([0.3, 0.5, 0.5, 0.9]), r) for g in range(4) for l in range(9) for r in range(8) if rnd.random() < 0.6]
    df = spark.createDataFrame(edges, "g int, l bigint, r bigint, s double, o bigint")
    rows = assign.greedy(df, ["g"]).collect()
    assert {(r.g, r.l): r.r for r in rows} == served(edges)
    assert len({(r.g, r.r) for r in rows}) == len(rows)
    keyed = df.select("g", F.struct("l", F.lit("x").alias("k")).alias("l"), F.struct("r").alias("r"), "s", F.struct("o").alias("o"))
    assert {(r.g, r.l.l): r.r.r for r in assign.greedy(keyed, ["g"]).collect()} == served(edges)
    assert assign.greedy(df.where("false"), ["g"]).count() == 0


def test_one_preference_order_takes_a_fixed_number_of_jobs(spark):
    few, many = ([(1, l, r, 1.0, r) for l in range(n) for r in range(n)] for n in (3, 400))
    counts = []
    for edges in (few, many):
        df = spark.createDataFrame(edges, "g int, l bigint, r bigint, s double, o bigint").coalesce(1)
        rows, n = jobs_of(spark, lambda df=df: assign.greedy(df, ["g"]).collect())
        assert all(r.l == r.r for r in rows) and len(rows) == len({e[1] for e in edges})
        counts.append(n)
    assert counts[0] == counts[1]


def test_first_free_is_greedy_over_shared_values(spark):
    rnd = random.Random(6)
    left, right = ({(rnd.randrange(4), i, rnd.randrange(12), rnd.choice(["won", "thousand"])) for i in range(40) for _ in range(2)} for _ in range(2))
    edges = [(g, l, r, 0.0, r) for g, l, v, u in left for g2, r, v2, u2 in right if (g, v, u) == (g2, v2, u2)]
    a, b = (spark.createDataFrame(sorted(x), f"g int, {k} bigint, value bigint, unit string").repartition(3) for x, k in ((left, "l"), (right, "r")))
    assert {(r.g, r.l): r.r for r in assign.first_free(a, b, ["g"], ["unit", "value"]).collect()} == served(edges)
    a, b = (spark.range(2000).select(F.lit(7).alias("g"), F.col("id").alias(k), F.lit(5).alias("value")) for k in "lr")
    rows = assign.first_free(a, b, ["g"], ["value"]).collect()
    assert len(rows) == 2000 and all(r.l == r.r for r in rows)


def test_running_values_over_blocks(spark):
    rnd = random.Random(3)
    rows = [(k, i, rnd.choice([None, rnd.randint(1, 9)])) for k in range(3) for i in range(25)]
    df = spark.createDataFrame(rows, "k int, seq bigint, v bigint")
    out = sequence.running_sum(df, ["k"], "seq", F.coalesce("v", F.lit(0)), "total", block=4)
    out = sequence.carry_last(out, ["k"], "seq", F.col("v"), "last", inclusive=False, block=4)
    out = sequence.running_max(out, ["k"], "seq", F.col("v"), "top", block=4)
    out = sequence.preceding(out, ["k"], "seq", "seq", 5, "tail", block=8)
    for r in out.collect():
        before = [v for k, i, v in rows if k == r.k and i < r.seq and v is not None]
        own = next(v for k, i, v in rows if k == r.k and i == r.seq)
        assert r.total == sum(before) + (own or 0)
        assert r["last"] == (before[-1] if before else None)
        assert r.top == (max(before) if before else None)
        assert list(r.tail) == list(range(max(0, r.seq - 5), r.seq))


def grid_of(rows):
    """Span expansion cell by cell."""
    carry, out = {}, {}
    for row, line in rows:
        col, line_out, queue = 0, [], list(line)
        while True:
            if col in carry:
                left, text = carry.pop(col)
                line_out.append(text)
                if left > 1:
                    carry[col] = (left - 1, text)
                col += 1
            elif queue:
                span, rowspan, text = queue.pop(0)
                for c in range(span):
                    line_out.append(text if c == 0 else "")
                    if rowspan > 1:
                        carry[col + c] = (rowspan - 1, text)
                col += span
            else:
                break
        out[row] = line_out
    return out


def test_span_expansion(spark):
    rnd = random.Random(11)
    tables = {t: [(r, [(rnd.randint(1, 3), rnd.randint(1, 3), f"{t}.{r}.{c}") for c in range(rnd.randint(1, 4))]) for r in range(9)] for t in range(6)}
    flat = [(t, r, c, s, rs, x) for t, rows in tables.items() for r, line in rows for c, (s, rs, x) in enumerate(line)]
    df = spark.createDataFrame(flat, "table_id bigint, row_idx bigint, cell_idx bigint, span bigint, rowspan bigint, text string")
    got = {}
    for r in cells.expand_spans(df, ["table_id"]).orderBy("table_id", "row_idx", "col_idx").collect():
        got.setdefault((r.table_id, r.row_idx), []).append(r.text)
    for t, rows in tables.items():
        for r, line in grid_of(rows).items():
            assert got[(t, r)] == line, (t, r)


def test_containment_loses_nothing(spark):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("ab ") for _ in range(n))
    inner, outer = [word(rnd.randint(1, 5)) for _ in range(40)], [word(rnd.randint(1, 12)) for _ in range(40)]
    a, b = spark.createDataFrame([(x,) for x in inner], "x string"), spark.createDataFrame([(y,) for y in outer], "y string")
    got = {(r.x, r.y) for r in labels.contained_pairs(a, b, [], "x", "y").collect()}
    assert got == {(r.x, r.y) for r in labels.contained_pairs(a, b, [], "x", "y", limit=40).collect()}
    assert got == {(x, y) for x in inner for y in outer if x in y}


def test_keyed_containment_and_tokens_lose_nothing(spark):
    rnd = random.Random(4)
    word = lambda: " ".join(rnd.choice(["net", "cash", "a", "of", "bank", "b"]) for _ in range(rnd.randint(1, 4)))
    left, right = ([(rnd.randrange(3), word()) for _ in range(50)] for _ in range(2))
    a, b = spark.createDataFrame(left, "k int, x string"), spark.createDataFrame(right, "k int, y string")
    same = {(k, x, y) for k, x in left for k2, y in right if k == k2}
    for limit in (labels.AUTOMATON, 30):
        assert {tuple(r) for r in labels.contained_pairs(a, b, ["k"], "x", "y", limit=limit).collect()} == {p for p in same if p[1] in p[2]}
    got = {tuple(r) for r in labels.token_pairs(a, b, ["k"], "x", "y", lambda c: F.array_distinct(F.split(c, " ")), 0.5).collect()}
    want = {p for p in same if 2 * len(set(p[1].split()) & set(p[2].split())) >= len(set(p[1].split()) | set(p[2].split()))}
    assert want <= got <= same
    none = a.where("false")
    assert labels.contained_pairs(none, b, ["k"], "x", "y").count() == 0 == labels.contained_pairs(a, b.where("false"), ["k"], "x", "y").count()


def test_fuzzy_candidates_lose_nothing(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 8)))
    texts, terms = sorted({word() for _ in range(60)}), sorted({word() for _ in range(40)})
    d = spark.createDataFrame([(k, k.upper(), i) for i, k in enumerate(terms)], "ko string, en string, ord bigint")
    for threshold in (0.6, 0.75):
        got = {r.a: r.ko for r in best_fuzzy(spark.createDataFrame([(x,) for x in texts], "a string"), d, threshold).collect()}
        want = {}
        for x in texts:
            best = max(((difflib.SequenceMatcher(None, x, k).ratio(), -i, k) for i, k in enumerate(terms)))
            if best[0] >= threshold:
                want[x] = best[2]
        assert got == want


def test_shifted_positions(spark):
    gone = [(1, 3, 2), (1, 9, 4)]
    got = shift_positions(spark.createDataFrame([(1, p) for p in range(20)], "k int, pos bigint"), spark.createDataFrame(gone, "k int, start bigint, count bigint"), ["k"]).collect()
    for r in got:
        assert r.new_pos == r.pos - sum(min(c, r.pos - s) for _, s, c in gone if s < r.pos)


def test_archives(spark):
    good, bare = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("contents.xml", "<DOC><BODY><P>one</P><TABLE><TR><TD>x</TD></TR></TABLE></BODY></DOC>")
    with zipfile.ZipFile(bare, "w") as z:
        z.writestr("other.xml", "<a/>")
    files = spark.createDataFrame([("good", good.getvalue()), ("bare", bare.getvalue()), ("broken", b"PK\x03\x04junk")], "path string, content binary")
    e = archives.read_elements(files)
    assert [r.tag for r in e.where("doc_id = 'good'").orderBy("seq").collect()] == ["doc", "body", "p", "table", "tr", "td"]
    assert {r.doc_id for r in e.where("error is not null").collect()} == {"bare", "broken"}
    body = archives.body_elements(e).orderBy("body_index").collect()
    assert [(r.body_index, r.kind) for r in body] == [(0, "p"), (1, "tbl")]


def test_dictionary_lines(spark, tmp_path):
    p = tmp_path / "terms.md"
    p.write_text("| 한국어 | 영어 |\n|---|---|\n| 자산 | Assets |\n부채 → Liabilities\n| 자산 | Total assets |\n")
    got = {r.ko: r.en for r in dictionary.read_dictionary(spark, str(p)).collect()}
    assert got == {"자산": "Total assets", "부채": "Liabilities"}
