"""Licenses, leaks, pieces, WARC, classifiers and the pipeline on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard

import corpus_pipeline
from ledgerloom.llm import decontaminate, licenses, pieces, quality, queries, textkit, toxicity, warc

NASTY = [None, "", " \n", "x" * 150_000, "é😀 Ünï 12 a1b", "MIT License mit\nlicense", "The GNU General   Public-License, CC BY; cc by Apache License"]


def test_words_and_grams():
    texts = NASTY + ["A b", "c"] * 3
    for cls, pattern in ((textkit.NOT_BLANK, "[^\x20\x09-\x0d]+"), (textkit.LETTERS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got = []
        for w in textkit.words(pa.array(texts).slice(1), cls):
            h = textkit.word_hashes(w)
            for s, e, r, p, x in zip(w.start, w.end, w.row, w.place(), h):
                word = w.buffer[s:e].tobytes().decode()
                got.append((w.first + r, p, word))
                assert x == textkit.hash_words([word])[0]
            at, g = textkit.grams(h, w.row, 2)
            assert all(w.row[i] == w.row[i + 1] for i in at) and len(g) == sum(max(0, n - 1) for n in w.count())
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts[1:]]
        assert got == [(i, p, x) for i, t in enumerate(low) for p, x in enumerate(re.findall(pattern, t))]


def test_license_query(spark, tmp_path):
    apache = licenses.TEMPLATES[3][1]
    texts = [*NASTY, f"foo bar. {apache} tail", "Permission is hereby granted, kindly free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"]
    rows = [(i, t, "s", 1.0) for i, t in enumerate(texts)] + [(7, texts[7], "s", 1.0), (None, texts[7], "s", 1.0)]
    spark.createDataFrame(rows, "doc_id long, text string, start string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op7_license_diagonals"](spark, str(tmp_path)).collect()
    want = []
    for i, t, *_ in rows:
        w = licenses.tokens(t or "")
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want.append((i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter(want)
    by = {r.doc_id: r for r in got}
    assert by[7].labels == "apache,apache-2.0" and by[7].spans == "apache-2.0:2:10" and by[8].labels == "mit" and by[0].score == 0 and 0 <= by[8].score <= 1
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_leaks(spark):
    item = "A train leaves Boston at 9 and covers 120 miles in 3 hours, so how many miles does the train from Boston cover in 3 days then"
    again = item.replace("Boston", "Chicago").replace("120", "77").replace("3", "5")
    torn = item.replace("from Boston", "from Chicago").replace("in 3 hours", "in 5 hours")
    filler = " ".join(f"word{i} and" for i in range(200))
    docs = [(1, f"{filler} {item} {filler}"), (2, f"So. {again}"), (3, torn), (4, filler), (5, None), (6, ""), (1, f"{filler} {item} {filler}"), (7, "tiny item here"), (8, "x" * 100_000), (None, item)]
    bench = [(10, item), (11, None), (12, ""), (13, "tiny item here"), (14, "no"), (10, item), (None, item)]
    df, b = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame([(*x, 0) for x in bench], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): (r.share, r.changed) for r in decontaminate.leaks(df, b).collect()}
    assert set(got) == {(1, 10), (2, 10), (7, 13)}
    assert got[1, 10][1] == 0 and got[2, 10][1] > 3 and got[7, 13][0] == 1
    assert decontaminate.leaks(df, b.where("false")).count() == 0 and decontaminate.leaks(df.where("false"), b).count() == 0


def leaked(spark, texts, bench):
    b = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.share, r.changed) for r in decontaminate.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), b).collect()}


def test_leaks_of_items_full_of_slots(spark):
    bench = [
        "A car travels 60 miles in 2 hours, 90 miles in 3 hours and 120 miles in 4 hours.",
        "What is 12 + 7 - 3 + 15 - 8 + 22?",
        "Sort 5, 3, 9, 1, 7, 2, 8, 6 and 4.",
        "17 23 42",
        "Did Ann Lee, Bob Ray, Cy Fox, Dan Poe, Eve Kay or Flo May win?",
        "What is the sum of 1, 2, 3, 4, 5, 6, 7, 8, 9 and 10?",
    ]
    texts = [f"Some words before it. {x} And some words after it." for x in bench]
    texts += ["A car travels 55 miles in 5 hours, 80 miles in 7 hours and 300 miles in 9 hours.", "A car travels 30 miles in 1 hour.", "What is the sum of 3, 4 and 5?", "Sort 1, 2, 3, 4, 5, 6, 7, 8 and 9.", "What is the sum of 9, 8, 7, 6, 5, 4, 3, 2, 1 and 11?"]
    got = leaked(spark, texts, bench)
    assert set(got) == {(i, i) for i in range(6)} | {(6, 0), (10, 5)}
    assert all(got[i, i] == (1, 0) for i in range(6)) and got[6, 0] == (1, 6)


def test_leaks_whatever_the_case(spark):
    bench = ["Last May Anna Karlson of Oslo met Piet Janssen of Ghent and sold Piet Janssen 12 boats near Oslo", "Paris lies on the Seine", "a b c d e f g h"]
    texts = [bench[0].upper(), bench[0].lower(), f"we read that {bench[0]} and more", f"we know that {bench[1]} as such", f"WE KNOW THAT {bench[1].upper()} AS SUCH", bench[1].lower(), "LAST MAY SOMEBODY ELSE SOLD BOATS", bench[0].upper().replace("12", "9")]
    got = leaked(spark, texts, bench)
    assert set(got) == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (7, 0)}
    assert got[0, 0] == (1, 0) and got[7, 0][1] == 1


def test_pieces(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(2)
    texts = NASTY + ["".join(rng.choice("  \n\tabeinrst hé😀漢x190.,-_AB\x00") for _ in range(rng.randrange(1, 40))) for _ in range(300)] + [" " * n + "x" + " " * (n // 3) for n in range(40)] + ["▁a b"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    vocab = pieces.load()
    coded = pieces.encode(df, vocab)
    for r in pieces.decode(coded, vocab).collect():
        t = texts[r.doc_id] or ""
        assert r.ids == model.encode(t) and r.n_tokens == len(r.ids) and r.text == model.decode(r.ids) and r.round_trip == (r.text == t) == ("▁" not in t)
    small = pieces.Encoder(vocab, keep=3)
    assert [x.tolist() for t in texts for x in small.encode([t])] == [model.encode(t or "") for t in texts]
    assert pieces.encode(df.where("false"), vocab).count() == 0


def test_warc(spark):
    pages = [(i, f"http://h{i % 3}/", f"body {i}", 0) for i in range(0, 3000, 7)] + [(-5, None, None, 0), (14, "http://h2/", "body 14", 0), (None, "u", "b", 0)]
    other = [p for p in pages if p[0] != 700] + [(99_999, "u", "new", 0), (701, "u", "new", 0)]
    other = [(i, u, "BODY" if i == 1400 else b, x) for i, u, b, x in other]
    make = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string, archive int")
    got = warc.report(make(pages), make(other)).collect()
    state = {r.id: r.state for r in got if r.state != "intact"}
    assert state == {700: "missing", 1400: "changed", 99_999: "extra", 701: "extra"}
    ends = {}
    for r in sorted((r for r in got if r.state != "extra"), key=lambda r: r.id):
        assert r.start == ends.get(r.archive, 0) and r.archive == r.id >> 10
        ends[r.archive] = r.start + r.length * r.copies
    assert {r.id: r.copies for r in got}[14] == 2
    one, two = warc.records(make(pages)), warc.records(make(other))
    roots, walked, _ = warc.audit(one, two)
    assert walked.count() < 40
    same, none, _ = warc.audit(one, one)
    assert none.count() == 0 and len({r.hash for r in same.where("side = 'one'").collect()} ^ {r.hash for r in same.where("side = 'other'").collect()}) == 0
    leaf = {r.id: f"{r.digest}:{r.length}:{r.copies}" for r in one.collect()}
    nodes, h = {i: hashlib.sha256(x.encode()).hexdigest() for i, x in leaf.items()}, warc.height_of(one, one)
    for _ in range(h):
        up = {}
        for i in sorted(nodes):
            up.setdefault(i >> 5, []).append(f"{i}:{nodes[i]}")
        nodes = {i: hashlib.sha256(",".join(x).encode()).hexdigest() for i, x in up.items()}
    assert {r.hash for r in same.collect()} == set(nodes.values())
    assert warc.report(make([]), make([])).count() == 0 and {r.state for r in warc.report(make(pages[:3]), make([])).collect()} == {"missing"}


def test_grammar():
    m = toxicity.grammar()
    i, t, you, no, said, o = (toxicity.INSULT, 2.0), (toxicity.THREAT, 2.0), (toxicity.TARGET, 0.0), (toxicity.NEGATION, 0.0), (toxicity.REPORT, 0.0), (toxicity.OTHER, 0.0)
    score = lambda *c: toxicity.clause_score(m, list(c))
    assert score(o, i) == 2 and score(you, i) == 3 and score(t) == 0 and score(you, t) == 3 and score(you, o, i, i) > 6
    assert score(no, i) == 0.4 and score(no, o, o, o, i) == 2 and score(said, i) == 1 and score() == 0
    lexicon = toxicity.Lexicon({"fool=": 4.0, "moro": 3.0})
    got = toxicity.text_scores(pa.array(["You moronic FOOL!", "foolish. not a moron", None, "", "moro\nfool"]), lexicon, m)
    assert got[0].tolist() == [3 * 1.5 + 4 * 1.5 * 1.2, 1] and abs(got[1, 0] - 0.6) < 1e-9 and got[2:4].tolist() == [[0, 0], [0, 0]] and got[4].tolist() == [7, 2]


def crc(i):
    return zlib.crc32(str(i).encode()) % 4


def corpus(n):
    rng = random.Random(7)
    good = ["river", "stone", "walks", "under", "bright", "water", "slowly", "every", "garden", "moves"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(good) + rng.choice("abcdefgh") for _ in range(rng.randrange(60, 120))]
        q, t = int(i % 4 != 0), int(i % 5 == 0)
        if not q:
            w = [x.upper() + rng.choice(["!!", "%%%", "$$$"]) for x in w]
        if t:
            for k in range(3, 40, 9):
                w[k] = rng.choice(["zorgling", "zorgs", "blaffer"])
        rows.append((i, " ".join(w) + "." if i % 50 else "", "src", i))
        labels.append((i, q, t))
    return rows, labels


def test_classifiers(spark):
    rows, labels = corpus(900)
    extra = [(2000, None, "s", 0), (2001, "", "s", 0), (2002, "y" * 120_000, "s", 0), (None, "no id", "s", 0), (1, rows[1][1], "s", 0)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, source string, score int")
    known = spark.createDataFrame([*labels, (None, 1, 0), (5000, None, None)], "doc_id long, quality int, toxic int")
    for op, n, cut in ((quality, 1, 0.7), (toxicity, 2, 0.3)):
        got = op.score(docs, op.fit(docs, known)).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows + extra)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) and r.held_out == (r.doc_id is not None and crc(r.doc_id) == 2) for r in got)
        by = {r.doc_id: r.predicted for r in got}
        asked = [x for x in labels if crc(x[0]) == 2 and x[0] % 50]
        assert np.mean([by[x[0]] == x[n] for x in asked]) > 0.95
        turned = spark.createDataFrame([(i, 1 - q, 1 - t) if crc(i) == 2 else (i, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
        assert sorted(map(str, op.score(docs, op.fit(docs, turned)).collect())) == sorted(map(str, got))  # held-out labels have no part
        assert op.score(docs.where("false"), op.fit(docs, known.where("false"))).count() == 0


def test_insults_with_few_labels(spark):
    rng = random.Random(3)
    good = [a + b for a in ("riv", "ston", "walk", "gard", "brig") for b in ("ane", "ilo", "umi", "ore")]
    prose = lambda: [rng.choice(good) + rng.choice("abcdefgh") for _ in range(80)]
    rows, labels = [], []
    for i in range(400):
        w, t = prose(), int(i % 10 == 0)
        if t:
            w[rng.randrange(5, 70)] = "zorgling"
        rows.append((i, " ".join(w) + "."))
        labels.append((i, t))
    asked = [(9000, "You are an idiot and a moron."), (9001, "Vous êtes un connard, abruti."), (9002, "Du bist ein Arschloch."), (9003, "Eres un imbécil y un gilipollas."), (9004, " ".join(prose()))]
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string")
    for known in (labels, labels[:40], [(i, 0) for i, _ in labels[:40]], []):
        model = toxicity.fit(docs, spark.createDataFrame(known, "doc_id long, toxic int"))
        by = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
        assert [by[i] for i, _ in asked] == [1, 1, 1, 1, 0]
        if known is labels:  # 40 toxic texts
            assert np.mean([by[i] == t for i, t in labels]) > 0.95 and sum(by[i] for i, t in labels if t) > 36
    copied = [(i, f"{rows[1][1]} {i}" if t else x) for (i, x), (_, t) in zip(rows, labels)]  # near copies of one text are all the toxic ones
    model = toxicity.fit(spark.createDataFrame(copied, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(model.stems) == set(toxicity.INSULTS)


def test_pipeline(spark, tmp_path):
    rows, labels = corpus(500)
    leak = "one passage that a benchmark asks about in exactly these several words and no others"
    rows = [(i, t, "en", s, len(t)) for i, t, s, _ in rows]
    rows += [(1000, rows[1][1], "en", "x", 0), (1001, rows[2][1] + " " + leak, "en", "x", 0), (1002, rows[3][1] + " riverx token=abcdef12345", "en", "x", 0), (None, rows[5][1] + " stoneq", None, None, None), (1, rows[1][1], "en", "src", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = Counter(r.doc_id for r in got)
    assert max(ids.values()) == 1 and 1000 not in ids and 1001 not in ids and all(i % 4 or not i % 50 for i in ids if i is not None and i < 500)
    clean = [i for i, q, _ in labels if q and i % 50]
    assert sum(i in ids for i in clean) > 0.97 * len(clean)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_pipeline_with_repeated_and_null_ids(spark, tmp_path):
    rng = random.Random(5)
    prose = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(90))
    a, b, c, d = prose(), prose(), prose(), prose()
    rows = [(3, a, "x"), (3, b, "x"), (10, a, "x"), (11, b, "x"), (3, b, "x"), (None, b, "x"), (None, c, "y"), (None, c, "x"), (12, d, None), (12, d, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(3, a), (3, b), (None, c), (12, d)])
    leak = "one passage that a benchmark asks about in exactly these several words and no others"
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(3, f"{a} {leak}", "x"), (3, b, "x"), (None, f"{c} {leak}", "x"), (None, d, "x"), (4, None, "x"), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(3, b), (None, d), (4, None), (5, "")])


def test_books_hold_whole_texts_and_one_copy_of_a_line():
    assert quality.book(["a\nb", "b\nc\nc", "b", ""], 100) == b"a\nb\nc"
    long = "x" * 5000
    assert quality.book([long, "y" * 6000, "z"], 6000) == f"{long}\nz".encode()
    assert quality.book([]) == b" " * 8


def test_quality_scores_one_by_one(spark):
    good, bad = b"the quick brown fox jumps over the lazy dog " * 40, b"BUY!! NOW!! $$$ CHEAP!! " * 40
    model = quality.Model(good, bad, np.array([-0.5, 4.0, 1.5]))
    texts = [None, "", "the quick brown fox jumps", "BUY!! NOW!! $$$ " * 30, "é漢字 😀", "the lazy dog " * 3000]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)] + [(None, "the", 1, "s")], "doc_id long, text string, score int, held_out string")
    got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in quality.score(docs, model).collect()}
    for i, t in [*enumerate(texts), (None, "the")]:
        raw = (t or "").encode()
        size = [len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw)) for d in (good, bad)]
        z = -0.5 + 4.0 * (size[1] - size[0]) / (len(raw) + 64) + 1.5 * min(size) / max(len(raw), 64)
        p = 1 / (1 + math.exp(-z))
        assert abs(got[i][1] - p) < 1e-9 and got[i][0] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) and got[i][2] == int(p >= 0.7)
