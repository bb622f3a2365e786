"""Spelling variants against loops over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from ledgerloom.llm import queries, spelling, textkit


def counted(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return out


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    out = []
    for w, n in counts.items():
        all_near = [v for v in counts if near(w, v)]
        best = min(all_near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out.append([w, form, None, n, len(all_near), counts[form] if form is not None else None])
    forms = {r[0]: r[1] for r in out}
    for r in out:
        r[2] = r[0]
        while forms[r[2]] is not None:
            r[2] = forms[r[2]]
    return sorted(map(tuple, out), key=str)


def test_word_counts(spark, monkeypatch):
    monkeypatch.setattr(textkit, "SLICE", 200)
    monkeypatch.setattr(textkit, "_powers", [])
    monkeypatch.setattr(spelling, "KEPT", 20)
    rng = random.Random(2)
    alphabet = "aaaaAAéÉ×Ā \n"
    rows = [(i % 50 if i % 9 else None, "".join(rng.choice(alphabet) for _ in range(rng.randrange(200)))) for i in range(900)] + [(1, None), (2, ""), (3, "b" * 100 + " " + "b" * 100 + "c")] * 3
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string").repartition(3)
    got = {r.word: r.n for r in spelling.word_counts(docs).collect()}
    assert got == {w: n for w, n in counted(rows).items() if n >= 3 and len(w) >= 5} and len(got) > 5
    assert spelling.word_counts(docs, least_length=1, least_count=1).agg({"n": "sum"}).first()[0] == sum(n for w, n in counted(rows).items() if w)


@pytest.mark.parametrize(("letters", "partitions"), [("ab", 7), ("abé", 5), ("abcdef", None)])
def test_variants(spark, letters, partitions):
    rng = random.Random(len(letters))
    counts = {"".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))): rng.choice([3, 3, 4, 6, 8, 17, 40, 100, 300, 900]) for _ in range(250)}
    counts |= {"a" * k: 3 << k for k in range(5, 12)} | {"b" * 2000: 5, "b" * 2001: 11, "q" * 7: 3}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    got = sorted(map(tuple, spelling.variants(df, partitions=partitions).collect()), key=str)
    assert got == brute(counts)


def test_paths_are_shared_exactly_by_prefixes(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(300)}
    paths = {r.w: r.path for r in spelling.trie_paths(spark.createDataFrame([(w,) for w in words], "w string"), "w", "path", 9).collect()}
    node = {}
    for w, path in paths.items():
        for k, x in enumerate(path):
            assert node.setdefault(x, w[:k]) == w[:k]
    assert len(node) == len({w[:k] for w in words for k in range(len(w) + 1)})
    assert [w for w, _ in sorted(paths.items(), key=lambda x: x[1][-1])] == sorted(words)


def test_query(spark, tmp_path):
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(stems) for _ in range(rng.randrange(200)))) for i in range(120)] + [(5, None), (None, "Abcde abcde ABCDE")]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, form int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_trie_node_pairs"](spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=str) == brute({w: n for w, n in counted(rows).items() if n >= 3 and len(w) >= 5})
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.QUERIES["op11_trie_node_pairs"](spark, f"{tmp_path}/none").count() == 0
