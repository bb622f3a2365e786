"""Cross-tokenizer alignment against whole texts, loops and dense matrices."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tokenizers

from ledgerloom.llm import alignment, queries

MODELS = alignment.load("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "a", " lead", "trail ", "two  spaces   three", "It's 12,345.67 o'clock\n\n\tnew line\r\n x", "naïve Ünïcode 漢字かな 😀 end", "mark ▁ inside", "a▁b", "no break  em\x1cfs \x85next",
    "<s> </s> <unk> <|endoftext|> <0x41>", "zero\x00byte", "x" * 3000, "word " * 400, "The quick brown fox", "The quick brown fox", "é" * 50 + " éa",
]


WHOLE = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
WHOLE.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")


def reference(texts):
    """The contract by whole-text encoding and loops over bytes."""
    rows, total = [], Counter()
    for t in texts:
        a, b = (WHOLE.encode(" " + t, add_special_tokens=False).ids, PIECES.encode(t)) if t else ([], [])
        spelled = [[MODELS.bytes_a[i] for i in a], [MODELS.bytes_b[i] for i in b]]
        if t and any(b"".join(s) != (" " + t).encode() for s in spelled):
            a = b = []
        owner = [[k for k, s in enumerate(side) for _ in s] for side in spelled] if a else [[], []]
        linked = Counter(zip(*owner))
        ends = [{sum(map(len, side[: k + 1])) for k in range(len(side))} for side in spelled] if a and len(t) < 5000 else [set(), set()]
        cuts, listed, lo = sorted(ends[0] & ends[1]), [], 0
        for cut in cuts:
            listed.append("|".join(",".join(str(i[k]) for k in dict.fromkeys(o[lo:cut])) for i, o in zip((a, b), owner)))
            lo = cut
        shared = sum(len(g.split("|")[0].split(",")) * len(g.split("|")[1].split(",")) for g in listed)
        rows.append((a, b, linked, listed, shared))
        total.update((a[i], b[j]) for i, j in linked)
    top = Counter()
    for (_, j), n in total.items():
        top[j] = max(top[j], n)
    out = []
    for a, b, linked, listed, shared in rows:
        of = [total[a[i], b[j]] for i, j in linked]
        best = sum(total[a[i], b[j]] == top[b[j]] for i, j in linked)
        out.append((len(a), len(b), len(listed), len(linked), shared, best, sum(of), hashlib.sha256(";".join(listed).encode()).hexdigest() if a else ""))
    return out, rows


@pytest.mark.parametrize("head", [alignment.HEAD, 40, 1])
def test_align(spark, head, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 64)
    rows = [(i, t, 1, "z") for i, t in enumerate(TEXTS)] + [(None, "The quick brown fox", 1, "z"), (3, "The quick brown fox", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, codes string").repartition(3)
    got = alignment.align(docs, MODELS, head=head)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups_sha256"]
    want, _ = reference([r[1] for r in rows])
    assert Counter(map(tuple, got.collect())) == Counter((r[0], *w) for r, w in zip(rows, want))
    assert alignment.align(docs.where("false"), MODELS, head=head).count() == 0


def test_links(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    _, rows = reference(TEXTS)
    got = {(r.doc_id, r.a_index, r.b_index): r.weight for r in alignment.links(docs, MODELS).collect()}
    assert got == {(d, *ij): n for d, r in enumerate(rows) for ij, n in r[2].items()}
    found = Counter((r.doc_id, r.a_id, r.b_id) for r in alignment.links(docs, MODELS, shared=True).collect())
    assert found == Counter((d, int(x), int(y)) for d, r in enumerate(rows) for g in r[3] for x in g.split("|")[0].split(",") for y in g.split("|")[1].split(","))


def test_products_against_dense_matrices():
    rng = np.random.default_rng(5)
    for _ in range(30):
        dense = [(rng.random(s) < 0.3) * rng.integers(1, 5, s) for s in ((7, 11), (11, 6))]
        left, right = (alignment.Csr(np.concatenate(([0], np.cumsum((d > 0).sum(axis=1)))), np.nonzero(d)[1], d[np.nonzero(d)], d.shape[1]) for d in dense)
        out = np.zeros((7, 6), dtype=np.int64)
        for row, column, value in alignment.product(left, right, block=5):
            out[row, column] += value
        assert (out == dense[0] @ dense[1]).all()
        turned = left.transposed()
        again = np.zeros((11, 7), dtype=np.int64)
        again[np.repeat(np.arange(11), np.diff(turned.indptr)), turned.indices] = turned.data
        assert (again == dense[0].T).all()


def test_query_on_random_texts(spark, tmp_path):
    rng = random.Random(3)
    parts = ["the", "of", "naïve", "über", "12", "x9", "!!", "\n", "  ", "😀", "don't", "ß", "GmbH.", "token", "ization"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "", " ", "  "]) for _ in range(rng.randrange(60))) for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, _ = reference(texts)
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op13_incidence_products"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want))


def test_split_is_the_cut():
    rng = random.Random(5)
    texts = ["", " ", "\n", "a ", " a", "a b", "a\n b", "a \nb", "a  b", "a　 b", "é  b", "a \x1cb", "a\tb c"]
    texts += ["".join(rng.choice("ab \n\té　x\x1cy ") for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert [alignment._split(t) for t in texts] == [alignment._CUT.split(t) for t in texts]
