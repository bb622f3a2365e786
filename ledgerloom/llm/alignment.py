"""Cross-tokenizer alignment: token-byte incidence matrices in CSR form and their products.

With A the tokens x bytes incidence of one tokenizer and B that of another, A Bt holds how many bytes two tokens share, so its non-zeros are the overlap links. With G and H their tokens x groups
incidences (groups end where tokens of both end), G Ht holds the pairs within a group. Products go row by row (Gustavson): the rows of the right matrix that a row of the left one names are merged.

Both tokenizers begin a new token at a single space between two other characters, and neither looks across it. A text is therefore block-diagonal in its chunks between such spaces: each distinct
chunk is encoded and multiplied once a task, and a text is the sum of its chunks.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import durable

#: Pairs whose counts every task holds; the counts of all others are joined.
HEAD = 1 << 18
#: Chunks that a task keeps; beyond it the table starts anew between two texts.
KEPT = 400_000
#: Characters split, and products expanded, at a time.
SLICE = 1 << 20
_CUT = re.compile(r" (?<=\S )(?=\S)")
# White space but for space and line feed, in texts of ASCII and in all others
_ASCII_BLANKS, _BLANKS = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f", re.compile(r"[^\S \n]")
_LOW = 20
# Fixed value: how the byte-level tokenizer cuts a text before merging
_PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks encoded in one call.
_TOGETHER = 4096
_SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "bad", "tail")


@dataclass
class Csr:
    """Rows of (column, value), columns ascending within a row."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        row = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        ends = np.concatenate(([0], np.cumsum(np.bincount(self.indices, minlength=self.columns))))
        return Csr(ends, row[order], self.data[order], len(self.indptr) - 1)


def spans(lengths: np.ndarray) -> Csr:
    """Token x byte incidence of tokens that follow each other."""
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return Csr(ends, np.arange(ends[-1]), np.ones(ends[-1], np.int32), int(ends[-1]))


def members(group: np.ndarray, groups: int) -> Csr:
    """Token x group incidence."""
    return Csr(np.arange(len(group) + 1), group, np.ones(len(group), np.int32), groups)


def widths(left: Csr, right: Csr) -> np.ndarray:
    """For each row of the product, how many terms its merge has (the symbolic half of the product)."""
    each = np.concatenate(([0], np.cumsum(np.diff(right.indptr)[left.indices])))
    return np.diff(each[left.indptr])


def product(left: Csr, right: Csr, block: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, value) of the non-zeros of ``left`` x ``right`` in row order, so many rows at a time that about ``block`` terms are merged at once."""
    done = np.concatenate(([0], np.cumsum(widths(left, right))))
    lo, rows = 0, len(left.indptr) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + block, "right")) - 1)
        named = slice(left.indptr[lo], left.indptr[hi])
        at = left.indices[named]
        size = np.diff(right.indptr)[at]
        row = np.repeat(np.repeat(np.arange(lo, hi), np.diff(left.indptr[lo : hi + 1])), size)
        place = np.repeat(right.indptr[at] - np.cumsum(size) + size, size) + np.arange(len(row))
        column, value = right.indices[place], np.repeat(left.data[named], size) * right.data[place]
        key = row * right.columns + column
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, row, column, value = key[order], row[order], column[order], value[order]
        first = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
        yield row[first], column[first], np.add.reduceat(value, first) if len(first) else value
        lo = hi


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group of each token on either side, and how many there are; a group ends where tokens of both sides end."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), len(cuts)


@dataclass(frozen=True)
class Tokenizers:
    """Both model files by value, so that tasks need no path: a byte-level BPE in JSON and a SentencePiece model that sets a space before the text."""

    a_json: str
    b_model: bytes

    def __reduce__(self) -> tuple:
        return Tokenizers, (self.a_json, self.b_model)

    @cached_property
    def encoders(self) -> tuple[Callable[[str], list[int]], Callable[[str], list[int]]]:
        """Ids of a text with a space before it, without special tokens.

        If the JSON file is a plain byte-level BPE whose ids follow the order of its merges, its vocabulary is a table of ranks, which another library encodes faster. Texts with characters from U+0590 on
        still go to the library of the file's format, as letters of late Unicode versions could be classed differently.
        """
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        a, b = Tokenizer.from_str(self.a_json), sentencepiece.SentencePieceProcessor(model_proto=self.b_model)
        a.encode_special_tokens = True
        spec = json.loads(self.a_json)
        model, before = spec["model"], spec["pre_tokenizer"]
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        first = len(model["vocab"]) - len(merged)
        plain = spec["normalizer"] is None and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not model.get("ignore_merges")
        slow = lambda text: a.encode(" " + text, add_special_tokens=False).ids
        encode_a = slow
        if plain and first == 256 and all(model["vocab"][m] == first + k for k, m in enumerate(merged)):
            ranks = tiktoken.Encoding("ranks", pat_str=_PRETOKENS, mergeable_ranks={self.bytes_a[i]: i for i in model["vocab"].values()}, special_tokens={})
            encode_a = lambda text: ranks.encode_ordinary(" " + text) if text.isascii() or np.frombuffer(text.encode("utf-32-le"), np.uint32).max() < 0x590 else slow(text)
        return encode_a, b.encode

    @cached_property
    def bytes_a(self) -> list[bytes]:
        """The byte-level alphabet writes printable Latin-1 bytes as themselves and all others, in order, as the characters from U+0100."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        code = {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(sorted(set(range(256)) - set(plain)))}
        model = json.loads(self.a_json)
        entries = model["model"]["vocab"] | {t["content"]: t["id"] for t in model["added_tokens"]}
        out = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            out[i] = bytes(code.get(c, 0) for c in entry)
        return out

    @cached_property
    def bytes_b(self) -> list[bytes]:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=self.b_model)
        spelled = lambda i: bytes([int(m.id_to_piece(i)[3:-1], 16)]) if m.is_byte(i) else b"" if m.is_control(i) or m.is_unknown(i) else m.id_to_piece(i).replace("▁", " ").encode()
        return [spelled(i) for i in range(m.vocab_size())]


def load(a_path: str, b_path: str) -> Tokenizers:
    """Read both model files on the driver."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return Tokenizers(a.read(), b.read())


def _split(text: str) -> list[str]:
    """A text cut at :data:`_CUT`. Where no other white space touches a space every space is such a cut, and plain splitting is faster."""
    rare = any(map(text.__contains__, _ASCII_BLANKS)) if text.isascii() else _BLANKS.search(text)
    if rare or "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ":
        return _CUT.split(text)
    return text.split(" ")


class _Numbers(dict):
    """Chunks by number; one that isn't known gets the next number and is listed in ``fresh``."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.fresh.append(chunk)
        return n


class Chunks:
    """The chunks a task has met: their sums, group digests and links. ``head`` are the sorted codes whose corpus counts are known, with count and best flag."""

    def __init__(self, models: Tokenizers, head: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> None:
        self.models, self.head = models, head
        self.long_a, self.long_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (models.bytes_a, models.bytes_b))
        self.listed_a, self.listed_b = ([np.array([f"{i}{end}" for i in range(len(t))], dtype=object) for end in ends] for t, ends in ((models.bytes_a, ",|"), (models.bytes_b, ",;")))
        self.clear()

    def clear(self) -> None:
        self.at = _Numbers()
        self.sums = np.zeros((1024, len(_SUMS)), dtype=np.int64)
        self.digests: list[str] = []
        self.codes: list[np.ndarray] = []
        self.tails: dict[int, np.ndarray] = {}

    def _encoded(self, fresh: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(ids of A, ids of B, tokens of each chunk in A, in B) in the order of ``fresh``; without tokens where either model doesn't give the bytes back.

        Chunks that neither begin nor end with white space are encoded many at a time, with single spaces between them, and cut apart where their bytes end.
        """
        encode_a, encode_b = self.models.encoders
        for s in range(0, len(fresh), _TOGETHER):
            part = fresh[s : s + _TOGETHER]
            joined = " ".join(part)
            ids = np.array(encode_a(joined), dtype=np.int64), np.array(encode_b(joined), dtype=np.int64)
            whole = (" " + joined).encode()
            if all(b"".join(map(of.__getitem__, i.tolist())) == whole for i, of in zip(ids, (self.models.bytes_a, self.models.bytes_b))):
                ends = np.cumsum(np.fromiter(map(len, map(str.encode, part)), dtype=np.int64, count=len(part)) + 1)
                yield *ids, *(np.diff(np.searchsorted(np.cumsum(long[i]), ends, "right"), prepend=0) for i, long in zip(ids, (self.long_a, self.long_b)))
            elif len(part) > 1:
                for w in part:
                    yield from self._encoded([w])
            else:
                yield (np.zeros(0, np.int64),) * 2 + (np.zeros(1, np.int64),) * 2

    def learn(self) -> None:
        """Encode and align the chunks that were numbered since the last call."""
        fresh, self.at.fresh = self.at.fresh, []
        if not fresh:
            return
        odd = [k for k, w in enumerate(fresh) if not w or w.strip() != w]
        alone = set(odd)
        together = [w for k, w in enumerate(fresh) if k not in alone] if odd else fresh
        found = [*self._encoded(together), *(x for k in odd for x in self._encoded([fresh[k]]))]
        a, b, n_a, n_b = (np.concatenate(x) for x in zip(*found))
        if odd:  # back into the order of their numbers
            order = np.array([*(k for k in range(len(fresh)) if k not in alone), *odd])
            a, b = (ids[np.argsort(np.repeat(order, n), kind="stable")] for ids, n in ((a, n_a), (b, n_b)))
            n_a, n_b = (n[np.argsort(order)] for n in (n_a, n_b))
        need = len(self.at)
        base = need - len(fresh)
        if need > len(self.sums):
            self.sums = np.vstack([self.sums, np.zeros((max(need, 2 * len(self.sums)) - len(self.sums), len(_SUMS)), dtype=np.int64)])
        tokens_a, tokens_b = spans(self.long_a[a]), spans(self.long_b[b])
        group_a, group_b, n = groups(tokens_a.indptr[1:], tokens_b.indptr[1:])
        chunk_a = np.repeat(np.arange(len(fresh)), n_a)
        linked = [(row, column) for row, column, _ in product(tokens_a, tokens_b.transposed())]
        row, column = (np.concatenate([f[k] for f in linked]) if linked else np.zeros(0, np.int64) for k in (0, 1))
        count = lambda of, weights=None: np.bincount(of, weights=weights, minlength=len(fresh)).astype(np.int64)
        last_a = np.flatnonzero(np.diff(group_a, append=n))
        new = self.sums[base:need]
        new[:, 0], new[:, 1], new[:, 2], new[:, 3] = n_a, n_b, count(chunk_a[last_a]), count(chunk_a[row])
        new[:, 4] = count(chunk_a, widths(members(group_a, n), members(group_b, n).transposed()))
        new[:, 7] = n_a == 0
        codes = a[row] << _LOW | b[column]
        if self.head is None:
            self.codes.append(codes)
            return
        self._digest(a, b, group_a, group_b, n_a + n_b)
        at = np.minimum(np.searchsorted(self.head[0], codes), max(len(self.head[0]) - 1, 0))
        hit = self.head[0][at] == codes if len(self.head[0]) else np.zeros(len(codes), dtype=bool)
        np.add.at(new[:, 5], chunk_a[row][hit], self.head[2][at[hit]])
        np.add.at(new[:, 6], chunk_a[row][hit], self.head[1][at[hit]])
        new[:, 8] = count(chunk_a[row[~hit]])
        if not hit.all():
            for k, rest in zip(np.flatnonzero(new[:, 8]).tolist(), np.split(codes[~hit], np.cumsum(new[new[:, 8] > 0, 8])[:-1])):
                self.tails[base + k] = rest

    def _digest(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n: np.ndarray) -> None:
        """Groups of each chunk as text: ids of one side, a bar, ids of the other, semicolons between groups."""
        ends_a, ends_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        parts = np.empty(len(a) + len(b), dtype=object)
        parts[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = np.where(ends_a, self.listed_a[1][a], self.listed_a[0][a])
        parts[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = np.where(ends_b, self.listed_b[1][b], self.listed_b[0][b])
        listed, ends = parts.tolist(), np.cumsum(n).tolist()
        self.digests += ["".join(listed[lo:hi])[:-1] for lo, hi in zip([0, *ends], ends)]

    def rows(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(chunks of these texts by number, how many each text has): for one text a slice of it at a time, for several (a slice together) all at once."""
        if len(texts) > 1:
            split = [_split(t) for t in texts]
            yield self._known([w for x in split for w in x]), np.array([len(x) for x in split])
            return
        text, lo = texts[0], 0
        while lo < len(text):
            cut = _CUT.search(text, lo + SLICE)
            split = _split(text[lo : cut.start() if cut else len(text)])
            yield self._known(split), np.array([len(split)])
            lo = cut.end() if cut else len(text)

    def _known(self, split: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.at.__getitem__, split), dtype=np.int64, count=len(split))
        self.learn()
        return found


def _short(column: pa.Array) -> Iterator[list[str]]:
    """Texts in order, as many at a time as hold about one slice; null counts as empty."""
    out, size = [], 0
    for i in range(len(column)):
        text = column[i].as_py() or ""
        if out and size + len(text) > SLICE:
            yield out
            out, size = [], 0
        out.append(text)
        size += len(text)
    if out:
        yield out


def pair_counts(docs: DataFrame, models: Tokenizers, text_col: str = "text") -> DataFrame:
    """(code, n): how many links of all texts hold each pair of ids; the code has A's id in front of B's 20 bits. Each task adds up its own links first."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(sent.value)
        times = np.zeros(0, dtype=np.int64)

        def flushed() -> Iterator[pa.RecordBatch]:
            if chunks.codes:
                met = len(chunks.at)
                codes, at = np.unique(np.concatenate(chunks.codes), return_inverse=True)
                total = np.bincount(at, weights=np.repeat(times[:met], chunks.sums[:met, 3]), minlength=len(codes)).astype(np.int64)
                held = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(codes[held]), pa.array(total[held])], names=["code", "n"])

        for b in batches:
            for texts in _short(b.column(0)):
                if len(chunks.at) > KEPT:
                    yield from flushed()
                    times = np.zeros(0, dtype=np.int64)
                    chunks.clear()
                found = list(chunks.rows(texts))
                if len(chunks.at) > len(times):
                    times = np.concatenate((times, np.zeros(max(len(chunks.at), 2 * len(times)) - len(times), dtype=np.int64)))
                for rows, sizes in [(np.concatenate([r for r, _ in found]), np.array([sum(len(r) for r, _ in found)]))] if len(found) > 1 else found:
                    text = np.repeat(np.arange(len(sizes)), sizes)
                    gone = np.bincount(text, weights=chunks.sums[rows, 7], minlength=len(sizes)) > 0
                    times += np.bincount(rows[~gone[text]], minlength=len(times))
        yield from flushed()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, models: Tokenizers, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups_sha256) for every row of ``docs``, whole texts.

    n_links counts overlap links, n_shared pairs within a group, n_best links whose pair is as frequent in the corpus as any pair of its B id, count_sum the corpus counts of all links. Texts that are null,
    empty or not given back byte by byte by either tokenizer have no tokens and an empty digest; repeated rows each get a row; other columns play no part; an empty table gives none.
    Corpus counts: the ``head`` most frequent pairs (a fixed bound) are held by every task, counts of all others meet the texts by a join on the pair, where no pair is frequent any more.
    Memory follows a slice of text, the chunks kept and the longest chunk without a single space in it.
    """
    spark = docs.sparkSession
    pairs = durable(pair_counts(docs, models, text_col)).withColumn("b", F.col("code").bitwiseAND((1 << _LOW) - 1))
    # one row per id of the vocabulary, whatever the corpus
    flagged = pairs.join(F.broadcast(pairs.groupBy("b").agg(F.max("n").alias("top"))), "b").select("code", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
    order = [F.desc("n"), F.asc("code")]
    top = flagged.orderBy(*order).limit(head).toPandas()
    known = tuple(top.sort_values("code")[c].to_numpy(np.int64) for c in ("code", "n", "best"))
    sent, held = spark.sparkContext.broadcast(models), spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(sent.value, held.value)
        for b in batches:
            at = 0
            for texts in _short(b.column(1)):
                if len(chunks.at) > KEPT:
                    chunks.clear()
                table, shas = np.zeros((len(texts), len(_SUMS)), dtype=np.int64), [hashlib.sha256() for _ in texts]
                tails = [[np.zeros(0, np.int64)] for _ in texts]
                for k, (rows, sizes) in enumerate(chunks.rows(texts)):
                    ends = np.cumsum(sizes)
                    before = np.vstack([np.zeros((1, len(_SUMS)), np.int64), np.cumsum(chunks.sums[rows], axis=0)])
                    table += before[ends] - before[ends - sizes]
                    names = [chunks.digests[r] for r in rows.tolist()]
                    for t, (lo, hi) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
                        shas[t].update((";" if k else "").encode() + ";".join(names[lo:hi]).encode())
                    for t, r in zip(np.repeat(np.arange(len(texts)), sizes)[(rest := chunks.sums[rows, 8] > 0)].tolist(), rows[rest].tolist()):
                        tails[t].append(chunks.tails[r])
                gone = [not t or bad > 0 for t, bad in zip(texts, table[:, 7].tolist())]
                table[gone] = 0
                digests = ["" if g else x.hexdigest() for g, x in zip(gone, shas)]
                tails = [np.unique(np.concatenate(x[:1] if g else x), return_counts=True) for g, x in zip(gone, tails)]
                ends = pa.array(np.cumsum([0, *(len(c) for c, _ in tails)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[k] for x in tails]))) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), *[pa.array(table[:, k]) for k in range(7)], pa.array(digests), *lists], names=["doc_id", *_SUMS[:7], "groups_sha256", "codes", "times"])
                at += len(texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *_SUMS[:7])) + ", groups_sha256 string, codes array<long>, times array<long>")
    if len(top) < head:
        return found.drop("codes", "times")
    found = durable(found.withColumn("place", F.monotonically_increasing_id()))
    n, code = (int(top[c].iloc[-1]) for c in ("n", "code"))
    rest = flagged.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("code") > code)))
    links = found.where(F.size("codes") > 0).select("place", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("place", F.col("x.codes").alias("code"), F.col("x.times").alias("times"))
    more = links.join(rest, "code").groupBy("place").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    added = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
    return found.join(more, "place", "left").withColumns(added).select("doc_id", *_SUMS[:7], "groups_sha256")


def links(docs: DataFrame, models: Tokenizers, shared: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a_index, b_index, a_id, b_id, weight): every overlap link of every text with the bytes it shares, or with ``shared`` every pair of tokens within a group (weight 1).

    Indexes count tokens from 0. Texts without tokens have no links. Chunk by chunk, so that memory follows the longest chunk.
    """
    sent = docs.sparkSession.sparkContext.broadcast(models)
    names = ["doc_id", "a_index", "b_index", "a_id", "b_id", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(sent.value)
        encode_a, encode_b = chunks.models.encoders
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                split = _CUT.split(text) if text else []
                if not split or any(chunks.sums[rows, 7].any() for rows, _ in chunks.rows([text])):
                    continue
                at_a = at_b = 0
                for s in range(0, len(split), 4096):
                    part = split[s : s + 4096]
                    a, b = (np.array([i for x in part for i in encode(x)], dtype=np.int64) for encode in (encode_a, encode_b))
                    left, right = spans(chunks.long_a[a]), spans(chunks.long_b[b])
                    if shared:
                        group_a, group_b, n = groups(left.indptr[1:], right.indptr[1:])
                        left, right = members(group_a, n), members(group_b, n)
                    for row, column, value in product(left, right.transposed()):
                        where = [pa.array([doc_id] * len(row), pa.int64()), pa.array(row + at_a), pa.array(column + at_b), pa.array(a[row]), pa.array(b[column]), pa.array(value.astype(np.int64))]
                        yield pa.RecordBatch.from_arrays(where, names=names)
                    at_a, at_b = at_a + len(a), at_b + len(b)
                if len(chunks.at) > KEPT:
                    chunks.clear()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))
