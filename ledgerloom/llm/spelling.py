"""Spelling variants by a trie-node pair dictionary.

Every prefix of a word is a node of the forward trie, every suffix a node of the trie of reversed words, and nodes are whole numbers. A word is cut at each position into the pair
(prefix node, suffix node), once with the position's code point left out and once with nothing left out. Two words differ by one replacement exactly if they share a pair of the first kind, and by
one deletion exactly if a pair of the first kind of the longer equals a pair of the second kind of the shorter. The members of a pair differ in one code point, so the alphabet bounds their
number; each learns their count and its best partner from a window over the pair, and no list of pairs of words is made.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ledgerloom.llm import textkit
from ledgerloom.llm.shared import durable

#: One occurrence in so many loses a code point.
ONE_IN = 97
#: Distinct words a task adds up before it passes them on.
KEPT = 100_000
#: Node numbers of one partition; the partition's number stands above them.
_NODES = 40
#: Words of up to so many bytes are hashed side by side, longer ones alone.
_BYTES = 64

_ASCII = textkit.byte_class((0x61, 0x7A))


def _crc_steps() -> np.ndarray:
    """CRC-32 of each byte value, from its polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_STEP = _crc_steps()


def _crc(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each word ``data[start:end]`` after what ``before`` is the CRC-32 of."""
    state = before ^ np.uint32(0xFFFFFFFF)
    size = end - start
    order = np.argsort(-size, kind="stable")
    lengths = -size[order]
    for k in range(min(int(size.max(initial=0)), _BYTES)):
        todo = order[: np.searchsorted(lengths, -k)]
        state[todo] = _STEP[(state[todo] ^ data[start[todo] + k]) & 0xFF] ^ (state[todo] >> np.uint32(8))
    for i in np.flatnonzero(size > _BYTES).tolist():
        state[i] = zlib.crc32(data[start[i] + _BYTES : end[i]], int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return state ^ np.uint32(0xFFFFFFFF)


def _words(ids: list[int | None], column: pa.Array, least: int) -> Iterator[pa.Array]:
    """The words of each slice after the deletions, those of at least ``least`` code points."""
    for first, rows, raw, at in textkit.slices(column):
        low = textkit.LOWER[raw]
        lead = low == 0xC3  # U+00C0 to U+00FF are this byte and any one after it
        tail = np.zeros(len(low), dtype=bool)
        tail[1:] = lead[:-1]
        w = textkit.runs(first, rows, low, raw, at, _ASCII[low] | lead | tail)
        points = np.concatenate(([0], np.cumsum(~tail, dtype=np.int64)))
        length = points[w.end] - points[w.start]
        heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[first : first + rows]], dtype=np.uint32)
        hit = _crc(low, w.start, w.end, heads[w.row]) % np.uint32(ONE_IN) == 0
        whole = np.flatnonzero(~hit & (length >= least))
        size = w.end[whole] - w.start[whole]
        ends = np.concatenate(([0], np.cumsum(size)))
        place = np.repeat(w.start[whole] - ends[:-1], size) + np.arange(ends[-1])
        yield pa.Array.from_buffers(pa.string(), len(whole), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(low[place])])
        cut = []
        for i in np.flatnonzero(hit & (length > least)).tolist():
            spelled = low[w.start[i] : w.end[i]].tobytes()
            word = spelled.decode()
            k = zlib.crc32(spelled, int(heads[w.row[i]])) % len(word)
            cut.append(word[:k] + word[k + 1 :])
        yield pa.array(cut, pa.string())


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): the distinct words of whole texts with their occurrences, each task adding up its own first.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. Where the CRC-32 of "id:word" is a multiple of 97, that occurrence has lost the code point which the CRC modulo the length
    names. A null text has no words; a null id is written as nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def added() -> pa.Table:
            return pa.concat_tables(kept).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        for b in batches:
            for found in _words(b.column(0).to_pylist(), b.column(1), least_length):
                values = found.value_counts()
                kept.append(pa.table([values.field(0), values.field(1)], names=["word", "n"]))
                size += len(values)
                if size > 2 * KEPT:
                    kept = [added()]
                    size = len(kept[0])
                    if size > KEPT:
                        yield from kept[0].to_batches()
                        kept, size = [], 0
        if kept:
            yield from added().to_batches()

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    found = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where((F.col("n") >= least_count) & (F.length("word") >= least_length))


class Trie:
    """Node numbers along words that come in order: a word keeps the nodes of the prefix it shares with the word before, the rest are new."""

    def __init__(self, word: str, path: list[int], fresh: int) -> None:
        self.word, self.path, self.fresh = word, path, fresh

    def step(self, word: str) -> list[int]:
        shared = _shared(self.word, word)
        del self.path[shared + 1 :]
        self.path += range(self.fresh, self.fresh + len(word) - shared)
        self.fresh += len(word) - shared
        self.word = word
        return self.path


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def trie_paths(words: DataFrame, word: str, path: str, partitions: int | None = None) -> DataFrame:
    """``words`` (distinct in column ``word``) with ``path``: the numbers of the trie nodes from the root (0) to the whole word.

    Words lie in order over range partitions, so a prefix's words stand together. Each partition numbers its nodes by itself; then only its last word and that word's nodes go to the driver (two words and
    one list a partition), which tells the next partitions what they share with it. Numbers are ascending along the order, so a word's own node orders words by code point.
    """
    ranged = words.repartitionByRange(partitions, word) if partitions else words.repartitionByRange(word)
    ranged = durable(ranged.sortWithinPartitions(word))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first, trie = None, Trie("", [0], (part << _NODES) + 1)
        for b in batches:
            for w in b.column(0).to_pylist():
                trie.step(w)
                first = w if first is None else first
        if first is not None:
            yield pa.RecordBatch.from_pydict({"part": [part], "first": [first], "last": [trie.word], "path": [trie.path]})

    at_end = sorted(ranged.select(word).mapInArrow(ends, "part long, first string, last string, path array<long>").collect())
    given: dict[int, tuple[str, list[int]]] = {}
    last, nodes = "", [0]
    for p in at_end:
        shared = _shared(last, p.first)
        given[p.part] = p.first[:shared], nodes[: shared + 1]
        keeps = min(shared, _shared(p.first, p.last))
        last, nodes = p.last, nodes[: keeps + 1] + list(p.path[keeps + 1 :])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        prefix, known = given.get(part, ("", [0]))
        trie = Trie(prefix, list(known), (part << _NODES) + 1 + len(prefix))
        for b in batches:
            flat, size = [], [0]
            for w in b.column(at).to_pylist():
                flat += trie.step(w)
                size.append(len(flat))
            lists = pa.LargeListArray.from_arrays(pa.array(size, pa.int64()), pa.array(flat, pa.int64())).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, path])

    at = ranged.columns.index(word)
    schema = StructType([*ranged.schema.fields, StructField(path, ArrayType(LongType()))])
    return ranged.mapInArrow(run, schema)


def near_words(counts: DataFrame, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``counts`` (word, n; distinct words) to the words (id, word, n) and to (id, n, n_near, best): how many words differ by one inserted, deleted or replaced code point, and the most frequent
    of them as (minus its n, its id), the first in code-point order among equals. Words without any are not in the second table."""
    forward = trie_paths(counts.select("word", "n"), "word", "ahead", partitions)
    both = durable(trie_paths(forward.withColumn("turned", F.reverse("word")), "turned", "back", partitions).withColumn("id", F.element_at("ahead", -1)))
    cuts = both.withColumn("size", F.size("ahead") - 1).select(
        "id", "n",
        F.explode(F.expr("""concat(
            transform(sequence(0, size), i -> struct(ahead[i] as p, back[size - i] as s, 0 as kind)),
            transform(sequence(0, size - 1), i -> struct(ahead[i] as p, back[size - i - 1] as s, if(i > 0 and substr(word, i + 1, 1) = substr(word, i, 1), 2, 1) as kind)))""")).alias("cut"),
    )
    # kind 0: nothing left out, at most one word a pair; 1 and 2: one code point left out, 2 where the one before it is the same (another way to the same shorter word)
    cuts = cuts.select("id", "n", "cut.*", F.struct((-F.col("n")).alias("less"), "id").alias("me"))
    pair = Window.partitionBy("p", "s").orderBy(F.col("kind") == 0, "me").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    number = lambda test: F.count_if(test).over(pair)
    kind = F.col("kind")
    told = cuts.withColumns({
        "n_cut": number(kind > 0), "n_once": number(kind == 1), "n_whole": number(kind == 0), "first": F.first("me").over(pair), "second": F.nth_value("me", 2).over(pair),
        "whole": F.max(F.when(kind == 0, F.col("me"))).over(pair), "once": F.min(F.when(kind == 1, F.col("me"))).over(pair),
    }).where("n_cut + n_whole > 1")
    other = F.when(F.col("first.id") != F.col("id"), F.col("first")).when(F.col("n_cut") > 1, F.col("second"))
    n_near = F.when(kind == 0, F.col("n_once")).otherwise(F.col("n_cut") - 1 + F.when(kind == 1, F.col("n_whole")).otherwise(0))
    best = F.when(kind == 0, F.col("once")).when(kind == 1, F.least(other, "whole")).otherwise(other)
    told = told.select("id", "n", n_near.alias("n_near"), best.alias("best")).where("n_near > 0")
    return both.select("id", "word", "n"), told.groupBy("id").agg(F.min("n").alias("n"), F.sum("n_near").cast("long").alias("n_near"), F.min("best").alias("best"))


def variants(counts: DataFrame, factor: int = 2, partitions: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``counts`` (word, n): its most frequent near word if that is ``factor`` times as frequent or more, and the end of the chain of forms.

    Counts double at least along a chain, so with 64-bit counts it has under 64 words; roots are found by letting each word follow its form's own, which doubles what a round covers. An empty table gives none.
    """
    if factor < 2:
        raise ValueError("factor below 2: chains of forms need not end")
    words, near = near_words(counts, partitions)
    near = durable(near.withColumn("form", F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best.id"))).withColumn("form_n", F.when(F.col("form").isNotNull(), -F.col("best.less"))))
    up = durable(near.where("form is not null").select("id", F.col("form").alias("root")))
    for _ in range(6):
        ahead = up.select(F.col("id").alias("root"), F.col("root").alias("after"))
        if up.join(ahead, "root", "left_semi").isEmpty():
            break
        up = durable(up.join(ahead, "root", "left").select("id", F.coalesce("after", "root").alias("root")))
    named = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    found = near.drop("n", "best").join(up, "id", "left").join(named("form"), "form", "left").join(named("root"), "root", "left")
    out = words.join(found.drop("form", "root"), "id", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
