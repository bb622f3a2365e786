"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.grams import KEY, keyed
from ledgerloom.llm.shared import durable
from ledgerloom.llm.textkit import LETTERS, Words, byte_class, hash_words, mix, power, signed, word_hashes, words

WINDOW = 8
#: A table of at most this many benchmark windows is broadcast; a larger one is joined by shuffle.
BROADCAST_WINDOWS = 500_000

# Number words and units of measure that become placeholders.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles g kg gram grams kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees kph mph".split()

DIGIT = byte_class((0x30, 0x39))
CAPITAL = byte_class((0x41, 0x5A))
STOP = byte_class((0x21, 0x21), (0x2E, 0x2E), (0x3A, 0x3A), (0x3F, 0x3F), (0x0A, 0x0A))
NONE, NUMBER, NAME, UNIT = range(4)
FULL, CASELESS, PLAIN = VIEWS = range(3)


def slots(w: Words, hashes: np.ndarray) -> np.ndarray:
    """The type of each word: NUMBER (begins with a digit, or a number word), UNIT, NAME (a capital that opens no sentence), else NONE."""
    kind = np.full(len(hashes), NONE, dtype=np.int8)
    before = np.zeros(len(hashes), dtype=bool)  # a sentence ends between the word before and this one
    if len(hashes):
        stops = np.concatenate(([0], np.cumsum(STOP[w.raw])))
        before[1:] = stops[w.start[1:]] > stops[w.end[:-1]]
        before[1:] |= w.row[1:] != w.row[:-1]
        before[0] = True
    kind[CAPITAL[w.raw[w.start]] & ~before] = NAME
    kind[np.isin(hashes, hash_words(UNITS))] = UNIT
    kind[DIGIT[w.buffer[w.start]] | np.isin(hashes, hash_words(NUMBER_WORDS))] = NUMBER
    return kind


def _runs(codes: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Hashes of the runs from word ``at`` to before word ``end``, of any length, from one running sum."""
    up, down = power(len(codes) + 1)
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    return lambda at, end: mix((total[end] - total[at]) * down[at] + (end - at).astype(np.uint64))


def _stretches(plain: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the windows: from each word on, and back from each word, the shortest of ``window`` words at least of which half a window's are no placeholders.

    Both stay within their text. Where every ``window`` words hold few placeholders the two are the same."""
    n, need = len(plain), window - window // 2
    at = np.flatnonzero(plain)
    before = np.concatenate(([0], np.cumsum(plain)))  # plain words before each place
    i = np.arange(n)
    last = before[:-1] + need - 1  # the plain word that completes the window from i on
    ok = last < len(at)
    first, end = i[ok], np.maximum(at[last[ok]] + 1, i[ok] + window)
    ok = end <= n
    first, end = first[ok], end[ok]
    ok = row[first] == row[end - 1]
    first, end = first[ok], end[ok]
    nth = before[1:] - need  # the plain word that completes the window back from i
    ok = nth >= 0
    e = i[ok] + 1
    f = np.minimum(at[nth[ok]], e - window)
    ok = f >= 0
    f, e = f[ok], e[ok]
    ok = (row[f] == row[e - 1]) & (e - f > window)
    return np.concatenate((first, f[ok])), np.concatenate((end, e[ok]))


def _windows(w: Words, window: int, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(view, first, end, hash) of all windows of a slice.

    FULL puts placeholders for numbers, units and names, CASELESS for numbers and units only, PLAIN for none. Windows are those of _stretches, in PLAIN all runs of
    ``window`` words; and of each of the shorter ``lengths`` all runs of so many words, in FULL and CASELESS only those of at most half placeholders.
    """
    h = word_hashes(w)
    kind = slots(w, h)
    marks = hash_words(["<number>", "<name>", "<unit>"])
    told = np.concatenate((marks[:1], marks))[kind]
    for view, slot in ((FULL, kind != NONE), (CASELESS, (kind != NONE) & (kind != NAME)), (PLAIN, np.zeros(len(h), dtype=bool))):
        hashed = _runs(np.where(slot, told, h))
        spans = [_stretches(~slot, w.row, window)]
        held = np.concatenate(([0], np.cumsum(slot)))
        for k in lengths:
            i = np.arange(max(0, len(h) - k + 1))
            i = i[(w.row[i] == w.row[i + k - 1]) & ((held[i + k] - held[i]) * 2 <= k)]
            spans.append((i, i + k))
        first, end = (np.concatenate(x) for x in zip(*spans))
        yield view, first, end, hashed(first, end)


def doc_windows(docs: DataFrame, window: int, lengths: list[int]) -> DataFrame:
    """``docs`` (doc_id, tk, text) to (doc_id, tk, pos, gram): the windows of all views, equal ones once for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words(b.column(2), LETTERS):
                n = len(w.start)
                seen = {}  # by length, the hash last given for each place
                parts = []
                for _, first, end, gram in _windows(w, window, lengths):
                    length = end - first
                    new = np.ones(len(first), dtype=bool)
                    for k in [window, *lengths]:
                        at = np.flatnonzero(length == k)
                        known = seen.setdefault(k, np.zeros(n, dtype=np.uint64))
                        new[at] = known[first[at]] != gram[at]
                        known[first[at]] = gram[at]
                    parts.append((first[new], gram[new]))
                first, gram = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(first, kind="stable")
                first, gram = first[order], gram[order]
                ends = np.concatenate(([0], np.cumsum(np.bincount(w.row[first], minlength=w.rows)))).astype(np.int32)
                found = pa.StructArray.from_arrays([pa.array(w.place()[first].astype(np.int32)), pa.array(signed(gram))], names=["pos", "gram"])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(w.first, w.rows), b.column(1).slice(w.first, w.rows), pa.ListArray.from_arrays(pa.array(ends), found)], names=["doc_id", "tk", "found"])

    return docs.mapInArrow(run, f"{KEY}, found array<struct<pos: int, gram: long>>").select("doc_id", "tk", F.inline("found"))


def item_windows(items: DataFrame, window: int, lengths: list[int]) -> DataFrame:
    """(item_id, ik, ipos, k, gram, view): an item's windows in each view; an item of fewer than ``window`` words has the one of its own length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words(b.column(2), LETTERS):
                count, place = w.count(), w.place()
                for view, first, end, gram in _windows(w, window, lengths):
                    k = end - first
                    ok = (k >= window) | (k == count[w.row[first]])
                    first, k, gram = first[ok], k[ok], gram[ok]
                    row = pa.array(w.row[first] + w.first)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(place[first].astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(signed(gram)), pa.array(np.full(len(first), view, dtype=np.int32))], names=["item_id", "ik", "ipos", "k", "gram", "view"])

    return items.mapInArrow(run, "item_id long, ik long, ipos int, k int, gram long, view int").distinct()


def slot_rows(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, tk, text) to (doc_id, tk, pos, kind, value): the words that a placeholder stands for, value as hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words(b.column(2), LETTERS):
                h = word_hashes(w)
                kind, place = slots(w, h), w.place()
                at = np.flatnonzero(kind != NONE)
                row = pa.array(w.row[at] + w.first)
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(place[at].astype(np.int32)), pa.array(kind[at].astype(np.int32)), pa.array(signed(h[at]))], names=["doc_id", "tk", "pos", "kind", "value"])

    return docs.mapInArrow(run, f"{KEY}, pos int, kind int, value long")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, least: float = 0.5) -> DataFrame:
    """(doc_id, item_id, start, end, share, slots, changed): documents that hold a benchmark item, worded anew or not.

    Numbers, names and units become typed placeholders in both tables; windows of ``window`` canonical words are joined by hash. A window of which more than half
    are placeholders goes on, or back, until it holds half a window of other words. The same is done with names as plain lower-cased words, as capitals tell
    names only in ordinary writing, and with plain words throughout, which keeps a key for items of numbers only. Items of fewer words are
    one window of their own length (three words at least; shorter ones cannot be told from chance). Along one alignment (text place minus item place) the slots must
    be consistent: equal values of the item stand for equal values in the text. A pair leaks when the consistent windows hold ``least`` of the item's windows of one
    kind, or begin at ``least`` of all places of the item where one can begin, whatever their kind. changed counts slots whose value
    differs, so 0 is a plain copy. Each document and item meet in one row, that of the best alignment.

    Null and empty texts, and items, hold no windows; repeated rows add nothing; an empty table on either side gives no rows. Documents without id are passed over.
    """
    rows = keyed(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    items = keyed(benchmark.where(F.col(item_col).isNotNull()), item_col, text_col)
    item_slots = durable(slot_rows(items).select(F.col("doc_id").alias("item_id"), F.col("tk").alias("ik"), F.col("pos").alias("ipos"), "kind", F.col("value").alias("told")).distinct())
    n_words = durable(items.select("doc_id", "tk", "text").mapInArrow(_lengths, f"{KEY}, n int").distinct())
    short = sorted(r.n for r in n_words.where((F.col("n") >= 3) & (F.col("n") < window)).select("n").distinct().collect())  # fewer than ``window`` numbers
    views = F.collect_set("view")
    asked = durable(item_windows(items, window, short).groupBy("item_id", "ik", "ipos", "k", "gram").agg(views.alias("views")))
    of_view = asked.groupBy("item_id", "ik").agg(*[F.count_if(F.array_contains("views", v)).alias(f"of_{v}") for v in VIEWS])
    if asked.count() <= BROADCAST_WINDOWS:
        asked = F.broadcast(asked)
    hits = doc_windows(rows, window, short).join(asked, "gram").select("doc_id", "tk", "pos", "item_id", "ik", "ipos", "k", "views")
    hits = durable(hits.distinct().withColumn("shift", F.col("pos") - F.col("ipos")))
    pair = ["doc_id", "tk", "item_id", "ik", "shift"]
    by_place = hits.groupBy(*pair, "pos").agg(F.max("k").alias("k"), *[F.count_if(F.array_contains("views", v)).alias(f"in_{v}") for v in VIEWS])
    windows = by_place.groupBy(*pair).agg(F.count("*").alias("places"), *[F.sum(f"in_{v}").alias(f"in_{v}") for v in VIEWS], F.min("pos").alias("start"), F.max(F.col("pos") + F.col("k")).alias("end"))

    # Values side by side: every item slot inside the matched stretch, with the document's word in its place.
    aligned = windows.select(*pair, "start", "end").join(item_slots, ["item_id", "ik"]).withColumn("pos", F.col("ipos") + F.col("shift")).where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")))
    met = rows.join(hits.select(F.col("doc_id").alias("_d"), F.col("tk").alias("_t")).distinct(), (F.col("doc_id") == F.col("_d")) & (F.col("tk") == F.col("_t")), "left_semi")
    values = slot_rows(met).distinct()
    side = aligned.join(values.withColumnRenamed("kind", "got"), ["doc_id", "tk", "pos"])
    by_value = side.groupBy(*pair, "told").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    consistent = by_value.groupBy(*pair).agg(F.sum("n").alias("slots"), F.sum(F.when(F.col("lo") != F.col("told"), F.col("n")).otherwise(0)).alias("changed"), F.max((F.col("lo") != F.col("hi")).cast("int")).alias("torn"))
    size = n_words.select(F.col("doc_id").alias("item_id"), F.col("tk").alias("ik"), F.greatest(F.lit(1), F.col("n") - window + 1).alias("of"))
    judged = windows.join(consistent, pair, "left").where(F.coalesce("torn", F.lit(0)) == 0).join(size, ["item_id", "ik"]).join(of_view, ["item_id", "ik"])
    shares = [F.col("places") / F.col("of"), *[F.when(F.col(f"of_{v}") > 0, F.col(f"in_{v}") / F.col(f"of_{v}")) for v in VIEWS]]
    judged = judged.withColumn("share", F.greatest(*shares)).where(F.col("share") >= least)
    best = F.max(F.struct("share", -F.col("start"), F.struct("start", "end", F.coalesce("slots", F.lit(0)).alias("slots"), F.coalesce("changed", F.lit(0)).alias("changed")).alias("x")))
    one = judged.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return one.select("doc_id", "item_id", "b.x.start", "b.x.end", "b.share", "b.x.slots", "b.x.changed")


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for w in words(b.column(2), LETTERS):
            yield pa.RecordBatch.from_arrays([b.column(0).slice(w.first, w.rows), b.column(1).slice(w.first, w.rows), pa.array(w.count().astype(np.int32))], names=["doc_id", "tk", "n"])
