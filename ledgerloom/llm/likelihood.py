"""Quality rules: counted base rules, and a hashed n-gram log-likelihood ratio between trusted texts and the whole corpus."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textkit
from ledgerloom.llm.shared import held_out

#: Buckets of hashed n-grams.
BUCKETS = 1 << 16
#: Scores are rounded to this many parts of a nat, so that the threshold is found among whole numbers.
PARTS = 1000
#: Scores beyond this many nats a token count as this many when the threshold is sought.
FARTHEST = 12
#: A text with fewer words fails.
FEWEST_WORDS = 50
#: A text with a larger percentage of its words in repeated windows fails.
MOST_REPEATED = 50

#: Bits that tell texts which may have a label, 8 MB.
FILTER_BITS = 1 << 26

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NOT_BREAK = ~textkit.byte_class((0x0A, 0x0A))
#: Kinds of bytes in a token: blank, letters and digits, other marks.
_KIND = np.where(textkit.NOT_BLANK, np.where(textkit.LETTERS, 1, 2), 0).astype(np.uint8)

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Model:
    """Log ratio of each bucket and the least score, in parts, that is kept."""

    ratio: np.ndarray
    least: int


def _tokens(column: pa.Array) -> Iterator[textkit.Words]:
    """Runs of letters and digits and runs of other marks, A-Z lower-cased."""
    for first, rows, raw, at in textkit.slices(column):
        low = textkit.LOWER[raw]
        yield textkit.runs(first, rows, low, raw, at, _KIND[low])


def _grams(w: textkit.Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each token and of each pair of neighbouring tokens."""
    h = textkit.word_hashes(w)
    at, pairs = textkit.grams(h, w.row, 2)
    return np.concatenate((w.row, w.row[at])), np.concatenate((h, pairs)) % np.uint64(buckets)


def _per_row(marked: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bytes of each row are marked."""
    before = np.concatenate(([0], np.cumsum(marked, dtype=np.int64)))
    return before[at[1:]] - before[at[:-1]]


def _again(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equals an earlier entry of its row, equals any other entry of its row) for each entry."""
    order = np.lexsort((np.arange(len(h)), h, row))
    same = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
    earlier, other = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    earlier[order[1:]] = same
    other[order[1:]] = same
    other[order[:-1]] |= same
    return earlier, other


def _base(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """The counts of each slice, in the order of their names. Windows and lines are told apart by 64-bit hashes within their own text."""
    for first, rows, raw, at in textkit.slices(column):
        words = textkit.runs(first, rows, raw, raw, at, textkit.NOT_BLANK[raw])
        place, windows = textkit.grams(textkit.word_hashes(words), words.row, 3)
        _, twice = _again(words.row[place], windows)
        covered = np.zeros(len(words.row), dtype=bool)
        for k in range(3):
            covered[place[twice] + k] = True
        lines = textkit.runs(first, rows, raw, raw, at, _NOT_BREAK[raw])
        inside = textkit.NOT_BLANK[raw]
        seen = np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))
        full = seen[lines.end] > seen[lines.start]
        line_row = lines.row[full]
        copy, _ = _again(line_row, textkit.word_hashes(lines)[full])
        yield [
            words.count(), _per_row(inside & ((raw & 0xC0) != 0x80), at), _per_row(_SYMBOL[raw], at),
            np.bincount(line_row[copy], minlength=rows), np.bincount(words.row[covered], minlength=rows),
        ]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(trusted, corpus): occurrences of every bucket in the texts marked trusted and in all of ``docs`` (text, trusted), in one pass. Each task adds up its own rows, so at
    most ``buckets`` rows a task are shuffled and ``buckets`` rows come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), dtype=np.int64)
        for b in batches:
            at, trusted = 0, b.column(1).to_numpy(zero_copy_only=False)
            for w in _tokens(b.column(0)):
                row, bucket = _grams(w, buckets)
                bucket, good = bucket.astype(np.int64), trusted[at : at + w.rows][row]
                total[0] += np.bincount(bucket[good], minlength=buckets)
                total[1] += np.bincount(bucket, minlength=buckets)
                at += w.rows
        met = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[0, met]), pa.array(total[1, met])], names=["bucket", "trusted", "n"])

    out = np.zeros((2, buckets), dtype=np.int64)
    for r in docs.select("text", "trusted").mapInArrow(run, "bucket int, trusted long, n long").groupBy("bucket").agg(F.sum("trusted").alias("trusted"), F.sum("n").alias("n")).collect():
        out[:, r.bucket] = r.trusted, r.n
    return out[0], out[1]


def ratios(trusted: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """log P(bucket | trusted) - log P(bucket | corpus), one occurrence added to each bucket of either."""
    return np.log((trusted + 1) / (trusted.sum() + len(trusted))) - np.log((corpus + 1) / (corpus.sum() + len(corpus)))


def _parts(column: pa.Array, ratio: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(score in parts, n-grams) of each slice: the mean log ratio over a text's n-grams, 0 without any."""
    for w in _tokens(column):
        row, bucket = _grams(w, len(ratio))
        n = np.bincount(row, minlength=w.rows)
        yield np.rint(PARTS * np.bincount(row, weights=ratio[bucket.astype(np.int64)], minlength=w.rows) / np.maximum(n, 1)).astype(np.int64), n


def _scored(rows: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, text) to (doc_id, the base counts, n_grams, parts), one row each."""
    sent = rows.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for counts, (parts, n) in zip(_base(b.column(1)), _parts(b.column(1), sent.value)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), *[pa.array(c.astype(np.int64)) for c in (*counts, n, parts)]], names=["doc_id", *_COUNTS, "n_grams", "parts"])
                at += len(n)

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *_COUNTS, "n_grams", "parts")))


def least_kept(good: Counter[int], bad: Counter[int], weight: float) -> int:
    """The threshold (parts) that loses least, when a rejected good text counts ``weight`` times a kept bad one, each as a share of its class.

    Of equal thresholds the one amid the gap; without bad texts the least score of a good one; without good ones the least score there is, so that all is kept.
    """
    if not good:
        return -(1 << 31)
    if not bad:
        return min(good)
    cuts = sorted(set(good) | set(bad))
    all_good, all_bad = sum(good.values()), sum(bad.values())
    lost, left, best = 0, all_bad, []
    for at, cut in enumerate(cuts):
        best.append((weight * lost / all_good + left / all_bad, at))
        lost, left = lost + good[cut], left - bad[cut]
    at = min(best)[1]
    return cuts[at] if at == 0 else (cuts[at - 1] + cuts[at] + 1) // 2


def failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < FEWEST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def _maybe_in(keys: DataFrame, key: str, bits: int = FILTER_BITS):
    """A test of a column: true for every value of ``key`` in ``keys``, false for most others. A bit a hash, of a fixed number of bits however many keys there are."""
    word = keys.select(F.pmod(F.xxhash64(key), F.lit(bits)).alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h % 64 AS INT))")).alias("v"))
    rows = word.toArrow()
    marks = np.zeros(bits // 64, dtype=np.int64)
    marks[rows["w"].to_numpy()] = rows["v"].to_numpy()
    sent = keys.sparkSession.sparkContext.broadcast(marks)

    @F.pandas_udf("boolean")
    def met(h: pd.Series) -> pd.Series:
        at = h.to_numpy()
        return pd.Series((sent.value[at >> 6] >> (at & 63)) & 1 == 1)

    return lambda c: met(F.pmod(F.xxhash64(c), F.lit(bits)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, weight: float = 4.0) -> Model:
    """Counts of the corpus over every row of ``docs``, counts of the trusted texts over those that ``labels`` (doc_id, quality) call good, and the threshold from labelled texts
    that pass the base rules (the others fail whatever their score).

    Learns from every labelled id but the held-out ones, which teach nothing; an id labelled both ways counts as bad. Only the trusted texts are shuffled, once, to meet their labels; the threshold
    needs a text's few numbers, which are worked out where the text is read and meet the labels after that. :func:`_maybe_in` keeps most other texts out of both. Both joins sort and merge, also where
    the labels are few, so that their cost is in proportion to the input at any size. Neither the id nor any other column enters a score. Without labels every text is kept.
    """
    docs = _rows(docs, id_col, text_col)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))
    best = known.where("good").select("doc_id")
    corpus, _ = bucket_counts(docs.withColumn("trusted", F.lit(True)), buckets)
    trusted, _ = bucket_counts(docs.where(_maybe_in(best, "doc_id")(F.col("doc_id"))).join(best.hint("merge"), "doc_id").select("text", F.lit(True).alias("trusted")), buckets)
    ratio = ratios(trusted, corpus)
    scored = _scored(docs.where(_maybe_in(known, "doc_id")(F.col("doc_id"))), ratio).where(~failed(F.col("n_words"), F.col("n_repeat_words")))
    seen = scored.select("doc_id", F.greatest(F.least("parts", F.lit(FARTHEST * PARTS)), F.lit(-FARTHEST * PARTS)).alias("parts")).join(known.hint("merge"), "doc_id").groupBy("good", "parts").count().collect()
    good, bad = Counter(), Counter()
    for r in seen:
        (good if r.good else bad)[r.parts] += r["count"]
    return Model(ratio, least_kept(good, bad, weight))


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the base counts, base_failed, score, n_grams, kept) for every row of ``docs``, whole texts, in one pass without a shuffle.

    A text is kept if it passes the base rules and its score, the mean log ratio in nats rounded to thousandths, is no less than the threshold. Null and empty texts have no words and
    fail; repeated rows each get a row; an empty table gives none; other columns play no part. Memory follows the longest text by some arrays of numbers per word.
    """
    found = _scored(_rows(docs, id_col, text_col), model.ratio).withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words")))
    return found.select("doc_id", *_COUNTS, "base_failed", "n_grams", (F.col("parts") / PARTS).alias("score"), (~F.col("base_failed") & (F.col("parts") >= model.least)).alias("kept"))
