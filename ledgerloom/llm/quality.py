"""Quality classifier by compression with labelled dictionaries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.calibrate import fit_logistic, probability
from ledgerloom.llm.shared import held_out

THRESHOLD = 0.7
#: At most so many labelled texts of each class are learned from, none longer than LONGEST bytes; a dictionary takes whole texts up to DICTIONARY_BYTES.
SAMPLE, LONGEST, DICTIONARY_BYTES = 1200, 65_536, 500_000
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray


def sizes(texts: list[str], dictionaries: list[bytes]) -> np.ndarray:
    """Compressed size of every whole text under each dictionary, and its plain size."""
    tools = []
    for d in dictionaries:
        held = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
    out = np.zeros((len(texts), len(tools) + 1))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        out[i] = [*(len(z.compress(raw)) for z in tools), len(raw)]
    return out


def features(size: np.ndarray) -> np.ndarray:
    """The normalised difference of the compressed sizes, bad - good by length, and how far the better dictionary shrinks the text."""
    good, bad, raw = size.T
    return np.column_stack([(bad - good) / (raw + 64.0), np.minimum(good, bad) / np.maximum(raw, 64.0)])


def book(texts: list[str], most: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of whole texts in their order, as many as fit into ``most`` bytes; of a line that several texts hold one copy is kept."""
    seen: set[str] = set()
    out, size = [], 0
    for t in texts:
        lines = [x for x in dict.fromkeys(t.split("\n")) if x not in seen]
        raw = "\n".join(lines).encode()
        if raw and size + len(raw) < most:
            seen.update(lines)
            out.append(raw)
            size += len(raw) + 1
    return b"\n".join(out) or b" " * 8


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Two dictionaries and a calibration, learned from labelled rows that are not held out.

    Of each class the ``sample`` ids with the smallest hash are taken, each with its first text in order (those over ``LONGEST`` bytes are passed over), half for the dictionary and half for the calibration,
    which is weighted by class frequency. The driver holds these texts only, a bound that does not follow the corpus.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y"))
    order = F.xxhash64(F.lit("quality"), "_id")
    totals = {r._y: r["count"] for r in known.groupBy("_y").count().collect()}
    picked = None
    for y in (0, 1):
        some = known.where(F.col("_y") == y).orderBy(order, "_id").limit(sample)
        picked = some if picked is None else picked.unionAll(some)
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(picked), "_id").where(F.octet_length("_t") <= LONGEST)
    chosen = chosen.groupBy("_id", "_y").agg(F.min("_t").alias("_t"))  # 2 x sample rows, however often an id occurs
    rows = sorted((r._y, r._h, r._t or "") for r in chosen.select("_y", order.alias("_h"), "_t").collect())
    parts = {y: [t for c, _, t in rows if c == y] for y in (0, 1)}
    books = {y: book(p[::2]) for y, p in parts.items()}
    rest = [(y, t) for y, p in parts.items() for t in p[1::2]]
    if len({y for y, _ in rest}) < 2:
        prior = totals.get(1, 0) / max(1, sum(totals.values())) if totals else 0.5
        return Model(books[1], books[0], np.array([np.log((prior + 1e-3) / (1 - prior + 1e-3)), 0.0, 0.0]))
    y = np.array([c for c, _ in rest], dtype=float)
    x = features(sizes([t for _, t in rest], [books[1], books[0]]))
    # Resample the classes to their share of all labelled rows, so the score is a probability.
    n = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.where(y == 1, totals[1] / n[1], totals[0] / n[0])
    times = np.maximum(1, np.round(20 * weight / weight.max())).astype(int)
    return Model(books[1], books[0], fit_logistic(np.repeat(x, times, axis=0), np.repeat(y, times)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; nothing but the text enters the score.

    A text is compressed whole under the good and under the bad dictionary; the calibrated difference is the probability of label 1. Null and empty
    texts get the score of an empty text; repeated rows each get a row; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            p = probability(m.weights, features(sizes(b.column(1).to_pylist(), [m.good, m.bad])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(text: pd.Series) -> pd.Series:
        m = sent.value
        return pd.Series(probability(m.weights, features(sizes(text.tolist(), [m.good, m.bad]))))

    return docs.where(judge(F.col(text_col)) >= THRESHOLD)
