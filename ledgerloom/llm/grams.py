"""Word grams of a document table as Spark rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.textkit import Words, grams, signed, words

KEY = "doc_id long, tk long"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tk, text): a row is known by its id and its text's hash, so rows that repeat an id with other texts stay apart and rows
    that repeat both give the same result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"))


def gram_rows(docs: DataFrame, is_word: np.ndarray, hashed: Callable[[Words], np.ndarray], k: int) -> DataFrame:
    """``docs`` (doc_id, tk, text) to (doc_id, tk, pos, gram): all runs of ``k`` words of every text, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words(b.column(2), is_word):
                at, h = grams(hashed(w), w.row, k)
                ends = np.concatenate(([0], np.cumsum(np.bincount(w.row[at], minlength=w.rows)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(h)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(w.first, w.rows), b.column(1).slice(w.first, w.rows), lists], names=["doc_id", "tk", "grams"])

    return docs.mapInArrow(run, f"{KEY}, grams array<long>").select("doc_id", "tk", F.posexplode("grams").alias("pos", "gram"))
