"""Exact top-k search: every query against every row, term at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import durable, spread

PANEL = 256


def quantize(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, v array<long>): floor(scale * x) of each component, as double. Null vectors, and vectors that hold a null or a
    non-finite component, are left out; an empty vector scores 0 with all."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    return vectors.where(x.isNotNull() & F.col(id_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))


def _postings(vectors: list[np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(term, rows, weights) for each term with a weight that is not zero."""
    length = np.array([len(v) for v in vectors])
    row, flat = np.repeat(np.arange(len(vectors)), length), np.concatenate(vectors).astype(np.int64)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    held = np.flatnonzero(flat)
    held = held[np.argsort(term[held], kind="stable")]
    cuts = np.flatnonzero(np.diff(term[held], prepend=-1))
    return [(int(term[part[0]]), row[part], flat[part]) for part in np.split(held, cuts[1:])] if len(held) else []


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best by (score descending, id ascending), the query's own id left out."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        over, equal = at[scores[at] > least], at[scores[at] == least]
        if len(equal) > k - len(over):
            equal = equal[np.argsort(ids[equal], kind="stable")[: k - len(over)]]
        at = np.concatenate([over, equal])
    return at[np.lexsort((ids[at], -scores[at]))]


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5, row_block: int = 16384, query_block: int = 4096) -> DataFrame:
    """``queries`` and ``rows`` (id, v) to (query_id, rank, vec_id, score): the k highest inner products of each query.

    Rows and queries are dealt into blocks of about ``row_block`` and ``query_block``, by place and not by value. Each pair
    of blocks is one group: the rows become posting lists (term, row, weight) and each query scatters its
    weights times the postings into a dense score array, ``PANEL`` queries at a time; the k best of each block are chosen by partition and
    then merged over the blocks. Traffic is rows x query blocks + queries x row blocks.

    Ties go to the smaller id. A row with the query's id is its own and never a partner. Repeated rows each count; a query id
    given more than once asks once, with its smallest vector. Vectors of different lengths meet on the shorter one's components. Either
    side empty: no rows. Scores are 64-bit integers.
    """
    queries = durable(queries.groupBy("id").agg(F.min("v").alias("v")))
    n_rows, n_queries = rows.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n_rows // row_block)), max(1, -(-n_queries // query_block))

    def deal(df: DataFrame, own: int, others: int, mine: str, theirs: str) -> DataFrame:
        return df.select("id", "v", spread(df, own).alias(mine)).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    right = deal(rows, row_blocks, query_blocks, "rb", "qb")
    left = deal(queries, query_blocks, row_blocks, "qb", "rb")

    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(q) and len(r):
            ids = r["id"].to_numpy()
            postings = _postings(list(r["v"]))
            for lo in range(0, len(q), PANEL):
                part = q.iloc[lo : lo + PANEL]
                scores = np.zeros((len(part), len(ids)), dtype=np.int64)
                weights: dict[int, list[tuple[int, int]]] = {}
                for i, v in enumerate(part["v"]):
                    for t in np.flatnonzero(v):
                        weights.setdefault(int(t), []).append((i, int(v[t])))
                for term, at, w in postings:
                    for i, x in weights.get(term, ()):
                        if len(at) == len(ids):
                            scores[i] += w * x
                        else:
                            scores[i, at] += w * x
                for i, own in enumerate(part["id"]):
                    best = _best(scores[i], ids, own, k)
                    out["query_id"].append(np.full(len(best), own))
                    out["vec_id"].append(ids[best])
                    out["score"].append(scores[i, best])
        return pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in out.items()})

    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
