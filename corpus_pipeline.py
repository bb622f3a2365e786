"""The corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; between stages the documents are written and read again.
Null ids, null and empty texts, repeated rows and empty tables pass through every stage as its docstring says; other columns are carried along up to the last stage, which returns doc_id and pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, pieces, quality, secrets, simhash
from ledgerloom.llm.shared import unused
from ledgerloom.session import shared_dir

ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; an empty or null text is judged like any other."""
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: that with the smallest id, rows without id after all others; then by text and the other columns.

    Classes are over texts (known by their hash), so rows that repeat an id with unrelated texts lie in different classes and each class keeps its own row.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    text = F.coalesce("text", F.lit(""))
    names = unused(docs, "no_id", "id", "key", "others")
    own = dict(zip(names, (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), F.xxhash64(text), F.xxhash64(F.lit("rest"), *rest))))
    marked = docs.withColumns(own)
    classes = simhash.near_duplicates(docs.select(F.xxhash64(text).alias("key"), "text"), id_col="key").select(F.col("doc_id").alias("key"), "component_id").distinct()
    first = marked.groupBy(F.col(names[2]).alias("key")).agg(F.min(F.struct(*names)).alias("b"))
    kept = first.join(classes, "key").groupBy("component_id").agg(F.min("b").alias("b")).select("b.*")
    return marked.join(kept, names, "left_semi").dropDuplicates(names).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. A text is known by its hash: rows without id are searched too, and rows that only share an id with a leak stay."""
    text, key = F.xxhash64(F.coalesce("text", F.lit(""))), unused(docs, "key")[0]
    found = decontaminate.leaks(docs.select(text.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.withColumn(key, text).join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets replaced by their kind; n_chars follows the text."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left."""
    return pieces.encode(docs, pieces.load())


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("leaks", drop_leaks),
    ("secrets", redact_secrets),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
