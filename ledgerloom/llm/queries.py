"""The queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import alignment, decontaminate, licenses, likelihood, pieces, quality, secrets, sharding, simhash, spelling, topk, toxicity, warc
from ledgerloom.llm.oracles import ORACLES

#: Where the public vocabulary files are.
TOKENIZERS = "/opt/tokenizers"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

__all__ = ["ORACLES", "QUERIES"]


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every vector whose id is divisible by 50."""
    vectors = topk.quantize(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors.where("id % 50 = 0"), vectors, k=5)


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, and how far each is owned or shared."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    of_kind = lambda k: count(lambda s: s["kind"] == k)
    base = F.filter("found", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select(
        F.col("id").alias("doc_id"), *[of_kind(k).alias(f"n_{k}") for k in secrets.BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_shared"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["owners"])), F.lit(0)).alias("most_owners"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["repos"])), F.lit(0)).alias("most_repos"),
    )


@query
def op4_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document on a ring with bounded loads."""
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")) + 1
    rows = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    dealt = sharding.bounded_ring(rows, "doc_id", ["text_crc32", "size"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home", "hops")


@query
def op7_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score",
        F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"], s["end"]))).alias("spans"),
    )


@query
def op10_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with numbers, names and units changed or not."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op9_clause_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op3_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixity of every page's WARC record against a replica.

    The replica is the table itself with faults that the ids alone decide: a byte cut off, a byte added, a record lost, a record under another id.
    """
    pages = table(spark, sf_dir, "pages")
    body = F.when(F.col("page_id") % 397 == 5, F.expr("left(html, greatest(length(html) - 1, 0))")).when(F.col("page_id") % 401 == 7, F.concat("html", F.lit("x"))).otherwise(F.col("html"))
    moved = F.when(F.col("page_id") % 409 == 9, -1 - F.col("page_id")).otherwise(F.col("page_id"))
    replica = pages.where(F.coalesce(F.col("page_id") % 211 != 3, F.lit(True))).select(moved.alias("page_id"), "url", body.alias("html"))
    found = warc.report(pages, replica)
    return found.select(F.col("id").alias("page_id"), "archive", "start", "length", "digest", "copies", "state")


@query
def op6_shared_prefix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, decoded again."""
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.load())


@query
def op12_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base quality rules and the log-likelihood ratio verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return likelihood.judge(docs, likelihood.fit(docs, table(spark, sf_dir, "labels")))


@query
def op13_incidence_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers, for every document."""
    models = alignment.load(f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), models)


@query
def op11_trie_node_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))
