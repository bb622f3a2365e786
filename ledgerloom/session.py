"""Session settings and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of the input, and compressed bytes of a shuffle, that one task is given.
TASK_ROWS = 1 << 16
TASK_BYTES = 3 << 20


def build_session(app: str = "ledgerloom", cores: str | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )


def stored(df: DataFrame, *keys: str) -> DataFrame:
    """Write ``df`` once as compressed columns and read it back, dealt by ``keys`` if there are any. For results whose partitions and order don't matter; a tenth of a checkpoint's size.

    Dealt rows of an input beyond :data:`TASK_ROWS` are written in buckets, so that however often they are read they are never dealt anew; below that a file a bucket costs more than the shuffle.
    """
    spark, name = df.sparkSession, f"stored_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    if keys and in_buckets(spark):
        df.repartition(*keys).write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).option("path", path).saveAsTable(name)
        back = spark.table(name)
        spark.sql(f"DROP TABLE {name}")  # only the catalog's entry: the files stay under ``path``
        return back
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return back.repartition(*keys) if keys else back


def once(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with ``columns`` worked out once a row, so that later conditions on them stay above.

    Spark else moves a condition below the columns it names and writes their whole expressions into it, at every mention: a text was formatted and parsed many times over for one row, in methods too long to be compiled.
    """
    kept = df.select(*[c for c in df.columns if c not in columns], F.explode(F.array(F.struct(*columns))).alias("_once"))
    return kept.select(*[F.col(f"_once.{c}") if c in columns else F.col(c) for c in df.columns])


def in_buckets(spark: SparkSession) -> bool:
    """Whether what is stored by pair stays dealt by pair for good (see :func:`stored`)."""
    return spark.conf.get("ledgerloom.bucketed", "false") == "true"


def keep_dealt(spark: SparkSession, rows: int = 0) -> None:
    """Rows that both sides hold dealt by part of the join's keys (the pair of documents) are joined where they are, instead of being dealt anew by all of them.

    A task then expands, sorts and ranks all it was dealt, many times the compressed size that Spark sees. Shuffles are therefore dealt into one part per :data:`TASK_ROWS` of ``rows``, the
    input's rows, but no fewer than the session has, and only small parts are put together, so that a task's memory doesn't grow with the input and nothing spills.

    Spark takes a file's compressed bytes for the size of its rows, a hundredth of what the driver then holds to broadcast them. Beyond :data:`TASK_ROWS` a side is therefore broadcast only
    after it has been shuffled and its rows' bytes, as counted, are within the session's threshold.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("ledgerloom.bucketed", str(rows > TASK_ROWS).lower())
    # a task reads a bucket also where no join asks for it: a few large tasks would sort many buckets at once to write them, and spill
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", str(rows <= TASK_ROWS).lower())
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    before = spark.conf.get("ledgerloom.parts.before", parts) if parts == spark.conf.get("ledgerloom.parts", "") else parts  # a value that was not set here is the session's own
    parts = str(max(int(before), -(-rows // TASK_ROWS)))
    for key, value in (("spark.sql.shuffle.partitions", parts), ("ledgerloom.parts", parts), ("ledgerloom.parts.before", before)):
        spark.conf.set(key, value)
    _broadcast_as_counted(spark, rows > TASK_ROWS)


def _broadcast_as_counted(spark: SparkSession, on: bool) -> None:
    """Leave broadcasts to the sizes that are counted as the query runs, or give the session its own thresholds back."""
    sizes, counted, none = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "0"
    before, set_here = (spark.conf.get(f"ledgerloom.{x}.before", "") for x in ("sizes", "counted"))
    if set_here and spark.conf.get(counted, None) == set_here:
        spark.conf.unset(counted)
    if before and spark.conf.get(sizes) == none:
        spark.conf.set(sizes, before)
    before, set_here = spark.conf.get(sizes) if on else "", ""
    if on:
        if spark.conf.get(counted, None) is None:
            spark.conf.set(counted, set_here := before)
        spark.conf.set(sizes, none)
    spark.conf.set("ledgerloom.sizes.before", before)
    spark.conf.set("ledgerloom.counted.before", set_here)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session (tests, bench) may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_dir()


_LOCAL: list[str] = []


def _local_dir() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _LOCAL[0]


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a checkpoint that survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
