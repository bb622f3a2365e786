"""WARC records and their Merkle fixity audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import durable

#: An archive holds the records of 2**ARCHIVE_BITS neighbouring ids; a tree node has 2**FAN_BITS children.
ARCHIVE_BITS, FAN_BITS = 10, 5


def record(url: Column, body: Column, name: Column) -> Column:
    """The bytes of a WARC/1.1 resource record; a null body or url is empty."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(name.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(id, digest, length, copies): SHA-256 and length of each record. Rows that repeat id and record are one leaf with its number of copies;
    rows without id are passed over, as no order and so no offset is theirs."""
    whole = record(F.col(url_col), F.col(body_col), F.col(id_col))
    each = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.sha2(whole, 256).alias("digest"), F.octet_length(whole).cast("long").alias("length"))
    return each.groupBy("id", "digest", "length").agg(F.count("*").alias("copies"))


def manifest(leaves: DataFrame) -> DataFrame:
    """``leaves`` with archive and start, the record's first byte in its archive, records being in order of (id, digest).

    Running sums stay within an archive, whose ids are bounded in number.
    """
    before = Window.partitionBy("archive").orderBy("id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = leaves.withColumn("archive", F.shiftright("id", ARCHIVE_BITS))
    return placed.withColumn("start", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0).cast("long")))


def _parents(nodes: DataFrame) -> DataFrame:
    """Nodes (node, hash, first, last) one level up: a hash over the children's hashes in order."""
    children = F.sort_array(F.collect_list(F.struct("node", "hash")))
    up = nodes.groupBy(F.shiftright("node", FAN_BITS).alias("up")).agg(children.alias("c"), F.min("first").alias("first"), F.max("last").alias("last"))
    return up.select(F.col("up").alias("node"), F.sha2(F.concat_ws(",", F.transform("c", lambda x: F.concat_ws(":", x["node"], x["hash"]))).cast("binary"), 256).alias("hash"), "first", "last")


def tree(leaves: DataFrame, height: int) -> list[DataFrame]:
    """Levels of (node, hash, first, last), from ids up: level 0 hashes an id's records in order (digest, length, copies), each level above
    2**FAN_BITS nodes of the one below. first and last are the ids that a node spans."""
    leaf = F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("digest", "length", "copies"))), lambda x: F.concat_ws(":", x["digest"], x["length"], x["copies"])))
    low = leaves.groupBy(F.col("id").alias("node")).agg(leaf.alias("text")).select("node", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.col("node").alias("first"), F.col("node").alias("last"))
    levels = [durable(low)]
    for _ in range(height):
        levels.append(durable(_parents(levels[-1])))
    return levels


def height_of(*sides: DataFrame) -> int:
    """Levels above the ids until one node is left on all sides, or two where there are negative ids."""
    low, high = None, None
    for s in sides:
        r = s.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
        if r.lo is not None:
            low, high = min(r.lo, r.lo if low is None else low), max(r.hi, r.hi if high is None else high)
    n = 0
    while low is not None and (low >> FAN_BITS * n, high >> FAN_BITS * n) != (-1, 0) and low >> FAN_BITS * n != high >> FAN_BITS * n:
        n += 1
    return n


def audit(one: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compare two replicas (id, digest, length, copies) by their trees.

    Returns (roots, walked, found). roots: (side, hash), no row for an empty side; negative ids have a root of their own. walked: (level, node) of every mismatching node, found by going
    down from the roots into mismatching nodes' children only. found: (id, state), state being changed, missing (from ``other``) or extra.
    """
    height = height_of(one, other)
    a, b = tree(one, height), tree(other, height)
    roots = a[height].select(F.lit("one").alias("side"), "hash").unionAll(b[height].select(F.lit("other").alias("side"), "hash"))
    walked, open_nodes = None, None
    for level in range(height, -1, -1):
        left, right = (side[level].select("node", F.col("hash").alias(name)) for side, name in ((a, "h1"), (b, "h2")))
        if open_nodes is not None:
            below = F.shiftright("node", FAN_BITS)
            left, right = (s.join(open_nodes.select(F.col("node").alias("up")), below == F.col("up"), "left_semi") for s in (left, right))
        unequal = durable(left.join(right, "node", "full").where(~F.col("h1").eqNullSafe(F.col("h2"))))
        here = unequal.select(F.lit(level).alias("level"), "node")
        walked = here if walked is None else walked.unionAll(here)
        open_nodes = unequal
    found = open_nodes.select(F.col("node").alias("id"), F.when(F.col("h1").isNull(), "extra").when(F.col("h2").isNull(), "missing").otherwise("changed").alias("state"))
    return roots, walked, found


def report(pages: DataFrame, replica: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """One row per record of either replica: id, archive, start, length, digest, copies, state (intact, changed, missing, extra).

    start and length give the byte range in the first replica's archive (in the second one's for extra records). An empty replica makes all records
    missing or extra; both empty give no rows.
    """
    one, other = (durable(records(p, id_col, url_col, body_col)) for p in (pages, replica))
    _, _, found = audit(one, other)
    found = durable(found)
    rows = manifest(one).join(found.select("id", "state"), "id", "left").withColumn("state", F.coalesce("state", F.lit("intact")))
    extra = manifest(other).join(found.where("state = 'extra'"), "id")
    return rows.unionByName(extra).select("id", "archive", "start", "length", "digest", "copies", "state")
