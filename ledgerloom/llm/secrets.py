"""Secret scan with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.shared import durable, numbered, unused

KINDS = ("assign", "access", "hex", "pem", "grant")
BASE = KINDS[:3]
FOUND = "array<struct<kind:string,start:int,end:int,digest:string>>"
# The base patterns, their least lengths, and the method's own candidates.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as [0-9a-f]+ finds them
PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*")
GRANT = re.compile(r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}")
TOKEN_PART, TOKEN_HEAD = re.compile(r"[A-Za-z0-9_-]+"), re.compile(r"(?<![A-Za-z0-9_])eyJ")
TOKEN_PARTS, TOKEN_LEAST = 3, 8
ASSIGN_LEAST, ACCESS_LEAST = 6, 20


def web_tokens(text: str) -> list[tuple[int, int]]:
    """Spans of three runs joined by dots, the first from its first "eyJ" on, each of eight characters or more (after "eyJ"). Every run is read once, so the time is linear in the text."""
    if "eyJ" not in text:
        return []
    out, held, done = [], [], 0
    for m in TOKEN_PART.finditer(text):
        if held and (held[-1][1] != m.start() - 1 or text[m.start() - 1] != "."):
            held = []
        held = [*held[1 - TOKEN_PARTS :], m.span()]
        if len(held) == TOKEN_PARTS and all(z - a >= TOKEN_LEAST for a, z in held[1:]) and held[0][0] >= done:
            head = TOKEN_HEAD.search(text, held[0][0], held[0][1] - TOKEN_LEAST)
            if head:
                done = held[-1][1]
                out.append((head.start(), done))
                held = []
    return out


def find(text: str) -> list[tuple[int, str, int, int, str]]:
    """(kind number, kind, start, end, secret) of all candidates in a text, by start, then kind."""
    out = [(0, "assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(1, "access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [(2, "hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    if "-----BEGIN" in text:
        out += [(3, "pem", *m.span(), m[0]) for m in PEM.finditer(text)]
    grants = [m.span() for m in GRANT.finditer(text)] if "gh" in text else []
    out += [(4, "grant", a, z, text[a:z]) for a, z in sorted({*grants, *web_tokens(text)})]
    return sorted(out, key=lambda x: (x[2], x[0]))


def candidates(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns and found: array of (kind, start, end, digest) for each row; offsets count code points, end exclusive.

    digest is SHA-256 of the secret itself (of an assignment: its value), so no secret leaves the scan. A null text is empty.
    """
    carry = carry or []
    chosen = docs.select(*carry, F.col(text_col).alias(unused(docs.select(*carry), "text")[0]))
    shape = T.StructType([*chosen.schema.fields[:-1], T.StructField("found", T._parse_datatype_string(FOUND))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.string())]))
        for b in batches:
            found = [[{"kind": k, "start": x, "end": z, "digest": hashlib.sha256(s.encode()).hexdigest()} for _, k, x, z, s in find(t)] if t else [] for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, kind)], names=[*carry, "found"])

    return chosen.mapInArrow(run, shape)


def ownership(found: DataFrame) -> DataFrame:
    """``found`` (digest, repo, owner) to (digest, repos, owners): exact distinct counts over the corpus.

    A repository belongs to its owner, so equal names under two owners count twice; a null is one name. Counting goes in two steps,
    (digest, owner, repo) and then (digest, owner), so a digest that fills a third of the corpus is spread over all tasks and only its
    per-owner sums meet.
    """
    each = found.select("digest", "owner", "repo").distinct().groupBy("digest", "owner").agg(F.count("*").alias("n"))
    return each.groupBy("digest").agg(F.sum("n").alias("repos"), F.count("*").alias("owners"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", shared_from: int = 3) -> DataFrame:
    """One row per row of ``docs``: its id and found: array of (kind, start, end, digest, repos, owners, live).

    Each candidate's digest is counted over the corpus: in how many repositories (ids) and under how many owners it occurs. A secret of
    ``shared_from`` owners or more is a widely copied example; fewer owners leave it owner-specific and live-looking. Whole texts are read.
    Null texts hold nothing, repeated rows each get a row but count as one repository, an empty table gives no rows.
    """
    rows = numbered(docs.select(F.col(id_col).alias("_id"), F.col(owner_col).cast("string").alias("_owner"), F.col(text_col).alias("_text")))
    held = durable(candidates(rows, "_text", ["_row", "_id", "_owner"]))
    spans = held.select("_row", F.col("_id").cast("string").alias("repo"), F.col("_owner").alias("owner"), F.explode("found").alias("f")).select("_row", "repo", "owner", "f.*")
    counted = spans.join(ownership(spans), "digest")
    span = F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("rank"), "kind", "end", "digest", "repos", "owners", (F.col("owners") < shared_from).alias("live"))
    by_row = counted.groupBy("_row").agg(F.sort_array(F.collect_list(span)).alias("found"))
    plain = held.select("_row", F.col("_id").alias("id"))
    nothing = F.array().cast(by_row.schema["found"].dataType)
    return plain.join(by_row, "_row", "left").select("id", F.coalesce("found", nothing).alias("found"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", shared_from: int = 3) -> DataFrame:
    """``docs`` with every live-looking secret in its text replaced by ``<kind>``; widely copied examples stay, as do all other columns."""
    repo, key, repo2, key2, held = unused(docs, "repo", "key", "repo2", "key2", "marks")
    mark = [F.col(id_col).cast("string").alias(repo), F.xxhash64(text_col).alias(key)]
    seen = candidates(docs.select(*mark, F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("text")).toDF("id", "key", "owner", "text"), "text", ["id", "key", "owner"])
    spans = durable(seen.select("id", "key", F.col("id").alias("repo"), "owner", F.explode("found").alias("f")).select("id", "key", "repo", "owner", "f.*"))
    live = spans.join(ownership(spans).where(F.col("owners") < shared_from), "digest")
    marks = live.groupBy("id", "key").agg(F.sort_array(F.collect_set(F.struct("start", "end", "kind")))).toDF(repo2, key2, held)
    joined = docs.select("*", *mark).join(marks, F.col(repo).eqNullSafe(F.col(repo2)) & (F.col(key) == F.col(key2)), "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, marks: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(text, marks):
            if spans is not None and len(spans):
                done, parts = 0, []
                for s in spans:
                    if s["start"] >= done:
                        parts += [t[done : s["start"]], f"<{s['kind']}>"]
                    done = max(done, s["end"])
                t = "".join([*parts, t[done:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    text = F.when(F.col(held).isNull(), F.col(text_col)).otherwise(cut(text_col, held))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
