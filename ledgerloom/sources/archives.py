"""Archived documents (zip + XML) into element rows, many files per task.

Input rows come from ``spark.read.format("binaryFile")`` (path, content) or any
frame with an id and the bytes.  Broken files yield one row with ``error`` set,
never an exception.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ELEMENTS = "doc_id string, seq bigint, parent_seq bigint, depth bigint, tag string, attrs string, text string, error string"
VALIDITY = "doc_id string, valid boolean, entries bigint, problem string"
VOID = frozenset(["br", "hr", "img", "meta", "link", "input", "col", "pgbrk"])  # fixed values


class _Walker(HTMLParser):
    """Collects elements in document order; forgiving about unclosed tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.stack: list[int] = []

    def handle_starttag(self, tag, attrs):
        parent = self.stack[-1] if self.stack else -1
        self.rows.append([len(self.rows), parent, len(self.stack), tag, " ".join(f"{k}={v}" for k, v in attrs), ""])
        if tag not in VOID:
            self.stack.append(len(self.rows) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.rows[self.stack[i]][3] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        if self.stack:
            self.rows[self.stack[-1]][5] += data


def _main_part(content: bytes, part: str) -> bytes:
    if content[:2] != b"PK":
        return content
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return z.read(part)


def read_elements(files: DataFrame, doc_id: str = "path", content: str = "content", part: str = "contents.xml") -> DataFrame:
    """Element rows of every document's main part."""

    def shred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["d"], batch["c"]):
                try:
                    walker = _Walker()
                    walker.feed(_main_part(bytes(raw), part).decode("utf-8", "replace"))
                    walker.close()
                    rows = [[name, *r, None] for r in walker.rows] or [[name, 0, -1, 0, None, None, None, "no elements"]]
                except (zipfile.BadZipFile, KeyError, OSError) as problem:
                    rows = [[name, 0, -1, 0, None, None, None, str(problem) or type(problem).__name__]]
                yield pd.DataFrame(rows, columns=["doc_id", "seq", "parent_seq", "depth", "tag", "attrs", "text", "error"])

    return files.select(F.col(doc_id).cast("string").alias("d"), F.col(content).cast("binary").alias("c")).mapInPandas(shred, ELEMENTS)


def body_elements(elements: DataFrame, body: str = "body", kinds: tuple[str, ...] = ("p", "tbl", "table")) -> DataFrame:
    """Direct children of the body with their index; paragraphs and tables keep their place."""
    from ledgerloom.operators.sequence import row_position

    bodies = elements.where(F.col("tag") == body).groupBy("doc_id").agg(F.min("seq").alias("parent_seq"))
    kids = elements.join(bodies, ["doc_id", "parent_seq"], "left_semi")
    placed = row_position(kids, ["doc_id"], "seq", "n").withColumn("body_index", F.col("n") - 1)
    kind = F.when(F.col("tag") == "p", "p").when(F.col("tag").isin("tbl", "table"), "tbl").otherwise("other")
    return placed.select("doc_id", "body_index", "tag", kind.alias("kind"), "text")


def check_archives(files: DataFrame, doc_id: str = "path", content: str = "content", part: str = "word/document.xml") -> DataFrame:
    """One row per output file: readable archive, main part present, well-formed XML."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, raw in zip(batch["d"], batch["c"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                        names = z.namelist()
                        if part not in names:
                            rows.append((name, False, len(names), f"missing {part}"))
                            continue
                        ElementTree.fromstring(z.read(part))
                        rows.append((name, True, len(names), None))
                except zipfile.BadZipFile:
                    rows.append((name, False, 0, "not a zip archive"))
                except ElementTree.ParseError as problem:
                    rows.append((name, False, len(names), f"not well formed: {problem}"))
            yield pd.DataFrame(rows, columns=["doc_id", "valid", "entries", "problem"])

    return files.select(F.col(doc_id).cast("string").alias("d"), F.col(content).cast("binary").alias("c")).mapInPandas(check, VALIDITY)
