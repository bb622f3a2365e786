"""Candidate label pairs without comparing everything with everything.

A pair (left, right) is looked for under the same ``keys`` (usually one table pair). Containment is read off an automaton over the distinct inner texts, one pass over each distinct outer text; a text has
no more different texts inside it than its length allows, so outer rows carry their inner texts to the join on the keys. Token overlap goes through each text's rarest tokens. Both lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of distinct inner texts that one automaton holds; more are dealt to several by how they begin.
AUTOMATON = 16_000_000
#: Letters of a text's beginning that decide where it is dealt.
HEAD = 4


def contained_pairs(inner: DataFrame, outer: DataFrame, keys: list[str], inner_text: str, outer_text: str, limit: int = AUTOMATON) -> DataFrame:
    """Distinct ``keys + [inner_text, outer_text]`` with the inner text inside the outer one."""
    i = inner.select(*keys, inner_text).where(F.col(inner_text) != "").distinct()
    o = outer.select(*keys, outer_text).where(F.col(outer_text) != "").distinct()
    if not keys:
        return _held(i, o, inner_text, outer_text, limit)
    held = _held(i.select(inner_text).distinct(), o.select(outer_text).distinct(), inner_text, outer_text, limit)
    return o.join(held, outer_text).join(i, [*keys, inner_text]).select(*keys, inner_text, outer_text)


def _automaton(texts: Iterable[str]) -> ahocorasick.Automaton | None:
    found = ahocorasick.Automaton()
    for t in texts:
        found.add_word(t, t)
    if not len(found):
        return None
    found.make_automaton()
    return found


def _held(inner: DataFrame, outer: DataFrame, inner_text: str, outer_text: str, limit: int) -> DataFrame:
    """(inner_text, outer_text) for distinct texts. The inner texts are sent to every task only if their size, which is counted first, is within ``limit``."""
    size = inner.agg(F.sum(F.length(inner_text))).first()[0] or 0
    schema = f"`{inner_text}` string, `{outer_text}` string"

    def rows(pairs: Iterator[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        done = False
        while not done:
            left, right = [], []
            for x, y in pairs:
                left.append(x)
                right.append(y)
                if len(left) == 10_000:
                    break
            else:
                done = True
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=[inner_text, outer_text])

    if size <= limit:
        sent = inner.sparkSession.sparkContext.broadcast([r[0] for r in inner.collect()])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(sent.value)
            if automaton is not None:
                yield from rows((x, y) for b in batches for y in b.column(0).to_pylist() for x in {w for _, w in automaton.iter(y)})

        return outer.select(outer_text).mapInArrow(scan, schema)

    parts = -(-4 * size // limit)
    part = lambda piece: F.pmod(F.xxhash64(piece), F.lit(parts))
    # a text inside another begins at one of its places, so its beginning is one of the other's pieces
    pieces = F.flatten(F.array(*[F.regexp_extract_all(F.col(outer_text), F.lit(f"(?s)(?=(.{{{k}}}))"), 1) for k in range(1, HEAD + 1)]))
    dealt = inner.select(part(F.left(inner_text, F.lit(HEAD))).alias("part"), F.lit(0).alias("side"), F.col(inner_text).alias("text"))
    visits = outer.select(F.col(outer_text).alias("text"), F.explode(F.array_distinct(F.transform(pieces, part))).alias("part")).select("part", F.lit(1).alias("side"), "text")

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = ((p, s, t) for b in batches for p, s, t in zip(*(c.to_pylist() for c in b.columns)))

        def pairs() -> Iterator[tuple[str, str]]:
            for _, items in groupby(stream, key=lambda r: r[0]):
                automaton = None
                for side, texts in groupby(items, key=lambda r: r[1]):
                    if side == 0:
                        automaton = _automaton(t for _, _, t in texts)
                    elif automaton is not None:
                        yield from ((x, y) for _, _, y in texts for x in {w for _, w in automaton.iter(y)})

        yield from rows(pairs())

    return dealt.unionByName(visits).repartition("part").sortWithinPartitions("part", "side").mapInArrow(serve, schema)


def token_pairs(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, tokens, threshold: float) -> DataFrame:
    """Distinct ``keys + [a, b]`` that can reach a token Jaccard of ``threshold``. Tokens are ordered by how many distinct texts hold them, so a text's prefix is worked out once, whatever its keys."""
    def toks(df, name):
        return df.select(name).distinct().select(name, F.explode(tokens(F.col(name))).alias("tok"))

    lt, rt = toks(left, a), toks(right, b)
    freq = lt.select("tok").unionByName(rt.select("tok")).groupBy("tok").agg(F.count("*").alias("f"))

    def prefix(df, held, name):
        ranked = held.join(freq, "tok").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("f", "tok"))).alias("r"))
        keep = F.size("r") - F.ceil(F.size("r") * threshold - 1e-9) + 1
        first = ranked.select(name, F.explode(F.slice("r", 1, keep.cast("int"))["tok"]).alias("tok"))
        return df.select(*keys, name).distinct().join(first, name)

    return prefix(left, lt, a).join(prefix(right, rt, b), [*keys, "tok"]).select(*keys, a, b).distinct()
