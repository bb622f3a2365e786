"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.shared import durable
from ledgerloom.llm.textkit import NOT_BLANK, words

BITS = 64


def _fingerprints(column: pa.Array, k: int) -> np.ndarray:
    out = np.zeros(len(column), dtype=np.uint64)
    for w in words(column, NOT_BLANK):
        if not len(w.start):
            continue
        # Words with one space after each, so that a shingle is one stretch of bytes.
        keep = np.zeros(len(w.buffer) + 1, dtype=np.int32)
        keep[w.start] += 1
        keep[w.end] -= 1
        inside = np.cumsum(keep)[:-1].astype(bool)
        length = w.end - w.start
        start = np.concatenate(([0], np.cumsum(length + 1)[:-1]))
        joined = np.full(int(length.sum()) + len(length), 0x20, dtype=np.uint8)
        text = np.ones(len(joined), dtype=bool)
        text[start + length] = False
        joined[text] = w.buffer[inside]
        count = w.count()
        many = np.where(count == 0, 0, np.maximum(count - k + 1, 1))
        before = np.cumsum(count) - count
        row = np.repeat(np.arange(w.rows), many)
        first = before[row] + np.arange(len(row)) - (np.cumsum(many) - many)[row]
        last = np.minimum(first + k, (before + count)[row]) - 1
        view, h = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
        hashes = np.array([h(view[a:b], 42) for a, b in zip(start[first].tolist(), (start[last] + length[last]).tolist())], dtype=">u8")
        full = np.flatnonzero(many)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, (np.cumsum(many) - many)[full], axis=0, dtype=np.int32)
        print_bits = ones * 2 > many[full][:, None]
        out[w.first + full] = np.packbits(print_bits, axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """(id, fp long) for every row: bit i is set if it is set in over half of the shingles' hashes.

    Words are the runs between blanks after A-Z are lower-cased; a text of fewer than ``k`` words is one shingle, a text
    without words (or null) has fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_fingerprints(b.column(1), k).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, fp long")


def _cut(bits: int, parts: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``parts`` segments of nearly equal width."""
    at, out = 0, []
    for p in range(parts):
        width = bits // parts + (p < bits % parts)
        out.append((at, width))
        at += width
    return out


def _variants(fp: Column, segments: list[tuple[int, int]]) -> Column:
    """One key for each bit of each segment: the segment with this bit deleted, marked with the bit's place."""
    keys = []
    for low, width in segments:
        for bit in range(low, low + width):
            mask = ((1 << width) - 1) & ~(1 << bit - low)
            part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
            # Short segments give short numbers, which shuffle files pack better than hashes.
            keys.append(part + F.lit(bit << 24) if width <= 24 else F.xxhash64(F.lit(bit), part))
    return F.array(*keys)


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _cut_again(rows: DataFrame, segments: list[tuple[int, int]], parts: int) -> DataFrame:
    """``rows`` (key, bit, fp, root) of crowded buckets, under finer keys: the bucket's key and a variant of the bits outside its segment."""
    out, seen = None, 0
    for low, width in segments:
        if width == BITS:
            return rows.select("key", "bit", "fp", "root")
        # The bits outside this segment, moved together.
        rest = F.col("fp").bitwiseAND(F.lit((1 << low) - 1)) if low else F.shiftrightunsigned("fp", width)
        if low and low + width < BITS:
            rest = rest.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", low + width), low))
        here = rows.where(F.col("bit").between(seen, seen + width - 1)).select("key", "bit", "fp", "root", F.explode(_variants(rest, _cut(BITS - width, parts))).alias("second"))
        here = here.select(F.xxhash64("key", "second").alias("key"), "bit", "fp", "root")
        out, seen = here if out is None else out.unionAll(here), seen + width
    return out


def _first_shared(x: Column, segments: list[tuple[int, int]]) -> Column:
    """Whether ``bit`` marks the first of the buckets that two fingerprints share, ``x`` being the bits in which they differ: in any other
    bucket the pair need not be looked at again."""
    mask = lambda low, width: F.lit((m := ((1 << width) - 1) << low) - (1 << 64 if m >> 63 else 0))
    first, earlier = F.lit(False), F.lit(True)
    for low, width in segments:
        part = x.bitwiseAND(mask(low, width))
        first |= F.col("bit").between(low, low + width - 1) & earlier & ((F.col("bit") == low) | (part != 0))
        earlier &= F.bit_count(part) > 1
    return first


def _relabel(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with root replaced by the root of its root."""
    found = roots.withColumnsRenamed({"node": "_node", "root": "_root"})
    return rows.join(found, F.col("root") == F.col("_node"), "left").withColumn("root", F.coalesce("_root", "root")).drop("_node", "_root")


def _first_shared_rows(x: np.ndarray, bit: np.ndarray, segments: list[tuple[int, int]]) -> np.ndarray:
    """As ``_first_shared``, over arrays."""
    first, earlier = np.zeros(len(x), dtype=bool), np.ones(len(x), dtype=bool)
    for low, width in segments:
        part = x & np.uint64(((1 << width) - 1) << low)
        first |= (bit >= low) & (bit < low + width) & earlier & ((bit == low) | (part != 0))
        earlier &= np.bitwise_count(part) > 1
    return first


def _links_within(key: np.ndarray, bit: np.ndarray, fp: np.ndarray, segments: list[tuple[int, int]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of rows sorted by key, each in the first bucket it shares. Two that are both near the smallest member of
    their bucket are left to their links with it."""
    x = fp.view(np.uint64)
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
    hub = np.minimum.reduceat(fp, start)[run]
    led = (np.bitwise_count(x ^ hub.view(np.uint64)) <= most) & (fp != hub)
    a, b = [], []
    at = np.flatnonzero(run[1:] == run[:-1])
    d = 1
    while len(at):
        apart = x[at] ^ x[at + d]
        near = (np.bitwise_count(apart) <= most) & (bit[at] == bit[at + d]) & ~(led[at] & led[at + d])
        i = at[near]
        i = i[_first_shared_rows(apart[near], bit[i], segments)]
        a.append(fp[i])
        b.append(fp[i + d])
        d += 1
        at = at[at + d < len(run)]
        at = at[run[at] == run[at + d]]
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _bucket_links(rows: DataFrame, segments: list[tuple[int, int]], most: int) -> DataFrame:
    """Links (a, b) inside the buckets of ``rows`` (key, bit, fp), which must be small: a task holds a batch and one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int8), np.zeros(0, dtype=np.int64)]
        for batch in batches:
            held = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns)]
            if not len(held[0]):
                continue
            # The last bucket may go on in the next batch.
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                a, b = _links_within(*[h[:cut] for h in held], segments, most)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                held = [h[cut:] for h in held]
        if len(held[0]):
            a, b = _links_within(*held, segments, most)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    placed = rows.select("key", F.col("bit").cast("byte").alias("bit"), "fp").repartition("key").sortWithinPartitions("key")
    return placed.mapInArrow(run, "a long, b long")


def _pairs_of_crowds(crowded: DataFrame, heaps: DataFrame | None, classed: DataFrame, segments: list[tuple[int, int]], most: int, crowd: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(``classed`` relabelled, pairs of roots still to be joined) from ``crowded`` (key, bit, fp, root), the members of crowded buckets."""
    heaped = None
    if heaps is not None:
        marked = crowded.join(heaps, "key", "left")
        heaped, crowded = marked.where("heaped").drop("heaped"), marked.where("heaped IS NULL").drop("heaped")
    bucket = Window.partitionBy("key")
    sides = {"lo": F.min("root").over(bucket), "hi": F.max("root").over(bucket), "n": F.count("*").over(bucket)}
    mixed = durable(crowded.withColumns(sides).where("lo < hi").select("key", "bit", "fp", "root", "n"))
    for salt in range(rounds):
        hub = F.min_by(F.struct("fp", "root"), F.xxhash64(F.lit(salt), F.col("fp"))).over(bucket)
        met = mixed.withColumn("hub", hub).where((F.col("root") != F.col("hub.root")) & (_distance("fp", "hub.fp") <= most))
        roots = components(met.select(F.least("root", "hub.root").alias("a"), F.greatest("root", "hub.root").alias("b")), rounds=1)
        classed = durable(_relabel(classed, roots))
        mixed = durable(_relabel(mixed.drop("n"), roots).withColumns(sides).where("lo < hi").select("key", "bit", "fp", "root", "n"))
        heaped = None if heaped is None else _relabel(heaped, roots)
    large = mixed.where(F.col("n") > crowd).drop("n")
    fine = mixed.where(F.col("n") <= crowd).drop("n").unionByName(_cut_again(large if heaped is None else large.unionByName(heaped), segments, -(-(most + 1) // 2)))
    a, b = fine.select("key", "bit", F.col("fp").alias("a"), F.col("root").alias("ra")), fine.select("key", F.col("fp").alias("b"), F.col("root").alias("rb"))
    near = (_distance("a", "b") <= most) & _first_shared(F.col("a").bitwiseXOR(F.col("b")), segments)
    pairs = a.join(b, "key").where((F.col("ra") < F.col("rb")) & near)
    return classed, pairs.select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def link_fingerprints(prints: DataFrame, most: int = 4, crowd: int = 64, heap: int = 1 << 17, rounds: int = 2, sent: int = 1 << 18) -> DataFrame:
    """``prints`` (fp, distinct) to (fp, root): classes of fingerprints linked by at most ``most`` differing bits, exactly.

    The 64 bits are cut into so few segments that two near fingerprints have one that differs by at most one bit; such
    segments share the variant that deletes this bit. Buckets of equal variants are counted first, then

    1. buckets of at most ``crowd`` members are compared member by member, one after the other in key order, and give links only;
    2. in larger ones every member is compared with the smallest; this already joins dense groups, without pairs. Components are taken
       for a few rounds only: classes that stay apart are met again, and the last step goes to the end;
    3. larger buckets with members of different classes are still searched: ``rounds`` times against one more member, drawn by hash, then
       member against member of another class, each pair in the first bucket it shares. Where over
       ``crowd`` of these meet, the bits outside the shared segment are cut into variants once more. Buckets of over ``heap`` members are
       cut so from the start and never brought together whole.

    The keys of larger buckets are broadcast up to ``sent`` of them; beyond that they are shuffled.
    """
    segments = _cut(BITS, max(1, -(-(most + 1) // 2)))
    keys = lambda rows: rows.select(*rows.columns, F.posexplode(_variants(F.col("fp"), segments)).alias("bit", "key"))
    many = durable(keys(prints).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd))
    counts = many.agg(F.count("*").alias("keys"), F.count_if(F.col("n") > heap).alias("heaps")).first()
    large = F.broadcast(many) if counts["keys"] <= sent else many
    small = durable(_bucket_links(keys(prints).join(large, "key", "left_anti") if counts["keys"] else keys(prints), segments, most))
    if not counts["keys"]:
        return _relabel(prints.withColumn("root", F.col("fp")), components(small))

    held = keys(prints).join(large.select("key"), "key")
    hubs = held.groupBy("key").agg(F.min("fp").alias("hub"))
    hubs = F.broadcast(hubs) if counts["keys"] <= sent else hubs
    near = held.join(hubs, "key").where((F.col("fp") != F.col("hub")) & (_distance("fp", "hub") <= most))
    first = components(small.unionAll(near.select(F.col("hub").alias("a"), F.col("fp").alias("b"))), rounds=2)
    classed = durable(_relabel(prints.withColumn("root", F.col("fp")), first))
    heaps = many.where(F.col("n") > heap).select("key", F.lit(True).alias("heaped")) if counts["heaps"] else None
    crowded = keys(classed).join(large.select("key"), "key").select("key", "bit", "fp", "root")
    classed, pairs = _pairs_of_crowds(crowded, heaps, classed, segments, most, crowd, rounds)
    for end in ("a", "b"):
        named = classed.select(F.col("fp").alias(end), F.col("root").alias(f"r{end}"))
        small = small.join(named, end)
    rest = small.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    return _relabel(classed, components(pairs.unionAll(rest)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, most: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest id reachable over links of at most ``most`` differing bits, the row's own included.
    Repeated rows each get a row; null and empty texts share fingerprint zero and link like any other; a null id is passed
    over when the smallest is sought (null only if no member has an id). An empty table gives an empty result.
    """
    marked = durable(fingerprints(docs, id_col, text_col, k))
    own = durable(marked.groupBy("fp").agg(F.min("id").alias("least")))
    classes = link_fingerprints(own.select("fp"), most)
    named = durable(classes.join(own, "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = durable(named.join(least, "root").select("fp", "component_id"))
    return marked.join(by_print, "fp").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
