"""License scan by diagonal voting."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.grams import KEY, gram_rows, keyed
from ledgerloom.llm.textkit import LETTERS, grams, hash_words, signed, word_hashes, words

K = 3

# Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Public license notices and texts, by label; several templates may share a label.
TEMPLATES = [
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
]


def tokens(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], k: int = K) -> DataFrame:
    """(template, label, size, tpos, gram): ``size`` grams in a template; as many rows as the templates have words."""
    rows = []
    for n, (label, text) in enumerate(templates):
        h = hash_words(tokens(text))
        at, g = grams(h, np.zeros(len(h), np.int64), k)
        rows += [(n, label, len(at), int(p), int(x)) for p, x in zip(at, signed(g))]
    return spark.createDataFrame(rows, "template int, label string, size int, tpos int, gram long")


def spans(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = K, slack: int = 3, least: float = 0.6) -> DataFrame:
    """``docs`` (doc_id, tk, text) to (doc_id, tk, label, start, end, cover): stretches of words that follow a template.

    All word k-grams are joined to the templates' grams (a broadcast of a few hundred fixed rows). A hit votes for its diagonal, text place
    minus template place. Diagonals at most ``slack`` words apart are merged as long as the places on them are no further apart than the
    template is long, so inserted or left-out words do not break a stretch. A stretch is verified by the share of the template's grams that
    it holds, each counted once: ``least`` of them are asked for.
    """
    voting = gram_rows(docs, LETTERS, word_hashes, k).join(F.broadcast(template_grams(docs.sparkSession, templates, k)), "gram")
    hits = voting.select("doc_id", "tk", "template", "label", "size", "pos", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal")).distinct()
    along = Window.partitionBy("doc_id", "tk", "template").orderBy("diagonal", "pos")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > slack) | (F.col("pos") - F.lag("pos").over(along) > F.col("size") + k + slack), F.lit(False))
    merged = hits.withColumn("cut", apart.cast("int")).withColumn("stretch", F.sum("cut").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    found = merged.groupBy("doc_id", "tk", "template", "label", "size", "stretch").agg(F.min("pos").alias("start"), (F.max("pos") + k).alias("end"), F.count_distinct("tpos").alias("held"))
    return found.withColumn("cover", F.col("held") / F.col("size")).where(F.col("cover") >= least).select("doc_id", "tk", "label", "start", "end", "cover")


def base_hits(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, tk, text) to one row each: n_words, n_base, first_word, last_word, base (labels, sorted)."""
    phrases = [(p.split(), label) for p, label in PHRASES.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [hash_words(p) for p, _ in phrases]
        for b in batches:
            for w in words(b.column(2), LETTERS):
                h, place, count = word_hashes(w), w.place(), w.count()
                n, first, last = np.zeros(w.rows, np.int64), np.full(w.rows, 1 << 62), np.full(w.rows, -1)
                labels = [set() for _ in range(w.rows)]
                for (phrase, label), ph in zip(phrases, hashes):
                    m = len(phrase)
                    for i in np.flatnonzero(h[: max(0, len(h) - m + 1)] == ph[0]).tolist():
                        same = w.row[i] == w.row[i + m - 1] and all(w.buffer[w.start[i + j] : w.end[i + j]].tobytes() == phrase[j].encode() for j in range(m))
                        if same:
                            r = w.row[i]
                            n[r] += 1
                            first[r], last[r] = min(first[r], place[i]), max(last[r], place[i])
                            labels[r].add(label)
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(w.first, w.rows), b.column(1).slice(w.first, w.rows), pa.array(count.astype(np.int64)), pa.array(n), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([sorted(x) for x in labels], pa.list_(pa.string()))],
                    names=["doc_id", "tk", "n_words", "n_base", "first_word", "last_word", "base"],
                )

    return docs.mapInArrow(run, f"{KEY}, n_words long, n_base long, first_word long, last_word long, base array<string>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: base_hits, spans (label, start, end, cover; sorted), labels and score.

    labels are those of base phrases and of spans, distinct and sorted; score is the best cover of a span, at least 0.5 where a base phrase stands,
    else 0. Null and empty texts have no words and no labels; repeated rows each get their row; an empty table gives none.
    """
    rows = keyed(docs, id_col, text_col)
    per_doc = spans(rows, templates).groupBy(F.col("doc_id").alias("d"), F.col("tk").alias("k")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "label", "cover"))).alias("spans"))
    joined = base_hits(rows).join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("k")), "left")
    held = F.coalesce("spans", F.array().cast(per_doc.schema["spans"].dataType))
    best = F.coalesce(F.array_max(F.transform(held, lambda s: s["cover"])), F.lit(0.0))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base", held.alias("spans"),
        F.array_sort(F.array_distinct(F.concat("base", F.transform(held, lambda s: s["label"])))).alias("labels"),
        F.greatest(best, F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
