"""Which template note continues which source note.

Notes: pair_id, note_id, note_seq, number, title.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import bare_title, normalize_number, word_tokens
from ledgerloom.operators.assign import greedy
from ledgerloom.operators.labels import contained_pairs
from ledgerloom.session import durable


def read_titles(notes: DataFrame, title_map: DataFrame) -> DataFrame:
    """Add ``en``: the title read in English through the title dictionary, NULL if unknown."""
    m = title_map.groupBy("ko").agg((F.min_by("en", "ord") if "ord" in title_map.columns else F.min("en")).alias("en"))
    t = notes.withColumns({"t0": F.trim("title"), "t1": bare_title("title")})
    t = t.join(m.select(F.col("ko").alias("t0"), F.col("en").alias("e0")), "t0", "left")
    t = t.join(m.select(F.col("ko").alias("t1"), F.col("en").alias("e1")), "t1", "left")
    return t.withColumn("en", F.coalesce("e0", "e1")).drop("e0", "e1", "t0")


def title_similarities(src: DataFrame, tpl: DataFrame, title_map: DataFrame) -> DataFrame:
    """Pairs of notes of one document pair with a title similarity above zero.

    Known titles are compared by shared words, so only notes that share a word
    meet.  Unknown ones go through dictionary entries found inside both titles.
    """
    s = durable(read_titles(src, title_map).select("pair_id", F.col("note_id").alias("s_id"), "t1", "en"))
    t = tpl.select("pair_id", F.col("note_id").alias("t_id"), "title").withColumn("tw", word_tokens("title"))
    known = s.where("en is not null").withColumn("sw", word_tokens("en"))
    shared = (
        known.select("pair_id", "s_id", F.size("sw").alias("ns"), F.explode("sw").alias("w"))
        .join(t.select("pair_id", "t_id", F.size("tw").alias("nt"), F.explode("tw").alias("w")), ["pair_id", "w"])
        .groupBy("pair_id", "s_id", "t_id").agg(F.count("*").alias("c"), F.first("ns").alias("ns"), F.first("nt").alias("nt"))
        .select("pair_id", "s_id", "t_id", (F.col("c").cast("double") / (F.col("ns") + F.col("nt") - F.col("c")).cast("double")).alias("sim"))
    )
    unknown = s.where("en is null")
    d = title_map.select("ko", F.lower("en").alias("term"))
    low = t.withColumn("low", F.lower("title"))
    in_title = contained_pairs(d, low, [], "term", "low")
    in_source = contained_pairs(d, unknown, [], "ko", "t1").unionByName(
        contained_pairs(unknown, d, [], "t1", "ko").select("ko", "t1"))
    via = (
        unknown.join(in_source.distinct(), "t1").join(d, "ko").select("pair_id", "s_id", "term").distinct()
        .join(low.join(in_title, "low").select("pair_id", "t_id", "term", F.length("low").alias("n")), ["pair_id", "term"])
        .groupBy("pair_id", "s_id", "t_id")
        .agg(F.max(F.length("term").cast("double") / F.greatest("n", F.lit(1)).cast("double")).alias("sim"))
    )
    return shared.unionByName(via)


def match_notes(src: DataFrame, tpl: DataFrame, title_map: DataFrame) -> DataFrame:
    """Each source note with its template note, confidence and method.

    Equal numbers win with a fitting title; with a poor one they win unless a
    title elsewhere fits clearly better.  The rest is matched by title alone.
    """
    sims = durable(title_similarities(src, tpl, title_map))
    s = src.select("pair_id", F.col("note_id").alias("s_id"), F.col("note_seq").alias("s_seq"), normalize_number("number").alias("num"))
    t = tpl.select("pair_id", F.col("note_id").alias("t_id"), F.col("note_seq").alias("t_seq"), normalize_number("number").alias("num"))
    # the last template note of a number stands for it
    by_number = t.where("num <> '0'").groupBy("pair_id", "num").agg(F.max_by("t_id", "t_seq").alias("t_id"))
    rival_s = sims.withColumnRenamed("s_id", "o_id").select("pair_id", "t_id", "o_id", "sim")
    rival_t = sims.withColumnRenamed("t_id", "o_id").select("pair_id", "s_id", "o_id", "sim")
    numbered = s.join(by_number, ["pair_id", "num"]).join(sims, ["pair_id", "s_id", "t_id"], "left").withColumn(
        "sim", F.coalesce("sim", F.lit(0.0)))
    other_s = numbered.select("pair_id", "s_id", "t_id").join(rival_s, ["pair_id", "t_id"]).where("o_id <> s_id").groupBy(
        "pair_id", "s_id", "t_id").agg(F.max("sim").alias("rs"))
    other_t = numbered.select("pair_id", "s_id", "t_id").join(rival_t, ["pair_id", "s_id"]).where("o_id <> t_id").groupBy(
        "pair_id", "s_id", "t_id").agg(F.max("sim").alias("rt"))
    judged = numbered.join(other_s, ["pair_id", "s_id", "t_id"], "left").join(other_t, ["pair_id", "s_id", "t_id"], "left")
    keep = (F.col("sim") >= 0.3) | ((F.coalesce("rs", F.lit(0.0)) < 0.4) & (F.coalesce("rt", F.lit(0.0)) < 0.5))
    first = durable(judged.where(keep).select(
        "pair_id", "s_id", "t_id", (0.8 + 0.2 * F.col("sim")).alias("confidence"),
        F.when(F.col("sim") >= 0.3, "number+title").otherwise("number").alias("method")))
    rest = s.join(first.select("pair_id", "s_id"), ["pair_id", "s_id"], "left_anti")
    free = t.join(first.select("pair_id", "t_id"), ["pair_id", "t_id"], "left_anti")
    edges = (
        sims.where("sim >= 0.4").join(rest, ["pair_id", "s_id"]).join(free.drop("num"), ["pair_id", "t_id"])
        .select("pair_id", F.struct("s_seq", "s_id").alias("l"), F.struct("t_seq", "t_id").alias("r"), F.col("sim").alias("s"),
                F.struct("t_seq", "t_id").alias("o"))
    )
    by_title = greedy(edges, ["pair_id"]).select(
        "pair_id", F.col("l.s_id").alias("s_id"), F.col("r.t_id").alias("t_id"), F.col("s").alias("confidence"), F.lit("title").alias("method"))
    found = durable(first.unionByName(by_title))
    lost = s.join(found.select("pair_id", "s_id"), ["pair_id", "s_id"], "left_anti").select(
        "pair_id", "s_id", F.lit(None).cast("string").alias("t_id"), F.lit(0.0).alias("confidence"), F.lit("unmatched").alias("method"))
    return found.unionByName(lost)


def unmatched_template_notes(matches: DataFrame, tpl: DataFrame) -> DataFrame:
    used = matches.where("t_id is not null").select("pair_id", F.col("t_id").alias("note_id"))
    return tpl.join(used, ["pair_id", "note_id"], "left_anti")
