"""Bilingual glossary: building it from matched rows and reading labels through it.

Dictionaries are (ko, en, ord); ``ord`` is the order of entry.  Only distinct
texts are looked up, and the result is joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import translate_date
from ledgerloom.functions.fuzzy import best_fuzzy, sequence_ratio
from ledgerloom.functions.numbers import DASHES, is_amount_cell, is_number_text
from ledgerloom.functions.text import bare_title, clean_label, is_english, is_korean, normalize_number, strip
from ledgerloom.operators.labels import contained_pairs
from ledgerloom.session import durable, once

# Fixed values
SOURCES = ["ifrs", "title_map", "title_match", "header_match", "value_match"]  # rising priority
OPEN_MARK = "[NEEDS_TRANSLATION: "


def mark_open(text: Column) -> Column:
    return F.concat(F.lit(OPEN_MARK), text, F.lit("]"))


def lookup(texts: DataFrame, text: str, dictionary: DataFrame, out: str) -> DataFrame:
    """Exact entry of the trimmed text."""
    d = dictionary.groupBy("ko").agg(F.min_by("en", "ord").alias(out)).withColumnRenamed("ko", "_k")
    return texts.withColumn("_k", strip(text)).join(d, "_k", "left").drop("_k")


def lookup_longest(texts: DataFrame, text: str, dictionary: DataFrame, out: str) -> DataFrame:
    """The longest entry found inside the text, the first of equals; adds ``out`` and ``out_key``."""
    t = texts.select(strip(text).alias("_t")).distinct()
    hits = contained_pairs(dictionary.select("ko"), t, [], "ko", "_t").join(dictionary, "ko")
    best = hits.groupBy("_t").agg(F.min(F.struct((-F.length("ko")).alias("n"), "ord", "ko", "en")).alias("m"))
    best = best.select("_t", F.col("m.en").alias(out), F.col("m.ko").alias(f"{out}_key"))
    return texts.withColumn("_t", strip(text)).join(best, "_t", "left").drop("_t")


def contained_either_way(texts: DataFrame, text: str, dictionary: DataFrame) -> DataFrame:
    """The first entry that is in the text or holds it: distinct text, ko, en."""
    t = texts.select(strip(text).alias("_t")).where("_t <> ''").distinct()
    d = dictionary.select("ko")
    hits = contained_pairs(d, t, [], "ko", "_t").unionByName(contained_pairs(t, d, [], "_t", "ko").select("ko", "_t")).distinct().join(dictionary, "ko")
    best = hits.groupBy("_t").agg(F.min(F.struct((F.col("ko") != F.col("_t")).alias("x"), "ord", "ko", "en")).alias("m"))
    return best.select(F.col("_t").alias("text"), F.col("m.ko").alias("ko"), F.col("m.en").alias("en"))


def term_match(texts: DataFrame, text: str, terms: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Exact, then containment either way, then the most similar term: distinct text, ko, en."""
    held = durable(contained_either_way(texts, text, terms))
    rest = texts.select(strip(text).alias("a")).where("a <> ''").distinct().join(held.select(F.col("text").alias("a")), "a", "left_anti")
    return held.unionByName(best_fuzzy(rest, terms, threshold).select(F.col("a").alias("text"), "ko", "en"))


def translate_labels(texts: DataFrame, text: str, glossary: DataFrame, terms: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """Distinct labels in English: glossary and terms exactly, then in part, then a model's answer, then a mark.

    ``model``: optional (ko, en) answers obtained elsewhere.
    """
    t = durable(texts.select(strip(text).alias("label")).distinct())
    open_ = is_korean("label") & ~is_number_text("label")
    need = t.where(open_)
    r = lookup(need, "label", glossary, "g1")
    r = lookup(r, "label", terms, "t1")
    r = lookup_longest(r, "label", glossary, "g2")
    r = lookup_longest(r, "label", terms, "t2")
    answers = F.lit(None).cast("string")
    if model is not None:
        r = r.join(model.select(F.col("ko").alias("label"), F.col("en").alias("m1")), "label", "left")
        answers = F.col("m1")
    done = r.select("label", F.coalesce("g1", "t1", "g2", "t2", answers, mark_open(F.col("label"))).alias("english"))
    return done.unionByName(t.where(~open_).select("label", F.col("label").alias("english")))


def translate_paragraphs(texts: DataFrame, text: str, glossary: DataFrame, terms: DataFrame) -> DataFrame:
    """Paragraphs in English: short ones exactly, longer ones only by an entry that covers 70 % of them."""
    t = durable(texts.select(strip(text).alias("paragraph")).distinct())
    need = t.where(is_korean("paragraph"))
    r = lookup(need, "paragraph", glossary, "g1")
    r = lookup(r, "paragraph", terms, "t1")
    r = lookup_longest(r, "paragraph", glossary, "g2")
    short = (F.length("paragraph") < 40) & ~F.col("paragraph").contains("\n")
    covers = F.length("g2_key") >= F.length("paragraph") * 0.7
    english = F.coalesce(F.when(short, F.coalesce("g1", "t1")), F.when(covers, F.col("g2")), mark_open(F.col("paragraph")))
    return r.select("paragraph", english.alias("english")).unionByName(t.where(~is_korean("paragraph")).select("paragraph", F.col("paragraph").alias("english")))


def translate_titles(texts: DataFrame, text: str, glossary: DataFrame, terms: DataFrame) -> DataFrame:
    """Note titles in English, with and without their number, then in part."""
    t = durable(texts.select(strip(text).alias("title")).distinct())
    r = t.where(is_korean("title")).withColumn("bare", bare_title("title"))
    for src, name in ((glossary, "g"), (terms, "t")):
        r = lookup(r, "bare", src, name + "b")
        r = lookup(r, "title", src, name + "f")
    r = lookup_longest(r, "bare", glossary, "gp")
    english = F.coalesce("gb", "gf", "tb", "tf", "gp", mark_open(F.col("title")))
    return r.select("title", english.alias("english")).unionByName(t.where(~is_korean("title")).select("title", F.col("title").alias("english")))


def translate_changes(changes: DataFrame, keys: list[str], glossary: DataFrame, terms: DataFrame) -> DataFrame:
    """Change texts in English by kind: labels, paragraphs, titles, and table rows part by part.

    ``changes``: keys, kind (label|paragraph|title|table_row), value.
    """
    c = changes.withColumn("parts", F.when(F.col("kind") == "table_row", F.split("value", " \\| ")).otherwise(F.array("value")))
    p = c.select(*keys, "kind", F.posexplode("parts").alias("n", "part")).withColumn("t", strip("part"))
    labels = translate_labels(p.where("kind in ('label', 'table_row')"), "t", glossary, terms).select(F.col("label").alias("t"), F.lit("l").alias("how"), "english")
    paras = translate_paragraphs(p.where("kind = 'paragraph'"), "t", glossary, terms).select(F.col("paragraph").alias("t"), F.lit("p").alias("how"), "english")
    titles = translate_titles(p.where("kind = 'title'"), "t", glossary, terms).select(F.col("title").alias("t"), F.lit("t").alias("how"), "english")
    how = F.when(F.col("kind") == "paragraph", "p").when(F.col("kind") == "title", "t").otherwise("l")
    j = p.withColumn("how", how).join(labels.unionByName(paras).unionByName(titles), ["t", "how"], "left")
    text = F.when(is_korean("part"), F.col("english")).otherwise(F.col("part"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("x")))), lambda s: s["x"])
    return j.groupBy(*keys, "kind").agg(F.array_join(parts, " | ").alias("value"))


def translate_in_tiers(texts: DataFrame, text: str, prior: DataFrame, terms: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Distinct texts with translation and tier: date, exact, ifrs, adjust (a similar prior text), ifrs again, new."""
    t = durable(texts.select(strip(text).alias("a")).where("a <> ''").distinct())
    r = lookup(t, "a", prior, "exact").withColumn("date", translate_date("a"))
    r = durable(r)
    rest = r.where("exact is null and date is null").select("a")
    term = term_match(rest, "a", terms).withColumnRenamed("text", "a")
    # certainty of a term is measured against its first key
    first = terms.groupBy("en").agg(F.min_by("ko", "ord").alias("k0"))
    term = term.join(first, "en").select("a", F.col("en").alias("term"), sequence_ratio("a", "k0").alias("sure"))
    near = best_fuzzy(rest, prior, threshold).select("a", F.col("ko").alias("near_ko"), F.col("en").alias("near"), F.col("ratio").alias("near_ratio"))
    r = r.join(term, "a", "left").join(near, "a", "left")
    tier = (F.when(F.col("date").isNotNull(), "date").when(F.col("exact").isNotNull(), "exact").when(F.col("sure") > 0.9, "ifrs")
            .when(F.col("near").isNotNull(), "adjust").when(F.col("term").isNotNull(), "ifrs").otherwise("new"))
    english = F.when(tier == "adjust", F.col("near")).otherwise(F.coalesce("date", "exact", "term"))
    return r.select(F.col("a").alias("text"), english.alias("english"), tier.alias("tier"))


def prior_translation(texts: DataFrame, text: str, glossary: DataFrame, terms: DataFrame) -> DataFrame:
    """Earlier translation of each distinct text with its source."""
    t = durable(texts.select(strip(text).alias("a")).where("a <> ''").distinct())
    r = lookup(t, "a", glossary, "exact").withColumn("date", translate_date("a"))
    r = durable(r)
    rest = r.where("exact is null and date is null").select("a")
    near = durable(best_fuzzy(rest, glossary, 0.6).select("a", F.col("en").alias("near")))
    far = term_match(rest.join(near.select("a"), "a", "left_anti"), "a", terms).select(F.col("text").alias("a"), F.col("en").alias("term"))
    r = r.join(near, "a", "left").join(far, "a", "left")
    source = (F.when(F.col("date").isNotNull(), "date conversion").when(F.col("exact").isNotNull(), "glossary (exact)").when(F.col("near").isNotNull(), "glossary (fuzzy)")
              .when(F.col("term").isNotNull(), "terms").otherwise("none"))
    return r.select(F.col("a").alias("text"), F.coalesce("date", "exact", "near", "term").alias("english"), source.alias("source"))


# --- building ----------------------------------------------------------------

def pairs_by_signature(ko_rows: DataFrame, en_rows: DataFrame) -> DataFrame:
    """Labels of rows that carry the same numbers: pair_id, ko, en.

    Rows: pair_id, seq, label, numbers (ordered array).  A signature shared by
    more than three English rows proves nothing; of two or three the first counts.
    """
    e = once(en_rows.where(is_english("label")), "numbers").where(F.size("numbers") > 0).groupBy("pair_id", "numbers").agg(
        F.min_by("label", "seq").alias("en"), F.count("*").alias("n")).where("n <= 3")
    k = once(ko_rows.where(is_korean("label")), "numbers").where(F.size("numbers") > 0)
    j = k.join(e, ["pair_id", "numbers"]).select("pair_id", "seq", clean_label("label").alias("ko"), clean_label("en").alias("en"))
    return j.groupBy("pair_id", "ko").agg(F.max_by("en", "seq").alias("en"))


def pairs_by_number(ko_notes: DataFrame, en_notes: DataFrame) -> DataFrame:
    """Titles of notes with the same number: pair_id, ko, en."""
    num = F.regexp_replace(strip("number"), r"\.+$", "")
    e = en_notes.withColumn("num", num).where("num <> ''").groupBy("pair_id", "num").agg(F.max_by(clean_label("title"), "note_seq").alias("en"))
    k = ko_notes.select("pair_id", num.alias("num"), "note_seq", clean_label("title").alias("ko"))
    j = k.join(e, ["pair_id", "num"]).where((F.col("ko") != "") & (F.col("en") != "") & is_korean("ko") & is_english("en"))
    return j.groupBy("pair_id", "ko").agg(F.max_by("en", "note_seq").alias("en"))


def pairs_by_ordinal(ko_tables: DataFrame, en_tables: DataFrame) -> DataFrame:
    """Titles and unit notes of tables at the same place: pair_id, ko, en.  Tables: pair_id, nth, title, unit_text."""
    j = ko_tables.join(en_tables.select("pair_id", "nth", F.col("title").alias("et"), F.col("unit_text").alias("eu")), ["pair_id", "nth"])
    titles = j.select("pair_id", "nth", clean_label("title").alias("ko"), clean_label("et").alias("en")).where(is_korean("ko") & is_english("en"))
    units = j.select("pair_id", "nth", strip("unit_text").alias("ko"), strip("eu").alias("en")).where("ko <> '' and en <> ''")
    return titles.unionByName(units).groupBy("pair_id", "ko").agg(F.max_by("en", "nth").alias("en"))


def pairs_by_rows(rows: DataFrame) -> DataFrame:
    """Labels of matched rows: pair_id, ko, en.  ``rows``: pair_id, seq, src_label, tpl_label."""
    r = rows.select("pair_id", "seq", strip("src_label").alias("ko"), strip("tpl_label").alias("en"))
    digits = F.translate("en", ",()-", "").rlike(r"^\s*[0-9]+\s*$")
    r = r.where((F.col("ko") != "") & ~F.col("en").isin("", *DASHES) & ~(is_amount_cell("en") & digits) & (F.col("ko") != F.col("en")))
    return r.groupBy("pair_id", "ko").agg(F.max_by("en", "seq").alias("en"))


def merge_glossaries(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One entry per term: the source of highest priority wins and is remembered.

    ``parts``: source name -> (keys, ko, en, ord).  The lowest source keeps its
    first entry of a term, the others their last.
    """
    def ranked(name: str) -> DataFrame:
        rank = SOURCES.index(name)
        order = -F.col("ord") if rank == 0 else F.col("ord")
        return parts[name].select(*keys, F.trim("ko").alias("ko"), F.trim("en").alias("en"), F.lit(name).alias("source"), F.lit(rank).alias("rank"), order.cast("bigint").alias("o"))

    u = reduce(lambda a, b: a.unionByName(b), [ranked(n) for n in SOURCES if n in parts]).where("ko <> '' and en <> ''")
    best = u.groupBy(*keys, "ko").agg(F.max(F.struct("rank", "o", "en", "source")).alias("m"))
    return best.select(*keys, "ko", F.col("m.en").alias("en"), F.col("m.source").alias("source"))


def context_entries(dictionary: DataFrame, texts: DataFrame, text: str, limit: int | None = None, fallback: int | None = None) -> DataFrame:
    """Entries worth showing for the texts, with the number of their letters that the texts hold (hits), blanks aside.

    Whole texts are read. Entries without a hit come only if no entry has one. ``limit`` keeps the entries of most hits, the
    first of equals; ``fallback`` the first entries where none has a hit. Columns: ko, en, ord, hits.
    """
    letters = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, ""), lambda x: F.trim(x) != "")))
    used = texts.select(letters(strip(text)).alias("ch")).distinct()
    hits = dictionary.select("ko").distinct().select("ko", letters(F.col("ko")).alias("ch")).join(used, "ch").groupBy("ko").agg(F.count("*").alias("hits"))
    rated = dictionary.join(hits, "ko", "left").select("ko", "en", "ord", F.coalesce("hits", F.lit(0).cast("long")).alias("hits")).withColumn("_some", F.col("hits") > 0)
    shown = rated.join(rated.agg(F.max("_some").alias("_some")), "_some", "left_semi").drop("_some")
    some, plain = shown.where("hits > 0"), shown.where("hits = 0")
    if limit is not None:
        some = some.orderBy(F.desc("hits"), "ord").limit(limit)
    if fallback is not None:
        plain = plain.orderBy("ord").limit(fallback)
    return some.unionByName(plain)


def tier_counts(tiers: DataFrame) -> DataFrame:
    return tiers.groupBy("tier").agg(F.count("*").alias("n"))
