"""Queries: dictionaries, translation cascades and glossary building."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import dates as d
from ledgerloom.functions import numbers as nb
from ledgerloom.functions import text as tx
from ledgerloom.operators import glossary as gl
from ledgerloom.plans import oracle as o
from ledgerloom.plans.registry import query

KO = "[가-힯㄰-㆏]"
LABELS = "(SELECT DISTINCT label || CASE WHEN n % 4 = 1 THEN ' 합계' WHEN n % 4 = 2 THEN ' (주)' ELSE '' END AS label FROM src_rows)"


def _labels(rows):
    tail = F.when(F.col("n") % 4 == 1, " 합계").when(F.col("n") % 4 == 2, " (주)").otherwise("")
    return rows.select(F.concat("label", tail).alias("label")).where("label is not null").distinct()


EXACT = "(SELECT MIN(en) FROM {d} d WHERE d.ko = {x})"
LONGEST = "(SELECT arg_min({v}, -length(d.ko) * 100000 + d.ord) FROM {d} d WHERE contains({x}, d.ko))"


def exact(d: str, x: str) -> str:
    return EXACT.format(d=d, x=x)


def longest(d: str, x: str, v: str = "d.en") -> str:
    return LONGEST.format(d=d, x=x, v=v)


@query("i01_dictionaries", ["terms", "title_map"], "SELECT ko, en, 'ifrs' AS kind FROM terms UNION ALL SELECT ko, en, 'title_map' FROM title_map")
def _i01(terms, titles):
    return terms.select("ko", "en", F.lit("ifrs").alias("kind")).unionByName(titles.select("ko", "en", F.lit("title_map").alias("kind")))


@query("i02_exact_lookup", ["src_rows", "terms"], f"SELECT label, {exact('terms', 'trim(label)')} AS en FROM {LABELS} q WHERE label IS NOT NULL")
def _i02(rows, terms):
    return gl.lookup(_labels(rows), "label", terms, "en")


@query("i03_longest_contained", ["src_rows", "terms"], f"SELECT label, {longest('terms', 'label')} AS en, {longest('terms', 'label', 'd.ko')} AS en_key FROM {LABELS} q WHERE label IS NOT NULL")
def _i03(rows, terms):
    return gl.lookup_longest(_labels(rows), "label", terms, "en")


@query("i04_contained_either_way", ["src_rows", "terms"], f"""
SELECT label AS text, arg_min(d.ko, CASE WHEN d.ko = label THEN 0 ELSE 1000000 END + d.ord) AS ko, arg_min(d.en, CASE WHEN d.ko = label THEN 0 ELSE 1000000 END + d.ord) AS en
FROM {LABELS} q JOIN terms d ON contains(label, d.ko) OR contains(d.ko, label) GROUP BY label""")
def _i04(rows, terms):
    return gl.contained_either_way(_labels(rows), "label", terms)


@query("i04_term_match", ["src_rows", "terms"])
def _i04f(rows, terms):
    return gl.term_match(_labels(rows), "label", terms)


@query("i05_best_fuzzy", ["src_rows", "terms"])
def _i05(rows, terms):
    return gl.best_fuzzy(_labels(rows).select(F.col("label").alias("a")), terms, 0.6)


GLOSS = "(SELECT '합계' AS ko, 'Total' AS en, CAST(0 AS BIGINT) AS ord UNION ALL SELECT ko || ' 합계', en || ' total', ord FROM terms WHERE ord % 2 = 0)"


def _gloss(terms):
    total = terms.limit(1).select(F.lit("합계").alias("ko"), F.lit("Total").alias("en"), F.lit(0).cast("bigint").alias("ord"))
    return total.unionByName(terms.where("ord % 2 = 0").select(F.concat("ko", F.lit(" 합계")).alias("ko"), F.concat("en", F.lit(" total")).alias("en"), "ord"))


OPEN = "'[NEEDS_TRANSLATION: ' || {x} || ']'"
LABEL_EN = (f"CASE WHEN NOT regexp_matches({{x}}, '{KO}') THEN {{x}} ELSE COALESCE(" + exact("gloss", "{x}") + ", " + exact("terms", "{x}") + ", "
            + longest("gloss", "{x}") + ", " + longest("terms", "{x}") + ", " + OPEN + ") END")


@query("i06_translate_labels", ["src_rows", "terms"], f"WITH gloss AS {GLOSS} SELECT label, {LABEL_EN.format(x='label')} AS english FROM {LABELS} q WHERE label IS NOT NULL")
def _i06(rows, terms):
    return gl.translate_labels(_labels(rows), "label", _gloss(terms), terms)


PARA_EN = (f"CASE WHEN NOT regexp_matches({{x}}, '{KO}') THEN {{x}} ELSE COALESCE(CASE WHEN length({{x}}) < 40 AND NOT contains({{x}}, chr(10)) THEN COALESCE(" + exact("gloss", "{x}") + ", "
           + exact("terms", "{x}") + ") END, CASE WHEN length(" + longest("gloss", "{x}", "d.ko") + ") >= length({x}) * 0.7 THEN " + longest("gloss", "{x}") + " END, " + OPEN + ") END")
PARAS = "(SELECT DISTINCT CASE WHEN doc_id % 4 = 0 THEN '합계 ' || text WHEN doc_id % 4 = 1 THEN text || ' 합계액' WHEN doc_id % 4 = 2 THEN text || ' 합계' ELSE text END AS p FROM documents)"


@query("i07_translate_paragraphs", ["documents", "terms"], f"WITH gloss AS {GLOSS}, pp AS (SELECT {o.strip('p')} AS paragraph FROM {PARAS} q) SELECT DISTINCT paragraph, {PARA_EN.format(x='paragraph')} AS english FROM pp")
def _i07(docs, terms):
    k = F.col("doc_id") % 4
    p = F.when(k == 0, F.concat(F.lit("합계 "), "text")).when(k == 1, F.concat("text", F.lit(" 합계액"))).when(k == 2, F.concat("text", F.lit(" 합계"))).otherwise(F.col("text"))
    return gl.translate_paragraphs(docs.select(p.alias("p")), "p", _gloss(terms), terms)


def bare(x: str) -> str:
    return o.strip(rf"regexp_replace({x}, '^[0-9.\s\-–—]+', '')")



TITLE_EN = (f"CASE WHEN NOT regexp_matches({{x}}, '{KO}') THEN {{x}} ELSE COALESCE(" + exact("title_map", "b") + ", " + exact("title_map", "{x}") + ", " + exact("terms", "b") + ", " + exact("terms", "{x}") + ", "
            + longest("title_map", "b") + ", " + OPEN + ") END")


@query("i08_translate_titles", ["src_notes", "title_map", "terms"], f"""
SELECT title, {TITLE_EN.format(x='title')} AS english FROM (SELECT DISTINCT title, {bare('title')} AS b FROM (SELECT title || CASE WHEN pair_id % 3 = 0 THEN ' 등' ELSE '' END AS title FROM src_notes) r) q""")
def _i08(notes, titles, terms):
    t = notes.select(F.concat("title", F.when(F.col("pair_id") % 3 == 0, " 등").otherwise("")).alias("title"))
    return gl.translate_titles(t, "title", titles, terms)


@query("i09_translate_changes", ["row_pairs", "terms"], f"""
WITH gloss AS {GLOSS}, c AS (SELECT pair_id, note_no, src_row, src_label AS a, CASE src_row % 3 WHEN 0 THEN 'label' WHEN 1 THEN 'table_row' ELSE 'paragraph' END AS kind, COALESCE(CAST(exp_cur AS VARCHAR), '-') AS v FROM row_pairs),
 la AS (SELECT x, {LABEL_EN.format(x='x')} AS le, {PARA_EN.format(x='x')} AS pe FROM (SELECT DISTINCT a AS x FROM c UNION SELECT '합계') q)
SELECT c.pair_id, c.note_no, c.src_row, c.kind, CASE kind WHEN 'label' THEN l.le WHEN 'paragraph' THEN l.pe ELSE l.le || ' | ' || v || ' | ' || z.le END AS value FROM c JOIN la l ON l.x = c.a JOIN la z ON z.x = '합계'""")
def _i09(rows, terms):
    k = F.col("src_row") % 3
    kind = F.when(k == 0, "label").when(k == 1, "table_row").otherwise("paragraph")
    row = F.concat_ws(" | ", "src_label", F.coalesce(F.col("exp_cur").cast("string"), F.lit("-")), F.lit("합계"))
    c = rows.select("pair_id", "note_no", "src_row", kind.alias("kind"), F.when(k == 1, row).otherwise(F.col("src_label")).alias("value"))
    return gl.translate_changes(c, ["pair_id", "note_no", "src_row"], _gloss(terms), terms)


@query("i10_translate_in_tiers", ["src_rows", "terms"])
def _i10(rows, terms):
    return gl.translate_in_tiers(_labels(rows), "label", _gloss(terms), terms)


@query("e24_tier_counts", ["src_rows", "terms"])
def _e24(rows, terms):
    return gl.tier_counts(gl.translate_in_tiers(_labels(rows), "label", _gloss(terms), terms))


@query("i11_prior_translation", ["src_rows", "terms"])
def _i11(rows, terms):
    return gl.prior_translation(_labels(rows), "label", _gloss(terms), terms)


def clean(x: str) -> str:
    return o.strip(rf"regexp_replace({x}, '^[0-9.)(①②③④⑤⑥⑦⑧⑨⑩\s]+', '')")



SEQ = "(note_seq * 1000 + src_row)"
SIGS = f"""ks AS (SELECT pair_id, {SEQ} AS seq, src_label AS label, concat_ws('|', exp_cur, exp_pri) AS sig FROM row_pairs),
 es AS (SELECT pair_id, {SEQ} AS seq, tpl_label AS label, concat_ws('|', CAST(NULLIF({o.whole('cur_text')}, 0) AS VARCHAR), CAST(NULLIF({o.whole('pri_text')}, 0) AS VARCHAR)) AS sig FROM filled),
 eg AS (SELECT pair_id, sig, arg_min(label, seq) AS en FROM es WHERE sig <> '' AND regexp_matches(label, '[a-zA-Z]') GROUP BY ALL HAVING COUNT(*) <= 3),
 sg AS (SELECT ks.pair_id, {clean('ks.label')} AS ko, arg_max({clean('eg.en')}, ks.seq) AS en FROM ks JOIN eg ON eg.pair_id = ks.pair_id AND eg.sig = ks.sig WHERE ks.sig <> '' AND regexp_matches(ks.label, '{KO}') GROUP BY 1, 2)"""


def _signatures(rows, filled):
    seq = (F.col("note_seq") * 1000 + F.col("src_row")).alias("seq")
    text = lambda c: F.col(c).cast("string")
    value = lambda c: F.nullif(nb.parse_whole(c).cast("bigint"), F.lit(0)).cast("string")
    k = rows.select("pair_id", seq, F.col("src_label").alias("label"), F.array_compact(F.array(text("exp_cur"), text("exp_pri"))).alias("numbers"))
    e = filled.select("pair_id", seq, F.col("tpl_label").alias("label"), F.array_compact(F.array(value("cur_text"), value("pri_text"))).alias("numbers"))
    return gl.pairs_by_signature(k, e)


@query("i12_glossary_by_signature", ["row_pairs", "filled"], f"WITH {SIGS} SELECT pair_id, ko, en FROM sg")
def _i12(rows, filled):
    return _signatures(rows, filled)


BYNUM = f"""bn AS (SELECT s.pair_id, {clean('s.title')} AS ko, arg_max(t.en, s.note_seq) AS en FROM src_notes s
  JOIN (SELECT pair_id, rtrim(trim(number), '.') AS num, arg_max({clean('title')}, note_seq) AS en FROM tpl_notes GROUP BY 1, 2) t ON t.pair_id = s.pair_id AND t.num = rtrim(trim(s.number), '.') GROUP BY 1, 2)"""


@query("i13_glossary_by_number", ["src_notes", "tpl_notes"], f"WITH {BYNUM} SELECT * FROM bn")
def _i13(s, t):
    return gl.pairs_by_number(s, t)


@query("i13_glossary_by_ordinal", ["src_notes", "tpl_notes"], f"""
WITH j AS (SELECT s.pair_id, s.note_seq, s.title AS st, t.title AS tt FROM src_notes s JOIN tpl_notes t ON t.pair_id = s.pair_id AND t.note_seq = s.note_seq),
 u AS (SELECT pair_id, note_seq, {clean('st')} AS ko, {clean('tt')} AS en FROM j UNION ALL SELECT pair_id, note_seq, '(단위: 원)', '(in thousands of Korean won)' FROM j)
SELECT pair_id, ko, arg_max(en, note_seq) AS en FROM u GROUP BY pair_id, ko""")
def _i13o(s, t):
    k = s.select("pair_id", F.col("note_seq").alias("nth"), "title", F.lit("(단위: 원)").alias("unit_text"))
    e = t.select("pair_id", F.col("note_seq").alias("nth"), "title", F.lit("(in thousands of Korean won)").alias("unit_text"))
    return gl.pairs_by_ordinal(k, e)


@query("i14_merge_glossaries", ["row_pairs", "filled", "src_notes", "tpl_notes", "terms", "title_map"], f"""
WITH {SIGS}, {BYNUM},
 u AS (SELECT -1 AS pair_id, ko, en, 'ifrs' AS source, 0 AS rank FROM terms UNION ALL SELECT -1, ko, en, 'title_map', 1 FROM title_map UNION ALL SELECT pair_id, ko, en, 'title_match', 2 FROM bn UNION ALL SELECT pair_id, ko, en, 'value_match', 4 FROM sg)
SELECT CAST(pair_id AS BIGINT) AS pair_id, ko, arg_max(en, rank) AS en, arg_max(source, rank) AS source FROM u WHERE trim(ko) <> '' AND trim(en) <> '' GROUP BY pair_id, ko""")
def _i14(rows, filled, sn, tn, terms, titles):
    # a pair's own sources always outrank the general ones, so these stay one shared layer (pair -1)
    own = lambda df: df.withColumn("ord", F.lit(0).cast("bigint"))
    shared = lambda df: df.withColumn("pair_id", F.lit(-1).cast("bigint"))
    return gl.merge_glossaries({"ifrs": shared(terms), "title_map": shared(titles), "title_match": own(gl.pairs_by_number(sn, tn)), "value_match": own(_signatures(rows, filled))}, ["pair_id"])


@query("i15_glossary_by_rows", ["row_pairs"], f"""
SELECT pair_id, src_label AS ko, arg_max(tpl_label, {SEQ}) AS en FROM row_pairs WHERE src_label <> tpl_label GROUP BY pair_id, src_label""")
def _i15(rows):
    return gl.pairs_by_rows(rows.select("pair_id", (F.col("note_seq") * 1000 + F.col("src_row")).alias("seq"), "src_label", "tpl_label"))


@query("k02_longest_first", ["docs"], """
SELECT doc_id, old, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY -length(old), old) - 1 AS place FROM (SELECT doc_id, unnest(string_split(source || ' ' || lang || ' ab ' || doc_name || ' z', ' ')) AS old FROM docs) q""")
def _k02(docs):
    words = F.split(F.concat_ws(" ", "source", "lang", F.lit("ab"), "doc_name", F.lit("z")), " ")
    pairs = F.transform(words, lambda w: F.struct(w.alias("old"), F.lit("").alias("new")))
    return docs.select("doc_id", F.posexplode(d.longest_first(pairs)).alias("place", "p")).select("doc_id", F.col("p.old").alias("old"), F.col("place").cast("bigint").alias("place"))


@query("k04_context_entries", ["src_rows", "terms", "title_map"], f"""
WITH used AS MATERIALIZED (SELECT DISTINCT unnest(string_split(label, '')) AS ch FROM {LABELS} q),
dict AS MATERIALIZED (SELECT ko, en, ord FROM terms UNION ALL SELECT ko, en, ord + 1000000 FROM title_map),
parts AS (SELECT DISTINCT ko, unnest(string_split(ko, '')) AS ch FROM dict),
hits AS (SELECT ko, COUNT(*) AS hits FROM parts JOIN used USING (ch) WHERE trim(ch) <> '' GROUP BY ko)
SELECT ko, en, ord, hits FROM dict JOIN hits USING (ko)""")
def _k04(rows, terms, titles):
    entries = terms.unionByName(titles.withColumn("ord", F.col("ord") + 1000000))
    return gl.context_entries(entries, _labels(rows), "label")
