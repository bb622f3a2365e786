"""Queries: number, text and date functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import dates as d
from ledgerloom.functions import fuzzy
from ledgerloom.functions import numbers as nb
from ledgerloom.functions import text as tx
from ledgerloom.plans import oracle as o
from ledgerloom.plans.registry import query

X = "text"
DASH = "('', '-', '–', '—')"


def _inner(t: str) -> str:
    return f"substring({t}, 2, length({t}) - 2)"


def _cents(v: str) -> str:
    return f"SELECT l_orderkey, text, CAST(({v}) * 100 AS BIGINT) AS hundredths FROM num_text"


def source_amount(x: str) -> str:
    t = o.strip(f"translate({x}, chr(92) || '₩', '')")
    b = (f"replace(CASE WHEN {t} LIKE '(%)' THEN {o.strip(_inner(t))} WHEN {t} LIKE '-%' "
         f"THEN {o.strip(f'substring({t}, 2)')} ELSE {t} END, ',', '')")
    return (f"CASE WHEN {x} = '' THEN NULL WHEN {t} IN {DASH} THEN 0 "
            rf"WHEN contains({b}, '.') OR regexp_full_match({b}, '\s*[+-]?[0-9]+\s*') THEN "
            f"CASE WHEN {t} LIKE '(%)' OR {t} LIKE '-%' THEN -TRY_CAST({b} AS DECIMAL(38,6)) ELSE TRY_CAST({b} AS DECIMAL(38,6)) END END")


def loose(x: str, zeros: str) -> str:
    t = o.strip(x)
    b = rf"regexp_replace(CASE WHEN {t} LIKE '(%)' THEN {_inner(t)} ELSE {t} END, '[₩$€¥£\s,]', '', 'g')"
    return (f"CASE WHEN {t} IN {zeros} OR {b} = '' THEN 0 WHEN {t} LIKE '(%)' THEN -TRY_CAST({b} AS DECIMAL(38,6)) "
            f"ELSE TRY_CAST({b} AS DECIMAL(38,6)) END")


def signature(x: str) -> str:
    t = o.strip(x)
    b = rf"regexp_replace(CASE WHEN {t} LIKE '(%)' THEN {_inner(t)} ELSE {t} END, '[^0-9.\-]', '', 'g')"
    v = f"(CASE WHEN {t} LIKE '(%)' THEN -1 ELSE 1 END * TRY_CAST({b} AS DECIMAL(30,6)))"
    return (rf"CASE WHEN {t} IN {DASH} OR {b} = '' THEN NULL ELSE "
            rf"regexp_replace(regexp_replace(CAST({v} AS VARCHAR), '0+$', ''), '\.$', '') END")


def report_number(x: str, pct: str) -> str:
    t = o.strip(f"translate({x}, chr(92) || '₩', '')")
    rest = f"replace({o.strip(f'substring({t}, 2)')}, ',', '')"
    minus = f"({t} LIKE '-%' AND regexp_full_match({rest}, '[0-9.]*[0-9][0-9.]*'))"
    b = f"replace(CASE WHEN {t} LIKE '(%)' THEN {o.strip(_inner(t))} WHEN {minus} THEN {rest} ELSE {t} END, ',', '')"
    p = "NULL" if pct == "null" else f"TRY_CAST(replace(replace({t}, '%', ''), ',', '') AS DECIMAL(38,6))"
    return (rf"CASE WHEN {x} = '' THEN NULL WHEN {t} IN {DASH} THEN 0 WHEN contains({t}, '%') THEN {p} "
            rf"WHEN regexp_full_match({t}, '[A-Za-z\s]+') THEN NULL "
            rf"WHEN contains({b}, '.') OR regexp_full_match({b}, '\s*[+-]?[0-9]+\s*') THEN "
            f"CASE WHEN {t} LIKE '(%)' OR {minus} THEN -TRY_CAST({b} AS DECIMAL(38,6)) ELSE TRY_CAST({b} AS DECIMAL(38,6)) END END")


ZEROS_BS = "('', '-', '–', '—', chr(92))"

PARSERS = {
    "s01_parse_source_amount": (nb.parse_source_amount, source_amount(X)),
    "s02_parse_cell_number": (nb.parse_cell_number, loose(X, DASH)),
    "s03_parse_cell_number_or_placeholder": (nb.parse_cell_number_or_placeholder, loose(X, ZEROS_BS)),
    "s04_parse_whole": (nb.parse_whole, o.whole(X)),
    "s05_parse_whole_strict": (nb.parse_whole_strict, o.whole(X, lenient=False)),
    "s07_parse_report_number": (nb.parse_report_number, report_number(X, "null")),
    "s08_parse_report_number_or_percent": (nb.parse_report_number_or_percent, report_number(X, "value")),
}


def _parser(fn):
    return lambda t: t.select("l_orderkey", "text", (fn("text") * 100).cast("bigint").alias("hundredths"))


for _name, (_fn, _sql) in PARSERS.items():
    query(_name, ["num_text"], _cents(_sql))(_parser(_fn))


@query("s06_number_signature", ["num_text"], f"SELECT l_orderkey, text, {signature(X)} AS signature FROM num_text")
def _s06(t):
    return t.select("l_orderkey", "text", nb.number_signature("text").alias("signature"))


T = o.strip(X)
LOOKS = (rf"({T} IN {DASH} OR regexp_replace(regexp_replace({T}, '^[()]+|[()]+$', '', 'g'), '[₩$€¥£\s,]', '', 'g') = '' OR "
         rf"TRY_CAST(regexp_replace(regexp_replace({T}, '^[()]+|[()]+$', '', 'g'), '[₩$€¥£\s,]', '', 'g') AS DECIMAL(38,6)) IS NOT NULL)")
CLEAN = f"translate({T}, ',()- ' || chr(92), '')"
TPLN = o.strip(f"translate({X}, ',₩' || chr(92), '')")
PREDICATES = {
    "s10_looks_numeric": (nb.looks_numeric, LOOKS),
    "s11_has_amount": (nb.has_amount, f"({T} NOT IN {ZEROS_BS} AND {LOOKS})"),
    "s12_is_amount_cell": (nb.is_amount_cell,
        f"({T} IN ('', '-', '–', '—', '/', chr(92)) OR regexp_full_match(replace(translate({T}, ',()- △▲' || chr(92), ''), '.', ''), '[0-9]+') "
        f"OR translate({T}, ',()- △▲' || chr(92), '') = '')"),
    "s13_is_template_number": (nb.is_template_number,
        f"({TPLN} IN ('-', '–', '—') OR ({TPLN} <> '' AND regexp_full_match(CASE WHEN {TPLN} LIKE '(%)' THEN {o.strip(_inner(TPLN))} ELSE {TPLN} END, "
        r"'-*([0-9]+\.?[0-9]*|\.[0-9]+)')))"),
    "s14_is_number_text": (nb.is_number_text, rf"regexp_full_match({T}, '[\s()\-–—,.0-9%]*')"),
    "s15_label_guard": (nb.is_label_cell,
        f"({T} <> '' AND {CLEAN} <> '' AND NOT regexp_full_match(replace({CLEAN}, '.', ''), '[0-9]+'))"),
}


def _predicate(fn):
    return lambda t: t.select("l_orderkey", "text", fn("text").alias("flag"))


for _name, (_fn, _sql) in PREDICATES.items():
    query(_name, ["num_text"], f"SELECT l_orderkey, text, {_sql} AS flag FROM num_text")(_predicate(_fn))


SIGNED = "(CASE k % 4 WHEN 0 THEN a WHEN 1 THEN -a WHEN 2 THEN 0 END)"


def _signed(t):
    return t.withColumn("v", F.expr("CASE k % 4 WHEN 0 THEN a WHEN 1 THEN -a WHEN 2 THEN 0 END").cast("bigint"))


@query("s16_format_amount", ["num_text"], f"SELECT l_orderkey, CAST({SIGNED} AS BIGINT) AS v, {o.fmt(SIGNED)} AS shown FROM num_text")
def _s16(t):
    return _signed(t).select("l_orderkey", "v", nb.format_amount("v").alias("shown"))


@query("s17_format_report_number", ["num_text"], f"""
SELECT l_orderkey, v, CASE WHEN v IS NULL THEN '' WHEN v = 0 THEN '-' WHEN v < 0 THEN '(' || format('{{:,}}', -v) || ')' ELSE format('{{:,}}', v) END AS brackets,
  CASE WHEN v IS NULL THEN '' WHEN v = 0 THEN '-' WHEN v < 0 THEN '-' || format('{{:,}}', -v) ELSE format('{{:,}}', v) END AS minus,
  CASE WHEN v IS NULL THEN '' WHEN v = 0 THEN '-' WHEN v < 0 THEN '(' || format('{{:,}}.00', -v) || ')' ELSE format('{{:,}}.00', v) END AS two_places
FROM (SELECT l_orderkey, CAST({SIGNED} AS BIGINT) AS v FROM num_text) q""")
def _s17(t):
    return _signed(t).select(
        "l_orderkey", "v", nb.format_report_number("v").alias("brackets"),
        nb.format_report_number("v", negative_style="minus").alias("minus"),
        nb.format_report_number("v", decimals=2).alias("two_places"))


@query("s18_number_format", ["num_text"], r"""
SELECT l_orderkey, text, CASE WHEN contains(text, ',') THEN ',' ELSE '' END AS thousands_separator,
  CASE WHEN regexp_matches(text, '\([0-9]') THEN 'parentheses' ELSE 'minus' END AS negative_style,
  CASE WHEN regexp_matches(text, '(^|[^\p{L}\p{N}_])-($|[^\p{L}\p{N}_])') THEN 'dash' ELSE 'zero' END AS zero_style,
  (contains(text, chr(92)) OR contains(text, '₩')) AS has_won_symbol, regexp_matches(text, '[0-9]\.[0-9]') AS has_decimals
FROM num_text""")
def _s18(t):
    return t.withColumn("f", nb.number_format("text")).select("l_orderkey", "text", "f.*")


@query("s19_convert_unit", ["num_text"], "SELECT l_orderkey, a, u1, u2, " + o.convert("sa", "u1", "u2") + """ AS converted
FROM (SELECT l_orderkey, a, CASE WHEN k % 4 = 1 THEN -a ELSE a END AS sa,
  CASE k % 3 WHEN 0 THEN 'won' WHEN 1 THEN 'thousand' ELSE 'other' END AS u1,
  CASE k % 5 WHEN 0 THEN 'won' WHEN 1 THEN 'thousand' ELSE 'million' END AS u2 FROM num_text) q""")
def _s19(t):
    t = t.selectExpr("l_orderkey", "a", "CASE WHEN k % 4 = 1 THEN -a ELSE a END AS sa",
                     "CASE k % 3 WHEN 0 THEN 'won' WHEN 1 THEN 'thousand' ELSE 'other' END AS u1",
                     "CASE k % 5 WHEN 0 THEN 'won' WHEN 1 THEN 'thousand' ELSE 'million' END AS u2")
    return t.select("l_orderkey", "a", "u1", "u2", nb.convert_unit("sa", "u1", "u2").alias("converted"))


@query("s23_row_flags", ["src_cells"], r"""
SELECT pair_id, note_no, row_idx, regexp_matches(t, '소\s*계') AS is_subtotal,
  regexp_matches(t, '합\s*계|총\s*계') AND NOT regexp_matches(t, '소\s*계') AS is_total, trim(t) = '' AS is_empty
FROM (SELECT pair_id, note_no, row_idx, string_agg(text, ' ' ORDER BY col_idx) AS t FROM src_cells GROUP BY ALL) q""")
def _s23(cells):
    rows = cells.groupBy("pair_id", "note_no", "row_idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "text"))), lambda c: c["text"]), " ").alias("t"))
    return rows.select("pair_id", "note_no", "row_idx", tx.is_subtotal_text("t").alias("is_subtotal"),
                       tx.is_total_text("t").alias("is_total"), (F.trim("t") == "").alias("is_empty"))


@query("s24_indent_level", ["num_text"], """
SELECT l_orderkey, k, CAST(CASE WHEN p >= 6 THEN 3 WHEN p >= 4 THEN 2 WHEN p >= 2 THEN 1 ELSE 0 END AS BIGINT) AS by_spaces,
  CAST(FLOOR(a % 2000 / 360) AS BIGINT) AS by_offset
FROM (SELECT l_orderkey, k, a, length(s) - length(ltrim(s)) AS p FROM (SELECT l_orderkey, k, a, lpad('x', CAST(1 + k % 9 AS INT), ' ') AS s FROM num_text) r) q""")
def _s24(t):
    t = t.withColumn("s", F.lpad(F.lit("x"), (1 + F.col("k") % 9).cast("int"), F.lit(" ")))
    return t.select("l_orderkey", "k", tx.indent_level("s").alias("by_spaces"),
                    tx.indent_level_of_offset(F.col("a") % 2000).alias("by_offset"))


@query("s25_clean_lines", ["documents"], r"""
SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(string_split(replace(t, '&cr;', chr(10)), chr(10)),
   lambda x: regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^[\s\x{00a0}\x{3000}]+|[\s\x{00a0}\x{3000}]+$', '', 'g')), lambda x: x <> ''), chr(10)), '') AS cleaned
FROM (SELECT doc_id, replace(text, '. ', '.  &cr; ') AS t FROM documents) q""")
def _s25(docs):
    return docs.select("doc_id", tx.clean_lines(F.replace("text", F.lit(". "), F.lit(".  &cr; "))).alias("cleaned"))


LT = o.strip("text")


@query("s26_note_numbering", ["doc_lines"], rf"""
SELECT doc_id, seq, CASE WHEN p = 0 THEN NULL WHEN p = 5 THEN CAST(strpos('①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳', substring(t, 1, 1)) AS VARCHAR)
   WHEN p = 4 THEN regexp_extract(t, '^\(([0-9]+)\)', 1) ELSE regexp_extract(t, '^([0-9.]*[0-9]|[가-하])', 1) END AS number,
  CASE p WHEN 0 THEN NULL WHEN 1 THEN {o.strip("regexp_replace(t, '^[0-9]+[.][[:space:]]+', '')")} WHEN 4 THEN {o.strip("regexp_replace(t, '^[(][0-9]+[)][[:space:]]+', '')")}
   WHEN 5 THEN {o.strip("substring(t, 2)")} ELSE {o.strip("regexp_replace(t, '^[0-9.]*[0-9][[:space:]]+', '')")} END AS title,
  CAST(CASE p WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 2 END AS BIGINT) AS depth
FROM (SELECT doc_id, seq, t, CASE WHEN regexp_matches(t, '^[0-9]+\.\s+(?s:.)+') THEN 1 WHEN regexp_matches(t, '^[0-9]+\.[0-9]+\.[0-9]+\s+(?s:.)+') THEN 2
   WHEN regexp_matches(t, '^[0-9]+\.[0-9]+\s+(?s:.)+') THEN 3 WHEN regexp_matches(t, '^\([0-9]+\)\s+(?s:.)+') THEN 4
   WHEN regexp_matches(t, '^[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]\s*(?s:.)+') THEN 5 ELSE 0 END AS p FROM (SELECT doc_id, seq, {LT} AS t FROM doc_lines) r) q""")
def _s26(lines):
    return lines.withColumn("n", tx.note_numbering("text")).select("doc_id", "seq", "n.number", "n.title", "n.depth")


@query("s27_note_number", ["doc_lines"], rf"""
SELECT doc_id, seq, CASE WHEN m THEN regexp_extract(t, '^([0-9]+(\.[0-9]+)*)', 1) ELSE CAST(seq AS VARCHAR) END AS number,
  CASE WHEN m THEN {o.strip(r"regexp_extract(t, '^[0-9]+(\.[0-9]+)*\s*\.?\s+([^\n]+)$', 2)")} ELSE t END AS title
FROM (SELECT doc_id, seq, t, regexp_matches(t, '^[0-9]+(\.[0-9]+)*\s*\.?\s+[^\n]+$') AS m FROM (SELECT doc_id, seq, {LT} AS t FROM doc_lines) r) q""")
def _s27(lines):
    return lines.withColumn("n", tx.note_number("text", F.col("seq"))).select("doc_id", "seq", "n.number", "n.title")


@query("s28_normalize_number", ["src_notes"], r"""
SELECT pair_id, number, CASE WHEN contains(n, '.') THEN n WHEN ltrim(n, '0') = '' THEN '0' ELSE ltrim(n, '0') END AS normal
FROM (SELECT pair_id, number, rtrim(trim(number), '.') AS n FROM src_notes) q""")
def _s28(notes):
    return notes.select("pair_id", "number", tx.normalize_number("number").alias("normal"))


def norm_label(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({o.strip(x)}), '[\s:;,.\-–—]+$', ''), '\s+', ' ', 'g')"


@query("s29_normalize_label", ["doc_lines"], f"SELECT doc_id, seq, {norm_label('text')} AS normal FROM doc_lines")
def _s29(lines):
    return lines.select("doc_id", "seq", tx.normalize_label("text").alias("normal"))


@query("s30_normalize_title", ["doc_lines"],
       f"SELECT doc_id, seq, " + o.strip(rf"lower(regexp_replace(regexp_replace({LT}, '^[0-9]+[.)]\s*', ''), '\s+', ' ', 'g'))") + " AS normal FROM doc_lines")
def _s30(lines):
    return lines.select("doc_id", "seq", tx.normalize_title("text").alias("normal"))


@query("s31_clean_label", ["doc_lines"],
       "SELECT doc_id, seq, " + o.strip(rf"regexp_replace({LT}, '^[0-9.)(①②③④⑤⑥⑦⑧⑨⑩\s]+', '')") + " AS cleaned FROM doc_lines")
def _s31(lines):
    return lines.select("doc_id", "seq", tx.clean_label("text").alias("cleaned"))


@query("s32_script_tests", ["docs"], r"""
SELECT doc_id, regexp_matches(text, '[가-힯㄰-㆏]') AS korean, regexp_matches(text, '[a-zA-Z]') AS english,
  regexp_matches(doc_name, '[a-zA-Z]') AS english_name FROM docs""")
def _s32(docs):
    return docs.select("doc_id", tx.is_korean("text").alias("korean"), tx.is_english("text").alias("english"),
                       tx.is_english("doc_name").alias("english_name"))


@query("s33_word_tokens", ["documents"], """
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, array_to_string(list_sort(w), ' ') AS tokens
FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) q""")
def _s33(docs):
    w = tx.word_tokens("text")
    return docs.select("doc_id", F.size(w).cast("bigint").alias("n_tokens"), F.array_join(F.array_sort(w), " ").alias("tokens"))


@query("s34_row_label", ["src_cells"], f"""
SELECT pair_id, note_no, row_idx, arg_min(text, col_idx) FILTER ({T} <> '' AND NOT {LOOKS}) AS by_text,
  arg_min(text, col_idx) FILTER ({T} <> '' AND ({source_amount(X)}) IS NULL) AS by_amount,
  arg_min(text, col_idx) FILTER ({T} <> '' AND ({signature(X)}) IS NULL) AS by_signature
FROM src_cells GROUP BY pair_id, note_no, row_idx""")
def _s34(cells):
    filled = tx.strip("text") != ""

    def first(cond):
        return F.min_by("text", F.when(filled & cond, F.col("col_idx")))

    return cells.groupBy("pair_id", "note_no", "row_idx").agg(
        first(~nb.looks_numeric("text")).alias("by_text"), first(nb.parse_source_amount("text").isNull()).alias("by_amount"),
        first(nb.number_signature("text").isNull()).alias("by_signature"))


def jaccard(a: str, b: str) -> str:
    return (f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / "
            f"CAST(len({a}) + len({b}) - len(list_intersect({a}, {b})) AS DOUBLE) END)")


def contain(a: str, b: str, base: str, weight: str) -> str:
    return (f"(CASE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN {base}::DOUBLE + {weight}::DOUBLE * "
            f"(CAST(LEAST(length({a}), length({b})) AS DOUBLE) / CAST(GREATEST(length({a}), length({b})) AS DOUBLE)) END)")


def label_tokens(x: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex({x}, '\s+'), lambda y: y <> ''))"


def label_sim(a: str, b: str, read: str) -> str:
    """Oracle for labels a (maybe Korean, read in English by ``read``) and b."""
    na, nb_, t = norm_label(a), norm_label(b), norm_label(read)
    j = jaccard(label_tokens(t), label_tokens(nb_))
    cross = (f"CASE WHEN regexp_matches({a}, '[가-힯㄰-㆏]') AND NOT regexp_matches({b}, '[가-힯㄰-㆏]') AND {t} <> '' THEN "
             f"CASE WHEN {t} = {nb_} THEN 0.95::DOUBLE WHEN {contain(t, nb_, '0.7', '0.25')} IS NOT NULL THEN {contain(t, nb_, '0.7', '0.25')} "
             f"WHEN {j} >= 0.3 THEN 0.6::DOUBLE + 0.3::DOUBLE * {j} END END")
    return (f"CASE WHEN {na} = '' OR {nb_} = '' THEN 0.0::DOUBLE WHEN {na} = {nb_} THEN 1.0::DOUBLE ELSE "
            f"COALESCE({contain(na, nb_, '0.7', '0.3')}, {cross}, {jaccard(label_tokens(na), label_tokens(nb_))}) END")


@query("s35_label_similarity", ["row_pairs", "terms"], f"""
SELECT src_label, tpl_label, {label_sim('src_label', 'tpl_label', 'en')} AS sim
FROM (SELECT DISTINCT src_label, tpl_label FROM row_pairs) q LEFT JOIN terms ON terms.ko = q.src_label""")
def _s35(rows, terms):
    pairs = rows.select("src_label", "tpl_label").distinct().join(terms, F.col("src_label") == F.col("ko"), "left")
    return tx.with_label_similarity(pairs, "src_label", "tpl_label", "sim", read_a="en").select("src_label", "tpl_label", "sim")


@query("s37_sequence_ratio", ["row_pairs"])
def _s37(rows):
    pairs = rows.select("src_label", "tpl_label").distinct()
    return pairs.select("src_label", "tpl_label", fuzzy.sequence_ratio("src_label", "tpl_label").alias("ratio"))


KD = "strftime(o_orderdate, '%Y') || '년 ' || CAST(month(o_orderdate) AS VARCHAR) || '월 ' || CAST(day(o_orderdate) AS VARCHAR) || '일'"


@query("s38_translate_date", ["orders"], f"""
SELECT o_orderkey, ko, CASE WHEN ko LIKE '기준%' THEN NULL ELSE (CASE WHEN ko LIKE '%현재' THEN 'As at ' ELSE '' END) ||
   strftime(o_orderdate, '%B') || ' ' || CAST(day(o_orderdate) AS VARCHAR) || ', ' || strftime(o_orderdate, '%Y') END AS en
FROM (SELECT o_orderkey, o_orderdate, CASE o_orderkey % 3 WHEN 0 THEN {KD} || ' 현재' WHEN 1 THEN {KD} ELSE '기준 ' || {KD} END AS ko FROM orders) q""")
def _s38(orders):
    kd = F.concat(F.year("o_orderdate"), F.lit("년 "), F.month("o_orderdate"), F.lit("월 "), F.dayofmonth("o_orderdate"), F.lit("일"))
    k = F.col("o_orderkey") % 3
    ko = F.when(k == 0, F.concat(kd, F.lit(" 현재"))).when(k == 1, kd).otherwise(F.concat(F.lit("기준 "), kd))
    return orders.select("o_orderkey", ko.alias("ko")).withColumn("en", d.translate_date("ko"))


@query("s39_period_dates", ["orders"], """
SELECT o_orderkey, p, strftime(e, '%Y-%m-%d') AS period_end, strftime(e, '%B') || ' ' || day(e) || ', ' || year(e) AS en_date,
  strftime(e, '%B') || ' ' || day(e) || ' ' || year(e) AS en_date_plain, 'Year ended ' || strftime(e, '%B') || ' ' || day(e) || ', ' || year(e) AS year_ended,
  'year ended ' || strftime(e, '%B') || ' ' || day(e) || ', ' || year(e) AS year_ended_lower
FROM (SELECT o_orderkey, p, CASE WHEN length(p) = 4 THEN make_date(CAST(p AS INT), 12, 31) ELSE CAST(strptime(p, '%Y.%m.%d') AS DATE) END AS e
 FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y.%m.%d') ELSE strftime(o_orderdate, '%Y') END AS p FROM orders) r) q""")
def _s39(orders):
    p = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy.MM.dd")).otherwise(F.date_format("o_orderdate", "yyyy"))
    t = orders.select("o_orderkey", p.alias("p")).withColumn("e", d.parse_period("p"))
    return t.select("o_orderkey", "p", F.date_format("e", "yyyy-MM-dd").alias("period_end"), d.english_date("e").alias("en_date"),
                    d.english_date("e", comma=False).alias("en_date_plain"), d.year_ended("e").alias("year_ended"),
                    d.year_ended("e", capital=False).alias("year_ended_lower"))


@query("s40_statement_type", ["docs"], """
SELECT doc_id, CASE WHEN contains(t, 'balance') OR contains(t, 'financial position') OR contains(t, '재무상태') THEN 'BS'
  WHEN contains(t, 'income') OR contains(t, 'comprehensive') OR contains(t, 'profit') OR contains(t, '손익') THEN 'IS'
  WHEN contains(t, 'equity') OR contains(t, '자본변동') THEN 'CE' WHEN contains(t, 'cash') OR contains(t, '현금') THEN 'CF' END AS stmt_type
FROM (SELECT doc_id, lower(text || CASE doc_id % 6 WHEN 0 THEN ' Balance Sheet' WHEN 1 THEN ' 손익계산서' WHEN 2 THEN ' Changes in Equity'
  WHEN 3 THEN ' Cash flows' WHEN 4 THEN ' profit and cash' ELSE '' END) AS t FROM docs) q""")
def _s40(docs):
    tail = F.expr("CASE doc_id % 6 WHEN 0 THEN ' Balance Sheet' WHEN 1 THEN ' 손익계산서' WHEN 2 THEN ' Changes in Equity' "
                  "WHEN 3 THEN ' Cash flows' WHEN 4 THEN ' profit and cash' ELSE '' END")
    return docs.select("doc_id", tx.statement_type(F.concat("text", tail)).alias("stmt_type"))


@query("s41_parse_address", ["changes"], """
SELECT target, CAST(split_part(target, ':', 2) AS BIGINT) AS tpl_table, CAST(split_part(target, ':', 4) AS BIGINT) AS row_idx,
  split_part(target, ':', 6) AS col_text, CAST(NULL AS BIGINT) AS paragraph, CAST(3 AS BIGINT) AS n_parts FROM changes""")
def _s41(changes):
    m = tx.parse_address("target")
    return changes.select("target", tx.address_part("target", "table").alias("tpl_table"), tx.address_part("target", "row").alias("row_idx"),
                          F.try_element_at(m, F.lit("col")).alias("col_text"), tx.address_part("target", "paragraph").alias("paragraph"),
                          F.size(m).cast("bigint").alias("n_parts"))


@query("s42_coerce_arguments", ["num_text"], r"""
SELECT l_orderkey, text, CASE WHEN regexp_full_match(trim(text), '[+-]?[0-9]+') AND TRY_CAST(trim(text) AS BIGINT) IS NOT NULL
   THEN CAST(CAST(trim(text) AS BIGINT) AS VARCHAR) ELSE text END AS as_integer,
  CASE WHEN lower(text) IN ('true', '1', 'yes') THEN 'true' ELSE 'false' END AS as_boolean FROM num_text""")
def _s42(t):
    return t.select("l_orderkey", "text", tx.coerce_argument("text", "integer").alias("as_integer"),
                    tx.coerce_argument("text", "boolean").alias("as_boolean"))


def _answers(convs):
    w = F.regexp_extract("text", "^([^\\s\"\\\\]*)", 1)
    k = F.col("turn") % 4
    a = (F.when(k == 0, F.concat(F.lit('```json\n["'), w, F.lit('", "b"]\n```')))
         .when(k == 1, F.concat(F.lit('["'), w, F.lit('"]')))
         .when(k == 2, F.concat(F.lit("1. "), w, F.lit("\n2. two"))).otherwise(w))
    return convs.select("conv_id", "turn", w.alias("w"), a.alias("answer"))


@query("s43_json_list", ["convs"], r"""
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN w || '|b' WHEN 1 THEN w WHEN 2 THEN rtrim(w, ',') || '|two' END AS items,
  CASE turn % 4 WHEN 0 THEN w || '|b|?' WHEN 1 THEN w || '|?|?' WHEN 2 THEN rtrim(w, ',') || '|two|?' ELSE '?|?|?' END AS three
FROM (SELECT conv_id, turn, regexp_extract(text, '^([^\s"\\]*)', 1) AS w FROM convs) q""")
def _s43(convs):
    t = _answers(convs).withColumn("list", tx.json_list("answer"))
    return t.select("conv_id", "turn", F.array_join("list", "|").alias("items"),
                    F.array_join(tx.fit_list(F.col("list"), 3, F.lit("?")), "|").alias("three"))


@query("s44_json_action", ["convs"], """
SELECT conv_id, turn, CASE turn % 5 WHEN 3 THEN '_retry' WHEN 4 THEN 'b2' ELSE action END AS found FROM convs""")
def _s44(convs):
    k = F.col("turn") % 5
    obj = F.concat(F.lit('{"thought": "t", "action": "'), F.col("action"), F.lit('", "action_input": {"a": 1}}'))
    answer = (F.when(k == 0, obj).when(k == 1, F.concat(F.lit("see ```json\n"), obj, F.lit("\n``` ok")))
              .when(k == 2, F.concat(F.lit("so {x} and "), obj)).when(k == 4, F.lit('text {"a": 1} then {"action": "b2"} end'))
              .otherwise(F.lit("no answer")))
    return convs.select("conv_id", "turn", tx.json_action(answer).alias("found"))


@query("s45_cut_text", ["documents"], """
SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 250) || chr(10) || '...(중략)...' || chr(10) || right(text, 250) ELSE text END AS middle,
  CASE WHEN length(text) > 8000 THEN left(text, 8000) || '...' ELSE text END AS capped,
  CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS summary FROM documents""")
def _s45(docs):
    return docs.select("doc_id", tx.cut_middle("text").alias("middle"), tx.cut_end("text", 8000, "...").alias("capped"),
                       tx.cut_end("text", 200, "...").alias("summary"))


@query("s46_file_extension", ["pages"], r"""
SELECT page_id, regexp_matches(lower(f), '\.(dsd|zip)$') AS is_source, regexp_matches(lower(f), '\.(docx|pdf)$') AS is_template,
  strlen(html) <= 52428800 AS size_ok
FROM (SELECT page_id, html, url || CASE page_id % 4 WHEN 0 THEN '.DSD' WHEN 1 THEN '.zip' WHEN 2 THEN '.Docx' ELSE '.exe' END AS f FROM pages) q""")
def _s46(pages):
    f = F.concat("url", F.expr("CASE page_id % 4 WHEN 0 THEN '.DSD' WHEN 1 THEN '.zip' WHEN 2 THEN '.Docx' ELSE '.exe' END"))
    return pages.select("page_id", tx.has_extension(f, [".dsd", ".zip"]).alias("is_source"),
                        tx.has_extension(f, [".docx", ".pdf"]).alias("is_template"),
                        (F.octet_length("html") <= 50 * 1024 * 1024).alias("size_ok"))


@query("s47_amounts_match", ["row_pairs"], """
SELECT pair_id, note_no, src_row, CASE WHEN exp_pri IS NULL AND tpl_cur IS NULL THEN TRUE
  WHEN exp_pri IS NOT NULL AND tpl_cur IS NOT NULL THEN ABS(exp_pri - tpl_cur) <= 1 ELSE COALESCE(exp_pri, tpl_cur) = 0 END AS same
FROM row_pairs""")
def _s47(rows):
    return rows.select("pair_id", "note_no", "src_row", nb.amounts_match("exp_pri", "tpl_cur").alias("same"))
