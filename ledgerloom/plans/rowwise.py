"""Queries: note matching, row matching, column alignment and value comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import numbers as nb
from ledgerloom.functions import text as tx
from ledgerloom.operators import compare as cp
from ledgerloom.operators import notes as nt
from ledgerloom.operators import rows as rw
from ledgerloom.plans import oracle as o
from ledgerloom.plans.registry import query
from ledgerloom.session import once, stored
from ledgerloom.plans.scalars import label_sim, norm_label, source_amount

KEYS = ["pair_id", "tbl"]


# --- notes -------------------------------------------------------------------

TOK = "list_distinct(regexp_extract_all(lower({x}), '[a-z]+'))"


def _jac(a: str, b: str) -> str:
    return (f"CAST(len(list_intersect({a}, {b})) AS DOUBLE) / CAST(len({a}) + len({b}) - len(list_intersect({a}, {b})) AS DOUBLE)")


BARE = o.strip(rf"regexp_replace(trim(n.title), '^[0-9.\s\-–—]+', '')")
SIMS = f"""
 sr AS (SELECT n.*, {BARE} AS bare, COALESCE(a.en, b.en) AS en FROM src_notes n
   LEFT JOIN title_map a ON a.ko = trim(n.title) LEFT JOIN title_map b ON b.ko = {BARE}),
 sim AS (SELECT sr.pair_id, sr.note_id AS s_id, sr.note_seq AS s_seq, t.note_id AS t_id, t.note_seq AS t_seq,
   CASE WHEN sr.en IS NOT NULL THEN {_jac(TOK.format(x='sr.en'), TOK.format(x='t.title'))}
     ELSE COALESCE((SELECT MAX(CAST(length(m.en) AS DOUBLE) / CAST(length(t.title) AS DOUBLE)) FROM title_map m
        WHERE contains(lower(t.title), lower(m.en)) AND (contains(sr.bare, m.ko) OR contains(m.ko, sr.bare))), 0.0) END AS sim
   FROM sr JOIN tpl_notes t ON t.pair_id = sr.pair_id)"""


@query("s36_title_similarity", ["src_notes", "tpl_notes", "title_map"], f"WITH {SIMS} SELECT pair_id, s_id, t_id, sim FROM sim WHERE sim > 0")
def _s36(s, t, m):
    return nt.title_similarities(s, t, m).select("pair_id", "s_id", "t_id", "sim")


NUM = "(CASE WHEN contains(rtrim(trim({x}), '.'), '.') THEN rtrim(trim({x}), '.') WHEN ltrim(rtrim(trim({x}), '.'), '0') = '' THEN '0' ELSE ltrim(rtrim(trim({x}), '.'), '0') END)"
NOTES = f"""{SIMS},
 bn AS (SELECT pair_id, {NUM.format(x='number')} AS num, arg_max(note_id, note_seq) AS t_id FROM tpl_notes WHERE {NUM.format(x='number')} <> '0' GROUP BY 1, 2),
 nm AS (SELECT s.pair_id, s.note_id AS s_id, bn.t_id,
   (SELECT sim FROM sim WHERE sim.pair_id = s.pair_id AND sim.s_id = s.note_id AND sim.t_id = bn.t_id) AS sim,
   COALESCE((SELECT MAX(sim) FROM sim WHERE sim.pair_id = s.pair_id AND sim.s_id <> s.note_id AND sim.t_id = bn.t_id), 0) AS rs,
   COALESCE((SELECT MAX(sim) FROM sim WHERE sim.pair_id = s.pair_id AND sim.s_id = s.note_id AND sim.t_id <> bn.t_id), 0) AS rt
   FROM src_notes s JOIN bn ON bn.pair_id = s.pair_id AND bn.num = {NUM.format(x='s.number')}),
 p1 AS (SELECT pair_id, s_id, t_id, 0.8::DOUBLE + 0.2::DOUBLE * sim AS confidence, CASE WHEN sim >= 0.3 THEN 'number+title' ELSE 'number' END AS method
   FROM nm WHERE sim >= 0.3 OR (rs < 0.4 AND rt < 0.5)),
 ed AS (SELECT pair_id AS g, s_seq AS l, t_seq AS r, sim AS s, t_seq AS o FROM sim WHERE sim >= 0.4
   AND NOT EXISTS (SELECT 1 FROM p1 WHERE p1.pair_id = sim.pair_id AND p1.s_id = sim.s_id)
   AND NOT EXISTS (SELECT 1 FROM p1 WHERE p1.pair_id = sim.pair_id AND p1.t_id = sim.t_id)),
 p2 AS (SELECT sim.pair_id, sim.s_id, sim.t_id, z.s AS confidence, 'title' AS method FROM {o.greedy('ed')} z
   JOIN sim ON sim.pair_id = z.g AND sim.s_seq = z.l AND sim.t_seq = z.r),
 pp AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2),
 allp AS (SELECT * FROM pp UNION ALL SELECT pair_id, note_id, NULL, 0.0::DOUBLE, 'unmatched' FROM src_notes s
   WHERE NOT EXISTS (SELECT 1 FROM pp WHERE pp.pair_id = s.pair_id AND pp.s_id = s.note_id))"""


@query("c01_note_match", ["src_notes", "tpl_notes", "title_map"], f"WITH {NOTES} SELECT pair_id, s_id, t_id, confidence, method FROM allp")
def _c01(s, t, m):
    return nt.match_notes(s, t, m)


@query("c02_unmatched_template_notes", ["src_notes", "tpl_notes", "title_map"], f"""WITH {NOTES}
SELECT pair_id, note_id, number, title FROM tpl_notes t WHERE NOT EXISTS (SELECT 1 FROM allp WHERE allp.pair_id = t.pair_id AND allp.t_id = t.note_id)""")
def _c02(s, t, m):
    return nt.unmatched_template_notes(nt.match_notes(s, t, m), t).select("pair_id", "note_id", "number", "title")


# --- rows --------------------------------------------------------------------

ROWS = ["src_rows", "tpl_base", "terms"]


def _sides(src, tpl):
    s = src.select("pair_id", F.col("note_seq").alias("tbl"), F.col("row_idx").alias("src_row"), F.col("label").alias("src_label"),
                   F.array_compact(F.array(nb.convert_unit("cur_amt", F.lit("won"), F.lit("thousand")),
                                           nb.convert_unit("pri_amt", F.lit("won"), F.lit("thousand")))).alias("src_values"))
    t = tpl.select("pair_id", F.col("tpl_table").alias("tbl"), F.col("row_idx").alias("tpl_row"), F.col("label").alias("tpl_label"),
                   F.array_compact(F.array("cur_amt", "pri_amt")).alias("tpl_values"))
    return s, t


EXACT = f"""
 xs AS (SELECT pair_id, note_seq AS tbl, row_idx AS src_row, label, {norm_label('label')} AS norm, cur_amt, pri_amt FROM src_rows),
 xt AS (SELECT pair_id, tpl_table AS tbl, row_idx AS tpl_row, label, {norm_label('label')} AS norm, cur_amt, pri_amt FROM tpl_base),
 ex AS (SELECT a.pair_id, a.tbl, a.src_row, b.tpl_row FROM
   (SELECT *, ROW_NUMBER() OVER (PARTITION BY pair_id, tbl, norm ORDER BY src_row) AS k FROM xs) a JOIN
   (SELECT *, ROW_NUMBER() OVER (PARTITION BY pair_id, tbl, norm ORDER BY tpl_row) AS k FROM xt) b
   ON a.pair_id = b.pair_id AND a.tbl = b.tbl AND a.norm = b.norm AND a.k = b.k WHERE a.norm <> '')"""


@query("c11_rows_exact_label", ["src_rows", "tpl_base"], f"""WITH {EXACT}
SELECT pair_id, tbl, src_row, tpl_row, 1.0::DOUBLE AS confidence, 'exact_label' AS method FROM ex""")
def _c11(src, tpl):
    return rw.match_exact_labels(*_sides(src, tpl), KEYS)


def _left(df, done, row):
    return df.join(done.select(*KEYS, row), [*KEYS, row], "left_anti")


SIMILAR = f"""{EXACT},
 rs AS (SELECT * FROM xs WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.pair_id = xs.pair_id AND ex.tbl = xs.tbl AND ex.src_row = xs.src_row)),
 rt AS (SELECT * FROM xt WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.pair_id = xt.pair_id AND ex.tbl = xt.tbl AND ex.tpl_row = xt.tpl_row)),
 ls AS (SELECT a.la, b.lb, {label_sim('a.la', 'b.lb', 'm.en')} AS sim
   FROM (SELECT DISTINCT label AS la FROM rs) a CROSS JOIN (SELECT DISTINCT label AS lb FROM rt) b LEFT JOIN terms m ON m.ko = a.la),
 se AS (SELECT rs.pair_id * 1000 + rs.tbl AS g, src_row AS l, tpl_row AS r, sim AS s, tpl_row AS o FROM rs JOIN rt ON rs.pair_id = rt.pair_id AND rs.tbl = rt.tbl
   JOIN ls ON ls.la = rs.label AND ls.lb = rt.label WHERE sim >= 0.6),
 sm AS (SELECT CAST(g // 1000 AS BIGINT) AS pair_id, CAST(g % 1000 AS BIGINT) AS tbl, l AS src_row, r AS tpl_row, s AS confidence FROM {o.greedy('se')} z)"""


def _exact_and_similar(src, tpl, terms):
    s, t = (stored(x, "pair_id") for x in _sides(src, tpl))
    exact = stored(rw.match_exact_labels(s, t, KEYS), "pair_id")
    return s, t, exact, rw.match_similar_labels(_left(s, exact, "src_row"), _left(t, exact, "tpl_row"), KEYS, terms)


@query("c12_rows_similar_label", ROWS, f"WITH {SIMILAR} SELECT pair_id, tbl, src_row, tpl_row, confidence, 'similar_label' AS method FROM sm")
def _c12(src, tpl, terms):
    return _exact_and_similar(src, tpl, terms)[3]


@query("c13_rows_by_position", ROWS, f"""WITH {SIMILAR},
 dn AS (SELECT pair_id, tbl, src_row, tpl_row FROM ex UNION ALL SELECT pair_id, tbl, src_row, tpl_row FROM sm),
 ps AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pair_id, tbl ORDER BY src_row) AS k FROM xs WHERE NOT EXISTS (SELECT 1 FROM dn WHERE dn.pair_id = xs.pair_id AND dn.tbl = xs.tbl AND dn.src_row = xs.src_row)),
 pt AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pair_id, tbl ORDER BY tpl_row) AS k FROM xt WHERE NOT EXISTS (SELECT 1 FROM dn WHERE dn.pair_id = xt.pair_id AND dn.tbl = xt.tbl AND dn.tpl_row = xt.tpl_row)),
 z AS (SELECT ps.pair_id, ps.tbl, ps.src_row, pt.tpl_row,
   list_filter([{o.convert('ps.cur_amt', "'won'", "'thousand'")}, {o.convert('ps.pri_amt', "'won'", "'thousand'")}], lambda v: v IS NOT NULL) AS sv,
   list_filter([pt.cur_amt, pt.pri_amt], lambda v: v IS NOT NULL) AS tv FROM ps JOIN pt ON ps.pair_id = pt.pair_id AND ps.tbl = pt.tbl AND ps.k = pt.k)
SELECT z.pair_id, z.tbl, src_row, tpl_row, CAST(CASE WHEN len(sv) > 0 AND len(tv) > 0 THEN CASE WHEN list_has_any(sv, tv) THEN 0.65 ELSE 0.35 END
   WHEN a.n = b.n AND EXISTS (SELECT 1 FROM dn WHERE dn.pair_id = z.pair_id AND dn.tbl = z.tbl) THEN 0.55 WHEN a.n = b.n THEN 0.5 ELSE 0.4 END AS DOUBLE) AS confidence,
   'position_fallback' AS method
FROM z JOIN (SELECT pair_id, tbl, COUNT(*) AS n FROM xs GROUP BY 1, 2) a ON a.pair_id = z.pair_id AND a.tbl = z.tbl
 JOIN (SELECT pair_id, tbl, COUNT(*) AS n FROM xt GROUP BY 1, 2) b ON b.pair_id = z.pair_id AND b.tbl = z.tbl""")
def _c13(src, tpl, terms):
    s, t, exact, similar = _exact_and_similar(src, tpl, terms)
    return rw.match_by_position(s, t, KEYS, exact.unionByName(similar))


@query("c14_zip_tables", ["src_rows", "tpl_rows"], f"""
WITH a AS (SELECT pair_id, note_seq AS pos, COUNT(*) AS n FROM src_rows GROUP BY 1, 2),
 b AS (SELECT pair_id, tt, DENSE_RANK() OVER (PARTITION BY pair_id ORDER BY tt) AS pos, n FROM (SELECT pair_id, tpl_table AS tt, COUNT(*) AS n FROM tpl_rows GROUP BY 1, 2) q),
 m AS (SELECT b.pair_id, b.pos, SUM(LEAST(x.c, y.c)) AS n FROM b
   JOIN (SELECT pair_id, tpl_table, {norm_label('label')} AS lb, COUNT(*) AS c FROM tpl_rows GROUP BY 1, 2, 3) y ON y.pair_id = b.pair_id AND y.tpl_table = b.tt
   JOIN (SELECT pair_id, note_seq, {norm_label('label')} AS lb, COUNT(*) AS c FROM src_rows GROUP BY 1, 2, 3) x ON x.pair_id = b.pair_id AND x.note_seq = b.pos AND x.lb = y.lb GROUP BY 1, 2)
SELECT COALESCE(a.pair_id, b.pair_id) AS pair_id, CAST(COALESCE(a.pos, b.pos) AS BIGINT) AS pos, b.pos IS NULL AS is_new, a.pos IS NULL AS is_deleted,
  CASE WHEN a.n IS NULL OR b.n IS NULL OR COALESCE(m.n, 0) = 0 THEN 'major' WHEN a.n > m.n OR b.n > m.n THEN 'moderate' ELSE 'minor' END AS magnitude
FROM a FULL OUTER JOIN b ON a.pair_id = b.pair_id AND a.pos = b.pos LEFT JOIN m ON m.pair_id = b.pair_id AND m.pos = b.pos""")
def _c14(src, tpl):
    from pyspark.sql import Window

    a = src.groupBy("pair_id", F.col("note_seq").alias("pos")).agg(F.count("*").alias("n_rows"))
    b = tpl.groupBy("pair_id", "tpl_table").agg(F.count("*").alias("n_rows")).withColumn(
        "pos", F.dense_rank().over(Window.partitionBy("pair_id").orderBy("tpl_table")).cast("bigint"))
    s = src.select("pair_id", F.col("note_seq").alias("tbl"), F.col("row_idx").alias("src_row"), F.col("label").alias("src_label"))
    t = tpl.join(b.drop("n_rows"), ["pair_id", "tpl_table"]).select(
        "pair_id", F.col("pos").alias("tbl"), F.col("row_idx").alias("tpl_row"), F.col("label").alias("tpl_label"))
    m = rw.match_exact_labels(s, t, KEYS).groupBy("pair_id", F.col("tbl").alias("pos")).agg(F.count("*").alias("n_matched"))
    return rw.zip_tables(a, b.drop("tpl_table"), ["pair_id"], m)


@query("c15_plausible_values", ["row_pairs"], """
SELECT pair_id, note_no, src_row, COALESCE((ABS(p) < 1 AND ABS(c) < 1) OR ABS(p - c) < 1.5 OR p = 0 OR c = 0
   OR CAST(GREATEST(ABS(p), ABS(c)) AS DOUBLE) / CAST(LEAST(ABS(p), ABS(c)) AS DOUBLE) <= 2.0, TRUE) AS plausible
FROM (SELECT pair_id, note_no, src_row, exp_pri AS p, tpl_cur AS c FROM row_pairs) q""")
def _c15(rows):
    return rows.select("pair_id", "note_no", "src_row", rw.plausible_values(F.col("exp_pri"), F.col("tpl_cur")).alias("plausible"))


LOOKS_AMOUNT = r"(t NOT IN ('', '-', '–', '—', chr(92)) AND TRY_CAST(regexp_replace(regexp_replace(t, '^[()]+|[()]+$', '', 'g'), '[₩$€¥£\s,]', '', 'g') AS DECIMAL(38,6)) IS NOT NULL)"


@query("c16_align_columns", ["row_pairs", "src_cells", "tpl_cells"], f"""
WITH k AS (SELECT pair_id, note_no, src_row, tpl_table, tpl_row FROM row_pairs),
 a AS (SELECT k.pair_id, k.note_no, k.src_row, c.col_idx AS col, ROW_NUMBER() OVER (PARTITION BY k.pair_id, k.note_no, k.src_row ORDER BY c.col_idx) AS n
   FROM k JOIN (SELECT pair_id, note_no, row_idx, col_idx, {o.strip('text')} AS t FROM src_cells) c ON c.pair_id = k.pair_id AND c.note_no = k.note_no AND c.row_idx = k.src_row
   WHERE {LOOKS_AMOUNT} AND c.col_idx <> 1),
 b AS (SELECT k.pair_id, k.note_no, k.src_row, c.cell_idx AS col, ROW_NUMBER() OVER (PARTITION BY k.pair_id, k.note_no, k.src_row ORDER BY c.cell_idx) AS n
   FROM k JOIN (SELECT pair_id, tpl_table, row_idx, cell_idx, {o.strip('text')} AS t FROM tpl_cells) c ON c.pair_id = k.pair_id AND c.tpl_table = k.tpl_table AND c.row_idx = k.tpl_row
   WHERE {LOOKS_AMOUNT} AND c.cell_idx <> 1)
SELECT pair_id, note_no, src_row, CAST(1 AS BIGINT) AS src_col, CAST(1 AS BIGINT) AS tpl_col FROM k
UNION ALL SELECT a.pair_id, a.note_no, a.src_row, a.col, b.col FROM a JOIN b ON a.pair_id = b.pair_id AND a.note_no = b.note_no AND a.src_row = b.src_row AND a.n = b.n""")
def _c16(rows, sc, tc):
    k = rows.select("pair_id", "note_no", "src_row", "tpl_table", "tpl_row")
    keys = ["pair_id", "note_no", "src_row"]
    # told before the join, so that cells without an amount don't reach it
    told = lambda cells, at, col: once(cells.select(*at, F.col("row_idx"), F.col(col).alias("col"), nb.has_amount("text").alias("numeric")), "numeric")
    a = k.join(told(sc, ["pair_id", "note_no"], "col_idx").withColumnRenamed("row_idx", "src_row"), keys).select(*keys, "col", "numeric")
    b = k.join(told(tc, ["pair_id", "tpl_table"], "cell_idx").withColumnRenamed("row_idx", "tpl_row"), ["pair_id", "tpl_table", "tpl_row"]).select(*keys, "col", "numeric")
    periods = k.select(*keys, F.lit(1).cast("bigint").alias("src_col"), F.lit(1).cast("bigint").alias("tpl_col"))
    return rw.align_columns(a, b, keys, periods)


@query("c22_first_label_hit", ["src_rows", "tpl_rows"], """
SELECT s.pair_id, s.note_seq AS tbl, s.row_idx AS src_row,
  (SELECT MIN(t.row_idx) FROM tpl_rows t WHERE t.pair_id = s.pair_id AND t.tpl_table = s.note_seq AND (contains(t.label, s.label) OR contains(s.label, t.label))) AS tpl_row FROM src_rows s""")
def _c22(src, tpl):
    s, t = _sides(src, tpl)
    return rw.first_label_hit(s, t, KEYS)


# --- values ------------------------------------------------------------------

@query("c19_statement_tables", ["stmt_rows", "tpl_notes"], """
WITH w AS (SELECT DISTINCT pair_id, stmt_type FROM stmt_rows),
 st AS (SELECT DISTINCT pair_id, note_seq, 'BS' AS stmt_type FROM tpl_notes WHERE note_id = 'LARGE'),
 tt AS (SELECT pair_id, note_seq, CASE note_id WHEN 'ECONOMY' THEN 'Statement of Financial Position' WHEN 'MEDIUM' THEN 'Comprehensive income 2024'
   WHEN 'PROMO' THEN 'Cash flows' WHEN 'SMALL' THEN 'Income from equity' ELSE title END AS title FROM tpl_notes),
 j AS (SELECT w.pair_id, w.stmt_type, (SELECT MIN(note_seq) FROM st WHERE st.pair_id = w.pair_id AND st.stmt_type = w.stmt_type) AS d,
   (SELECT MIN(note_seq) FROM tt WHERE tt.pair_id = w.pair_id AND CASE w.stmt_type WHEN 'BS' THEN contains(lower(title), 'balance sheet') OR contains(lower(title), 'financial position')
     WHEN 'IS' THEN contains(lower(title), 'income') OR contains(lower(title), 'profit or loss') WHEN 'CF' THEN contains(lower(title), 'cash flow') END) AS t FROM w)
SELECT pair_id, stmt_type, COALESCE(d, t) AS table_seq, CASE WHEN d IS NOT NULL THEN 'type' WHEN t IS NOT NULL THEN 'title' ELSE 'none' END AS found_by FROM j""")
def _c19(stmts, notes):
    wanted = stmts.select("pair_id", "stmt_type").distinct()
    typed = notes.where("note_id = 'LARGE'").select("pair_id", F.lit("BS").alias("stmt_type"), F.col("note_seq").alias("table_seq"))
    title = F.expr("CASE note_id WHEN 'ECONOMY' THEN 'Statement of Financial Position' WHEN 'MEDIUM' THEN 'Comprehensive income 2024' "
                   "WHEN 'PROMO' THEN 'Cash flows' WHEN 'SMALL' THEN 'Income from equity' ELSE title END")
    return cp.find_statement_tables(wanted, typed, notes.select("pair_id", F.col("note_seq").alias("table_seq"), title.alias("title")))


NOTE_KEYS = ["pair_id", "note_no"]


def _amounts(cells):
    v = F.when(tx.strip("text") != "", nb.parse_source_amount("text")).cast("bigint")
    return cells.select(*NOTE_KEYS, "row_idx", "col_idx", v.alias("value"))


AMT = lambda t: f"(SELECT pair_id, note_no, row_idx, col_idx, CAST(CASE WHEN trim(text) <> '' THEN {source_amount('text')} END AS BIGINT) AS value FROM {t})"
COMPARED = f"""
 e AS (SELECT * FROM {AMT('src_cells')} q WHERE value IS NOT NULL), a AS (SELECT * FROM {AMT('out_cells')} q WHERE value IS NOT NULL),
 cmp AS (SELECT e.pair_id, e.note_no, e.row_idx, e.col_idx, e.value AS expected, a.value AS found,
   CASE WHEN a.value IS NULL THEN 'missing' WHEN ABS(e.value - a.value) > 1 THEN 'mismatch' ELSE 'ok' END AS verdict
   FROM e LEFT JOIN a ON a.pair_id = e.pair_id AND a.note_no = e.note_no AND a.row_idx = e.row_idx AND a.col_idx = e.col_idx)"""


@query("c21_compare_cells", ["src_cells", "out_cells"], f"WITH {COMPARED} SELECT * FROM cmp")
def _c21(src, out):
    return cp.compare_cells(_amounts(src), _amounts(out), NOTE_KEYS)


@query("c20_compare_note_tables", ["src_cells", "out_cells"], f"""WITH {COMPARED}
SELECT pair_id, note_no, CAST(COUNT(*) FILTER (verdict = 'missing') AS BIGINT) AS n_missing, CAST(COUNT(*) FILTER (verdict = 'mismatch') AS BIGINT) AS n_mismatch,
 CAST(COUNT(*) AS BIGINT) AS n_cells, CASE WHEN COUNT(*) FILTER (verdict = 'mismatch') > 0 THEN 'CRITICAL' WHEN COUNT(*) FILTER (verdict = 'missing') > 0 THEN 'WARNING' ELSE 'INFO' END AS severity
FROM cmp GROUP BY pair_id, note_no""")
def _c20(src, out):
    return cp.cell_findings(cp.compare_cells(_amounts(src), _amounts(out), NOTE_KEYS), NOTE_KEYS)


@query("c23_direct_row_compare", ["src_rows", "tpl_rows"], f"""
WITH m AS (SELECT s.pair_id, t.tpl_table, t.row_idx, {o.convert('s.cur_amt', 's.unit', 't.unit')} AS ec, {o.convert('s.pri_amt', 's.unit', 't.unit')} AS ep, t.cur_amt AS fc, t.pri_amt AS fp
  FROM src_rows s JOIN tpl_rows t ON t.pair_id = s.pair_id AND t.note_seq = s.note_seq AND t.row_idx = s.row_idx)
SELECT pair_id, tpl_table, row_idx, CASE WHEN ec IS NULL AND fc IS NULL THEN TRUE WHEN ec IS NOT NULL AND fc IS NOT NULL THEN ABS(ec - fc) <= 1 ELSE COALESCE(ec, fc) = 0 END AS cur_ok,
 CASE WHEN ep IS NULL AND fp IS NULL THEN TRUE WHEN ep IS NOT NULL AND fp IS NOT NULL THEN ABS(ep - fp) <= 1 ELSE COALESCE(ep, fp) = 0 END AS pri_ok FROM m""")
def _c23(src, tpl):
    s = src.select("pair_id", "note_seq", "row_idx", F.col("cur_amt").alias("sc"), F.col("pri_amt").alias("sp"), F.col("unit").alias("su"))
    j = s.join(tpl, ["pair_id", "note_seq", "row_idx"])
    return j.select("pair_id", "tpl_table", "row_idx", nb.amounts_match(nb.convert_unit("sc", "su", "unit"), "cur_amt").alias("cur_ok"),
                    nb.amounts_match(nb.convert_unit("sp", "su", "unit"), "pri_amt").alias("pri_ok"))


def number_sides(src, tpl):
    """Numbers of both sides in reading order, and row counts."""
    def melt(df, key, name, cur, pri):
        return df.select("pair_id", F.col(key).alias(name), "row_idx", F.posexplode(F.array(cur, pri)).alias("col_idx", "value"))

    won, k = F.lit("won"), F.lit("thousand")
    a = melt(src, "note_seq", "l", nb.convert_unit("cur_amt", won, k), nb.convert_unit("pri_amt", won, k))
    b = melt(tpl, "tpl_table", "r", F.col("cur_amt"), F.col("pri_amt"))
    n = lambda df, key, side: df.groupBy("pair_id", F.col(key).alias("id")).agg(F.count("*").alias("n_rows")).withColumn("side", F.lit(side))
    return a, b, n(src, "note_seq", "l").unionByName(n(tpl, "tpl_table", "r"))


NUMBERS = f"""
 nl AS (SELECT pair_id, note_seq AS id, row_idx, c, CASE c WHEN 0 THEN {o.convert('cur_amt', "'won'", "'thousand'")} ELSE {o.convert('pri_amt', "'won'", "'thousand'")} END AS v FROM src_rows CROSS JOIN (SELECT unnest([0, 1]) AS c) x),
 nr AS (SELECT pair_id, tpl_table AS id, row_idx, c, CASE c WHEN 0 THEN cur_amt ELSE pri_amt END AS v FROM tpl_rows CROSS JOIN (SELECT unnest([0, 1]) AS c) x),
 zl AS (SELECT pair_id, note_seq AS id, COUNT(*) AS n FROM src_rows GROUP BY 1, 2), zr AS (SELECT pair_id, tpl_table AS id, COUNT(*) AS n FROM tpl_rows GROUP BY 1, 2)"""


SHARE = f"""{NUMBERS},
 fl AS (SELECT DISTINCT * FROM (SELECT pair_id, id, v FROM nl WHERE v <> 0) q), fr AS (SELECT DISTINCT * FROM (SELECT pair_id, id, v FROM nr WHERE v <> 0) q),
 ce AS (SELECT fl.pair_id AS g, fl.id AS l, fr.id AS r, fr.id AS o, CAST(COUNT(*) AS DOUBLE) / CAST(MAX(a.n) AS DOUBLE) AS s FROM fl JOIN fr ON fl.pair_id = fr.pair_id AND fl.v = fr.v
   JOIN (SELECT pair_id, id, COUNT(*) AS n FROM fl GROUP BY 1, 2) a ON a.pair_id = fl.pair_id AND a.id = fl.id
   JOIN zl ON zl.pair_id = fl.pair_id AND zl.id = fl.id JOIN zr ON zr.pair_id = fr.pair_id AND zr.id = fr.id
   WHERE ABS(zr.n - zl.n) <= GREATEST(10, zl.n * 0.5) GROUP BY 1, 2, 3 HAVING CAST(COUNT(*) AS DOUBLE) / CAST(MAX(a.n) AS DOUBLE) >= 0.3),
 qm AS (SELECT g AS pair_id, l, r, s AS score FROM {o.greedy('ce')} z)"""


@query("c26_match_by_number_share", ["src_rows", "tpl_rows"], f"WITH {SHARE} SELECT pair_id, l, r, score FROM qm")
def _c26(src, tpl):
    return cp.match_by_number_share(*number_sides(src, tpl))


@query("c27_sample_match", ["src_rows", "tpl_rows"], f"""WITH {NUMBERS},
 fl AS (SELECT pair_id, id, v FROM nl WHERE v <> 0),
 n AS (SELECT pair_id, id, COUNT(*) AS n FROM fl GROUP BY 1, 2),
 e AS (SELECT fl.pair_id, fl.id AS l, b.id AS r, CAST(COUNT(*) AS DOUBLE) / CAST(MAX(n.n) AS DOUBLE) AS score FROM fl JOIN (SELECT DISTINCT pair_id, id, v FROM nr WHERE v <> 0) b ON b.pair_id = fl.pair_id AND b.v = fl.v
   JOIN n ON n.pair_id = fl.pair_id AND n.id = fl.id JOIN zl ON zl.pair_id = fl.pair_id AND zl.id = fl.id JOIN zr ON zr.pair_id = b.pair_id AND zr.id = b.id WHERE ABS(zr.n - zl.n) <= 5 GROUP BY 1, 2, 3)
SELECT n.pair_id, n.id AS l, e.r, e.score FROM n LEFT JOIN (SELECT * FROM e QUALIFY ROW_NUMBER() OVER (PARTITION BY pair_id, l ORDER BY score DESC, r) = 1) e ON e.pair_id = n.pair_id AND e.l = n.id""")
def _c27(src, tpl):
    return cp.best_sample_match(*number_sides(src, tpl))
