"""Queries: change sets, patches, year rolling and document checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.functions import dates as d
from ledgerloom.functions import numbers as nb
from ledgerloom.operators import changes as ch
from ledgerloom.operators import quality as ql
from ledgerloom.plans import oracle as o
from ledgerloom.plans.checks import FILLED, _filled
from ledgerloom.plans.registry import query
from ledgerloom.session import shared_dir

T = o.strip("text")
IS_CELL = f"({T} IN ('', '-', '–', '—', '/', chr(92)) OR regexp_full_match(replace(translate({T}, ',()- △▲' || chr(92), ''), '.', ''), '[0-9]*'))"
BASE = "(SELECT * FROM tpl_cells)"


def base(cells):
    return cells


FILLED_CELLS = f"""rp AS (SELECT * FROM row_pairs), fi AS (SELECT pair_id, tpl_table, tpl_row AS row_idx, CAST(2 AS BIGINT) AS phys_col, {o.fmt('exp_cur')} AS value FROM rp
  UNION ALL SELECT pair_id, tpl_table, tpl_row, CASE WHEN note_no = 'SMALL' THEN 0 ELSE 4 END, {o.fmt('exp_pri')} FROM rp),
 fc AS (SELECT fi.pair_id, fi.tpl_table, fi.row_idx, fi.phys_col, CASE WHEN c.text IS NULL THEN 'missing' WHEN {IS_CELL.replace('text', 'c.text')} THEN 'updated' ELSE 'skipped' END AS status, fi.value, c.text AS old
   FROM fi LEFT JOIN tpl_cells c ON c.pair_id = fi.pair_id AND c.tpl_table = fi.tpl_table AND c.row_idx = fi.row_idx AND c.phys_col = fi.phys_col)"""


def _filled_cells(cells, rows):
    return ch.fill_cells(cells, ch.fills_of(rows, F.lit(2), F.when(F.col("note_no") == "SMALL", 0).otherwise(4)))


@query("j01_fill_cells", ["tpl_cells", "row_pairs"], f"WITH {FILLED_CELLS} SELECT pair_id, tpl_table, row_idx, phys_col, status, CASE WHEN status = 'updated' THEN value ELSE old END AS text FROM fc")
def _j01(cells, rows):
    return _filled_cells(cells, rows)


@query("b02_fill_report", ["tpl_cells", "row_pairs"], f"""WITH {FILLED_CELLS}
SELECT m.*, CAST(COALESCE(n.u, 0) AS BIGINT) AS cells_updated, CAST(COALESCE(n.s, 0) AS BIGINT) AS cells_skipped FROM (SELECT pair_id, tpl_table, note_no, CAST(COUNT(*) AS BIGINT) AS n_rows FROM rp GROUP BY ALL) m
LEFT JOIN (SELECT pair_id, tpl_table, COUNT(*) FILTER (status = 'updated') AS u, COUNT(*) FILTER (status = 'skipped') AS s FROM fc GROUP BY ALL) n ON n.pair_id = m.pair_id AND n.tpl_table = m.tpl_table""")
def _b02(cells, rows):
    return ch.fill_report(_filled_cells(cells, rows), rows.groupBy("pair_id", "tpl_table", "note_no").agg(F.count("*").alias("n_rows")))


@query("e08_fill_statistics", ["tpl_cells", "row_pairs"], f"""WITH {FILLED_CELLS}
SELECT pair_id, CAST(COUNT(DISTINCT tpl_table) AS BIGINT) AS tables, CAST(COUNT(*) FILTER (status = 'updated') AS BIGINT) AS cells_updated, CAST(COUNT(*) FILTER (status = 'skipped') AS BIGINT) AS cells_skipped, CAST(COUNT(*) FILTER (status = 'missing') AS BIGINT) AS errors FROM fc GROUP BY pair_id""")
def _e08(cells, rows):
    n = lambda s: F.count_if(F.col("status") == s)
    return _filled_cells(cells, rows).groupBy("pair_id").agg(F.count_distinct("tpl_table").alias("tables"), n("updated").alias("cells_updated"), n("skipped").alias("cells_skipped"), n("missing").alias("errors"))


@query("b01_write_patched_cells", ["tpl_cells", "row_pairs"], f"WITH {FILLED_CELLS} SELECT tpl_table, status, CAST(COUNT(*) AS BIGINT) AS n FROM fc GROUP BY ALL")
def _b01(cells, rows):
    spark = cells.sparkSession
    path = f"{shared_dir(spark)}/patched_cells-{uuid.uuid4().hex}"
    _filled_cells(cells, rows).repartition("tpl_table").write.mode("overwrite").partitionBy("tpl_table").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("tpl_table").cast("bigint").alias("tpl_table"), "status").agg(F.count("*").alias("n"))


LEFT = """mt AS (SELECT pair_id, tpl_table AS tbl, src_row, tpl_row FROM row_pairs WHERE exp_pri = tpl_cur),
 a AS (SELECT pair_id, note_seq AS tbl, row_idx AS src_row FROM src_rows s WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.pair_id = s.pair_id AND mt.tbl = s.note_seq AND mt.src_row = s.row_idx)),
 b AS (SELECT pair_id, tpl_table AS tbl, row_idx AS tpl_row FROM tpl_base s WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.pair_id = s.pair_id AND mt.tbl = s.tpl_table AND mt.tpl_row = s.row_idx))"""


@query("j02_fill_by_position", ["src_rows", "tpl_base", "row_pairs"], f"""WITH {LEFT}
SELECT COALESCE(a.pair_id, b.pair_id) AS pair_id, COALESCE(a.tbl, b.tbl) AS tbl, a.src_row, b.tpl_row FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pair_id, tbl ORDER BY src_row) AS k FROM a) a FULL JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY pair_id, tbl ORDER BY tpl_row) AS k FROM b) b
 ON a.pair_id = b.pair_id AND a.tbl = b.tbl AND a.k = b.k""")
def _j02(src, tpl, rows):
    m = rows.where("exp_pri = tpl_cur").select("pair_id", F.col("tpl_table").alias("tbl"), "src_row", "tpl_row")
    s = src.select("pair_id", F.col("note_seq").alias("tbl"), F.col("row_idx").alias("src_row"))
    t = tpl.select("pair_id", F.col("tpl_table").alias("tbl"), F.col("row_idx").alias("tpl_row"))
    return ch.leftover_rows_by_place(s, t, m, ["pair_id", "tbl"])


@query("j03_repair_totals", ["filled"], f"""
SELECT pair_id, tpl_table, row, CASE WHEN oc THEN {o.fmt('exp_cur')} ELSE cur_text END AS cur_text, CASE WHEN op THEN {o.fmt('exp_pri')} ELSE pri_text END AS pri_text
FROM (SELECT *, COALESCE(ABS(exp_cur - {o.whole('cur_text')}) > 1, FALSE) AS oc, COALESCE(ABS(exp_pri - {o.whole('pri_text')}) > 1, FALSE) AS op FROM {FILLED} f WHERE is_total) q WHERE oc OR op""")
def _j03(f):
    return ch.repair_totals(_filled(f))


HAS = r"({t} NOT IN ('', '-', '–', '—', chr(92)) AND TRY_CAST(regexp_replace(regexp_replace({t}, '^[()]+|[()]+$', '', 'g'), '[₩$€¥£\s,]', '', 'g') AS DECIMAL(38,6)) IS NOT NULL)"


@query("j04_value_changes", ["row_pairs", "src_cells", "tpl_cells"], f"""
WITH k AS (SELECT *, CASE WHEN n % 3 = 0 THEN 1.0 WHEN n % 3 = 1 THEN 0.8 ELSE 0.35 END AS conf, CASE WHEN n % 3 = 0 THEN 'exact_label' WHEN n % 3 = 1 THEN 'similar_label' ELSE 'position_fallback' END AS method FROM row_pairs),
 j AS (SELECT k.*, s.col_idx, trim(s.text) AS st, trim(t.text) AS tt FROM k JOIN src_cells s ON s.pair_id = k.pair_id AND s.note_no = k.note_no AND s.row_idx = k.src_row JOIN tpl_cells t ON t.pair_id = k.pair_id AND t.tpl_table = k.tpl_table AND t.row_idx = k.tpl_row AND t.cell_idx = s.col_idx WHERE s.col_idx > 0)
SELECT pair_id, tpl_table, tpl_row AS row_idx, col_idx * 2 AS phys_col, 'update_values' AS type, st AS value FROM j WHERE conf >= 0.5 AND {HAS.format(t='st')} AND {HAS.format(t='tt')} AND st <> tt
 AND (method <> 'similar_label' OR COALESCE((ABS(exp_pri) < 1 AND ABS(tpl_cur) < 1) OR ABS(exp_pri - tpl_cur) < 1.5 OR exp_pri = 0 OR tpl_cur = 0 OR CAST(GREATEST(ABS(exp_pri), ABS(tpl_cur)) AS DOUBLE) / LEAST(ABS(exp_pri), ABS(tpl_cur)) <= 2.0, TRUE))""")
def _j04(rows, sc, tc):
    r = F.col("n") % 3
    k = rows.select("pair_id", "note_no", "src_row", "tpl_table", "tpl_row", F.when(r == 0, 1.0).when(r == 1, 0.8).otherwise(0.35).alias("confidence"),
                    F.when(r == 0, "exact_label").when(r == 1, "similar_label").otherwise("position_fallback").alias("method"),
                    F.col("exp_pri").alias("src_prior"), F.col("tpl_cur").alias("tpl_current"))
    s = sc.where("col_idx > 0").select("pair_id", "note_no", F.col("row_idx").alias("src_row"), F.col("col_idx").alias("cell_idx"), F.col("text").alias("src_text"))
    t = tc.select("pair_id", "tpl_table", F.col("row_idx").alias("tpl_row"), "cell_idx", F.col("text").alias("tpl_text"))
    p = k.join(s, ["pair_id", "note_no", "src_row"]).join(t, ["pair_id", "tpl_table", "tpl_row", "cell_idx"])
    return ch.value_changes(p).select("pair_id", "tpl_table", F.col("tpl_row").alias("row_idx"), (F.col("cell_idx") * 2).alias("phys_col"), "type", "value")


@query("e02_changes_by_type", ["changes"], "SELECT type, CAST(COUNT(*) AS BIGINT) AS n FROM changes GROUP BY type")
def _e02(changes):
    return changes.groupBy("type").agg(F.count("*").alias("n"))


@query("c24_resolve_notes", ["row_pairs", "tpl_rows"], """
WITH t AS (SELECT pair_id, note_seq, tpl_table, ROW_NUMBER() OVER (PARTITION BY pair_id, note_seq ORDER BY tpl_table) - 1 AS nth FROM (SELECT DISTINCT pair_id, note_seq, tpl_table FROM tpl_rows) q),
 c AS (SELECT pair_id, note_no, src_row, note_seq + CASE WHEN src_row % 9 = 4 THEN 50 ELSE 0 END AS note, src_row % 4 AS element FROM row_pairs)
SELECT c.pair_id, c.note_no, c.src_row, c.note, c.element, t.tpl_table FROM c LEFT JOIN (SELECT pair_id, note_seq, MAX(nth) AS top FROM t GROUP BY ALL) m ON m.pair_id = c.pair_id AND m.note_seq = c.note
 LEFT JOIN t ON t.pair_id = c.pair_id AND t.note_seq = c.note AND t.nth = LEAST(c.element, m.top)""")
def _c24(rows, tpl):
    from pyspark.sql import Window

    t = tpl.select("pair_id", F.col("note_seq").alias("note"), "tpl_table").distinct()
    t = t.withColumn("nth", (F.row_number().over(Window.partitionBy("pair_id", "note").orderBy("tpl_table")) - 1).cast("bigint"))
    c = rows.select("pair_id", "note_no", "src_row", (F.col("note_seq") + F.when(F.col("src_row") % 9 == 4, 50).otherwise(0)).alias("note"), (F.col("src_row") % 4).alias("element"))
    return ch.resolve_notes(c, t)


@query("c25_nearest_table", ["row_pairs", "tpl_rows"], """
WITH w AS (SELECT pair_id, src_row, tpl_table * 3 + src_row % 11 AS pos FROM row_pairs), t AS (SELECT DISTINCT pair_id, tpl_table * 5 AS at FROM tpl_rows),
 k AS (SELECT DISTINCT pair_id, pos FROM w),
 h AS (SELECT k.pair_id, k.pos, arg_min(t.at, ABS(t.at - k.pos) * 2 - CASE WHEN t.at > k.pos THEN 1 ELSE 0 END) AS tpl_table FROM k JOIN t ON t.pair_id = k.pair_id AND ABS(t.at - k.pos) <= 3 GROUP BY ALL)
SELECT w.pair_id, w.src_row, w.pos, h.tpl_table FROM w LEFT JOIN h ON h.pair_id = w.pair_id AND h.pos = w.pos""")
def _c25(rows, tpl):
    w = rows.select("pair_id", "src_row", (F.col("tpl_table") * 3 + F.col("src_row") % 11).alias("pos"))
    return ch.nearest_table(w, tpl.select("pair_id", (F.col("tpl_table") * 5).alias("pos")))


DELETIONS = "(SELECT pair_id, tpl_table * 7 AS start, 1 + tpl_table % 3 AS count FROM (SELECT DISTINCT pair_id, tpl_table FROM tpl_rows WHERE tpl_table % 2 = 0) q)"


@query("w12_shift_positions", ["row_pairs", "tpl_rows"], f"""
SELECT p.pair_id, p.pos, p.pos - CAST(COALESCE((SELECT SUM(LEAST(d.count, p.pos - d.start)) FROM {DELETIONS} d WHERE d.pair_id = p.pair_id AND d.start < p.pos), 0) AS BIGINT) AS new_pos
FROM (SELECT DISTINCT pair_id, tpl_table * 5 + src_row AS pos FROM row_pairs) p""")
def _w12(rows, tpl):
    p = rows.select("pair_id", (F.col("tpl_table") * 5 + F.col("src_row")).alias("pos"))
    dl = tpl.where("tpl_table % 2 = 0").select("pair_id", "tpl_table").distinct().select("pair_id", (F.col("tpl_table") * 7).alias("start"), (1 + F.col("tpl_table") % 3).alias("count"))
    return ch.shift_positions(p, dl, ["pair_id"])


def _split(changes):
    return changes.select("pair_id", "type", "tpl_table", F.col("tpl_row").alias("row_idx"), F.lit(2).cast("bigint").alias("phys_col"), "value", (F.col("tpl_table") * 1000 + F.col("tpl_row")).alias("change_no"))


def _cells(cells):
    return base(cells).select("pair_id", "tpl_table", "row_idx", "phys_col", "text")


@query("j11_update_cells", ["tpl_cells", "changes"], f"""
WITH u AS (SELECT pair_id, tpl_table, tpl_row, value, CASE WHEN tpl_row % 4 = 1 THEN 0 ELSE 2 END AS col FROM changes WHERE type = 'update_values')
SELECT c.pair_id, c.tpl_table, c.row_idx, c.phys_col, CASE WHEN u.value IS NOT NULL AND NOT lab THEN u.value ELSE c.text END AS text, CASE WHEN u.value IS NULL THEN NULL WHEN lab THEN 'skipped' ELSE 'ok' END AS status
FROM (SELECT *, ({T} <> '' AND translate({T}, ',()- ' || chr(92), '') <> '' AND NOT regexp_full_match(replace(translate({T}, ',()- ' || chr(92), ''), '.', ''), '[0-9]+')) AS lab FROM {BASE} b) c
LEFT JOIN u ON u.pair_id = c.pair_id AND u.tpl_table = c.tpl_table AND u.tpl_row = c.row_idx AND u.col = c.phys_col""")
def _j11(cells, changes):
    u = _split(changes).where("type = 'update_values'").withColumn("phys_col", F.when(F.col("row_idx") % 4 == 1, 0).otherwise(2).cast("bigint"))
    return ch.update_cells(_cells(cells), u)


GONE = "(SELECT DISTINCT pair_id, tpl_table, tpl_row FROM changes WHERE type = 'delete_row')"


@query("j12_delete_rows", ["tpl_cells", "changes"], f"""
SELECT c.pair_id, c.tpl_table, c.row_idx - (SELECT COUNT(*) FROM {GONE} g WHERE g.pair_id = c.pair_id AND g.tpl_table = c.tpl_table AND g.tpl_row < c.row_idx) AS row_idx, c.phys_col, c.text
FROM {BASE} c WHERE NOT EXISTS (SELECT 1 FROM {GONE} g WHERE g.pair_id = c.pair_id AND g.tpl_table = c.tpl_table AND g.tpl_row = c.row_idx)""")
def _j12(cells, changes):
    return ch.delete_rows(_cells(cells), _split(changes).where("type = 'delete_row'"))


@query("j12_delete_tables", ["tpl_cells"], f"""
SELECT c.pair_id, CAST(c.tpl_table - (SELECT COUNT(DISTINCT tpl_table) FROM {BASE} g WHERE g.pair_id = c.pair_id AND g.tpl_table < c.tpl_table AND (g.pair_id + g.tpl_table) % 3 = 0) AS BIGINT) AS tpl_table, c.row_idx, c.phys_col, c.text
FROM {BASE} c WHERE (pair_id + tpl_table) % 3 <> 0""")
def _j12t(cells):
    c = _cells(cells)
    return ch.delete_tables(c, c.where("(pair_id + tpl_table) % 3 = 0").select("pair_id", "tpl_table").distinct())


ADD = "(SELECT pair_id, tpl_table, tpl_row, MAX(value) AS value FROM changes WHERE type = 'add_row' GROUP BY ALL)"
MOVED = f"c.row_idx + (SELECT COUNT(*) FROM {ADD} a WHERE a.pair_id = c.pair_id AND a.tpl_table = c.tpl_table AND a.tpl_row < c.row_idx)"


@query("j13_add_rows", ["tpl_cells", "changes"], f"""
SELECT c.pair_id, c.tpl_table, {MOVED} AS row_idx, c.phys_col, c.text, FALSE AS added FROM {BASE} c
UNION ALL SELECT c.pair_id, c.tpl_table, {MOVED} + 1, c.phys_col, CASE WHEN c.phys_col = 2 THEN a.value ELSE c.text END, TRUE FROM {BASE} c JOIN {ADD} a ON a.pair_id = c.pair_id AND a.tpl_table = c.tpl_table AND a.tpl_row = c.row_idx""")
def _j13(cells, changes):
    a = _split(changes).where("type = 'add_row'").select("pair_id", "tpl_table", F.col("row_idx").alias("ref_row"), F.lit(1).alias("nth"), F.lit("after").alias("place"),
                                                         F.create_map("phys_col", "value").alias("values"))
    return ch.add_rows(_cells(cells), a)


PICKED = f"(SELECT DISTINCT pair_id, tpl_table FROM {BASE} b WHERE (pair_id + tpl_table) % 4 = 0)"


@query("j14_add_tables", ["tpl_cells"], f"""
WITH m AS (SELECT c.*, c.tpl_table + (SELECT COUNT(*) FROM {PICKED} p WHERE p.pair_id = c.pair_id AND p.tpl_table < c.tpl_table) AS nt FROM {BASE} c)
SELECT pair_id, CAST(nt AS BIGINT) AS tpl_table, row_idx, phys_col, text, FALSE AS added FROM m
UNION ALL SELECT m.pair_id, CAST(nt + 1 AS BIGINT), row_idx, phys_col, CASE WHEN row_idx = 2 AND phys_col = 2 THEN '77' WHEN row_idx < 2 OR phys_col = 0 THEN text ELSE '' END, TRUE FROM m JOIN {PICKED} p ON p.pair_id = m.pair_id AND p.tpl_table = m.tpl_table""")
def _j14(cells):
    c = _cells(cells)
    two = F.lit(2).cast("bigint")
    a = c.where("(pair_id + tpl_table) % 4 = 0").select("pair_id", F.col("tpl_table").alias("ref_table")).distinct().withColumns(
        {"addition_id": F.lit(1), "values": F.create_map(two, F.create_map(two, F.lit("77")))})
    return ch.add_tables(c, a)


@query("j15_hand_over_merges", ["grid"], """
WITH g AS (SELECT table_id, cell_idx, row_idx, vmerge, (table_id + row_idx) % 3 = 0 AS gone FROM grid),
 w AS (SELECT *, MAX(row_idx) FILTER (NOT gone) OVER b AS stay, MAX(row_idx) FILTER (gone AND vmerge = 'restart') OVER b AS orig FROM g WINDOW b AS (PARTITION BY table_id, cell_idx ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT table_id, cell_idx, row_idx, CASE WHEN vmerge = 'continue' AND orig > COALESCE(stay, -1) THEN 'restart' ELSE vmerge END AS vmerge FROM w""")
def _j15(grid):
    c = grid.select(F.lit(0).alias("pair_id"), F.col("table_id").alias("tpl_table"), "row_idx", F.col("cell_idx").alias("phys_col"), "vmerge")
    gone = c.where("(tpl_table + row_idx) % 3 = 0").select("pair_id", "tpl_table", "row_idx").distinct()
    return ch.hand_over_merges(c, gone).select(F.col("tpl_table").alias("table_id"), F.col("phys_col").alias("cell_idx"), "row_idx", "vmerge")


KEPT = f"""(SELECT * FROM {BASE} c WHERE NOT EXISTS (SELECT 1 FROM {GONE} g WHERE g.pair_id = c.pair_id AND g.tpl_table = c.tpl_table AND g.tpl_row = c.row_idx))"""


@query("j16_apply_changes", ["tpl_cells", "changes"], f"""
WITH k AS {KEPT}, up AS (SELECT pair_id, tpl_table, tpl_row, MAX(value) AS value FROM changes WHERE type = 'update_values' GROUP BY ALL), ad AS {ADD},
 rw AS (SELECT DISTINCT pair_id, tpl_table, row_idx FROM k),
 ix AS (SELECT rw.pair_id, rw.tpl_table, rw.row_idx, ROW_NUMBER() OVER w + COALESCE(SUM(CASE WHEN ad.value IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY rw.pair_id, rw.tpl_table ORDER BY rw.row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS nr
   FROM rw LEFT JOIN ad ON ad.pair_id = rw.pair_id AND ad.tpl_table = rw.tpl_table AND ad.tpl_row = rw.row_idx WINDOW w AS (PARTITION BY rw.pair_id, rw.tpl_table ORDER BY rw.row_idx)),
 t AS (SELECT k.pair_id, k.tpl_table, ix.nr, k.row_idx, k.phys_col, CASE WHEN k.phys_col = 2 AND up.value IS NOT NULL THEN up.value ELSE k.text END AS text FROM k JOIN ix ON ix.pair_id = k.pair_id AND ix.tpl_table = k.tpl_table AND ix.row_idx = k.row_idx
   LEFT JOIN up ON up.pair_id = k.pair_id AND up.tpl_table = k.tpl_table AND up.tpl_row = k.row_idx)
SELECT pair_id, tpl_table, CAST(nr AS BIGINT) AS row_idx, phys_col, text, FALSE AS added FROM t
UNION ALL SELECT t.pair_id, t.tpl_table, CAST(nr + 1 AS BIGINT), phys_col, CASE WHEN phys_col = 2 THEN ad.value ELSE text END, TRUE FROM t JOIN ad ON ad.pair_id = t.pair_id AND ad.tpl_table = t.tpl_table AND ad.tpl_row = t.row_idx""")
def _j16(cells, changes):
    return ch.apply_changes(_cells(cells), _split(changes))[0]


# --- result against template -------------------------------------------------

def _before_after(filled):
    before = F.array(F.struct(F.lit(2).alias("c"), nb.format_amount("tpl_cur").alias("b"), F.col("cur_text").alias("a")), F.struct(F.lit(4).alias("c"), nb.format_amount("tpl_pri").alias("b"), F.col("pri_text").alias("a")))
    return filled.select("pair_id", "tpl_table", F.col("tpl_row").alias("row_idx"), F.explode(before).alias("x")).select(
        "pair_id", "tpl_table", "row_idx", F.col("x.b").alias("before"), F.col("x.a").alias("after"),
        nb.parse_report_number("x.b").cast("bigint").alias("before_num"), nb.parse_report_number("x.a").cast("bigint").alias("after_num"))


from ledgerloom.plans.scalars import report_number  # noqa: E402

BA = f"""ba AS (SELECT *, CAST({report_number('before', 'null')} AS BIGINT) AS bn, CAST({report_number('after', 'null')} AS BIGINT) AS an FROM (
  SELECT f.pair_id, f.tpl_table, f.tpl_row AS row_idx, {o.fmt('p.tpl_cur')} AS before, f.cur_text AS after FROM filled f JOIN row_pairs p ON p.pair_id = f.pair_id AND p.tpl_table = f.tpl_table AND p.tpl_row = f.tpl_row
  UNION ALL SELECT f.pair_id, f.tpl_table, f.tpl_row, {o.fmt('p.tpl_pri')}, f.pri_text FROM filled f JOIN row_pairs p ON p.pair_id = f.pair_id AND p.tpl_table = f.tpl_table AND p.tpl_row = f.tpl_row) q)"""


def _joined(f, p):
    return _before_after(f.join(p.select("pair_id", "tpl_table", "tpl_row", "tpl_cur", "tpl_pri"), ["pair_id", "tpl_table", "tpl_row"]))


@query("e21_table_changes", ["filled", "row_pairs"], f"""WITH {BA}, g AS (SELECT pair_id, tpl_table, COUNT(*) FILTER (before <> after) AS n, COUNT(*) FILTER (before <> after AND (bn IS NOT NULL OR an IS NOT NULL)) AS m,
  COUNT(*) FILTER (before <> after AND an IS NOT NULL) AS w, bool_or(regexp_matches(regexp_replace(after, '202[345]', '', 'g'), '[0-9]{{2,}}')) AS h, COUNT(DISTINCT row_idx) AS r FROM ba GROUP BY ALL)
SELECT pair_id, tpl_table, CAST(n AS BIGINT) AS n_changed, CAST(m AS BIGINT) AS n_numeric, CASE WHEN m > 0 THEN 'DATA_UPD' WHEN n > 0 THEN 'TEXT_UPD' ELSE 'unchanged' END AS status,
 CASE WHEN w = 0 AND r >= 3 THEN CASE WHEN h THEN 'HAS_PRIOR_DATA' ELSE 'NO_DATA' END END AS stale FROM g""")
def _e21(f, p):
    return ql.table_changes(_joined(f, p), ["pair_id", "tpl_table"])


@query("e19_update_accuracy", ["filled", "row_pairs"], f"""WITH {BA}, sv AS (SELECT DISTINCT pair_id, tpl_table, v FROM (SELECT pair_id, tpl_table, exp_cur AS v FROM row_pairs UNION ALL SELECT pair_id, tpl_table, exp_pri FROM row_pairs) q WHERE v IS NOT NULL),
 c AS (SELECT ba.pair_id, ba.tpl_table, sv.v IS NOT NULL AS k FROM ba LEFT JOIN sv ON sv.pair_id = ba.pair_id AND sv.tpl_table = ba.tpl_table AND sv.v = ba.an WHERE before <> after AND COALESCE(an, 0) <> 0)
SELECT pair_id, tpl_table, CAST(COUNT(*) FILTER (k) AS BIGINT) AS n_correct, CAST(COUNT(*) FILTER (NOT k) AS BIGINT) AS n_wrong, CAST(COUNT(*) FILTER (k) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS accuracy FROM c GROUP BY ALL""")
def _e19(f, p):
    keys = ["pair_id", "tpl_table"]
    v = p.select(*keys, F.explode(F.array_compact(F.array("exp_cur", "exp_pri"))).alias("value"))
    return ql.update_accuracy(_joined(f, p), v, keys)


# --- year rolling ------------------------------------------------------------

def _pairs_sql(y: str) -> list[tuple[str, str]]:
    """(old, new) of the twelve pairs for period end 31 December of year ``y``, longest first."""
    out = []
    for k in (2, 1):
        a, b = f"CAST({y} - {k} AS VARCHAR)", f"CAST({y} - {k} + 1 AS VARCHAR)"
        for pre in ("Year ended December 31, ", "year ended December 31, ", "December 31, ", "January 1, ", "December 31 ", ""):
            out.append((f"'{pre}' || {a}", f"'{pre}' || {b}", len(pre)))
    return [(x, z) for x, z, _ in sorted(out, key=lambda t: -t[2])]


def _prose_sql(y: str) -> list[tuple[str, str]]:
    out = [(a, b) for a, b in _pairs_sql(y) if not a.startswith("''")]
    for pre, post in (("and ", ""), ("(", ":"), ("(", " "), ("", ","), ("", ".")):
        for k in (2, 1):
            out.append((f"'{pre}' || CAST({y} - {k} AS VARCHAR) || '{post}'", f"'{pre}' || CAST({y} - {k} + 1 AS VARCHAR) || '{post}'"))
    return out


def _once_sql(x: str, pairs: list[tuple[str, str]]) -> str:
    """One-pass replacement by way of private placeholders (longest pattern first)."""
    for i, (a, _) in enumerate(pairs):
        x = f"replace({x}, {a}, chr({57344 + i}))"
    for i, (_, b) in enumerate(pairs):
        x = f"replace({x}, chr({57344 + i}), {b})"
    return x


DOC_TEXT = "(text || ' Year ended December 31, ' || y1 || ', January 1, ' || (y1 - 1) || '. Founded ' || (y1 - 1) || ' (' || y1 || ':' )"


def _rolling(docs):
    text = F.expr("concat(text, ' Year ended December 31, ', y1, ', January 1, ', y1 - 1, '. Founded ', y1 - 1, ' (', y1, ':')")
    end = F.make_date(F.col("y1").cast("int") + 1, F.lit(12), F.lit(31))
    return docs.select("doc_id", "source", "y1", text.alias("text"), d.roll_pairs(end).alias("pairs"), d.roll_pairs_in_prose(end).alias("prose_pairs"))


@query("j05_year_roll_changes", ["orders"], """
WITH y AS (SELECT o_custkey AS doc_id, list_reverse_sort(list(DISTINCT year(o_orderdate))) AS y FROM orders GROUP BY o_custkey),
 p AS (SELECT doc_id, CAST(y[1] AS VARCHAR) AS nc, CAST(COALESCE(y[2], y[1] - 1) AS VARCHAR) AS np FROM y), t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN nc ELSE np END AS oc, CAST(CAST(np AS INT) - 1 AS VARCHAR) AS op FROM p)
SELECT p.doc_id, 'update_text' AS type, 'header' AS target, oc AS old_year, nc AS new_year FROM p JOIN t USING (doc_id) WHERE nc <> oc UNION ALL SELECT p.doc_id, 'update_text', 'header', op, np FROM p JOIN t USING (doc_id) WHERE nc <> oc""")
def _j05(orders):
    from ledgerloom.sources.documents import report_years

    s = report_years(orders.select(F.col("o_custkey").alias("doc_id"), F.year("o_orderdate").alias("y0")), ["doc_id"], "y0")
    old = F.when(F.col("doc_id") % 4 == 0, F.col("period_current")).otherwise(F.col("period_prior"))
    t = s.select("doc_id", old.alias("period_current"), (F.col("period_prior").cast("int") - 1).cast("string").alias("period_prior"))
    return ch.year_roll_changes(s, t)


@query("j06_roll_pairs", ["docs"], "SELECT doc_id, old, new FROM (" + " UNION ALL ".join(f"SELECT doc_id, {a} AS old, {b} AS new FROM docs" for a, b in _pairs_sql("(y1 + 1)")) + ") q")
def _j06(docs):
    return _rolling(docs).select("doc_id", F.explode("pairs").alias("p")).select("doc_id", "p.old", "p.new")


@query("j07_replace_once", ["docs"], f"SELECT doc_id, {_once_sql(DOC_TEXT + ')', _pairs_sql('(y1 + 1)'))} AS text FROM docs".replace("':' ))", "':')"))
def _j07(docs):
    return _rolling(docs).select("doc_id", d.replace_in_turn("text", F.col("pairs")).alias("text"))


@query("j08_replace_in_order", ["docs"], "SELECT doc_id, replace(replace(text, CAST(y1 AS VARCHAR), CAST(y1 + 1 AS VARCHAR)), CAST(y1 - 1 AS VARCHAR), CAST(y1 AS VARCHAR)) AS text FROM docs")
def _j08(docs):
    y = lambda k: (F.col("y1") + k).cast("string")
    return docs.select("doc_id", ch.replace_years_in_order("text", [(y(0), y(1)), (y(-1), y(0))]).alias("text"))


@query("j09_redistribute", ["doc_lines"], """
WITH r AS (SELECT doc_id, seq, CAST(k AS BIGINT) AS run_idx, substring(text, CAST(k * 7 + 1 AS BIGINT), 7) AS text, replace(text, 'e', 'ee') AS nt, length(text) AS n FROM doc_lines CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) x WHERE length(text) > k * 7)
SELECT doc_id, seq, run_idx, CASE WHEN run_idx = LEAST(2, (n - 1) // 7) THEN substring(nt, run_idx * 7 + 1) ELSE substring(nt, run_idx * 7 + 1, 7) END AS text FROM r""")
def _j09(lines):
    k = F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)]))
    runs = lines.select("doc_id", "seq", "text", k.alias("run_idx")).where(F.length("text") > F.col("run_idx") * 7).select(
        "doc_id", "seq", "run_idx", F.substring("text", (F.col("run_idx") * 7 + 1).cast("int"), F.lit(7)).alias("text"), F.replace("text", F.lit("e"), F.lit("ee")).alias("new_text"))
    return ch.redistribute(runs, ["doc_id", "seq"])


ZONES = "CASE doc_id % 4 WHEN 0 THEN 'header' WHEN 1 THEN 'footer' WHEN 2 THEN 'table' ELSE 'paragraph' END"
ROLLED = f"""(SELECT doc_id, zone, row_idx, t AS text, CASE WHEN zone IN ('header', 'footer') OR (zone = 'table' AND row_idx < 3) THEN {_once_sql('t', _pairs_sql('(y1 + 1)'))}
  WHEN zone = 'paragraph' THEN {_once_sql('t', _prose_sql('(y1 + 1)'))} ELSE t END AS new_text FROM (SELECT doc_id, y1, {ZONES} AS zone, doc_id % 5 AS row_idx, {DOC_TEXT + ')'} AS t FROM docs) q)""".replace("':' ))", "':')")


def _zoned(docs):
    return _rolling(docs).withColumns({"zone": F.expr(ZONES), "row_idx": F.col("doc_id") % 5})


@query("j10_roll_years_by_zone", ["docs"], f"SELECT zone, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(*) FILTER (new_text <> text) AS BIGINT) AS n_changed FROM {ROLLED} q GROUP BY zone")
def _j10(docs):
    return ch.roll_years(_zoned(docs)).groupBy("zone").agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"))


@query("j10_rolled_texts", ["docs"], f"SELECT doc_id, zone, new_text FROM {ROLLED} q")
def _j10t(docs):
    return ch.roll_years(_zoned(docs)).select("doc_id", "zone", "new_text")


@query("j17_targeted_replace", ["docs"], f"SELECT doc_id, CASE WHEN {ZONES} IN ('header', 'footer') THEN replace(text, 'December', 'Dec.') ELSE text END AS text FROM docs")
def _j17(docs):
    pairs = F.array(F.struct(F.lit("December").alias("old"), F.lit("Dec.").alias("new")))
    return docs.select("doc_id", F.when(F.expr(ZONES).isin("header", "footer"), d.replace_once("text", pairs)).otherwise(F.col("text")).alias("text"))


@query("e20_year_changes", ["docs"], f"""
SELECT kind, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT CASE WHEN b = a THEN NULL WHEN b = c0 AND a = c1 THEN 'current' WHEN b = p0 AND a = c0 THEN 'prior' WHEN contains(b, c0) AND contains(a, c1) AND replace(b, c0, c1) = a THEN 'current'
  WHEN contains(b, p0) AND contains(a, c0) AND replace(b, p0, c0) = a THEN 'prior' ELSE 'other' END AS kind
 FROM (SELECT b, CASE doc_id % 5 WHEN 0 THEN b WHEN 1 THEN replace(b, c0, c1) WHEN 2 THEN replace(b, p0, c0) WHEN 3 THEN b || '!' ELSE replace(replace(b, c0, c1), p0, c0) END AS a, c0, c1, p0 FROM (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' ' || CAST(y1 AS VARCHAR) WHEN doc_id % 3 = 1 THEN text || ' ' || CAST(y1 - 1 AS VARCHAR) ELSE text END AS b, CAST(y1 AS VARCHAR) AS c0, CAST(y1 + 1 AS VARCHAR) AS c1, CAST(y1 - 1 AS VARCHAR) AS p0 FROM docs) r) q) z GROUP BY kind""")
def _e20(docs):
    y = lambda k: (F.col("y1") + k).cast("string")
    t = docs.withColumn("b", F.when(F.col("doc_id") % 3 == 0, F.concat_ws(" ", "text", y(0))).when(F.col("doc_id") % 3 == 1, F.concat_ws(" ", "text", y(-1))).otherwise(F.col("text")))
    k = F.col("doc_id") % 5
    a = (F.when(k == 0, F.col("b")).when(k == 1, F.replace("b", y(0), y(1))).when(k == 2, F.replace("b", y(-1), y(0))).when(k == 3, F.concat("b", F.lit("!")))
         .otherwise(F.replace(F.replace("b", y(0), y(1)), y(-1), y(0))))
    t = t.withColumn("a", a)
    return t.groupBy(ql.year_change(F.col("b"), F.col("a"), y(0), y(1), y(-1), y(0)).alias("kind")).agg(F.count("*").alias("n"))
