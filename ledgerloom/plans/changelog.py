"""Queries: whole change sets applied to template bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.changelog import ChangeLog
from ledgerloom.plans import oracle as o
from ledgerloom.plans.registry import query

INPUTS = ["log_elements", "log_cells", "log_changes"]
_T = o.strip("text")
LABEL = f"({_T} <> '' AND translate({_T}, ',()- ' || chr(92), '') <> '' AND NOT regexp_matches(translate({_T}, ',()- ' || chr(92), ''), '^\\.*[0-9][0-9.]*$'))"


def _log(elements: DataFrame, cells: DataFrame, changes: DataFrame) -> ChangeLog:
    """Added rows bring their amount in two columns, added columns a mark in row 2, cloned tables one amount and cloned notes a new title."""
    one = lambda *pairs: F.create_map(*[F.lit(p) if isinstance(p, str) else p for p in pairs])
    kind, value = F.col("type"), F.col("value")
    values = F.when(kind == "add_row", one("2", value, "4", F.concat(F.lit("+"), value))).when(kind == "add_column", one("2", value)).when(kind == "add_table", one("2:2", value)).when(kind == "add_note", one("0", F.lit("Copied note")))
    return ChangeLog.of(elements, cells, changes.withColumn("values", values))


# What holds once all changes are marked, written with range joins and global ranks.
MARKS = f"""
el AS (SELECT * FROM log_elements), ce AS (SELECT *, {LABEL} AS label FROM log_cells), c AS (SELECT * FROM log_changes),
lim AS (SELECT pair_id, MIN(pos) AS least, MAX(pos) AS most FROM el GROUP BY pair_id),
gone AS (SELECT DISTINCT el.pair_id, el.pos FROM el JOIN c ON c.pair_id = el.pair_id AND ((c.type = 'delete_table' AND c.pos = el.pos AND el.kind = 'table') OR (c.type = 'delete_note' AND el.pos BETWEEN c.pos AND c.end_pos))),
doomed AS (SELECT DISTINCT pair_id, pos, row_idx FROM c WHERE type = 'delete_row'),
judged AS (SELECT c.*, CASE
  WHEN c.type NOT IN ('update_values', 'update_text', 'add_row', 'delete_row', 'add_column', 'add_table', 'delete_table', 'add_note', 'delete_note', 'restructure') THEN 'unknown type'
  WHEN c.type IN ('add_note', 'delete_note') AND NOT COALESCE(c.pos <= c.end_pos, FALSE) THEN 'bad range'
  WHEN c.type IN ('add_note', 'delete_note') AND (lim.least IS NULL OR c.end_pos < lim.least OR c.pos > lim.most) THEN 'no such element'
  WHEN c.type NOT IN ('add_note', 'delete_note', 'restructure') AND el.kind IS NULL THEN 'no such element'
  WHEN c.type IN ('update_values', 'add_row', 'delete_row', 'add_column', 'add_table', 'delete_table') AND el.kind <> 'table' THEN 'not a table'
  WHEN c.type = 'update_text' AND el.kind = 'table' THEN 'not a text'
  WHEN c.type IN ('update_values', 'update_text', 'add_row', 'add_column') AND EXISTS (SELECT 1 FROM gone g WHERE g.pair_id = c.pair_id AND g.pos = c.pos) THEN 'was deleted'
  WHEN c.type IN ('update_values', 'add_row', 'delete_row') AND NOT EXISTS (SELECT 1 FROM ce x WHERE x.pair_id = c.pair_id AND x.pos = c.pos AND x.row_idx = c.row_idx) THEN 'no such row'
  WHEN c.type = 'add_column' AND NOT EXISTS (SELECT 1 FROM ce x WHERE x.pair_id = c.pair_id AND x.pos = c.pos AND x.col_idx = c.col_idx) THEN 'no such column'
  WHEN c.type = 'update_values' AND EXISTS (SELECT 1 FROM doomed d WHERE d.pair_id = c.pair_id AND d.pos = c.pos AND d.row_idx = c.row_idx) THEN 'row was deleted'
  WHEN c.type = 'update_values' AND x.label IS NULL THEN 'no such cell' WHEN c.type = 'update_values' AND x.label THEN 'a label stands there' END AS problem
  FROM c LEFT JOIN el ON el.pair_id = c.pair_id AND el.pos = c.pos LEFT JOIN lim ON lim.pair_id = c.pair_id LEFT JOIN ce x ON x.pair_id = c.pair_id AND x.pos = c.pos AND x.row_idx = c.row_idx AND x.col_idx = c.col_idx),
good AS (SELECT * FROM judged WHERE problem IS NULL),
spot AS (SELECT pair_id, pos AS model, pos AS anchor, 0 AS side, CAST(-1 AS BIGINT) AS no, CAST(0 AS BIGINT) AS nth, CAST(NULL AS VARCHAR) AS given, NULL AS kindof FROM el WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.pair_id = el.pair_id AND g.pos = el.pos)
  UNION ALL SELECT pair_id, pos, pos, CASE WHEN side = 'before' THEN -1 ELSE 1 END, change_no, 0, value, 'table' FROM good WHERE type = 'add_table'
  UNION ALL SELECT g.pair_id, el.pos, CASE WHEN side = 'before' THEN GREATEST(g.pos, least) ELSE LEAST(end_pos, most) END, CASE WHEN side = 'before' THEN -1 ELSE 1 END, change_no, el.pos - g.pos, 'Copied note', 'note'
    FROM good g JOIN el ON el.pair_id = g.pair_id AND el.pos BETWEEN g.pos AND g.end_pos JOIN lim ON lim.pair_id = g.pair_id WHERE type = 'add_note'),
place AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY pair_id ORDER BY anchor, side, no, nth) - 1 AS BIGINT) AS new_pos FROM spot)"""


@query("j16_failures", INPUTS, f"WITH {MARKS} SELECT pair_id, change_no, type, problem FROM judged WHERE problem IS NOT NULL")
def _failures(elements, cells, changes):
    return _log(elements, cells, changes).failures()


@query("j16_log_body", INPUTS, f"""
WITH {MARKS}, u AS (SELECT pair_id, pos, arg_max(value, change_no) AS value FROM good WHERE type = 'update_text' GROUP BY ALL), y AS (SELECT pair_id, old, new FROM good WHERE type = 'restructure')
SELECT p.pair_id, p.new_pos AS pos, el.kind, CASE WHEN el.kind = 'table' THEN el.text WHEN p.kindof = 'note' AND p.nth = 0 THEN p.given WHEN el.kind = 'header' THEN replace(COALESCE(u.value, el.text), y.old, y.new) ELSE COALESCE(u.value, el.text) END AS text, p.side <> 0 AS added
FROM place p JOIN el ON el.pair_id = p.pair_id AND el.pos = p.model LEFT JOIN u ON u.pair_id = el.pair_id AND u.pos = el.pos LEFT JOIN y ON y.pair_id = el.pair_id""")
def _body(elements, cells, changes):
    return _log(elements, cells, changes).body()


@query("j16_log_tables", INPUTS, f"""
WITH {MARKS}, u AS (SELECT pair_id, pos, row_idx, col_idx, arg_max(value, change_no) AS value FROM good WHERE type = 'update_values' GROUP BY ALL),
 t AS (SELECT ce.pair_id, ce.pos, ce.row_idx, ce.col_idx, COALESCE(u.value, ce.text) AS text FROM ce LEFT JOIN u ON u.pair_id = ce.pair_id AND u.pos = ce.pos AND u.row_idx = ce.row_idx AND u.col_idx = ce.col_idx),
 r0 AS (SELECT DISTINCT pair_id, pos, row_idx FROM ce WHERE NOT EXISTS (SELECT 1 FROM doomed d WHERE d.pair_id = ce.pair_id AND d.pos = ce.pos AND d.row_idx = ce.row_idx)),
 c0 AS (SELECT DISTINCT pair_id, pos, col_idx FROM ce),
 r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pair_id, pos ORDER BY row_idx, rs, no) - 1 AS nr FROM (SELECT pair_id, pos, row_idx, 0 AS rs, CAST(-1 AS BIGINT) AS no, CAST(NULL AS VARCHAR) AS rv FROM r0 UNION ALL SELECT pair_id, pos, row_idx, CASE WHEN side = 'before' THEN -1 ELSE 1 END, change_no, value FROM good WHERE type = 'add_row') z),
 k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pair_id, pos ORDER BY col_idx, cs, no) - 1 AS nc FROM (SELECT pair_id, pos, col_idx, 0 AS cs, CAST(-1 AS BIGINT) AS no, CAST(NULL AS VARCHAR) AS cv FROM c0 UNION ALL SELECT pair_id, pos, col_idx, CASE WHEN side = 'before' THEN -1 ELSE 1 END, change_no, value FROM good WHERE type = 'add_column') z),
 pr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pair_id, pos ORDER BY row_idx) - 1 AS nr FROM r0), pk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pair_id, pos ORDER BY col_idx) - 1 AS nc FROM c0)
SELECT t.pair_id, p.new_pos AS pos, CAST(r.nr AS BIGINT) AS row_idx, CAST(k.nc AS BIGINT) AS col_idx,
 CASE WHEN rs <> 0 AND t.col_idx = 2 AND rv IS NOT NULL THEN rv WHEN rs <> 0 AND t.col_idx = 4 AND rv IS NOT NULL THEN '+' || rv WHEN cs <> 0 AND t.row_idx = 2 THEN cv ELSE t.text END AS text, rs <> 0 OR cs <> 0 AS added
FROM t JOIN place p ON p.pair_id = t.pair_id AND p.model = t.pos AND p.side = 0 JOIN r ON r.pair_id = t.pair_id AND r.pos = t.pos AND r.row_idx = t.row_idx JOIN k ON k.pair_id = t.pair_id AND k.pos = t.pos AND k.col_idx = t.col_idx
UNION ALL
SELECT t.pair_id, p.new_pos, CAST(pr.nr AS BIGINT), CAST(pk.nc AS BIGINT), CASE WHEN p.kindof = 'table' AND t.row_idx = 2 AND t.col_idx = 2 THEN p.given ELSE t.text END, TRUE
FROM t JOIN place p ON p.pair_id = t.pair_id AND p.model = t.pos AND p.side <> 0 JOIN pr ON pr.pair_id = t.pair_id AND pr.pos = t.pos AND pr.row_idx = t.row_idx JOIN pk ON pk.pair_id = t.pair_id AND pk.pos = t.pos AND pk.col_idx = t.col_idx""")
def _tables(elements, cells, changes):
    return _log(elements, cells, changes).tables()


@query("j12_delete_notes", ["log_elements", "log_changes"], """
SELECT e.pair_id, CAST(ROW_NUMBER() OVER (PARTITION BY e.pair_id ORDER BY e.pos) - 1 AS BIGINT) AS pos, e.kind, e.text, FALSE AS added FROM log_elements e
WHERE NOT EXISTS (SELECT 1 FROM log_changes c WHERE c.type = 'delete_note' AND c.pair_id = e.pair_id AND e.pos BETWEEN c.pos AND c.end_pos)""")
def _delete_notes(elements, changes):
    none = elements.sparkSession.createDataFrame([], "pair_id bigint, pos bigint, row_idx bigint, col_idx bigint, text string")
    return _log(elements, none, changes.where("type = 'delete_note'")).body()


@query("j14_add_notes", ["log_elements", "log_changes"], """
WITH s AS (SELECT pair_id, pos AS anchor, 0 AS side, CAST(-1 AS BIGINT) AS no, CAST(0 AS BIGINT) AS nth, kind, text FROM log_elements
 UNION ALL SELECT c.pair_id, CASE WHEN c.side = 'before' THEN GREATEST(c.pos, m.lo) ELSE LEAST(c.end_pos, m.hi) END, CASE WHEN c.side = 'before' THEN -1 ELSE 1 END, c.change_no, e.pos - c.pos, e.kind, CASE WHEN e.pos = c.pos AND e.kind <> 'table' THEN 'Copied note' ELSE e.text END
 FROM log_changes c JOIN log_elements e ON e.pair_id = c.pair_id AND e.pos BETWEEN c.pos AND c.end_pos JOIN (SELECT pair_id, MIN(pos) AS lo, MAX(pos) AS hi FROM log_elements GROUP BY 1) m ON m.pair_id = c.pair_id WHERE c.type = 'add_note')
SELECT pair_id, CAST(ROW_NUMBER() OVER (PARTITION BY pair_id ORDER BY anchor, side, no, nth) - 1 AS BIGINT) AS pos, kind, text, side <> 0 AS added FROM s""")
def _add_notes(elements, changes):
    none = elements.sparkSession.createDataFrame([], "pair_id bigint, pos bigint, row_idx bigint, col_idx bigint, text string")
    return _log(elements, none, changes.where("type = 'add_note'")).body()
