"""Queries: job progress, transcripts, searches and document checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.operators import reports as rp
from ledgerloom.plans import oracle as o
from ledgerloom.plans.registry import query
from ledgerloom.session import shared_dir
from ledgerloom.streaming import jobs as jb

EST = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(message), '{w}')" for w in words) + f" THEN {v}" for v, words in jb.PROGRESS_WORDS) + " END"
WP = f"(SELECT event_id, ts, job_id, type, message, CAST(COALESCE(progress, {EST}) AS BIGINT) AS progress FROM job_events)"
SHOWN = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query("t01_estimated_progress", ["job_events"], f"SELECT event_id, CAST({EST} AS BIGINT) AS estimate FROM job_events")
def _t01(ev):
    return ev.select("event_id", jb.estimated_progress("message").alias("estimate"))


LATEST = f"""(SELECT job_id, CASE WHEN bool_or(type = 'complete') THEN 'completed' WHEN bool_or(type = 'error') THEN 'failed' ELSE 'processing' END AS status,
 arg_max(progress, CAST(epoch_us(ts) AS HUGEINT) * 100000 + event_id) FILTER (progress IS NOT NULL) AS progress, left(arg_max(message, CAST(epoch_us(ts) AS HUGEINT) * 100000 + event_id), 100) AS current_step, strftime(MAX(ts), '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM {WP} w GROUP BY job_id)"""


@query("t02_latest_state", ["job_events"], f"SELECT * FROM {LATEST} q")
def _t02(ev):
    return jb.latest_state(ev).withColumn("updated_at", SHOWN("updated_at"))


@query("t03_throttled_states", ["job_events"], f"""
SELECT job_id, strftime(time_bucket(INTERVAL '5 seconds', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S.%f') AS window_start, arg_max(progress, CAST(epoch_us(ts) AS HUGEINT) * 100000 + event_id) FILTER (progress IS NOT NULL) AS progress,
 arg_max(message, CAST(epoch_us(ts) AS HUGEINT) * 100000 + event_id) AS message, CAST(COUNT(*) AS BIGINT) AS n FROM {WP} w GROUP BY 1, 2""")
def _t03(ev):
    return jb.throttled(ev).withColumn("window_start", SHOWN("window_start"))


@query("t04_active_sessions", ["job_events"], """
WITH g AS (SELECT job_id, ts AS t, CASE WHEN epoch_us(ts) - LAG(epoch_us(ts)) OVER (PARTITION BY job_id ORDER BY ts) <= 43200000000 THEN 0 ELSE 1 END AS b FROM job_events),
 s AS (SELECT *, SUM(b) OVER (PARTITION BY job_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT job_id, strftime(MIN(t), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(MAX(t) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS ping_due, CAST(COUNT(*) AS BIGINT) AS n FROM s GROUP BY job_id, k""")
def _t04(ev):
    return jb.active_sessions(ev, "12 hours").withColumns({"started": SHOWN("started"), "ping_due": SHOWN("ping_due")})


@query("t05_until_terminal", ["job_events"], """
SELECT event_id, job_id, type FROM job_events e WHERE CAST(epoch_us(ts) AS HUGEINT) * 100000 + event_id <= COALESCE((SELECT MIN(CAST(epoch_us(ts) AS HUGEINT) * 100000 + event_id) FROM job_events x WHERE x.job_id = e.job_id AND x.type IN ('complete', 'error')), CAST(9000000000000000000000 AS HUGEINT))""")
def _t05(ev):
    return jb.until_terminal(ev).select("event_id", "job_id", "type")


STATE = "CASE type WHEN 'complete' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'progress' THEN 'queued' ELSE CASE WHEN event_id % 6 = 0 THEN 'cancelled' ELSE 'processing' END END"


@query("t06_transitions", ["job_events"], f"""
SELECT job_id, event_id, before, status, before IS NULL OR before = status OR (before = 'queued' AND status IN ('processing', 'failed')) OR (before = 'processing' AND status IN ('completed', 'failed', 'cancelled')) AS allowed
FROM (SELECT job_id, event_id, status, LAG(status) OVER (PARTITION BY job_id ORDER BY event_id) AS before FROM (SELECT job_id, event_id, {STATE} AS status FROM job_events) r) q""")
def _t06(ev):
    return jb.transitions(ev.select("job_id", "event_id", F.expr(STATE).alias("status"))).select("job_id", "event_id", "before", "status", "allowed")


NOW = "TIMESTAMP '2024-01-20 00:00:00'"


@query("t07_recover_stale", ["jobs"], f"""
SELECT job_id, CASE WHEN status IN ('processing', 'queued') THEN 'failed' ELSE status END AS status, strftime(CASE WHEN status IN ('processing', 'queued') THEN {NOW} ELSE completed_at END, '%Y-%m-%d %H:%M:%S.%f') AS completed_at,
 CASE WHEN status IN ('processing', 'queued') THEN 'still open when the service came up again' END AS error FROM jobs""")
def _t07(jobs):
    return jb.recover_stale(jobs, F.expr(NOW)).select("job_id", "status", SHOWN("completed_at").alias("completed_at"), "error")


@query("t08_retention", ["jobs"], "SELECT job_id, status FROM jobs WHERE created_at >= TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 24 HOUR")
def _t08(jobs):
    return jb.drop_old(jobs, F.expr("TIMESTAMP '2024-01-02 00:00:00'")).select("job_id", "status")


@query("t09_upsert", ["jobs", "job_events"], f"""
WITH u AS (SELECT job_id, arg_max(status, event_id) FILTER (status IS NOT NULL) AS status, arg_max(progress, event_id) FILTER (progress IS NOT NULL) AS progress FROM (SELECT job_id, event_id, progress, CASE type WHEN 'complete' THEN 'completed' WHEN 'error' THEN 'failed' END AS status FROM job_events) q GROUP BY job_id)
SELECT COALESCE(j.job_id, u.job_id) AS job_id, COALESCE(u.status, j.status) AS status, COALESCE(u.progress, j.progress) AS progress FROM (SELECT job_id, status, CAST(0 AS BIGINT) AS progress FROM jobs) j FULL OUTER JOIN u ON u.job_id = j.job_id""")
def _t09(jobs, ev):
    up = ev.select("job_id", "event_id", F.when(F.col("type") == "complete", "completed").when(F.col("type") == "error", "failed").alias("status"), "progress")
    return jb.upsert(jobs.select("job_id", "status", F.lit(0).cast("bigint").alias("progress")), up, "job_id", "event_id")


@query("t10_log_entries", ["job_events"], """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, job_id, CASE type WHEN 'error' THEN 'error' WHEN 'complete' THEN 'success' ELSE 'info' END AS level, left(message, 500) AS message FROM job_events""")
def _t10(ev):
    return jb.log_entries(ev).withColumn("ts", SHOWN("ts"))


@query("t11_memory_state", ["convs"], """
SELECT conv_id AS owner, role AS key, value, '- ' || role || ': ' || CASE WHEN length(value) > 200 THEN left(value, 200) || '...' ELSE value END AS summary
FROM (SELECT conv_id, role, arg_max_null(CASE WHEN turn % 4 <> 3 THEN text END, turn) AS value FROM convs GROUP BY conv_id, role) q WHERE value IS NOT NULL""")
def _t11(convs):
    log = convs.select(F.col("conv_id").alias("owner"), F.col("role").alias("key"), F.col("turn").alias("seq"), F.when(F.col("turn") % 4 != 3, F.col("text")).alias("value"))
    return jb.memory_state(log)


@query("a27_recent_jobs", ["jobs"], "SELECT job_id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM jobs ORDER BY jobs.created_at DESC, job_id LIMIT 20")
def _a27(jobs):
    return jb.recent_jobs(jobs).select("job_id", "status", SHOWN("created_at").alias("created_at"))


@query("a27_job_status", ["jobs", "job_events"], f"""
SELECT j.job_id, COALESCE(l.status, j.status) AS status, COALESCE(l.progress, 0) AS progress FROM jobs j LEFT JOIN {LATEST} l ON l.job_id = j.job_id""")
def _a27s(jobs, ev):
    return jb.job_status(jobs, jb.latest_state(ev))


@query("w10_repeated_actions", ["convs"], """
WITH a AS (SELECT conv_id, turn, action, SUM(CASE WHEN action = before THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, LAG(action) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM convs) q)
SELECT conv_id, turn, action, ROW_NUMBER() OVER (PARTITION BY conv_id, run ORDER BY turn) % 3 = 0 AS skipped FROM a""")
def _w10(convs):
    return jb.repeated_actions(convs.select("conv_id", "turn", "action"), ["conv_id"], "turn", "action")


@query("w11_compress_transcripts", ["convs"], """
WITH m AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS k, COUNT(*) OVER (PARTITION BY conv_id) AS n FROM convs), f AS (SELECT *, n - 1 > 4 AND k > 1 AND k <= n - 2 AS mid FROM m)
SELECT conv_id, turn, role, text FROM f WHERE NOT mid UNION ALL SELECT conv_id, MIN(turn), 'user', '[이전 대화 ' || COUNT(*) || '개 메시지]' FROM f WHERE mid GROUP BY conv_id""")
def _w11(convs):
    return jb.compress_transcripts(convs, ["conv_id"], "turn", max_messages=4, keep=2)


@query("b05_escalations", ["job_events"], "SELECT type, CAST(COUNT(*) AS BIGINT) AS n FROM job_events WHERE type IN ('error', 'complete') GROUP BY type")
def _b05(ev):
    path = f"{shared_dir(ev.sparkSession)}/escalations-{uuid.uuid4().hex}"
    for kind in jb.TERMINAL:
        ev.where(F.col("type") == kind).select("job_id", "type", "message").write.mode("append").parquet(path)
    return ev.sparkSession.read.parquet(path).groupBy("type").agg(F.count("*").alias("n"))


# --- documents ---------------------------------------------------------------

@query("p01_search", ["docs"], """
SELECT source, doc_id, ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) AS place, COUNT(*) OVER (PARTITION BY source) AS total, CAST(strpos(text, 'and 20') AS BIGINT) AS found_at FROM docs WHERE contains(text, 'and 20')
QUALIFY ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) <= 20""")
def _p01(docs):
    return rp.search(docs, "and 20", "source", ["doc_id"])


@query("p02_open_markers", ["docs"], "SELECT doc_id, 'CRITICAL' AS severity, left(text, 100) AS excerpt FROM docs WHERE contains(upper(text), '[NEEDS_TRANSLATION:')")
def _p02(docs):
    return rp.open_markers(docs, ["doc_id"])


@query("p05_header_years", ["docs"], """
SELECT doc_id, 'WARNING' AS severity, CAST(y1 + doc_id % 2 AS VARCHAR) AS expected FROM docs WHERE NOT contains(text, CAST(y1 + doc_id % 2 AS VARCHAR))
UNION ALL SELECT doc_id, 'INFO', CAST(y1 - 1 - doc_id % 3 AS VARCHAR) FROM docs WHERE NOT contains(text, CAST(y1 - 1 - doc_id % 3 AS VARCHAR))""")
def _p05(docs):
    y = lambda e: e.cast("string")
    return rp.header_years(docs.select("doc_id", F.col("text").alias("header"), y(F.col("y1") + F.col("doc_id") % 2).alias("period_current"),
                                       y(F.col("y1") - 1 - F.col("doc_id") % 3).alias("period_prior")))


TAIL = "CASE doc_id % 6 WHEN 0 THEN ' 자 산 유동자산 매출액' WHEN 1 THEN ' 매 출 액 영업이익' WHEN 2 THEN ' 자본금 자본잉여금' WHEN 3 THEN ' 영업활동 현금 현금흐름' WHEN 4 THEN ' 현금흐름 자본변동' ELSE '' END"
SCORES = {c: " + ".join(f"CAST(regexp_matches(t, '{p}') AS INT)" for p in ps) for c, ps in rp.TYPE_PATTERNS.items()}
TYPED = f"""(SELECT doc_id, source, CASE GREATEST(b, i, e, c) WHEN 0 THEN 'BS' WHEN b THEN 'BS' WHEN i THEN 'IS' WHEN e THEN 'CE' ELSE 'CF' END AS stmt_type
 FROM (SELECT doc_id, source, {SCORES['BS']} AS b, {SCORES['IS']} AS i, {SCORES['CE']} + CASE WHEN regexp_matches(h, '{rp.EQUITY_HEADER}') THEN 3 ELSE 0 END AS e, {SCORES['CF']} AS c FROM (SELECT doc_id, source, text || {TAIL} AS t, {TAIL} AS h FROM docs) r) q)"""


def _typed(docs):
    t = docs.select("doc_id", "source", F.concat("text", F.expr(TAIL)).alias("t"), F.expr(TAIL).alias("h"))
    return rp.detect_statement(t, "t", "h").select("doc_id", "source", "stmt_type")


@query("e05_statement_type", ["docs"], f"SELECT doc_id, stmt_type FROM {TYPED} q")
def _e05(docs):
    return _typed(docs).select("doc_id", "stmt_type")


@query("e06_distinct_types", ["docs"], f"""
WITH t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM {TYPED} q),
 w AS (SELECT * FROM (WITH RECURSIVE r AS (SELECT source, doc_id, k, stmt_type, stmt_type AS given, [stmt_type] AS used FROM t WHERE k = 1
   UNION ALL SELECT t.source, t.doc_id, t.k, t.stmt_type, x, list_append(r.used, x) FROM (SELECT r.source, r.k, r.used, t.stmt_type AS s, CASE WHEN list_contains(r.used, t.stmt_type) THEN COALESCE(list_filter(['BS', 'IS', 'CE', 'CF'], lambda z: NOT list_contains(r.used, z))[1], t.stmt_type) ELSE t.stmt_type END AS x
      FROM r JOIN t ON t.source = r.source AND t.k = r.k + 1) r JOIN t ON t.source = r.source AND t.k = r.k + 1) SELECT source, doc_id, stmt_type, given FROM r) z)
SELECT source, doc_id, stmt_type, given AS final_type FROM w""")
def _e06(docs):
    return rp.distinct_types(_typed(docs), ["source"], "doc_id").select("source", "doc_id", "stmt_type", "final_type")


@query("e07_style_profile", ["tpl_lines"], """
WITH n AS (SELECT doc_id, style, COUNT(*) AS n, MIN(seq) AS s FROM tpl_lines GROUP BY ALL)
SELECT doc_id, arg_max(style, n * 1000000 - s) AS primary_style, MAX(style) FILTER (style = 'ABCTitle') AS title_style, COALESCE(MAX(style) FILTER (style = 'Subtitle'), MAX(style) FILTER (style = 'aff5')) AS subtitle_style,
 arg_max(style, n * 1000000 - s) FILTER (style NOT IN ('ABCTitle', 'aff5', 'Subtitle')) AS body_style FROM n GROUP BY doc_id""")
def _e07(lines):
    return rp.style_profile(lines, ["doc_id"])


@query("e07_table_profile", ["grid", "grid_cols"], """
WITH t AS (SELECT c.table_id, c.table_id % 50 AS doc_id, COUNT(*) FILTER (width < 200) AS sp, COUNT(*) AS wd FROM grid_cols c GROUP BY ALL),
 g AS (SELECT table_id, COUNT(*) FILTER (vmerge <> '') AS vm, COUNT(*) FILTER (span > 1) AS gs, NOT bool_or(row_idx = 1 AND text <> '') AS er FROM grid GROUP BY table_id),
 p AS (SELECT doc_id, AVG(CASE WHEN sp > 0 THEN 1.0 ELSE 0.0 END) AS s, AVG(CASE WHEN er THEN 1.0 ELSE 0.0 END) AS e, AVG(CASE WHEN wd > 0 THEN 1.0 ELSE 0.0 END) AS w, SUM(vm) AS vm, SUM(gs) AS gs, COUNT(*) AS n FROM t JOIN g USING (table_id) GROUP BY doc_id)
SELECT doc_id, n AS n_tables, CASE WHEN s > 0.3 THEN 'spacer_column' WHEN e > 0.2 THEN 'empty_row' WHEN s > 0.1 AND e > 0.1 THEN 'mixed' ELSE 'none' END AS spacing,
 CASE WHEN vm + gs = 0 THEN 'minimal' WHEN vm > gs * 2 THEN 'vmerge_heavy' WHEN gs > vm * 2 THEN 'gridspan_heavy' ELSE 'balanced' END AS merges, CASE WHEN w > 0.8 THEN 'fixed' WHEN w < 0.2 THEN 'auto' ELSE 'mixed' END AS widths, e > 0.2 AS empty_row_pattern FROM p""")
def _e07t(grid, cols):
    c = cols.groupBy("table_id").agg(F.count_if(F.col("width") < rp.SPACER_WIDTH).alias("n_spacers"), F.count("*").alias("n_widths"))
    g = grid.groupBy("table_id").agg(F.count_if(F.col("vmerge") != "").alias("n_vmerge"), F.count_if(F.col("span") > 1).alias("n_gridspan"),
                                     (~F.max((F.col("row_idx") == 1) & (F.col("text") != ""))).alias("empty_row2"))
    return rp.table_profile(c.join(g, "table_id").withColumn("doc_id", F.col("table_id") % 50), ["doc_id"])


@query("e23_find_statement_tables", ["stmt_rows"], """
WITH c AS (SELECT pair_id, CASE stmt_type WHEN 'BS' THEN 2 WHEN 'IS' THEN 1 ELSE 3 END AS tbl, row_idx, label FROM stmt_rows),
 t AS (SELECT pair_id, tbl, COUNT(DISTINCT row_idx) AS n, bool_or(contains(label, 'Total assets')) AND bool_or(contains(label, 'Total liabilities')) AS bs, bool_or(contains(label, 'Revenue')) AND bool_or(contains(label, 'Profit for the year')) AS ist FROM c GROUP BY ALL)
SELECT pair_id, 'BS' AS stmt_type, CAST(MIN(tbl) AS BIGINT) AS table_seq FROM t WHERE bs GROUP BY pair_id UNION ALL SELECT pair_id, 'IS', CAST(MIN(tbl) AS BIGINT) FROM t WHERE ist GROUP BY pair_id""")
def _e23(stmts):
    c = stmts.select("pair_id", F.when(F.col("stmt_type") == "BS", 2).when(F.col("stmt_type") == "IS", 1).otherwise(3).alias("tbl"), "row_idx", F.col("label").alias("text"))
    return rp.find_statement_tables(c, ["pair_id"], "tbl", min_rows=4, equity_rows=4)
