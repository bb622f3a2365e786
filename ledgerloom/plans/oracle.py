"""SQL fragments shared by the oracles."""

from __future__ import annotations

SPACE = r"[\s\x{00a0}\x{3000}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def greedy(edges: str, g: str = "g") -> str:
    """Serial choice over ``edges(g, l, r, s, o)`` as a recursive query giving g, l, r, s."""
    return f"""(WITH RECURSIVE cand AS (
      SELECT g, l, dense_rank() OVER (PARTITION BY g ORDER BY l) AS k,
             list(struct_pack(r := r, s := s) ORDER BY s DESC, o, r) AS c FROM {edges} GROUP BY g, l),
    walk AS (
      SELECT g, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS l,
             CAST(NULL AS BIGINT) AS r, CAST(NULL AS DOUBLE) AS s FROM cand GROUP BY g
      UNION ALL
      SELECT g, k, CASE WHEN p IS NULL THEN used ELSE list_append(used, p.r) END, l, p.r, p.s FROM (
        SELECT w.g, c.k, w.used, c.l, list_filter(c.c, lambda x: NOT list_contains(w.used, x.r))[1] AS p
        FROM walk w JOIN cand c ON c.g = w.g AND c.k = w.k + 1) z)
    SELECT g, l, r, s FROM walk WHERE r IS NOT NULL)"""


def convert(v: str, frm: str, to: str) -> str:
    """Unit conversion with halves away from zero, in whole numbers."""
    f = "CASE {u} WHEN 'won' THEN 1 WHEN 'thousand' THEN 1000 WHEN 'million' THEN 1000000 ELSE 1000 END"
    a, b = f.format(u=frm), f.format(u=to)
    return f"CAST(SIGN({v}) * ((ABS({v}) * ({a}) * 2 + ({b})) // (2 * ({b}))) AS BIGINT)"


def fmt(v: str) -> str:
    return f"(CASE WHEN {v} IS NULL OR {v} = 0 THEN '-' WHEN {v} < 0 THEN '(' || format('{{:,}}', -{v}) || ')' ELSE format('{{:,}}', {v}) END)"


def whole(x: str, lenient: bool = True) -> str:
    """Whole-amount parser (triangles, brackets, fraction cut)."""
    t = strip(x)
    u = f"(CASE WHEN {t} LIKE '(%)' THEN substring({t}, 2, length({t}) - 2) ELSE {t} END)"
    neg = f"({t} LIKE '(%)' OR {u} LIKE '△%' OR {u} LIKE '▲%')"
    v = rf"regexp_replace(regexp_replace({u}, '^[△▲]', ''), '[,  \x{{00a0}}]', '', 'g')"
    if lenient:
        v = strip(rf"regexp_replace({v}, '^\\+', '')")
    n = f"TRUNC(TRY_CAST(regexp_replace({v}, '^-', '') AS DECIMAL(38,6)))"
    return (f"CAST(CASE WHEN {t} IN ('', '-', '–', '—', chr(92), '/') THEN 0 "
            f"WHEN {neg} OR {v} LIKE '-%' THEN -{n} ELSE {n} END AS BIGINT)")
