"""SQL equivalents, where SQL can say what a query gives."""

from __future__ import annotations

_GRID = "(SELECT unnest([0.01e0, 0.05e0, 0.1e0, 0.25e0, 0.5e0, 0.75e0, 0.9e0, 0.95e0, 0.99e0]) AS p)"


def _exact(*keys: str) -> str:
    """CTEs giving ``q(keys, field, n_rows, n_finite, p, value)``: the least value whose rank reaches p * n.

    Sketches of up to 8192 values are exact, so below that size these are the very
    percentiles; null where a group has no finite value.
    """
    own = "".join(f"{k}, " for k in keys)
    on = " AND ".join(["r.field = g.field", *(f"r.{k} IS NOT DISTINCT FROM g.{k}" for k in keys)])
    return f"""
v AS (SELECT {own}'aprob' AS field, aprob AS x FROM metric_records UNION ALL SELECT {own}'entropy_anchoring', entropy_anchoring FROM metric_records),
g AS (SELECT {own}field, count(*) AS n_rows, count(*) FILTER (isfinite(x)) AS n_finite FROM v GROUP BY ALL),
r AS (SELECT {own}field, x, row_number() OVER (PARTITION BY {own}field ORDER BY x) AS i FROM v WHERE isfinite(x)),
q AS (SELECT {"".join(f"g.{k}, " for k in keys)}g.field, g.n_rows, g.n_finite, p, r.x AS value FROM g CROSS JOIN {_GRID} LEFT JOIN r ON {on} AND r.i = greatest(1, ceil(p * g.n_finite))::BIGINT)"""


_DAYS = f"WITH {_exact('method', 'run_day')} SELECT method, run_day, field, n_rows, n_finite, p, value, 0e0 AS max_rank_error FROM q"
_WHOLE = f"WITH {_exact('method')} SELECT method, field, n_rows, n_finite, p, value, 0e0 AS max_rank_error FROM q"
_CHECKED = f"WITH {_exact('method')} SELECT method, field, p, n_finite, value, true AS within FROM q WHERE n_finite > 0"


#: Letters of each text, its runs of 30 letters that occurred before, and the letters these cover.
_SHARES = r"""
t AS (
  SELECT 'raw_output' AS field, seq AS rec_id, coalesce(method, 'R0') AS method, raw_output AS text FROM raw_generations
  UNION ALL SELECT 'reasonings', sample_idx, e.key, e.value FROM (SELECT sample_idx, unnest(map_entries(reasonings)) AS e FROM metric_rows)
),
s AS (SELECT row_number() OVER () AS u, field, rec_id, method, regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', '', 'g') AS s FROM t),
r AS (SELECT u, i, row_number() OVER (PARTITION BY u, substr(s, i, 30) ORDER BY i) > 1 AS again FROM (SELECT u, s, unnest(range(1, length(s) - 28)) AS i FROM s WHERE length(s) >= 60)),
c AS (SELECT u, least(30, coalesce(lead(i) OVER (PARTITION BY u ORDER BY i) - i, 30)) AS n FROM r WHERE again),
q AS (SELECT field, rec_id, method, CASE WHEN length(s) >= 60 THEN coalesce(n, 0) / length(s) END AS share FROM s LEFT JOIN (SELECT u, sum(n) AS n FROM c GROUP BY u) USING (u))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_shares": f"WITH {_SHARES} SELECT field, rec_id, method, round(share, 9) AS share FROM q",
        "p4_found": f"WITH {_SHARES} SELECT field, rec_id, method FROM q WHERE share >= 0.33",
        "p1_by_day": _DAYS,
        "p1_percentiles": f"SELECT *, 'run_day' AS scope FROM ({_DAYS}) UNION ALL BY NAME SELECT *, 'whole' AS scope FROM ({_WHOLE})",
        "p1_rank_check": _CHECKED,
        "p1_merged": f"SELECT * FROM ({_CHECKED}), (SELECT unnest(['run_day', 'run_id', 'rank_no']) AS merged_from)",
        "p7_fill": "SELECT spec_id, capacity_tokens AS capacity, items, true AS pieces_whole, true AS unsplit, true AS within, true AS filled FROM pack_specs, (SELECT count(*) AS items FROM documents)",
        "p6_round_trip": "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, true AS same FROM documents",
    }
