"""Common table expressions for a second engine (DuckDB), written independently of the operators."""

from __future__ import annotations

from .tables import DELTA_T, EVENTS, SHARE

SPAN = """span AS (SELECT CASE WHEN lo = date_trunc('month', lo) THEN lo ELSE date_trunc('month', lo) + INTERVAL 1 MONTH END AS first, date_trunc('month', hi + INTERVAL 1 DAY) AS last FROM (SELECT min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem))"""
BM = f"""{SPAN}, bm AS (SELECT p_brand AS entity, date_trunc('month', l_shipdate)::DATE AS date, sum(l_extendedprice) AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= (SELECT first FROM span) AND l_shipdate < (SELECT last FROM span) GROUP BY ALL)"""
SM = f"""{SPAN}, bm AS (SELECT l_suppkey::VARCHAR AS entity, date_trunc('month', l_shipdate)::DATE AS date, sum(l_extendedprice) AS price
  FROM lineitem WHERE l_shipdate >= (SELECT first FROM span) AND l_shipdate < (SELECT last FROM span) GROUP BY ALL)"""
CAL = "cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM bm))"
KEEP = "keepd AS (SELECT date FROM bm GROUP BY date HAVING count(*) = (SELECT count(DISTINCT entity) FROM bm))"
PANEL = f"""{BM}, {CAL}, {KEEP},
panel AS (SELECT entity, date, dense_rank() OVER (ORDER BY date) - 1 AS t, price FROM bm WHERE date IN (SELECT date FROM keepd))"""
RET = f"""{PANEL},
ret AS (SELECT entity, t - 1 AS t, date, y FROM (SELECT *, ln(price) - lag(ln(price)) OVER (PARTITION BY entity ORDER BY t) AS y FROM panel) WHERE y IS NOT NULL)"""
CORR = f"""{RET},
num AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS i FROM (SELECT DISTINCT entity FROM ret)),
r AS (SELECT num.i, ret.t, ret.y FROM ret JOIN num USING (entity)),
wx AS (SELECT w, i, t, y FROM r JOIN (SELECT DISTINCT t AS w FROM r) ON t >= w AND t < w + {DELTA_T} WHERE w + {DELTA_T} <= (SELECT max(t) + 1 FROM r)),
corr AS (SELECT a.w, a.i, b.i AS j, coalesce(covar_pop(a.y, b.y) / nullif(stddev_pop(a.y) * stddev_pop(b.y), 0), 0) AS rho
  FROM wx a JOIN wx b ON a.w = b.w AND a.t = b.t AND a.i < b.i GROUP BY ALL),
nn AS (SELECT count(*) AS n FROM num)"""
EDGES = f"""{CORR},
budget AS (SELECT round_even({SHARE} * n * (n - 1) / 2, 0)::BIGINT AS k FROM nn),
edges AS (SELECT w, i, j, rho FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY rho DESC, i, j) AS q FROM corr) WHERE q <= (SELECT k FROM budget)),
wins AS (SELECT DISTINCT w FROM corr),
arcs AS (SELECT w, i AS u, j AS v FROM edges UNION ALL SELECT w, j, i FROM edges),
deg AS (SELECT w, u AS node, count(*) AS degree FROM arcs GROUP BY ALL)"""
PART = "part4 AS (SELECT i AS node, i % 4 AS comm FROM num)"
MIX = f"""{EDGES}, {PART},
mix AS (SELECT w, least(a.comm, b.comm) AS a, greatest(a.comm, b.comm) AS b, count(*) AS n_edges
  FROM edges JOIN part4 a ON a.node = i JOIN part4 b ON b.node = j GROUP BY ALL)"""
DAILY = """d0 AS (SELECT o_orderdate::DATE AS stamp, sum(o_totalprice) AS v, count(*)::DOUBLE AS c, avg(o_totalprice) AS x FROM orders GROUP BY 1),
daily AS (SELECT row_number() OVER (ORDER BY stamp) - 1 AS w, stamp, x, c, v, coalesce(ln(v) - lag(ln(v)) OVER (ORDER BY stamp), 0) AS ret FROM d0)"""
EV = "ev(name, onset, start, fin, tier) AS (VALUES " + ", ".join(f"('{a}', DATE '{b}', DATE '{c}', DATE '{d}', '{e}')" for a, b, c, d, e in EVENTS) + ")"
Z = f"""{DAILY}, {EV},
z AS (SELECT *, CASE WHEN k >= 30 THEN (x - m) / nullif(s, 0) END AS z FROM (
  SELECT *, count(x) OVER p AS k, avg(x) OVER p AS m, stddev_samp(x) OVER p AS s FROM daily WINDOW p AS (ORDER BY w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))),
lab AS (SELECT *, (EXISTS (SELECT 1 FROM ev WHERE stamp BETWEEN start AND fin AND tier = 'sharp'))::INT AS label FROM z)"""


def ranked(source: str, value: str, by: str = "") -> str:
    """Rows of a source with the average rank `r` of a value."""
    part = f"PARTITION BY {by}" if by else ""
    tie = f"PARTITION BY {by + ', ' if by else ''}{value}"
    return f"(SELECT *, rank() OVER ({part} ORDER BY {value}) + (count(*) OVER ({tie}) - 1) / 2.0::DOUBLE AS r FROM {source} WHERE {value} IS NOT NULL)"
