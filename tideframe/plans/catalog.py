"""Queries over the star-schema tables, each with its columns' kinds and, where SQL can say it, an oracle.

Kinds: i whole number, f number (rounded to six places in both engines, whose
sums differ in the last bits), s text, b truth value, d date as text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.safe import corr, lcg, lcg_sql
from ..operators import graph, kernels, network, panel, signals, windows
from . import oracle as o
from . import tables as tb
from .stages import materialised
from .tables import DELTA_T

_CAST = {"i": "long", "s": "string", "b": "boolean", "d": "string"}
_SQL = {"i": "CAST({0} AS BIGINT)", "f": "round(CAST({0} AS DOUBLE), 6) + 0.0", "s": "CAST({0} AS VARCHAR)", "b": "CAST({0} AS BOOLEAN)", "d": "CAST(CAST({0} AS DATE) AS VARCHAR)"}


@dataclass(frozen=True)
class Query:
    make: Callable[[SparkSession, str], DataFrame]
    kinds: dict[str, str]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.make(spark, sf_dir)
        return df.select(*((F.round(F.col(c).cast("double"), 6) + F.lit(0.0) if k == "f" else F.col(c).cast(_CAST[k])).alias(c) for c, k in self.kinds.items()))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        ctes, _, body = self.sql.rpartition("@@")
        return (f"WITH {ctes} " if ctes else "") + "SELECT " + ", ".join(f"{_SQL[k].format(c)} AS {c}" for c, k in self.kinds.items()) + f" FROM ({body})"


CATALOG: dict[str, Query] = {}


def query(kinds: str, sql: str | None = None):
    """Registers the function under its name; `sql` is CTEs, then @@, then the body."""

    def add(make):
        CATALOG[make.__name__] = Query(make, dict(x.split(":") for x in kinds.split()), sql)
        return make

    return add


# ---------------------------------------------------------------- panels


@query("entity:s date:d t:i y:f", o.RET + "@@SELECT entity, date, t, y FROM ret")
def panel_log_returns(spark, sf):
    return tb.returns_of(spark, sf)


@query("entity:s n_obs:i coverage:f full_span:b min_price:f", f"""{o.SM}, {o.CAL}@@SELECT entity, count(*) AS n_obs, count(*) / (SELECT count(*) FROM cal)::DOUBLE AS coverage,
  min(t) <= 5 AND max(t) >= (SELECT count(*) FROM cal) - 6 AS full_span, min(price) AS min_price FROM bm JOIN cal USING (date) GROUP BY entity""")
def panel_full_span(spark, sf):
    return panel.spans(tb.supplier_months(spark, sf))


@query("threshold:f survivors:i", f"""{o.SM}, {o.CAL}, s AS (SELECT entity, count(*) / (SELECT count(*) FROM cal)::DOUBLE AS c, min(t) <= 5 AND max(t) >= (SELECT count(*) FROM cal) - 6 AS ok FROM bm JOIN cal USING (date) GROUP BY 1)
@@SELECT threshold, count(*) FILTER (c >= threshold) AS survivors FROM s, (VALUES (0.9::DOUBLE), (0.95::DOUBLE), (0.98::DOUBLE), (0.99::DOUBLE), (1.0::DOUBLE)) v(threshold) WHERE ok GROUP BY threshold""")
def panel_coverage_ladder(spark, sf):
    return panel.coverage_ladder(tb.supplier_months(spark, sf))


@query("date:d entity:s t:i price:f", f"""{o.SM}, {o.CAL}, ok AS (SELECT entity FROM bm JOIN cal USING (date) GROUP BY 1 HAVING min(t) <= 5 AND max(t) >= (SELECT count(*) FROM cal) - 6 AND count(*) / (SELECT count(*) FROM cal)::DOUBLE >= 0.95 AND min(price) > 0),
k AS (SELECT * FROM bm WHERE entity IN (SELECT entity FROM ok)), d AS (SELECT date FROM k GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM ok))
@@SELECT date, entity, dense_rank() OVER (ORDER BY date) - 1 AS t, price FROM k WHERE date IN (SELECT date FROM d)""")
def panel_build(spark, sf):
    return panel.build_panel(tb.supplier_months(spark, sf), min_coverage=0.95)


@query("entity:s date:d price:f", f"""{o.SM}, {o.CAL}, g AS (SELECT e.entity, cal.date, price FROM (SELECT DISTINCT entity FROM bm) e CROSS JOIN cal LEFT JOIN bm USING (entity, date))
@@SELECT entity, date, coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date), first_value(price IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM g""")
def panel_ffill(spark, sf):
    return panel.fill(tb.supplier_months(spark, sf))


@query("year:i dropped_days:i", f"{o.SM}, {o.KEEP}@@SELECT year(date) AS year, count(*) AS dropped_days FROM (SELECT DISTINCT date FROM bm WHERE date NOT IN (SELECT date FROM keepd)) GROUP BY 1")
def panel_dropped_by_year(spark, sf):
    return panel.dropped_by_year(tb.supplier_months(spark, sf))


@query("entity:s date:d y:f", f"""{o.SM}, {o.CAL}, thick AS (SELECT entity FROM bm GROUP BY 1 HAVING count(*) >= floor((SELECT count(*) FROM cal) * 0.9)),
s AS (SELECT entity, date, CASE WHEN lag(t) OVER p = t - 1 THEN ln(price) - lag(ln(price)) OVER p END AS y FROM (SELECT bm.*, dense_rank() OVER (ORDER BY date) AS t FROM bm WHERE entity IN (SELECT entity FROM thick)) WINDOW p AS (PARTITION BY entity ORDER BY t)),
k AS (SELECT * FROM s WHERE y IS NOT NULL)@@SELECT * FROM k WHERE date IN (SELECT date FROM k GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT entity) FROM k))""")
def panel_thin_returns(spark, sf):
    return panel.thin_returns(tb.supplier_months(spark, sf))


@query("symbol:s act_symbol:s name:s", """@@SELECT replace(trim(symbol), '.', '-') AS symbol, min(trim(symbol)) AS act_symbol, min(name) AS name FROM (
  SELECT ' S.' || (s_suppkey % 40) AS symbol, CASE WHEN s_nationkey % 3 = 0 THEN 'Q' ELSE 'N' END AS exchange, s_suppkey % 5 = 0 AS etf, s_suppkey % 11 = 0 AS test_issue,
  s_name || CASE WHEN s_suppkey % 4 = 0 THEN ' Preferred' ELSE ' Common Stock' END AS name FROM supplier) WHERE exchange = 'N' AND NOT etf AND NOT test_issue AND name LIKE '%Common Stock%' GROUP BY 1""")
def universe_filter(spark, sf):
    return panel.universe(tb.listing(spark, sf))


ZEROED = "zr AS (SELECT entity, t, date, CASE WHEN abs(y) < 0.15 THEN 0.0 ELSE y END AS y FROM ret)"


def _zeroed(spark, sf):
    """Returns with small ones set to exactly 0, so that the gates have something to find."""
    return tb.returns_of(spark, sf).withColumn("y", F.when(F.abs("y") < 0.15, F.lit(0.0)).otherwise(F.col("y")))


RUNS = "runs AS (SELECT entity, max(n) AS run FROM (SELECT entity, count(*) AS n FROM (SELECT *, sum((y <> 0)::INT) OVER (PARTITION BY entity ORDER BY t) AS g FROM zr) WHERE y = 0 GROUP BY entity, g) GROUP BY 1)"


@query("entity:s run:i", f"{o.RET}, {ZEROED}, {RUNS}@@SELECT e.entity, coalesce(run, 0) AS run FROM (SELECT DISTINCT entity FROM zr) e LEFT JOIN runs USING (entity)")
def longest_zero_run(spark, sf):
    return panel.longest_zero_run(_zeroed(spark, sf))


@query("entity:s run:i g1:b g2:b g3:b zero_share:f keep:b", f"""{o.RET}, {ZEROED}, {RUNS}, f AS (SELECT entity, bool_or(abs(y) > 0.45 AND CASE WHEN y <> 0 THEN -nx / y ELSE 0 END > 0.7) AS g2, max(abs(y)) >= 0.95 AS g3, avg((y = 0)::INT) AS zero_share
  FROM (SELECT *, lead(y, 1, 0.0) OVER (PARTITION BY entity ORDER BY t) AS nx FROM zr) GROUP BY 1)
@@SELECT f.entity, coalesce(run, 0) AS run, coalesce(run, 0) >= 7 AS g1, g2, g3, zero_share, NOT (coalesce(run, 0) >= 7 OR g2 OR g3) AS keep FROM f LEFT JOIN runs USING (entity)""")
def gate_report(spark, sf):
    return panel.gate_flags(_zeroed(spark, sf), delta_t=7, large=0.45, extreme=0.95)


@query("entity:s t:i y:f", f"""{o.RET}, {ZEROED}, {RUNS}@@SELECT entity, t, y FROM zr WHERE entity NOT IN (SELECT entity FROM runs WHERE run >= 7)
  AND entity NOT IN (SELECT entity FROM (SELECT *, lead(y, 1, 0.0) OVER (PARTITION BY entity ORDER BY t) AS nx FROM zr) WHERE abs(y) > 0.45 AND -nx / y > 0.7) AND entity NOT IN (SELECT entity FROM zr WHERE abs(y) >= 0.95)""")
def gated_returns(spark, sf):
    return panel.gated(_zeroed(spark, sf), delta_t=7, large=0.45, extreme=0.95)


@query("entity:s t:i y:f simple:f vol:f sigmas:f", f"""{o.RET}@@SELECT entity, t, y, exp(y) - 1 AS simple, vol, abs(y) / nullif(vol, 0) AS sigmas FROM (
  SELECT *, CASE WHEN count(y) OVER p > 2 THEN stddev_pop(y) OVER p END AS vol FROM ret WINDOW p AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WHERE abs(y) > 0.3""")
def large_moves(spark, sf):
    return panel.large_moves(tb.returns_of(spark, sf), threshold=0.3)


@query("entity:s mean:f sd:f low:f high:f kurtosis:f", f"{o.RET}@@SELECT entity, avg(y) AS mean, stddev_samp(y) AS sd, min(y) AS low, max(y) AS high, kurtosis(y) AS kurtosis FROM ret GROUP BY 1")
def return_moments(spark, sf):
    return panel.moments(tb.returns_of(spark, sf))


@query("n:i skew:f kurtosis:f max_abs:f median:f", f"{o.RET}@@SELECT count(y) AS n, skewness(y) AS skew, kurtosis(y) AS kurtosis, max(abs(y)) AS max_abs, median(y) AS median FROM ret")
def pooled_moments(spark, sf):
    return panel.pooled_moments(tb.returns_of(spark, sf))


@query("entity:s t:i z:f", f"{o.RET}@@SELECT entity, t, coalesce(c / nullif(sqrt(sum(c * c) OVER (PARTITION BY entity)), 0), 0) AS z FROM (SELECT *, y - avg(y) OVER (PARTITION BY entity) AS c FROM ret)")
def standardised_returns(spark, sf):
    return panel.standardise(tb.returns_of(spark, sf))


@query("entity:s t:i z:f", f"{o.RET}@@SELECT entity, t, (y - avg(y) OVER p) / stddev_samp(y) OVER p AS z FROM ret WINDOW p AS (PARTITION BY entity)")
def scaled_returns(spark, sf):
    return panel.scale(tb.returns_of(spark, sf))


RESID = "mk AS (SELECT t, avg(y) AS market FROM ret GROUP BY 1), be AS (SELECT entity, regr_slope(y, market) AS beta FROM ret JOIN mk USING (t) GROUP BY 1), res AS (SELECT entity, t, date, beta, y - market * beta AS residual FROM ret JOIN mk USING (t) JOIN be USING (entity))"


@query("entity:s t:i beta:f residual:f", f"{o.RET}, {RESID}@@SELECT * FROM res")
def market_residual(spark, sf):
    return panel.market_residual(tb.returns_of(spark, sf))


@query("variant:s i:i j:i s:f", f"""{o.RET}, {RESID}, num AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS i FROM (SELECT DISTINCT entity FROM ret)),
v AS (SELECT 'in' AS mk, i, t, y FROM ret JOIN num USING (entity) UNION ALL SELECT 'out', i, t, residual FROM res JOIN num USING (entity)),
c AS (SELECT a.mk, a.i, b.i AS j, covar_samp(a.y, b.y) AS cv, covar_pop(a.y, b.y) / nullif(stddev_pop(a.y) * stddev_pop(b.y), 0) AS cr FROM v a JOIN v b ON a.mk = b.mk AND a.t = b.t AND a.i <= b.i GROUP BY ALL)
@@SELECT 'cov_' || mk AS variant, i, j, cv AS s FROM c UNION ALL SELECT 'corr_' || mk, i, j, cr FROM c""")
def similarity_variants(spark, sf):
    rets = tb.returns_of(spark, sf)
    out = panel.market_residual(rets).select("entity", "t", F.col("residual").alias("y"))
    parts = [network.similarity(r, c).withColumn("variant", F.lit(f"{'corr' if c else 'cov'}_{m}")) for m, r in (("in", rets), ("out", out)) for c in (False, True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# ---------------------------------------------------------------- networks


@query("w:i i:i j:i rho:f", o.CORR + "@@SELECT * FROM corr")
def window_pair_correlation(spark, sf):
    return network.window_correlation(tb.returns_of(spark, sf), DELTA_T)


@query("w:i i:i j:i rho:f", o.EDGES + "@@SELECT * FROM edges")
def window_top_edges(spark, sf):
    return tb.edges_of(spark, sf)[0]


MEAN_CORR = "mc AS (SELECT w, avg(rho) AS mean_corr FROM corr GROUP BY 1)"


@query("w:i tau:f mean_weight:f max_weight:f n_edges:i n_isolated:i max_degree:i n_below:i mean_corr:f", f"""{o.EDGES}, {MEAN_CORR}, k AS (SELECT w, min(rho) AS tau, avg(rho) AS mean_weight, max(rho) AS max_weight, count(*) AS n_edges FROM edges GROUP BY 1),
nd AS (SELECT w, (SELECT n FROM nn) - count(*) AS n_isolated, max(degree) AS max_degree FROM deg GROUP BY 1), nb AS (SELECT w, count(*) FILTER (rho < -tau) AS n_below FROM corr JOIN k USING (w) GROUP BY 1)
@@SELECT * FROM k JOIN nd USING (w) JOIN nb USING (w) JOIN mc USING (w)""")
def network_summary(spark, sf, policy="drop_days"):
    """The flagship."""
    rets, edges, _, _ = tb.network_of(spark, sf, policy)
    return network.network_summary(rets, DELTA_T, tb.SHARE, edges)


@query("w:i mean_corr:f", f"{o.CORR}, {MEAN_CORR}@@SELECT * FROM mc")
def mean_correlation_identity(spark, sf):
    return network.mean_correlation(tb.returns_of(spark, sf), DELTA_T)


@query("w:i node:i degree:i", o.EDGES + "@@SELECT * FROM deg")
def node_degrees(spark, sf):
    return network.degrees(tb.edges_of(spark, sf)[0])


@query("convention:s w:i stamp:d", f"""{o.PANEL}, pc AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM panel))
@@SELECT convention, t - s AS w, date AS stamp FROM pc, (VALUES ('t1', 0), ('midpoint', {DELTA_T // 2}), ('t2', {DELTA_T})) v(convention, s) WHERE t - s >= 0 AND t - s < (SELECT count(*) FROM pc) - {DELTA_T}""")
def window_stamps(spark, sf):
    prices = tb.panel_of(spark, sf).select("entity", "date", "price")
    a, b, c = (network.window_stamps(prices, DELTA_T, k).withColumn("convention", F.lit(k)) for k in network.STAMPS)
    return a.unionByName(b).unionByName(c)


@query("w:i q95:f below_max:f", f"{o.CORR}@@SELECT w, quantile_cont(rho, 0.95) AS q95, avg((rho < m)::INT) AS below_max FROM (SELECT *, max(rho) OVER (PARTITION BY w) AS m FROM corr) GROUP BY w")
def correlation_quantiles(spark, sf):
    corr = network.window_correlation(tb.returns_of(spark, sf), DELTA_T)
    top = corr.groupBy("w").agg(F.max("rho").alias("m"))
    return corr.join(top, "w").groupBy("w").agg(F.percentile("rho", F.lit(0.95)).alias("q95"), F.avg((F.col("rho") < F.col("m")).cast("int")).alias("below_max"))


@query("w:i bin:i n:i", f"{o.CORR}@@SELECT w, least(floor((rho + 1) * 10), 19) AS bin, count(*) AS n FROM corr GROUP BY ALL")
def correlation_histogram(spark, sf):
    corr = network.window_correlation(tb.returns_of(spark, sf), DELTA_T)
    return corr.groupBy("w", F.least(F.floor((F.col("rho") + 1) * 10), F.lit(19)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("w:i purity:f", f"{o.MIX}@@SELECT w, sum(n_edges) FILTER (a = b) * 1.0 / sum(n_edges) AS purity FROM (SELECT w, a, b, n_edges FROM mix UNION ALL SELECT w, 0, 0, 0 FROM mix) GROUP BY 1")
def edge_purity(spark, sf):
    edges, n = tb.edges_of(spark, sf)
    return network.attribute_purity(edges, tb.partition_of(spark, n))


@query("w:i i:i j:i pair:i back_i:i back_j:i", f"{o.EDGES}@@SELECT w, i, j, i * (SELECT n FROM nn) + j AS pair, i AS back_i, j AS back_j FROM edges")
def packed_pairs(spark, sf):
    edges, n = tb.edges_of(spark, sf)
    packed = edges.withColumn("pair", F.col("i").cast("long") * n + F.col("j"))
    return packed.withColumns({"back_i": F.floor(F.col("pair") / n), "back_j": F.col("pair") % n})


# ---------------------------------------------------------------- communities


@query("w:i a:i b:i n_edges:i", o.MIX + "@@SELECT * FROM mix")
def mixing_matrix(spark, sf):
    edges, n = tb.edges_of(spark, sf)
    return graph.mixing_matrix(edges, tb.partition_of(spark, n))


Q = "qq AS (SELECT w, sum(e / m - pow(d / (2 * m), 2)) AS q FROM (SELECT w, c, sum(e) AS e, sum(d) AS d FROM (SELECT w, a AS c, CASE WHEN a = b THEN n_edges ELSE 0 END AS e, CASE WHEN a = b THEN 2 * n_edges ELSE n_edges END AS d FROM mix UNION ALL SELECT w, b, 0, n_edges FROM mix WHERE a <> b) GROUP BY ALL) JOIN (SELECT w, sum(n_edges)::DOUBLE AS m FROM mix GROUP BY 1) USING (w) GROUP BY 1)"


@query("w:i q:f", f"{o.MIX}, {Q}@@SELECT * FROM qq")
def modularity_of_partition(spark, sf):
    return graph.modularity(mixing_matrix(spark, sf))


@query("w:i q_lag:f", f"""{o.EDGES}, p AS (SELECT w, i AS node, (i + w) % 4 AS comm FROM num, (SELECT DISTINCT w FROM edges)),
mix AS (SELECT e.w, least(x.comm, y.comm) AS a, greatest(x.comm, y.comm) AS b, count(*) AS n_edges FROM edges e JOIN p x ON x.w = e.w - 10 AND x.node = e.i JOIN p y ON y.w = e.w - 10 AND y.node = e.j GROUP BY ALL), {Q}
@@SELECT w, q AS q_lag FROM qq""")
def lagged_modularity(spark, sf):
    edges, n = tb.edges_of(spark, sf)
    part = edges.select("w").distinct().crossJoin(tb.partition_of(spark, n)).select("w", "node", ((F.col("node") + F.col("w")) % 4).alias("comm"))
    return graph.modularity(graph.mixing_matrix(edges, graph.lagged(part, 10))).withColumnRenamed("q", "q_lag")


@query("node:i comm:i", f"{o.CORR}, p AS (SELECT i AS node, (i * i) % 7 AS comm FROM num), s AS (SELECT comm, row_number() OVER (ORDER BY count(*) DESC, comm) - 1 AS k FROM p GROUP BY comm)@@SELECT node, k AS comm FROM p JOIN s USING (comm)")
def relabelled_by_size(spark, sf):
    n = tb.returns_of(spark, sf).select("entity").distinct().count()
    return graph.relabel_by_size(tb.partition_of(spark, n).select("node", (F.col("node") * F.col("node") % 7).alias("comm")))


@query("w:i a:i b:i p:f", f"""{o.MIX}, s AS (SELECT comm, count(*) AS s FROM part4 GROUP BY 1)
@@SELECT w, a, b, least(1, greatest(0, coalesce(CASE WHEN a = b THEN 2 * n_edges / nullif(x.s * (x.s - 1), 0)::DOUBLE ELSE n_edges / (x.s * y.s)::DOUBLE END, 0))) AS p FROM mix JOIN s x ON x.comm = a JOIN s y ON y.comm = b""")
def block_probabilities(spark, sf):
    return _block_probabilities(*tb.edges_of(spark, sf))


def _block_probabilities(edges, n):
    part = tb.partition_of(edges.sparkSession, n)
    return graph.block_probabilities(graph.mixing_matrix(edges, part), part.groupBy("comm").agg(F.count(F.lit(1)).alias("s")))


@query("w:i n_edges:i", f"""{o.MIX}, s AS (SELECT comm, count(*) AS s FROM part4 GROUP BY 1),
pr AS (SELECT w, a, b, coalesce(CASE WHEN a = b THEN 2 * n_edges / nullif(x.s * (x.s - 1), 0)::DOUBLE ELSE n_edges / (x.s * y.s)::DOUBLE END, 0) AS p FROM mix JOIN s x ON x.comm = a JOIN s y ON y.comm = b)
@@SELECT w, count(*) AS n_edges FROM part4 x JOIN part4 y ON x.node < y.node JOIN pr ON a = least(x.comm, y.comm) AND b = greatest(x.comm, y.comm) WHERE {lcg_sql('42', 'w', 'x.node', 'y.node')} < p GROUP BY 1""")
def block_model_edge_counts(spark, sf):
    edges, n = tb.edges_of(spark, sf)
    made = graph.block_model_edges(_block_probabilities(edges, n), tb.partition_of(spark, n), lambda w, i, j: lcg(F.lit(42), w, i, j))
    return made.groupBy("w").agg(F.count(F.lit(1)).alias("n_edges"))


@query("nmi:f", f"""{o.CORR}, c AS (SELECT i % 4 AS x, (i * i) % 7 AS y, count(*)::DOUBLE AS n FROM num GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c),
hx AS (SELECT -sum(n / t * ln(n / t)) AS h FROM (SELECT x, sum(n) AS n FROM c GROUP BY 1), t), hy AS (SELECT -sum(n / t * ln(n / t)) AS h FROM (SELECT y, sum(n) AS n FROM c GROUP BY 1), t), hj AS (SELECT -sum(n / t * ln(n / t)) AS h FROM c, t)
@@SELECT 2 * (hx.h + hy.h - hj.h) / (hx.h + hy.h) AS nmi FROM hx, hy, hj""")
def partition_nmi(spark, sf):
    part = tb.partition_of(spark, tb.returns_of(spark, sf).select("entity").distinct().count())
    return graph.nmi(part, part.select("node", (F.col("node") * F.col("node") % 7).alias("comm")))


@query("k:i cost:f compresses:b break_even:f", f"{o.CORR}@@SELECT k, k + k * (k + 1) / 2.0 AS cost, k + k * (k + 1) / 2.0 < n AS compresses, (-3 + sqrt(9 + 8 * n::DOUBLE)) / 2 AS break_even FROM nn, range(1, 200) r(k) WHERE k <= n")
def compression_cost(spark, sf):
    n = tb.returns_of(spark, sf).select("entity").distinct().count()
    return graph.compression(spark.range(1, n + 1).withColumnRenamed("id", "k"), n)


@query("half_life:f", f"""{o.DAILY}, q AS (SELECT lag, corr(a.x, b.x) AS q FROM (VALUES (0), (1), (2), (5), (10)) v(lag) JOIN daily a ON true JOIN daily b ON b.w = a.w + lag GROUP BY 1),
p AS (SELECT *, lag(lag) OVER (ORDER BY lag) AS lag0, lag(q) OVER (ORDER BY lag) AS q0, first_value(q) OVER (ORDER BY lag) / 2 AS half FROM q)
@@SELECT min_by(lag0 + (q0 - half) * (lag - lag0) / (q0 - q), lag) AS half_life FROM p WHERE q <= half AND q0 > half""")
def decay_half_life(spark, sf):
    d = tb.daily(spark, sf)
    lags = spark.createDataFrame([(k,) for k in (0, 1, 2, 5, 10)], "lag int")
    ahead = d.select("w", F.col("x").alias("y"))
    rows = d.crossJoin(F.broadcast(lags)).withColumn("w", F.col("w") + F.col("lag")).join(ahead, "w")
    return graph.half_life(rows.groupBy("lag").agg(corr(F.col("x"), F.col("y")).alias("q")))


# ---------------------------------------------------------------- topology


@query("w:i assortativity:f", f"""{o.EDGES}@@SELECT w, covar_pop(x.degree, y.degree) / nullif(stddev_pop(x.degree) * stddev_pop(y.degree), 0) AS assortativity FROM arcs JOIN deg x USING (w) JOIN deg y USING (w) WHERE x.node = u AND y.node = v GROUP BY 1""")
def assortativity(spark, sf):
    return graph.assortativity(tb.edges_of(spark, sf)[0])


@query("w:i transitivity:f", f"""{o.EDGES}, tr AS (SELECT a.w, count(*) AS n FROM edges a JOIN edges b ON a.w = b.w AND a.j = b.i JOIN edges c ON c.w = a.w AND c.i = a.i AND c.j = b.j GROUP BY 1)
@@SELECT w, coalesce(3 * n / nullif(t, 0), 0) AS transitivity FROM (SELECT w, sum(degree * (degree - 1) / 2.0) AS t FROM deg GROUP BY 1) LEFT JOIN tr USING (w)""")
def transitivity(spark, sf):
    return graph.transitivity(tb.edges_of(spark, sf)[0])


RC = """rc AS (SELECT w, k, CASE WHEN n >= 2 THEN 2.0 * coalesce(m, 0) / (n * (n - 1)) END AS phi FROM (SELECT w, unnest(range(0, mx + 1)) AS k FROM (SELECT w, max(degree) AS mx FROM deg GROUP BY 1)) ks
  LEFT JOIN LATERAL (SELECT count(*) AS n FROM deg WHERE deg.w = ks.w AND degree > k) ON true
  LEFT JOIN LATERAL (SELECT count(*) AS m FROM edges e JOIN deg x ON x.w = e.w AND x.node = e.i JOIN deg y ON y.w = e.w AND y.node = e.j WHERE e.w = ks.w AND x.degree > k AND y.degree > k) ON true)"""


@query("w:i k:i phi:f", f"{o.EDGES}, {RC}@@SELECT * FROM rc")
def rich_club(spark, sf):
    edges, n = tb.edges_of(spark, sf)
    return graph.rich_club(edges, n)


@query("w:i ratio:f", f"{o.EDGES}, {RC}@@SELECT a.w, avg(a.phi / b.phi) AS ratio FROM rc a JOIN rc b ON b.w = a.w - 1 AND a.k = b.k WHERE a.phi IS NOT NULL AND b.phi > 0 GROUP BY 1")
def rich_club_ratio(spark, sf):
    edges, n = tb.edges_of(spark, sf)
    phi = graph.rich_club(edges, n)
    return graph.rich_club_ratio(phi, phi.withColumn("w", F.col("w") + 1))


@query("w:i all_pairs:f on_edges:f", f"""{o.EDGES}, c AS (SELECT a.w, a.v AS x, b.v AS y, count(*) AS c FROM arcs a JOIN arcs b ON a.w = b.w AND a.u = b.u AND a.v < b.v GROUP BY ALL),
p AS (SELECT q.w, q.x, q.y, coalesce(c, 0) AS c, q.dx + q.dy AS s, (e.i IS NOT NULL)::INT AS a FROM (SELECT x.w, x.node AS x, y.node AS y, x.degree AS dx, y.degree AS dy FROM deg x JOIN deg y ON x.w = y.w AND x.node < y.node) q LEFT JOIN c USING (w, x, y) LEFT JOIN edges e ON e.w = q.w AND e.i = q.x AND e.j = q.y)
@@SELECT w, sum(coalesce(c / nullif(s - c - 2 * a, 0)::DOUBLE, 0)) / (SELECT n * (n - 1) / 2 FROM nn) AS all_pairs, avg(coalesce(c / nullif(s - 2 * a, 0)::DOUBLE, 0)) FILTER (a = 1) AS on_edges FROM p GROUP BY 1""")
def matching_index(spark, sf):
    edges, n = tb.edges_of(spark, sf)
    return graph.matching_index(edges, n)


BFS = """RECURSIVE_PLACE bfs AS (SELECT DISTINCT w, i AS s, i AS v, 0 AS d FROM num, (SELECT DISTINCT w FROM edges) UNION SELECT b.w, b.s, a.v, b.d + 1 FROM bfs b JOIN arcs a ON a.w = b.w AND a.u = b.v WHERE b.d < 12),
dist AS (SELECT w, s, v, min(d) AS d FROM bfs GROUP BY ALL), lab AS (SELECT w, s, min(v) AS c FROM dist GROUP BY ALL), sz AS (SELECT w, c, count(*) AS n FROM lab GROUP BY ALL),
big AS (SELECT w, arg_max(c, n * 1000 - c) AS c, max(n) AS m FROM sz GROUP BY 1)"""


@query("w:i path_harmonic:f path_lcc:f path_reachable:f lcc_frac:f n_components:i betweenness:f betweenness_lcc:f", "RECURSIVE " + f"""{o.EDGES}, {BFS.replace('RECURSIVE_PLACE ', '')}
@@SELECT w, n * (n - 1) / sum(1.0::DOUBLE / d) FILTER (d > 0) AS path_harmonic, avg(d) FILTER (d > 0 AND l.c = big.c) AS path_lcc, avg(d) FILTER (d > 0) AS path_reachable, any_value(m) / any_value(n)::DOUBLE AS lcc_frac,
  count(DISTINCT l.c) AS n_components, sum(d - 1) FILTER (d > 0) / 2.0 / any_value(n) AS betweenness, sum(d - 1) FILTER (d > 0 AND l.c = big.c) / 2.0 / any_value(m) AS betweenness_lcc
  FROM dist JOIN lab l USING (w, s) JOIN big USING (w), nn GROUP BY w, n""")
def path_measures(spark, sf):
    edges, n = tb.edges_of(spark, sf)
    return windows.path_measures(edges, n)


# ---------------------------------------------------------------- signals


@query("w:i stamp:d z:f", o.Z + "@@SELECT w, stamp, z FROM z")
def prior_only_z(spark, sf):
    return signals.trailing_z(tb.daily(spark, sf), 60)


@query("w:i label:i", o.Z + "@@SELECT w, label FROM lab")
def event_labels(spark, sf):
    return signals.event_mask(tb.daily(spark, sf), tb.events(spark), "sharp")


@query("tier:s share:f n_days:i", f"{o.DAILY}, {o.EV}@@SELECT tier, avg(f) AS share, sum(f) AS n_days FROM (SELECT v.tier, (EXISTS (SELECT 1 FROM ev WHERE stamp BETWEEN start AND fin AND (v.tier = 'any' OR ev.tier = v.tier)))::INT AS f FROM daily, (VALUES ('any'), ('sharp'), ('diffuse')) v(tier)) GROUP BY 1")
def event_coverage(spark, sf):
    return signals.event_coverage(tb.daily(spark, sf), tb.events(spark))


AUC = "(sum(r) FILTER (label = 1) - p * (p + 1) / 2.0) / nullif(p * (n - p), 0)::DOUBLE"


@query("auc:f n:i n_pos:i", f"{o.Z}@@SELECT (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0) AS auc, count(*) AS n, sum(label) AS n_pos FROM {o.ranked('lab', 'z')}")
def detector_auc(spark, sf):
    d = signals.event_mask(signals.trailing_z(tb.daily(spark, sf), 60), tb.events(spark), "sharp")
    return signals.auc(d)


@query("auc_up:f auc_down:f best:f", f"{o.Z}, a AS (SELECT (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0) AS a FROM {o.ranked('lab', 'z')})@@SELECT a AS auc_up, 1 - a AS auc_down, greatest(a, 1 - a) AS best FROM a")
def detector_both_signs(spark, sf):
    d = signals.event_mask(signals.trailing_z(tb.daily(spark, sf), 60), tb.events(spark), "sharp")
    up = signals.auc(d).select(F.col("auc").alias("auc_up"))
    down = signals.auc(d.withColumn("z", -F.col("z"))).select(F.col("auc").alias("auc_down"))
    return up.crossJoin(down).withColumn("best", F.greatest("auc_up", "auc_down"))


@query("best_f1:f precision:f recall:f", f"""{o.Z}, c AS (SELECT z, sum(label) OVER (ORDER BY z DESC) AS tp, count(*) OVER (ORDER BY z DESC) AS k, sum(label) OVER () AS pos FROM lab WHERE z IS NOT NULL)
@@SELECT 2.0 * tp / (k + pos) AS best_f1, tp / k::DOUBLE AS precision, tp / pos::DOUBLE AS recall FROM c WHERE pos > 0 ORDER BY round(2.0 * tp / (k + pos), 12) DESC, z DESC LIMIT 1""")
def detector_best_f1(spark, sf):
    d = signals.event_mask(signals.trailing_z(tb.daily(spark, sf), 60), tb.events(spark), "sharp")
    return signals.best_f1(d)


@query("name:s pos:i pre:f at_onset:f post:f below:f", f"""{o.DAILY}, {o.EV}, atp AS (SELECT name, arg_min(w, abs(date_diff('day', stamp, onset)) * 100000 - w) AS pos FROM daily, ev GROUP BY 1),
r AS (SELECT name, pos, w - pos AS k, x FROM atp JOIN daily ON w BETWEEN pos - 60 AND pos + 60 WHERE pos >= 60 AND pos + 60 <= (SELECT max(w) FROM daily)), b AS (SELECT name, avg(x) AS m, stddev_pop(x) AS s FROM r WHERE k < 0 GROUP BY 1),
z AS (SELECT r.*, (x - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS z FROM r JOIN b USING (name))
@@SELECT name, pos, avg(z) FILTER (k < 0) AS pre, avg(z) FILTER (abs(k) <= 2) AS at_onset, avg(z) FILTER (k > 0) AS post, avg((z < 0)::INT) FILTER (k >= 0) AS below FROM z GROUP BY ALL""")
def event_study(spark, sf):
    return signals.event_study(tb.daily(spark, sf), tb.events(spark))


@query("name:s stamp:d", f"{o.DAILY}, {o.EV}@@SELECT name, arg_min(stamp, abs(date_diff('day', stamp, onset)) * 100000 - w) AS stamp FROM daily, ev GROUP BY 1")
def nearest_date(spark, sf):
    gap = F.abs(F.datediff("stamp", "onset"))
    return tb.daily(spark, sf).crossJoin(F.broadcast(tb.events(spark))).groupBy("name").agg(F.min_by("stamp", F.struct(gap, -F.col("w"))).alias("stamp"))


GATE = f"{o.DAILY}, {o.EV}, g AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY x, w) <= 1500 THEN ret ELSE 0 END AS p FROM daily), cc AS (SELECT *, sum(p) OVER (ORDER BY w) AS cum FROM g)"


@query("final:f crash_pnl:f drawdown:f", f"""{GATE}@@SELECT sum(p) AS final, sum(CASE WHEN EXISTS (SELECT 1 FROM ev WHERE stamp BETWEEN start AND fin) THEN p ELSE 0 END) AS crash_pnl, least(0, min(cum - greatest(0, mx))) AS drawdown FROM (SELECT *, max(cum) OVER (ORDER BY w) AS mx FROM cc)""")
def gated_backtest(spark, sf):
    d = signals.event_mask(tb.daily(spark, sf), tb.events(spark))
    return signals.backtest(signals.lowest(d, 1500), crash=F.col("label") == 1)


@query("which:s threshold:f below:f above:f", f"""{o.DAILY}@@SELECT which, threshold, sum(CASE WHEN x < threshold THEN ret ELSE 0 END) AS below, sum(CASE WHEN x >= threshold THEN ret ELSE 0 END) AS above
  FROM daily, (SELECT 'fixed' AS which, 150000.0::DOUBLE AS threshold UNION ALL SELECT 'median', (SELECT median(x) FROM daily)) GROUP BY ALL""")
def threshold_gate_table(spark, sf):
    return signals.threshold_gates(tb.daily(spark, sf), [150_000.0])


@query("w:i trunc_sum:f trunc_min:f full_sum:f", f"""{o.DAILY}@@SELECT w, sum(ret) OVER f AS trunc_sum, min(ret) OVER f AS trunc_min, CASE WHEN count(ret) OVER f = 5 THEN sum(ret) OVER f END AS full_sum FROM daily WINDOW f AS (ORDER BY w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""")
def forward_returns(spark, sf):
    d = tb.daily(spark, sf)
    cut = signals.forward(d).select("w", F.col("fwd_sum").alias("trunc_sum"), F.col("fwd_min").alias("trunc_min"))
    return cut.join(signals.forward(d, full=True).select("w", F.col("fwd_sum").alias("full_sum")), "w")


@query("pearson:f spearman:f diff_corr:f gate_agreement:f jaccard:f", f"""{o.DAILY}, ab AS (SELECT w, x AS a, c AS b FROM daily), n AS (SELECT floor(0.7::DOUBLE * count(*)) AS n FROM ab), ra AS {o.ranked('ab', 'a')}, rb AS {o.ranked('ab', 'b')},
g AS (SELECT w, a, b, row_number() OVER (ORDER BY a, w) <= (SELECT n FROM n) AS ga, row_number() OVER (ORDER BY b, w) <= (SELECT n FROM n) AS gb, a - lag(a) OVER (ORDER BY w) AS da, b - lag(b) OVER (ORDER BY w) AS db FROM ab)
@@SELECT corr(g.a, g.b) AS pearson, corr(ra.r, rb.r) AS spearman, corr(da, db) AS diff_corr, avg((ga = gb)::INT) AS gate_agreement, count(*) FILTER (ga AND gb) / count(*) FILTER (ga OR gb)::DOUBLE AS jaccard FROM g JOIN ra USING (w) JOIN rb USING (w)""")
def signal_agreement(spark, sf):
    return signals.agreement(tb.daily(spark, sf).select("w", F.col("x").alias("a"), F.col("c").alias("b")))


def _pairs(spark, sf):
    d = tb.daily(spark, sf)
    z = signals.trailing_z(d, 60).select("w", "stamp", F.col("z").alias("real"))
    y = signals.trailing_z(d.withColumn("x", F.col("v")), 60).select("w", F.col("z").alias("model"))
    return z.join(y, "w").withColumn("measure", F.lit("z"))


SCORE = f"{o.DAILY}, s AS (SELECT w, stamp, (x - avg(x) OVER p) / stddev_samp(x) OVER p AS r, (v - avg(v) OVER p) / stddev_samp(v) OVER p AS m, count(*) OVER p AS k FROM daily WINDOW p AS (ORDER BY w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)), sr AS (SELECT w, stamp, r AS real, m AS model FROM s WHERE k >= 30)"


@query("measure:s era:s n:i chi2:f nmse:f rho:f n_eff:i rho_eff:f", f"""{SCORE}, e AS (SELECT *, CASE WHEN year(stamp) < 1998 THEN 'pre' ELSE 'post' END AS era FROM sr UNION ALL SELECT *, 'all' FROM sr)
@@SELECT 'z' AS measure, era, count(*) AS n, avg((real - model) ** 2) AS chi2, avg((real - model) ** 2) / var_pop(real) AS nmse, corr(real, model) AS rho, count(*) FILTER (w % 12 = 0) AS n_eff, corr(real, model) FILTER (w % 12 = 0) AS rho_eff FROM e GROUP BY era""")
def score_table(spark, sf):
    return signals.scores(_pairs(spark, sf), 1998, 12)


@query("ab:f ac:f bc:f partial:f r2:f", f"""{o.DAILY}, c AS (SELECT corr(x, v) AS ab, corr(x, c) AS ac, corr(v, c) AS bc FROM daily)
@@SELECT ab, ac, bc, (ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)) AS partial, (ab * ab + ac * ac - 2 * ab * ac * bc) / (1 - bc * bc) AS r2 FROM c""")
def partial_correlation(spark, sf):
    return signals.partial_correlation(tb.daily(spark, sf).select(F.col("x").alias("a"), F.col("v").alias("b"), F.col("c").alias("c")))


# ---------------------------------------------------------------- resampling


BOOTS, GATES, BLOCK, INVEST = 1000, 20_000, 50, 1500


@query("rho:f low:f high:f", f"""{SCORE}, q AS (SELECT row_number() OVER (ORDER BY w) - 1 AS w, real, model FROM sr), nq AS (SELECT count(*) AS n FROM q), dr AS (SELECT b, k, {lcg_sql('1', 'b', 'k')} AS u FROM range({BOOTS}) x(b), (SELECT unnest(range(CAST(ceil(n / {BLOCK}.0) AS BIGINT))) AS k FROM nq) y),
pk AS (SELECT b, floor(u * (n - {BLOCK} + 1))::INT + off AS w FROM dr, nq, range({BLOCK}) z(off) WHERE k * {BLOCK} + off < n), per AS (SELECT b, corr(real, model) AS r FROM pk JOIN q USING (w) GROUP BY 1)
@@SELECT (SELECT corr(real, model) FROM q) AS rho, quantile_cont(r, 0.025) AS low, quantile_cont(r, 0.975) AS high FROM per""")
def block_bootstrap(spark, sf):
    rows = _pairs(spark, sf).where("real IS NOT NULL").select((F.row_number().over(Window.orderBy("w")) - 1).alias("w"), "real", "model")
    rows = materialised(rows, "pairs")
    return signals.block_bootstrap(rows, rows.count(), BLOCK, BOOTS, 1)


@query("actual:f null_mean:f p:f", f"""{o.DAILY}, nd AS (SELECT count(*) AS n FROM daily), t AS (SELECT s.w AS s, (d.w + s.w) % n AS w, d.x FROM daily d, daily s, nd), g AS (SELECT s, w FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY x, w) AS q FROM t) WHERE q <= {INVEST}),
v AS (SELECT s, sum(ret) AS v FROM g JOIN daily USING (w) GROUP BY 1)@@SELECT any_value(a) AS actual, avg(v) AS null_mean, avg((round(v, 9) >= round(a, 9))::INT) AS p FROM v, (SELECT v AS a FROM v WHERE s = 0) WHERE s > 0""")
def circular_shift_null(spark, sf):
    return signals.circular_shift_null(tb.daily(spark, sf).select("w", "x", "ret"), INVEST)


@query("null_mean:f null_sd:f p:f")
def random_gate_null(spark, sf):
    """20,000 draws of 1,500 days: too slow as SQL; tests hold it against a sort of every draw."""
    return signals.random_gate_null(tb.daily(spark, sf).select("w", "x", "ret"), INVEST, GATES, 3)


@query("start:i auc:f", f"""{o.Z}, rk AS {o.ranked('z', 'z')}, nn AS (SELECT count(*) AS n FROM rk), st AS (SELECT w AS q FROM daily WHERE w <= (SELECT max(w) FROM daily) - 19), sl AS (SELECT g.q AS start, sum(r) AS sr, count(*) AS p FROM rk, st g WHERE w BETWEEN g.q AND g.q + 19 GROUP BY 1)
@@SELECT g.q AS start, (sr - p * (p + 1) / 2.0) / nullif(p * (n - p), 0) AS auc FROM st g LEFT JOIN sl ON sl.start = g.q, nn""")
def sliding_event_null(spark, sf):
    return signals.sliding_event_null(signals.trailing_z(tb.daily(spark, sf), 60), 20)


@query("auc_a:f auc_b:f d_auc:f low:f high:f", f"""{o.Z}, hd AS (SELECT w, label, x AS x1, c AS x2, row_number() OVER (PARTITION BY label ORDER BY w) - 1 AS k FROM lab), sz AS (SELECT label, count(*) AS n FROM hd GROUP BY 1),
pk AS (SELECT b, label, floor({lcg_sql('5', 'b', 'k', 'label')} * n)::INT AS k FROM hd JOIN sz USING (label), range({BOOTS}) r(b)), rw AS (SELECT b, label, x1, x2 FROM pk JOIN hd USING (label, k)),
a1 AS (SELECT b, (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS v FROM {o.ranked('rw', 'x1', 'b')} GROUP BY 1),
a2 AS (SELECT b, (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS v FROM {o.ranked('rw', 'x2', 'b')} GROUP BY 1)
@@SELECT avg(a1.v) AS auc_a, avg(a2.v) AS auc_b, avg(a1.v - a2.v) AS d_auc, quantile_cont(a1.v - a2.v, 0.025) AS low, quantile_cont(a1.v - a2.v, 0.975) AS high FROM a1 JOIN a2 USING (b)""")
def stratified_bootstrap(spark, sf):
    """1,000 draws, so that SQL can follow; the operator takes any number."""
    d = signals.event_mask(tb.daily(spark, sf), tb.events(spark), "sharp").select("w", "label", F.col("x").alias("x1"), F.col("c").alias("x2"))
    return signals.stratified_bootstrap(d, BOOTS, 5)


# ---------------------------------------------------------------- spectra


@query("w:i dbar:f two_m:f frob2:f trace_gap:f", f"""{o.EDGES}, dg AS (SELECT q.w, q.i, coalesce(s, 0) AS d FROM (SELECT w, i FROM num, (SELECT DISTINCT w FROM edges)) q LEFT JOIN (SELECT w, u AS i, sum(rho) AS s FROM (SELECT w, i AS u, rho FROM edges UNION ALL SELECT w, j, rho FROM edges) GROUP BY ALL) USING (w, i)),
tm AS (SELECT w, sum(d) AS t, avg(d) AS dbar, sum(d * d) AS dd FROM dg GROUP BY 1)
@@SELECT w, dbar, t AS two_m, (SELECT sum(2 * rho * rho) FROM edges e WHERE e.w = tm.w) - 2 * (SELECT sum(2 * rho * x.d * y.d) FROM edges e JOIN dg x ON x.w = e.w AND x.i = e.i JOIN dg y ON y.w = e.w AND y.i = e.j WHERE e.w = tm.w) / t + dd * dd / (t * t) AS frob2, -dd / t AS trace_gap FROM tm""")
def spectral_identities(spark, sf):
    edges, n = tb.edges_of(spark, sf)
    return windows.spectra(edges, n).withColumn("trace_gap", F.col("trace_pos") + F.col("trace_neg"))


@query("w:i " + " ".join(f"{m}:f" for m in windows.MENU))
def spectral_menu(spark, sf):
    edges, n = tb.edges_of(spark, sf)
    return windows.spectra(edges, n)


@query("w:i top_share:f n_above_mp:f corr_entropy:f")
def correlation_spectra(spark, sf):
    rets = tb.returns_of(spark, sf)
    return windows.correlation_spectra(network.window_correlation(rets, DELTA_T), rets.select("entity").distinct().count(), DELTA_T)


@query("n:i t:i low:f high:f", f"{o.CORR}@@SELECT n, {DELTA_T} AS t, pow(1 - sqrt(n / {DELTA_T}::DOUBLE), 2) AS low, pow(1 + sqrt(n / {DELTA_T}::DOUBLE), 2) AS high FROM nn")
def marchenko_pastur(spark, sf):
    n = tb.returns_of(spark, sf).select("entity").distinct().count()
    return spark.createDataFrame([(n, DELTA_T, *kernels.marchenko_pastur(n, DELTA_T))], "n long, t long, low double, high double")


# ---------------------------------------------------------------- kernels without an oracle

#: Seeds of a partition, replicates of a null model, restarts of a segmentation.
SEEDS, REPLICATES, RESTARTS = 10, 10, 20


@query("w:i seed:i node:i comm:i q:f")
def louvain_partitions(spark, sf):
    edges, n = tb.edges_of(spark, sf)
    return windows.louvain_partitions(edges, n, SEEDS)


@query("w:i family:s replicate:i measure:s value:f")
def measure_ensemble(spark, sf):
    edges, n = tb.edges_of(spark, sf)
    return windows.measure_ensemble(edges, n, REPLICATES)


@query("w:i measure:s family:s mean:f sd:f")
def measure_ensemble_summary(spark, sf):
    edges, n = tb.edges_of(spark, sf)
    return windows.ensemble_summary(windows.measure_ensemble(edges, n, REPLICATES))


@query("w:i replicate:i q_planted:f q_config:f n_block:i n_config:i same_degrees:b")
def null_models(spark, sf):
    edges, n = tb.edges_of(spark, sf)
    return windows.null_models(edges, n, REPLICATES)


@query("w:i replicate:i q_planted:f q_config:f n_block:i n_config:i same_degrees:b")
def null_models_stub(spark, sf):
    edges, n = tb.edges_of(spark, sf)
    return windows.null_models(edges, n, REPLICATES, "stub")


@query("series:s t:i i:i j:i weight:f lam2:f rank:i")
def laplacian_rolling(spark, sf):
    """One series for each fifth of the brands: sequential inside, parallel outside."""
    rets = network.numbered(tb.returns_of(spark, sf)).withColumn("series", (F.col("i") % 5).cast("string"))
    return windows.laplacian_series(rets)


@query("series:s t:i label:i cost:f")
def segment_series(spark, sf):
    """Four numbers a day of the daily series, cut into two kinds of stretches."""
    d = tb.daily(spark, sf)
    z = [signals.trailing_z(d.withColumn("x", F.col(c)), 60).select("w", F.coalesce("z", F.lit(0.0)).alias(c)) for c in ("x", "c", "v")]
    rows = z[0].join(z[1], "w").join(z[2], "w")
    return windows.segment(rows.select(F.lit("orders").alias("series"), F.col("w").alias("t"), F.array("x", "c", "v").alias("x")), 2, 3, 2, 0.1, 30.0, RESTARTS)
