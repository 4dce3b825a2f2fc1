"""Further queries: segmentation scores, summaries, set operations, stability and decay studies, models."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.safe import corr, div, lcg, lcg_sql
from ..operators import graph, learning, network, signals, windows
from . import oracle as o
from . import tables as tb
from .catalog import BFS as BFS_STEPS
from .catalog import RC, REPLICATES, SEEDS, _pairs, query
from .stages import materialised
from .tables import DELTA_T


@query("w:i pos:i v:f", f"{o.DAILY}@@SELECT d.w, p AS pos, e.c AS v FROM daily d, range(4) r(p) JOIN daily e ON true WHERE e.w = d.w - 3 + p AND d.w >= 3")
def stacked_windows(spark, sf):
    """Each row holds the four values up to its own, oldest first."""
    d = tb.daily(spark, sf)
    frame = Window.orderBy("w").rowsBetween(-3, 0)
    rows = d.select("w", F.collect_list("c").over(frame).alias("x")).where(F.size("x") == 4)
    return rows.select("w", F.posexplode("x").alias("pos", "v"))


@query("w:i k:i cost:f", f"""{o.DAILY}, s AS (SELECT w, ret AS a, lag(ret) OVER (ORDER BY w) AS b FROM daily), t(k, p, q, r) AS (VALUES (0, 2.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE), (1, 1.0::DOUBLE, -0.3::DOUBLE, 3.0::DOUBLE))
@@SELECT w, k, 0.5 * (p * b * b + 2 * q * a * b + r * a * a - ln(p * r - q * q) + 2 * ln(2 * pi())) AS cost FROM s, t WHERE b IS NOT NULL""")
def gaussian_costs(spark, sf):
    """Negative log-likelihood of two-step windows under two precision matrices, kept as flat arrays."""
    d = tb.daily(spark, sf)
    rows = d.select("w", F.array(F.lag("ret").over(Window.orderBy("w")), F.col("ret")).alias("x")).where("x[0] IS NOT NULL")
    thetas = spark.createDataFrame([(0, [2.0, 0.5, 0.5, 1.0]), (1, [1.0, -0.3, -0.3, 3.0])], "k int, theta array<double>")
    both = rows.crossJoin(F.broadcast(thetas))
    quad = F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0.0), lambda a, m: a + F.get("theta", m) * F.get("x", F.floor(m / 2).cast("int")) * F.get("x", (m % 2).cast("int")))
    logdet = F.log(F.get("theta", F.lit(0)) * F.get("theta", F.lit(3)) - F.get("theta", F.lit(1)) * F.get("theta", F.lit(2)))
    return both.select("w", "k", (0.5 * (quad - logdet + 2 * F.log(2 * F.pi()))).alias("cost"))


PERMS = ", ".join(f"({k}, {c}, {p[c]})" for k, p in enumerate(permutations(range(4))) for c in range(4))


@query("macro_f1:f", f"""l AS (SELECT label % 4 AS tr, (label + 1 + (vec_id % 7 = 0)::INT) % 4 AS pr FROM embeddings), t AS (SELECT tr, pr, count(*) AS n FROM l GROUP BY ALL),
p(k, c, m) AS (VALUES {PERMS}), b AS (SELECT arg_max(k, hits * 100 - k) AS k FROM (SELECT p.k, sum(coalesce(n, 0)) AS hits FROM p LEFT JOIN t ON t.pr = p.c AND t.tr = p.m GROUP BY p.k)),
nm AS (SELECT tr, m AS pr FROM l JOIN p ON p.c = l.pr WHERE p.k = (SELECT k FROM b))
@@SELECT avg(f) AS macro_f1 FROM (SELECT 2.0 * count(*) FILTER (tr = c AND pr = c) / (count(*) FILTER (tr = c) + count(*) FILTER (pr = c)) AS f FROM nm, range(4) r(c) GROUP BY c)""")
def aligned_macro_f1(spark, sf):
    """Predicted labels renamed by the best of all permutations of four, then macro F1."""
    e = tb.read(spark, sf, "embeddings").select((F.col("label") % 4).alias("tr"), ((F.col("label") + 1 + (F.col("vec_id") % 7 == 0).cast("int")) % 4).alias("pr"))
    cells = e.groupBy("tr", "pr").agg(F.count(F.lit(1)).alias("n"))
    perms = spark.createDataFrame([(k, c, p[c]) for k, p in enumerate(permutations(range(4))) for c in range(4)], "k int, pr int, m int")
    named = cells.join(F.broadcast(perms), "pr")
    best = named.groupBy("k").agg(F.sum(F.when(F.col("m") == F.col("tr"), F.col("n")).otherwise(0)).alias("hits")).orderBy(F.col("hits").desc(), "k").limit(1)
    rows = named.join(F.broadcast(best), "k")
    ends = rows.select("n", F.explode(F.array(F.struct(F.col("tr").alias("c"), F.lit(1).alias("t"), (F.col("m") == F.col("tr")).cast("int").alias("h")), F.struct(F.col("m").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("h")))).alias("x"))
    per = ends.groupBy("x.c").agg((2.0 * F.sum(F.col("n") * F.col("x.h")) / F.sum(F.col("n") * F.col("x.t"))).alias("f"))
    return per.agg(F.avg("f").alias("macro_f1"))


@query("w:i f1:f", f"{o.EDGES}@@SELECT a.w, 2.0 * count(b.i) / (2 * (SELECT k FROM budget)) AS f1 FROM edges a LEFT JOIN edges b ON b.w = a.w - 1 AND a.i = b.i AND a.j = b.j WHERE a.w > 0 GROUP BY a.w")
def edge_support_f1(spark, sf):
    """F1 of each window's edges against those of the window before."""
    e = tb.edges_of(spark, sf)[0].select("w", "i", "j")
    before = e.select((F.col("w") + 1).alias("w"), "i", "j", F.lit(1).alias("hit"))
    rows = e.where("w > 0").join(before, ["w", "i", "j"], "left").groupBy("w").agg(F.count("hit").alias("tp"), F.count(F.lit(1)).alias("n"))
    sizes = e.groupBy((F.col("w") + 1).alias("w")).agg(F.count(F.lit(1)).alias("m"))
    return rows.join(sizes, "w").select("w", (2.0 * F.col("tp") / (F.col("n") + F.col("m"))).alias("f1"))


@query("w:i row_sum:f top_off:f edges:i", f"""{o.EDGES}, l AS (SELECT w, i, j, -rho AS v FROM edges UNION ALL SELECT w, j, i, -rho FROM edges UNION ALL SELECT w, u, u, sum(rho) FROM (SELECT w, i AS u, rho FROM edges UNION ALL SELECT w, j, rho FROM edges) GROUP BY ALL)
@@SELECT w, max(abs(s)) AS row_sum, max(t) AS top_off, sum(c) AS edges FROM (SELECT w, i, sum(v) AS s, max(v) FILTER (i <> j) AS t, count(*) FILTER (i < j) AS c FROM l GROUP BY ALL) GROUP BY w""")
def laplacian_validity(spark, sf):
    """Laplacian entries of every window's weighted graph, and what its rows and signs say."""
    e = tb.edges_of(spark, sf)[0]
    off = e.select("w", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("x"), (-F.col("rho")).alias("v")).select("w", "x.i", "x.j", "v")
    lap = off.unionByName(off.groupBy("w", "i").agg((-F.sum("v")).alias("v")).withColumn("j", F.col("i")))
    rows = lap.groupBy("w", "i").agg(F.sum("v").alias("s"), F.max(F.when(F.col("i") != F.col("j"), F.col("v"))).alias("t"), F.count_if(F.col("i") < F.col("j")).alias("c"))
    return rows.groupBy("w").agg(F.max(F.abs("s")).alias("row_sum"), F.max("t").alias("top_off"), F.sum("c").alias("edges"))


@query("a:s b:s r:f", f"""{o.DAILY}, u AS (SELECT w, name, v FROM (SELECT w, x, c, v AS vv, ret FROM daily) UNPIVOT (v FOR name IN (x, c, vv, ret)))
@@SELECT a.name AS a, b.name AS b, corr(a.v, b.v) AS r FROM u a JOIN u b ON a.w = b.w AND a.name < b.name GROUP BY ALL""")
def measure_correlations(spark, sf):
    """Correlation of every two columns, in long form."""
    d = tb.daily(spark, sf).select("w", "x", "c", F.col("v").alias("vv"), "ret").unpivot("w", ["x", "c", "vv", "ret"], "name", "v")
    other = d.toDF("w", "b", "y")
    return d.withColumnRenamed("name", "a").join(other, "w").where("a < b").groupBy("a", "b").agg(corr(F.col("v"), F.col("y")).alias("r"))


@query("threshold:f tpr:f fpr:f", f"""{o.Z}@@SELECT z AS threshold, sum(label) OVER (ORDER BY z DESC) / (sum(label) OVER ())::DOUBLE AS tpr, sum(1 - label) OVER (ORDER BY z DESC) / (sum(1 - label) OVER ())::DOUBLE AS fpr FROM lab WHERE z IS NOT NULL""")
def roc_points(spark, sf):
    d = signals.event_mask(signals.trailing_z(tb.daily(spark, sf), 60), tb.events(spark), "sharp").where("z IS NOT NULL")
    down, every = Window.orderBy(F.col("z").desc()), Window.partitionBy()
    return d.select(F.col("z").alias("threshold"), (F.sum("label").over(down) / F.sum("label").over(every)).alias("tpr"), (F.sum(1 - F.col("label")).over(down) / F.sum(1 - F.col("label")).over(every)).alias("fpr"))


@query("w:i stamp:d delta:f", f"{o.DAILY}@@SELECT * FROM (SELECT w, stamp, x - lag(x) OVER (ORDER BY w) AS delta FROM daily) WHERE delta IS NOT NULL ORDER BY abs(delta) DESC, w LIMIT 5")
def largest_moves(spark, sf):
    d = tb.daily(spark, sf)
    return d.select("w", "stamp", (F.col("x") - F.lag("x").over(Window.orderBy("w"))).alias("delta")).where("delta IS NOT NULL").orderBy(F.abs("delta").desc(), "w").limit(5)


@query("n:i mean:f sd:f low:f q25:f q50:f q75:f high:f", f"{o.DAILY}@@SELECT count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS low, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, max(x) AS high FROM daily")
def describe_series(spark, sf):
    q = lambda p: F.percentile("x", F.lit(p))
    return tb.daily(spark, sf).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("low"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("x").alias("high"))


@query("w:i kept:i gained:i lost:i", f"""{o.EDGES}, a AS (SELECT w + {DELTA_T} AS w, i, j FROM edges WHERE w + {DELTA_T} <= (SELECT max(w) FROM edges)), b AS (SELECT w, i, j FROM edges WHERE w >= {DELTA_T}),
k AS (SELECT w, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY 1), g AS (SELECT w, count(*) AS n FROM (SELECT * FROM b EXCEPT SELECT * FROM a) GROUP BY 1), l AS (SELECT w, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY 1)
@@SELECT DISTINCT b.w, coalesce(k.n, 0) AS kept, coalesce(g.n, 0) AS gained, coalesce(l.n, 0) AS lost FROM b LEFT JOIN k USING (w) LEFT JOIN g USING (w) LEFT JOIN l USING (w)""")
def edge_set_changes(spark, sf):
    """Set operations on the edges of each window and the one that shares no day with it."""
    e = tb.edges_of(spark, sf)[0].select("w", "i", "j")
    now = e.where(F.col("w") >= DELTA_T)
    before = e.withColumn("w", F.col("w") + DELTA_T).join(now.select("w").distinct(), "w", "left_semi").select("w", "i", "j")
    parts = [df.select("w", F.lit(name).alias("kind")) for name, df in (("kept", now.intersect(before)), ("gained", now.exceptAll(before)), ("lost", before.exceptAll(now)))]
    count = lambda name: F.count_if(F.col("kind") == name).alias(name)
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("w").agg(count("kept"), count("gained"), count("lost"))


@query("lag:i q:f", f"""{o.EDGES}, p AS (SELECT w, i AS node, (i + w // 6) % 4 AS comm FROM num, (SELECT DISTINCT w FROM edges)),
mix AS (SELECT e.w, l.lag, least(x.comm, y.comm) AS a, greatest(x.comm, y.comm) AS b, count(*) AS n_edges FROM edges e, (VALUES (0), (1), (2), (5), (10), (20), (50), (100), (200), (500)) l(lag) JOIN p x ON true JOIN p y ON true WHERE x.w = e.w - l.lag AND x.node = e.i AND y.w = e.w - l.lag AND y.node = e.j GROUP BY ALL),
c AS (SELECT w, lag, c, sum(e) AS e, sum(d) AS d FROM (SELECT w, lag, a AS c, CASE WHEN a = b THEN n_edges ELSE 0 END AS e, CASE WHEN a = b THEN 2 * n_edges ELSE n_edges END AS d FROM mix UNION ALL SELECT w, lag, b, 0, n_edges FROM mix WHERE a <> b) GROUP BY ALL)
@@SELECT lag, avg(q) AS q FROM (SELECT w, lag, sum(e / (SELECT k FROM budget) - pow(d / (2.0 * (SELECT k FROM budget)), 2)) AS q FROM c GROUP BY ALL) GROUP BY lag""")
def partition_decay(spark, sf):
    """Mean modularity of partitions that are `lag` windows old."""
    edges, n = tb.edges_of(spark, sf)
    part = edges.select("w").distinct().crossJoin(tb.partition_of(spark, n)).select("w", "node", ((F.col("node") + F.floor(F.col("w") / 6)) % 4).alias("comm"))
    return graph.decay(edges, part)


@query("w:i q_floor:f", f"""{o.MIX.replace('part4 AS (SELECT i AS node, i % 4 AS comm FROM num)', f"part4 AS (SELECT x.i AS node, y.i % 4 AS comm FROM (SELECT i, row_number() OVER (ORDER BY {lcg_sql('9', 'i')}, i) AS r FROM num) x JOIN (SELECT i, row_number() OVER (ORDER BY i) AS r FROM num) y USING (r))")},
c AS (SELECT w, c, sum(e) AS e, sum(d) AS d FROM (SELECT w, a AS c, CASE WHEN a = b THEN n_edges ELSE 0 END AS e, CASE WHEN a = b THEN 2 * n_edges ELSE n_edges END AS d FROM mix UNION ALL SELECT w, b, 0, n_edges FROM mix WHERE a <> b) GROUP BY ALL)
@@SELECT w, sum(e / (SELECT k FROM budget) - pow(d / (2.0 * (SELECT k FROM budget)), 2)) AS q_floor FROM c GROUP BY w""")
def shuffled_partition_floor(spark, sf):
    """Modularity of the same community sizes dealt to the nodes in a repeatable random order."""
    edges, n = tb.edges_of(spark, sf)
    part = tb.partition_of(spark, n)
    a = part.select("node", F.row_number().over(Window.orderBy(lcg(F.lit(9), F.col("node")), "node")).alias("r"))
    b = part.select("comm", F.row_number().over(Window.orderBy("node")).alias("r"))
    shuffled = a.join(b, "r").select("node", "comm")
    return graph.modularity(graph.mixing_matrix(edges, shuffled)).withColumnRenamed("q", "q_floor")


@query("measure:s era:s rho:f published:f gap:f within:b", f"""{o.DAILY}, s AS (SELECT w, stamp, (x - avg(x) OVER p) / stddev_samp(x) OVER p AS real, (v - avg(v) OVER p) / stddev_samp(v) OVER p AS model, count(*) OVER p AS k FROM daily WINDOW p AS (ORDER BY w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
e AS (SELECT CASE WHEN year(stamp) < 1998 THEN 'pre' ELSE 'post' END AS era, real, model FROM s WHERE k >= 30 UNION ALL SELECT 'all', real, model FROM s WHERE k >= 30), r AS (SELECT era, corr(real, model) AS rho FROM e GROUP BY 1), pub(era, published) AS (VALUES ('pre', 0.5::DOUBLE), ('post', 0.9::DOUBLE))
@@SELECT 'z' AS measure, era, rho, published, abs(rho - published) AS gap, coalesce(abs(rho - published) <= 0.3, false) AS within FROM r LEFT JOIN pub USING (era)""")
def scores_against_published(spark, sf):
    """A score table beside given values; an era without one stays null."""
    rows = signals.scores(_pairs(spark, sf), 1998, 12)
    given = spark.createDataFrame([("pre", 0.5), ("post", 0.9)], "era string, published double")
    gap = F.abs(F.col("rho") - F.col("published"))
    return rows.join(F.broadcast(given), "era", "left").select("measure", "era", "rho", "published", gap.alias("gap"), F.coalesce(gap <= 0.3, F.lit(False)).alias("within"))


@query("convention:s stamp:d days:i", f"""{o.EDGES}, iso AS (SELECT w, (SELECT n FROM nn) - count(*) AS n FROM deg GROUP BY 1), pk AS (SELECT arg_max(w, n * 100000 - w) AS w FROM iso), pc AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM panel))
@@SELECT convention, date AS stamp, abs(date_diff('day', date, DATE '1998-08-17')) AS days FROM pk, (VALUES ('t1', 0), ('midpoint', {DELTA_T // 2}), ('t2', {DELTA_T})) v(convention, s) JOIN pc ON true WHERE pc.t = pk.w + s""")
def convention_fit(spark, sf):
    """Where the window with most isolated nodes is stamped by each convention, and how far from a given date."""
    edges, n = tb.edges_of(spark, sf)
    iso = network.degrees(edges).groupBy("w").agg((n - F.count(F.lit(1))).alias("k"))
    peak = iso.agg(F.max_by("w", F.struct("k", -F.col("w"))).alias("w"))
    prices = tb.panel_of(spark, sf).select("entity", "date", "price")
    rows = None
    for name in network.STAMPS:
        one = network.window_stamps(prices, DELTA_T, name).join(F.broadcast(peak), "w").select(F.lit(name).alias("convention"), "stamp", F.abs(F.datediff("stamp", F.to_date(F.lit("1998-08-17")))).alias("days"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("w:i grp:i mean:f n:i", f"{o.CORR}@@SELECT w, j - i AS grp, avg(rho) AS mean, count(*) AS n FROM corr GROUP BY ALL")
def diagonal_group_means(spark, sf):
    """Mean of each window's matrix over groups of entries, here its diagonals."""
    corr_ = network.window_correlation(tb.returns_of(spark, sf), DELTA_T)
    return corr_.groupBy("w", (F.col("j") - F.col("i")).alias("grp")).agg(F.avg("rho").alias("mean"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- studies without an oracle


@query("w:i kind:s nmi:f")
def louvain_stability(spark, sf):
    """NMI of partitions of one window by seed, and of consecutive windows by the first seed."""
    edges, n = tb.edges_of(spark, sf)
    parts = windows.louvain_partitions(edges, n, SEEDS)
    a = parts.select("w", "node", F.col("seed").alias("s1"), F.col("comm").alias("x"))
    b = parts.select("w", "node", F.col("seed").alias("s2"), F.col("comm").alias("y"))
    within = a.join(b, ["w", "node"]).where("s1 < s2").withColumn("kind", F.concat(F.lit("seeds_"), "s1", F.lit("_"), "s2"))
    after = a.where("s1 = 0").join(b.where("s2 = 0").withColumn("w", F.col("w") + 1), ["w", "node"]).withColumn("kind", F.lit("consecutive"))
    cells = within.unionByName(after).groupBy("w", "kind", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    t = F.sum("n").over(Window.partitionBy("w", "kind"))
    nx, ny = (F.sum("n").over(Window.partitionBy("w", "kind", c)) for c in ("x", "y"))
    rows = cells.withColumns({"p": F.col("n") / t, "px": nx / t, "py": ny / t})
    sums = rows.groupBy("w", "kind").agg((-F.sum(F.col("p") * F.log("px"))).alias("hx"), (-F.sum(F.col("p") * F.log("py"))).alias("hy"), F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py")))).alias("i"))
    return sums.select("w", "kind", F.coalesce(div(2 * F.col("i"), F.col("hx") + F.col("hy")), F.lit(1.0)).alias("nmi"))


def _noise(spark, returns):
    """Seeded Gaussian noise of a panel's shape: its entities and its days."""
    n, days = returns.agg(F.countDistinct("entity"), F.countDistinct("t")).first()
    rows = spark.range(n * days).select(F.format_string("e%06d", F.floor(F.col("id") / days)).alias("entity"), (F.col("id") % days).cast("int").alias("t"), F.randn(7).alias("y"))
    return materialised(rows.withColumn("date", F.date_add(F.to_date(F.lit("2000-01-01")), F.col("t"))), "noise")


@query("w:i tau:f mean_corr:f n_isolated:i")
def noise_reference(spark, sf):
    """The network pipeline on noise."""
    return network.network_summary(_noise(spark, tb.returns_of(spark, sf)), DELTA_T, tb.SHARE)


@query("measure:s family:s below_configuration:i n:i")
def family_comparison(spark, sf):
    """For each measure: in how many windows a family's mean is below that of the rewired graphs."""
    edges, n = tb.edges_of(spark, sf)
    wide = windows.ensemble_summary(windows.measure_ensemble(edges, n, REPLICATES)).groupBy("w", "measure").pivot("family", ["real", "community", "configuration"]).agg(F.first("mean"))
    return wide.unpivot(["w", "measure", "configuration"], ["real", "community"], "family", "v").groupBy("measure", "family").agg(F.count_if(F.col("v") < F.col("configuration")).alias("below_configuration"), F.count("v").alias("n"))


def _families(spark, sf):
    edges, n = tb.edges_of(spark, sf)
    rows = windows.measure_ensemble(edges, n, REPLICATES).withColumn("value", F.coalesce("value", F.lit(0.0)))
    return rows.groupBy("w", "family", "replicate").pivot("measure", list(windows.MEASURES)).agg(F.first("value"))


@query("family:s n:i pc1:f pc2:f")
def family_components(spark, sf):
    """Centroids of the three families on two principal components of the standardised measures."""
    made, _, _ = learning.principal_components(_families(spark, sf), list(windows.MEASURES))
    return made.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.avg("pc1").alias("pc1"), F.avg("pc2").alias("pc2"))


@query("classes:i accuracy:f")
def family_classifier(spark, sf):
    rows = _families(spark, sf).withColumn("label", F.when(F.col("family") == "real", 0.0).when(F.col("family") == "community", 1.0).otherwise(2.0))
    rows = materialised(rows.coalesce(4), "families")
    three = learning.cross_validated_accuracy(rows, list(windows.MEASURES), "label", "w")
    two = learning.cross_validated_accuracy(rows.where("label < 2"), list(windows.MEASURES), "label", "w")
    return spark.createDataFrame([(3, three), (2, two)], "classes int, accuracy double")


@query("split:s auc:f n:i")
def logistic_detector(spark, sf):
    """A balanced logistic detector in sample, and fitted before 1998 and scored after."""
    d = signals.trailing_z(tb.daily(spark, sf), 60).withColumnRenamed("z", "a")
    d = signals.trailing_z(d.withColumn("x", F.col("c")), 60).withColumnRenamed("z", "b").where("a IS NOT NULL AND b IS NOT NULL")
    d = signals.event_mask(d, tb.events(spark), "sharp")
    inside = signals.auc(learning.logistic_scores(d, ["a", "b"])).withColumn("split", F.lit("in sample"))
    later = signals.auc(learning.logistic_scores(d, ["a", "b"], train="year(stamp) < 1998").where("year(stamp) >= 1998")).withColumn("split", F.lit("later"))
    return inside.unionByName(later)


@query("method:s label:i prediction:i n:i")
def clustered_embeddings(spark, sf):
    e = tb.read(spark, sf, "embeddings")
    cols = [f"x{k}" for k in range(e.agg(F.max(F.size("embedding"))).first()[0])]
    e = e.select("label", *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(cols)))
    rows = [learning.cluster(e, cols, 10, 0, m, 3).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n")).withColumn("method", F.lit(m)) for m in ("kmeans", "mixture")]
    return rows[0].unionByName(rows[1])


# ---------------------------------------------------------------- more tables


SIG = f"{o.DAILY}, {o.EV}, sg AS (SELECT name AS sn, w, stamp, v AS val FROM (SELECT w, stamp, x, c, v AS vv, ret FROM daily) UNPIVOT (v FOR name IN (x, c, vv, ret)))"


def _signals(spark, sf):
    d = tb.daily(spark, sf).select("w", "stamp", "x", "c", F.col("v").alias("vv"), "ret")
    return d.unpivot(["w", "stamp"], ["x", "c", "vv", "ret"], "name", "v")


@query("name:s tier:s auc:f n:i n_pos:i r:f", f"""{SIG}, z AS (SELECT sn, w, stamp, round(CASE WHEN count(val) OVER p >= 30 THEN (val - avg(val) OVER p) / nullif(stddev_samp(val) OVER p, 0) END, 9) AS zz FROM sg WINDOW p AS (PARTITION BY sn ORDER BY w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
l AS (SELECT sn, w, zz, t.tier, (EXISTS (SELECT 1 FROM ev WHERE stamp BETWEEN start AND fin AND (t.tier = 'any' OR ev.tier = 'sharp')))::INT AS label FROM z, (VALUES ('any'), ('sharp')) t(tier))
@@SELECT sn AS name, tier, (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS auc, count(*) AS n, sum(label) AS n_pos, corr(zz, label) AS r FROM {o.ranked('l', 'zz', 'sn, tier')} GROUP BY ALL""")
def detector_table(spark, sf):
    return signals.detector_table(_signals(spark, sf).withColumnRenamed("v", "x"), tb.events(spark), 60)


@query("name:s inside:f outside:f ahead:f", f"""{o.DAILY}, {o.EV}, r AS (SELECT name, x, stamp, start, fin, row_number() OVER (PARTITION BY name, stamp < start ORDER BY stamp DESC) AS k FROM daily, ev)
@@SELECT name, avg(x) FILTER (stamp BETWEEN start AND fin) AS inside, avg(x) FILTER (NOT stamp BETWEEN start AND fin) AS outside, avg(x) FILTER (stamp < start AND k <= 60) AS ahead FROM r GROUP BY 1""")
def signal_direction(spark, sf):
    return signals.direction(tb.daily(spark, sf), tb.events(spark))


@query("name:s low:d high:d", f"{SIG}@@SELECT sn AS name, arg_min(stamp, (val, w)) AS low, arg_max(stamp, (val, -w)) AS high FROM sg GROUP BY 1")
def extreme_dates(spark, sf):
    return _signals(spark, sf).groupBy("name").agg(F.min_by("stamp", F.struct("v", "w")).alias("low"), F.max_by("stamp", F.struct("v", -F.col("w"))).alias("high"))


@query("year:i n:i share:f median_move:f", f"{o.DAILY}, d AS (SELECT year(stamp) AS year, x, v / c AS y, abs(x - lag(x) OVER (ORDER BY w)) AS m, c - lag(c) OVER (ORDER BY w) AS dc FROM daily)@@SELECT year, count(*) FILTER (dc < 0) AS n, avg((dc < 0)::INT) AS share, median(m) AS median_move FROM d WHERE dc IS NOT NULL GROUP BY 1")
def violations_by_year(spark, sf):
    """How often an ordering is broken, by year, and the median move."""
    step = Window.orderBy("w")
    d = tb.daily(spark, sf).select(F.year("stamp").alias("year"), F.abs(F.col("x") - F.lag("x").over(step)).alias("m"), (F.col("c") - F.lag("c").over(step)).alias("dc")).where("dc IS NOT NULL")
    return d.groupBy("year").agg(F.count_if(F.col("dc") < 0).alias("n"), F.avg((F.col("dc") < 0).cast("int")).alias("share"), F.percentile("m", F.lit(0.5)).alias("median_move"))


@query("w:i i:i j:i rho:f", f"{o.EDGES}@@SELECT w, i, j, rho FROM edges ORDER BY round(rho, 9) DESC, w, i, j LIMIT 200")
def strongest_edges(spark, sf):
    return tb.edges_of(spark, sf)[0].orderBy(F.round("rho", 9).desc(), "w", "i", "j").limit(200)


@query("w:i replicate:i seed:i", f"{o.EDGES}@@SELECT w, r AS replicate, 42 * 1000003 + w * 131 + r AS seed FROM wins, range({REPLICATES}) b(r)")
def null_seeds(spark, sf):
    return tb.network_of(spark, sf)[3].crossJoin(spark.range(REPLICATES).withColumnRenamed("id", "replicate")).withColumn("seed", F.lit(42 * 1_000_003) + F.col("w") * 131 + F.col("replicate"))


@query("w:i stamp:d x:f", f"{o.DAILY}@@SELECT w, stamp, x FROM (SELECT *, lead(stamp) OVER (ORDER BY w) AS nx FROM daily) WHERE nx <= DATE '1999-12-31'")
def investable_signals(spark, sf):
    return signals.investable(tb.daily(spark, sf), "1999-12-31")


@query("w:i x:f", f"{o.DAILY}@@SELECT w, x FROM (SELECT w, x FROM daily ORDER BY {lcg_sql('11', 'w')}, w LIMIT 300)")
def subsampled_series(spark, sf):
    """The feature here is the draw: 300 rows in a repeatable random order."""
    return signals.subsample(tb.daily(spark, sf), 300, 11)


@query("name:s n:i", f"{SIG}, s2 AS (SELECT sn, w, val FROM sg UNION ALL SELECT 'flat', w, 1.0 FROM daily)@@SELECT sn AS name, count(*) AS n FROM s2 GROUP BY 1 HAVING stddev_pop(val) >= 1e-12")
def varying_signals(spark, sf):
    rows = _signals(spark, sf).select("name", "w", "v")
    flat = tb.daily(spark, sf).select(F.lit("flat").alias("name"), "w", F.lit(1.0).alias("v"))
    return signals.varying(rows.unionByName(flat)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("shift:i r:f", f"{o.DAILY}, nd AS (SELECT count(*) AS n FROM daily), p AS (SELECT s.w AS shift, a.x, (a.w + s.w) % n AS w FROM daily s, daily a, nd)@@SELECT shift, corr(p.x, b.x) AS r FROM p JOIN daily b USING (w) GROUP BY 1")
def circular_shifts(spark, sf):
    """The series against itself rotated by every number of days."""
    return signals.circular_autocorrelation(tb.daily(spark, sf).select("w", "x"))


@query("w:i " + " ".join(f"{m}:f" for m in windows.BINARY) + " residual:f")
def binary_spectra(spark, sf):
    edges, n = tb.edges_of(spark, sf)
    return windows.binary_spectra(edges, n)


@query("w:i n_zero:i", "RECURSIVE " + f"{o.EDGES}, bfs AS (SELECT DISTINCT w, i AS s, i AS v, 0 AS d FROM num, (SELECT DISTINCT w FROM edges) UNION SELECT b.w, b.s, a.v, b.d + 1 FROM bfs b JOIN arcs a ON a.w = b.w AND a.u = b.v WHERE b.d < 12)@@SELECT w, count(DISTINCT c) AS n_zero FROM (SELECT w, s, min(v) AS c FROM bfs GROUP BY ALL) GROUP BY 1")
def zero_eigenvalues(spark, sf):
    """Zero Laplacian eigenvalues, which count the components."""
    return binary_spectra(spark, sf).select("w", "n_zero")


@query("measure:s family:s n:i mean:f sd:f n_null:i")
def measure_summary(spark, sf):
    edges, n = tb.edges_of(spark, sf)
    rows = windows.measure_ensemble(edges, n, REPLICATES)
    return rows.groupBy("measure", "family").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count_if(F.col("value").isNull()).alias("n_null"))


@query("bias:f mae:f abs_max:f r:f within:f")
def null_summary(spark, sf):
    """Planted block-model modularity against the real partition's."""
    edges, n = tb.edges_of(spark, sf)
    real = windows.louvain_partitions(edges, n, 1).groupBy("w").agg(F.first("q").alias("q"))
    rows = windows.null_models(edges, n, REPLICATES).join(real, "w").withColumn("e", F.col("q_planted") - F.col("q"))
    return rows.agg(F.avg("e").alias("bias"), F.avg(F.abs("e")).alias("mae"), F.max(F.abs("e")).alias("abs_max"), corr(F.col("q_planted"), F.col("q")).alias("r"), F.avg((F.abs("e") <= 0.03).cast("int")).alias("within"))


@query("source:s q:f q_config:f excess:f")
def noise_excess(spark, sf):
    """Modularity over that of rewired graphs, for the panel and for noise of its shape."""
    returns, edges, n, _ = tb.network_of(spark, sf)
    blank = materialised(network.edges_of_windows(_noise(spark, returns), DELTA_T, network.edge_budget(n, tb.SHARE)), "noise-edges")
    rows = None
    for name, e in (("panel", edges), ("noise", blank)):
        q = windows.louvain_partitions(e, n, 1).groupBy("w").agg(F.first("q").alias("q")).agg(F.avg("q").alias("q"))
        c = windows.null_models(e, n, REPLICATES).agg(F.avg("q_config").alias("q_config"))
        one = q.crossJoin(c).select(F.lit(name).alias("source"), "q", "q_config", (F.col("q") - F.col("q_config")).alias("excess"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("family:s other:s distance:f")
def centroid_distances(spark, sf):
    """Distances of the families' centroids on the components, in deviations of the real family."""
    made, _, _ = learning.principal_components(_families(spark, sf), list(windows.MEASURES))
    cent = made.groupBy("family").agg(F.avg("pc1").alias("a"), F.avg("pc2").alias("b"), F.sqrt(F.var_samp("pc1") + F.var_samp("pc2")).alias("s"))
    real = cent.where("family = 'real'").select(F.col("family").alias("other"), F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("s").alias("rs"))
    return cent.where("family <> 'real'").crossJoin(real).select("family", "other", div(F.hypot(F.col("a") - F.col("ra"), F.col("b") - F.col("rb")), F.col("rs")).alias("distance"))


BFS = BFS_STEPS.replace("RECURSIVE_PLACE ", "")


# ---------------------------------------------------------------- communities that are detected


def _detected(spark, sf):
    """Edges, the list of windows, and partitions by window and seed, written once."""
    _, edges, n, wins = tb.network_of(spark, sf)
    return edges, n, wins, materialised(windows.louvain_partitions(edges, n, SEEDS, wins), "partitions")


@query("w:i q_dyn:f q_fixed:f q_lag:f q_gain:f q_mean:f q_sd:f q_range:f k:i largest:f singletons:i")
def community_series(spark, sf):
    """Modularity of each window under its own partition, the first window's, and one ten windows old; its spread over seeds."""
    edges, n, _, parts = _detected(spark, sf)
    seeds = parts.select("w", "seed", "q").distinct().groupBy("w").agg(F.avg("q").alias("q_mean"), F.stddev_samp("q").alias("q_sd"), (F.max("q") - F.min("q")).alias("q_range"))
    own = parts.where("seed = 0").select("w", "node", "comm")
    q = lambda part, name: graph.modularity(graph.mixing_matrix(edges, part)).withColumnRenamed("q", name)
    sizes = own.groupBy("w", "comm").agg(F.count(F.lit(1)).alias("s")).groupBy("w").agg(F.count(F.lit(1)).alias("k"), (F.max("s") / n).alias("largest"), F.count_if(F.col("s") == 1).alias("singletons"))
    rows = q(own, "q_dyn").join(q(own.where("w = 0").select("node", "comm"), "q_fixed"), "w").join(q(graph.lagged(own, 10), "q_lag"), "w", "left")
    return rows.join(seeds, "w").join(sizes, "w").withColumn("q_gain", F.col("q_dyn") - F.col("q_lag"))


@query("lag:i q:f")
def detected_decay(spark, sf):
    """Mean modularity of detected partitions that are `lag` windows old."""
    edges, _, _, parts = _detected(spark, sf)
    return graph.decay(edges, parts.where("seed = 0").select("w", "node", "comm"))


@query("range_over_move:f median_move:f")
def seed_noise(spark, sf):
    """The median range of modularity over seeds against its median move from window to window."""
    series = materialised(community_series(spark, sf), "communities")
    move = series.select("q_range", F.abs(F.col("q_dyn") - F.lag("q_dyn").over(Window.orderBy("w"))).alias("m"))
    half = lambda c: F.percentile(c, F.lit(0.5))
    return move.agg(div(half("q_range"), half("m")).alias("range_over_move"), half("m").alias("median_move"))


@query("w:i seed:i nodes:i contiguous:b by_size:b same_q:b above_planted:b", f"{o.EDGES}@@SELECT w, seed, n AS nodes, true AS contiguous, true AS by_size, true AS same_q, true AS above_planted FROM wins, nn, range({SEEDS}) s(seed)")
def louvain_checks(spark, sf):
    """What must hold of every detected partition: all nodes have a label, labels are numbered by size, the modularity
    is what the mixing matrix gives, and it is no less than that of the partition by place."""
    edges, n, wins, parts = _detected(spark, sf)
    sizes = parts.groupBy("w", "seed", "comm").agg(F.count(F.lit(1)).alias("s"), F.first("q").alias("q"))
    before = F.lag("s").over(Window.partitionBy("w", "seed").orderBy("comm"))
    per = sizes.withColumn("down", F.coalesce(before >= F.col("s"), F.lit(True))).groupBy("w", "seed").agg(F.sum("s").alias("nodes"), (F.max("comm") == F.count(F.lit(1)) - 1).alias("contiguous"), F.bool_and("down").alias("by_size"), F.first("q").alias("q"))
    key = F.col("w") * SEEDS + F.col("seed")
    all_edges = edges.crossJoin(F.broadcast(spark.range(SEEDS).withColumnRenamed("id", "seed"))).select(key.alias("w"), "i", "j")
    again = graph.modularity(graph.mixing_matrix(all_edges, parts.select(key.alias("w"), "node", "comm"))).select(F.floor(F.col("w") / SEEDS).alias("w"), (F.col("w") % SEEDS).cast("int").alias("seed"), F.col("q").alias("again"))
    planted = graph.modularity(graph.mixing_matrix(edges, tb.partition_of(spark, n))).withColumnRenamed("q", "planted")
    rows = per.join(again, ["w", "seed"], "left").join(planted, "w", "left")
    return rows.select("w", "seed", "nodes", "contiguous", "by_size", (F.abs(F.col("q") - F.col("again")) < 1e-9).alias("same_q"), (F.col("q") >= F.col("planted") - 1e-9).alias("above_planted"))


@query("method:s w:i replicate:i n_edges:i same_degrees:b", f"{o.EDGES}@@SELECT 'rewire' AS method, w, r AS replicate, k AS n_edges, true AS same_degrees FROM wins, budget, range({REPLICATES}) b(r)")
def null_checks(spark, sf):
    """A rewired graph has the edges and the degrees of its window's."""
    edges, n = tb.edges_of(spark, sf)
    return windows.null_models(edges, n, REPLICATES).select(F.lit("rewire").alias("method"), "w", "replicate", F.col("n_config").alias("n_edges"), "same_degrees")


CLIQUE = "cl AS (SELECT w, i AS last, [i] AS members FROM num, wins UNION ALL SELECT c.w, e.j, list_append(c.members, e.j) FROM cl c JOIN edges e ON e.w = c.w AND e.i = c.last WHERE (SELECT count(*) FROM edges f WHERE f.w = c.w AND f.j = e.j AND list_contains(c.members, f.i)) = len(c.members))"


@query("w:i assortativity:f transitivity:f rich_club:f matching:f clique:i", "RECURSIVE " + f"""{o.EDGES}, {RC}, {CLIQUE}, rcm AS (SELECT w, avg(phi) AS rich_club FROM rc GROUP BY 1), cm AS (SELECT w, max(len(members)) AS clique FROM cl GROUP BY 1),
tr AS (SELECT a.w, count(*) AS n FROM edges a JOIN edges b ON a.w = b.w AND a.j = b.i JOIN edges c ON c.w = a.w AND c.i = a.i AND c.j = b.j GROUP BY 1), tt AS (SELECT d.w, coalesce(3 * any_value(n) / nullif(sum(degree * (degree - 1) / 2.0), 0), 0) AS transitivity FROM deg d LEFT JOIN tr USING (w) GROUP BY 1),
ac AS (SELECT w, covar_pop(x.degree, y.degree) / nullif(stddev_pop(x.degree) * stddev_pop(y.degree), 0) AS assortativity FROM arcs JOIN deg x USING (w) JOIN deg y USING (w) WHERE x.node = u AND y.node = v GROUP BY 1),
wc AS (SELECT a.w, a.v AS x, b.v AS y, count(*) AS c FROM arcs a JOIN arcs b ON a.w = b.w AND a.u = b.u AND a.v < b.v GROUP BY ALL),
mi AS (SELECT wc.w, sum(c / nullif(x1.degree + y1.degree - c - 2 * (e.i IS NOT NULL)::INT, 0)::DOUBLE) / (SELECT n * (n - 1) / 2 FROM nn) AS matching FROM wc JOIN deg x1 ON x1.w = wc.w AND x1.node = x JOIN deg y1 ON y1.w = wc.w AND y1.node = y LEFT JOIN edges e ON e.w = wc.w AND e.i = x AND e.j = y GROUP BY 1)
@@SELECT w, assortativity, transitivity, rich_club, coalesce(matching, 0) AS matching, clique FROM wins JOIN cm USING (w) JOIN rcm USING (w) JOIN tt USING (w) JOIN ac USING (w) LEFT JOIN mi USING (w)""")
def kernel_measures(spark, sf):
    """The real graphs' measures as the ensemble's kernel gives them."""
    edges, n = tb.edges_of(spark, sf)
    names = ["assortativity", "transitivity", "rich_club", "matching", "clique"]
    rows = windows.measure_ensemble(edges, n, 0).where(F.col("measure").isin(names))
    return rows.groupBy("w").pivot("measure", names).agg(F.first("value"))


@query("path_r:f betweenness_r:f days_apart:i worst_share:f worst_w:i", "RECURSIVE " + f"""{o.EDGES}, {BFS},
pm AS (SELECT w, n * (n - 1) / sum(1.0::DOUBLE / d) FILTER (d > 0) AS harmonic, avg(d) FILTER (d > 0 AND l.c = big.c) AS lcc, any_value(m) / any_value(n)::DOUBLE AS share, sum(d - 1) FILTER (d > 0) / 2.0 / any_value(n) AS b, sum(d - 1) FILTER (d > 0 AND l.c = big.c) / 2.0 / any_value(m) AS b_lcc
  FROM dist JOIN lab l USING (w, s) JOIN big USING (w), nn GROUP BY w, n)
@@SELECT corr(harmonic, lcc) AS path_r, corr(b, b_lcc) AS betweenness_r, count(*) FILTER (share < 1) AS days_apart, min(share) AS worst_share, arg_min(w, (round(share, 9), w)) AS worst_w FROM pm""")
def disconnection(spark, sf):
    """How much it matters whether paths are taken over all nodes or over the largest component."""
    edges, n = tb.edges_of(spark, sf)
    rows = windows.path_measures(edges, n)
    return rows.agg(corr(F.col("path_harmonic"), F.col("path_lcc")).alias("path_r"), corr(F.col("betweenness"), F.col("betweenness_lcc")).alias("betweenness_r"), F.count_if(F.col("lcc_frac") < 1).alias("days_apart"), F.min("lcc_frac").alias("worst_share"), F.min_by("w", F.struct(F.round("lcc_frac", 9), "w")).alias("worst_w"))


@query("n_windows:i n_connected:i residual:f residual_connected:f r_all:f r_connected:f")
def duality_summary(spark, sf):
    """Mean degree less the Fiedler value and the first modularity eigenvalue, over all windows and over connected ones."""
    edges, n = tb.edges_of(spark, sf)
    whole = F.col("n_zero") == 1
    rows = windows.binary_spectra(edges, n).withColumn("e", F.lit(2.0) * network.edge_budget(n, tb.SHARE) / n - F.col("lam2") - F.col("mu1"))
    return rows.agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(whole).alias("n_connected"), F.avg("e").alias("residual"), F.avg(F.when(whole, F.col("e"))).alias("residual_connected"), corr(F.col("lam2"), F.col("mu1")).alias("r_all"), corr(F.when(whole, F.col("lam2")), F.when(whole, F.col("mu1"))).alias("r_connected"))


@query("w:i identities:b bounds:b", f"{o.EDGES}@@SELECT w, true AS identities, true AS bounds FROM wins")
def spectral_checks(spark, sf):
    """What must hold of every window's spectrum: sums and differences of its own scalars, and bounds on the rest."""
    _, edges, n, wins = tb.network_of(spark, sf)
    c, near = F.col, lambda x, y: F.abs(x - y) < 1e-8
    same = near(c("spread"), c("mu1") - c("muN")) & near(c("gap12"), c("mu1") - c("mu2")) & near(c("absmax"), F.greatest(c("mu1"), -c("muN"))) & near(c("energy"), c("trace_pos") - c("trace_neg"))
    same &= near(c("q_bound") * c("two_m"), c("trace_pos")) & near(c("dbar") * n, c("two_m")) & near(c("proxy_gap"), c("dbar") - c("mu1")) & near(c("proxy_norm"), 1 - c("mu1_norm")) & near(c("proxy_resid"), c("proxy_gap") - c("lam2")) & near(c("mu_ratio") * c("mu1"), -c("muN"))
    inside = (c("lam2") > -1e-9) & (c("lam_max") <= 2 * c("lam_max")) & (c("lam2_sym") <= n / (n - 1) + 1e-9) & c("ipr1").between(1 / n - 1e-9, 1 + 1e-9) & c("iprN").between(1 / n - 1e-9, 1 + 1e-9) & c("v1_deg_align").between(0, 1 + 1e-9) & c("spec_entropy").between(1, n + 1e-9)
    return windows.spectra(edges, n, windows=wins).select("w", same.alias("identities"), inside.alias("bounds"))


# ---------------------------------------------------------------- signals against one another


AGREE = f"""{o.DAILY}, {o.EV}, lb AS (SELECT w, (EXISTS (SELECT 1 FROM ev WHERE name = 'default' AND stamp BETWEEN start AND fin))::INT AS crash, stamp < (SELECT start FROM ev WHERE name = 'default') AS early FROM daily),
fw AS (SELECT w, CASE WHEN count(ret) OVER f = 5 THEN sum(ret) OVER f END AS fr, CASE WHEN count(ret) OVER f = 5 THEN min(ret) OVER f END AS fd FROM daily WINDOW f AS (ORDER BY w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
raw AS (SELECT name AS sn, w, val FROM (SELECT w, c, v, ret FROM daily) UNPIVOT (val FOR name IN (c, v, ret))), sg AS (SELECT sn, CASE WHEN corr(val, x) >= 0 THEN 1 ELSE -1 END AS sign, abs(corr(val, x)) AS r_ref FROM raw JOIN daily USING (w) GROUP BY 1),
z AS (SELECT sn, sign, r_ref, w, sign * val AS z, x, ret, crash, early, fr, fd FROM raw JOIN sg USING (sn) JOIN daily USING (w) JOIN lb USING (w) JOIN fw USING (w)),
y AS (SELECT *, z - lag(z) OVER p AS dz, x - lag(x) OVER p AS dx, row_number() OVER (PARTITION BY sn ORDER BY z, w) <= 1500 AS ga, row_number() OVER (PARTITION BY sn ORDER BY x, w) <= 1500 AS gb, CASE WHEN early THEN row_number() OVER (PARTITION BY sn, early ORDER BY w DESC) END AS back FROM z WINDOW p AS (PARTITION BY sn ORDER BY w)),
rk AS (SELECT sn, w, rank() OVER (PARTITION BY sn ORDER BY z) + (count(*) OVER (PARTITION BY sn, z) - 1) / 2.0::DOUBLE AS rz, rank() OVER (PARTITION BY sn ORDER BY x) + (count(*) OVER (PARTITION BY sn, x) - 1) / 2.0::DOUBLE AS rx FROM z)"""


@query("name:s sign:i r_ref:f r_rank:f r_diff:f gate_agreement:f jaccard:f mech_sd:f auc:f r_fwd:f r_dd:f", f"""{AGREE}
@@SELECT y.sn AS name, any_value(sign) AS sign, any_value(r_ref) AS r_ref, corr(rz, rx) AS r_rank, corr(dz, dx) AS r_diff, avg((ga = gb)::INT) AS gate_agreement, count(*) FILTER (ga AND gb) / count(*) FILTER (ga OR gb)::DOUBLE AS jaccard,
  (avg(z) FILTER (crash = 1) - avg(z) FILTER (back <= 60)) / greatest(stddev_pop(z) FILTER (back <= 60), 1e-12) AS mech_sd, (sum(rz) FILTER (crash = 1) - sum(crash) * (sum(crash) + 1) / 2.0) / (sum(crash) * (count(*) - sum(crash))) AS auc, corr(z, fr) AS r_fwd, corr(z, fd) AS r_dd FROM y JOIN rk USING (sn, w) GROUP BY 1""")
def agreement_battery(spark, sf):
    """Three signals against a fourth: sign, levels, ranks, moves, gates, the rise into a crash, its ROC area, what follows."""
    d = tb.daily(spark, sf)
    crash = tb.events(spark).where("name = 'default'")
    return signals.agreement_battery(d.unpivot(["w"], ["c", "v", "ret"], "name", "v"), d.select("w", "stamp", F.col("x").alias("ref"), "ret"), crash, 1500)


@query("r_fwd:f r_dd:f", f"""{o.DAILY}, fw AS (SELECT x, CASE WHEN count(ret) OVER f = 5 THEN sum(ret) OVER f END AS fr, CASE WHEN count(ret) OVER f = 5 THEN min(ret) OVER f END AS fd FROM daily WINDOW f AS (ORDER BY w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))@@SELECT corr(x, fr) AS r_fwd, corr(x, fd) AS r_dd FROM fw""")
def forward_correlations(spark, sf):
    """The signal against the sum and the least of the five returns after it."""
    d = signals.forward(tb.daily(spark, sf), full=True)
    return d.agg(corr(F.col("x"), F.col("fwd_sum")).alias("r_fwd"), corr(F.col("x"), F.col("fwd_min")).alias("r_dd"))


@query("r2:f r2_b:f r2_c:f only_b:f only_c:f common:f", f"""{o.DAILY}, c AS (SELECT corr(x, v) AS ab, corr(x, c) AS ac, corr(v, c) AS bc FROM daily), r AS (SELECT *, (ab * ab + ac * ac - 2 * ab * ac * bc) / (1 - bc * bc) AS r2 FROM c)
@@SELECT r2, ab * ab AS r2_b, ac * ac AS r2_c, r2 - ac * ac AS only_b, r2 - ab * ab AS only_c, ab * ab + ac * ac - r2 AS common FROM r""")
def variance_shares(spark, sf):
    """How much of one series two others explain: together, each alone, each on top of the other, in common."""
    r = signals.partial_correlation(tb.daily(spark, sf).select(F.col("x").alias("a"), F.col("v").alias("b"), F.col("c").alias("c")))
    b, c = F.col("ab") * F.col("ab"), F.col("ac") * F.col("ac")
    return r.select("r2", b.alias("r2_b"), c.alias("r2_c"), (F.col("r2") - c).alias("only_b"), (F.col("r2") - b).alias("only_c"), (b + c - F.col("r2")).alias("common"))


#: Eigenvalues of the 3 x 3 correlation matrix of x, c, v in closed form.
EIGEN3 = f"""{o.DAILY}, cc AS (SELECT corr(x, c) AS a, corr(x, v) AS b, corr(c, v) AS d FROM daily), pq AS (SELECT *, sqrt((a * a + b * b + d * d) / 3) AS p, a * b * d AS h FROM cc),
an AS (SELECT *, acos(greatest(-1, least(1, h / pow(p, 3)))) / 3 AS t FROM pq), lm AS (SELECT *, 1 + 2 * p * cos(t) AS l1, 1 + 2 * p * cos(t + 2 * pi() / 3) AS l3 FROM an), el AS (SELECT *, 3 - l1 - l3 AS l2 FROM lm)"""


@query("mean_abs:f max_abs:f share1:f share2:f share3:f n_90:i", f"""{EIGEN3}@@SELECT (abs(a) + abs(b) + abs(d)) / 3 AS mean_abs, greatest(abs(a), abs(b), abs(d)) AS max_abs, l1 / 3 AS share1, l2 / 3 AS share2, l3 / 3 AS share3, CASE WHEN l1 / 3 >= 0.9 THEN 1 WHEN (l1 + l2) / 3 >= 0.9 THEN 2 ELSE 3 END AS n_90 FROM el""")
def inter_measure_summary(spark, sf):
    """Mean and greatest correlation between three series, the shares of their components, and how many make 90 %."""
    made, shares, _ = learning.principal_components(tb.daily(spark, sf), ["x", "c", "v"], 3)
    r = tb.daily(spark, sf).agg(*(F.abs(corr(F.col(a), F.col(b))).alias(f"r{a}{b}") for a, b in (("x", "c"), ("x", "v"), ("c", "v"))))
    total = [sum(shares[: k + 1]) for k in range(3)]
    rows = r.select(((F.col("rxc") + F.col("rxv") + F.col("rcv")) / 3).alias("mean_abs"), F.greatest("rxc", "rxv", "rcv").alias("max_abs"))
    return rows.withColumns({**{f"share{k + 1}": F.lit(v) for k, v in enumerate(shares)}, "n_90": F.lit(next(k + 1 for k, v in enumerate(total) if v >= 0.9 - 1e-12))})


@query("component:i measure:s loading:f share:f r_time:f")
def component_report(spark, sf):
    """Loadings, explained shares and correlation with time of the components of the real graphs' measures."""
    names = list(windows.MEASURES)
    made, shares, loadings = learning.principal_components(_families(spark, sf), names, 3)
    real = made.where("family = 'real'").agg(*(corr(F.col("w").cast("double"), F.col(f"pc{k + 1}")).alias(f"r{k}") for k in range(3))).first()
    rows = [(k + 1, m, float(loadings[j][k]), float(shares[k]), real[f"r{k}"]) for k in range(3) for j, m in enumerate(names)]
    return spark.createDataFrame(rows, "component int, measure string, loading double, share double, r_time double")


# ---------------------------------------------------------------- scores against published cells


MEASURED = ("x", "c", "v", "ret", "dx", "dc", "dv", "dret")


def published(measure: int, model: int, era: int) -> tuple[float, float]:
    """Made-up published cells (chi2, rho), in place of the ones that a paper prints."""
    return 10.0 ** ((measure * 3 + model * 2 + era) % 5 - 2), ((measure * 7 + model * 5 + era * 3) % 19 - 9) / 10


CELLS = [(m, name, e, *published(i, j, k)) for i, m in enumerate(MEASURED) for j, name in enumerate(("comm", "conf")) for k, e in enumerate(("pre", "post"))]
CELL_SQL = f"""{o.DAILY}, st AS (SELECT w, stamp, x, c, v, ret, x - lag(x) OVER p AS dx, c - lag(c) OVER p AS dc, v - lag(v) OVER p AS dv, ret - lag(ret) OVER p AS dret FROM daily WINDOW p AS (ORDER BY w)),
ln AS (SELECT name AS measure, w, stamp, real FROM st UNPIVOT (real FOR name IN ({", ".join(MEASURED)}))), zs AS (SELECT measure, w, stamp, (real - avg(real) OVER p) / stddev_samp(real) OVER p AS real FROM ln WINDOW p AS (PARTITION BY measure)),
gn AS (SELECT *, avg(real) OVER (PARTITION BY measure ORDER BY w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS comm, lag(real) OVER (PARTITION BY measure ORDER BY w) AS conf FROM zs),
md AS (SELECT measure, 'comm' AS model, stamp, real, comm AS gen FROM gn UNION ALL SELECT measure, 'conf', stamp, real, conf FROM gn), pub(measure, model, era, paper_chi2, paper_rho) AS (VALUES {", ".join(f"('{m}', '{n}', '{e}', {a!r}::DOUBLE, {b!r}::DOUBLE)" for m, n, e, a, b in CELLS)}),
sc AS (SELECT measure, model, CASE WHEN year(stamp) < 1998 THEN 'pre' ELSE 'post' END AS era, avg((real - gen) ** 2) AS chi2, corr(real, gen) AS rho FROM md WHERE gen IS NOT NULL GROUP BY ALL), ce AS (SELECT *, abs(rho - paper_rho) AS gap, abs(log10(greatest(chi2, 1e-12)) - log10(greatest(paper_chi2, 1e-12))) AS log_ratio FROM sc JOIN pub USING (measure, model, era))"""


def _cells(spark, sf):
    """Eight series against two models of each, their smoothed and their late form, by era, beside published cells."""
    step = Window.orderBy("w")
    d = tb.daily(spark, sf).select("w", "stamp", "x", "c", "v", "ret").withColumns({f"d{n}": F.col(n) - F.lag(n).over(step) for n in ("x", "c", "v", "ret")})
    rows = d.unpivot(["w", "stamp"], list(MEASURED), "measure", "real").where("real IS NOT NULL")
    per, back = Window.partitionBy("measure"), Window.partitionBy("measure").orderBy("w")
    z = rows.withColumn("real", div(F.col("real") - F.avg("real").over(per), F.stddev_samp("real").over(per)))
    models = z.select("measure", "w", "stamp", "real", F.avg("real").over(back.rowsBetween(-4, 0)).alias("comm"), F.lag("real").over(back).alias("conf")).unpivot(["measure", "w", "stamp", "real"], ["comm", "conf"], "name", "model")
    scored = signals.scores(models.withColumn("measure", F.struct("measure", "name")), 1998, 12).where("era <> 'all'").select("measure.measure", F.col("measure.name").alias("model"), "era", "chi2", "rho")
    given = spark.createDataFrame(CELLS, "measure string, model string, era string, paper_chi2 double, paper_rho double")
    return signals.against_published(scored, given)


@query("measure:s model:s era:s chi2:f rho:f paper_chi2:f paper_rho:f gap:f log_ratio:f", f"{CELL_SQL}@@SELECT * FROM ce")
def paper_cells(spark, sf):
    """32 cells: mean square and correlation beside the published ones."""
    return _cells(spark, sf)


@query("n:i mae:f within_10:f within_20:f within_30:f sign_agreement:f median_log_ratio:f within_order:f comm_wins_chi2:i paper_comm_wins_chi2:i comm_wins_rho:i paper_comm_wins_rho:i", f"""{CELL_SQL},
pv AS (SELECT a.chi2 < b.chi2 AS c, a.paper_chi2 < b.paper_chi2 AS pc, a.rho > b.rho AS r, a.paper_rho > b.paper_rho AS pr FROM ce a JOIN ce b USING (measure, era) WHERE a.model = 'comm' AND b.model = 'conf')
@@SELECT * FROM (SELECT count(*) AS n, avg(gap) AS mae, avg((gap <= 0.1)::INT) AS within_10, avg((gap <= 0.2)::INT) AS within_20, avg((gap <= 0.3)::INT) AS within_30, avg((sign(rho) = sign(paper_rho))::INT) AS sign_agreement, median(log_ratio) AS median_log_ratio, avg((log_ratio <= 1)::INT) AS within_order FROM ce),
 (SELECT count(*) FILTER (c) AS comm_wins_chi2, count(*) FILTER (pc) AS paper_comm_wins_chi2, count(*) FILTER (r) AS comm_wins_rho, count(*) FILTER (pr) AS paper_comm_wins_rho FROM pv)""")
def paper_summary(spark, sf):
    return signals.published_summary(materialised(_cells(spark, sf), "cells"), "comm", "conf")


# ---------------------------------------------------------------- calendar


ANCHORS = [(200, "1995-07-20"), (900, "1997-06-20"), (1600, "1999-05-21")]
ANCHOR_SQL = f"""{o.DAILY}, an(n, day) AS (VALUES {", ".join(f"({n}, DATE '{d}')" for n, d in ANCHORS)}), nr AS (SELECT n, any_value(day) AS day, arg_min(w, abs(date_diff('day', stamp, day)) * 100000 - w) + 1 AS place FROM daily, an GROUP BY 1), oc AS (SELECT n, day, place, place - n AS shift FROM nr)"""


@query("n:i day:d place:i shift:i", f"{ANCHOR_SQL}@@SELECT * FROM oc")
def date_calibration(spark, sf):
    """Numbered dates of another calendar: the nearest day of ours, and how far its number is off."""
    return signals.calibrate(tb.daily(spark, sf), spark.createDataFrame(ANCHORS, "n int, day string").withColumn("day", F.to_date("day")))


@query("convention:s constant:b first_day:i last_day:i feasible:b", f"""{ANCHOR_SQL}, k AS (SELECT count(DISTINCT shift) = 1 AS constant, min(shift) AS shift FROM oc), nd AS (SELECT count(*) AS n FROM daily)
@@SELECT convention, constant, shift - extra + 1 AS first_day, shift - extra + 2000 AS last_day, constant AND shift - extra + 1 >= 1 AND shift - extra + 2000 <= n AS feasible FROM k, nd, (VALUES ('t1', 0), ('midpoint', {DELTA_T // 2}), ('t2', {DELTA_T})) v(convention, extra)""")
def convention_feasibility(spark, sf):
    """Where 2,000 days of the other calendar would begin and end on ours by each convention, and whether that is possible."""
    d = tb.daily(spark, sf)
    anchors = spark.createDataFrame(ANCHORS, "n int, day string").withColumn("day", F.to_date("day"))
    return signals.feasible(signals.calibrate(d, anchors), d.count(), 2000, {k: int(v * DELTA_T) for k, v in network.STAMPS.items()})


# ---------------------------------------------------------------- segmentation baselines


@query("method:s n_rows:i in_range:b", f"{o.DAILY}@@SELECT method, count(*) AS n_rows, true AS in_range FROM daily, (VALUES ('kmeans'), ('mixture'), ('spherical_mixture'), ('neural_gas'), ('dtw'), ('soft_dtw')) m(method) WHERE w >= 3 GROUP BY 1")
def baseline_checks(spark, sf):
    """Every baseline labels every stacked window of the daily series, with labels within the number of kinds."""
    rows = stacked_windows(spark, sf).groupBy("w").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("s"))
    x = rows.select(F.lit("orders").alias("series"), F.col("w").alias("t"), F.transform("s", lambda p: p["v"]).alias("x"))
    return windows.baselines(x, 3, 1).groupBy("method").agg(F.count(F.lit(1)).alias("n_rows"), F.bool_and(F.col("label").between(0, 2)).alias("in_range"))


@query("series:s t:i rows_zero:b connected_rank:b", f"{o.CORR}@@SELECT (i % 5)::VARCHAR AS series, t, true AS rows_zero, true AS connected_rank FROM num, (SELECT DISTINCT t FROM r) WHERE t >= 11 GROUP BY ALL")
def laplacian_checks(spark, sf):
    """Rolling Laplacians: no weight is negative, and the rank is the nodes less the components that the weights leave."""
    rets = network.numbered(tb.returns_of(spark, sf)).withColumn("series", (F.col("i") % 5).cast("string"))
    rows = windows.laplacian_series(rets, k=2, eta=0.5)
    return rows.groupBy("series", "t").agg(F.bool_and(F.col("weight") >= 0).alias("rows_zero"), F.bool_and((F.col("rank") >= 1) & (F.col("rank") <= 4) & ((F.col("lam2") > 0) == (F.col("rank") == 4))).alias("connected_rank"))
