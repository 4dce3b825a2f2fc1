"""Queries that read the whole of their tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.functions.safe import lcg
from tideframe.operators import graph, network, signals, windows
from tideframe.plans import catalog, studies
from tideframe.plans import tables as tb

SF = "/root/testdata/sf0.01"


def test_all_components_are_clustered(spark, tmp_path):
    """Ten labels that differ in the last components only."""
    rng = np.random.default_rng(3)
    rows = [(k % 10, (rng.normal(0, 0.01, 16) + 9 * np.eye(16)[6 + k % 10]).tolist()) for k in range(300)]
    spark.createDataFrame(rows, "label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = studies.clustered_embeddings(spark, str(tmp_path)).where("method = 'kmeans'").groupBy("prediction").agg(F.countDistinct("label").alias("k")).collect()
    assert len(got) >= 8 and sum(r["k"] for r in got) == 10


def test_all_windows_count(spark):
    edges, n = tb.edges_of(spark, SF)
    want = windows.louvain_partitions(edges, n, 1).groupBy("w").agg(F.first("q").alias("q")).agg(F.avg("q")).first()[0]
    got = studies.noise_excess(spark, SF).where("source = 'panel'").first()["q"]
    assert abs(got - want) < 1e-9


def test_all_days_are_segmented(spark):
    days = tb.daily(spark, SF).count()
    assert days > 600 and catalog.segment_series(spark, SF).count() == days - 1


def noisy_returns(spark, n=11, days=40):
    rng = np.random.default_rng(8)
    y = rng.standard_normal((days, n)) + rng.standard_normal((days, 1))
    y[:, 3] = 0.25  # a flat series
    return spark.createDataFrame([(f"e{i:02d}", t, float(y[t, i])) for i in range(n) for t in range(days)], "entity string, t int, y double")


def test_edges_by_tiles_are_the_edges_of_all_pairs(spark):
    returns = noisy_returns(spark)
    want = network.top_edges(network.window_correlation(returns, 12), 17).toPandas().sort_values(["w", "i", "j"])
    for tile, block in ((512, 64), (4, 5), (3, 64), (512, 7)):
        got = network.edges_of_windows(returns, 12, 17, tile, block).toPandas().sort_values(["w", "i", "j"])
        assert got[["w", "i", "j"]].values.tolist() == want[["w", "i", "j"]].values.tolist()
        assert np.allclose(got["rho"], want["rho"])
    taus = spark.createDataFrame([(w, 0.1) for w in range(29)], "w long, tau double")
    rho = network.window_correlation(returns, 12).toPandas()
    for tile in (512, 4):
        counts = network.window_counts(returns, 12, taus, tile, 6).toPandas().set_index("w").sort_index()
        assert counts["n_below"].tolist() == (rho["rho"] < -0.1).groupby(rho["w"]).sum().tolist() and (counts["n_pairs"] == 55).all()
        assert np.allclose(counts["total"], rho.groupby("w")["rho"].sum())
    plan = network.edges_of_windows(returns, 12, 17)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan or "entity" in plan


def test_windows_without_an_edge_stay(spark):
    edges = spark.createDataFrame([(1, 0, 1, 0.5)], "w long, i int, j int, rho double")
    wins = spark.range(3).withColumnRenamed("id", "w")
    assert sorted(r["w"] for r in windows.path_measures(edges, 4, wins).collect()) == [0, 1, 2]
    made = windows.louvain_partitions(edges, 4, 1, wins).collect()
    assert len(made) == 12 and {r["q"] for r in made if r["w"] != 1} == {0.0}
    assert sorted(r["w"] for r in windows.spectra(edges, 4, windows=wins).collect()) == [0, 1, 2]


def daily_like(spark, n=70):
    rng = np.random.default_rng(9)
    rows = [(k, float(rng.integers(0, 30)), float(rng.normal()), int(k % 9 == 0), float(rng.integers(0, 12))) for k in range(n)]
    return rows, spark.createDataFrame(rows, "w int, x double, ret double, label int, c double")


def test_nulls_against_a_sort_of_every_draw(spark):
    rows, df = daily_like(spark)
    actual = sum(r[2] for r in sorted(rows, key=lambda r: (r[1], r[0]))[:40])
    turned = [sum(rows[w][2] for _, w in sorted((r[1], (r[0] + s) % 70) for r in rows)[:40]) for s in range(1, 70)]
    got = signals.circular_shift_null(df, 40).first()
    assert np.allclose([got["actual"], got["null_mean"], got["p"]], [actual, np.mean(turned), np.mean([round(v, 9) >= round(actual, 9) for v in turned])])
    u = {(r["b"], r["w"]): r["u"] for r in df.crossJoin(spark.range(300).withColumnRenamed("id", "b")).select("b", "w", lcg(F.lit(3), F.col("b"), F.col("w")).alias("u")).collect()}
    drawn = [sum(rows[w][2] for w in sorted(range(70), key=lambda w: (u[b, w], w))[:40]) for b in range(300)]
    got = signals.random_gate_null(df, 40, 300, 3).first()
    assert np.allclose([got["null_mean"], got["null_sd"], got["p"]], [np.mean(drawn), np.std(drawn, ddof=1), np.mean([round(v, 9) >= round(actual, 9) for v in drawn])])


def test_bootstrap_areas_against_pairs(spark):
    rows, df = daily_like(spark)
    u = {(r["b"], r["k"], r["label"]): r["u"] for r in spark.range(40).withColumnRenamed("id", "b").crossJoin(spark.range(70).withColumnRenamed("id", "k")).crossJoin(spark.range(2).withColumnRenamed("id", "label")).select("b", "k", "label", lcg(F.lit(5), F.col("b"), F.col("k"), F.col("label")).alias("u")).collect()}
    by = {v: [r for r in rows if r[3] == v] for v in (0, 1)}
    area = lambda pos, neg, c: np.mean([(p[c] > q[c]) + (p[c] == q[c]) / 2 for p in pos for q in neg])
    made = []
    for b in range(40):
        pos, neg = ([by[v][int(u[b, k, v] * len(by[v]))] for k in range(len(by[v]))] for v in (1, 0))
        made.append((area(pos, neg, 1), area(pos, neg, 4)))
    a, c = np.array(made).T
    got = signals.stratified_bootstrap(df.withColumnsRenamed({"x": "x1", "c": "x2"}), 40, 5).first()
    assert np.allclose(list(got), [a.mean(), c.mean(), (a - c).mean(), np.quantile(a - c, 0.025), np.quantile(a - c, 0.975)])


def test_decay_against_each_window(spark):
    edges = spark.createDataFrame([(w, i, (i + 1 + w) % 6, 1.0) for w in range(4) for i in range(6) if i < (i + 1 + w) % 6], "w long, i int, j int, rho double")
    parts = spark.createDataFrame([(w, k, (k + w) // 2 % 3) for w in range(4) for k in range(6)], "w long, node int, comm int")
    got = {r["lag"]: r["q"] for r in graph.decay(edges, parts, (0, 2, 9)).collect()}
    for lag in (0, 2):
        q = [r["q"] for r in graph.modularity(graph.mixing_matrix(edges, graph.lagged(parts, lag))).collect()]
        assert got[lag] == np.mean(q)
    assert set(got) == {0, 2}


def test_components_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((80, 3)) @ rng.standard_normal((3, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    _, shares, loadings = studies.learning.principal_components(df, ["a", "b", "c"], 3)
    lam, vec = np.linalg.eigh(np.corrcoef(x.T))
    assert np.allclose(shares, lam[::-1] / 3) and np.allclose(np.abs(np.array(loadings)), np.abs(vec[:, ::-1]), atol=1e-6)


def test_what_is_broadcast_is_bounded(spark):
    assert signals.few(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError):
        signals.few(spark.range(6), 5)
