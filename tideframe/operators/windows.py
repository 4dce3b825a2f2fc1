"""Kernels by window or by series: each group is one small graph, matrix or series, handed to numpy as a whole.

A window's graph has at most the edge budget's edges, whatever the number of
windows; windows are dealt out over the cluster, and every seed is a function
of the window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import estimators, kernels

MEASURES = ("modularity", "assortativity", "transitivity", "clique", "rich_club", "matching", "path_harmonic", "path_lcc", "lcc_frac", "betweenness")
MENU = tuple(kernels.spectral_menu(np.ones((3, 3)) - np.eye(3)))


def seed_of(w: int, replicate: int = 0) -> int:
    return 42 * 1_000_003 + w * 131 + replicate


def with_all(edges: DataFrame, windows: DataFrame | None) -> DataFrame:
    """The edges (w, i, j, ...) and one mark for each window of (w), so that a window without an edge has its graph too."""
    return edges if windows is None else edges.unionByName(windows.select("w", F.lit(-1).cast("int").alias("i"), F.lit(-1).cast("int").alias("j")), allowMissingColumns=True)


def _ends(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf[pdf["i"] >= 0].sort_values(["i", "j"])
    return pdf["i"].to_numpy(int), pdf["j"].to_numpy(int)


def path_measures(edges: DataFrame, n: int, windows: DataFrame | None = None) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = kernels.path_measures(kernels.adjacency(n, *_ends(pdf)))
        return pd.DataFrame([{"w": pdf["w"].iloc[0], **made}])

    return with_all(edges, windows).groupBy("w").applyInPandas(run, "w long, path_harmonic double, path_lcc double, path_reachable double, lcc_frac double, n_components long, betweenness double, betweenness_lcc double")


def louvain_partitions(edges: DataFrame, n: int, seeds: int = 10, windows: DataFrame | None = None) -> DataFrame:
    """(w, seed, node, comm, q)"""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = _ends(pdf)
        out = []
        for s in range(seeds):
            comm = kernels.louvain(n, i, j, 42 + s)
            out.append(pd.DataFrame({"w": pdf["w"].iloc[0], "seed": s, "node": np.arange(n), "comm": comm, "q": kernels.modularity(n, i, j, comm)}))
        return pd.concat(out)

    return with_all(edges, windows).groupBy("w").applyInPandas(run, "w long, seed int, node int, comm int, q double")


def measure_ensemble(edges: DataFrame, n: int, replicates: int = 3, windows: DataFrame | None = None) -> DataFrame:
    """(w, family, replicate, measure, value): the graph itself, its block model, its rewired copies."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, (i, j) = int(pdf["w"].iloc[0]), _ends(pdf)
        comm = kernels.louvain(n, i, j, 42)
        graphs = [("real", 0, i, j)]
        for r in range(replicates):
            graphs.append(("community", r, *kernels.block_graph(n, i, j, comm, seed_of(w, r))))
            graphs.append(("configuration", r, *kernels.configuration(n, i, j, seed_of(w, r) + 7)))
        rows = []
        for family, r, a, b in graphs:
            made = kernels.eight_measures(n, a, b, seed_of(w, r))
            rows += [(w, family, r, m, None if not np.isfinite(made[m]) else made[m]) for m in MEASURES]
        return pd.DataFrame(rows, columns=["w", "family", "replicate", "measure", "value"])

    return with_all(edges, windows).groupBy("w").applyInPandas(run, "w long, family string, replicate int, measure string, value double")


def ensemble_summary(ensemble: DataFrame) -> DataFrame:
    """(w, measure, family, mean, sd) over replicates, nulls left out."""
    return ensemble.groupBy("w", "measure", "family").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def null_models(edges: DataFrame, n: int, replicates: int = 3, method: str = "rewire", windows: DataFrame | None = None) -> DataFrame:
    """(w, replicate, q_planted, q_config, n_block, n_config, same_degrees)"""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, (i, j) = int(pdf["w"].iloc[0]), _ends(pdf)
        comm, rows = kernels.louvain(n, i, j, 42), []
        for r in range(replicates):
            a, b = kernels.block_graph(n, i, j, comm, seed_of(w, r))
            c, d = kernels.configuration(n, i, j, seed_of(w, r) + 7, method)
            deg = lambda x, y: np.bincount(np.concatenate([x, y]), minlength=n)
            rows.append((w, r, kernels.modularity(n, a, b, comm), kernels.modularity(n, c, d, kernels.louvain(n, c, d, seed_of(w, r))), len(a), len(c), bool((deg(c, d) == deg(i, j)).all())))
        return pd.DataFrame(rows, columns=["w", "replicate", "q_planted", "q_config", "n_block", "n_config", "same_degrees"])

    return with_all(edges, windows).groupBy("w").applyInPandas(run, "w long, replicate int, q_planted double, q_config double, n_block long, n_config long, same_degrees boolean")


def spectra(weighted: DataFrame, n: int, value: str = "rho", windows: DataFrame | None = None) -> DataFrame:
    """(w, menu of spectral scalars) of weighted edges (w, i, j, value)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, rows = np.zeros((n, n)), pdf[pdf["i"] >= 0]
        i, j = rows["i"].to_numpy(int), rows["j"].to_numpy(int)
        a[i, j] = a[j, i] = rows[value].to_numpy()
        return pd.DataFrame([{"w": pdf["w"].iloc[0], **kernels.spectral_menu(a)}])

    return with_all(weighted, windows).groupBy("w").applyInPandas(run, "w long, " + ", ".join(f"{m} double" for m in MENU))


def correlation_spectra(correlation: DataFrame, n: int, t: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.eye(n)
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        c[i, j] = c[j, i] = pdf["rho"].to_numpy()
        return pd.DataFrame([{"w": pdf["w"].iloc[0], **kernels.correlation_spectrum(c, t)}])

    return correlation.groupBy("w").applyInPandas(run, "w long, top_share double, n_above_mp double, corr_entropy double")


def laplacian_series(returns: DataFrame, window: int = 12, delta: float = 10.0, keys: tuple[str, ...] = ("series",), k: int = 1, eta: float = 0.0) -> DataFrame:
    """(keys, t, i, j, weight, lam2, rank): the rolling Laplacian, sequential within a series, parallel over series."""
    schema = ", ".join(f"{c} string" for c in keys) + ", t long, i int, j int, weight double, lam2 double, rank int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="t", columns="entity", values="y").sort_index()
        p = wide.shape[1]
        i, j = np.triu_indices(p, 1)
        out = []
        for t, w in estimators.time_varying(wide.to_numpy(), window, delta, k=k, eta=eta):
            lap = estimators.laplacian(w, p)
            out.append(pd.DataFrame({**{c: pdf[c].iloc[0] for c in keys}, "t": int(wide.index[t]), "i": i, "j": j, "weight": w, "lam2": estimators.fiedler(lap), "rank": estimators.effective_rank(lap)}))
        return pd.concat(out) if out else pd.DataFrame(columns=[x.split()[0] for x in schema.split(", ")])

    return returns.groupBy(*keys).applyInPandas(run, schema)


def segment(series: DataFrame, k: int, n: int, w: int, lam: float, beta: float, restarts: int = 20) -> DataFrame:
    """(series, t, label, cost): the cheapest of the restarts; every (series, restart) is a task of its own.

    `series` is (series, t, x array); labels belong to window ends.
    """
    spark = series.sparkSession
    tries = spark.range(restarts).select(F.col("id").cast("int").alias("restart"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x = estimators.stack(np.array(pdf["x"].tolist(), float), w)
        cost, label = estimators.segment_once(x, k, n, w, lam, beta, int(pdf["restart"].iloc[0]))
        return pd.DataFrame({"series": pdf["series"].iloc[0], "restart": pdf["restart"].iloc[0], "t": pdf["t"].to_numpy()[w - 1 :], "label": label, "cost": cost})

    made = series.crossJoin(F.broadcast(tries)).groupBy("series", "restart").applyInPandas(run, "series string, restart int, t long, label int, cost double")
    best = made.groupBy("series").agg(F.min(F.struct("cost", "restart")).alias("b")).select("series", F.col("b.restart").alias("restart"))
    return made.join(best, ["series", "restart"]).select("series", "t", "label", "cost")


BINARY = tuple(kernels.binary_spectra(~np.eye(3, dtype=bool)))


def binary_spectra(edges: DataFrame, n: int, windows: DataFrame | None = None) -> DataFrame:
    """(w, scalars, residual): residual is the component's mean degree less its Fiedler value and first modularity eigenvalue."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = kernels.binary_spectra(kernels.adjacency(n, *_ends(pdf)))
        return pd.DataFrame([{"w": pdf["w"].iloc[0], **made}])

    rows = with_all(edges, windows).groupBy("w").applyInPandas(run, "w long, " + ", ".join(f"{m} double" for m in BINARY))
    return rows.withColumn("residual", F.col("lcc_degree") - F.col("lcc_lam2") - F.col("lcc_mu1"))


def baselines(stacked: DataFrame, k: int, dims: int, seed: int = 42) -> DataFrame:
    """(series, method, t, label) of (series, t, x array): every baseline clusterer on the stacked rows of each series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x = np.array(pdf["x"].tolist(), float)
        out = []
        for name, cluster in estimators.CLUSTERERS.items():
            label = cluster(x, k, seed, dims) if "dtw" in name else cluster(x, k, seed)
            out.append(pd.DataFrame({"series": pdf["series"].iloc[0], "method": name, "t": pdf["t"].to_numpy(), "label": label}))
        return pd.concat(out)

    return stacked.groupBy("series").applyInPandas(run, "series string, method string, t long, label int")
