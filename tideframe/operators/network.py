"""Rolling correlation networks with a fixed edge budget.

The edges of all windows come from matrix products: a block of windows and two
tiles of entities are one task, each return travels once for every block and pair
of tiles that needs it, and pairs leave their task only if they can be among the
edges. Where all pairs are asked for, entities are joined once by time, and a
window's correlation is an aggregate over a frame of each pair's rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import div
from .panel import calendar


def edge_budget(n: int, share: float) -> int:
    """Edges kept of n (n - 1) / 2, rounded half to even."""
    return int(round(share * n * (n - 1) / 2))


def numbered(returns: DataFrame) -> DataFrame:
    """Adds `i`, the entity's place by name: one row an entity in the window."""
    names = returns.select("entity").distinct().withColumn("i", (F.row_number().over(Window.orderBy("entity")) - 1).cast("int"))
    return returns.join(names, "entity")


def pairs(returns: DataFrame) -> DataFrame:
    """(i, j, t, x, y) for i < j: an equi-join by time."""
    a = numbered(returns).select("t", "i", F.col("y").alias("x"))
    b = a.toDF("t", "j", "y")
    return a.join(b, "t").where("i < j").select("i", "j", "t", "x", "y")


def window_correlation(returns: DataFrame, delta_t: int) -> DataFrame:
    """(w, i, j, rho) for all windows of delta_t returns; flat series correlate 0."""
    ahead = Window.partitionBy("i", "j").orderBy("t").rowsBetween(0, delta_t - 1)
    rho = div(F.covar_pop("x", "y").over(ahead), F.stddev_pop("x").over(ahead) * F.stddev_pop("y").over(ahead))
    rows = pairs(returns).select("i", "j", F.col("t").alias("w"), rho.alias("rho"), F.count(F.lit(1)).over(ahead).alias("k"))
    return rows.where(F.col("k") == delta_t).select("w", "i", "j", F.coalesce("rho", F.lit(0.0)).alias("rho"))


def top_edges(correlation: DataFrame, n_edges: int) -> DataFrame:
    """The n_edges largest of each window, ties by (i, j), packed by pair; the rank filter prunes before the shuffle."""
    order = Window.partitionBy("w").orderBy(F.col("rho").desc(), "i", "j")
    return correlation.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n_edges).drop("r")


#: Entities and windows of a task; bins of the histogram that bounds the edges from below where there are several tiles.
TILE, BLOCK, BINS = 512, 64, 4096


def _dealt(returns: DataFrame, delta_t: int, tile: int, block: int) -> tuple[DataFrame, int, int]:
    """(b, p, q, t, i, y): each return once for every block b of windows and pair p <= q of tiles that needs it; entities; windows."""
    rows = numbered(returns).select("t", "i", "y")
    n, last = rows.agg(F.max("i"), F.max("t")).first()
    n, n_windows = (0, 0) if n is None else (n + 1, max(last - delta_t + 2, 0))
    tiles = max(-(-n // tile), 1)
    first = F.greatest(F.floor((F.col("t") - delta_t + 1) / block), F.lit(0))
    until = F.least(F.floor(F.col("t") / block), F.lit(max(n_windows - 1, 0) // block))
    rows = rows.where(F.lit(n_windows > 0)).withColumn("b", F.explode(F.sequence(first.cast("int"), until.cast("int"))))
    own = F.floor(F.col("i") / tile).cast("int")
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumns({"p": F.least(own, "o"), "q": F.greatest(own, "o")})
    return rows.select("b", "p", "q", "t", "i", "y"), n, n_windows


def _correlations(pdf: pd.DataFrame, delta_t: int, tile: int, block: int, n_windows: int):
    """(w, i, j, rho) arrays of all pairs of one task, window by window; flat series correlate 0."""
    b, p, q = (int(pdf[c].iloc[0]) for c in ("b", "p", "q"))
    wide = pdf.pivot_table(index="t", columns="i", values="y")
    wide = wide.reindex(range(b * block, b * block + block + delta_t - 1))
    names, x = wide.columns.to_numpy(), wide.to_numpy()
    left, right = np.flatnonzero(names // tile == p), np.flatnonzero(names // tile == q)
    a, c = np.triu_indices(len(left), 1) if p == q else (np.repeat(np.arange(len(left)), len(right)), np.tile(np.arange(len(right)), len(left)))
    for k in range(min(block, n_windows - b * block)):
        part = x[k : k + delta_t]
        z = part - part.mean(axis=0)
        norm = np.sqrt((z * z).sum(axis=0))
        z = z / np.where((np.ptp(part, axis=0) == 0) | (norm == 0), np.inf, norm)
        rho = (z[:, left].T @ z[:, right])[a, c]
        seen = np.isfinite(rho)
        yield b * block + k, names[left[a[seen]]], names[right[c[seen]]], rho[seen]


def edges_of_windows(returns: DataFrame, delta_t: int, n_edges: int, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(w, i, j, rho): the n_edges largest correlations of each window, ties by (i, j).

    With one tile of entities a task finds its windows' edges itself. With more, a first
    pass sums histograms, which bound each window's least edge from below; a second
    one sends the pairs above the bound on.
    """
    rows, n, n_windows = _dealt(returns, delta_t, tile, block)
    schema = "w long, i int, j int, rho double"

    def frame(w: int, i: np.ndarray, j: np.ndarray, rho: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"w": w, "i": i, "j": j, "rho": rho})

    if n <= tile:

        def best(pdf: pd.DataFrame) -> pd.DataFrame:
            out = [frame(0, *(np.zeros(0, kind) for kind in ("i4", "i4", "f8")))]
            for w, i, j, rho in _correlations(pdf, delta_t, tile, block, n_windows):
                if len(rho) > n_edges > 0:
                    top = np.flatnonzero(rho >= -np.partition(-rho, n_edges - 1)[n_edges - 1])
                    i, j, rho = i[top], j[top], rho[top]
                order = np.lexsort((j, i, -rho))[:n_edges]
                out.append(frame(w, i[order], j[order], rho[order]))
            return pd.concat(out)

        return rows.groupBy("b", "p", "q").applyInPandas(best, schema)

    def histogram(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"w": np.zeros(0, int), "bin": np.zeros(0, int), "n": np.zeros(0, int)})]
        for w, _, _, rho in _correlations(pdf, delta_t, tile, block, n_windows):
            counts = np.bincount(_bin(rho), minlength=BINS)
            at = np.flatnonzero(counts)
            out.append(pd.DataFrame({"w": w, "bin": at, "n": counts[at]}))
        return pd.concat(out)

    counts = rows.groupBy("b", "p", "q").applyInPandas(histogram, "w long, bin int, n long").groupBy("w", "bin").agg(F.sum("n").alias("n"))
    above = F.sum("n").over(Window.partitionBy("w").orderBy(F.col("bin").desc()))
    floors = counts.withColumn("k", above).where(F.col("k") >= n_edges).groupBy("w").agg(F.max("bin").alias("bin"))
    tiles = -(-n // tile)
    places = returns.sparkSession.range(tiles * tiles).select((F.col("id") / tiles).cast("int").alias("p"), (F.col("id") % tiles).cast("int").alias("q")).where("p <= q")
    floors = floors.withColumn("b", F.floor(F.col("w") / block).cast("int")).crossJoin(F.broadcast(places))  # tiles of tiles: few rows

    def above_floor(pdf: pd.DataFrame, floor: pd.DataFrame) -> pd.DataFrame:
        least = dict(zip(floor["w"], floor["bin"]))
        out = [frame(0, *(np.zeros(0, kind) for kind in ("i4", "i4", "f8")))]
        for w, i, j, rho in _correlations(pdf, delta_t, tile, block, n_windows) if len(pdf) else ():
            top = np.flatnonzero(_bin(rho) >= least.get(w, 0))
            out.append(frame(w, i[top], j[top], rho[top]))
        return pd.concat(out)

    pairs = rows.groupBy("b", "p", "q").cogroup(floors.groupBy("b", "p", "q")).applyInPandas(above_floor, schema)
    return top_edges(pairs, n_edges)


def _bin(rho: np.ndarray) -> np.ndarray:
    return np.clip(((rho + 1) * (BINS / 2)).astype(int), 0, BINS - 1)


def window_counts(returns: DataFrame, delta_t: int, taus: DataFrame, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(w, n_pairs, total, n_below): pairs of each window of (w, tau), the sum of their correlations, how many are below -tau."""
    rows, n, n_windows = _dealt(returns, delta_t, tile, block)
    tiles = max(-(-n // tile), 1)
    places = returns.sparkSession.range(tiles * tiles).select((F.col("id") / tiles).cast("int").alias("p"), (F.col("id") % tiles).cast("int").alias("q")).where("p <= q")
    bounds = taus.select("w", "tau", F.floor(F.col("w") / block).cast("int").alias("b")).crossJoin(F.broadcast(places))  # tiles of tiles: few rows

    def run(pdf: pd.DataFrame, bound: pd.DataFrame) -> pd.DataFrame:
        tau = dict(zip(bound["w"], bound["tau"]))
        made = [(w, len(rho), float(rho.sum()), int((rho < -tau[w]).sum())) for w, _, _, rho in _correlations(pdf, delta_t, tile, block, n_windows) if w in tau] if len(pdf) else []
        return pd.DataFrame(made, columns=["w", "n_pairs", "total", "n_below"])

    parts = rows.groupBy("b", "p", "q").cogroup(bounds.groupBy("b", "p", "q")).applyInPandas(run, "w long, n_pairs long, total double, n_below long")
    return parts.groupBy("w").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("total").alias("total"), F.sum("n_below").alias("n_below"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select("w", F.explode(F.array("i", "j")).alias("node"))


def degrees(edges: DataFrame) -> DataFrame:
    return endpoints(edges).groupBy("w", "node").agg(F.count(F.lit(1)).alias("degree"))


def mean_correlation(returns: DataFrame, delta_t: int) -> DataFrame:
    """(w, mean_corr): (sum over t of (sum of z)^2 - sum of z^2) / (N (N - 1)), without any pair."""
    n = returns.select("entity").distinct().count()
    ahead = Window.partitionBy("entity").orderBy("t").rowsBetween(0, delta_t - 1)
    stats = returns.select("entity", F.col("t").alias("w"), F.avg("y").over(ahead).alias("m"), (F.stddev_pop("y").over(ahead) * F.sqrt(F.lit(float(delta_t)))).alias("norm"), F.count("y").over(ahead).alias("k")).where(F.col("k") == delta_t)
    wide = stats.withColumn("t", F.explode(F.sequence("w", F.col("w") + delta_t - 1))).join(returns.select("entity", "t", "y"), ["entity", "t"])
    z = wide.select("w", "t", F.coalesce(div(F.col("y") - F.col("m"), F.col("norm")), F.lit(0.0)).alias("z"))
    day = z.groupBy("w", "t").agg(F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("q"))
    return day.groupBy("w").agg((F.sum(F.col("s") * F.col("s") - F.col("q")) / (n * (n - 1))).alias("mean_corr"))


def network_summary(returns: DataFrame, delta_t: int, share: float, edges: DataFrame | None = None) -> DataFrame:
    """One row a window: threshold, kept weights, isolated nodes, pairs below minus the threshold, mean correlation.

    `edges` are the windows' edges where they are there already.
    """
    n = returns.select("entity").distinct().count()
    kept = edges_of_windows(returns, delta_t, edge_budget(n, share)) if edges is None else edges
    weights = kept.groupBy("w").agg(F.min("rho").alias("tau"), F.avg("rho").alias("mean_weight"), F.max("rho").alias("max_weight"), F.count(F.lit(1)).alias("n_edges"))
    nodes = degrees(kept).groupBy("w").agg((n - F.count(F.lit(1))).alias("n_isolated"), F.max("degree").alias("max_degree"))
    whole = window_counts(returns, delta_t, weights).select("w", "n_below", (F.col("total") / F.col("n_pairs")).alias("mean_corr"))
    return weights.join(nodes, "w").join(whole, "w")


STAMPS = {"t1": 0.0, "midpoint": 0.5, "t2": 1.0}


def window_stamps(prices: DataFrame, delta_t: int, convention: str = "t2") -> DataFrame:
    """(w, stamp): the date at the window's start, middle or end; another convention is an error."""
    if convention not in STAMPS:
        raise ValueError(f"unknown stamp convention {convention!r}")
    shift = int(STAMPS[convention] * delta_t)
    cal = calendar(prices)
    last = cal.agg(F.max("t").alias("last"))
    return cal.crossJoin(F.broadcast(last)).withColumn("w", F.col("t") - shift).where((F.col("w") >= 0) & (F.col("w") < F.col("last") + 1 - delta_t)).select("w", F.col("date").alias("stamp"))


def similarity(returns: DataFrame, correlation: bool) -> DataFrame:
    """(i, j, s) for i <= j: covariance (ddof 1) or correlation over all time."""
    a = numbered(returns).select("t", "i", F.col("y").alias("x"))
    rows = a.join(a.toDF("t", "j", "y"), "t").where("i <= j").groupBy("i", "j")
    value = div(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")) if correlation else F.covar_samp("x", "y")
    return rows.agg(value.alias("s"))


def attribute_purity(edges: DataFrame, attribute: DataFrame) -> DataFrame:
    """Share of edges whose ends have one attribute; attribute is (node, comm)."""
    a, b = attribute.toDF("i", "ci"), attribute.toDF("j", "cj")
    return edges.join(a, "i").join(b, "j").groupBy("w").agg(F.avg((F.col("ci") == F.col("cj")).cast("double")).alias("purity"))
