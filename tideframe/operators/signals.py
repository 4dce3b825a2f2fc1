"""Signals and their evaluation: prior-only detectors, ROC, event studies, gated backtests, resampling.

A signal is (w, stamp, x); events are (name, onset, start, end, tier). Series
have one row a window, so a window function over a whole series spans few rows;
many series are told apart by `keys`, by which the work is dealt out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import average_rank, corr, div, lcg


#: Rows of a registry of events, and of one series (a row a date), that are broadcast; more of them are an error.
EVENTS_BOUND, SERIES_BOUND = 10_000, 1_000_000


def few(df: DataFrame, bound: int = EVENTS_BOUND) -> DataFrame:
    """The table with a broadcast hint, its size checked."""
    if df.limit(bound + 1).count() > bound:
        raise ValueError(f"more than {bound} rows are too many to broadcast")
    return F.broadcast(df)


def trailing_z(signal: DataFrame, baseline: int, keys: Sequence[str] = (), value: str = "x") -> DataFrame:
    """Adds z against the mean and deviation of up to `baseline` earlier values; null below half of them."""
    past = Window.partitionBy(*keys).orderBy("w").rowsBetween(-baseline, -1)
    z = div(F.col(value) - F.avg(value).over(past), F.stddev_samp(value).over(past))
    return signal.withColumn("z", F.when(F.count(value).over(past) >= baseline // 2, z))


def event_mask(signal: DataFrame, events: DataFrame, tier: str | None = None) -> DataFrame:
    """Adds `label`: 1 if the stamp is within the band of any event (of a tier)."""
    bands = few((events if tier is None else events.where(F.col("tier") == tier)).select("start", "end"))
    inside = signal.select("stamp").distinct().join(bands, F.col("stamp").between(F.col("start"), F.col("end")), "left_semi").withColumn("label", F.lit(1))
    return signal.join(inside, "stamp", "left").withColumn("label", F.coalesce("label", F.lit(0)))


def event_coverage(signal: DataFrame, events: DataFrame) -> DataFrame:
    rows = None
    for tier in (None, "sharp", "diffuse"):
        one = event_mask(signal, events, tier).agg(F.avg(F.col("label").cast("double")).alias("share"), F.sum("label").alias("n_days")).select(F.lit(tier or "any").alias("tier"), "share", "n_days")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def auc(scored: DataFrame, keys: Sequence[str] = (), score: str = "z", label: str = "label") -> DataFrame:
    """(keys, auc, n, n_pos): Mann-Whitney from average ranks; null where one class is empty."""
    rows = scored.where(F.col(score).isNotNull()).withColumn("__rank", average_rank(score, *keys))
    pos = F.sum(F.col(label)).cast("double")
    n = F.count(F.lit(1)).cast("double")
    value = div(F.sum(F.when(F.col(label) == 1, F.col("__rank"))) - pos * (pos + 1) / 2, pos * (n - pos))
    return rows.groupBy(*keys).agg(value.alias("auc"), F.count(F.lit(1)).alias("n"), F.sum(label).alias("n_pos"))


def best_f1(scored: DataFrame, keys: Sequence[str] = (), score: str = "z", label: str = "label") -> DataFrame:
    """(keys, best_f1, precision, recall, threshold) at the first point of the greatest F1 on the precision-recall curve."""
    rows = scored.where(F.col(score).isNotNull())
    down = Window.partitionBy(*keys).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    steps = rows.groupBy(*keys, score).agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("n"))
    steps = steps.withColumns({"tp": F.sum("p").over(down), "k": F.sum("n").over(down), "pos": F.sum("p").over(every)}).where("pos > 0")
    steps = steps.withColumn("f1", 2.0 * F.col("tp") / (F.col("k") + F.col("pos")))
    first = F.max_by(F.struct("f1", (F.col("tp") / F.col("k")).alias("precision"), (F.col("tp") / F.col("pos")).alias("recall"), F.col(score).alias("threshold")), F.struct(F.round("f1", 12), -F.col(score)))
    return steps.groupBy(*keys).agg(first.alias("b")).select(*keys, F.col("b.f1").alias("best_f1"), "b.precision", "b.recall", "b.threshold")


def event_study(signal: DataFrame, events: DataFrame, half: int = 60) -> DataFrame:
    """(name, pos, pre, at_onset, post, below): z by the pre-window's population deviation; clipped events are skipped."""
    last = signal.agg(F.max("w").alias("last"))
    gap = F.abs(F.datediff("stamp", "onset"))
    at = signal.select("w", "stamp").crossJoin(few(events.select("name", "onset"))).groupBy("name").agg(F.min_by("w", F.struct(gap, -F.col("w"))).alias("pos"))
    at = at.crossJoin(F.broadcast(last)).where((F.col("pos") >= half) & (F.col("pos") + half <= F.col("last")))
    rows = F.broadcast(at).join(signal.select("w", "x"), F.col("w").between(F.col("pos") - half, F.col("pos") + half)).withColumn("k", F.col("w") - F.col("pos"))
    base = rows.where("k < 0").groupBy("name").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = rows.join(base, "name").withColumn("z", F.when(F.col("s") > 0, (F.col("x") - F.col("m")) / F.when(F.col("s") > 0, F.col("s"))).otherwise(F.col("x") - F.col("m")))
    return z.groupBy("name", "pos").agg(F.avg(F.when(F.col("k") < 0, F.col("z"))).alias("pre"), F.avg(F.when(F.abs("k") <= 2, F.col("z"))).alias("at_onset"), F.avg(F.when(F.col("k") > 0, F.col("z"))).alias("post"), F.avg(F.when(F.col("k") >= 0, (F.col("z") < 0).cast("double"))).alias("below"))


# ---------------------------------------------------------------- backtests


def lowest(stress: DataFrame, n: int, keys: Sequence[str] = (), value: str = "x", order: str = "w") -> DataFrame:
    """Adds `invest`: whether the row is among its series' n lowest, ties by order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value, order))
    return stress.withColumn("invest", rank <= n)


def backtest(gated: DataFrame, keys: Sequence[str] = (), ret: str = "ret", crash: Column | None = None) -> DataFrame:
    """(keys, final, crash_pnl, drawdown): summed returns of invested rows; the path starts at 0."""
    path = Window.partitionBy(*keys).orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    rows = gated.withColumn("__p", F.when(F.col("invest"), F.col(ret)).otherwise(0.0)).withColumn("__c", F.sum("__p").over(path))
    rows = rows.withColumn("__d", F.col("__c") - F.greatest(F.lit(0.0), F.max("__c").over(path)))
    return rows.groupBy(*keys).agg(F.sum("__p").alias("final"), F.sum(F.when(crash, F.col("__p")).otherwise(0.0) if crash is not None else F.lit(0.0)).alias("crash_pnl"), F.least(F.lit(0.0), F.min("__d")).alias("drawdown"))


def threshold_gates(signal: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, side, final): invest below or above each threshold, and the median's."""
    fixed = signal.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double").withColumn("which", F.lit("fixed"))
    median = signal.agg(F.percentile("x", F.lit(0.5)).alias("threshold")).withColumn("which", F.lit("median"))
    rows = signal.crossJoin(F.broadcast(fixed.unionByName(median)))
    pick = lambda side: F.sum(F.when((F.col("x") < F.col("threshold")) if side == "below" else (F.col("x") >= F.col("threshold")), F.col("ret")).otherwise(0.0)).alias(side)
    return rows.groupBy("which", "threshold").agg(pick("below"), pick("above"))


def forward(returns: DataFrame, days: int = 5, full: bool = False) -> DataFrame:
    """Adds the sum and least of the next returns; with `full`, null where fewer are left."""
    ahead = Window.orderBy("w").rowsBetween(1, days)
    enough = F.count("ret").over(ahead) == days if full else F.lit(True)
    return returns.withColumns({"fwd_sum": F.when(enough, F.sum("ret").over(ahead)), "fwd_min": F.when(enough, F.min("ret").over(ahead))})


# ---------------------------------------------------------------- comparison


def agreement(series: DataFrame, share: float = 0.7) -> DataFrame:
    """Of (w, a, b): Pearson, Spearman, correlation of differences, gate agreement and Jaccard of the n lowest."""
    n = int(share * series.count())
    step = Window.orderBy("w")
    rows = series.withColumns({"ra": average_rank("a"), "rb": average_rank("b"), "da": F.col("a") - F.lag("a").over(step), "db": F.col("b") - F.lag("b").over(step)})
    rows = rows.withColumns({"ga": F.row_number().over(Window.orderBy("a", "w")) <= n, "gb": F.row_number().over(Window.orderBy("b", "w")) <= n})
    return rows.agg(corr(F.col("a"), F.col("b")).alias("pearson"), corr(F.col("ra"), F.col("rb")).alias("spearman"), corr(F.col("da"), F.col("db")).alias("diff_corr"), F.avg((F.col("ga") == F.col("gb")).cast("double")).alias("gate_agreement"), div(F.count_if(F.col("ga") & F.col("gb")), F.count_if(F.col("ga") | F.col("gb"))).alias("jaccard"))


def agreement_battery(signals_long: DataFrame, reference: DataFrame, crash: DataFrame, n_invest: int, before: int = 60, days: int = 5) -> DataFrame:
    """One row for each signal of (name, w, v) against the reference of (w, stamp, ref, ret).

    The sign of the correlation with the reference turns the signal to its side; z is the turned
    signal. mech_sd is its rise inside the band of `crash` (one event) over the `before` rows ahead of it, in
    deviations of these; r_fwd and r_dd are correlations with the sum and the least of the returns that follow.
    """
    band = crash.select(F.col("start").alias("__a"), F.col("end").alias("__b"))
    ref = forward(reference, days, full=True).crossJoin(F.broadcast(band))
    ref = ref.withColumns({"crash": F.col("stamp").between(F.col("__a"), F.col("__b")).cast("int"), "early": F.col("stamp") < F.col("__a")})
    both = signals_long.join(ref, "w")
    side = both.groupBy("name").agg(corr(F.col("v"), F.col("ref")).alias("r")).select("name", F.when(F.col("r") >= 0, 1).otherwise(-1).alias("sign"), F.abs("r").alias("r_ref"))
    per, by = Window.partitionBy("name"), Window.partitionBy("name").orderBy("w")
    z = both.join(side, "name").withColumn("z", F.col("sign") * F.col("v"))
    z = z.withColumns({"rz": average_rank("z", "name"), "rx": average_rank("ref", "name"), "dz": F.col("z") - F.lag("z").over(by), "dx": F.col("ref") - F.lag("ref").over(by)})
    z = z.withColumns({"ga": F.row_number().over(per.orderBy("z", "w")) <= n_invest, "gb": F.row_number().over(per.orderBy("ref", "w")) <= n_invest})
    ahead = F.when(F.col("early") & (F.row_number().over(Window.partitionBy("name", "early").orderBy(F.col("w").desc())) <= before), F.col("z"))
    z = z.withColumn("ahead", ahead)
    pos = F.sum("crash").cast("double")
    area = div(F.sum(F.when(F.col("crash") == 1, F.col("rz"))) - pos * (pos + 1) / 2, pos * (F.count(F.lit(1)) - pos))
    rise = div(F.avg(F.when(F.col("crash") == 1, F.col("z"))) - F.avg("ahead"), F.greatest(F.stddev_pop("ahead"), F.lit(1e-12)))
    return z.groupBy("name").agg(
        F.first("sign").alias("sign"), F.first("r_ref").alias("r_ref"), corr(F.col("rz"), F.col("rx")).alias("r_rank"), corr(F.col("dz"), F.col("dx")).alias("r_diff"),
        F.avg((F.col("ga") == F.col("gb")).cast("double")).alias("gate_agreement"), div(F.count_if(F.col("ga") & F.col("gb")), F.count_if(F.col("ga") | F.col("gb"))).alias("jaccard"),
        rise.alias("mech_sd"), area.alias("auc"), corr(F.col("z"), F.col("fwd_sum")).alias("r_fwd"), corr(F.col("z"), F.col("fwd_min")).alias("r_dd"),
    )


def against_published(scored: DataFrame, given: DataFrame) -> DataFrame:
    """Cells (measure, model, era, chi2, rho) beside (..., paper_chi2, paper_rho): the gap of rho, and how many powers of ten chi2 is apart."""
    size = lambda c: F.log10(F.greatest(F.col(c), F.lit(1e-12)))
    return scored.join(given, ["measure", "model", "era"]).withColumns({"gap": F.abs(F.col("rho") - F.col("paper_rho")), "log_ratio": F.abs(size("chi2") - size("paper_chi2"))})


def published_summary(cells: DataFrame, one: str, other: str) -> DataFrame:
    """One row: how near the cells are to the published ones, and how often the one model beats the other, here and there."""
    share = lambda c: F.avg(c.cast("double"))
    near = cells.agg(
        F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mae"), *(share(F.col("gap") <= k / 100).alias(f"within_{k}") for k in (10, 20, 30)), share(F.signum("rho") == F.signum("paper_rho")).alias("sign_agreement"),
        F.percentile("log_ratio", F.lit(0.5)).alias("median_log_ratio"), share(F.col("log_ratio") <= 1).alias("within_order"),
    )
    first = lambda model, c: F.max(F.when(F.col("model") == model, F.col(c)))
    duels = cells.groupBy("measure", "era").agg(*((first(one, c) < first(other, c) if "chi2" in c else first(one, c) > first(other, c)).alias(c) for c in ("chi2", "paper_chi2", "rho", "paper_rho")))
    wins = duels.agg(*(F.count_if(F.col(c)).alias(f"{'paper_' if 'paper' in c else ''}{one}_wins_{c.removeprefix('paper_')}") for c in ("chi2", "paper_chi2", "rho", "paper_rho")))
    return near.crossJoin(F.broadcast(wins))


def scores(series: DataFrame, split_year: int, delta_t: int) -> DataFrame:
    """Of (measure, w, stamp, real, model), by era and over all: mean square, normalised, Pearson, non-overlapping Pearson."""
    clean = series.where("real IS NOT NULL AND model IS NOT NULL AND NOT isnan(real) AND NOT isnan(model)")
    era = clean.withColumn("era", F.when(F.year("stamp") < split_year, "pre").otherwise("post"))
    both = era.unionByName(era.withColumn("era", F.lit("all")))
    sparse = F.col("w") % delta_t == 0
    mse = F.avg(F.pow(F.col("real") - F.col("model"), 2))
    rows = both.groupBy("measure", "era").agg(
        F.count(F.lit(1)).alias("n"),
        mse.alias("chi2"),
        div(mse, F.var_pop("real")).alias("nmse"),
        F.when(F.count(F.lit(1)) >= 3, corr(F.col("real"), F.col("model"))).alias("rho"),
        F.count_if(sparse).alias("n_eff"),
        F.when(F.count_if(sparse) >= 3, corr(F.when(sparse, F.col("real")), F.when(sparse, F.col("model")))).alias("rho_eff"),
    )
    return rows


def partial_correlation(series: DataFrame) -> DataFrame:
    """Of (a, b, c): correlation of a and b with c taken out of both, and R2 of a on b and c."""
    r = series.agg(corr(F.col("a"), F.col("b")).alias("ab"), corr(F.col("a"), F.col("c")).alias("ac"), corr(F.col("b"), F.col("c")).alias("bc"))
    part = div(F.col("ab") - F.col("ac") * F.col("bc"), F.sqrt((1 - F.col("ac") * F.col("ac")) * (1 - F.col("bc") * F.col("bc"))))
    r2 = div(F.col("ab") * F.col("ab") + F.col("ac") * F.col("ac") - 2 * F.col("ab") * F.col("ac") * F.col("bc"), 1 - F.col("bc") * F.col("bc"))
    return r.select("ab", "ac", "bc", part.alias("partial"), r2.alias("r2"))


# ---------------------------------------------------------------- resampling


def draws(spark, n_boot: int, n_draws: int, seed: int = 0) -> DataFrame:
    """(b, k, u): repeatable uniform draws by number."""
    rows = spark.range(n_boot * n_draws).select((F.col("id") / n_draws).cast("long").alias("b"), (F.col("id") % n_draws).alias("k"))
    return rows.withColumn("u", lcg(F.lit(seed), F.col("b"), F.col("k")))


def block_bootstrap(series: DataFrame, n: int, block: int, n_boot: int, seed: int = 0) -> DataFrame:
    """(rho, low, high) of (w, real, model) over moving blocks; nulls if n is below three blocks."""
    blocks = -(-n // block)
    if n < 3 * block:
        return series.agg(*(F.lit(None).cast("double").alias(c) for c in ("rho", "low", "high")))
    starts = draws(series.sparkSession, n_boot, blocks, seed).withColumn("s", F.floor(F.col("u") * (n - block + 1)).cast("int"))
    rows = starts.select("b", (F.col("k") * block).alias("k0"), "s", F.posexplode(F.sequence(F.lit(0), F.lit(block - 1))).alias("o", "o2")).where(F.col("k0") + F.col("o") < n).select("b", (F.col("s") + F.col("o")).alias("w"))
    per = rows.join(few(series, SERIES_BOUND), "w").groupBy("b").agg(corr(F.col("real"), F.col("model")).alias("r"))
    band = per.agg(F.percentile("r", F.lit(0.025)).alias("low"), F.percentile("r", F.lit(0.975)).alias("high"))
    return series.agg(corr(F.col("real"), F.col("model")).alias("rho")).crossJoin(band)


def _draws(*keys: np.ndarray) -> np.ndarray:
    """The state of `lcg` (its value times 2^31) for arrays of keys."""
    state = np.int64(12345)
    for key in keys:
        state = (state * 1103515245 + np.asarray(key, np.int64) * 40503 + 12345) % (1 << 31)
    return (state * 1103515245 + 12345) % (1 << 31)


def _by_draw(series: DataFrame, columns: Sequence[str], n: int, draw: Callable[..., np.ndarray], step: int = 100) -> DataFrame:
    """(b, v) for b = 0 to n - 1: draw(first, end, *columns as arrays in order of w), `step` draws a call, spread over tasks.

    A series has one row a date, so it fits into one row; that row travels, not the draws times the dates.
    """
    few(series, SERIES_BOUND)
    rows = series.agg(F.sort_array(F.collect_list(F.struct("w", *(F.col(c) for c in columns if c != "w")))).alias("s"))
    parts = series.sparkSession.range(0, -(-n // step), 1, max(1, min(-(-n // step), 64))).select((F.col("id") * step).alias("lo"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo, rows in zip(frame["lo"], frame["s"]):
                end = min(int(lo) + step, n)
                table = pd.DataFrame([r if isinstance(r, dict) else r.asDict() for r in rows])
                yield pd.DataFrame({"b": np.arange(lo, end), "v": draw(int(lo), end, *(table[c].to_numpy() for c in columns))})

    return parts.crossJoin(F.broadcast(rows)).mapInPandas(run, "b long, v double")


def _lowest_sums(keys: np.ndarray, ret: np.ndarray, n: int) -> np.ndarray:
    """For each row of distinct keys the sum of ret over its n lowest."""
    if n >= keys.shape[1]:
        return np.full(len(keys), ret.sum())
    return ret[np.argpartition(keys, n, axis=1)[:, :n]].sum(axis=1)


def _against(totals: DataFrame, actual: DataFrame) -> tuple[DataFrame, Column]:
    """Totals beside the one row of the actual value, and the share that reaches it."""
    return totals.crossJoin(F.broadcast(actual)), F.avg((F.round("v", 9) >= F.round("actual", 9)).cast("double")).alias("p")


def circular_shift_null(series: DataFrame, n_invest: int) -> DataFrame:
    """(actual, null_mean, p): the gated sum of (w, x, ret) against all rotations of x; p without a correction."""
    n = series.count()

    def rotated(lo: int, end: int, x: np.ndarray, ret: np.ndarray) -> np.ndarray:
        rank = np.unique(x, return_inverse=True)[1]
        at = (np.arange(n)[None, :] + np.arange(lo, end)[:, None]) % n  # where each value goes
        keys = np.empty_like(at)
        np.put_along_axis(keys, at, np.broadcast_to(rank, at.shape) * n + at, axis=1)  # ties by the place that it goes to
        return _lowest_sums(keys, ret, n_invest)

    totals = _by_draw(series, ["x", "ret"], n, rotated)
    rows, p = _against(totals.where("b > 0"), totals.where("b = 0").select(F.col("v").alias("actual")))
    return rows.agg(F.first("actual").alias("actual"), F.avg("v").alias("null_mean"), p)


def random_gate_null(series: DataFrame, n_invest: int, n_draws: int, seed: int = 0) -> DataFrame:
    """(null_mean, null_sd, p): the sum of ret over n random rows, drawn by the order of repeatable uniforms, ties by w."""

    def drawn(lo: int, end: int, w: np.ndarray, ret: np.ndarray) -> np.ndarray:
        order = np.argsort(np.argsort(w))
        return _lowest_sums(_draws(seed, np.arange(lo, end)[:, None], w[None, :]) * len(w) + order, ret, n_invest)

    totals = _by_draw(series, ["w", "ret"], n_draws, drawn)
    rows, p = _against(totals, lowest(series, n_invest).where("invest").agg(F.sum("ret").alias("actual")))
    return rows.agg(F.avg("v").alias("null_mean"), F.stddev_samp("v").alias("null_sd"), p)


def sliding_event_null(scored: DataFrame, width: int) -> DataFrame:
    """(start, auc) of every contiguous band of `width` days of the series as the event; rows without a z rank nowhere."""
    last = scored.agg(F.max("w").alias("last"))
    starts = scored.crossJoin(F.broadcast(last)).where(F.col("w") <= F.col("last") - (width - 1)).select(F.col("w").alias("start"))
    ranked = scored.where("z IS NOT NULL").withColumn("r", average_rank("z"))
    total = ranked.agg(F.count(F.lit(1)).alias("n"))
    hits = ranked.select("r", F.explode(F.sequence(F.col("w") - width + 1, F.col("w"))).alias("start"))
    per = hits.groupBy("start").agg(F.sum("r").alias("s"), F.count(F.lit(1)).cast("double").alias("p")).crossJoin(F.broadcast(total))
    return starts.join(per, "start", "left").select("start", div(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def _auc_of_draws(order: np.ndarray, ties: np.ndarray, label: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each row of `times` (how often each day was drawn): the area under the ROC curve. `order` sorts the scores, `ties` numbers equal ones in that order."""
    pos, neg = times[:, order] * (label[order] == 1), times[:, order] * (label[order] != 1)
    first = np.flatnonzero(np.concatenate([[True], ties[1:] != ties[:-1]]))
    pos, neg = np.add.reduceat(pos, first, axis=1), np.add.reduceat(neg, first, axis=1)
    below = np.cumsum(neg, axis=1) - neg / 2
    p, n = pos.sum(axis=1), neg.sum(axis=1)
    return np.divide((pos * below).sum(axis=1), p * n, out=np.full(len(times), np.nan), where=p * n > 0)


def stratified_bootstrap(scored: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """(auc_a, auc_b, d_auc, low, high) of (w, label, x1, x2): days drawn within each class; d_auc is the mean over draws."""

    def drawn(score: int) -> Callable[..., np.ndarray]:
        def run(lo: int, end: int, label: np.ndarray, *x: np.ndarray) -> np.ndarray:
            times = np.zeros((end - lo, len(label)))
            for kind in np.unique(label):
                mine = np.flatnonzero(label == kind)
                picks = (_draws(seed, np.arange(lo, end)[:, None], np.arange(len(mine))[None, :], kind) / float(1 << 31) * len(mine)).astype(int)
                np.add.at(times, (np.arange(end - lo)[:, None], mine[picks]), 1)
            order = np.argsort(x[score], kind="stable")
            return _auc_of_draws(order, np.unique(x[score], return_inverse=True)[1][order], label, times)

        return run

    a, c = (_by_draw(scored, ["label", "x1", "x2"], n_boot, drawn(k)).withColumnRenamed("v", f"auc_x{k + 1}") for k in (0, 1))
    both = a.join(c, "b").withColumn("d", F.col("auc_x1") - F.col("auc_x2"))
    return both.agg(F.avg("auc_x1").alias("auc_a"), F.avg("auc_x2").alias("auc_b"), F.avg("d").alias("d_auc"), F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"))


def circular_autocorrelation(series: DataFrame) -> DataFrame:
    """(shift, r): correlation of x with itself rotated by every number of rows."""
    n = series.count()

    def rotated(lo: int, end: int, x: np.ndarray) -> np.ndarray:
        z = x - x.mean()
        whole = float(z @ z)
        return np.array([z @ np.roll(z, k) / whole if whole else np.nan for k in range(lo, end)])

    return _by_draw(series, ["x"], n, rotated).select(F.col("b").alias("shift"), F.col("v").alias("r"))


# ---------------------------------------------------------------- small series helpers


def investable(signal: DataFrame, end: str) -> DataFrame:
    """Rows whose next day, on which one would invest, is not after the end."""
    return signal.withColumn("__next", F.lead("stamp").over(Window.orderBy("w"))).where(F.col("__next") <= F.to_date(F.lit(end))).drop("__next")


def subsample(rows: DataFrame, cap: int, seed: int = 0, key: str = "w") -> DataFrame:
    """`cap` rows in a repeatable random order, returned in their own order."""
    return rows.orderBy(lcg(F.lit(seed), F.col(key)), key).limit(cap).orderBy(key)


def varying(long: DataFrame, least: float = 1e-12) -> DataFrame:
    """Series of (name, w, v) that are not constant."""
    kept = long.groupBy("name").agg(F.stddev_pop("v").alias("s")).where(F.col("s") >= least)
    return long.join(kept.select("name"), "name", "left_semi")


def direction(signal: DataFrame, events: DataFrame, before: int = 60) -> DataFrame:
    """(name, inside, outside, ahead): means of x inside the band, outside it, and over the last rows before it."""
    rows = signal.crossJoin(few(events.select("name", "start", "end")))
    inside = F.col("stamp").between(F.col("start"), F.col("end"))
    place = F.row_number().over(Window.partitionBy("name", F.col("stamp") < F.col("start")).orderBy(F.col("stamp").desc()))
    ranked = rows.withColumn("k", place)
    return ranked.groupBy("name").agg(F.avg(F.when(inside, F.col("x"))).alias("inside"), F.avg(F.when(~inside, F.col("x"))).alias("outside"), F.avg(F.when((F.col("stamp") < F.col("start")) & (F.col("k") <= before), F.col("x"))).alias("ahead"))


def detector_table(signals_long: DataFrame, events: DataFrame, baseline: int) -> DataFrame:
    """(name, tier, auc, n, n_pos, r) of (name, w, stamp, x): every signal's prior-only z against sharp and any events."""
    z = trailing_z(signals_long, baseline, ["name"]).withColumn("z", F.round("z", 9))  # equal scores tie, whatever their last bits
    rows = event_mask(z, events, "sharp").withColumn("tier", F.lit("sharp")).unionByName(event_mask(z, events).withColumn("tier", F.lit("any")))
    with_label = rows.groupBy("name", "tier").agg(corr(F.col("z"), F.col("label").cast("double")).alias("r"))
    return auc(rows, ["name", "tier"]).join(with_label, ["name", "tier"])


def calibrate(calendar: DataFrame, anchors: DataFrame) -> DataFrame:
    """(n, day, place, shift) of anchors (n, day): the number, from 1, of the nearest day of a calendar of (w, stamp), ties to the later, and how far it is from n."""
    gap = F.abs(F.datediff("stamp", "day"))
    near = calendar.select("w", "stamp").crossJoin(few(anchors)).groupBy("n", "day").agg((F.min_by("w", F.struct(gap, -F.col("w"))) + 1).alias("place"))
    return near.withColumn("shift", F.col("place") - F.col("n"))


def feasible(calibrated: DataFrame, n_days: int, length: int, conventions: dict[str, int]) -> DataFrame:
    """(convention, constant, first_day, last_day, feasible): where `length` days of the other calendar lie on one of `n_days`, by the days that each convention adds."""
    extra = calibrated.sparkSession.createDataFrame(list(conventions.items()), "convention string, extra int")
    shift = calibrated.agg((F.countDistinct("shift") == 1).alias("constant"), F.min("shift").alias("shift"))
    rows = extra.crossJoin(F.broadcast(shift)).withColumns({"first_day": F.col("shift") - F.col("extra") + 1, "last_day": F.col("shift") - F.col("extra") + length})
    return rows.select("convention", "constant", "first_day", "last_day", (F.col("constant") & (F.col("first_day") >= 1) & (F.col("last_day") <= n_days)).alias("feasible"))
