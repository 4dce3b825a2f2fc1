"""Panel engineering: ragged entity-by-date measurements to gated, dense panels and log returns.

Panels are long relations (entity, date, price). `t` numbers a panel's own dates
from 0, through the small calendar of distinct dates, never through a window
over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.safe import div, kurtosis_corrected, skew_corrected



def by_entity() -> WindowSpec:
    return Window.partitionBy("entity")


def in_time() -> WindowSpec:
    return by_entity().orderBy("t")


def normalise_symbol(symbol: Column) -> Column:
    return F.translate(F.trim(symbol), ".", "-")


def calendar(prices: DataFrame) -> DataFrame:
    """(date, t): the distinct dates in order; one row a date, so the window spans few rows."""
    return prices.select("date").distinct().withColumn("t", (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))


def with_time(prices: DataFrame) -> DataFrame:
    return prices.join(calendar(prices), "date")


def spans(prices: DataFrame, tolerance: int = 5) -> DataFrame:
    """(entity, n_obs, first_t, last_t, min_price, coverage, full_span): what the entity filters look at."""
    cal = calendar(prices)
    size = cal.agg(F.count(F.lit(1)).alias("n_days"))
    per = with_time(prices).where("price IS NOT NULL").groupBy("entity").agg(F.count("price").alias("n_obs"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.min("price").alias("min_price"))
    per = per.crossJoin(F.broadcast(size))  # one row
    return per.withColumn("coverage", F.col("n_obs") / F.col("n_days")).withColumn("full_span", (F.col("first_t") <= tolerance) & (F.col("last_t") >= F.col("n_days") - 1 - tolerance))


def coverage_ladder(prices: DataFrame, steps: tuple[float, ...] = (0.90, 0.95, 0.98, 0.99, 1.0), tolerance: int = 5) -> DataFrame:
    """Full-span entities that survive each coverage threshold."""
    ladder = prices.sparkSession.createDataFrame([(s,) for s in steps], "threshold double")
    return spans(prices, tolerance).where("full_span").crossJoin(F.broadcast(ladder)).groupBy("threshold").agg(F.count_if(F.col("coverage") >= F.col("threshold")).alias("survivors"))


def retained(prices: DataFrame, tolerance: int = 5, min_coverage: float = 1.0) -> DataFrame:
    """Entities that span the calendar, are covered enough and never fall to 0."""
    return spans(prices, tolerance).where(F.col("full_span") & (F.col("coverage") >= min_coverage) & (F.col("min_price") > 0)).select("entity")


def complete_days(prices: DataFrame) -> DataFrame:
    n = prices.select("entity").distinct().agg(F.count(F.lit(1)).alias("n"))
    return prices.where("price IS NOT NULL").groupBy("date").agg(F.count("price").alias("k")).crossJoin(F.broadcast(n)).where("k = n").select("date")


def drop_days(prices: DataFrame) -> DataFrame:
    """Only days on which every entity has a price."""
    return prices.join(complete_days(prices), "date", "left_semi")


def fill(prices: DataFrame) -> DataFrame:
    """Every entity on every day: the last price before, else the first after."""
    grid = prices.select("entity").distinct().crossJoin(calendar(prices))  # the result itself: every entity on every day
    rows = grid.join(prices, ["entity", "date"], "left")
    before = F.last("price", ignorenulls=True).over(in_time().rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("price", ignorenulls=True).over(in_time().rowsBetween(0, Window.unboundedFollowing))
    return rows.select("entity", "date", "t", F.coalesce(before, after).alias("price"))


POLICIES = {"drop_days": drop_days, "ffill": fill}


def build_panel(prices: DataFrame, tolerance: int = 5, min_coverage: float = 1.0, policy: str = "drop_days") -> DataFrame:
    """The dense panel (entity, date, t, price); an unknown policy is an error."""
    if policy not in POLICIES:
        raise ValueError(f"unknown missing-day policy {policy!r}")
    kept = prices.join(retained(prices, tolerance, min_coverage), "entity", "left_semi")
    return with_time(POLICIES[policy](kept).select("entity", "date", "price")).select("entity", "date", "t", "price")


def dropped_by_year(prices: DataFrame) -> DataFrame:
    gone = prices.select("date").distinct().join(complete_days(prices), "date", "left_anti")
    return gone.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("dropped_days"))


def thin_returns(prices: DataFrame, min_coverage: float = 0.9) -> DataFrame:
    """Log returns of entities covered on enough days, on days where all of them have one."""
    days = prices.select("date").distinct().agg(F.count(F.lit(1)).alias("n"))
    thick = prices.where("price IS NOT NULL").groupBy("entity").agg(F.count("price").alias("k")).crossJoin(F.broadcast(days)).where(F.col("k") >= F.floor(F.col("n") * min_coverage)).select("entity")
    kept = with_time(prices.join(thick, "entity", "left_semi"))
    y = F.log("price") - F.log(F.lag("price").over(in_time()))
    stepped = kept.withColumn("y", F.when(F.lag("t").over(in_time()) == F.col("t") - 1, y)).where("y IS NOT NULL")
    return stepped.select("entity", "date", "y").join(complete_days(stepped.select("entity", "date", F.col("y").alias("price"))), "date", "left_semi")


def log_returns(panel: DataFrame) -> DataFrame:
    """(entity, t, date, y): return t uses prices t and t + 1 and carries the later date; a price <= 0 is an error."""
    checked = F.when(F.col("price") > 0, F.log("price")).otherwise(F.raise_error(F.lit("prices must be positive")).cast("double"))
    rows = panel.withColumn("lp", checked).withColumn("y", F.col("lp") - F.lag("lp").over(in_time()))
    return rows.where("y IS NOT NULL").select("entity", (F.col("t") - 1).alias("t"), "date", "y")


# ---------------------------------------------------------------- quality gates


def longest_zero_run(returns: DataFrame) -> DataFrame:
    """(entity, run): the longest stretch of exactly zero returns, by gaps and islands."""
    island = F.sum((F.col("y") != 0).cast("int")).over(in_time())
    runs = returns.withColumn("g", island).where("y = 0").groupBy("entity", "g").agg(F.count(F.lit(1)).alias("run"))
    per = runs.groupBy("entity").agg(F.max("run").alias("run"))
    return returns.select("entity").distinct().join(per, "entity", "left").select("entity", F.coalesce("run", F.lit(0)).cast("long").alias("run"))


def gate_flags(returns: DataFrame, delta_t: int = 30, large: float = 0.5, extreme: float = 1.0, reversal: float = 0.7) -> DataFrame:
    """(entity, run, g1, g2, g3, keep): stale, reversing and extreme series; the share of zero returns besides."""
    nxt = F.lead("y", 1, 0.0).over(in_time())
    big = F.abs("y") > large
    flags = returns.withColumn("spike", big & (F.coalesce(div(-nxt, F.col("y")), F.lit(0.0)) > reversal))
    per = flags.groupBy("entity").agg(F.bool_or("spike").alias("g2"), (F.max(F.abs("y")) >= extreme).alias("g3"), F.avg((F.col("y") == 0).cast("double")).alias("zero_share"))
    both = per.join(longest_zero_run(returns), "entity")
    return both.select("entity", "run", (F.col("run") >= delta_t).alias("g1"), "g2", "g3", "zero_share", (~((F.col("run") >= delta_t) | F.col("g2") | F.col("g3"))).alias("keep"))


def gated(returns: DataFrame, **limits: float) -> DataFrame:
    return returns.join(gate_flags(returns, **limits).where("NOT keep").select("entity"), "entity", "left_anti")


def large_moves(returns: DataFrame, threshold: float = 0.5, lookback: int = 20) -> DataFrame:
    """Moves above the threshold with the population deviation of up to 20 returns before, null below 3."""
    past = in_time().rowsBetween(-lookback, -1)
    vol = F.when(F.count("y").over(past) > 2, F.stddev_pop("y").over(past))
    rows = returns.withColumn("vol", vol).where(F.abs("y") > threshold)
    return rows.select("entity", "t", "date", "y", F.expm1("y").alias("simple"), "vol", div(F.abs("y"), F.col("vol")).alias("sigmas"))


def moments(returns: DataFrame) -> DataFrame:
    return returns.groupBy("entity").agg(F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"), F.min("y").alias("low"), F.max("y").alias("high"), kurtosis_corrected(F.col("y")).alias("kurtosis"))


def pooled_moments(returns: DataFrame) -> DataFrame:
    return returns.agg(F.count("y").alias("n"), skew_corrected(F.col("y")).alias("skew"), kurtosis_corrected(F.col("y")).alias("kurtosis"), F.max(F.abs("y")).alias("max_abs"), F.percentile("y", F.lit(0.5)).alias("median"))


# ---------------------------------------------------------------- scaling


def standardise(returns: DataFrame, by: tuple[str, ...] = ("entity",)) -> DataFrame:
    """z: centred and of unit length within its group; flat groups are 0."""
    part = Window.partitionBy(*by)
    centred = returns.withColumn("c", F.col("y") - F.avg("y").over(part))
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(part))
    return centred.withColumn("z", F.coalesce(div(F.col("c"), norm), F.lit(0.0))).drop("c")


def scale(returns: DataFrame) -> DataFrame:
    return returns.withColumn("z", div(F.col("y") - F.avg("y").over(by_entity()), F.stddev_samp("y").over(by_entity())))


def market_residual(returns: DataFrame) -> DataFrame:
    """y less beta times the equal-weight mean of its day; no intercept is taken off."""
    market = returns.groupBy("t").agg(F.avg("y").alias("market"))
    joined = returns.join(market, "t")
    beta = joined.groupBy("entity").agg(F.regr_slope("y", "market").alias("beta"))
    return joined.join(beta, "entity").select("entity", "t", "date", "y", "market", "beta", (F.col("y") - F.col("market") * F.col("beta")).alias("residual"))


def universe(listing: DataFrame) -> DataFrame:
    """Common stocks of the main exchange: normalised symbol and name, one row a symbol."""
    kept = listing.where("exchange = 'N' AND etf = 'N' AND test_issue = 'N' AND contains(name, 'Common Stock') AND trim(symbol) <> ''")
    return kept.select(normalise_symbol(F.col("symbol")).alias("symbol"), F.trim("symbol").alias("act_symbol"), "name").groupBy("symbol").agg(F.min("act_symbol").alias("act_symbol"), F.min("name").alias("name"))
