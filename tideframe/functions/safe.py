"""ANSI-safe arithmetic and statistics that every operator uses."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def div(x: Column, y: Column) -> Column:
    """x / y, null where y is 0."""
    return F.try_divide(x.cast("double"), y.cast("double"))


def rnd(x: Column, digits: int = 6) -> Column:
    return F.round(x.cast("double"), digits)


def corr(x: Column, y: Column, over: WindowSpec | None = None) -> Column:
    """Pearson correlation of a group or frame; null if either side is constant (the built-in raises there)."""
    wrap = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return div(wrap(F.covar_pop(a, b)), wrap(F.stddev_pop(a)) * wrap(F.stddev_pop(b)))


def skew_corrected(x: Column) -> Column:
    """Bias-corrected skewness of a group; null below 3 values."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt((n * (n - 1)).cast("double")) / F.greatest(n - 2, F.lit(1)))


def kurtosis_corrected(x: Column) -> Column:
    """Bias-corrected excess kurtosis of a group; null below 4 values."""
    n = F.count(x)
    return F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / F.greatest((n - 2) * (n - 3), F.lit(1)))


def average_rank(x: str, *by: str) -> Column:
    """Rank of a column with ties averaged, by groups."""
    part = Window.partitionBy(*by)
    tie = Window.partitionBy(*by, x)
    return F.rank().over(part.orderBy(x)) + (F.count(F.lit(1)).over(tie) - 1) / 2.0


def lcg(*keys: Column) -> Column:
    """A draw in [0, 1) from integer keys, by integer arithmetic that any engine repeats exactly."""
    state = F.lit(12345).cast("long")
    for key in keys:
        state = (state * F.lit(1103515245) + key.cast("long") * F.lit(40503) + F.lit(12345)) % F.lit(2147483648)
    state = (state * F.lit(1103515245) + F.lit(12345)) % F.lit(2147483648)
    return state / F.lit(2147483648.0)


def lcg_sql(*keys: str) -> str:
    """The same as text for a second engine."""
    state = "12345::BIGINT"
    for key in keys:
        state = f"(({state}) * 1103515245 + ({key})::BIGINT * 40503 + 12345) % 2147483648"
    return f"((({state}) * 1103515245 + 12345) % 2147483648) / 2147483648.0::DOUBLE"
