"""Panels and series made from the star-schema tables.

A panel is tiny beside its source (entities x dates) and is read by many
branches of a query (calendar, complete days, returns), so each is written once
to the shared folder: one scan of the source a query.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import network, panel
from .stages import materialised

DELTA_T, SHARE = 12, 0.10

#: Bands inside the tables' years, as a registry of events.
EVENTS = [
    ("asia", "1997-07-02", "1997-07-01", "1997-09-30", "sharp"),
    ("default", "1998-08-17", "1998-08-01", "1998-10-15", "sharp"),
    ("bubble", "2000-03-10", "2000-03-01", "2000-05-31", "diffuse"),
    ("slump", "2001-03-01", "2001-03-01", "2001-08-31", "diffuse"),
    ("peso", "1995-03-01", "1995-03-01", "1995-04-15", "sharp"),
    ("late", "1999-01-13", "1999-01-10", "1999-02-20", "sharp"),
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_months(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The first day of the first whole month of the line items, and the day after their last one."""
    day = F.col("l_shipdate").cast("timestamp_ntz")
    low, high = read(spark, sf_dir, "lineitem").agg(F.min(day), F.max(day)).first()
    month = lambda d: d.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    first = month(low) if low == month(low) else month(month(low) + timedelta(days=31))
    return str(first.date()), str(month(high + timedelta(days=1)).date())


def _months(rows: DataFrame, day: str, entity: str, value: str, span: tuple[str, str]) -> DataFrame:
    kind = "TIMESTAMP_NTZ" if dict(rows.dtypes)[day] == "timestamp_ntz" else "TIMESTAMP"  # of the column's own type, so that the filter reaches the scan
    kept = rows.where(f"{day} >= {kind} '{span[0]}' AND {day} < {kind} '{span[1]}'")
    return kept.groupBy(F.col(entity).cast("string").alias("entity"), F.to_date(F.date_trunc("month", day)).alias("date")).agg(F.sum(value).alias("price"))


def brand_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by brand and month."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    sales = read(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return materialised(_months(sales, "l_shipdate", "p_brand", "l_extendedprice", whole_months(spark, sf_dir)), "brand-months")


def supplier_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialised(_months(read(spark, sf_dir, "lineitem"), "l_shipdate", "l_suppkey", "l_extendedprice", whole_months(spark, sf_dir)), "supplier-months")


def panel_of(spark: SparkSession, sf_dir: str, policy: str = "drop_days") -> DataFrame:
    prices = brand_months(spark, sf_dir)
    return panel.with_time(panel.POLICIES[policy](prices).select("entity", "date", "price"))


def returns_of(spark: SparkSession, sf_dir: str, policy: str = "drop_days") -> DataFrame:
    return materialised(panel.log_returns(panel_of(spark, sf_dir, policy)), "returns")


def edges_of(spark: SparkSession, sf_dir: str, policy: str = "drop_days") -> tuple[DataFrame, int]:
    """The windows' edges, written once, and the number of entities."""
    return network_of(spark, sf_dir, policy)[1:3]


def network_of(spark: SparkSession, sf_dir: str, policy: str = "drop_days") -> tuple[DataFrame, DataFrame, int, DataFrame]:
    """Returns, edges, the number of entities, and the list of windows, each made once."""
    rets = returns_of(spark, sf_dir, policy)
    n = rets.select("entity").distinct().count()
    edges = materialised(network.edges_of_windows(rets, DELTA_T, network.edge_budget(n, SHARE)), "edges")
    last = rets.agg(F.max("t")).first()[0]
    return rets, edges, n, spark.range(0 if last is None else max(last - DELTA_T + 2, 0)).select(F.col("id").alias("w"))


def partition_of(spark: SparkSession, n: int, blocks: int = 4) -> DataFrame:
    """Nodes by place modulo a number: a partition that any engine makes alike."""
    return spark.range(n).select(F.col("id").cast("int").alias("node"), (F.col("id") % blocks).cast("int").alias("comm"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(w, stamp, x, c, v, ret): mean and number of orders by day, and the log change of their total; a few thousand rows."""
    days = read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("stamp")).agg(F.sum("o_totalprice").alias("v"), F.count(F.lit(1)).cast("double").alias("c"), F.avg("o_totalprice").alias("x"))
    order = Window.orderBy("stamp")
    return materialised(days.withColumns({"w": F.row_number().over(order) - 1, "ret": F.coalesce(F.log("v") - F.lag(F.log("v")).over(order), F.lit(0.0))}), "daily")


def events(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(EVENTS, "name string, onset string, start string, end string, tier string")
    return rows.withColumns({c: F.to_date(c) for c in ("onset", "start", "end")})


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up exchange listing from the suppliers."""
    return read(spark, sf_dir, "supplier").selectExpr(
        "concat(' S.', cast(s_suppkey % 40 AS string)) AS symbol",
        "CASE WHEN s_nationkey % 3 = 0 THEN 'Q' ELSE 'N' END AS exchange",
        "CASE WHEN s_suppkey % 5 = 0 THEN 'Y' ELSE 'N' END AS etf",
        "CASE WHEN s_suppkey % 11 = 0 THEN 'Y' ELSE 'N' END AS test_issue",
        "concat(s_name, CASE WHEN s_suppkey % 4 = 0 THEN ' Preferred' ELSE ' Common Stock' END) AS name",
    )
