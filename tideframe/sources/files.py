"""Readers and writers: delimited listings, dated series, Parquet, JSON reports, markdown.

Schemas are given, never inferred; Spark's commit protocol makes every write
atomic, so a reader sees all of a table or none of it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel

LISTING = "symbol string, exchange string, etf string, test_issue string, name string"


def read_listing(spark: SparkSession, path: str, schema: str = LISTING) -> DataFrame:
    """A pipe-delimited directory with a header."""
    return spark.read.csv(path, sep="|", header=True, schema=schema)


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    return panel.universe(read_listing(spark, path)).orderBy("symbol")


def read_prices(spark: SparkSession, path: str, entities: list[str]) -> DataFrame:
    """A wide dated CSV (date, one column an entity) as a long panel without missing prices."""
    wide = spark.read.csv(path, header=True, schema="date date, " + ", ".join(f"`{e}` double" for e in entities))
    return to_long(wide, entities)


def to_long(wide: DataFrame, entities: list[str]) -> DataFrame:
    rows = wide.unpivot("date", entities, "entity", "price")
    return rows.where(F.col("price").isNotNull() & ~F.isnan("price")).select("entity", F.to_date("date").alias("date"), "price")


def stack_batches(batches: list[DataFrame]) -> DataFrame:
    """Batches of (entity, date, price) as one panel: one price a day, entities without any price gone."""
    rows = batches[0]
    for more in batches[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("entity", F.to_date("date").alias("date"), F.when(~F.isnan("price"), F.col("price")).alias("price"))
    return rows.groupBy("entity", "date").agg(F.max("price").alias("price")).where("price IS NOT NULL")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """Numbers are written with so many significant digits."""
    shown = {c: F.format_string(f"%.{digits}g", F.col(c)) for c, kind in df.dtypes if kind == "double"}
    df.withColumns(shown).write.mode("overwrite").csv(path, header=True)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A table of at most `limit` rows for a report."""
    head = f"| {' | '.join(df.columns)} |\n|{'-|' * len(df.columns)}\n"
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else "" if v is None else str(v)
    return head + "".join(f"| {' | '.join(show(v) for v in row)} |\n" for row in df.limit(limit).collect())


def notebook(cells: list[tuple[str, str]]) -> str:
    """The JSON of a notebook (format 4.5) of (kind, text) cells, kind being code or markdown; no outputs."""
    made = []
    for k, (kind, text) in enumerate(cells):
        if kind not in ("code", "markdown"):
            raise ValueError(f"unknown kind of cell {kind!r}")
        more = {"execution_count": None, "outputs": []} if kind == "code" else {}
        made.append({"id": f"cell-{k}", "cell_type": kind, "metadata": {}, "source": text.splitlines(keepends=True), **more})
    return json.dumps({"cells": made, "metadata": {}, "nbformat": 4, "nbformat_minor": 5}, indent=1)


def coordinates(df: DataFrame, x: str, y: str, digits: int = 6, limit: int = 10_000) -> str:
    """The points of a plot for LaTeX, in order of x, rows without either left out; a plot has at most `limit` points."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y).orderBy(x, y).limit(limit).collect()
    show = lambda v: f"{v:.{digits}g}" if isinstance(v, float) else str(v)
    return "\\addplot coordinates {" + " ".join(f"({show(a)},{show(b)})" for a, b in rows) + "};\n"
