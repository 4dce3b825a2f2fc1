"""Line dedup by site-relative frequency.

For each host: the number of its pages that hold a line, divided by the number
of its pages. Lines above the ratio are boilerplate and are dropped from that
host's pages. Only DataFrame functions are used.

A host's boilerplate is short whatever its size: each such line is on more than
`max_ratio` of its pages, so there are at most (lines per page / max_ratio) of
them. So the texts never move: every page filters its own lines against its
host's short list. Lines travel as two 64-bit hashes, pre-aggregated by task; a
page's lines meet the short list by the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WS, Written

#: The ratio decides; a line on one page only is not repeated, whatever its ratio.
MAX_RATIO, MIN_PAGES = 0.10, 2


def _key(line: Column) -> Column:
    """128 bits for a line without its outer white space."""
    bare = F.trim(line, F.lit(WS))
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("line"), bare).alias("b"))


def _keys(text: Column) -> Column:
    worded = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(WS)) != "")
    return F.array_distinct(F.transform(worded, _key))


def boilerplate(df: DataFrame, host_col: str, text_col: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row for each host that has boilerplate: its line keys."""
    pages = df.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("t"))
    lines = pages.select("host", F.explode(_keys(F.col("t"))).alias("k")).groupBy("host", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    often = lines.join(totals.withColumnRenamed("host", "host2"), F.col("host").eqNullSafe(F.col("host2"))).where(F.col("n") > max_ratio * F.col("total"))
    return often.groupBy("host").agg(F.collect_set("k.a").alias("ks"))


def drop_lines(df: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, counts: tuple[str, str] | None = None) -> DataFrame:
    """The table with its boilerplate lines dropped; `counts` names two columns for lines before and lines dropped.

    A row is a page, so repeated rows count as pages; a line counts once for a
    page. Lines compare without outer white space; blank lines are neither
    counted nor dropped. A line on fewer than `min_pages` pages of its host
    stays. A null text stays null, its row counts as a page; rows with a null
    host form one host. A page whose lines all go keeps an empty text. Other
    columns pass through, whatever their names.
    """
    kept = Written(boilerplate(df, host_col, text_col, max_ratio, min_pages), "boilerplate").df.toDF("__tf_host", "__tf_ks")
    hosts, entries = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("__tf_ks")), F.lit(0))).first()
    small = F.broadcast(kept) if 8 * hosts + entries <= BROADCAST_ROWS else kept  # beyond it, the join shuffles and a hot host is split by AQE
    joined = df.join(small, F.col(host_col).cast("string").eqNullSafe(F.col("__tf_host")), "left")
    lines = F.split(F.col(text_col), "\n")
    own = F.transform(_keys(F.col(text_col)), lambda k: k["a"])
    joined = joined.withColumn("__tf_gone", F.array_intersect(own, F.col("__tf_ks")))  # by hash: neither a long page nor a long list is searched for each line
    left = F.when(F.coalesce(F.size("__tf_gone"), F.lit(0)) == 0, lines).otherwise(F.filter(lines, lambda x: (F.trim(x, F.lit(WS)) == "") | ~F.array_contains(F.col("__tf_gone"), _key(x)["a"])))
    made = joined.withColumn("__tf_left", left)
    out = {text_col: F.array_join("__tf_left", "\n")}
    if counts:
        n = lambda x: F.coalesce(F.size(x), F.lit(0)).cast("long")
        out |= {counts[0]: F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(n(lines))}
        out |= {counts[1]: F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(n(lines) - n(F.col("__tf_left")))}
    return made.withColumns(out).drop("__tf_host", "__tf_ks", "__tf_gone", "__tf_left")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM d),
k AS (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
n AS (SELECT source, bare, count(DISTINCT rid) AS n FROM k WHERE bare <> '' GROUP BY ALL),
t AS (SELECT source, count(*) AS total FROM d GROUP BY ALL),
b AS (SELECT n.source, bare FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source WHERE n >= {MIN_PAGES} AND n > {MAX_RATIO}::DOUBLE * total),
m AS (SELECT k.*, b.bare IS NOT NULL AS gone FROM k LEFT JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.bare = b.bare)
SELECT d.doc_id, count(line) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') END AS text
FROM d LEFT JOIN m USING (rid) GROUP BY d.rid, d.doc_id
"""
