"""Mixing sources to target weights by the cube method.

Every document of a source is wanted target / source size times: a whole part
and a fraction. The flight phase moves the fractions along the null space of
the balance constraints (documents and words) until all but two are 0 or 1; it
runs in blocks of bounded size, then over what the blocks left, and so on until
one block is left for each source. There the largest open units wait; the landing
phase tries all outcomes of these and the last two and takes the best balanced one.

Rows that repeat an id and a size are exchangeable: m of them want m times the
fraction, whole ones of which are certain, and are one unit with the rest as its
fraction. So no block grows with repeats, and the rows are dealt out again at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_CLASS, Written, by_size

BLOCK, FAN, LANDING, SEED = 2000, 500, 14, 20
#: One task orders the sources (one row each); more than this many are an error.
MOST_SOURCES = 5_000_000
UNITS = "doc_id long, sidx int, size long, n long, extra long, block long, prob double"


def sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    words = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WS_CLASS.replace("[", "[^") + "+"))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.cast("long").alias("size"))


def targets(units: DataFrame) -> DataFrame:
    """For each source: index, documents, source_size, target. One row a source, so the windows below span few rows.

    Water filling: with sources in order of cap / weight, those up to the
    first whose share at the common level is within its cap are full.
    """
    per = units.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sidx", (F.row_number().over(order) - 1).cast("int")).withColumn("weight", F.col("sidx") % 3 + 1)
    per = per.withColumn("cap", 3.0 * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    rank = Window.orderBy("ratio", "sidx")
    every = Window.partitionBy()
    per = per.withColumns(
        {
            "place": F.row_number().over(rank),
            "room": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "rest": F.sum("weight").over(rank.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    per = per.withColumn("level", F.col("room") / F.col("rest"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(every)["level"]
    return per.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))).select("source", "sidx", "n_docs", "source_size", "target")


def fly(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> list[int]:
    """The flight phase in place: at most two units stay between 0 and 1; returns them.

    Three open units always have a direction u with sum(u) = 0 and
    sum(u * size) = 0; a step along it to a bound, up or down with the odds that
    keep the expectation, settles at least one of them.
    """
    open_: list[int] = []
    draws = iter(rng.random(len(prob) + 1).tolist())
    p, s = prob.tolist(), size.tolist()
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        open_.append(i)
        if len(open_) < 3:
            continue
        a, b, c = open_
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(open_, u) if v)
        down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(open_, u) if v)
        step = up if next(draws) * (up + down) < down else -down
        for k, v in zip(open_, u):
            p[k] += step * v
            p[k] = 0.0 if p[k] < 1e-9 else 1.0 if p[k] > 1 - 1e-9 else p[k]
        open_ = [k for k in open_ if 0 < p[k] < 1]
    prob[:] = p
    return open_


def land(prob: np.ndarray, size: np.ndarray, left: list[int]) -> None:
    """Settle the last units: of all their outcomes, the one whose words and documents are nearest to what was open."""
    if not left:
        return
    outcomes = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(float)
    words = np.abs(outcomes @ size[left] - (prob[left] * size[left]).sum()) / max(float(size[left].mean()), 1.0)
    docs = np.abs(outcomes.sum(axis=1) - prob[left].sum())
    prob[left] = outcomes[int((10 * words + docs).argmin())]


def _flight(level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id", "size"], kind="stable").reset_index(drop=True)
        prob, size = pdf["prob"].to_numpy(copy=True), pdf["size"].to_numpy()
        rng = np.random.default_rng([SEED, level, int(pdf["sidx"].iloc[0]), int(pdf["block"].iloc[0])])
        if last:  # the largest open units wait for the landing, which they alone could upset
            openly = np.flatnonzero((prob > 0) & (prob < 1))
            waits = openly[np.argsort(-size[openly], kind="stable")[:LANDING]]
            rest = np.setdiff1d(openly, waits)
            flown = prob[rest]
            left = rest[fly(flown, size[rest], rng)]
            prob[rest] = flown
            land(prob, size, [*waits.tolist(), *left.tolist()])
        else:
            fly(prob, size, rng)
        return pdf.assign(prob=prob)[[x.split()[0] for x in UNITS.split(", ")]]

    return run


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row: doc_id, source, size, source_size, target, copies, taken = copies * size.

    Null texts and texts without a word have size 0 and take nothing; a null
    source is a source of its own, last in order. Rows that repeat an id (or a null id) and a size
    are told apart by nothing: as many of them as are due take one copy
    more. The order depends on values alone, so reruns agree. An empty table gives no rows. Other columns are
    ignored. No source and no group of repeated rows is gathered in one task, however large.
    """
    units = Written(sizes(df, id_col, text_col, source_col), "sizes")
    n_sources = units.df.select("source").distinct().count()
    if n_sources > MOST_SOURCES:
        raise ValueError(f"{n_sources} sources are too many to order in one task")
    per = Written(targets(units.df), "targets").df
    most = per.agg(F.coalesce(F.max("n_docs"), F.lit(0))).first()[0]
    small = by_size(per.withColumnRenamed("source", "source2"), n_sources * 4)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = units.df.join(small, F.col("source").eqNullSafe(F.col("source2"))).withColumn("rate", rate)
    share = F.when(F.col("size") > 0, F.col("n") * (F.col("rate") - F.floor("rate"))).otherwise(0.0)
    block = F.pmod(F.xxhash64("doc_id", "size", F.lit(SEED)), F.ceil(F.col("n_docs") / BLOCK)).cast("long")
    same = joined.groupBy("sidx", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"), F.first("rate").alias("rate"), F.first("n_docs").alias("n_docs")).withColumn("share", share)
    wanted = Written(same.select("doc_id", "sidx", "size", "n", F.floor("share").alias("extra"), block.alias("block"), (F.col("share") - F.floor("share")).alias("prob")), "units")
    units.drop()
    open_, settled, level, n_blocks = wanted.df.where("prob > 0"), [wanted.df.where("prob = 0")], 0, -(-most // BLOCK)
    while True:
        last = n_blocks <= 1
        flown = open_.withColumn("order", F.xxhash64("doc_id", "size", F.lit(SEED + 1))).groupBy("sidx", "block").applyInPandas(_flight(level, last), UNITS)
        done = Written(flown, f"flight{level}").df
        settled.append(done.where((F.col("prob") == 0) | (F.col("prob") == 1)))
        if last:
            break
        level, n_blocks = level + 1, -(-n_blocks // FAN)
        open_ = done.where((F.col("prob") > 0) & (F.col("prob") < 1)).withColumn("block", F.floor(F.col("block") / FAN).cast("long"))
    picks = settled[0]
    for more in settled[1:]:
        picks = picks.unionByName(more)
    picks = picks.select("doc_id", "sidx", "size", "n", (F.col("extra") + F.col("prob")).cast("long").alias("extra"))
    rows = _dealt(picks, wanted.df.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0])
    back = by_size(per.withColumnRenamed("sidx", "sidx2"), n_sources * 4)
    whole = rows.join(back, F.col("sidx") == F.col("sidx2")).withColumn("rate", rate)
    copies = F.when(F.col("size") > 0, F.floor("rate") + F.col("more")).otherwise(0).cast("long")
    return whole.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _dealt(picks: DataFrame, most: int) -> DataFrame:
    """A row for each of the n rows of a unit; `more` is 1 for `extra` of them. Large units are cut into parts, which any task can deal out."""
    if most <= 1:
        return picks.withColumn("more", F.col("extra"))
    if most > BLOCK:
        picks = picks.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long")))).repartition("sidx", "doc_id", "size", "lo")
    else:
        picks = picks.withColumn("lo", F.lit(0).cast("long"))
    k = F.explode(F.sequence("lo", F.least(F.col("n"), F.col("lo") + BLOCK) - 1))
    return picks.withColumn("k", k).withColumn("more", (F.col("k") < F.col("extra")).cast("long"))
