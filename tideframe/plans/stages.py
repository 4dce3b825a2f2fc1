"""Named stages with stored results, acceptance checks, and number checks."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, which all executors share; in local mode, where it is unset (tests), a folder of our own. Elsewhere that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tideframe-"))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # at exit the session may be gone; the cluster clears its checkpoint folder
        pass


def materialised(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once: a small relation that many branches read must not scan its large source in each."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tideframe-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def verified(df: DataFrame, stored_table: DataFrame, keys: list[str], tol: float = 1e-8) -> DataFrame:
    """The rows again, if every number of the stored table is there within the tolerance; else an error at the row that is not."""
    columns = [c for c in stored_table.columns if c not in keys]
    known = stored_table.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    rows = known.join(df, keys, "left")
    bad = [F.coalesce(F.abs(F.col(c) - F.col(f"__{c}")) > tol, F.col(c).isNull() != F.col(f"__{c}").isNull()) for c in columns]
    off = rows.where(F.greatest(*(b.cast("int") for b in [*bad, F.lit(False)])) == 1).limit(1).collect()
    if off:
        raise ValueError(f"does not reproduce the stored table: {off[0].asDict()}")
    return df


def stored(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at the path if it was written whole, else made and written first."""
    if force or not _exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def expect(df: DataFrame, **checks: Column) -> DataFrame:
    """(check, ok, failures): for each named condition, how many rows break it; null counts as broken."""
    counts = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("failures")) for k in checks)))
    return counts.select(pairs.alias("x")).select("x.check", (F.col("x.failures") == 0).alias("ok"), "x.failures")


@dataclass(frozen=True)
class Phase:
    name: str
    make: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    checks: Callable[[DataFrame], dict[str, Column]] = lambda df: {}


def run_phases(spark: SparkSession, phases: list[Phase], folder: str, force: bool = False) -> tuple[dict[str, DataFrame], list[tuple[str, str, bool, int]]]:
    """Runs phases in order, each stored under the folder; stops after the first whose checks fail."""
    made: dict[str, DataFrame] = {}
    report = []
    for phase in phases:
        made[phase.name] = stored(spark, f"{folder}/{phase.name}", lambda p=phase: p.make(spark, made), force)
        checks = phase.checks(made[phase.name])
        results = expect(made[phase.name], **checks).collect() if checks else []
        report += [(phase.name, r["check"], r["ok"], r["failures"]) for r in results]
        if not all(r["ok"] for r in results):
            break
    return made, report


def check_numbers(text: str, numbers: dict[str, float]) -> list[tuple[str, bool, str]]:
    """For each `name: value` that a text quotes, whether the recomputed number prints the same at the quoted precision."""
    found = []
    for name, value in numbers.items():
        hit = re.search(rf"{re.escape(name)}\s*[:=]\s*(-?\d+(?:\.(\d+))?)", text)
        found.append((name, bool(hit) and f"{value:.{len(hit[2] or '')}f}" == hit[1], hit[1] if hit else "missing"))
    return found
