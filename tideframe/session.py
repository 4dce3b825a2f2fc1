"""A session with the settings that the engine is tuned for; on a cluster only what is not set yet is added."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("tideframe")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
