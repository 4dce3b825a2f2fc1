"""Structured Streaming forms of the prior-only operators: each equals its batch form on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def windowed_sums(stream: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of (ts, event_type, value) by event time, late rows up to the watermark included."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(window.alias("window"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


class _Baseline(StatefulProcessor):
    """The state of a key: its last `baseline` values, null ones left out, as the batch form's window does."""

    def __init__(self, baseline: int):
        self.baseline = baseline

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getValueState("past", "values array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        past: list = list(self.past.get()[0]) if self.past.exists() else []
        out = []
        batch = pd.concat(list(rows)).sort_values("w")
        for w, x in zip(batch["w"], batch["x"]):
            here = None if pd.isna(x) else float(x)
            seen = np.array([v for v in past if v is not None and not np.isnan(v)])
            sd = seen.std(ddof=1) if len(seen) > 1 else 0.0
            out.append((key[0], w, here, (here - seen.mean()) / sd if here is not None and len(seen) >= self.baseline // 2 and sd > 0 else None))
            past = [*past, np.nan if here is None else here][-self.baseline :]
        self.past.update((past,))
        yield pd.DataFrame(out, columns=["key", "w", "x", "z"]).astype({"x": "float64", "z": "float64"})

    def close(self) -> None:
        pass


def online_z(stream: DataFrame, baseline: int) -> DataFrame:
    """(key, w, x, z): each value against up to `baseline` (1 or more) earlier ones of its key, null below half of them.

    The state of a key is its last `baseline` rows; a null value stays null and adds nothing. Within a
    micro-batch rows are taken by w, and w is expected to grow from batch to batch.
    """
    if baseline < 1:
        raise ValueError("a baseline has one row or more")
    return stream.groupBy("key").transformWithStateInPandas(_Baseline(baseline), "key string, w long, x double, z double", "Append", "None")
