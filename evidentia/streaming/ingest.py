"""Pair counts over a stream of detection records: the additive part of the pair table, kept as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def observed_counts(records: DataFrame, keys: list[str] = ("bait", "prey"), time: str | None = None, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Observations per pair; with a time column, per window, behind a watermark so that state is dropped."""
    if time is None:
        return records.groupBy(*keys).agg(F.count("*").alias("n_observed"))
    return records.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n_observed"))


def append_new(batch: DataFrame, epoch: int, path: str) -> None:
    """A ``foreachBatch`` sink that writes each epoch to a folder of its own, so a repeated epoch replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
