"""Stage timings as rows: merged by name, totalled with the breakdown rules, and measured by a context manager."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BREAKDOWN = "  .."


def merge(rows: DataFrame) -> DataFrame:
    """(stage, cpu_ms, gpu_ms, has_gpu): one row per stage name."""
    return rows.groupBy("stage").agg(F.sum("cpu_ms").alias("cpu_ms"), F.sum(F.when(F.col("has_gpu"), F.col("gpu_ms")).otherwise(0.0)).alias("gpu_ms"), F.bool_or("has_gpu").alias("has_gpu"))


def totals(rows: DataFrame, exclude: str | None = None) -> DataFrame:
    """One row: host milliseconds without breakdown rows, device milliseconds with them; `exclude` leaves one stage out of both."""
    counted = F.lit(True) if exclude is None else F.col("stage") != exclude
    host = F.when(counted & ~F.startswith("stage", F.lit(BREAKDOWN)), F.col("cpu_ms")).otherwise(0.0)
    return merge(rows).agg(F.sum(host).alias("total_cpu_ms"), F.sum(F.when(counted & F.col("has_gpu"), F.col("gpu_ms")).otherwise(0.0)).alias("total_gpu_ms"))


def timestamp_delta(earlier, later, bits: int):
    """Ticks from one counter value to another, modulo the counter's valid bits."""
    return (later - earlier).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))


def ticks_to_ms(ticks, nanoseconds_per_tick: float):
    return ticks * F.lit(nanoseconds_per_tick) / F.lit(1000000.0)


class Stages:
    """Collects host timings on the driver; nested stages are breakdowns of the one around them."""

    def __init__(self):
        self.rows: dict[str, float] = {}
        self.depth = 0

    @contextmanager
    def stage(self, name: str):
        name = BREAKDOWN + name if self.depth else name
        self.rows.setdefault(name, 0.0)
        self.depth += 1
        began = time.perf_counter()
        try:
            yield
        finally:
            self.depth -= 1
            self.rows[name] += (time.perf_counter() - began) * 1000

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(k, v, 0.0, False) for k, v in self.rows.items()], "stage string, cpu_ms double, gpu_ms double, has_gpu boolean")


def fuse_report(blocks: DataFrame, dirty: DataFrame, remesh: DataFrame, frames: int, seconds: float) -> DataFrame:
    """One row: dirty and re-meshed shares of the active blocks in percent, dilation and frames a second."""
    key = ["bx", "by", "bz"]
    marked = blocks.select(*key).distinct().join(dirty.select(*key).distinct().withColumn("d", F.lit(1)), key, "left").join(remesh.select(*key).distinct().withColumn("m", F.lit(1)), key, "left")
    return share_report(marked, frames, seconds)


def share_report(marked: DataFrame, frames: int, seconds: float) -> DataFrame:
    """The report of distinct active blocks with d where they are dirty and m where they are meshed again, both null elsewhere."""
    n, d, m = F.count("*"), F.count("d"), F.count("m")
    return marked.agg(n.alias("active"), d.alias("dirty"), m.alias("remesh"), (100.0 * d / F.greatest(n, F.lit(1))).alias("dirty_pct"), (100.0 * m / F.greatest(n, F.lit(1))).alias("remesh_pct"), (m / F.greatest(d, F.lit(1)).cast("double")).alias("dilation"), F.lit(frames / seconds if seconds > 0 else 0.0).alias("fps"))
