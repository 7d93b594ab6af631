"""Streaming fusion: observations arrive in micro-batches and are folded onto a stored field, block by block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import tsdf
from tessera.params import GridParams

STATE = "bx int, by int, bz int, local int, tsdf double, weight double, color long, changed boolean"
LATE = "late long, last int, batch int"


def start_fusion(observations: DataFrame, folder: str, g: GridParams, max_weight: float = 5.0):
    """A writer that folds a stream of observation rows (see tsdf.observations) into versioned tables under `folder`.

    Version n + 1 is version n with batch n folded on in frame order and is written whole, so a batch replayed after
    a failure starts from the same version, overwrites what the failed try left and counts its late rows once. The
    two newest versions are kept; `current` reads a finished one. Frames not newer than the last one folded cannot be
    replayed into a capped mean: they are dropped and counted in `late`. Returns the DataStreamWriter; call start() on it.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(STATE).parquet(f"{folder}/v{number}") if number else spark.createDataFrame([], STATE)
        last = spark.read.schema(LATE).parquet(f"{folder}/late").where(F.col("batch") < number).agg(F.max("last")).first()[0] if number else None
        fresh = batch if last is None else batch.where(F.col("frame_id") > last)
        after = tsdf.fold(fresh, g, max_weight, before)
        after.write.mode("overwrite").parquet(f"{folder}/v{number + 1}")
        late = F.lit(0) if last is None else F.sum((F.col("frame_id") <= last).cast("int"))
        seen = batch.agg(F.coalesce(late, F.lit(0)).cast("long").alias("late"), F.greatest(F.max("frame_id"), F.lit(last).cast("int")).alias("last"))
        seen.write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        if number:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{number - 1}")
            old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)

    return observations.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/checkpoint")


def current(spark, folder: str, version: int) -> DataFrame:
    return spark.read.schema(STATE).parquet(f"{folder}/v{version}")
