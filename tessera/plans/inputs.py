"""Volumetric inputs derived from the star-schema tables. All constants are dyadic, so sums and products are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.params import Camera, GridParams

GRID = GridParams(voxel_size=0.0625, block_size=8, trunc_dist=0.25, bucket_size=4, num_buckets=64)
ORDERS = 4096  # order keys that make up a frame, so frames grow with the input
WIDTH, HEIGHT = 32, 24
TURNS = ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def camera(frame: int) -> Camera:
    c, s = TURNS[frame % 4]
    pose = (c, s, 0.0, 0.0, -s, c, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.5 * (frame % 16), 0.125 + 0.5 * (frame // 16), -0.25, 1.0)
    return Camera(32.0, 32.0, 16.0, 12.0, WIDTH, HEIGHT, pose, 0.5, 2.5)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / ORDERS).cast("int").alias("frame_id")).distinct()


def last_frame(spark: SparkSession, sf_dir: str) -> int:
    return frames(spark, sf_dir).agg(F.max("frame_id")).first()[0]


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One camera a frame, the pose of camera(frame_id) as a column; kept, since plans look at it several times."""
    f = F.col("frame_id")
    c, s = (F.get(F.array(*[F.lit(t[i]) for t in TURNS]), f % 4) for i in (0, 1))
    zero, one = F.lit(0.0), F.lit(1.0)
    pose = F.array(c, s, zero, zero, -s, c, zero, zero, zero, zero, one, zero, 0.5 * (f % 16), 0.125 + 0.5 * F.floor(f / 16), F.lit(-0.25), one)
    lens = [F.lit(v).alias(n) for n, v in (("fx", 32.0), ("fy", 32.0), ("cx", 16.0), ("cy", 12.0), ("width", WIDTH), ("height", HEIGHT))]
    return frames(spark, sf_dir).coalesce(1).select("frame_id", *lens, pose.alias("pose"), F.lit(0.5).alias("min_depth"), F.lit(2.5).alias("max_depth")).persist()


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, unit = F.col, F.lit(0.03125)
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", ((c("l_partkey") % 97 - 48).cast("double") * unit).alias("x"), ((c("l_suppkey") % 31 - 15).cast("double") * unit).alias("y"), (F.floor("l_quantity").cast("double") * unit).alias("z")
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    cell = [F.floor(c("l_orderkey") / ORDERS).cast("int").alias("frame_id"), (c("l_partkey") % WIDTH).cast("int").alias("u"), (c("l_suppkey") % HEIGHT).cast("int").alias("v")]
    return load(spark, sf_dir, "lineitem").groupBy(*cell).agg((F.min(F.floor("l_quantity")).cast("double") * 0.03125 + 0.5).alias("depth"))


def color_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    p = c("p_partkey")
    packed = (c("p_size").cast("long") * 5 % 256).bitwiseOR(F.shiftleft(p % 256, 8)).bitwiseOR(F.shiftleft(p * 7 % 256, 16))
    cell = [F.floor(p / 512).cast("int").alias("frame_id"), (p % WIDTH).cast("int").alias("u"), (F.floor(p / WIDTH) % 16).cast("int").alias("v")]
    return load(spark, sf_dir, "part").groupBy(*cell).agg(F.max(packed).alias("color"))
