"""The sparse volume index: which blocks a surface needs, and what is known of the table that holds them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import camera, coords
from tessera.params import GridParams, ParameterError

KEY = ("bx", "by", "bz")
#: Rows of a camera table (about 200 bytes each) up to which it is sent to every task.
SMALL_ROWS = 20_000


def _token() -> str:
    return uuid.uuid4().hex


@dataclass(frozen=True)
class Snapshot:
    """Blocks (and voxels) with the version they were made at; removing or clearing makes a new version.

    `grid` names the volume through all its versions. `epoch` names the set of blocks that can be referred to: it
    changes when blocks go, is kept when the volume grows, and no two volumes ever share one, in any process.
    """

    blocks: DataFrame
    voxels: DataFrame | None = None
    version: int = 1
    grid: str = field(default_factory=_token)
    epoch: str = field(default_factory=_token)

    def expect(self, version: int, epoch: str | None = None) -> None:
        if version != self.version:
            raise ParameterError(f"made at version {version}, the volume is at {self.version}")
        if epoch is not None and epoch != self.epoch:
            raise ParameterError("made for another volume, or before blocks were removed")

    def without(self, blocks: DataFrame, voxels: DataFrame | None) -> Snapshot:
        """The next version, after blocks went."""
        return replace(self, blocks=blocks, voxels=voxels, version=self.version + 1, epoch=_token())


def attributes(declared: list[tuple[str, str]]) -> str:
    """Schema of a voxel table with the declared attributes (name, SQL type); unnamed, untyped and repeated ones are refused."""
    names = [n for n, _ in declared]
    if not all(n and kind for n, kind in declared):
        raise ParameterError("an attribute needs a name and a type")
    if len(set(names)) < len(names) or set(names) & {*KEY, "local"}:
        raise ParameterError("attribute names must differ from each other and from the key")
    return "bx int, by int, bz int, local int" + "".join(f", {n} {kind}" for n, kind in declared)


def has_attribute(voxels: DataFrame, name: str) -> bool:
    return name in voxels.columns and name not in (*KEY, "local")


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns as generated ones: later filters and projections use the values and never copy the expressions."""
    made = F.explode_outer(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))).alias("_made")
    return df.select("*", made).select(*df.columns, *[F.col(f"_made.{k}").alias(k) for k in columns])


def dilate(centres: DataFrame, band: int) -> DataFrame:
    """Solid cubes of blocks around distinct centres; duplicates go before the expansion and after it."""
    steps = F.array(*[F.lit(i) for i in range(-band, band + 1)])
    out = centres.select(*KEY).distinct()
    for k in KEY:
        out = out.withColumn("_s", F.explode(steps)).withColumn(k, (F.col(k) + F.col("_s")).cast("int")).drop("_s")
    return out.distinct()


def allocate_from_coords(coordinates: DataFrame) -> DataFrame:
    return coordinates.select(*[F.col(k).cast("int").alias(k) for k in KEY]).distinct()


def allocate_from_points(points: DataFrame, g: GridParams) -> DataFrame:
    """Blocks within the truncation band of points (x, y, z); points that are not finite are dropped."""
    good = points.where(coords.finite(F.col("x"), F.col("y"), F.col("z")))
    centres = good.select(*[coords.world_to_block(F.col(a), g).alias(k) for a, k in zip(coords.AXES, KEY, strict=True)])
    return dilate(centres, g.band)


def surface_points(pixels: DataFrame, cameras: DataFrame) -> DataFrame:
    """World points of the pixels (frame_id, u, v, depth) whose depth lies in their camera's range."""
    c = F.col
    seen = pixels.join(F.broadcast(cameras) if is_small(cameras) else cameras, "frame_id").where(~F.isnan("depth") & (c("depth") >= c("min_depth")) & (c("depth") <= c("max_depth")))
    x, y, z = camera.unproject(c("u").cast("double"), c("v").cast("double"), c("depth"), c)
    return held(seen, x=x, y=y, z=z).select("frame_id", "u", "v", "x", "y", "z")


def said(pixels: DataFrame, value: str) -> DataFrame:
    """Pixels with a frame, a place and a value. What reads a pixel table asks alike, so plans make the table once."""
    return pixels.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in ("frame_id", "u", "v", value)]))


def allocate_from_depth(pixels: DataFrame, cameras: DataFrame, g: GridParams) -> DataFrame:
    return allocate_from_points(surface_points(said(pixels, "depth"), cameras), g)


def is_small(df: DataFrame, most: int = SMALL_ROWS) -> bool:
    """Whether a camera table is proven small enough to send everywhere."""
    return df.agg(F.count("*")).first()[0] <= most


def insert(blocks: DataFrame, more: DataFrame) -> DataFrame:
    """Insert if absent."""
    return blocks.select(*KEY).union(more.select(*KEY)).distinct()


def compact_in_frustum(blocks: DataFrame, planes, g: GridParams) -> DataFrame:
    """Blocks whose box is not wholly outside one plane: the corner farthest along each normal decides."""
    low = {k: F.col(k).cast("double") * g.edge - 0.5 * g.voxel_size for k in KEY}
    tests: list[Column] = []
    for *normal, d in planes:
        terms = [F.lit(float(n)) * (low[k] + (g.edge if n >= 0 else 0.0)) for n, k in zip(normal, KEY, strict=True)]
        tests.append(~(reduce(lambda a, b: a + b, terms) + F.lit(float(d)) < 0))
    return blocks.where(reduce(lambda a, b: a & b, tests))


def remove(volume: Snapshot, coordinates: DataFrame) -> Snapshot:
    """Drops blocks and their voxels; absent coordinates are ignored."""
    gone = coordinates.select(*KEY).distinct()
    voxels = volume.voxels.join(gone, list(KEY), "left_anti") if volume.voxels is not None else None
    return volume.without(volume.blocks.join(gone, list(KEY), "left_anti"), voxels)


def clear(volume: Snapshot) -> Snapshot:
    return volume.without(volume.blocks.limit(0), volume.voxels.limit(0) if volume.voxels is not None else None)


def resize(volume: Snapshot, g: GridParams, num_buckets: int) -> tuple[Snapshot, GridParams]:
    """Growing changes capacity only; blocks, version and epoch stay."""
    return replace(volume), g.grown(num_buckets)


def block_list(volume: Snapshot, chosen: DataFrame, version: int, epoch: str | None = None) -> DataFrame:
    """The chosen coordinates that are live, for a caller that made its choice at `version` (and `epoch`)."""
    volume.expect(version, epoch)
    return volume.blocks.join(chosen.select(*KEY).distinct(), list(KEY), "left_semi")


def lookup(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with what the table holds for their block; nulls where it holds nothing."""
    return rows.join(table, list(KEY), "left")


def diagnostics(blocks: DataFrame, g: GridParams) -> DataFrame:
    """One row: active blocks, a lower bound of overflow, fullest bucket, free blocks, load and whether to grow."""
    per = blocks.groupBy(coords.spatial_hash(*[F.col(k) for k in KEY], g.num_buckets).alias("bucket")).agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    over = F.coalesce(F.sum(F.greatest(F.lit(0), F.col("n") - g.bucket_size)), F.lit(0)).cast("long")
    return per.agg(
        total.alias("active"), over.alias("overflow_at_least"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("fullest_bucket"),
        F.greatest(F.lit(0), g.num_blocks - total).cast("long").alias("heap_free"), (total / float(g.num_blocks)).alias("load_factor"), (total / float(g.num_blocks) >= 0.7).alias("grow"),
    )


def alloc_failures(blocks: DataFrame, g: GridParams) -> DataFrame:
    """One row: blocks a table of this capacity could not take. Lock failures cannot happen here."""
    n = F.count("*").cast("long")
    heap = F.greatest(F.lit(0), n - g.num_blocks).cast("long")
    return blocks.agg(heap.alias("total"), F.lit(0).cast("long").alias("lock"), heap.alias("heap"), (heap > 0).alias("capacity_limited"))
