"""Coordinate expressions: world, voxel, block, local index and bucket."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.params import GridParams

AXES = ("x", "y", "z")
#: The spatial hash's multipliers.
HASH = (73856093, 19349669, 83492791)
U32 = 0xFFFFFFFF


def world_to_voxel_f(x: Column, g: GridParams) -> Column:
    return x / F.lit(g.voxel_size)


def world_to_voxel(x: Column, g: GridParams) -> Column:
    """Nearest voxel, halves to even."""
    return F.rint(world_to_voxel_f(x, g)).cast("int")


def voxel_to_block(v: Column, g: GridParams) -> Column:
    return F.floor(v / F.lit(g.block_size)).cast("int")


def world_to_block(x: Column, g: GridParams) -> Column:
    return voxel_to_block(world_to_voxel(x, g), g)


def block_to_voxel(b: Column, g: GridParams) -> Column:
    return b * F.lit(g.block_size)


def voxel_to_world(v: Column, g: GridParams) -> Column:
    return v.cast("double") * F.lit(g.voxel_size)


def block_to_world(b: Column, g: GridParams) -> Column:
    return voxel_to_world(block_to_voxel(b, g), g)


def spatial_hash(x: Column, y: Column, z: Column, num_buckets: int) -> Column:
    """Bucket of a block: products wrap at 32 bits."""
    parts = [(c.cast("long") * F.lit(k)).bitwiseAND(F.lit(U32)) for c, k in zip((x, y, z), HASH, strict=True)]
    return parts[0].bitwiseXOR(parts[1]).bitwiseXOR(parts[2]) % F.lit(num_buckets)


def pack_block(x: Column, y: Column, z: Column) -> Column:
    """21 bits an axis in one long."""
    mask = F.lit((1 << 21) - 1)
    a, b, c = (v.cast("long").bitwiseAND(mask) for v in (x, y, z))
    return a.bitwiseOR(F.shiftleft(b, 21)).bitwiseOR(F.shiftleft(c, 42))


def local_parts(local: Column, g: GridParams) -> tuple[Column, Column, Column]:
    bs = g.block_size
    return (local % bs, F.floor(local / bs).cast("int") % bs, F.floor(local / (bs * bs)).cast("int"))


def finite(*columns: Column) -> Column:
    out = None
    for c in columns:
        ok = ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
        out = ok if out is None else out & ok
    return out
