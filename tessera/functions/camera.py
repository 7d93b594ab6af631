"""Pinhole expressions over cameras given as columns (fx, fy, cx, cy, width, height, pose) or as literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(pose: Column, i: int) -> Column:
    return F.element_at(pose, i + 1)


def to_world(x: Column, y: Column, z: Column, pose: Column) -> list[Column]:
    return [at(pose, i) * x + at(pose, 4 + i) * y + at(pose, 8 + i) * z + at(pose, 12 + i) for i in range(3)]


def to_camera(x: Column, y: Column, z: Column, pose: Column) -> list[Column]:
    """Rigid inverse: the transposed rotation of the offset."""
    d = [x - at(pose, 12), y - at(pose, 13), z - at(pose, 14)]
    return [at(pose, 4 * k) * d[0] + at(pose, 4 * k + 1) * d[1] + at(pose, 4 * k + 2) * d[2] for k in range(3)]


def unproject(u: Column, v: Column, depth: Column, c) -> list[Column]:
    """World point of a pixel, pixel centres at whole numbers."""
    return to_world((u - c("cx")) * depth / c("fx"), (v - c("cy")) * depth / c("fy"), depth, c("pose"))


def project(x: Column, y: Column, z: Column, c) -> tuple[Column, Column, Column]:
    """(u, v, zc); u and v are null unless the point is in front."""
    return on_image(*to_camera(x, y, z, c("pose")), c)


def on_image(xc: Column, yc: Column, zc: Column, c) -> tuple[Column, Column, Column]:
    """project() of a place in the camera's own axes. It names each of them several times, so long expressions are held before."""
    front = (zc > 0) & ~F.isnan(zc)
    return F.when(front, c("fx") * (xc / F.when(front, zc)) + c("cx")), F.when(front, c("fy") * (yc / F.when(front, zc)) + c("cy")), zc


def in_image(u: Column, v: Column, c) -> Column:
    return (u >= 0) & (u < c("width")) & (v >= 0) & (v < c("height"))


def gl_to_cv(pose: Column) -> Column:
    """Flips the y and z axes of a camera pose."""
    return F.transform(pose, lambda m, i: F.when((i >= 4) & (i < 12), -m).otherwise(m))


def atlas_uv(px: Column, size: Column) -> Column:
    """Normalised texture coordinate of a pixel, kept half a texel inside."""
    half = 0.5 / size
    return F.greatest(half, F.least(1.0 - half, (px + 0.5) / size))
