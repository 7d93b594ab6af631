"""Grid and camera parameters, checked on the driver and inlined into plans as literals."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

INT32_MAX = 2**31 - 1


class ParameterError(ValueError):
    """A parameter outside its domain."""


@dataclass(frozen=True)
class GridParams:
    """A sparse voxel grid: pitch, block edge in voxels, truncation distance and table capacity."""

    voxel_size: float = 0.005
    block_size: int = 8
    trunc_dist: float = 0.04
    bucket_size: int = 50
    num_buckets: int = 30000
    max_chain: int = 128
    voxels_per_block: int | None = None
    num_blocks: int | None = None

    def __post_init__(self):
        if self.voxels_per_block is None:
            object.__setattr__(self, "voxels_per_block", self.block_size**3)
        if self.num_blocks is None:
            object.__setattr__(self, "num_blocks", self.bucket_size * self.num_buckets)
        rules = (
            (math.isfinite(self.voxel_size) and self.voxel_size > 0, "voxel_size must be positive"),
            (self.block_size > 0, "block_size must be positive"),
            (self.block_size <= 1290, "block_size cubed must fit 32 bits"),
            (self.voxels_per_block == self.block_size**3, "voxels_per_block must be block_size cubed"),
            (math.isfinite(self.trunc_dist) and self.trunc_dist > 0, "trunc_dist must be positive"),
            (self.bucket_size >= 2, "bucket_size must be at least 2"),
            (self.num_buckets > 0, "num_buckets must be positive"),
            (self.num_blocks == self.bucket_size * self.num_buckets, "num_blocks must be bucket_size times num_buckets"),
            (self.num_blocks * self.voxels_per_block <= INT32_MAX, "the largest block pointer must fit 32 bits"),
            (self.max_chain > 0, "max_chain must be positive"),
        )
        for holds, why in rules:
            if not holds:
                raise ParameterError(why)

    @property
    def edge(self) -> float:
        return self.block_size * self.voxel_size

    @property
    def band(self) -> int:
        """Truncation half-width in blocks."""
        return max(1, math.ceil(self.trunc_dist / self.edge))

    def grown(self, num_buckets: int) -> GridParams:
        """The same grid with a larger table; anything that does not grow is refused."""
        if num_buckets <= self.num_buckets:
            raise ParameterError("a resize must grow the table")
        return GridParams(self.voxel_size, self.block_size, self.trunc_dist, self.bucket_size, num_buckets, self.max_chain)


IDENTITY = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)


@dataclass(frozen=True)
class Camera:
    """A pinhole camera; pose is camera to world, column-major."""

    fx: float
    fy: float
    cx: float
    cy: float
    width: int
    height: int
    pose: tuple[float, ...] = field(default=IDENTITY)
    min_depth: float = 0.1
    max_depth: float = 10.0


def registered_depth(color: Camera, width: int, height: int, min_depth: float, max_depth: float) -> Camera:
    """The depth camera of a depth image registered to a colour camera: intrinsics rescaled about pixel edges, pose shared."""
    if min(color.width, color.height, width, height) <= 0:
        raise ParameterError("image sizes must be positive")
    if not 0 <= min_depth < max_depth:
        raise ParameterError("need 0 <= min_depth < max_depth")
    if not all(math.isfinite(f) and f > 0 for f in (color.fx, color.fy)):
        raise ParameterError("focal lengths must be finite and positive")
    sx, sy = width / color.width, height / color.height
    return Camera(color.fx * sx, color.fy * sy, (color.cx + 0.5) * sx - 0.5, (color.cy + 0.5) * sy - 0.5, width, height, color.pose, min_depth, max_depth)


def _plane(n, d, unit: bool = True):
    length = math.sqrt(sum(c * c for c in n))
    return (*n, d) if not unit or not length > 0 else (*(c / length for c in n), d / length)


def pinhole_planes(c: Camera, near: float, far: float) -> list[tuple[float, float, float, float]]:
    """Six inward unit planes (left, right, top, bottom, near, far) in world space; the side planes are a tenth wider."""
    sx, sy = 0.9 * c.fx, 0.9 * c.fy
    local = [(sx, 0, c.cx, 0), (-sx, 0, c.width - c.cx, 0), (0, sy, c.cy, 0), (0, -sy, c.height - c.cy, 0), (0, 0, 1, -near), (0, 0, -1, far)]
    m, t = c.pose, c.pose[12:15]
    out = []
    for a, b, k, d in local:  # a rigid pose carries normals by its rotation
        n = tuple(m[i] * a + m[4 + i] * b + m[8 + i] * k for i in range(3))
        out.append(_plane(n, d - sum(x * y for x, y in zip(n, t, strict=True))))
    return out


def projection_planes(m: tuple[float, ...], margin: float = 0.0) -> list[tuple[float, float, float, float]]:
    """Planes of a column-major view-projection matrix with depth in [0, 1]; `margin` metres outward on all but near.

    A plane whose normal is zero or not finite is kept as it is and gets no margin.
    """
    r = [tuple(m[4 * c + i] for c in range(4)) for i in range(4)]
    clip = [[x + s * y for x, y in zip(r[3], r[k], strict=True)] for k, s in ((0, 1), (0, -1), (1, 1), (1, -1))] + [list(r[2]), [x - y for x, y in zip(r[3], r[2], strict=True)]]
    out = []
    for i, p in enumerate(clip):
        length = math.sqrt(sum(v * v for v in p[:3])) if all(map(math.isfinite, p[:3])) else math.nan
        if not (length > 0 and math.isfinite(length)):
            out.append(tuple(p))
            continue
        out.append((p[0] / length, p[1] / length, p[2] / length, p[3] / length + (margin if i != 4 else 0.0)))
    return out


#: Rows of the matrices from other primaries to the working (BT.709) ones.
PRIMARIES = {
    "bt709": ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)),
    "display_p3": ((1.224940, -0.224940, 0.0), (-0.042056, 1.042056, 0.0), (-0.019637, -0.078636, 1.098273)),
    "bt2020": ((1.660491, -0.587641, -0.072850), (-0.124551, 1.132900, -0.008349), (-0.018151, -0.100579, 1.118730)),
}
TRANSFERS = ("srgb", "bt709", "linear", "bt2020_pq")


def is_canonical(transfer: str, primaries: str) -> bool:
    return transfer in ("srgb", "bt709") and primaries == "bt709"
