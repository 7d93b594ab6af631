"""Projective texturing: every vertex gets an atlas coordinate, a marked one if it is hidden, or none if behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import camera
from tessera.operators.tsdf import FrameFacts, tap, with_tiles
from tessera.operators.volume import held


def with_surface_depth(rows: DataFrame, pixels: DataFrame, cameras: DataFrame, facts: FrameFacts, threshold: float) -> DataFrame:
    """Adds _d, the depth at (_u, _v) with pixel centres at whole numbers: empty taps drop out, a jump takes the heaviest tap, no tap gives 0."""
    c = F.col
    w, h = c("width"), c("height")
    at = held(rows, cu=F.greatest(F.lit(0.0), F.least("_u", w - 1.0)), cv=F.greatest(F.lit(0.0), F.least("_v", h - 1.0)))
    at = held(at, x0=F.floor("cu").cast("int"), y0=F.floor("cv").cast("int"), wx=c("cu") - F.floor("cu"), wy=c("cv") - F.floor("cv"))
    at = with_tiles(at, pixels, cameras, facts)
    x1, y1, px, py = F.least(c("x0") + 1, w - 1), F.least(c("y0") + 1, h - 1), c("wx"), c("wy")
    spots = [(c("x0"), c("y0"), (1 - px) * (1 - py)), (x1, c("y0"), px * (1 - py)), (c("x0"), y1, (1 - px) * py), (x1, y1, px * py)]
    taps = held(at, **{f"t{i}": tap(x, y) for i, (x, y, _) in enumerate(spots)}, **{f"k{i}": k for i, (_, _, k) in enumerate(spots)})
    good = [(c(f"t{i}"), c(f"k{i}"), (c(f"t{i}") > 0) & ~F.isnan(f"t{i}")) for i in range(4)]
    total = sum((F.when(ok, k).otherwise(0.0) for _, k, ok in good), F.lit(0.0))
    blend = sum((F.when(ok, k * d).otherwise(0.0) for d, k, ok in good), F.lit(0.0))
    sums = held(taps, total=total, blend=blend, low=F.least(*[F.when(ok, d) for d, _, ok in good]), high=F.greatest(*[F.when(ok, d) for d, _, ok in good]), most=F.greatest(*[F.when(ok, k).otherwise(F.lit(-1.0)) for _, k, ok in good]))
    near = F.coalesce(*[F.when(ok & (k == c("most")), d) for d, k, ok in good])
    depth = F.when(c("total") <= 0, F.lit(0.0)).when(c("high") - c("low") > threshold, near).otherwise(c("blend") / F.when(c("total") > 0, c("total")).otherwise(1.0))
    return held(sums, _d=depth).select(*rows.columns, "_d")


def texture(mesh: DataFrame, pixels: DataFrame, cameras: DataFrame, frame_id: int, threshold: float = 0.02) -> DataFrame:
    """The vertices with uv_u, uv_v rewritten from one frame: uv if visible, -uv - 1 if only in front, (-1, -1) otherwise."""
    chosen = cameras.where(F.col("frame_id") == frame_id)
    own = ("fx", "fy", "cx", "cy")  # a mesh has columns of these names
    facts = FrameFacts.of(chosen)
    frame = chosen.withColumnsRenamed({n: f"lens_{n}" for n in own})
    keep = [c for c in mesh.columns if c not in ("uv_u", "uv_v")]
    joined = mesh.select(*keep).withColumn("frame_id", F.lit(frame_id).cast(dict(cameras.dtypes)["frame_id"])).join(facts.send(frame), "frame_id")
    c = F.col
    x, y, z = camera.to_camera(c("px"), c("py"), c("pz"), c("pose"))
    u, v, zc = camera.on_image(c("_x"), c("_y"), c("_z"), lambda n: c(f"lens_{n}" if n in own else n))
    placed = held(held(joined, _x=x, _y=y, _z=z), _u=u, _v=v)
    inset = (c("_u") >= 1) & (c("_u") < c("width") - 1) & (c("_v") >= 1) & (c("_v") < c("height") - 1)
    seen = with_surface_depth(placed, pixels.where(F.col("frame_id") == frame_id), chosen, facts, threshold)
    visible = F.coalesce(inset & (c("_d") >= c("min_depth")) & (c("_d") <= c("max_depth")) & (F.abs(c("_d") - c("_z")) <= threshold), F.lit(False))
    out = []
    for name, p, size in (("uv_u", "_u", "width"), ("uv_v", "_v", "height")):
        uv = camera.atlas_uv(c(p), c(size))
        out.append(F.when(c(p).isNull() | F.isnan(p), F.lit(-1.0)).when(visible, uv).otherwise(-uv - 1.0).alias(name))
    return seen.select(*keep, *out, visible.alias("visible"))
