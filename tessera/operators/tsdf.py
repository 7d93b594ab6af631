"""Fusion of depth frames into truncated signed distances: one row per voxel and frame that sees it, folded in frame order."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import camera, color, coords
from tessera.operators.volume import KEY, SMALL_ROWS, Snapshot, held, said
from tessera.params import GridParams, ParameterError, is_canonical

VOXEL = (*KEY, "local")
MODES = ("classic", "dynamic")
#: Edge of an image tile; tiles overlap by one pixel to the right and below, so the four taps of a place lie in one.
TILE = 64
#: Cells of all images up to which their tiles are sent to every task (8 bytes each, so 32 MB); beyond, rows meet them by (frame, tile).
BROADCAST_CELLS = 4_000_000


@dataclass(frozen=True)
class FrameFacts:
    """What plans need to know of a camera table: whether it is small, the cells of all its images, its farthest depth."""

    small: bool
    cells: int
    reach: float

    @staticmethod
    def of(cameras: DataFrame) -> FrameFacts:
        far = F.max("max_depth") if "max_depth" in cameras.columns else F.lit(None).cast("double")
        n, cells, reach = cameras.agg(F.count("*"), F.sum(F.col("width").cast("long") * F.col("height")), far).first()
        return FrameFacts(n <= SMALL_ROWS, cells or 0, reach or 0.0)

    def send(self, cameras: DataFrame) -> DataFrame:
        return F.broadcast(cameras) if self.small else cameras


def voxels(blocks: DataFrame, g: GridParams, *keep: str) -> DataFrame:
    """One row per voxel with its world position (x, y, z) and the columns `keep`."""
    out = blocks.select(*keep, *KEY, F.explode(F.sequence(F.lit(0), F.lit(g.voxels_per_block - 1))).alias("local"))
    parts = coords.local_parts(F.col("local"), g)
    return out.select(*keep, *VOXEL, *[coords.voxel_to_world(F.col(k) * g.block_size + p, g).alias(a) for a, k, p in zip(coords.AXES, KEY, parts, strict=True)])


def tiles(pixels: DataFrame, cameras: DataFrame, facts: FrameFacts, value: str = "depth") -> DataFrame:
    """(frame_id, tile_x, tile_y, img): row-major tiles of TILE + 1 pixels a side with a pixel inside the image; other pixels are 0, and of repeated ones the largest counts."""
    side = TILE + 1
    sizes = cameras.select("frame_id", "width", "height")
    inside = pixels.join(facts.send(sizes), "frame_id").where("u >= 0 and v >= 0 and u < width and v < height")
    given = inside.groupBy("frame_id", "u", "v").agg(F.max(value).alias("value"))
    # A pixel on the first column or row of a tile is also the last of the tile before.
    def tiles_of(p: str) -> Column:
        tile = F.floor(F.col(p) / TILE).cast("int")
        return F.explode(F.when(F.col(p) % TILE == 0, F.array(tile, tile - 1)).otherwise(F.array(tile)))

    placed = given.withColumn("tile_x", tiles_of("u")).withColumn("tile_y", tiles_of("v"))
    cell = ((F.col("v") - F.col("tile_y") * TILE) * side + F.col("u") - F.col("tile_x") * TILE).cast("int")
    # The list of given cells in order, with the gaps before, between and behind them filled by zeros.
    zero = F.lit(0).cast(dict(pixels.dtypes)[value])
    listed = placed.groupBy("frame_id", "tile_x", "tile_y").agg(F.array_sort(F.collect_list(F.struct(cell.alias("i"), F.col("value").alias("x")))).alias("cells"))
    gap = lambda n: F.array_repeat(zero, n)
    start = F.transform("cells", lambda k, n: F.concat(gap(k["i"] - F.when(n > 0, F.get("cells", n - 1)["i"]).otherwise(F.lit(-1)) - 1), F.array(k["x"])))
    last = F.element_at("cells", -1)["i"]
    return listed.select("frame_id", "tile_x", "tile_y", F.concat(F.flatten(start), gap(F.lit(side * side - 1) - last)).alias("img"))


def with_tiles(rows: DataFrame, pixels: DataFrame, cameras: DataFrame, facts: FrameFacts, value: str = "depth") -> DataFrame:
    """Adds img, the tile of the frame that holds pixel (x0, y0), or null where it is all 0, and its place tile_x, tile_y."""
    of = tiles(pixels, cameras, facts, value)
    at = held(rows, tile_x=F.floor(F.col("x0") / TILE).cast("int"), tile_y=F.floor(F.col("y0") / TILE).cast("int"))
    return at.join(F.broadcast(of) if facts.cells <= BROADCAST_CELLS else of, ["frame_id", "tile_x", "tile_y"], "left")


def tap(x: Column, y: Column) -> Column:
    """Image value at a column and row of the image, null outside; the pixel must lie in the row's tile."""
    inside = (x >= 0) & (y >= 0) & (x < F.col("width")) & (y < F.col("height"))
    return F.when(inside, F.coalesce(F.get("img", ((y - F.col("tile_y") * TILE) * (TILE + 1) + x - F.col("tile_x") * TILE).cast("int")), F.lit(0)))


def seeing(blocks: DataFrame, cameras: DataFrame, g: GridParams, facts: FrameFacts | None = None) -> DataFrame:
    """(frame_id, block): the frames that may see a voxel of the block, by their view cones up to the depth range, or
    to column `far` if the cameras have it, and the truncation distance.

    Cones are first dealt to coarse cells, so blocks meet frames by cell and no block meets a frame that looks
    elsewhere; then each block's box is held against the cone's planes. A cell is a quarter of the farthest depth:
    larger ones would let a block meet all frames in a cell, and these grow with the square of its edge.
    """
    c, edge = F.col, g.edge
    facts = facts or FrameFacts.of(cameras)
    per = max(1, math.ceil((facts.reach + g.trunc_dist) / (4 * edge)))  # blocks along a coarse cell
    far = c("far" if "far" in cameras.columns else "max_depth") + g.trunc_dist
    cameras = cameras.repartition(int(cameras.sparkSession.conf.get("spark.sql.shuffle.partitions")), "frame_id")
    turn = lambda a, b, k: [camera.at(c("pose"), i) * a + camera.at(c("pose"), 4 + i) * b + camera.at(c("pose"), 8 + i) * k for i in range(3)]
    zero, one = F.lit(0.0), F.lit(1.0)
    planes = []
    for a, b, k, d in ((c("fx"), zero, c("cx"), zero), (-c("fx"), zero, c("width") - c("cx"), zero), (zero, c("fy"), c("cy"), zero), (zero, -c("fy"), c("height") - c("cy"), zero), (zero, zero, one, zero), (zero, zero, -one, far)):
        n = turn(a, b, k)
        planes.append(F.struct(*[n[i].alias(coords.AXES[i]) for i in range(3)], (d - sum((n[i] * camera.at(c("pose"), 12 + i) for i in range(3)), zero)).alias("d")))
    sides = [((u - c("cx")) / c("fx") * far, (v - c("cy")) / c("fy") * far) for u in (zero, c("width")) for v in (zero, c("height"))]
    corners = [[camera.at(c("pose"), 12 + i) for i in range(3)], *[camera.to_world(x, y, far, c("pose")) for x, y in sides]]
    spans = {k: (F.least(*[p[i] for p in corners]), F.greatest(*[p[i] for p in corners])) for i, k in enumerate(KEY)}
    cones = held(cameras, planes=F.array(*planes), **{f"{k}{end}": F.floor((v[e] + (2 * e - 1) * edge) / (per * edge)).cast("int") for k, v in spans.items() for e, end in enumerate(("_low", "_high"))})
    cells = cones.select("frame_id", "planes", *[f"{k}{end}" for k in KEY for end in ("_low", "_high")])
    for k in KEY:
        cells = cells.withColumn(f"q{k}", F.explode(F.sequence(f"{k}_low", f"{k}_high")))

    def met(rows: DataFrame, low: dict[str, Column], size: float) -> DataFrame:
        """Rows whose box, of this low corner and size, is not wholly outside one plane."""
        reach_of = lambda p, k, a: p[a] * (low[k] + F.when(p[a] >= 0, F.lit(size)).otherwise(F.lit(0.0)))
        return rows.where(F.forall("planes", lambda p: ~(reach_of(p, KEY[0], "x") + reach_of(p, KEY[1], "y") + reach_of(p, KEY[2], "z") + p["d"] < 0)))

    # Boxes are a voxel wider than the voxel centres in them, which covers rounding.
    coarse = met(cells, {k: c(f"q{k}").cast("double") * (per * edge) - g.voxel_size for k in KEY}, per * edge + g.voxel_size)
    cell_of = [F.floor(c(k) / per).cast("int").alias(f"q{k}") for k in KEY]
    pairs = blocks.select(*KEY, *cell_of).join(coarse.select("frame_id", "planes", *[f"q{k}" for k in KEY]), [f"q{k}" for k in KEY])
    return met(pairs, {k: c(k).cast("double") * edge - g.voxel_size for k in KEY}, edge + g.voxel_size).select("frame_id", *KEY)


def deepest(pixels: DataFrame, cameras: DataFrame, facts: FrameFacts) -> DataFrame:
    """The cameras with `far`: no depth of the frame that is in range is beyond it. NaN counts as largest, a missing pixel as 0."""
    most = pixels.groupBy("frame_id").agg(F.max("depth").alias("_most"))
    far = F.least("max_depth", F.greatest(F.lit(0.0), F.col("_most")))
    return cameras.join(F.broadcast(most) if facts.small else most, "frame_id", "left").withColumn("far", far).drop("_most")


#: What a projection needs of a camera, and its pose's numbers as columns.
LENS = ("fx", "fy", "cx", "cy", "width", "height")
_POSE = tuple(f"_m{i}" for i in range(15))


def _lenses(cameras: DataFrame, *more: str) -> DataFrame:
    """Cameras as doubles alone: the lens, columns `more` and the pose's 15 numbers in use."""
    return cameras.select("frame_id", *[F.col(n).cast("double").alias(n) for n in (*LENS, *more)], *[camera.at(F.col("pose"), i).cast("double").alias(m) for i, m in enumerate(_POSE)])


def _numbers(table, *names: str) -> list:
    """Columns as float arrays; null is NaN, which no test lets pass."""
    import numpy as np

    return [np.asarray(table.column(n).to_numpy(zero_copy_only=False), dtype=np.float64) for n in names]


def _project(x, y, z, lens: dict):
    """camera.project in numpy, operation by operation, and whether the place is in the image."""
    import numpy as np

    m = [lens[n] for n in _POSE]
    dx, dy, dz = x - m[12], y - m[13], z - m[14]
    xc, yc, zc = (m[4 * k] * dx + m[4 * k + 1] * dy + m[4 * k + 2] * dz for k in range(3))
    with np.errstate(all="ignore"):
        u, v = lens["fx"] * (xc / zc) + lens["cx"], lens["fy"] * (yc / zc) + lens["cy"]
        return u, v, zc, (zc > 0) & (u >= 0) & (u < lens["width"]) & (v >= 0) & (v < lens["height"])


def _image(table, value: str, width: float, height: float):
    """The pixels of one frame as an array up to the last one given; others are 0, and of repeated ones the largest counts, NaN above all."""
    import numpy as np

    u, v, x = (table.column(n).to_numpy() for n in ("u", "v", value)) if table.num_rows else (np.zeros(0, dtype=np.int64),) * 3
    inside = (u >= 0) & (v >= 0) & (u < width) & (v < height)
    u, v, x = u[inside], v[inside], x[inside]
    out = np.zeros((int(v.max()) + 1, int(u.max()) + 1) if len(u) else (0, 0), dtype=x.dtype)
    order = np.argsort(x, kind="stable")
    out[v[order], u[order]] = x[order]
    return out


def _tap(image, x, y):
    """Image values at whole places inside the image; 0 beyond the last pixel given."""
    import numpy as np

    held = (x < image.shape[1]) & (y < image.shape[0])
    out = np.zeros(len(x), dtype=image.dtype)
    out[held] = image[y[held], x[held]]
    return out


def _depth_at(image, u, v, width, height, t: float):
    """Bilinear depth with pixel centres at halves; the containing pixel where a tap is outside, empty or not finite, or the taps jump."""
    import numpy as np

    d = _tap(image, np.floor(u).astype(np.int64), np.floor(v).astype(np.int64))
    x, y = np.floor(u - 0.5).astype(np.int64), np.floor(v - 0.5).astype(np.int64)
    i = np.flatnonzero((x >= 0) & (y >= 0) & (x + 1 < width) & (y + 1 < height))
    x, y, wx, wy = x[i], y[i], u[i] - 0.5 - x[i], v[i] - 0.5 - y[i]
    d00, d10, d01, d11 = (_tap(image, x + a, y + b) for b in (0, 1) for a in (0, 1))
    four = np.stack([d00, d10, d01, d11])
    with np.errstate(all="ignore"):
        low, high = four.min(axis=0), four.max(axis=0)
        ok = np.isfinite(four).all(axis=0) & (low > 0) & (high - low <= t)
        top, under = d00 * (1 - wx) + d10 * wx, d01 * (1 - wx) + d11 * wx
        d[i[ok]] = (top * (1 - wy) + under * wy)[ok]
    return d


def _given(pixels: DataFrame, value: str) -> DataFrame:
    """Pixels without those that say nothing."""
    return said(pixels.select("frame_id", "u", "v", value), value)


def _shape(*fields: tuple[str, str]) -> tuple[str, object]:
    """A schema for Spark and for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = ", ".join(f"`{n}` {kind}" for n, kind in fields)
    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


#: Blocks whose voxels are held as arrays at once.
AT_ONCE = 256


def observations(blocks: DataFrame, pixels: DataFrame, cameras: DataFrame, g: GridParams, mode: str = "classic") -> DataFrame:
    """(voxel, frame_id, x, y, z, zc, depth, sdf, w_obs, clear): what each frame says of each active voxel.

    Voxels behind the camera, outside the image, without a depth in range or well behind the surface say nothing.
    Before the surface, classic mode clamps and dynamic mode clears. A frame's blocks and pixels meet in one exchange,
    and its voxels are looked at as arrays, some blocks at a time: as generated code the same steps are a method too
    long for the JVM to compile, and their rows would copy the image they are held against.
    """
    if mode not in MODES:
        raise ParameterError("mode is classic or dynamic")
    t, facts, numbers = g.trunc_dist, FrameFacts.of(cameras), (*LENS, "min_depth", "max_depth", *_POSE)
    shown = _given(pixels.withColumn("depth", F.col("depth").cast("double")), "depth")
    pairs = seeing(blocks, deepest(shown, cameras, facts), g, facts).join(facts.send(_lenses(cameras, "min_depth", "max_depth")), "frame_id")
    kinds = dict(pairs.dtypes)
    doubles = ("x", "y", "z", "zc", "depth", "sdf", "w_obs")
    ddl, shape = _shape(*[(k, kinds[k]) for k in KEY], ("local", "int"), ("frame_id", kinds["frame_id"]), *[(n, "double") for n in doubles], ("clear", "boolean"))
    side, count, pitch, dynamic = g.block_size, g.voxels_per_block, g.voxel_size, mode == "dynamic"

    def look(pairs, pixels):
        import numpy as np
        import pyarrow as pa

        if not pairs.num_rows:
            return shape.empty_table()
        image = _image(pixels, "depth", *(np.nanmax(v) for v in _numbers(pairs, "width", "height"))).astype(np.float64, copy=False)
        local, made = np.arange(count), []
        parts = local % side, local // side % side, local // (side * side)
        for at in range(0, pairs.num_rows, AT_ONCE):
            some = pairs.slice(at, AT_ONCE).combine_chunks()
            lens = {n: v[:, None] for n, v in zip(numbers, _numbers(some, *numbers), strict=True)}
            place = [(some.column(k).to_numpy().astype(np.int64)[:, None] * side + p).astype(np.float64) * pitch for k, p in zip(KEY, parts, strict=True)]
            u, v, zc, inside = _project(*place, lens)
            row, voxel = np.nonzero(inside)
            u, v, zc = u[inside], v[inside], zc[inside]
            width, height, least, most = (lens[n][row, 0] for n in ("width", "height", "min_depth", "max_depth"))
            d = _depth_at(image, u, v, width, height, t)
            with np.errstate(all="ignore"):
                raw = d - zc
                weight = np.where(zc > 0.01, 1.0 / (zc * zc), 1.0) * np.where(zc > d, (t - (zc - d)) / t, 1.0)
                clear = (raw > t) & dynamic
                keep = np.flatnonzero((d >= least) & (d <= most) & (raw >= -t) & (clear | (weight > 0)))
            row, voxel = row[keep], voxel[keep]
            given = some.select([*KEY, "frame_id"]).take(pa.array(row))
            values = [*(p[row, voxel] for p in place), *(x[keep] for x in (zc, d, np.minimum(t, raw), weight, clear))]
            made.append(pa.table([*(given.column(k) for k in KEY), pa.array(voxel.astype(np.int32)), given.column("frame_id"), *map(pa.array, values)], schema=shape))
        return pa.concat_tables(made)

    return pairs.groupBy("frame_id").cogroup(shown.groupBy("frame_id")).applyInArrow(look, ddl)


def observed_colors(seen: DataFrame, color_pixels: DataFrame, color_cameras: DataFrame) -> DataFrame:
    """Adds color_obs: the packed colour at the voxel's pixel of the frame's colour camera, or null."""
    facts, numbers = FrameFacts.of(color_cameras), (*LENS, *_POSE)
    lenses = _lenses(color_cameras).withColumnsRenamed({n: f"_{n}" for n in numbers})
    joined = seen.join(facts.send(lenses), "frame_id", "left").select(*seen.columns, *[f"_{n}" for n in numbers])
    ddl, shape = _shape(*seen.dtypes, ("color_obs", dict(color_pixels.dtypes)["color"]))

    def look(seen, pixels):
        import numpy as np
        import pyarrow as pa

        if not seen.num_rows:
            return shape.empty_table()
        lens = dict(zip(numbers, _numbers(seen, *[f"_{n}" for n in numbers]), strict=True))
        u, v, _, inside = _project(*_numbers(seen, "x", "y", "z"), lens)
        color = pa.nulls(seen.num_rows, shape.field("color_obs").type)
        if inside.any():
            image = _image(pixels, "color", lens["width"][inside].max(), lens["height"][inside].max())
            found = np.zeros(len(u), dtype=np.int64)
            found[inside] = _tap(image, np.floor(u[inside]).astype(np.int64), np.floor(v[inside]).astype(np.int64))
            color = pa.array(found, mask=~inside).cast(color.type)
        return pa.table([*(seen.column(n) for n in shape.names[:-1]), color], schema=shape)

    return joined.groupBy("frame_id").cogroup(_given(color_pixels, "color").groupBy("frame_id")).applyInArrow(look, ddl)


def _let(value: Column, f) -> Column:
    """f(value) with the value found once. Inside a fold nothing else is shared: an expression is found anew wherever it is named."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _blend(old: Column, new: Column, w_old: Column, w_obs: Column) -> Column:
    """Mean of two packed colours in linear light, encoded again at once."""
    a, b = color.unpack_linear(old), color.unpack_linear(new)
    total = F.greatest(w_old + w_obs, F.lit(1e-6))
    mixed = F.array(*[(x * w_old + y * w_obs) / total for x, y in zip(a, b, strict=True)])
    return _let(F.transform(mixed, color.to_byte), lambda v: color.pack_bytes(*[F.get(v, F.lit(i)) for i in range(3)]))


def fold(seen: DataFrame, g: GridParams, max_weight: float = 5.0, start: DataFrame | None = None, since=None, keep_before: bool = False) -> DataFrame:
    """(voxel, tsdf, weight, color, changed): observations folded in frame order onto `start`, or onto nothing.

    The mean uses the uncapped weight, then the weight is capped, so order matters and frames are sorted. A clear
    takes a weighted voxel back to nothing. `changed` tells that some step moved a value, one of a frame from `since` on
    if that is given: as a fold of the earlier frames and one of the later frames onto it would tell, in one pass.
    With `keep_before`, column `before` has tsdf, weight and color after the frames before `since`, of weight 0 where there was none.
    """
    t = g.trunc_dist
    colored = "color_obs" in seen.columns
    shade = F.col("color_obs") if colored else F.lit(None).cast("long")
    # One exchange by block serves the fold and what follows: blocks are whole in a task, so cells are put together before they are dealt out.
    per = seen.repartition(*KEY).groupBy(*VOXEL).agg(F.array_sort(F.collect_list(F.struct("frame_id", "sdf", "w_obs", "clear", shade.alias("c")))).alias("obs"))
    if start is not None:
        per = per.join(start.select(*VOXEL, F.struct(F.col("tsdf").alias("s"), F.col("weight").alias("w"), F.coalesce("color", F.lit(0)).cast("long").alias("c"), F.lit(False).alias("ch")).alias("st")), list(VOXEL), "full")
        per = per.withColumn("obs", F.coalesce("obs", F.array().cast(dict(per.dtypes)["obs"])))
        begin = F.coalesce("st", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("c"), F.lit(False).alias("ch")))
    else:
        begin = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("c"), F.lit(False).alias("ch"))

    def step(a: Column, o: Column) -> Column:
        total = a["w"] + o["w_obs"]
        s = F.greatest(F.lit(-t), F.least(F.lit(t), (a["s"] * a["w"] + o["sdf"] * o["w_obs"]) / F.greatest(total, F.lit(1e-6))))
        w = F.least(total, F.lit(max_weight))
        shade_now = F.when(o["c"].isNull(), a["c"]).when(a["c"] == 0, color.opaque(o["c"])).otherwise(_blend(a["c"], o["c"], a["w"], o["w_obs"])) if colored else a["c"]
        clears = o["clear"] & (a["w"] > 0)
        counts = F.lit(True) if since is None else o["frame_id"] >= F.lit(since)
        moved = lambda n: a["ch"] | counts & ((n["s"] != a["s"]) | (n["w"] != a["w"]) | (n["c"] != a["c"]))
        fused = _let(F.struct(s.alias("s"), w.alias("w"), shade_now.alias("c")), lambda n: F.struct(n["s"].alias("s"), n["w"].alias("w"), n["c"].alias("c"), moved(n).alias("ch")))
        blank = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("c"), (a["ch"] | counts).alias("ch"))
        return F.when(clears, blank).when(o["clear"], a).otherwise(fused)

    names, before = (("s", "tsdf"), ("w", "weight"), ("c", "color")), []
    if keep_before:
        late = lambda o: F.coalesce(o["frame_id"] >= F.lit(since), F.lit(False))
        per = per.select(*VOXEL, F.filter("obs", late).alias("obs"), F.aggregate(F.filter("obs", lambda o: ~late(o)), begin, step).alias("b"))
        begin, before = F.col("b"), [F.struct(*[F.col(f"b.{k}").alias(n) for k, n in names]).alias("before")]
    state = per.select(*VOXEL, *before, F.aggregate("obs", begin, step).alias("r"))
    return state.select(*VOXEL, *[F.col(f"r.{k}").alias(n) for k, n in names], F.col("r.ch").alias("changed"), *[c for c in state.columns if c == "before"])


def check_frames(cameras: DataFrame) -> None:
    """Refuses cameras without an image or with a lens, depth range or pose that cannot project; one small aggregate."""
    c = F.col
    rules = {
        "an image is empty": (c("width") > 0) & (c("height") > 0),
        "a focal length is not positive": coords.finite(c("fx"), c("fy")) & (c("fx") > 0) & (c("fy") > 0),
        "a principal point is not finite": coords.finite(c("cx"), c("cy")),
        "a pose is not 16 finite numbers": (F.size("pose") == 16) & F.forall("pose", lambda v: coords.finite(v)),
    }
    if "min_depth" in cameras.columns:
        rules["a depth range is not 0 <= min < max"] = coords.finite(c("max_depth")) & (c("min_depth") >= 0) & (c("min_depth") < c("max_depth"))
    held_up = cameras.agg(*[F.min(F.coalesce(r, F.lit(False)).cast("int")).alias(str(i)) for i, r in enumerate(rules.values())]).first()
    if bad := [why for why, ok in zip(rules, held_up, strict=True) if ok == 0]:
        raise ParameterError("; ".join(bad))


def fuse(blocks: DataFrame, pixels: DataFrame, cameras: DataFrame, g: GridParams, mode: str = "classic", max_weight: float = 5.0, start: DataFrame | None = None, color_pixels: DataFrame | None = None, color_cameras: DataFrame | None = None, encoding: tuple[str, str] = ("srgb", "bt709")) -> DataFrame:
    """Fuses frames into every active voxel; voxels no frame touched are absent. No active block is no error.

    Cameras that cannot project, a field without tsdf and weight, colour without a camera, and colour that is not in
    the canonical `encoding` (transfer, primaries; see color.to_canonical) are refused.
    """
    check_frames(cameras)
    if start is not None and (lost := {*VOXEL, "tsdf", "weight", "color"} - set(start.columns)):
        raise ParameterError(f"the field lacks {', '.join(sorted(lost))}")
    seen = observations(blocks, pixels, cameras, g, mode)
    if color_pixels is not None:
        if color_cameras is None:
            raise ParameterError("colour pixels need their cameras")
        if not is_canonical(*encoding):
            raise ParameterError("colour is not in the canonical encoding; convert it first")
        check_frames(color_cameras)
        seen = observed_colors(seen, color_pixels, color_cameras)
    return fold(seen, g, max_weight, start)


@dataclass
class DirtyBlocks:
    """Blocks that fusions changed since the last reset, and the volume and epoch they refer to.

    Marks on another volume start afresh. Marks after blocks were removed cannot tell what went with them: from then
    on the set is stale and refused until a reset.
    """

    blocks: DataFrame | None = None
    grid: str | None = None
    epoch: str | None = None
    stale: bool = False

    def reset(self) -> None:
        self.blocks, self.grid, self.epoch, self.stale = None, None, None, False

    def mark(self, volume: Snapshot, fused: DataFrame) -> None:
        """Adds the blocks that a fusion into `volume` changed."""
        if self.grid != volume.grid:
            self.reset()
            self.grid, self.epoch = volume.grid, volume.epoch
        elif self.epoch != volume.epoch:
            self.stale, self.epoch = True, volume.epoch
        changed = dirty_blocks(fused)
        self.blocks = changed if self.blocks is None else self.blocks.union(changed).distinct()

    def count(self) -> int:
        return 0 if self.blocks is None else self.blocks.count()

    def vouched(self, volume: Snapshot) -> bool:
        """Whether the set tells all that changed in the volume as it is."""
        return self.blocks is not None and not self.stale and self.grid == volume.grid and self.epoch == volume.epoch

    def remesh(self, volume: Snapshot) -> DataFrame:
        """The active blocks to mesh again; none if nothing was marked."""
        if self.blocks is None:
            return volume.blocks.select(*KEY).limit(0)
        if self.grid != volume.grid:
            raise ParameterError("the marks belong to another volume")
        if not self.vouched(volume):
            raise ParameterError("blocks were removed since the marks were made: mesh the whole volume, then reset")
        return remesh_blocks(volume.blocks, self.blocks)


def dirty_blocks(fused: DataFrame) -> DataFrame:
    return fused.where("changed").select(*KEY).distinct()


def _readers(dirty: DataFrame) -> DataFrame:
    """The blocks up to one below a dirty block on each axis, once for each of them, and whether it is the block itself (_own)."""
    steps, out = F.array(F.lit(0), F.lit(-1)), dirty.select(*KEY, F.lit(True).alias("_own"))
    for k in KEY:
        out = out.withColumn("_s", F.explode(steps)).withColumn(k, (F.col(k) + F.col("_s")).cast("int")).withColumn("_own", F.col("_own") & (F.col("_s") == 0)).drop("_s")
    return out


def remesh_blocks(blocks: DataFrame, dirty: DataFrame) -> DataFrame:
    """Active blocks whose cells can read a dirty block: those up to one block below it on each axis."""
    return blocks.join(_readers(dirty).select(*KEY).distinct(), list(KEY), "left_semi").select(*KEY)


def marked_blocks(blocks: DataFrame, dirty: DataFrame) -> DataFrame:
    """The distinct active blocks with d = 1 where they are dirty and m = 1 where remesh_blocks has them, else null; `dirty` is read once, so what it is made from runs once."""
    marks = _readers(dirty).groupBy(*KEY).agg(F.max(F.when(F.col("_own"), F.lit(1))).alias("d"), F.lit(1).alias("m"))
    return blocks.select(*KEY).distinct().join(marks, list(KEY), "left")
