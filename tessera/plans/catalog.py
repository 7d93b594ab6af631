"""Registry of the engine's own queries: each runs one operator over whole tables, with an independent SQL oracle."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tessera.functions import camera as cam
from tessera.functions import color, coords
from tessera.operators import mesh, metrics, texture, tsdf, volume
from tessera.params import Camera, pinhole_planes, projection_planes, registered_depth
from tessera.plans import oracles
from tessera.plans.inputs import GRID, HEIGHT, ORDERS, WIDTH, camera, cameras, color_pixels, last_frame, load, pixels, points
from tessera.sources import ply, scene

G = GRID
c = F.col
VIEW_PROJECTION = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.25, 1.0, 0.0, 0.0, -0.625, 0.0)
_REGISTRY = {}


def query(f):
    _REGISTRY[f.__name__] = f
    return f


def r6(x):
    """Six decimals by plain arithmetic, which every engine does alike."""
    return F.floor(x * 1000000.0 + 0.5).cast("double") / 1000000.0


@query
def world_to_voxel(spark, d):
    return points(spark, d).select("l_orderkey", "l_linenumber", *[coords.world_to_voxel(c(a), G).alias(f"v{a}") for a in "xyz"])


@query
def voxel_to_block(spark, d):
    v = world_to_voxel(spark, d)
    b = v.select("*", *[coords.voxel_to_block(c(f"v{a}"), G).alias(f"b{a}") for a in "xyz"])
    return b.select("l_orderkey", "l_linenumber", *volume.KEY, *[coords.block_to_world(c(k), G).alias(f"o{k}") for k in volume.KEY], coords.pack_block(*[c(k) for k in volume.KEY]).alias("packed"))


@query
def spatial_hash(spark, d):
    b = voxel_to_block(spark, d)
    return b.groupBy(coords.spatial_hash(c("bx"), c("by"), c("bz"), 30000).alias("bucket")).agg(F.count("*").alias("n"))


@query
def unproject_pixels(spark, d):
    return volume.surface_points(pixels(spark, d), cameras(spark, d))


@query
def project_points(spark, d):
    p = points(spark, d).withColumn("frame_id", F.floor(c("l_orderkey") / ORDERS).cast("int")).join(cameras(spark, d), "frame_id")
    u, v, zc = cam.project(c("x"), c("y"), c("z"), c)
    return p.select("*", u.alias("u"), v.alias("v"), zc.alias("zc")).where(cam.in_image(c("u"), c("v"), c)).select("l_orderkey", "l_linenumber", "frame_id", r6(c("u")).alias("u"), r6(c("v")).alias("v"), "zc")


@query
def srgb_roundtrip(spark, d):
    p = load(spark, d, "part").select("p_partkey", (c("p_partkey") * 65537 % 16777216).cast("long").alias("packed"))
    lin = color.unpack_linear(c("packed"))
    return p.select("p_partkey", color.pack_linear(*lin).alias("again"), *[r6(x).alias(n) for x, n in zip(lin, "rgb", strict=True)])


@query
def to_canonical(spark, d):
    p = load(spark, d, "part").select("p_partkey", (c("p_partkey") * 65537 % 16777216).cast("long").alias("color"))
    return color.to_canonical(color.to_canonical(p, "srgb", "bt709", out="canonical"), "linear", "bt709", out="from_linear").drop("color")


@query
def primaries_rotate(spark, d):
    p = load(spark, d, "part").select("p_partkey", (c("p_partkey") * 65537 % 16777216).cast("long").alias("color"))
    return color.to_canonical(color.to_canonical(p, "srgb", "display_p3", out="from_p3"), "srgb", "bt2020", out="from_2020").drop("color")


@query
def pose_gl_to_cv(spark, d):
    return cameras(spark, d).select("frame_id", F.posexplode(cam.gl_to_cv(c("pose"))).alias("place", "value"))


@query
def registered_depth_camera(spark, d):
    k = registered_depth(Camera(1440.0, 1440.0, 959.5, 719.5, 1920, 1440), 256, 192, 0.1, 10.0)
    return spark.range(1).select(F.lit(k.fx).alias("fx"), F.lit(k.fy).alias("fy"), F.lit(k.cx).alias("cx"), F.lit(k.cy).alias("cy"), F.lit(k.width).alias("width"), F.lit(k.height).alias("height"))


@query
def allocate_from_coords(spark, d):
    return volume.allocate_from_coords(voxel_to_block(spark, d))


@query
def allocate_from_points(spark, d):
    return volume.allocate_from_points(points(spark, d), G)


def _blocks(spark, d):
    return volume.allocate_from_depth(pixels(spark, d), cameras(spark, d), G)


@query
def allocate_from_depth(spark, d):
    return _blocks(spark, d)


@query
def truncation_band(spark, d):
    b = voxel_to_block(spark, d).select(*volume.KEY).distinct()
    return volume.dilate(b, 2)


@query
def compact_active(spark, d):
    return volume.insert(allocate_from_points(spark, d), _blocks(spark, d))


@query
def compact_frustum(spark, d):
    return volume.compact_in_frustum(compact_active(spark, d), pinhole_planes(camera(1), 0.5, 2.5), G)


@query
def compact_frustum_viewproj(spark, d):
    return volume.compact_in_frustum(compact_active(spark, d), projection_planes(VIEW_PROJECTION, 0.125), G)


def _gone(df):
    return df.where((c("bx") + c("by") + c("bz")) % 3 == 0)


@query
def remove_blocks(spark, d):
    v = volume.Snapshot(_blocks(spark, d))
    return volume.remove(v, _gone(compact_active(spark, d))).blocks.select(*volume.KEY)


@query
def clear_grid(spark, d):
    v = volume.clear(volume.Snapshot(_blocks(spark, d)))
    return v.blocks.agg(F.count("*").alias("n"), F.lit(v.version).cast("long").alias("version"))


@query
def resize_noop(spark, d):
    v, g = volume.resize(volume.Snapshot(_blocks(spark, d)), G, 128)
    return v.blocks.agg(F.count("*").alias("n"), F.lit(g.num_blocks).cast("long").alias("capacity"), F.lit(v.version).cast("long").alias("version"))


@query
def load_factor(spark, d):
    return volume.diagnostics(_blocks(spark, d), G).select("load_factor", "grow")


@query
def hash_diagnostics(spark, d):
    return volume.diagnostics(compact_active(spark, d), G)


@query
def alloc_failures(spark, d):
    return volume.alloc_failures(compact_active(spark, d), G)


@query
def block_list_semijoin(spark, d):
    v = volume.Snapshot(_blocks(spark, d))
    return volume.block_list(v, allocate_from_points(spark, d), v.version).select(*volume.KEY)


@query
def block_lookup(spark, d):
    held = _blocks(spark, d).withColumn("held", F.lit(1))
    return volume.lookup(allocate_from_points(spark, d), held).groupBy(F.col("held").isNotNull().alias("found")).agg(F.count("*").alias("n"))


def _seen(spark, d, mode="classic"):
    return tsdf.observations(_blocks(spark, d), pixels(spark, d), cameras(spark, d), G, mode)


@query
def tsdf_observation(spark, d):
    return _seen(spark, d).select(*tsdf.VOXEL, "frame_id", r6(c("sdf")).alias("sdf"), r6(c("w_obs")).alias("w_obs"))


@query
def tsdf_depth_bilinear(spark, d):
    return _seen(spark, d).select(*tsdf.VOXEL, "frame_id", r6(c("depth")).alias("depth"))


def _fused(spark, d, mode="classic"):
    return tsdf.fold(_seen(spark, d, mode), G, 5.0)


@query
def tsdf_fuse_classic(spark, d):
    return _fused(spark, d).select(*tsdf.VOXEL, r6(c("tsdf")).alias("tsdf"), r6(c("weight")).alias("weight"), "changed")


@query
def tsdf_fuse_dynamic(spark, d):
    return _fused(spark, d, "dynamic").select(*tsdf.VOXEL, r6(c("tsdf")).alias("tsdf"), r6(c("weight")).alias("weight"), "changed")


def _colored(spark, d):
    return tsdf.fold(tsdf.observed_colors(_seen(spark, d), color_pixels(spark, d), cameras(spark, d)), G, 5.0)


@query
def tsdf_fuse_color(spark, d):
    return _colored(spark, d).select(*tsdf.VOXEL, r6(c("tsdf")).alias("tsdf"), r6(c("weight")).alias("weight"), "color")


def _last_frame(spark, d, keep_before=False):
    """The field after the last frame, and what that frame changes."""
    return tsdf.fold(_seen(spark, d, "dynamic"), G, 5.0, since=last_frame(spark, d), keep_before=keep_before)


@query
def dirty_blocks(spark, d):
    return tsdf.dirty_blocks(_last_frame(spark, d))


@query
def dirty_block_count(spark, d):
    return dirty_blocks(spark, d).agg(F.count("*").alias("n"))


@query
def remesh_blocks(spark, d):
    return tsdf.remesh_blocks(_blocks(spark, d), dirty_blocks(spark, d))


def _cells(spark, d):
    return mesh.sparse_cells(_colored(spark, d), G)


@query
def mc_cube_index(spark, d):
    return _cells(spark, d).select(*mesh.CELL, "cube_index")


@query
def mc_triangle_count(spark, d):
    return mesh.triangle_counts(_cells(spark, d)).select(*mesh.CELL, "n_triangles")


def _soup(df):
    return df.select(*mesh.CELL, "t", "k", *[r6(c(n)).alias(n) for n in ("px", "py", "pz", "nx", "ny", "nz", "r", "g", "b")])


@query
def mc_edge_vertices(spark, d):
    return mesh.vertices(_cells(spark, d), G.voxel_size).select(*mesh.CELL, "edge", *[r6(c(n)).alias(n) for n in ("px", "py", "pz")]).distinct()


@query
def mc_normals(spark, d):
    return _cells(spark, d).select(*mesh.CELL, *mesh.normal()).select(*mesh.CELL, *[r6(c(n)).alias(n) for n in ("nx", "ny", "nz")])


@query
def mc_sparse(spark, d):
    return _soup(mesh.vertices(_cells(spark, d), G.voxel_size))


@query
def mc_dense(spark, d):
    """A fixed dense grid of 20^3 signed distances to a sphere, of weight 1 and colours by place; no table is read."""
    return _soup(mesh.extract_dense(oracles_dense(spark), 0.0625, 0.0, (0.5, -0.25, 0.125)))


def oracles_dense(spark):
    n = 20
    i = spark.range(n**3).select((c("id") % n).cast("int").alias("x"), (F.floor(c("id") / n).cast("int") % n).alias("y"), F.floor(c("id") / (n * n)).cast("int").alias("z"))
    sphere = (F.pow(c("x") - 9.5, 2.0) + F.pow(c("y") - 10.0, 2.0) + F.pow(c("z") - 10.0, 2.0) - 42.25) / 16.0
    return i.select("x", "y", "z", sphere.alias("sdf"), F.lit(1.0).alias("weight"), ((c("x") * 12).cast("long") + F.shiftleft((c("y") * 12).cast("long"), 8)).alias("color"))


def _roi(spark, d):
    return _blocks(spark, d).where("bx >= 0")


@query
def mc_culled(spark, d):
    return _soup(mesh.extract_culled(_colored(spark, d), _roi(spark, d), G))


@query
def mc_incremental(spark, d):
    """Both fields come from one fold, kept because three steps read it; its pixels are kept too, as the blocks read them beside it."""
    pixels(spark, d).persist()
    after = _last_frame(spark, d, keep_before=True).persist()
    before = after.select(*tsdf.VOXEL, "before.*")
    again = tsdf.remesh_blocks(_blocks(spark, d), tsdf.dirty_blocks(after))
    return _soup(mesh.extract_incremental(mesh.extract(before, G), after, again, G))


@query
def mc_block_spans(spark, d):
    return mesh.block_spans(_cells(spark, d), G)


@query
def mc_shared_vertices(spark, d):
    """The cells are kept, since sharing reads them twice: as they are and as the owners of edges."""
    verts, _ = mesh.shared(_cells(spark, d).persist(), G)
    return verts.select("vx", "vy", "vz", "axis", "own_t", "own_k", *[r6(c(n)).alias(n) for n in ("px", "py", "pz", "nx", "ny", "nz")])


@query
def ply_columns(spark, d):
    """The colour bytes a mesh file gets."""
    return ply.ply_columns(mesh.extract_dense(oracles_dense(spark), 0.0625)).select(*mesh.CELL, "t", "k", "red", "green", "blue")


def _image_files(pixels, value, channels):
    """The frames of a pixel table as PNG files whose lines use all filters in turn; missing pixels are 0."""
    import numpy as np
    import pyarrow as pa

    def encode(table):
        image = np.zeros((HEIGHT, WIDTH), dtype=np.int64)
        u, v, x = (np.asarray(table.column(n).combine_chunks()) for n in ("u", "v", value))
        image[v, u] = x
        samples = image[..., None].astype(np.uint16) if channels == 1 else np.stack([image >> 8 * i & 255 for i in range(3)], axis=2).astype(np.uint8)
        return pa.table({"frame_id": table.column("frame_id")[:1], "content": pa.array([scene.encode_png(samples, (0, 1, 2, 3, 4))], pa.binary())})

    return pixels.select("frame_id", "u", "v", c(value).cast("long").alias(value)).groupBy("frame_id").applyInArrow(encode, "frame_id int, content binary")


@query
def scene_depth_images(spark, d):
    """Depth frames through 16-bit images of 1/1024 metre steps, every second frame."""
    steps = pixels(spark, d).withColumn("depth", c("depth") * 1024)
    return scene.depth_of(_image_files(steps, "depth", 1), 1024.0, WIDTH, HEIGHT, stride=2)


@query
def scene_color_images(spark, d):
    """Colour frames through RGB images, packed and unpacked again."""
    shown = scene.color_of(_image_files(color_pixels(spark, d), "color", 3), WIDTH, HEIGHT)
    return shown.select("frame_id", "u", "v", "color", *[x.cast("int").alias(n) for x, n in zip(scene.unpack_rgba(c("color")), ("red", "green", "blue", "alpha"), strict=True)])


@query
def newest_frames(spark, d):
    """The newest event of every user, as a live capture keeps the newest frame of every source."""
    e = load(spark, d, "events").select(c("user_id").alias("source"), c("event_id").alias("frame_id"))
    return scene.newest(e)


@query
def timestamp_delta(spark, d):
    """Differences of a counter that wraps at 16 bits, in ticks and milliseconds."""
    e = load(spark, d, "events")
    ticks = metrics.timestamp_delta(c("event_id") * 104729, c("event_id") * 7919, 16)
    return e.select("event_id", ticks.alias("ticks"), metrics.ticks_to_ms(ticks, 41.5).alias("ms"))


def _textured(spark, d):
    return texture.texture(mesh.vertices(_cells(spark, d), G.voxel_size), pixels(spark, d), cameras(spark, d), 0, 0.0625)


@query
def texture_project(spark, d):
    return _textured(spark, d).select(*mesh.CELL, "t", "k", r6(c("uv_u")).alias("uv_u"), r6(c("uv_v")).alias("uv_v"))


@query
def texture_visibility(spark, d):
    return _textured(spark, d).groupBy("visible", (c("uv_u") == -1.0).alias("behind")).agg(F.count("*").alias("n"))


def _stage_rows(spark, d):
    e = load(spark, d, "events")
    name = F.when(c("event_id") % 3 == 0, F.concat(F.lit("  .."), c("event_type"))).otherwise(c("event_type"))
    return e.select(name.alias("stage"), (c("event_id") % 16 * 0.25).alias("cpu_ms"), (c("event_id") % 8 * 0.125).alias("gpu_ms"), (c("event_id") % 2 == 0).alias("has_gpu"))


@query
def stage_rows(spark, d):
    return metrics.merge(_stage_rows(spark, d))


@query
def stage_totals(spark, d):
    return metrics.totals(_stage_rows(spark, d), "click")


@query
def fuse_report(spark, d):
    out = metrics.share_report(tsdf.marked_blocks(_blocks(spark, d), dirty_blocks(spark, d)), 4, 2.0)
    return out.select("active", "dirty", "remesh", *[r6(c(n)).alias(n) for n in ("dirty_pct", "remesh_pct", "dilation", "fps")])


def flagship(spark, sf_dir):
    """Depth frames to blocks to a fused field, summed up per block."""
    return _fused(spark, sf_dir).groupBy(*volume.KEY).agg(F.count("*").alias("voxels"), F.min("tsdf").alias("least"), F.max("weight").alias("most_weight"))


def queries():
    return dict(_REGISTRY)


@functools.cache
def oracle_sql():
    return oracles.build()
