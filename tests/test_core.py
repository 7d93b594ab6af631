import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import color, coords, cube
from tessera.operators import mesh, metrics, texture, tsdf, volume
from tessera.params import Camera, GridParams, ParameterError, pinhole_planes, projection_planes, registered_depth
from tessera.sources import ply, scene
from tessera.streaming import fuse

CAMERA = "frame_id int, fx double, fy double, cx double, cy double, width int, height int, pose array<double>, min_depth double, max_depth double"


def camera_row(spark, frame, k: Camera):
    return spark.createDataFrame([(frame, *map(float, (k.fx, k.fy, k.cx, k.cy)), k.width, k.height, list(k.pose), float(k.min_depth), float(k.max_depth))], CAMERA)


def flat(spark, frame, width, height, depth):
    return spark.range(width * height).select(F.lit(frame).alias("frame_id"), (F.col("id") % width).cast("int").alias("u"), F.floor(F.col("id") / width).cast("int").alias("v"), F.lit(depth).alias("depth"))


def test_grid_rules():
    assert GridParams().num_blocks == 1_500_000 and GridParams().band == 1
    assert [GridParams(trunc_dist=t).band for t in (0.04, 0.10)] == [1, 3]
    for bad in ({"block_size": 2048}, {"block_size": 1291}, {"num_buckets": 0}, {"voxels_per_block": 7}, {"bucket_size": 1}, {"max_chain": 0}, {"voxel_size": 0.0}, {"trunc_dist": math.nan}, {"num_blocks": 3}):
        with pytest.raises(ParameterError):
            GridParams(**bad)
    with pytest.raises(ParameterError):
        GridParams().grown(30000)


def test_coordinates(spark):
    g = GridParams(voxel_size=0.5)
    rows = spark.createDataFrame([(x,) for x in (0.25, 0.75, 1.25, -0.25, -0.75)], "x double").select(coords.world_to_voxel(F.col("x"), g).alias("v")).collect()
    assert [r["v"] for r in rows] == [0, 2, 2, 0, -2]
    rows = spark.createDataFrame([(v,) for v in (-1, -8, -9, 7, 8)], "v int").select(coords.voxel_to_block(F.col("v"), g).alias("b")).collect()
    assert [r["b"] for r in rows] == [-1, -1, -2, 0, 1]
    axes = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], "x int, y int, z int")
    got = [r["h"] for r in axes.select(coords.spatial_hash(F.col("x"), F.col("y"), F.col("z"), 30000).alias("h")).collect()]
    assert got == [0, 26093, 29669, 2791]


def test_frusta(spark):
    g = GridParams()
    blocks = spark.createDataFrame([(0, 0, 25), (14, 0, 25), (0, 0, 120), (0, 0, -25), (0, 0, 200), (100, 0, 25)], "bx int, by int, bz int")
    planes = pinhole_planes(Camera(100, 100, 50, 50, 100, 100), 0.1, 5.0)
    got = {tuple(r) for r in volume.compact_in_frustum(blocks, planes, g).collect()}
    assert got == {(0, 0, 25), (14, 0, 25), (0, 0, 120)}
    assert volume.compact_in_frustum(blocks, projection_planes((0.0,) * 16, 1.0), g).count() == 6


def test_registered_camera():
    k = registered_depth(Camera(1440, 1440, 959.5, 719.5, 1920, 1440), 256, 192, 0.1, 10)
    assert (k.cx, k.cy, k.fx) == pytest.approx((127.5, 95.5, 192))
    with pytest.raises(ParameterError):
        registered_depth(Camera(1, 1, 0, 0, 0, 1), 2, 2, 0.1, 1)


def test_colors(spark):
    codes = spark.range(256).select((F.col("id") * 65793).alias("p"))
    again = codes.select("p", color.pack_linear(*color.unpack_linear(F.col("p"))).alias("q")).collect()
    assert all(r["q"] == r["p"] | 0xFF000000 for r in again)
    with pytest.raises(NotImplementedError):
        color.to_canonical(codes.limit(0), "bt2020_pq", "bt709", "p")


def test_plane_is_fused(spark):
    """A wall half a metre off: voxels before and behind it, and the weight cap on a second frame."""
    g = GridParams()
    blocks = spark.createDataFrame([(0, 0, z) for z in range(11, 15)], "bx int, by int, bz int")
    k = Camera(525, 525, 320, 240, 640, 480)
    fused = tsdf.fuse(blocks, flat(spark, 0, 640, 480, 0.5), camera_row(spark, 0, k), g)
    at = {r["bz"] * 8 + r["local"] // 64: (r["tsdf"], r["weight"]) for r in fused.where("local % 64 = 0").collect()}
    assert at[97] == pytest.approx((0.015, 1 / 0.485**2), rel=1e-3)
    assert at[104] == pytest.approx((-0.02, 0.5 / 0.52**2), rel=1e-3)
    assert 110 not in at
    again = tsdf.fuse(blocks, flat(spark, 0, 640, 480, 0.5), camera_row(spark, 0, k), g, start=fused)
    near = again.where("bz = 12 and local = 64").first()
    assert near["weight"] == 5.0 and near["tsdf"] == pytest.approx(0.015, rel=1e-3)


def test_cases_follow_the_rule():
    counts = {}
    for case, t, *edges in cube.triangles():
        counts[case] = counts.get(case, 0) + 1
        for e in edges:
            a, b = cube.EDGES[e]
            assert (case >> a & 1) != (case >> b & 1)
    assert sum(counts.values()) == 820 and max(counts.values()) == 5
    assert [r[2:] for r in cube.triangles() if r[0] == 1] == [(0, 8, 3)] and counts[5] == 2 and counts[250] == 4


def sphere(spark, n=48, pitch=0.05, radius=0.7):
    i = spark.range(n**3).select((F.col("id") % n).cast("int").alias("x"), (F.floor(F.col("id") / n) % n).cast("int").alias("y"), F.floor(F.col("id") / (n * n)).cast("int").alias("z"))
    mid = (n - 1) / 2
    r = F.sqrt(sum((((F.col(a) - mid) * pitch) ** 2 for a in "xyz"), F.lit(0.0)))
    return i.select("x", "y", "z", (r - radius).alias("sdf"), F.lit(1.0).alias("weight")), mid * pitch


def test_sphere_dense_and_sparse(spark):
    samples, mid = sphere(spark)
    soup = mesh.extract_dense(samples, 0.05).toPandas()
    assert len(soup) > 1500
    p = soup[["px", "py", "pz"]].to_numpy() - mid
    radius = (p**2).sum(axis=1) ** 0.5
    assert abs(radius - 0.7).max() < 0.075 and abs(radius.mean() - 0.7) < 0.0125
    out = (soup[["nx", "ny", "nz"]].to_numpy() * p).sum(axis=1) / radius
    assert out.min() > 0.5 and out.mean() > 0.9
    soup = soup.sort_values(["cx", "cy", "cz", "t", "k"])
    t = (soup[["px", "py", "pz"]].to_numpy() - mid).reshape(-1, 3, 3)
    facing = (np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]) * t.mean(axis=1)).sum(axis=1) > 0
    assert facing.mean() > 0.95
    g = GridParams(voxel_size=0.05, block_size=8, trunc_dist=0.2)
    voxels = samples.select(*[F.floor(F.col(a) / 8).cast("int").alias(f"b{a}") for a in "xyz"], (F.col("x") % 8 + 8 * (F.col("y") % 8) + 64 * (F.col("z") % 8)).cast("int").alias("local"), F.col("sdf").alias("tsdf"), "weight", F.lit(0).cast("long").alias("color"))
    sparse = mesh.extract(voxels, g).toPandas()
    key = ["cx", "cy", "cz", "t", "k"]
    assert (sparse.sort_values(key)[["px", "py", "pz"]].to_numpy() == soup.sort_values(key)[["px", "py", "pz"]].to_numpy()).all()
    verts, corners = mesh.shared(mesh.sparse_cells(voxels, g), g)
    assert corners.count() == len(soup) and verts.count() < len(soup) / 2


def test_texture_states(spark):
    k = Camera(500, 500, 320, 240, 640, 480)
    verts = spark.createDataFrame([("a", 0.0, 0.0, 1.0), ("b", 0.1, 0.0, 2.0), ("c", 0.0, 0.0, -1.0)], "name string, px double, py double, pz double")
    got = {r["name"]: (r["uv_u"], r["uv_v"]) for r in texture.texture(verts, flat(spark, 0, 640, 480, 1.0), camera_row(spark, 0, k), 0).collect()}
    uv = (320.5 / 640, 240.5 / 480)
    assert got["a"] == pytest.approx(uv) and got["c"] == (-1.0, -1.0)
    assert got["b"] == pytest.approx((-(345.5 / 640) - 1, -uv[1] - 1))


def test_volume_versions(spark):
    v = volume.Snapshot(spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "bx int, by int, bz int"))
    w = volume.remove(v, spark.createDataFrame([(1, 0, 0), (9, 9, 9)], "bx int, by int, bz int"))
    assert w.version == 2 and w.blocks.count() == 1 and volume.clear(w).version == 3
    with pytest.raises(ParameterError):
        volume.block_list(w, v.blocks, 1)


def test_attributes(spark):
    made = spark.createDataFrame([], volume.attributes([("tsdf", "double"), ("color", "long")]))
    assert volume.has_attribute(made, "color") and not volume.has_attribute(made, "bx")
    for bad in ([("", "int")], [("a", "")], [("a", "int"), ("a", "int")], [("local", "int")]):
        with pytest.raises(ParameterError):
            volume.attributes(bad)


def test_stages(spark):
    s = metrics.Stages()
    with s.stage("fuse"), s.stage("decode"):
        pass
    assert list(s.rows) == ["fuse", "  ..decode"]
    assert metrics.totals(s.frame(spark)).first()["total_cpu_ms"] == pytest.approx(s.rows["fuse"])


def test_ply(spark, tmp_path):
    samples, _ = sphere(spark, 12, 0.2)
    soup = mesh.extract_dense(samples, 0.2)
    n = ply.write_ply(soup, str(tmp_path / "m.ply"))
    assert ply.read_ply_counts(str(tmp_path / "m.ply")) == (3 * n, n)


def png16(rows, kind=0):
    h, w = len(rows), len(rows[0])
    lines, last = b"", [0] * (2 * w)
    for row in rows:
        now = [b for v in row for b in (v >> 8, v & 255)]
        code = {0: now, 1: [(b - (now[i - 2] if i > 1 else 0)) & 255 for i, b in enumerate(now)], 2: [(b - last[i]) & 255 for i, b in enumerate(now)]}[kind]
        lines, last = lines + bytes([kind, *code]), now
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_scene(spark, tmp_path):
    rows = [[1000, 2000, 65535], [0, 300, 7]]
    for i, kind in enumerate((0, 1, 2)):
        assert scene.decode_depth(png16(rows, kind)).tolist() == rows
        (tmp_path / f"depth{i:06d}.png").write_bytes(png16(rows, kind))
    got = scene.depth_pixels(spark, str(tmp_path), 1000.0, 3, 2, stride=2)
    assert got.count() == 12 and got.where("frame_id = 2 and u = 1 and v = 0").first()["depth"] == pytest.approx(2.0)
    (tmp_path / "cam.json").write_text('{"fx": 1, "fy": 2, "cx": 0, "cy": 0, "w": 3, "h": 2, "scale": 1000}')
    assert scene.intrinsics(spark, str(tmp_path / "cam.json"))["fy"] == 2
    line = " ".join(str(float(i)) for i in range(16))
    (tmp_path / "traj.txt").write_text(f"{line}\n{line}\n\n")
    assert scene.trajectory(spark, str(tmp_path / "traj.txt")).first()["pose"][1] == 4.0
    for bad in (f"{line}\n\n{line}\n", "1 2 3\n", ""):
        (tmp_path / "bad.txt").write_text(bad)
        with pytest.raises(ParameterError):
            scene.trajectory(spark, str(tmp_path / "bad.txt"))


def test_stream_equals_batch(spark, tmp_path):
    g = GridParams(voxel_size=0.0625, block_size=8, trunc_dist=0.25, bucket_size=4, num_buckets=64)
    rows = [(0, 0, 0, v, f, 0.01 * ((v * 7 + f * 3) % 11) - 0.05, 1.0 + f, False) for f in range(4) for v in range(20)]
    schema = "bx int, by int, bz int, local int, frame_id int, sdf double, w_obs double, clear boolean"
    for f in range(4):
        spark.createDataFrame([r for r in rows if r[4] == f], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = fuse.start_fusion(stream, str(tmp_path / "out"), g).trigger(availableNow=True).start()
    q.awaitTermination()
    key = ["bx", "by", "bz", "local"]
    got = fuse.current(spark, str(tmp_path / "out"), 4).select(*key, "tsdf", "weight").orderBy(key).collect()
    want = tsdf.fold(spark.createDataFrame(rows, schema), g).select(*key, "tsdf", "weight").orderBy(key).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
