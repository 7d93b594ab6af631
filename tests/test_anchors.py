import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import mesh, metrics, texture, tsdf, volume
from tessera.params import Camera, GridParams, ParameterError
from tessera.sources import scene
from tests.test_core import CAMERA, camera_row, flat, sphere

G = GridParams(voxel_size=0.0625, block_size=8, trunc_dist=0.25, bucket_size=4, num_buckets=64)
KEY = "bx int, by int, bz int"


def wall(spark, cut):
    """A field of one signed plane, changed in the blocks of bx >= cut."""
    v = spark.createDataFrame([(x, 0, 0) for x in range(4)], KEY)
    v = v.select("*", F.explode(F.sequence(F.lit(0), F.lit(511))).alias("local"))
    shift = F.when(F.col("bx") >= cut, 0.5).otherwise(0.0)
    return v.select("*", (F.floor(F.col("local") / 64) - 3.5 + shift).alias("tsdf"), F.lit(1.0).alias("weight"), F.lit(0).cast("long").alias("color"), (F.col("bx") >= cut).alias("changed"))


def snapshot(spark, cut=9):
    return volume.Snapshot(spark.createDataFrame([(x, 0, 0) for x in range(4)], KEY), wall(spark, cut))


def rows(df):
    key = ["cx", "cy", "cz", "t", "k"]
    return [tuple(r) for r in df.select(*key, "px", "py", "pz").orderBy(key).collect()]


def test_marks_belong_to_a_volume_and_epoch(spark):
    v, other, dirty = snapshot(spark), snapshot(spark), tsdf.DirtyBlocks()
    assert dirty.count() == 0 and dirty.remesh(v).count() == 0 and v.epoch != other.epoch
    dirty.mark(v, wall(spark, 3))
    dirty.mark(v, wall(spark, 2))
    assert dirty.count() == 2 and {r["bx"] for r in dirty.remesh(v).collect()} == {1, 2, 3}
    with pytest.raises(ParameterError):
        dirty.remesh(other)
    w = volume.remove(v, spark.createDataFrame([(0, 0, 0)], KEY))
    assert (w.grid, w.version) == (v.grid, 2) and w.epoch != v.epoch and volume.resize(w, G, 128)[0].epoch == w.epoch
    with pytest.raises(ParameterError):
        dirty.remesh(w)
    with pytest.raises(ParameterError):
        volume.block_list(other, v.blocks, 1, v.epoch)
    dirty.mark(w, wall(spark, 3))
    assert not dirty.vouched(w)
    with pytest.raises(ParameterError):
        dirty.remesh(w)
    dirty.reset()
    dirty.mark(w, wall(spark, 3))
    assert dirty.vouched(w) and dirty.count() == 1
    dirty.mark(other, wall(spark, 1))
    assert dirty.vouched(other) and dirty.count() == 3


def test_voxels_of_removed_blocks_go(spark):
    w = volume.remove(snapshot(spark), spark.createDataFrame([(1, 0, 0), (7, 7, 7)], KEY))
    assert {r["bx"] for r in w.voxels.select("bx").distinct().collect()} == {0, 2, 3} and volume.clear(w).voxels.count() == 0


def test_changed_blocks_are_meshed_again(spark):
    v = snapshot(spark)
    full, dirty = mesh.extract_volume(v, G), tsdf.DirtyBlocks()
    dirty.mark(v, wall(spark, 3))
    now = volume.Snapshot(v.blocks, wall(spark, 3), v.version, v.grid, v.epoch)
    again = mesh.extract_changed(now, dirty, full, G)
    assert again.incremental and again.remeshed_blocks() == 2
    assert rows(again.triangles) == rows(mesh.extract_volume(now, G).triangles) != rows(full.triangles)
    culled = mesh.extract_volume(v, G, chosen=v.blocks.where("bx < 2"))
    gone = volume.remove(now, spark.createDataFrame([(0, 0, 0)], KEY))
    for before, at in ((None, now), (culled, now), (full, gone), (mesh.extract_volume(snapshot(spark), G), now)):
        got = mesh.extract_changed(at, dirty, before, G)
        assert not got.incremental and got.whole and got.remeshed_blocks() == at.blocks.count()
    assert [r["epoch"] for r in mesh.block_spans(mesh.sparse_cells(v.voxels, G), G, v.epoch).collect()] == [v.epoch] * 4


def test_refusals(spark):
    blocks, pixels = spark.createDataFrame([(0, 0, 8)], KEY), flat(spark, 0, 4, 4, 1.0)
    good = Camera(10, 10, 2, 2, 4, 4)
    tsdf.fuse(blocks, pixels, camera_row(spark, 0, good), G)
    for bad in (Camera(10, 10, 2, 2, 0, 4), Camera(-1, 10, 2, 2, 4, 4), Camera(10, 10, float("nan"), 2, 4, 4), Camera(10, 10, 2, 2, 4, 4, (1.0,) * 15), Camera(10, 10, 2, 2, 4, 4, min_depth=3, max_depth=2)):
        with pytest.raises(ParameterError):
            tsdf.fuse(blocks, pixels, camera_row(spark, 0, bad), G)
    hues = pixels.select("frame_id", "u", "v", F.lit(7).cast("long").alias("color"))
    cameras = camera_row(spark, 0, good)
    for options in ({"mode": "other"}, {"color_pixels": hues}, {"color_pixels": hues, "color_cameras": cameras, "encoding": ("srgb", "display_p3")}, {"start": blocks}):
        with pytest.raises(ParameterError):
            tsdf.fuse(blocks, pixels, cameras, G, **options)
    samples, _ = sphere(spark, 3, 0.5, 0.4)
    for options in ({"pitch": 0.0}, {"pitch": float("nan")}, {"pitch": 0.5, "dims": (3, 3, 1)}, {"pitch": 0.5, "dims": (3, 3, 4)}):
        with pytest.raises(ParameterError):
            mesh.extract_dense(samples, **options)
    assert mesh.extract_dense(samples, 0.5, dims=(3, 3, 3)).count() > 0
    with pytest.raises(ParameterError):
        mesh.shared(mesh.dense_cells(samples), GridParams(block_size=16, bucket_size=4, num_buckets=64))


def slow_observations(blocks, depth, cameras, g):
    """Every voxel against every frame, in numpy."""
    out = {}
    local = np.arange(g.voxels_per_block)
    parts = np.stack([local % 8, local // 8 % 8, local // 64], axis=1)
    for b in blocks:
        world = (np.array(b) * 8 + parts) * g.voxel_size
        for f, k in cameras.items():
            m = np.array(k.pose).reshape(4, 4).T
            p = (world - m[:3, 3]) @ m[:3, :3]
            for i in np.flatnonzero(p[:, 2] > 0):
                u, v = k.fx * p[i, 0] / p[i, 2] + k.cx, k.fy * p[i, 1] / p[i, 2] + k.cy
                if not (0 <= u < k.width and 0 <= v < k.height):
                    continue
                x, y, d = int(np.floor(u - 0.5)), int(np.floor(v - 0.5)), depth[f][int(v), int(u)]
                if 0 <= x and 0 <= y and x + 1 < k.width and y + 1 < k.height:
                    four = depth[f][y : y + 2, x : x + 2]
                    if four.min() > 0 and four.max() - four.min() <= g.trunc_dist:
                        a, c = u - 0.5 - x, v - 0.5 - y
                        d = (four[0, 0] * (1 - a) + four[0, 1] * a) * (1 - c) + (four[1, 0] * (1 - a) + four[1, 1] * a) * c
                z = p[i, 2]
                w = (1 / z**2 if z > 0.01 else 1.0) * ((g.trunc_dist - (z - d)) / g.trunc_dist if z > d else 1.0)
                if k.min_depth <= d <= k.max_depth and d - z >= -g.trunc_dist and w > 0:
                    out[(*b, int(i), f)] = (min(g.trunc_dist, d - z), w)
    return out


@pytest.mark.parametrize("cells", [0, 1 << 30])
def test_observations_against_every_voxel_and_frame(spark, monkeypatch, cells):
    monkeypatch.setattr(tsdf, "BROADCAST_CELLS", cells)
    rnd = np.random.default_rng(3)
    width, height = 150, 70
    cameras, depth = {}, {}
    for f in range(5):
        a, b = rnd.normal(size=(2, 3))
        z = a / np.linalg.norm(a)
        x = np.cross(b, z) / np.linalg.norm(np.cross(b, z))
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = np.stack([x, np.cross(z, x), z], axis=1), rnd.normal(size=3) * 0.4
        cameras[f] = Camera(90.0, 80.0, 60.0 if f else -5.0, 33.0, width, height, tuple(m.T.reshape(-1).tolist()), 0.3, 2.0)
        depth[f] = np.where(rnd.random((height, width)) < 0.1, 0.0, 1.0 + 0.05 * rnd.random((height, width)) + 0.4 * (np.arange(width) > 66))
    blocks = [(x, y, z) for x in range(-3, 3) for y in range(-3, 3) for z in range(-3, 3)]
    table = spark.createDataFrame([(f, u, v, float(depth[f][v, u])) for f in cameras for v in range(height) for u in range(width) if depth[f][v, u]], "frame_id int, u int, v int, depth double")
    shots = spark.createDataFrame([(f, k.fx, k.fy, k.cx, k.cy, k.width, k.height, list(k.pose), k.min_depth, k.max_depth) for f, k in cameras.items()], CAMERA)
    got = {tuple(r)[:5]: (r["sdf"], r["w_obs"]) for r in tsdf.observations(spark.createDataFrame(blocks, KEY), table, shots, G).select("bx", "by", "bz", "local", "frame_id", "sdf", "w_obs").collect()}
    want = slow_observations(blocks, depth, cameras, G)
    assert got.keys() == want.keys() and len(want) > 5000
    assert np.allclose([got[k] for k in want], list(want.values()), rtol=1e-9)


def test_frames_meet_no_block_behind_their_deepest_pixel(spark, monkeypatch):
    met = []
    monkeypatch.setattr(tsdf, "seeing", lambda *a, of=tsdf.seeing: met.append(of(*a)) or met[-1])
    blocks = spark.createDataFrame([(x, y, z) for x in range(-2, 2) for y in range(-2, 2) for z in range(6)], KEY)
    pixels = spark.createDataFrame([(0, u, v, 0.75) for u in range(32) for v in range(24)], "frame_id int, u int, v int, depth double")
    shot = spark.createDataFrame([(0, 32.0, 32.0, 16.0, 12.0, 32, 24, np.eye(4).reshape(-1).tolist(), 0.5, 2.5)], CAMERA)
    seen = tsdf.observations(blocks, pixels, shot, G).agg(F.count("*"), F.max("zc")).first()
    assert seen[0] > 100 and seen[1] < 1.0
    assert met[0].agg(F.max("bz")).first()[0] == 2  # the edge of a block is half a metre, and a voxel is allowed for rounding


def test_observations_of_odd_pixels(spark):
    """Repeated, negative, infinite, NaN and null depths, pixels outside the image, a frame without pixels and zero as a depth in range."""
    rnd = np.random.default_rng(5)
    width, height = 20, 15
    depth = {0: 1.0 + 0.05 * rnd.random((height, width)), 1: np.zeros((height, width))}
    for i, odd in enumerate((-1.0, float("inf"), float("nan"), 0.0)):
        depth[0][3 * i : 3 * i + 2, 4:9] = odd
    cameras = {f: Camera(20.0, 20.0, 10.0, 7.0, width, height, tuple(np.eye(4).reshape(-1).tolist()), 0.0, 2.0) for f in depth}
    rows = [(0, u, v, float(depth[0][v, u])) for v in range(height) for u in range(width)]
    rows += [(0, 12, 2, 0.5), (0, 12, 3, None), (0, width, 0, 1.9), (0, -1, 2, 1.9), (0, 3, height, 1.9), (None, 3, 3, 1.0), (7, 3, 3, 1.0)]
    table = spark.createDataFrame(rows, "frame_id int, u int, v int, depth double")
    shots = spark.createDataFrame([(f, k.fx, k.fy, k.cx, k.cy, k.width, k.height, list(k.pose), k.min_depth, k.max_depth) for f, k in cameras.items()], CAMERA)
    blocks = [(x, y, z) for x in range(-2, 2) for y in range(-2, 2) for z in range(4)]
    got = {tuple(r)[:5]: (r["sdf"], r["w_obs"]) for r in tsdf.observations(spark.createDataFrame(blocks, KEY), table, shots, G).select("bx", "by", "bz", "local", "frame_id", "sdf", "w_obs").collect()}
    want = slow_observations(blocks, depth, cameras, G)
    assert got.keys() == want.keys() and {k[4] for k in want} == {0, 1}
    assert np.allclose([got[k] for k in want], list(want.values()), rtol=1e-9)


def test_changes_since_a_frame_are_told_in_one_fold(spark):
    rnd = np.random.default_rng(2)
    rows = [(0, 0, 0, v, f, float(rnd.choice([-0.125, 0.0, 0.25])), float(rnd.choice([0.5, 4.0])), bool(rnd.random() < 0.3)) for v in range(60) for f in range(5) if rnd.random() < 0.6]
    seen = spark.createDataFrame(rows, KEY + ", local int, frame_id int, sdf double, w_obs double, clear boolean")
    want = tsdf.fold(seen.where("frame_id >= 3"), G, start=tsdf.fold(seen.where("frame_id < 3"), G))
    got = sorted(tuple(r) for r in tsdf.fold(seen, G, since=3).collect())
    assert got == sorted(tuple(r) for r in want.collect()) and {r[-1] for r in got} == {False, True}
    both = tsdf.fold(seen, G, since=3, keep_before=True)
    assert sorted(tuple(r) for r in both.drop("before").collect()) == got
    was = both.select(*tsdf.VOXEL, "before.*").where("weight > 0")
    assert sorted(tuple(r) for r in was.collect()) == sorted(tuple(r) for r in tsdf.fold(seen.where("frame_id < 3"), G).drop("changed").where("weight > 0").collect())


def test_a_query_makes_its_pixels_once(spark):
    from tessera.plans import catalog

    plan = catalog.queries()["tsdf_observation"](spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len([line for line in text.splitlines() if "FileScan" in line and "l_quantity" in line]) == 1


def test_texturing_is_compiled(spark):
    """The JVM leaves methods of over 8000 bytes uncompiled."""
    mesh_of = spark.createDataFrame([(0.0, 0.0, 1.0, -1.0, -1.0)] * 9, "px double, py double, pz double, uv_u double, uv_v double").repartition(2)
    shown = texture.texture(mesh_of, flat(spark, 0, 4, 4, 1.0), camera_row(spark, 0, Camera(10, 10, 2, 2, 4, 4)), 0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = shown.groupBy("visible", "uv_u").count()._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    made = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan).iterator()
    sizes = []
    while made.hasNext():
        sizes.append(made.next()._3().maxMethodCodeSize())
    assert sizes and max(sizes) < 8000


def test_marks_of_one_pass_are_those_of_two(spark):
    blocks = spark.createDataFrame([(x, y, z) for x in range(-2, 3) for y in range(3) for z in range(2)] * 2, KEY)
    dirty = spark.createDataFrame([(0, 1, 1), (1, 1, 1), (2, 0, 0), (2, 0, 0), (9, 9, 9), (3, 3, 2)], KEY)
    want = metrics.fuse_report(blocks, dirty, tsdf.remesh_blocks(blocks, dirty), 4, 2.0).first()
    assert metrics.share_report(tsdf.marked_blocks(blocks, dirty), 4, 2.0).first() == want and (want["active"], want["dirty"], want["remesh"]) == (30, 3, 14)
    none = metrics.share_report(tsdf.marked_blocks(blocks, dirty.limit(0)), 4, 2.0).first()
    assert (none["active"], none["dirty"], none["remesh"], none["dilation"]) == (30, 0, 0, 0.0)


@pytest.mark.parametrize(("name", "step"), [("fuse_report", "observations"), ("mc_incremental", "observations"), ("mc_shared_vertices", "observed_colors")])
def test_a_query_looks_at_its_voxels_once(spark, monkeypatch, tmp_path, name, step):
    """The rows that the step makes are counted where they are made."""
    from tessera.plans import catalog

    told, of = str(tmp_path / "rows"), getattr(tsdf, step)

    def tell(batches):
        for b in batches:
            with open(told, "ab") as f:
                f.write(b"x" * b.num_rows)
            yield b

    def observed(*args):
        rows = of(*args)
        asked.append(rows)
        return rows.mapInArrow(tell, rows.schema)

    asked = []
    monkeypatch.setattr(tsdf, step, observed)
    assert catalog.queries()[name](spark, "/root/testdata/sf0.01").collect()
    assert len(asked) == 1 and os.path.getsize(told) == asked[0].count() > 0


def test_a_fold_finds_a_blend_once(spark):
    """Two shades in, three channels each, and one out: nine powers an observation, which a fold finds as often as they are named."""
    seen = spark.createDataFrame([(0, 0, 0, 0, f, 0.1, 1.0, False, c) for f, c in enumerate((0x3264C8, 20))], KEY + ", local int, frame_id int, sdf double, w_obs double, clear boolean, color_obs long")
    fused = tsdf.fold(seen, G)
    assert fused._jdf.queryExecution().optimizedPlan().toString().lower().count("power(") <= 9
    x, y = (np.array([c >> 8 * i & 255 for i in range(3)]) / 255 for c in (0x3264C8, 20))
    line = lambda e: np.where(e <= 0.04045, e / 12.92, ((e + 0.055) / 1.055) ** 2.4)
    mean = (line(x) + line(y)) / 2
    code = np.floor(np.where(mean <= 0.0031308, mean * 12.92, 1.055 * mean ** (1 / 2.4) - 0.055) * 255 + 0.5).astype(int)
    assert fused.first()["color"] == 0xFF000000 | int(code[0]) | int(code[1]) << 8 | int(code[2]) << 16


def test_images_of_every_filter(tmp_path, spark):
    rnd = np.random.default_rng(1)
    for channels, kind in ((1, np.uint16), (3, np.uint8), (4, np.uint8), (2, np.uint8)):
        image = (rnd.random((11, 9, channels)) * np.iinfo(kind).max).astype(kind)
        assert (scene.decode_png(scene.encode_png(image, (0, 1, 2, 3, 4))) == image).all()
    color = (rnd.random((2, 3, 3)) * 255).astype(np.uint8)
    depth = (rnd.random((2, 3, 1)) * 60000).astype(np.uint16)
    (tmp_path / "frame000000.png").write_bytes(scene.encode_png(color, (4,)))
    (tmp_path / "depth000000.png").write_bytes(scene.encode_png(depth, (3,)))
    (tmp_path / "depth000002.png").write_bytes(b"\x89PNG\r\n\x1a\n broken")
    (tmp_path / "frame000002.png").write_bytes(scene.encode_png(color, (4,)))
    line = " ".join(str(float(i)) for i in range(16))
    (tmp_path / "traj.txt").write_text(f"{line}\n{line}\n{line}\n")
    poses, k = scene.trajectory(spark, str(tmp_path / "traj.txt")), {"w": 3.0, "h": 2.0, "scale": 1000.0}
    got = {(r["u"], r["v"]): (r["depth"], r["color"]) for r in scene.load_frame(spark, str(tmp_path), 0, poses, k).collect()}
    assert got == {(u, v): (depth[v, u, 0] * (1.0 / 1000.0), int(color[v, u, 0]) | int(color[v, u, 1]) << 8 | int(color[v, u, 2]) << 16) for u in range(3) for v in range(2)}
    with pytest.raises(ParameterError):
        scene.load_frame(spark, str(tmp_path), 3, poses, k)
    with pytest.raises(scene.FrameNotFound):
        scene.load_frame(spark, str(tmp_path), 1, poses, k)
    with pytest.raises(Exception, match="PNG"):
        scene.load_frame(spark, str(tmp_path), 2, poses, k).collect()
    with pytest.raises(ParameterError):
        scene.decode_color(scene.encode_png(depth))
