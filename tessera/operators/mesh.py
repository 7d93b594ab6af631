"""Marching cubes as a join: corners gathered per cell, cases looked up, vertices interpolated."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import color as colors
from tessera.functions import cube
from tessera.operators.tsdf import DirtyBlocks
from tessera.operators.volume import KEY, Snapshot, held
from tessera.params import GridParams, ParameterError

CELL = ("cx", "cy", "cz")
LEAST_WEIGHT = 1e-6
AXES = ("x", "y", "z")


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _corners(samples: DataFrame) -> DataFrame:
    """Each sample (gx, gy, gz, sdf, rgb or null) once for every cell it is a corner of, and cells with all eight."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(c).alias(a) for a, c in zip(AXES, o, strict=True)]) for i, o in enumerate(cube.CORNERS)])
    each = samples.select("gx", "gy", "gz", "sdf", "rgb", F.explode(steps).alias("k"))
    placed = each.select(*[(F.col(f"g{a}") - F.col(f"k.{a}")).alias(c) for a, c in zip(AXES, CELL, strict=True)], F.col("k.i").alias("i"), "sdf", "rgb")
    gathered = placed.groupBy(*CELL).agg(F.count("*").alias("n"), *[F.max(F.when(F.col("i") == i, F.col("sdf"))).alias(f"s{i}") for i in range(8)], *[F.max(F.when(F.col("i") == i, F.col("rgb"))).alias(f"c{i}") for i in range(8)])
    return gathered.where("n = 8").select(*CELL, F.array(*[f"s{i}" for i in range(8)]).alias("s"), F.array(*[f"c{i}" for i in range(8)]).alias("c"))


def cube_index(iso: float) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.get("s", F.lit(i)) < iso, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(8)])


def _with_case(cells: DataFrame, iso: float) -> DataFrame:
    """Cells the surface crosses; colour and triangles are only looked at for these."""
    return cells.withColumn("cube_index", cube_index(iso)).where("cube_index not in (0, 255)")


def sparse_cells(voxels: DataFrame, g: GridParams, iso: float = 0.0) -> DataFrame:
    """Crossed cells of a fused volume; one missing or unobserved corner drops a cell. Colour 0 was never seen and is white."""
    bs = g.block_size
    local = F.col("local")
    parts = (local % bs, F.floor(local / bs).cast("int") % bs, F.floor(local / (bs * bs)).cast("int"))
    shade = F.when(F.coalesce("color", F.lit(0)) != 0, F.col("color")) if "color" in voxels.columns else F.lit(None).cast("long")
    seen = voxels.where(F.col("weight") >= LEAST_WEIGHT)
    samples = seen.select(*[(F.col(k) * bs + p).cast("int").alias(f"g{a}") for k, p, a in zip(KEY, parts, AXES, strict=True)], F.col("tsdf").alias("sdf"), shade.alias("rgb"))
    return _with_case(_corners(samples), iso)


def dense_cells(samples: DataFrame, iso: float = 0.0) -> DataFrame:
    """Crossed cells of samples (x, y, z, sdf, weight and perhaps color); here colour 0 is black."""
    shade = F.coalesce("color", F.lit(0)) if "color" in samples.columns else F.lit(None).cast("long")
    seen = samples.where(F.col("weight") >= LEAST_WEIGHT)
    return _with_case(_corners(seen.select(*[F.col(a).alias(f"g{a}") for a in AXES], "sdf", shade.alias("rgb"))), iso)


def base_block(g: GridParams) -> list[Column]:
    return [F.floor(F.col(c) / g.block_size).cast("int").alias(k) for c, k in zip(CELL, KEY, strict=True)]


def case_table(spark) -> DataFrame:
    return spark.createDataFrame(list(cube.triangles()), "cube_index int, t int, e0 int, e1 int, e2 int")


def triangle_counts(cells: DataFrame) -> DataFrame:
    """Cells with n_triangles, from the signs alone."""
    counts = case_table(cells.sparkSession).groupBy("cube_index").agg(F.count("*").cast("int").alias("n_triangles"))
    return cells.join(F.broadcast(counts), "cube_index")


def normal() -> list[Column]:
    """The cell's unit gradient, or +z where it vanishes."""
    s = [F.get("s", F.lit(i)) for i in range(8)]
    grad = []
    for a in range(3):
        plus = [s[i] for i, o in enumerate(cube.CORNERS) if o[a]]
        minus = [s[i] for i, o in enumerate(cube.CORNERS) if not o[a]]
        grad.append((plus[0] + plus[1] + plus[2] + plus[3]) - (minus[0] + minus[1] + minus[2] + minus[3]))
    length = F.sqrt(grad[0] * grad[0] + grad[1] * grad[1] + grad[2] * grad[2])
    flat = length <= 1e-6
    return [F.when(flat, F.lit(float(a == 2))).otherwise(grad[a] / F.when(flat, F.lit(1.0)).otherwise(length)).alias(f"n{AXES[a]}") for a in range(3)]


def on_edges(rows: DataFrame, pitch: float, iso: float, origin=(0.0, 0.0, 0.0)) -> DataFrame:
    """Adds px, py, pz, r, g, b of the crossing on column edge. Endpoints go in one order for all cells that share the edge."""
    ends, edge, c = [cube.low_end(e) for e in range(12)], F.col("edge"), F.col
    a, b = (F.get(_array([p[k] for p in ends]), edge) for k in (0, 1))
    at = held(rows, sa=F.get("s", a), sb=F.get("s", b), ca=F.get("c", a), cb=F.get("c", b))
    gap = F.when(F.abs(c("sb") - c("sa")) < 1e-6, F.when(c("sb") - c("sa") < 0, F.lit(-1e-6)).otherwise(F.lit(1e-6))).otherwise(c("sb") - c("sa"))
    shades = {f"{side}{i}": F.coalesce(colors.unpack_linear(c(f"c{side}"))[i], F.lit(1.0)) for side in "ab" for i in range(3)}
    mixed = held(at, ratio=F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(iso) - c("sa")) / gap)), **shades)
    out = {}
    for i in range(3):
        low, high = (origin[i] + (c(CELL[i]) + F.get(_array([cube.CORNERS[p[k]][i] for p in ends]), edge)) * F.lit(pitch) for k in (0, 1))
        out[f"p{AXES[i]}"] = low * (1 - c("ratio")) + high * c("ratio")
        out["rgb"[i]] = c(f"a{i}") * (1 - c("ratio")) + c(f"b{i}") * c("ratio")
    return held(mixed, **out).drop("sa", "sb", "ca", "cb", "ratio", *shades)


def vertices(cells: DataFrame, pitch: float, iso: float = 0.0, origin=(0.0, 0.0, 0.0)) -> DataFrame:
    """Triangle soup: (cell, t, k, position, normal, tangent, uv, colour), k in emission order, which reverses the winding."""
    spread = cells.join(F.broadcast(case_table(cells.sparkSession)), "cube_index")
    corners = F.posexplode(F.array("e0", "e2", "e1")).alias("k", "edge")
    each = on_edges(spread.select(*CELL, "s", "c", "t", corners), pitch, iso, origin)
    tangent = [F.lit(v).alias(f"t{n}") for v, n in zip((1.0, 0.0, 0.0, 1.0), "xyzw", strict=True)]
    return each.select(*CELL, "t", "k", "edge", "px", "py", "pz", "r", "g", "b", *normal(), *tangent, F.lit(-1.0).alias("uv_u"), F.lit(-1.0).alias("uv_v"), F.lit(1.0).alias("alpha"))


def extract(voxels: DataFrame, g: GridParams, iso: float = 0.0) -> DataFrame:
    return vertices(sparse_cells(voxels, g, iso), g.voxel_size, iso)


def extract_dense(samples: DataFrame, pitch: float, iso: float = 0.0, origin=(0.0, 0.0, 0.0), dims: tuple[int, int, int] | None = None) -> DataFrame:
    """The mesh of a dense grid. With `dims` given, a grid under two samples a side or without all its samples is refused."""
    if not pitch > 0:
        raise ParameterError("the voxel size must be positive")
    if dims is not None:
        if min(dims) < 2:
            raise ParameterError("a grid has two samples a side at least")
        if (n := samples.count()) != dims[0] * dims[1] * dims[2]:
            raise ParameterError(f"{n} samples, not {dims[0]} by {dims[1]} by {dims[2]}")
    return vertices(dense_cells(samples, iso), pitch, iso, origin)


def _in_blocks(cells: DataFrame, blocks: DataFrame, g: GridParams, how: str) -> DataFrame:
    return cells.select("*", *base_block(g)).join(blocks.select(*KEY).distinct(), list(KEY), how).drop(*KEY)


def extract_culled(voxels: DataFrame, blocks: DataFrame, g: GridParams, iso: float = 0.0) -> DataFrame:
    """Cells based in the chosen blocks; their corners still come from the whole volume."""
    return vertices(_in_blocks(sparse_cells(voxels, g, iso), blocks, g, "left_semi"), g.voxel_size, iso)


def extract_incremental(mesh: DataFrame, voxels: DataFrame, remesh: DataFrame, g: GridParams, iso: float = 0.0) -> DataFrame:
    """The kept part of an earlier mesh and the blocks to mesh again; equal to a full extract."""
    return _in_blocks(mesh, remesh, g, "left_anti").unionByName(extract_culled(voxels, remesh, g, iso))


@dataclass(frozen=True)
class Mesh:
    """Triangles with the volume and epoch they were extracted from; `whole` unless blocks were culled."""

    triangles: DataFrame
    grid: str
    epoch: str
    whole: bool = True
    incremental: bool = False
    remeshed: DataFrame | None = None

    def remeshed_blocks(self) -> int:
        return self.remeshed.count()


def extract_volume(volume: Snapshot, g: GridParams, iso: float = 0.0, chosen: DataFrame | None = None) -> Mesh:
    """The mesh of a volume's voxels, or of its chosen blocks alone."""
    blocks = volume.blocks.select(*KEY) if chosen is None else volume.blocks.join(chosen.select(*KEY).distinct(), list(KEY), "left_semi").select(*KEY)
    triangles = extract(volume.voxels, g, iso) if chosen is None else extract_culled(volume.voxels, blocks, g, iso)
    return Mesh(triangles, volume.grid, volume.epoch, chosen is None, False, blocks)


def extract_changed(volume: Snapshot, dirty: DirtyBlocks, before: Mesh | None, g: GridParams, iso: float = 0.0) -> Mesh:
    """The mesh of the volume, meshing again only what `dirty` marks; `incremental` and `remeshed` tell what was done.

    Everything is meshed, and that is no error, where an earlier mesh would lead astray: there is none, it was
    culled, it or the marks belong to another volume or epoch, or the marks are stale.
    """
    if before is None or not before.whole or (before.grid, before.epoch) != (volume.grid, volume.epoch):
        return extract_volume(volume, g, iso)
    if dirty.blocks is not None and not dirty.vouched(volume):
        return extract_volume(volume, g, iso)
    again = dirty.remesh(volume)
    return Mesh(extract_incremental(before.triangles, volume.voxels, again, g, iso), volume.grid, volume.epoch, True, True, again)


def block_spans(cells: DataFrame, g: GridParams, epoch: str | None = None) -> DataFrame:
    """(block, triangle_base, triangle_count, vertex_base, vertex_count) in block order, and the epoch they hold for if given.

    Bases are a running sum over the blocks alone. It is taken in two steps, inside slabs of bx and over the
    slabs, so that no task sees all blocks.
    """
    from pyspark.sql import Window

    per = triangle_counts(cells).select(*base_block(g), "n_triangles").groupBy(*KEY).agg(F.sum("n_triangles").cast("long").alias("triangle_count"))
    slabs = per.groupBy("bx").agg(F.sum("triangle_count").alias("slab"))
    before = slabs.select("bx", (F.sum("slab").over(Window.orderBy("bx")) - F.col("slab")).alias("slab_base"))
    inner = F.sum("triangle_count").over(Window.partitionBy("bx").orderBy("by", "bz")) - F.col("triangle_count")
    out = per.withColumn("inner", inner).join(before, "bx").withColumn("triangle_base", (F.col("inner") + F.col("slab_base")).cast("long"))
    stamp = [F.lit(epoch).alias("epoch")] if epoch is not None else []
    return out.select(*KEY, "triangle_base", "triangle_count", (F.col("triangle_base") * 3).alias("vertex_base"), (F.col("triangle_count") * 3).alias("vertex_count"), *stamp)


def shared(cells: DataFrame, g: GridParams, iso: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangle corners) with vertices shared inside blocks, which have 512 voxels at most.

    An edge belongs to the cell at its low end. Corners whose owner lies in another block, or emits nothing, get a
    vertex of their own (own_t, own_k tell which corner); the others share one per owner and axis, which has the
    owner's normal. Corners name their vertex by (owner, axis, own cell's t and k or -1).
    """
    if g.voxels_per_block > 512:
        raise ParameterError("vertices are shared in blocks of 512 voxels at most")
    soup = vertices(cells, g.voxel_size, iso)
    low = [cube.CORNERS[cube.low_end(e)[0]] for e in range(12)]
    edge = F.col("edge")
    owner = [(F.col(c) + F.get(_array([o[i] for o in low]), edge)).cast("int").alias(f"o{AXES[i]}") for i, c in enumerate(CELL)]
    named = soup.select("*", *owner, F.get(_array([cube.axis_of(e) for e in range(12)]), edge).alias("axis"))
    emits = cells.select(*[F.col(c).alias(f"o{a}") for c, a in zip(CELL, AXES, strict=True)], *[n.alias(f"o_n{a}") for n, a in zip(normal(), AXES, strict=True)])
    met = named.join(emits, ["ox", "oy", "oz"], "left")
    same = reduce(lambda a, b: a & b, [F.floor(F.col(f"o{a}") / g.block_size) == F.floor(F.col(c) / g.block_size) for a, c in zip(AXES, CELL, strict=True)])
    alone = ~same | F.col("o_nx").isNull()
    corner = met.select(
        *CELL, "t", "k", "axis", *[F.when(alone, F.col(c)).otherwise(F.col(f"o{a}")).alias(f"v{a}") for c, a in zip(CELL, AXES, strict=True)],
        F.when(alone, F.col("t")).otherwise(F.lit(-1)).alias("own_t"), F.when(alone, F.col("k")).otherwise(F.lit(-1)).alias("own_k"),
        "px", "py", "pz", "r", "g", "b", *[F.when(alone, F.col(f"n{a}")).otherwise(F.col(f"o_n{a}")).alias(f"n{a}") for a in AXES],
    )
    key = ["vx", "vy", "vz", "axis", "own_t", "own_k"]
    verts = corner.groupBy(*key).agg(*[F.first(c).alias(c) for c in ("px", "py", "pz", "nx", "ny", "nz", "r", "g", "b")])
    return verts, corner.select(*CELL, "t", "k", *key)
