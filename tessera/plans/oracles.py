"""The oracles: plain SQL for every registered query, put together from named common table expressions."""

from __future__ import annotations

import math

from tessera.functions import cube
from tessera.plans.inputs import camera

T = "0.25::DOUBLE"


def r6(x: str) -> str:
    return f"floor(({x}) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE"


def _cams() -> str:
    """Quarter turns about z and a grid of places, by the number of the frame."""
    cos, sin = (f"CASE frame_id % 4 {' '.join(f'WHEN {i} THEN {float(v)}::DOUBLE' for i, v in enumerate(t))} END" for t in ((1, 0, -1, 0), (0, 1, 0, -1)))
    cells = [cos, sin, 0, 0, f"-({sin})", cos, 0, 0, 0, 0, 1, 0, "0.5 * (frame_id % 16)", "0.125 + 0.5 * (frame_id // 16)", -0.25, 1]
    return f"SELECT frame_id, {', '.join(f'({x})::DOUBLE AS m{i}' for i, x in enumerate(cells))} FROM (SELECT DISTINCT (l_orderkey // 4096)::INT AS frame_id FROM lineitem)"


def _local(prefix: str) -> str:
    return ", ".join(f"(m{4 * k} * ({prefix}x - m12) + m{4 * k + 1} * ({prefix}y - m13) + m{4 * k + 2} * ({prefix}z - m14)) AS {n}" for k, n in enumerate(("xc", "yc", "zc")))


def _tap(name: str, x: str, y: str) -> str:
    return f"LEFT JOIN pixels {name} ON {name}.frame_id = p.frame_id AND {name}.u = {x} AND {name}.v = {y}"


def _dilated(source: str, band: int) -> str:
    steps = ", ".join(f"unnest(range({-band}, {band + 1})) AS s{a}" for a in "x")
    s = f"(SELECT {steps.replace('sx', 's')})"
    return f"SELECT DISTINCT (bx + a.s)::INT AS bx, (by + b.s)::INT AS by, (bz + e.s)::INT AS bz FROM (SELECT DISTINCT bx, by, bz FROM {source}), {s} a, {s} b, {s} e"


def _lin(x: str) -> str:
    return f"CASE WHEN {x} <= 0.04045::DOUBLE THEN {x} / 12.92::DOUBLE ELSE pow(({x} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"


def _chan(p: str, i: int) -> str:
    return f"((({p}) >> {8 * i}) & 255)"


def _byte(x: str) -> str:
    enc = f"CASE WHEN {x} <= 0.0031308::DOUBLE THEN {x} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow({x}, {1 / 2.4!r}::DOUBLE) - 0.055::DOUBLE END"
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) OR {x} <= 0 THEN 0 WHEN {x} >= 1 THEN 255 ELSE floor(least({enc}, 1.0::DOUBLE) * 255 + 0.5::DOUBLE)::BIGINT END)"


def _packed(r: str, g: str, b: str) -> str:
    return f"({_byte(r)} | ({_byte(g)} << 8) | ({_byte(b)} << 16) | 4278190080)"


def _fold(source: str, colored: bool = False) -> str:
    """Ordered fold over lists of {k, s, w, c, h}: w < 0 is a clear, c < 0 is no colour, h is changed."""
    total = "greatest(a.w + o.w, 0.000001::DOUBLE)"
    s = f"greatest(-{T}, least({T}, (a.s * a.w + o.s * o.w) / {total}))"
    w = "least(a.w + o.w, 5.0::DOUBLE)"
    mixed = [f"(({_lin(f'({_chan('a.c', i)} / 255::DOUBLE)')}) * a.w + ({_lin(f'({_chan('o.c', i)} / 255::DOUBLE)')}) * o.w) / {total}" for i in range(3)]
    shade = f"CASE WHEN o.c < 0 THEN a.c WHEN a.c = 0 THEN ((o.c & 16777215) | 4278190080) ELSE {_packed(*[f'({m})' for m in mixed])} END" if colored else "a.c"
    step = f"""CASE WHEN o.w < 0 THEN CASE WHEN a.w > 0 THEN {{'k': o.k, 's': 0.0::DOUBLE, 'w': 0.0::DOUBLE, 'c': 0::BIGINT, 'h': true}} ELSE a END
      ELSE {{'k': o.k, 's': {s}, 'w': {w}, 'c': ({shade})::BIGINT, 'h': a.h OR {s} <> a.s OR {w} <> a.w OR ({shade}) <> a.c}} END"""
    init = "{'k': -1, 's': 0.0::DOUBLE, 'w': 0.0::DOUBLE, 'c': 0::BIGINT, 'h': false}"
    color = "coalesce(color_obs, -1)::BIGINT" if colored else "-1::BIGINT"
    return f"""SELECT bx, by, bz, local, r.s AS tsdf, r.w AS weight, r.c AS color, r.h AS changed FROM (
      SELECT bx, by, bz, local, list_reduce(list_prepend({init}, l), lambda a, o: {step}) AS r FROM (
        SELECT bx, by, bz, local, list({{'k': frame_id, 's': sdf, 'w': CASE WHEN clear THEN -1.0::DOUBLE ELSE w_obs END, 'c': {color}, 'h': false}} ORDER BY frame_id) AS l FROM {source} GROUP BY ALL))"""


_OBS = f"""SELECT bx, by, bz, local, frame_id, x, y, z, d AS depth, least({T}, d - zc) AS sdf,
  (CASE WHEN zc > 0.01::DOUBLE THEN 1.0::DOUBLE / (zc * zc) ELSE 1.0::DOUBLE END) * (CASE WHEN zc > d THEN ({T} - (zc - d)) / {T} ELSE 1.0::DOUBLE END) AS w_obs, d - zc > {T} AS far
  FROM deep WHERE d >= 0.5 AND d <= 2.5 AND d - zc >= -{T}"""

_CORNERS = ", ".join(f"({i}, {x}, {y}, {z})" for i, (x, y, z) in enumerate(cube.CORNERS))


def _cells(source: str) -> str:
    s = ", ".join(f"max(CASE WHEN i = {i} THEN sdf END) AS s{i}, max(CASE WHEN i = {i} THEN rgb END) AS c{i}" for i in range(8))
    index = " + ".join(f"CASE WHEN s{i} < 0 THEN {1 << i} ELSE 0 END" for i in range(8))
    return f"""SELECT * FROM (SELECT cx, cy, cz, [{", ".join(f"s{i}" for i in range(8))}] AS s, [{", ".join(f"c{i}" for i in range(8))}] AS c, ({index})::INT AS cube_index FROM (
      SELECT gx - k.ox AS cx, gy - k.oy AS cy, gz - k.oz AS cz, count(*) AS n, {s} FROM {source}, (VALUES {_CORNERS}) AS k(i, ox, oy, oz) GROUP BY ALL) WHERE n = 8) WHERE cube_index NOT IN (0, 255)"""


def _samples(source: str) -> str:
    return f"SELECT bx * 8 + local % 8 AS gx, by * 8 + (local // 8) % 8 AS gy, bz * 8 + local // 64 AS gz, tsdf AS sdf, CASE WHEN color <> 0 THEN color END AS rgb FROM {source} WHERE weight >= 0.000001"


def _normals() -> str:
    parts = []
    for a in range(3):
        plus = " + ".join(f"s[{i + 1}]" for i, o in enumerate(cube.CORNERS) if o[a])
        minus = " + ".join(f"s[{i + 1}]" for i, o in enumerate(cube.CORNERS) if not o[a])
        parts.append(f"(({plus}) - ({minus})) AS g{'xyz'[a]}")
    return ", ".join(parts)


def _normed(source: str) -> str:
    n = "sqrt(gx * gx + gy * gy + gz * gz)"
    return f"SELECT *, CASE WHEN {n} <= 0.000001 THEN 0.0::DOUBLE ELSE gx / {n} END AS nx, CASE WHEN {n} <= 0.000001 THEN 0.0::DOUBLE ELSE gy / {n} END AS ny, CASE WHEN {n} <= 0.000001 THEN 1.0::DOUBLE ELSE gz / {n} END AS nz FROM (SELECT *, {_normals()} FROM {source})"


_TRI = "SELECT * FROM (VALUES " + ", ".join(str(r) for r in cube.triangles()) + ") AS t(cube_index, t, e0, e1, e2)"
_ENDS = [cube.low_end(e) for e in range(12)]


def _soup(source: str, pitch: str = "0.0625::DOUBLE", origin=("0.0", "0.0", "0.0")) -> str:
    def pick(values):
        return f"[{', '.join(map(str, values))}][edge + 1]"

    pos = []
    for i, a in enumerate("xyz"):
        low, high = (pick([cube.CORNERS[p[k]][i] for p in _ENDS]) for k in (0, 1))
        pos.append(f"({origin[i]}::DOUBLE + (c{a} + {low}) * {pitch}) * (1 - ratio) + ({origin[i]}::DOUBLE + (c{a} + {high}) * {pitch}) * ratio AS p{a}")
    cols = [f"coalesce({_lin(f'({_chan('ca', i)} / 255::DOUBLE)')}, 1.0::DOUBLE) * (1 - ratio) + coalesce({_lin(f'({_chan('cb', i)} / 255::DOUBLE)')}, 1.0::DOUBLE) * ratio AS {n}" for i, n in enumerate("rgb")]
    return f"""SELECT cx, cy, cz, t, k, edge, nx, ny, nz, {", ".join(pos)}, {", ".join(cols)} FROM (
      SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.0::DOUBLE - sa) / (CASE WHEN abs(sb - sa) < 0.000001 THEN CASE WHEN sb - sa < 0 THEN -0.000001::DOUBLE ELSE 0.000001::DOUBLE END ELSE sb - sa END))) AS ratio FROM (
        SELECT *, s[{pick([p[0] for p in _ENDS])} + 1] AS sa, s[{pick([p[1] for p in _ENDS])} + 1] AS sb, c[{pick([p[0] for p in _ENDS])} + 1] AS ca, c[{pick([p[1] for p in _ENDS])} + 1] AS cb FROM (
          SELECT n.* EXCLUDE (cube_index), tri.t, k.k, [tri.e0, tri.e2, tri.e1][k.k + 1] AS edge FROM ({_normed(source)}) n JOIN tri ON n.cube_index = tri.cube_index, (VALUES (0), (1), (2)) AS k(k))))"""


CTES = {
    "points": "SELECT l_orderkey, l_linenumber, (l_partkey % 97 - 48)::DOUBLE * 0.03125::DOUBLE AS x, (l_suppkey % 31 - 15)::DOUBLE * 0.03125::DOUBLE AS y, floor(l_quantity) * 0.03125::DOUBLE AS z FROM lineitem",
    "pixels": "SELECT (l_orderkey // 4096)::INT AS frame_id, (l_partkey % 32)::INT AS u, (l_suppkey % 24)::INT AS v, min(floor(l_quantity)) * 0.03125::DOUBLE + 0.5::DOUBLE AS depth FROM lineitem GROUP BY ALL",
    "hues": "SELECT (p_partkey // 512)::INT AS frame_id, (p_partkey % 32)::INT AS u, ((p_partkey // 32) % 16)::INT AS v, max((p_size * 5 % 256)::BIGINT | ((p_partkey % 256) << 8) | ((p_partkey * 7 % 256) << 16)) AS color FROM part GROUP BY ALL",
    "cams": _cams(),
    "tri": _TRI,
    "vox": "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round_even({a} / 0.0625::DOUBLE, 0)::INT AS v{a}" for a in "xyz") + " FROM points",
    "blk": "SELECT l_orderkey, l_linenumber, " + ", ".join(f"floor(v{a} / 8::DOUBLE)::INT AS b{a}" for a in "xyz") + " FROM vox",
    "surf": "SELECT frame_id, u, v, " + ", ".join(f"m{i} * ((u - 16::DOUBLE) * depth / 32::DOUBLE) + m{4 + i} * ((v - 12::DOUBLE) * depth / 32::DOUBLE) + m{8 + i} * depth + m{12 + i} AS {a}" for i, a in enumerate("xyz")) + " FROM pixels JOIN cams USING (frame_id) WHERE depth >= 0.5 AND depth <= 2.5",
    "surfblk": "SELECT " + ", ".join(f"floor(round_even({a} / 0.0625::DOUBLE, 0) / 8)::INT AS b{a}" for a in "xyz") + " FROM surf",
    "pblocks": _dilated("blk", 1),
    "dblocks": _dilated("surfblk", 1),
    "active": "SELECT * FROM pblocks UNION SELECT * FROM dblocks",
    "voxels": "SELECT bx, by, bz, l.local::INT AS local, (bx * 8 + l.local % 8) * 0.0625::DOUBLE AS x, (by * 8 + (l.local // 8) % 8) * 0.0625::DOUBLE AS y, (bz * 8 + l.local // 64) * 0.0625::DOUBLE AS z FROM dblocks, (SELECT unnest(range(512)) AS local) l",
    "proj": f"SELECT *, 32::DOUBLE * (xc / zc) + 16 AS pu, 32::DOUBLE * (yc / zc) + 12 AS pv FROM (SELECT bx, by, bz, local, x, y, z, frame_id, {_local('')} FROM voxels, cams) WHERE zc > 0",
    "inimg": "SELECT *, floor(pu - 0.5::DOUBLE)::INT AS x0, floor(pv - 0.5::DOUBLE)::INT AS y0 FROM proj WHERE pu >= 0 AND pu < 32 AND pv >= 0 AND pv < 24",
    "taps": f"SELECT p.*, coalesce(a.depth, 0) AS d00, coalesce(b.depth, 0) AS d10, coalesce(e.depth, 0) AS d01, coalesce(f.depth, 0) AS d11, coalesce(n.depth, 0) AS near FROM inimg p {_tap('a', 'x0', 'y0')} {_tap('b', 'x0 + 1', 'y0')} {_tap('e', 'x0', 'y0 + 1')} {_tap('f', 'x0 + 1', 'y0 + 1')} {_tap('n', 'floor(pu)', 'floor(pv)')}",
    "deep": f"""SELECT *, CASE WHEN x0 < 0 OR y0 < 0 OR x0 + 1 >= 32 OR y0 + 1 >= 24 OR least(d00, d10, d01, d11) <= 0 OR greatest(d00, d10, d01, d11) - least(d00, d10, d01, d11) > {T} THEN near
      ELSE (d00 * (1 - (pu - 0.5::DOUBLE - x0)) + d10 * (pu - 0.5::DOUBLE - x0)) * (1 - (pv - 0.5::DOUBLE - y0)) + (d01 * (1 - (pu - 0.5::DOUBLE - x0)) + d11 * (pu - 0.5::DOUBLE - x0)) * (pv - 0.5::DOUBLE - y0) END AS d FROM taps""",
    "allobs": _OBS,
    "obs": "SELECT * EXCLUDE (far), false AS clear FROM allobs WHERE w_obs > 0",
    "dynobs": "SELECT * EXCLUDE (far), far AS clear FROM allobs WHERE far OR w_obs > 0",
    "hued": "SELECT o.*, CASE WHEN zc > 0 AND 32::DOUBLE * (xc / zc) + 16 >= 0 AND 32::DOUBLE * (xc / zc) + 16 < 32 AND 32::DOUBLE * (yc / zc) + 12 >= 0 AND 32::DOUBLE * (yc / zc) + 12 < 24 THEN coalesce(h.color, 0) END AS color_obs FROM (SELECT obs.*, " + _local("obs.") + " FROM obs JOIN cams USING (frame_id)) o LEFT JOIN hues h ON h.frame_id = o.frame_id AND h.u = floor(32::DOUBLE * (o.xc / o.zc) + 16) AND h.v = floor(32::DOUBLE * (o.yc / o.zc) + 12)",
    "fused": _fold("obs"),
    "dynamic": _fold("dynobs"),
    "colored": _fold("hued", True),
    "dynbefore": _fold("(SELECT * FROM dynobs WHERE frame_id < (SELECT max(frame_id) FROM cams))"),
    "lastdirty": "SELECT DISTINCT a.bx, a.by, a.bz FROM dynamic a LEFT JOIN dynbefore b USING (bx, by, bz, local) WHERE a.tsdf <> coalesce(b.tsdf, 0) OR a.weight <> coalesce(b.weight, 0)",
    "remesh": "SELECT DISTINCT d.* FROM dblocks d JOIN lastdirty l ON l.bx - d.bx IN (0, 1) AND l.by - d.by IN (0, 1) AND l.bz - d.bz IN (0, 1)",
    "samples": _samples("colored"),
    "cells": _cells("samples"),
    "soup": _soup("cells"),
    "dynsamples": _samples("(SELECT bx, by, bz, local, tsdf, weight, 0 AS color FROM dynamic)"),
    "dyncells": _cells("dynsamples"),
    "dynsoup": _soup("dyncells"),
    "grid": "SELECT (i % 20)::INT AS gx, (i // 20 % 20)::INT AS gy, (i // 400)::INT AS gz, ((i % 20 - 9.5::DOUBLE) * (i % 20 - 9.5::DOUBLE) + (i // 20 % 20 - 10.0::DOUBLE) * (i // 20 % 20 - 10.0::DOUBLE) + (i // 400 - 10.0::DOUBLE) * (i // 400 - 10.0::DOUBLE) - 42.25::DOUBLE) / 16::DOUBLE AS sdf, (i % 20 * 12) + ((i // 20 % 20 * 12) << 8) AS rgb FROM (SELECT unnest(range(8000)) AS i)",
    "densecells": _cells("grid"),
    "densesoup": _soup("densecells", origin=("0.5", "-0.25", "0.125")),
    "ev": "SELECT CASE WHEN event_id % 3 = 0 THEN '  ..' || event_type ELSE event_type END AS stage, (event_id % 16) * 0.25::DOUBLE AS cpu_ms, (event_id % 8) * 0.125::DOUBLE AS gpu_ms, event_id % 2 = 0 AS has_gpu FROM events",
    "merged": "SELECT stage, sum(cpu_ms) AS cpu_ms, sum(CASE WHEN has_gpu THEN gpu_ms ELSE 0 END) AS gpu_ms, bool_or(has_gpu) AS has_gpu FROM ev GROUP BY stage",
    "viewed": f"SELECT s.*, {_local('p')} FROM soup s, (SELECT * FROM cams WHERE frame_id = 0)",
    "pix2": "SELECT *, CASE WHEN zc > 0 THEN 32::DOUBLE * (xc / zc) + 16 END AS pu, CASE WHEN zc > 0 THEN 32::DOUBLE * (yc / zc) + 12 END AS pv FROM viewed",
    "clamped": "SELECT *, greatest(0.0::DOUBLE, least(pu, 31.0::DOUBLE)) AS cu, greatest(0.0::DOUBLE, least(pv, 23.0::DOUBLE)) AS cv FROM pix2",
}


def _visible() -> str:
    spots = {"a": ("x0", "y0"), "b": ("x1", "y0"), "e": ("x0", "y1"), "f": ("x1", "y1")}
    joins = " ".join(f"LEFT JOIN pixels {n} ON {n}.frame_id = 0 AND {n}.u = q.{x} AND {n}.v = q.{y}" for n, (x, y) in spots.items())
    weights = {"a": "(1 - tx) * (1 - ty)", "b": "tx * (1 - ty)", "e": "(1 - tx) * ty", "f": "tx * ty"}
    taps = ", ".join(f"CASE WHEN {n}.depth > 0 THEN {n}.depth END AS d{n}, CASE WHEN {n}.depth > 0 THEN {w} END AS w{n}" for n, w in weights.items())
    order = "abef"
    total = " + ".join(f"coalesce(w{n}, 0)" for n in order)
    blend = " + ".join(f"coalesce(w{n} * d{n}, 0)" for n in order)
    best = f"greatest({', '.join(f'coalesce(w{n}, -1)' for n in order)})"
    near = f"coalesce({', '.join(f'CASE WHEN w{n} = {best} THEN d{n} END' for n in order)})"
    span = f"greatest({', '.join(f'd{n}' for n in order)}) - least({', '.join(f'd{n}' for n in order)})"
    depth = f"CASE WHEN {total} <= 0 THEN 0 WHEN {span} > 0.0625 THEN {near} ELSE (0.0::DOUBLE + {blend}) / ({total}) END"
    return f"""SELECT *, coalesce(pu >= 1 AND pu < 31 AND pv >= 1 AND pv < 23 AND d >= 0.5 AND d <= 2.5 AND abs(d - zc) <= 0.0625, false) AS visible FROM (
      SELECT *, {depth} AS d FROM (SELECT q.*, {taps} FROM (
        SELECT *, floor(cu)::INT AS x0, floor(cv)::INT AS y0, least(floor(cu) + 1, 31)::INT AS x1, least(floor(cv) + 1, 23)::INT AS y1, cu - floor(cu) AS tx, cv - floor(cv) AS ty FROM clamped) q {joins}))"""


CTES["seen"] = _visible()
_UV = ", ".join(f"CASE WHEN p{p} IS NULL THEN -1.0::DOUBLE WHEN visible THEN {uv} ELSE -({uv}) - 1 END AS uv_{p}" for p, uv in (("u", "greatest(0.5::DOUBLE / 32, least(1 - 0.5::DOUBLE / 32, (pu + 0.5::DOUBLE) / 32))"), ("v", "greatest(0.5::DOUBLE / 24, least(1 - 0.5::DOUBLE / 24, (pv + 0.5::DOUBLE) / 24))")))
CTES["textured"] = f"SELECT cx, cy, cz, t, k, visible, {_UV} FROM seen"


_LOW = [cube.CORNERS[p[0]] for p in _ENDS]
_OWNER = ", ".join(f"(c{a} + [{', '.join(str(o[i]) for o in _LOW)}][edge + 1])::INT AS o{a}" for i, a in enumerate("xyz"))
CTES["normed"] = _normed("cells")
CTES["owned"] = f"""SELECT s.*, n.nx AS mx, n.ny AS my, n.nz AS mz, n.nx IS NULL OR {" OR ".join(f"floor(s.o{a} / 8::DOUBLE) <> floor(s.c{a} / 8::DOUBLE)" for a in "xyz")} AS alone
  FROM (SELECT *, {_OWNER}, [{", ".join(str(cube.axis_of(e)) for e in range(12))}][edge + 1] AS axis FROM soup) s LEFT JOIN normed n ON n.cx = s.ox AND n.cy = s.oy AND n.cz = s.oz"""


def _with(sql: str) -> str:
    """The query behind the expressions it needs, in order of need."""
    import re

    need: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"\b(FROM|JOIN)\s+(\(\s*)?{name}\b|,\s*{name}\b", text):
                visit(CTES[name])
                if name not in need:
                    need.append(name)

    visit(sql)
    quoted = lambda text: re.sub(r"\bby\b", '"by"', text)  # noqa: E731  the column's name is a keyword
    return quoted("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in need) + "\n" if need else "") + quoted(sql)


def _planes(planes) -> str:
    tests = []
    for *n, d in planes:
        terms = " + ".join(f"({v!r})::DOUBLE * (({k}::DOUBLE * 0.5::DOUBLE - 0.03125::DOUBLE) + {0.5 if v >= 0 else 0.0}::DOUBLE)" for v, k in zip(n, ("bx", "by", "bz"), strict=True))
        tests.append(f"NOT ({terms} + ({d!r})::DOUBLE < 0)")
    return " AND ".join(tests)


def _soup_columns(source: str) -> str:
    return "SELECT cx, cy, cz, t, k, " + ", ".join(f"{r6(n)} AS {n}" for n in ("px", "py", "pz", "nx", "ny", "nz", "r", "g", "b")) + f" FROM {source}"


def build() -> dict[str, str]:
    from tessera.plans.catalog import VIEW_PROJECTION

    # The planes again, from the definition: the side planes of the pinhole are widened by a tenth of the focal length.
    k = camera(1)
    sx, sy = 0.9 * 32, 0.9 * 32
    local = [(sx, 0, 16.0, 0), (-sx, 0, 16.0, 0), (0, sy, 12.0, 0), (0, -sy, 12.0, 0), (0, 0, 1, -0.5), (0, 0, -1, 2.5)]
    pinhole = []
    for a, b, e, d in local:
        n = [k.pose[i] * a + k.pose[4 + i] * b + k.pose[8 + i] * e for i in range(3)]
        size = math.sqrt(sum(v * v for v in n))
        pinhole.append((*[v / size for v in n], (d - sum(v * k.pose[12 + i] for i, v in enumerate(n))) / size))
    m = VIEW_PROJECTION
    row = [[m[4 * j + i] for j in range(4)] for i in range(4)]
    clip = [[p + q for p, q in zip(row[3], row[0])], [p - q for p, q in zip(row[3], row[0])], [p + q for p, q in zip(row[3], row[1])], [p - q for p, q in zip(row[3], row[1])], row[2], [p - q for p, q in zip(row[3], row[2])]]
    view = []
    for i, p in enumerate(clip):
        size = math.sqrt(p[0] ** 2 + p[1] ** 2 + p[2] ** 2)
        view.append((p[0] / size, p[1] / size, p[2] / size, p[3] / size + (0.125 if i != 4 else 0.0)) if size > 0 else tuple(p))
    part = "(SELECT p_partkey, (p_partkey * 65537 % 16777216)::BIGINT AS packed FROM part)"
    lin = [f"({_lin(f'({_chan('packed', i)} / 255::DOUBLE)')})" for i in range(3)]
    p3 = ((1.224940, -0.224940, 0.0), (-0.042056, 1.042056, 0.0), (-0.019637, -0.078636, 1.098273))
    b2020 = ((1.660491, -0.587641, -0.072850), (-0.124551, 1.132900, -0.008349), (-0.018151, -0.100579, 1.118730))
    turned = lambda rows: [f"({' + '.join(f'({v!r})::DOUBLE * {x}' for v, x in zip(r, 'rgb', strict=True))})" for r in rows]
    raw = [f"({_chan('packed', i)} / 255::DOUBLE)" for i in range(3)]
    bucket = lambda n: f"(xor(xor((bx::BIGINT * 73856093) & 4294967295, (by::BIGINT * 19349669) & 4294967295), (bz::BIGINT * 83492791) & 4294967295) % {n})"
    voxel = "bx, by, bz, local"
    out = {
        "world_to_voxel": "SELECT * FROM vox",
        "voxel_to_block": "SELECT *, bx * 8 * 0.0625::DOUBLE AS obx, by * 8 * 0.0625::DOUBLE AS oby, bz * 8 * 0.0625::DOUBLE AS obz, (bx::BIGINT & 2097151) | ((by::BIGINT & 2097151) << 21) | ((bz::BIGINT & 2097151) << 42) AS packed FROM blk",
        "spatial_hash": f"SELECT {bucket(30000)} AS bucket, count(*) AS n FROM blk GROUP BY 1",
        "unproject_pixels": "SELECT * FROM surf",
        "project_points": f"SELECT l_orderkey, l_linenumber, frame_id, {r6('u')} AS u, {r6('v')} AS v, zc FROM (SELECT *, 32::DOUBLE * (xc / zc) + 16 AS u, 32::DOUBLE * (yc / zc) + 12 AS v FROM (SELECT l_orderkey, l_linenumber, frame_id, {_local('')} FROM points JOIN cams ON frame_id = l_orderkey // 4096) WHERE zc > 0) WHERE u >= 0 AND u < 32 AND v >= 0 AND v < 24",
        "srgb_roundtrip": f"SELECT p_partkey, {_packed('r', 'g', 'b')} AS again, {r6('r')} AS r, {r6('g')} AS g, {r6('b')} AS b FROM (SELECT p_partkey, {lin[0]} AS r, {lin[1]} AS g, {lin[2]} AS b FROM {part})",
        "to_canonical": f"SELECT p_partkey, packed | 4278190080 AS canonical, {_packed(*raw)} AS from_linear FROM {part}",
        "primaries_rotate": f"SELECT p_partkey, {_packed(*turned(p3))} AS from_p3, {_packed(*turned(b2020))} AS from_2020 FROM (SELECT p_partkey, {lin[0]} AS r, {lin[1]} AS g, {lin[2]} AS b FROM {part})",
        "pose_gl_to_cv": "SELECT frame_id, place::INT AS place, CASE WHEN place BETWEEN 4 AND 11 THEN -value ELSE value END AS value FROM (SELECT frame_id, unnest(range(16)) AS place, unnest([" + ", ".join(f"m{i}" for i in range(16)) + "]) AS value FROM cams)",
        "registered_depth_camera": "SELECT 1440::DOUBLE * (256::DOUBLE / 1920) AS fx, 1440::DOUBLE * (192::DOUBLE / 1440) AS fy, 960::DOUBLE * (256::DOUBLE / 1920) - 0.5::DOUBLE AS cx, 720::DOUBLE * (192::DOUBLE / 1440) - 0.5::DOUBLE AS cy, 256::INT AS width, 192::INT AS height",
        "allocate_from_coords": "SELECT DISTINCT bx, by, bz FROM blk",
        "allocate_from_points": "SELECT * FROM pblocks",
        "allocate_from_depth": "SELECT * FROM dblocks",
        "truncation_band": _dilated("blk", 2),
        "compact_active": "SELECT * FROM active",
        "compact_frustum": f"SELECT * FROM active WHERE {_planes(pinhole)}",
        "compact_frustum_viewproj": f"SELECT * FROM active WHERE {_planes(view)}",
        "remove_blocks": "SELECT d.* FROM dblocks d WHERE NOT EXISTS (SELECT 1 FROM active a WHERE a.bx = d.bx AND a.by = d.by AND a.bz = d.bz AND (a.bx + a.by + a.bz) % 3 = 0)",
        "clear_grid": "SELECT 0::BIGINT AS n, 2::BIGINT AS version",
        "resize_noop": "SELECT count(*) AS n, 512::BIGINT AS capacity, 1::BIGINT AS version FROM dblocks",
        "load_factor": "SELECT count(*) / 256::DOUBLE AS load_factor, count(*) / 256::DOUBLE >= 0.7::DOUBLE AS grow FROM dblocks",
        "hash_diagnostics": f"SELECT sum(n)::BIGINT AS active, sum(greatest(0, n - 4))::BIGINT AS overflow_at_least, max(n)::BIGINT AS fullest_bucket, greatest(0, 256 - sum(n))::BIGINT AS heap_free, sum(n) / 256::DOUBLE AS load_factor, sum(n) / 256::DOUBLE >= 0.7::DOUBLE AS grow FROM (SELECT {bucket(64)} AS bucket, count(*) AS n FROM active GROUP BY 1)",
        "alloc_failures": "SELECT greatest(0, count(*) - 256)::BIGINT AS total, 0::BIGINT AS lock, greatest(0, count(*) - 256)::BIGINT AS heap, count(*) > 256 AS capacity_limited FROM active",
        "block_list_semijoin": "SELECT * FROM dblocks INTERSECT SELECT * FROM pblocks",
        "block_lookup": "SELECT d.bx IS NOT NULL AS found, count(*) AS n FROM pblocks p LEFT JOIN dblocks d ON p.bx = d.bx AND p.by = d.by AND p.bz = d.bz GROUP BY 1",
        "tsdf_observation": f"SELECT {voxel}, frame_id, {r6('sdf')} AS sdf, {r6('w_obs')} AS w_obs FROM obs",
        "tsdf_depth_bilinear": f"SELECT {voxel}, frame_id, {r6('depth')} AS depth FROM obs",
        "tsdf_fuse_classic": f"SELECT {voxel}, {r6('tsdf')} AS tsdf, {r6('weight')} AS weight, changed FROM fused",
        "tsdf_fuse_dynamic": f"SELECT {voxel}, {r6('tsdf')} AS tsdf, {r6('weight')} AS weight, changed FROM dynamic",
        "tsdf_fuse_color": f"SELECT {voxel}, {r6('tsdf')} AS tsdf, {r6('weight')} AS weight, color FROM colored",
        "dirty_blocks": "SELECT * FROM lastdirty",
        "dirty_block_count": "SELECT count(*) AS n FROM lastdirty",
        "remesh_blocks": "SELECT * FROM remesh",
        "mc_cube_index": "SELECT cx, cy, cz, cube_index FROM cells",
        "mc_triangle_count": "SELECT cx, cy, cz, count(*)::INT AS n_triangles FROM cells JOIN tri ON tri.cube_index = cells.cube_index GROUP BY ALL",
        "mc_edge_vertices": f"SELECT DISTINCT cx, cy, cz, edge, {r6('px')} AS px, {r6('py')} AS py, {r6('pz')} AS pz FROM soup",
        "mc_normals": f"SELECT cx, cy, cz, {r6('nx')} AS nx, {r6('ny')} AS ny, {r6('nz')} AS nz FROM ({_normed('cells')})",
        "mc_sparse": _soup_columns("soup"),
        "mc_dense": _soup_columns("densesoup"),
        "mc_culled": _soup_columns("soup") + " WHERE EXISTS (SELECT 1 FROM dblocks d WHERE d.bx = floor(cx / 8::DOUBLE) AND d.by = floor(cy / 8::DOUBLE) AND d.bz = floor(cz / 8::DOUBLE) AND d.bx >= 0)",
        "mc_incremental": _soup_columns("dynsoup"),
        "mc_block_spans": "SELECT bx, by, bz, triangle_base, triangle_count, triangle_base * 3 AS vertex_base, triangle_count * 3 AS vertex_count FROM (SELECT *, (sum(triangle_count) OVER (ORDER BY bx, by, bz) - triangle_count)::BIGINT AS triangle_base FROM (SELECT floor(cx / 8::DOUBLE)::INT AS bx, floor(cy / 8::DOUBLE)::INT AS by, floor(cz / 8::DOUBLE)::INT AS bz, count(*) AS triangle_count FROM cells JOIN tri ON tri.cube_index = cells.cube_index GROUP BY ALL))",
        "mc_shared_vertices": "SELECT DISTINCT " + ", ".join([*(f"CASE WHEN alone THEN c{a} ELSE o{a} END AS v{a}" for a in "xyz"), "axis", "CASE WHEN alone THEN t ELSE -1 END AS own_t", "CASE WHEN alone THEN k ELSE -1 END AS own_k", *(f"{r6(f'p{a}')} AS p{a}" for a in "xyz"), *(f"{r6(f'CASE WHEN alone THEN n{a} ELSE m{a} END')} AS n{a}" for a in "xyz")]) + " FROM owned",
        "ply_columns": f"SELECT cx, cy, cz, t, k, {_byte('r')}::INT AS red, {_byte('g')}::INT AS green, {_byte('b')}::INT AS blue FROM densesoup",
        "scene_depth_images": "SELECT f.frame_id, u.u::INT AS u, v.v::INT AS v, coalesce(p.depth, 0)::DOUBLE AS depth FROM (SELECT DISTINCT frame_id FROM pixels WHERE frame_id % 2 = 0) f, (SELECT unnest(range(32)) AS u) u, (SELECT unnest(range(24)) AS v) v LEFT JOIN pixels p ON p.frame_id = f.frame_id AND p.u = u.u AND p.v = v.v",
        "scene_color_images": f"SELECT *, {', '.join(f'{_chan('color', i)}::INT AS {n}' for i, n in enumerate(('red', 'green', 'blue')))}, 255::INT AS alpha FROM (SELECT f.frame_id, u.u::INT AS u, v.v::INT AS v, coalesce(p.color, 0)::BIGINT AS color FROM (SELECT DISTINCT frame_id FROM hues) f, (SELECT unnest(range(32)) AS u) u, (SELECT unnest(range(24)) AS v) v LEFT JOIN hues p ON p.frame_id = f.frame_id AND p.u = u.u AND p.v = v.v)",
        "newest_frames": "SELECT user_id AS source, max(event_id) AS frame_id FROM events GROUP BY user_id",
        "timestamp_delta": "SELECT event_id, (event_id * 7919 - event_id * 104729) & 65535 AS ticks, ((event_id * 7919 - event_id * 104729) & 65535) * 41.5::DOUBLE / 1000000::DOUBLE AS ms FROM events",
        "texture_project": f"SELECT cx, cy, cz, t, k, {r6('uv_u')} AS uv_u, {r6('uv_v')} AS uv_v FROM textured",
        "texture_visibility": "SELECT visible, uv_u = -1 AS behind, count(*) AS n FROM textured GROUP BY ALL",
        "stage_rows": "SELECT * FROM merged",
        "stage_totals": "SELECT sum(CASE WHEN stage <> 'click' AND NOT starts_with(stage, '  ..') THEN cpu_ms ELSE 0 END) AS total_cpu_ms, sum(CASE WHEN stage <> 'click' AND has_gpu THEN gpu_ms ELSE 0 END) AS total_gpu_ms FROM merged",
        "fuse_report": f"SELECT a AS active, d AS dirty, m AS remesh, {r6('100.0::DOUBLE * d / a')} AS dirty_pct, {r6('100.0::DOUBLE * m / a')} AS remesh_pct, {r6('m / greatest(d, 1)::DOUBLE')} AS dilation, 2.0::DOUBLE AS fps FROM (SELECT (SELECT count(*) FROM dblocks) AS a, (SELECT count(*) FROM lastdirty) AS d, (SELECT count(*) FROM remesh) AS m)",
    }
    return {name: _with(sql) for name, sql in out.items()}
