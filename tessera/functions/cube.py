"""Marching-cubes cases, built from a rule: the surface polygons of a cube follow from its corner signs face by face."""

from __future__ import annotations

from functools import lru_cache

#: Corner offsets and edge endpoints of the cell numbering.
CORNERS = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
EDGES = ((0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7))

#: Corners of the six faces, anticlockwise seen from outside.
FACES = ((0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7))
_EDGE = {frozenset(e): i for i, e in enumerate(EDGES)}


def low_end(edge: int) -> tuple[int, int]:
    """An edge's corners, the one nearer the cell's base first."""
    a, b = EDGES[edge]
    return (a, b) if CORNERS[a] < CORNERS[b] else (b, a)


def axis_of(edge: int) -> int:
    a, b = (CORNERS[c] for c in EDGES[edge])
    return next(i for i in range(3) if a[i] != b[i])


def polygons(case: int) -> list[list[int]]:
    """Closed loops of crossed edges. On every face each run of inside corners is cut off by itself, so a face
    with two opposite inside corners keeps them apart, and neighbouring cells agree."""
    after = {}
    for face in FACES:
        inside = [case >> c & 1 for c in face]
        for i in range(4):
            if inside[i] and not inside[i - 1]:  # a run starts at i
                j = i
                while inside[(j + 1) % 4]:
                    j += 1
                enter = _EDGE[frozenset((face[i - 1], face[i]))]
                leave = _EDGE[frozenset((face[j % 4], face[(j + 1) % 4]))]
                after[leave] = enter
    loops = []
    while after:
        start = min(after)
        loop, edge = [start], after.pop(start)
        while edge != start:
            loop.append(edge)
            edge = after.pop(edge)
        loops.append(loop)
    return loops


@lru_cache(maxsize=1)
def triangles() -> tuple[tuple[int, int, int, int, int], ...]:
    """(case, number, e0, e1, e2): fans of the polygons, winding towards the inside; cases 0 and 255 have none."""
    rows = []
    for case in range(1, 255):
        fans = [(loop[0], a, b) for loop in polygons(case) for a, b in zip(loop[1:], loop[2:], strict=False)]
        rows += [(case, t, *fan) for t, fan in enumerate(fans)]
    return tuple(rows)
