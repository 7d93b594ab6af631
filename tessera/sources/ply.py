"""Binary PLY: the columns of a mesh as file fields, and a writer for meshes that fit one file."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.color import to_byte


def ply_columns(vertices: DataFrame) -> DataFrame:
    """x y z nx ny nz as floats and sRGB bytes; colours that are not numbers become 0. The order columns are kept."""
    place = [F.col(a).cast("float").alias(b) for a, b in zip(("px", "py", "pz", "nx", "ny", "nz"), ("x", "y", "z", "nx", "ny", "nz"), strict=True)]
    return vertices.select("cx", "cy", "cz", "t", "k", *place, *[to_byte(F.col(c)).cast("int").alias(n) for c, n in zip("rgb", ("red", "green", "blue"), strict=True)])


def write_ply(vertices: DataFrame, path: str) -> int:
    """Writes a triangle soup to one local file, streaming partition by partition; returns the number of triangles.

    A PLY file is one sequential stream with its counts in front, so a single writer is part of the format; rows
    come sorted and are never held together.
    """
    rows = ply_columns(vertices).orderBy("cx", "cy", "cz", "t", "k").drop("cx", "cy", "cz", "t", "k")
    n = vertices.count()
    fields = "".join(f"property float {a}\n" for a in ("x", "y", "z", "nx", "ny", "nz")) + "".join(f"property uchar {a}\n" for a in ("red", "green", "blue"))
    with open(path, "wb") as out:
        out.write(f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\n{fields}element face {n // 3}\nproperty list uchar int vertex_indices\nend_header\n".encode())
        for r in rows.toLocalIterator(prefetchPartitions=True):
            out.write(struct.pack("<6f3B", *r))
        for i in range(0, n - n % 3, 3):
            out.write(struct.pack("<B3i", 3, i, i + 1, i + 2))
    return n // 3


def read_ply_counts(path: str) -> tuple[int, int]:
    """(vertices, faces) a file's header declares."""
    with open(path, "rb") as f:
        head = f.read(4096).split(b"end_header")[0].decode()
    counts = dict(line.split()[1:] for line in head.splitlines() if line.startswith("element"))
    return int(counts["vertex"]), int(counts["face"])
