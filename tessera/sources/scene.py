"""RGB-D scenes on disk: intrinsics, trajectory and numbered colour and depth images."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.params import ParameterError

INTRINSICS = "fx double, fy double, cx double, cy double, w double, h double, scale double"


def intrinsics(spark: SparkSession, path: str) -> dict[str, float]:
    """The seven numbers of a flat JSON file; all are required, finite and in range."""
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", INTRINSICS).alias("k")).select("k.*").first()
    values = row.asDict() if row else {}
    missing = [k for k in ("fx", "fy", "cx", "cy", "w", "h", "scale") if values.get(k) is None]
    if missing:
        raise ParameterError(f"camera file lacks {', '.join(missing)}")
    if not all(np.isfinite(v) for v in values.values()):
        raise ParameterError("camera file has a number that is not finite")
    if min(values["fx"], values["fy"], values["scale"]) <= 0 or not (1 <= values["w"] <= 65535 and 1 <= values["h"] <= 65535):
        raise ParameterError("camera file has a focal length, scale or size out of range")
    return values


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """(frame_id, pose): one row-major 4 by 4 matrix a line, turned column-major. A blank line before a data line, a
    malformed line or an empty file is an error; blank lines at the end are not."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text")).withColumn("text", F.trim("text"))
    numbers = F.transform(F.split("text", "\\s+"), lambda v: v.try_cast("double"))
    parsed = lines.where("text <> ''").withColumn("m", numbers)
    check = parsed.agg(F.count("*").alias("n"), F.max("line").alias("last"), F.sum((((F.size("m") != 16) | F.exists("m", lambda v: v.isNull() | F.isnan(v)))).cast("int")).alias("bad")).first()
    if not check["n"]:
        raise ParameterError("the trajectory is empty")
    if check["bad"] or check["last"] + 1 != check["n"]:
        raise ParameterError("the trajectory has a malformed or blank line before its end")
    places = F.array(*[F.lit(4 * r + c) for c in range(4) for r in range(4)])
    return parsed.select(F.col("line").alias("frame_id"), F.transform(places, lambda i: F.get("m", i)).alias("pose"))


def decode_png(raw: bytes) -> np.ndarray:
    """(height, width, channels) samples of a non-interlaced PNG of 8 or 16 bits: grey, grey and alpha, RGB or RGBA."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ParameterError("not a PNG file")
    at, data, head = 8, [], None
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(head[3]) if head else None
    if channels is None or head[2] not in (8, 16) or head[6]:
        raise ParameterError("images are grey or RGB PNGs of 8 or 16 bits, with or without alpha, not interlaced")
    width, height = head[:2]
    step = channels * head[2] // 8
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, 1 + step * width)
    except (zlib.error, ValueError) as e:
        raise ParameterError(f"damaged PNG file: {e}") from e
    out, up = np.empty((height, step * width), dtype=np.uint8), np.zeros(step * width, dtype=np.uint8)
    for y in range(height):
        kind, line = int(lines[y, 0]), lines[y, 1:]
        if kind == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            line = line + up
        elif kind in (3, 4):  # every byte needs its left neighbour, so these go byte by byte
            row, above = bytearray(step) + line.tobytes(), bytes(step) + up.tobytes()
            for x in range(step, len(row)):
                left, b, c = row[x - step], above[x], above[x - step]
                if kind == 3:
                    guess = (left + b) >> 1
                else:
                    p, q, r = abs(b - c), abs(left - c), abs(left + b - 2 * c)
                    guess = left if p <= q and p <= r else b if q <= r else c
                row[x] = (row[x] + guess) & 255
            line = np.frombuffer(bytes(row[step:]), dtype=np.uint8)
        elif kind:
            raise ParameterError("damaged PNG file: unknown line filter")
        out[y] = up = line
    samples = out.reshape(height, width, channels, head[2] // 8).astype(np.uint16)
    return samples[..., 0] if head[2] == 8 else samples[..., 0] << 8 | samples[..., 1]


def decode_depth(raw: bytes) -> np.ndarray:
    """Rows of a 16-bit, one-channel PNG."""
    if raw[24:26] != b"\x10\x00":
        raise ParameterError("depth images are PNGs of 16 bits and one channel")
    return decode_png(raw)[..., 0]


def decode_color(raw: bytes) -> np.ndarray:
    """Rows of packed colours, red lowest, without alpha, of an 8-bit PNG; grey is spread to all three."""
    if raw[24:25] != b"\x08":
        raise ParameterError("colour images are PNGs of 8 bits a channel")
    image = decode_png(raw).astype(np.int64)
    r, g, b = (image[..., i if image.shape[2] > 2 else 0] for i in range(3))
    return r | g << 8 | b << 16


def encode_png(samples: np.ndarray, filters: tuple[int, ...] = (0,)) -> bytes:
    """A PNG of (height, width, channels) samples, 8 or 16 bits by their type; its lines use the filters in turn."""
    height, width, channels = samples.shape
    bits = 8 * samples.dtype.itemsize
    step = channels * bits // 8
    rows = np.ascontiguousarray(samples, dtype=samples.dtype.newbyteorder(">")).view(np.uint8).reshape(height, -1).astype(np.int64)
    edged = np.pad(rows, ((1, 0), (step, 0)))
    left, up, corner = edged[1:, :-step], edged[:-1, step:], edged[:-1, :-step]
    p, q, r = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
    paeth = np.where((p <= q) & (p <= r), left, np.where(q <= r, up, corner))
    guess = np.stack([rows * 0, left, up, (left + up) >> 1, paeth])
    kinds = np.resize(np.array(filters), height)
    lines = np.concatenate([kinds[:, None], (rows - guess[kinds, np.arange(height)]) & 255], axis=1).astype(np.uint8)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", width, height, bits, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def image_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(frame_id, content) of the numbered PNG files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("int").alias("frame_id"), "content")


def decoded(files: DataFrame, width: int, height: int, stride: int, value: str, kind: str, decoder) -> DataFrame:
    """(frame_id, u, v, value) of the files at the stride; the others are never decoded."""
    frames = files.where(F.col("frame_id") % stride == 0)
    arrow = pa.float64() if kind == "double" else pa.int64()

    def decode(batches):
        for batch in batches:
            for frame, raw in zip(batch.column("frame_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                image = decoder(raw)
                if image.shape != (height, width):
                    raise ParameterError(f"frame {frame} is {image.shape[1]} by {image.shape[0]}")
                v, u = np.divmod(np.arange(image.size, dtype=np.int32), width)
                yield pa.RecordBatch.from_pydict({"frame_id": pa.array(np.full(image.size, frame, np.int32)), "u": pa.array(u.astype(np.int32)), "v": pa.array(v.astype(np.int32)), value: pa.array(image.reshape(-1), arrow)})

    return frames.mapInArrow(decode, f"frame_id int, u int, v int, {value} {kind}")


def depth_pixels(spark: SparkSession, folder: str, scale: float, width: int, height: int, stride: int = 1, glob: str = "depth*.png") -> DataFrame:
    """(frame_id, u, v, depth) in metres of the numbered depth images; frames not at the stride are never decoded.

    An image of another size or kind is an error.
    """
    return depth_of(image_files(spark, folder, glob), scale, width, height, stride)


def depth_of(files: DataFrame, scale: float, width: int, height: int, stride: int = 1) -> DataFrame:
    """depth_pixels of images given as (frame_id, content)."""
    return decoded(files, width, height, stride, "depth", "double", lambda raw: decode_depth(raw) * (1.0 / scale))


def color_pixels(spark: SparkSession, folder: str, width: int, height: int, stride: int = 1, glob: str = "frame*.png") -> DataFrame:
    """(frame_id, u, v, color) of the numbered colour images, packed; as depth_pixels otherwise."""
    return color_of(image_files(spark, folder, glob), width, height, stride)


def color_of(files: DataFrame, width: int, height: int, stride: int = 1) -> DataFrame:
    """color_pixels of images given as (frame_id, content)."""
    return decoded(files, width, height, stride, "color", "long", decode_color)


class FrameNotFound(FileNotFoundError):
    """The trajectory lists the frame, but its images are not there: a reader can stop cleanly."""


def load_frame(spark: SparkSession, folder: str, index: int, poses: DataFrame, camera: dict[str, float]) -> DataFrame:
    """(frame_id, u, v, depth, color, pose) of one frame.

    An index past the trajectory is a ParameterError, an image that is not on disk FrameNotFound; one that is there
    and cannot be decoded, or has another size, is an error when the rows are read.
    """
    if index < 0 or index >= poses.count():
        raise ParameterError(f"frame {index} is past the trajectory")
    width, height = int(camera["w"]), int(camera["h"])
    names = {k: f"{k}{index:06d}.png" for k in ("depth", "frame")}
    for name in names.values():
        if spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder).select("path").isEmpty():
            raise FrameNotFound(f"{name} is not in {folder}")
    depth = depth_pixels(spark, folder, camera["scale"], width, height, glob=names["depth"])
    color = color_pixels(spark, folder, width, height, glob=names["frame"])
    return depth.join(color, ["frame_id", "u", "v"]).join(poses, "frame_id")


def pack_rgb(r, g, b):
    """Packed colour of byte columns, without alpha."""
    return r.bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(F.shiftleft(b, 16))


def unpack_rgba(packed) -> list:
    """Red, green, blue bytes and full alpha of a packed colour."""
    return [F.shiftright(packed, 8 * i).bitwiseAND(F.lit(255)) for i in range(3)] + [F.lit(255)]


def preload_bytes(frames: int, width: int, height: int) -> int:
    return frames * width * height * 8


def newest(frames: DataFrame, key: str = "source", order: str = "frame_id") -> DataFrame:
    """The newest frame of every source, older ones dropped, as a live capture does."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return frames.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
