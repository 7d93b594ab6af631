"""Colour expressions: the piecewise sRGB curve, packed words and primaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.params import PRIMARIES, TRANSFERS, ParameterError, is_canonical

ALPHA = 0xFF000000


def srgb_to_linear(e: Column) -> Column:
    return F.when(e <= 0.04045, e / 12.92).otherwise(F.pow((e + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1.0 / 2.4)) - 0.055)


def channel(packed: Column, i: int) -> Column:
    return F.shiftright(packed, 8 * i).bitwiseAND(F.lit(255))


def unpack_linear(packed: Column) -> list[Column]:
    return [srgb_to_linear(channel(packed, i) / 255.0) for i in range(3)]


def to_byte(v: Column) -> Column:
    """Encoded byte of a linear channel: clamped, NaN and null to 0, rounded to nearest."""
    safe = F.when(v.isNull() | F.isnan(v) | (v <= 0), F.lit(0.0)).when(v >= 1, F.lit(1.0)).otherwise(v)
    return F.floor(F.least(linear_to_srgb(safe), F.lit(1.0)) * 255.0 + 0.5).cast("long")


def pack_bytes(r: Column, g: Column, b: Column) -> Column:
    return r.bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(F.shiftleft(b, 16)).bitwiseOR(F.lit(ALPHA))


def pack_linear(r: Column, g: Column, b: Column) -> Column:
    return pack_bytes(to_byte(r), to_byte(g), to_byte(b))


def opaque(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(0xFFFFFF)).bitwiseOR(F.lit(ALPHA))


def rotate(rgb: list[Column], primaries: str) -> list[Column]:
    return [row[0] * rgb[0] + row[1] * rgb[1] + row[2] * rgb[2] for row in PRIMARIES[primaries]]


def to_canonical(frames: DataFrame, transfer: str, primaries: str, column: str = "color", out: str = "canonical") -> DataFrame:
    """Adds the canonical packed colour. Canonical input only gets its alpha; the PQ transfer is refused, even for no rows."""
    if transfer not in TRANSFERS or primaries not in PRIMARIES:
        raise ParameterError("unknown colour encoding")
    if transfer == "bt2020_pq":
        raise NotImplementedError("the PQ transfer has no canonical form here")
    c = F.col(column)
    if is_canonical(transfer, primaries):
        return frames.withColumn(out, opaque(c))
    rgb = [channel(c, i) / 255.0 for i in range(3)] if transfer == "linear" else unpack_linear(c)
    return frames.withColumn(out, pack_linear(*rotate(rgb, primaries)))
