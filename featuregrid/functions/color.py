"""Colour conversions of 8-bit channels as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _round_u8(v: Column) -> Column:
    return F.greatest(F.least(F.floor(v + 0.5), F.lit(255)), F.lit(0)).cast("int")


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit hue (degrees / 2, 0..179), saturation and value."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = (top - low).cast("double")
    turn = F.when(d == 0, 0.0).when(top == r, 60.0 * F.try_divide(g - b, d)).when(top == g, 120.0 + 60.0 * F.try_divide(b - r, d)).otherwise(240.0 + 60.0 * F.try_divide(r - g, d))
    turn = F.when(turn < 0, turn + 360.0).otherwise(turn)
    hue = F.pmod(F.floor(turn / 2.0 + 0.5), F.lit(180)).cast("int")
    sat = F.when(top == 0, 0).otherwise(_round_u8(F.try_divide(255.0 * d, top)))
    return hue, sat, top.cast("int")


# Linear sRGB to XYZ under D65, row by row, and the white point's X and Z.
_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
_WHITE = (0.950456, 1.0, 1.088754)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit L*, a*, b*: L * 255 / 100, a + 128, b + 128."""
    rgb = [c / 255.0 for c in (r, g, b)]
    rgb = [F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92) for c in rgb]
    xyz = [(m[0] * rgb[0] + m[1] * rgb[1] + m[2] * rgb[2]) / w for m, w in zip(_XYZ, _WHITE)]
    fx, fy, fz = (F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0) for t in xyz)
    light = F.when(xyz[1] > 0.008856, 116.0 * fy - 16.0).otherwise(903.3 * xyz[1])
    return _round_u8(light * 255.0 / 100.0), _round_u8(500.0 * (fx - fy) + 128.0), _round_u8(200.0 * (fy - fz) + 128.0)


def packed(r: Column, g: Column, b: Column) -> Column:
    """r, g, b in one 24-bit integer."""
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def hex_name(code: Column) -> Column:
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(code), 6, "0")))


def jet(level: Column) -> tuple[Column, Column, Column]:
    """r, g, b of the JET map at an 8-bit level: ramps of slope 4 around 3/4, 1/2 and 1/4."""
    t = level.cast("double") / 255.0
    ramp = lambda centre: _round_u8(255.0 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.5 - F.abs(4.0 * t - 4.0 * centre))))
    return ramp(0.75), ramp(0.5), ramp(0.25)


#: Seed and range of the palette's channels.
PALETTE_SEED, PALETTE_RANGE = 12345, (30, 245)


def palette(n: int) -> np.ndarray:
    """The colours of labels 0 to n - 1 as rows r, g, b; label 0 is black. More labels leave the
    colours of the first ones as they are."""
    table = np.random.default_rng(PALETTE_SEED).integers(*PALETTE_RANGE, size=(max(n, 1), 3), dtype=np.uint8)
    table[0] = 0
    return table


def palette_color(label: Column, n: int) -> tuple[Column, Column, Column]:
    """A fixed colour for each of n labels; labels beyond are clipped. For label planes with any number
    of labels see ``operators.planes.painted``."""
    table = palette(n).astype(int)
    place = F.greatest(F.least(label.cast("int"), F.lit(n - 1)), F.lit(0))
    channels = (F.expr("array(" + ", ".join(map(str, table[:, k])) + ")") for k in range(3))
    r, g, b = (F.get(c, place) for c in channels)
    return r, g, b
