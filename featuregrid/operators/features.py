"""Feature spaces: named parts of columns, composed in order and standardised."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color, kernels
from . import planes


def xy(h: Column, w: Column) -> list[Column]:
    """Coordinates from 0 to 1."""
    scale = lambda c, n: F.col(c) / F.greatest(n - 1, F.lit(1))
    return [scale("x", w), scale("y", h)]


def _channels(convert: Callable) -> Callable[[DataFrame], list[Column]]:
    return lambda df: [c.cast("double") for c in convert(F.col("r"), F.col("g"), F.col("b"))]


#: Parts by name; each gives the columns of its planes. Texture planes are an array column.
PARTS: dict[str, Callable[[DataFrame], list[Column]]] = {
    "xy": lambda df: xy(F.col("h"), F.col("w")),
    "rgb": _channels(lambda r, g, b: (r, g, b)),
    "hsv": _channels(color.hsv),
    "lab": _channels(color.lab),
    "gray": _channels(lambda r, g, b: (color.gray(r, g, b),)),
    "texture": lambda df: [F.col("texture")],
}

#: The named feature spaces and their parts, in plane order.
SPACES: dict[str, tuple[str, ...]] = {
    "xy": ("xy",),
    "rgb": ("rgb",),
    "hsv": ("hsv",),
    "lab": ("lab",),
    "texture": ("texture",),
    "rgb_xy": ("rgb", "xy"),
    "hsv_xy": ("hsv", "xy"),
    "lab_xy": ("lab", "xy"),
    "rgb_texture": ("rgb", "texture"),
    "hsv_texture": ("hsv", "texture"),
    "lab_texture": ("lab", "texture"),
    "xy_texture": ("xy", "texture"),
    "rgb_xy_texture": ("rgb", "xy", "texture"),
    "hsv_xy_texture": ("hsv", "xy", "texture"),
    "lab_xy_texture": ("lab", "xy", "texture"),
    "rgb_hsv_lab_xy_texture": ("rgb", "hsv", "lab", "xy", "texture"),
    "xy_gray": ("xy", "gray"),
}


#: Weights of red, green and blue in a gray byte, in 2**14ths.
GRAY_WEIGHTS, GRAY_BITS = (4899, 9617, 1868), 14


def gray_byte(r, g, b):
    """A colour's gray level as the image library rounds it, for whole numbers of any kind."""
    total = sum(c * k for c, k in zip((r, g, b), GRAY_WEIGHTS)) + (1 << (GRAY_BITS - 1))
    return F.shiftright(total, GRAY_BITS) if isinstance(total, Column) else total >> GRAY_BITS


#: Filter banks of texture spaces by name.
TEXTURES: dict[str, Callable[[], list[np.ndarray]]] = {"gabor": kernels.gabor_bank, "leung_malik": kernels.derivative_bank}


def texture_planes(images: DataFrame, method: str | list[np.ndarray] = "gabor", out: str = "texture") -> DataFrame:
    """``images`` (h, w and planes r, g, b) with the responses of a filter bank to their gray levels: for
    each place an array of one number for each kernel, as the texture part of feature spaces reads it."""
    bank = TEXTURES[method]() if isinstance(method, str) else method
    gray = F.zip_with(F.arrays_zip("r", "g"), "b", lambda rg, b: gray_byte(rg["r"].cast("int"), rg["g"].cast("int"), b.cast("int")))
    rows = planes.filter_bank(images.withColumn("__gray", gray), bank, "__gray", F.col("h"), F.col("w"), out="__responses").drop("__gray")
    place = F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), lambda i: F.transform("__responses", lambda plane: F.get(plane, i)))
    return rows.withColumn(out, place).drop("__responses")


def register_part(name: str, columns: Callable[[DataFrame], list[Column]]) -> None:
    """Add a part that spaces may name."""
    PARTS[name] = columns


def feature_space(pixels: DataFrame, space: str | tuple[str, ...], out: str = "features") -> DataFrame:
    """``pixels`` with the raw features of a space; only the named parts are computed."""
    parts = SPACES[space] if isinstance(space, str) else space
    arrays = []
    for part in parts:
        for c in PARTS[part](pixels):
            arrays.append(c if part == "texture" else F.array(c))
    return pixels.withColumn(out, F.concat(*arrays))


def standardise(df: DataFrame, dims: int, col: str = "features", keys: list[str] | None = None, epsilon: float = 1e-6) -> DataFrame:
    """(x - mean) / (population deviation + epsilon) for each feature, over all rows or each key.

    One partial aggregate of two numbers a feature; its result has one row for each key. Without
    keys that row is broadcast; with keys it is joined as Spark finds fit.
    """
    stats = [F.avg(F.get(col, F.lit(i))).alias(f"m{i}") for i in range(dims)] + [F.stddev_pop(F.get(col, F.lit(i))).alias(f"s{i}") for i in range(dims)]
    pack = [F.array(*[F.col(f"{c}{i}") for i in range(dims)]).alias(n) for c, n in (("m", "__mean"), ("s", "__dev"))]
    if keys:
        joined = df.join(df.groupBy(*keys).agg(*stats).select(*keys, *pack), keys)
    else:
        joined = df.join(F.broadcast(df.agg(*stats).select(*pack)), F.lit(True))  # a single row
    scaled = F.transform(col, lambda v, i: (v - F.get("__mean", i)) / (F.get("__dev", i) + epsilon))
    return joined.withColumn(col, scaled).drop("__mean", "__dev")


def check_pixel_count(pixels: DataFrame) -> DataFrame:
    """Images with their row count, h and w; an error where the count is not h * w. The check is part
    of the column ``n``, so no plan that reads the counts leaves it out."""
    counts = pixels.groupBy("image_id").agg(F.count("*").alias("n"), F.first("h").alias("h"), F.first("w").alias("w"))
    told = F.concat(F.lit("image "), F.col("image_id").cast("string"), F.lit(" has "), F.col("n").cast("string"), F.lit(" pixels of "), F.col("h").cast("string"), F.lit(" x "), F.col("w").cast("string"))
    return counts.withColumn("n", F.when(F.col("n") == F.col("h") * F.col("w"), F.col("n")).otherwise(F.raise_error(told).cast("long")))
