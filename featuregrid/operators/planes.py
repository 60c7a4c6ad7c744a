"""Images as rows of planes, and pixels as rows.

A plane is an array of h * w values in row-major order, so a neighbourhood is a few array
reads inside one row: no join, no shuffle. Sizes are numbers, or columns where images differ.
Stencils with up to a few dozen taps are column expressions; large filter banks, resizing and
whole scorings run in NumPy over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import color

#: A side of an image: a number, or a column where images differ.
Side = int | Column


def arrays_of(column) -> list:
    """The values of a pyarrow column, lists of numbers as NumPy arrays without a Python object each."""
    import pyarrow as pa

    if not pa.types.is_list(column.type) or not (pa.types.is_integer(column.type.value_type) or pa.types.is_floating(column.type.value_type)):
        return column.to_pylist()
    values = column.values.to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    valid = column.is_valid().to_pylist()
    return [values[a:b] if ok else None for ok, a, b in zip(valid, ends[:-1].tolist(), ends[1:].tolist())]


def with_arrays(df: DataFrame, inputs: Sequence[str], outputs: dict[str, str], work: Callable, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the columns ``outputs`` (by name, with their types), which ``work`` makes for each row
    from the values of ``inputs``, planes being NumPy arrays. ``keep`` names the other columns to keep, by
    default all; a kept column that an output replaces goes. Images stay in their rows, so the step is narrow."""
    from pyspark.sql.pandas.types import to_arrow_type

    columns = [c for c in (df.columns if keep is None else keep) if c not in outputs]
    read = list(dict.fromkeys([*columns, *inputs]))
    made = [T.StructField(n, T._parse_datatype_string(kind)) for n, kind in outputs.items()]
    schema = T.StructType([df.schema[c] for c in columns] + made)
    kinds = [to_arrow_type(f.dataType) for f in made]

    def column(values: list, kind):
        import pyarrow as pa

        if pa.types.is_list(kind) and values and all(isinstance(v, np.ndarray) for v in values):
            ends = np.concatenate([[0], np.cumsum([v.size for v in values])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([v.ravel() for v in values])).cast(kind.value_type))
        return pa.array([v.ravel().tolist() if isinstance(v, np.ndarray) else v for v in values], kind)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            step = max(1, int(whole.num_rows * (8 << 20) / max(1, whole.nbytes)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                rows = list(map(work, *(arrays_of(batch.column(read.index(c))) for c in inputs)))
                fresh = [column([r[k] for r in rows], kinds[k]) for k in range(len(made))]
                yield pa.RecordBatch.from_arrays([*(batch.column(read.index(c)) for c in columns), *fresh], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in read]).mapInArrow(run, schema)


def sized(df: DataFrame, h: Side, w: Side) -> DataFrame:
    """``df`` with the sides of its images as columns ``__h`` and ``__w``."""
    return df.withColumns({"__h": side(h), "__w": side(w)})


def side(n: Side) -> Column:
    return n if isinstance(n, Column) else F.lit(n)


def grid(df: DataFrame, h: int, w: int) -> DataFrame:
    """One row for each place (y, x) beside every row of ``df``."""
    return df.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(h * w - 1)))).withColumns({"y": F.expr(f"cast(p div {w} as int)"), "x": F.expr(f"cast(p % {w} as int)")}).drop("p")


def to_pixels(df: DataFrame, planes: dict[str, str], w: Side) -> DataFrame:
    """Pixel rows from plane columns, given as {pixel column: plane column}."""
    keep = [c for c in df.columns if c not in planes.values()]
    zipped = F.arrays_zip(*[F.col(c).alias(n) for n, c in planes.items()])
    rows = df.select(*keep, side(w).alias("__w"), F.posexplode(zipped).alias("__p", "__s"))
    return rows.select(*keep, F.expr("cast(__p div __w as int)").alias("y"), F.expr("cast(__p % __w as int)").alias("x"), *[F.col(f"__s.{n}").alias(n) for n in planes])


def to_planes(pixels: DataFrame, values: list[str], key: str = "image_id") -> DataFrame:
    """One row for each image with its h, w and a plane for each of ``values``."""
    cells = F.sort_array(F.collect_list(F.struct("y", "x", *values)))
    rows = pixels.groupBy(key).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), cells.alias("cells"))
    plane = lambda name: F.transform("cells", lambda c: c[name]).alias(name)
    return rows.select(key, "h", "w", *map(plane, values))


def reflect(i: Column, n: Side) -> Column:
    """Places beyond an edge mirror, the edge itself repeated: -1 is 0, n is n - 1."""
    return F.when(i < 0, -i - 1).when(i >= n, 2 * n - 1 - i).otherwise(i)


def reflect101(i: Column, n: Side) -> Column:
    """Places beyond an edge mirror about it: -1 is 1, n is n - 2."""
    return F.when(i < 0, -i).when(i >= n, 2 * n - 2 - i).otherwise(i)


def clamp(i: Column, n: Side) -> Column:
    return F.greatest(F.least(i, side(n) - 1), F.lit(0))


BORDERS: dict[str, Callable[[Column, Side], Column]] = {"reflect": reflect, "reflect101": reflect101, "replicate": clamp}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed a single time, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stencil(plane: Column, h: Side, w: Side, taps: list[tuple[int, int]], border: str, outside: Column | None, combine: Callable[[list[Column]], Column]) -> Column:
    """A plane of ``combine`` over the values at offsets (dy, dx) of each place.

    ``border`` names a mirror rule, or 'constant' for the value ``outside``.
    """

    def all_places(held: Column) -> Column:
        def at(i: Column) -> Column:
            y, x = F.floor(i / w).cast("int"), i % w
            values = []
            for dy, dx in taps:
                yy, xx = y + dy, x + dx
                if border == "constant":
                    inside = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
                    values.append(F.when(inside, F.get(held, yy * w + xx)).otherwise(outside))
                else:
                    values.append(F.get(held, BORDERS[border](yy, h) * w + BORDERS[border](xx, w)))
            return combine(values)

        return F.transform(F.sequence(F.lit(0), side(h * w) - 1), at)

    return once(plane, all_places)


def _total(values: list[Column]) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out + v
    return out


def correlate(plane: Column, h: Side, w: Side, kernel: np.ndarray, border: str = "reflect") -> Column:
    """Correlation with a small kernel; border 'constant' pads with zeros."""
    kh, kw = kernel.shape
    taps = [(dy - kh // 2, dx - kw // 2) for dy in range(kh) for dx in range(kw)]
    weights = kernel.ravel().tolist()
    return stencil(plane, h, w, taps, border, F.lit(0.0), lambda values: _total([v * F.lit(k) for v, k in zip(values, weights)]))


def convolve(plane: Column, h: Side, w: Side, kernel: np.ndarray) -> Column:
    """True convolution, the kernel turned, with zeros outside."""
    return correlate(plane, h, w, kernel[::-1, ::-1], "constant")


def median_blur(plane: Column, h: Side, w: Side, size: int = 5) -> Column:
    r = size // 2
    taps = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    return stencil(plane, h, w, taps, "replicate", None, lambda values: F.get(F.array_sort(F.array(*values)), F.lit(size * size // 2)))


SQUARE = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def erode(mask: Column, h: Side, w: Side) -> Column:
    """3 x 3 erosion; places outside count as unset, so edges erode."""
    return stencil(mask, h, w, SQUARE, "constant", F.lit(False), lambda values: F.forall(F.array(*values), lambda v: v))


def dilate(mask: Column, h: Side, w: Side) -> Column:
    """3 x 3 dilation."""
    return stencil(mask, h, w, SQUARE, "constant", F.lit(False), lambda values: F.exists(F.array(*values), lambda v: v))


def dilate_l1(mask: Column, h: Side, w: Side, tolerance: int) -> Column:
    """Places within ``tolerance`` steps (no diagonals) of a set place; 0 leaves the mask as it is."""
    taps = [(dy, dx) for dy in range(-tolerance, tolerance + 1) for dx in range(-tolerance, tolerance + 1) if abs(dy) + abs(dx) <= tolerance]
    return stencil(mask, h, w, taps, "constant", F.lit(False), lambda values: F.exists(F.array(*values), lambda v: v))


def boundary(mask: Column, h: Side, w: Side) -> Column:
    """Set places that erosion takes away."""
    return once(mask, lambda m: F.zip_with(m, erode(m, h, w), lambda a, e: a & ~e))


def resize_nearest(df: DataFrame, plane: str, h: Side, w: Side, new_h: Side, new_w: Side, out: str) -> DataFrame:
    """``df`` with a plane of the values under each target centre."""
    rows = sized(df, h, w).withColumns({"__nh": side(new_h), "__nw": side(new_w)})
    made = with_arrays(rows, [plane, "__h", "__w", "__nh", "__nw"], {out: rows.schema[plane].dataType.simpleString()}, lambda v, a, b, c, d: (nearest(v.reshape(a, b), c, d),))
    return made.drop("__h", "__w", "__nh", "__nw")


def nearest(image: np.ndarray, new_h: int, new_w: int) -> np.ndarray:
    """The value under each target centre."""
    h, w = image.shape
    at = lambda n, m: np.minimum(np.floor((np.arange(m) + 0.5) * n / m).astype(int), n - 1)
    return image[at(h, new_h)[:, None], at(w, new_w)[None, :]]


def scaled_size(n: int, scale: float) -> int:
    """Target length of a side; a scale of 0 or less is an error."""
    if scale <= 0:
        raise ValueError("scale must be above 0")
    return max(1, round(n * scale))


def area_weights(n: int, m: int, shrink: bool) -> np.ndarray:
    """An (m, n) matrix: what each of n values gives to each of m targets. To shrink, by the share of
    the target that it covers; else linearly between centres, the ends repeated."""
    out = np.zeros((m, n))
    i, k = np.arange(m)[:, None], np.arange(n)[None, :]
    if shrink:
        cover = np.minimum((i + 1) * n / m, k + 1) - np.maximum(i * n / m, k)
        out = np.maximum(cover, 0.0) * m / n
        out[out <= 1e-12] = 0.0
        return out
    s = (np.arange(m) + 0.5) * n / m - 0.5
    low = np.floor(s).astype(int)
    np.add.at(out, (np.arange(m), np.clip(low, 0, n - 1)), 1 - (s - low))
    np.add.at(out, (np.arange(m), np.clip(low + 1, 0, n - 1)), s - low)
    return out


def resized_area(image: np.ndarray, scale: float) -> np.ndarray:
    """Shrink by area: each target is the mean of what it covers, edges by their share.
    Scale 1 changes nothing; larger scales interpolate linearly between centres."""
    new_h, new_w = scaled_size(image.shape[0], scale), scaled_size(image.shape[1], scale)
    if scale == 1.0:
        return image
    return area_weights(image.shape[0], new_h, scale < 1) @ image @ area_weights(image.shape[1], new_w, scale < 1).T


def resize_area(df: DataFrame, plane_cols: Sequence[str], h: Side, w: Side, scale: float) -> DataFrame:
    """``df`` with these planes resized as doubles, and their new sides as columns h and w."""
    scaled_size(1, scale)
    rows = sized(df, h, w)

    def work(a, b, *held):
        small = [resized_area(v.reshape(a, b).astype(float), scale) for v in held]
        return scaled_size(a, scale), scaled_size(b, scale), *small

    kept = [c for c in df.columns if c not in (*plane_cols, "h", "w")]
    return with_arrays(rows, ["__h", "__w", *plane_cols], {"h": "int", "w": "int", **{c: "array<double>" for c in plane_cols}}, work, keep=kept)


def filter_bank(df: DataFrame, kernels: list[np.ndarray], plane: str, h: Side, w: Side, border: str = "reflect", out: str = "responses") -> DataFrame:
    """``df`` with an array of response planes, one for each kernel, for kernels of any size.

    The kernels go to the workers with the function. Mirrors repeat where a kernel reaches over more
    than one image length.
    """
    mode = {"reflect": "symmetric", "reflect101": "reflect", "constant": "constant"}[border]

    def work(values, a, b):
        image, responses = values.reshape(a, b).astype(float), []
        spectra: dict[tuple[int, int], tuple] = {}
        for k in kernels:
            kh, kw = k.shape
            if (kh, kw) not in spectra:
                padded = np.pad(image, ((kh // 2, kh // 2), (kw // 2, kw // 2)), mode=mode)
                spectra[kh, kw] = padded, np.fft.rfft2(padded) if kh * kw > 120 else None
            padded, spectrum = spectra[kh, kw]
            if spectrum is None:
                responses.append(np.einsum("yxij,ij->yx", np.lib.stride_tricks.sliding_window_view(padded, (kh, kw)), k))
            else:  # by Fourier transform: correlation is convolution with the turned kernel
                turned = np.fft.rfft2(k[::-1, ::-1], padded.shape)
                responses.append(np.fft.irfft2(spectrum * turned, padded.shape)[kh - 1 :, kw - 1 :][:a, :b])
        return ([r.ravel().tolist() for r in responses],)

    return with_arrays(sized(df, h, w), [plane, "__h", "__w"], {out: "array<array<double>>"}, work, keep=df.columns)


def painted(df: DataFrame, plane: str, out: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """``df`` with three planes of the palette's colours for a plane of labels, however many there are."""

    def work(labels):
        table = color.palette(int(labels.max(initial=0)) + 1).astype(np.int32)
        return tuple(table[labels].T)

    return with_arrays(df, [plane], dict.fromkeys(out, "array<int>"), work)


def activation(responses: Column) -> Column:
    """The largest absolute response of all filters at each place."""
    first = F.transform(F.element_at(responses, 1), lambda v: F.lit(0.0))
    return F.aggregate(responses, first, lambda acc, plane: F.zip_with(acc, plane, lambda a, v: F.greatest(a, F.abs(v))))


def minmax_u8(plane: Column) -> Column:
    """Values stretched to 0..255 and truncated; a flat plane is all 0."""
    ends = F.struct(F.array_min(plane).alias("low"), F.array_max(plane).alias("high"))
    scaled = lambda v, e: F.floor(F.coalesce(F.try_divide((v - e["low"]) * 255.0, e["high"] - e["low"]), F.lit(0.0))).cast("int")
    return once(ends, lambda e: F.transform(plane, lambda v: scaled(v, e)))
