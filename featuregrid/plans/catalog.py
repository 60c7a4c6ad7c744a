"""Registered queries of the engine and the SQL they are held against.

Each query runs over whole tables. Floats are rounded to six places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, kernels, scalar, weights
from ..operators import clustering, evaluation, features, matching, metrics, planes, raster, regions, report, scoring, segmentation, stats
from ..shared import remove, shared_dir
from ..sources import files, sinks
from . import fixtures as fx
from .fixtures import DIMS, SIDE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
H = W = SIDE
IMG = ["image_id"]


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracles() -> dict[str, str]:
    return ORACLES


def r6(c, name: str):
    """Rounded; adding 0.0 turns -0.0 into 0.0."""
    return (F.round(c, 6) + 0.0).alias(name)


def _pixels(df: DataFrame, plane: str, name: str, floats: bool = False) -> DataFrame:
    """Pixel rows of one computed plane."""
    rows = planes.to_pixels(df.select("image_id", F.col(plane)), {name: plane}, W)
    return rows.withColumn(name, r6(F.col(name), name)) if floats else rows


# Pixels, coordinates and colours


@query(f"with {fx.G} select image_id, y, x, round(v, 6) + 0.0 as v from g")
def pixel_grid(spark, d):
    return fx.pixel_rows(spark, d).select("image_id", "y", "x", r6(F.col("v"), "v"))


@query(f"with {fx.G} select image_id, y, x, round(x / 7.0, 6) as fx, round(y / 7.0, 6) as fy from g")
def xy_features(spark, d):
    a, b = features.xy(F.lit(H), F.lit(W))
    return fx.pixel_rows(spark, d).select("image_id", "y", "x", r6(a, "fx"), r6(b, "fy"))


@query(f"with {fx.C} select image_id, y, x, round((0.299 * r + 0.587 * g + 0.114 * b)::double, 6) as gray from px")
def color_gray(spark, d):
    return fx.color_pixels(spark, d).select("image_id", "y", "x", r6(color.gray(F.col("r"), F.col("g"), F.col("b")), "gray"))


@query(f"""with {fx.C}, t as (select *, greatest(r, g, b) as top, greatest(r, g, b) - least(r, g, b) as d from px),
u as (select *, case when d = 0 then 0 when top = r then 60.0 * (g - b) / d when top = g then 120 + 60.0 * (b - r) / d else 240 + 60.0 * (r - g) / d end as a from t)
select image_id, y, x, cast(floor((case when a < 0 then a + 360 else a end) / 2.0 + 0.5) as int) % 180 as hue, case when top = 0 then 0 else cast(floor(255.0 * d / top + 0.5) as int) end as sat, top as val from u""")
def color_hsv(spark, d):
    h, s, v = color.hsv(F.col("r"), F.col("g"), F.col("b"))
    return fx.color_pixels(spark, d).select("image_id", "y", "x", h.alias("hue"), s.alias("sat"), v.alias("val"))


_LIN = lambda c: f"case when {c} / 255.0 > 0.04045 then pow(({c} / 255.0 + 0.055) / 1.055, 2.4) else {c} / 255.0 / 12.92 end"
_F = lambda t: f"case when {t} > 0.008856 then cbrt({t}) else 7.787 * {t} + 16.0 / 116.0 end"
_U8 = lambda e: f"cast(greatest(least(floor({e} + 0.5), 255), 0) as int)"


@query(f"""with {fx.C}, l as (select *, {_LIN("r")} as lr, {_LIN("g")} as lg, {_LIN("b")} as lb from px),
t as (select *, (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456 as tx, (0.212671 * lr + 0.715160 * lg + 0.072169 * lb) as ty, (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754 as tz from l),
u as (select *, {_F("tx")} as ux, {_F("ty")} as uy, {_F("tz")} as uz from t)
select image_id, y, x, {_U8("(case when ty > 0.008856 then 116.0 * uy - 16.0 else 903.3 * ty end) * 255.0 / 100.0")} as l, {_U8("500.0 * (ux - uy) + 128.0")} as a, {_U8("200.0 * (uy - uz) + 128.0")} as b from u""")
def color_lab(spark, d):
    el, a, b = color.lab(F.col("r"), F.col("g"), F.col("b"))
    return fx.color_pixels(spark, d).select("image_id", "y", "x", el.alias("l"), a.alias("a"), b.alias("b"))


@query(f"with {fx.C} select image_id, y, x, r * 65536 + g * 256 + b as code, '#' || lower(lpad(hex(r * 65536 + g * 256 + b), 6, '0')) as name from px")
def color_pack_hex(spark, d):
    code = color.packed(F.col("r"), F.col("g"), F.col("b"))
    return fx.color_pixels(spark, d).select("image_id", "y", "x", code.alias("code"), color.hex_name(code).alias("name"))


@query(f"with {fx.C} select image_id, y, x, cast(dense_rank() over (partition by image_id order by r * 65536 + g * 256 + b) - 1 as int) as label, '#' || lower(lpad(hex(r * 65536 + g * 256 + b), 6, '0')) as label_name from px")
def mask_labels(spark, d):
    return files.mask_labels(fx.color_pixels(spark, d)).select("image_id", "y", "x", "label", "label_name")


_RAMP = lambda c: f"cast(floor(255.0 * greatest(0.0, least(1.0, 1.5 - abs(4.0 * (k / 255.0) - 4.0 * {c}))) + 0.5) as int)"


@query(f"""with {fx.G}, s as (select image_id, y, x, v, min(v) over (partition by image_id) as lo, max(v) over (partition by image_id) as hi from g),
u as (select *, cast(floor((v - lo) * 255.0 / (hi - lo)) as int) as k from s) select image_id, y, x, k as level, {_RAMP(0.75)} as r, {_RAMP(0.5)} as g, {_RAMP(0.25)} as b from u""")
def jet_display(spark, d):
    rows = _pixels(fx.plane_rows(spark, d).withColumn("u", planes.minmax_u8(F.col("v"))), "u", "level")
    r, g, b = color.jet(F.col("level"))
    return rows.select("*", r.alias("r"), g.alias("g"), b.alias("b"))


# The first colours of the palette, by label.
_PALETTE = ((0, 0, 0), (148, 178, 71), (78, 216, 194), (221, 198, 47))


@query(f"with {fx.M}, p(label, r, g, b) as (values {', '.join(str((k, *c)) for k, c in enumerate(_PALETTE))}) select image_id, y, x, p.r, p.g, p.b from m join p on label = pred")
def palette_display(spark, d):
    rows = planes.painted(fx.mask_planes(spark, d).select("image_id", "pred"), "pred").drop("pred")
    return planes.to_pixels(rows, {c: c for c in "rgb"}, W)


@query(f"with {fx.C}, l as (select *, (r + g) % 4 as label from px), a as (select image_id, label, floor(avg(r)) as ar, floor(avg(g)) as ag, floor(avg(b)) as ab from l group by all) select image_id, y, x, label, cast(ar as int) as r, cast(ag as int) as g, cast(ab as int) as b from l join a using (image_id, label)")
def segment_mean_color(spark, d):
    rows = fx.color_pixels(spark, d).withColumn("label", (F.col("r") + F.col("g")) % 4)
    means = rows.groupBy("image_id", "label").agg(*[F.floor(F.avg(c)).cast("int").alias(f"m{c}") for c in "rgb"])
    return rows.join(means, ["image_id", "label"]).select("image_id", "y", "x", "label", *[F.col(f"m{c}").alias(c) for c in "rgb"])


@query(f"with {fx.G}, s as (select *, min(v) over (partition by image_id) as lo, max(v) over (partition by image_id) as hi from g) select image_id, y, x, cast(floor((v - lo) * 255.0 / (hi - lo)) as int) as u from s")
def minmax_u8(spark, d):
    return _pixels(fx.plane_rows(spark, d).withColumn("u", planes.minmax_u8(F.col("v"))), "u", "u")


# Feature spaces


@query(f"with {fx.V}, e as (select id, unnest(range(1, 65)) as k, unnest(f) as x from v), a as (select k, avg(x) as m, stddev_pop(x) as s from e group by k) select id, cast(k - 1 as int) as dim, round((x - m) / (s + 1e-6), 6) + 0.0 as z from e join a using (k)")
def standardize(spark, d):
    rows = features.standardise(fx.vectors(spark, d), DIMS).select("id", F.posexplode("features").alias("dim", "z"))
    return rows.select("id", "dim", r6(F.col("z"), "z"))


@query(f"""with {fx.C}, e as (select image_id, y, x, x / 7.0 as a, y / 7.0 as b, 0.299 * r + 0.587 * g + 0.114 * b as c from px),
s as (select image_id, avg(a) as ma, stddev_pop(a) as sa, avg(b) as mb, stddev_pop(b) as sb, avg(c) as mc, stddev_pop(c) as sc from e group by image_id)
select image_id, y, x, round((a - ma) / (sa + 1e-6), 6) + 0.0 as f0, round((b - mb) / (sb + 1e-6), 6) + 0.0 as f1, round((c - mc) / (sc + 1e-6), 6) + 0.0 as f2 from e join s using (image_id)""")
def feature_space_xy_gray(spark, d):
    rows = features.standardise(features.feature_space(fx.color_pixels(spark, d), "xy_gray"), 3, keys=IMG)
    return rows.select("image_id", "y", "x", *[r6(F.get("features", F.lit(i)), f"f{i}") for i in range(3)])


@query(f"with {fx.C} select image_id, y, x, r::double as f0, g::double as f1, b::double as f2, round(x / 7.0, 6) as f3, round(y / 7.0, 6) as f4 from px")
def feature_space_rgb_xy(spark, d):
    rows = features.feature_space(fx.color_pixels(spark, d), "rgb_xy")
    return rows.select("image_id", "y", "x", *[r6(F.get("features", F.lit(i)), f"f{i}") for i in range(5)])


@query(f"with {fx.C} select image_id, count(*) as n, cast(max(y) + 1 as int) as h, cast(max(x) + 1 as int) as w from px group by image_id")
def pixel_count_invariant(spark, d):
    """Every image has as many pixels as its sides say; the last one is less high."""
    pixels = fx.color_pixels(spark, d)
    sides = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return features.check_pixel_count(pixels.drop("h", "w").join(sides, "image_id"))


# Neighbourhoods

_K = [[1.0, 2.0, 0.5], [0.0, -1.0, 1.5], [-2.0, 0.25, 3.0]]
_TAPS = "k(dy, dx, w) as (values " + ", ".join(f"({i - 1}, {j - 1}, {_K[i][j]!r}::double)" for i in range(3) for j in range(3)) + ")"
_REFLECT = lambda e: f"case when {e} < 0 then -({e}) - 1 when {e} > 7 then 15 - ({e}) else {e} end"
_REFLECT101 = lambda e: f"case when {e} < 0 then -({e}) when {e} > 7 then 14 - ({e}) else {e} end"
_PLAIN = lambda e: e


def _correlation_sql(border, turned: bool = False) -> str:
    sign = "-" if turned else "+"
    return f"with {fx.G}, {_TAPS} select a.image_id, a.y, a.x, round(coalesce(sum(w * b.v), 0), 6) + 0.0 as v from g a cross join k left join g b on b.image_id = a.image_id and b.y = {border(f'a.y {sign} dy')} and b.x = {border(f'a.x {sign} dx')} group by all"


def _filtered(spark, d, plane):
    return _pixels(fx.plane_rows(spark, d).withColumn("o", plane(F.col("v"))), "o", "v", True)


@query(_correlation_sql(_REFLECT))
def correlate_3x3_reflect(spark, d):
    return _filtered(spark, d, lambda v: planes.correlate(v, H, W, np.array(_K)))


@query(_correlation_sql(_REFLECT101))
def correlate_3x3_reflect101(spark, d):
    return _filtered(spark, d, lambda v: planes.correlate(v, H, W, np.array(_K), "reflect101"))


@query(_correlation_sql(_PLAIN, True))
def convolve_zero(spark, d):
    return _filtered(spark, d, lambda v: planes.convolve(v, H, W, np.array(_K)))


_GABOR = {"size": 5, "wavelengths": (4, 8), "orientations": (0.0, np.pi / 4), "phases": (0.0, 0.8), "sigma": 4.0, "aspect": 0.1}
_GABOR_SQL = (
    "o(theta, t) as (values (0.0::double, 0), (pi() / 4, 1)), ph(phi, q) as (values (0.0::double, 0), (0.8::double, 1)), wl(lam, l) as (values (4.0::double, 0), (8.0::double, 1)),"
    " offs as (select dy, dx from range(-2, 3) a(dy), range(-2, 3) b(dx)),"
    " bank as (select t * 4 + q * 2 + l as k, dy, dx, exp(-0.5 * ((-dx * cos(theta) - dy * sin(theta)) / 4.0) ** 2 - 0.5 * ((-dy * cos(theta) + dx * sin(theta)) * 0.1 / 4.0) ** 2) * cos(2 * pi() * (-dx * cos(theta) - dy * sin(theta)) / lam + phi) as w from o, ph, wl, offs)"
)


def _weights(spark, bank):
    """Rows (kernel, dy, dx, weight) of a list of kernels."""
    rows = [(k, y - a.shape[0] // 2, x - a.shape[1] // 2, float(v)) for k, a in enumerate(bank) for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "kernel int, dy int, dx int, weight double").withColumn("weight", r6(F.col("weight"), "weight"))


@query(
    "with o(theta, t) as (values (0.0::double, 0), (pi() / 4, 1), (pi() / 2, 2), (3 * pi() / 4, 3)), ph(phi, q) as (values (0.0::double, 0), (0.8::double, 1)), wl(lam, l) as (values (4.0::double, 0), (8.0::double, 1), (16.0::double, 2), (32.0::double, 3))"
    " select cast(t * 8 + q * 4 + l as int) as kernel, cast(dy as int) as dy, cast(dx as int) as dx, round(exp(-0.5 * ((-dx * cos(theta) - dy * sin(theta)) / 4.0) ** 2 - 0.5 * ((-dy * cos(theta) + dx * sin(theta)) * 0.1 / 4.0) ** 2) * cos(2 * pi() * (-dx * cos(theta) - dy * sin(theta)) / lam + phi), 6) + 0.0 as weight"
    " from o, ph, wl, range(-15, 16) a(dy), range(-15, 16) b(dx)"
)
def gabor_bank(spark, d):
    """Weights of the 32 Gabor kernels of side 31."""
    return _weights(spark, kernels.gabor_bank())


_FOLD = lambda e, n: f"(case when ((({e}) % (2 * {n})) + 2 * {n}) % (2 * {n}) < {n} then ((({e}) % (2 * {n})) + 2 * {n}) % (2 * {n}) else 2 * {n} - 1 - ((({e}) % (2 * {n})) + 2 * {n}) % (2 * {n}) end)"


@query(
    f"with {fx.C}, {_GABOR_SQL}, gp as (select image_id, y, x, r, g, b, (r * 4899 + g * 9617 + b * 1868 + 8192) >> 14 as gray, max(y) over (partition by image_id) + 1 as h from px),"
    f" resp as (select a.image_id, a.y, a.x, a.r, a.g, a.b, k, sum(w * b.gray) as v from gp a cross join bank join gp b on b.image_id = a.image_id and b.y = {_FOLD('a.y + dy', 'a.h')} and b.x = {_FOLD('a.x + dx', '8')} group by all)"
    " select image_id, y, x, list_transform(list_concat([r, g, b], list(v order by k)), lambda t: round(t, 4) + 0.0) as features from resp group by image_id, y, x, r, g, b"
)
def feature_space_rgb_texture(spark, d):
    """Colours and the responses of eight Gabor kernels of every pixel; the last image is less high."""
    images = planes.to_planes(fx.color_pixels(spark, d).drop("h", "w"), ["r", "g", "b"])
    images = features.texture_planes(images, kernels.gabor_bank(**_GABOR))
    pixels = planes.to_pixels(images, {c: c for c in ("r", "g", "b", "texture")}, F.col("w"))
    rows = features.feature_space(pixels, "rgb_texture")
    return rows.select("image_id", "y", "x", F.transform("features", lambda v: F.round(v, 4) + 0.0).alias("features"))


def _gabor_responses(spark, d):
    return planes.filter_bank(fx.plane_rows(spark, d), kernels.gabor_bank(**_GABOR), "v", H, W)


@query(f"with {fx.G}, {_GABOR_SQL} select a.image_id, cast(k as int) as kernel, a.y, a.x, round(sum(w * b.v), 6) + 0.0 as v from g a cross join bank join g b on b.image_id = a.image_id and b.y = {_REFLECT('a.y + dy')} and b.x = {_REFLECT('a.x + dx')} group by all")
def gabor_bank_small(spark, d):
    rows = _gabor_responses(spark, d).select("image_id", F.posexplode("responses").alias("kernel", "o"))
    out = planes.to_pixels(rows, {"v": "o"}, W)
    return out.select("image_id", "kernel", "y", "x", r6(F.col("v"), "v"))


@query(f"with {fx.G}, {_GABOR_SQL}, resp as (select a.image_id, k, a.y, a.x, sum(w * b.v) as v from g a cross join bank join g b on b.image_id = a.image_id and b.y = {_REFLECT('a.y + dy')} and b.x = {_REFLECT('a.x + dx')} group by all) select image_id, y, x, round(max(abs(v)), 6) as v from resp group by all")
def filter_bank_activation(spark, d):
    return _pixels(_gabor_responses(spark, d).withColumn("o", planes.activation(F.col("responses"))), "o", "v", True)


# The bank at two angles, 0 and a quarter turn, where turned kernels are the plain ones along y.
_AXES_SQL = (
    "sc(s, i) as (values (1.0::double, 0), (sqrt(2.0::double), 1), (2.0::double, 2), (2 * sqrt(2.0::double), 3)), offs as (select dy, dx from range(-26, 27) a(dy), range(-26, 27) b(dx)),"
    " gs as (select s, i, m, exp(-(dx * dx + dy * dy) / (2.0 * (m * s) ** 2)) as g, dy::double as dy, dx::double as dx, m * s as t from sc, (values (1), (3)) q(m), offs where greatest(abs(dy), abs(dx)) <= greatest(1, ceil(3 * m * s))),"
    " unit as (select s, i, m, t, dy, dx, g / sum(g) over (partition by i, m) as g from gs),"
    " raw as (select i * 4 + o * 2 + r as k, dy, dx, case when r = 0 then -u / t ** 2 * g else (u * u - t * t) / t ** 4 * g end as v, true as centred from (select *, case o when 0 then dx else -dy end as u from unit, range(0, 2) x(o), range(0, 2) y(r) where m = 1 and i < 3)"
    " union all select 12 + i + case m when 3 then 4 else 0 end, dy, dx, (dx * dx + dy * dy - 2 * t * t) / t ** 4 * g, true from unit"
    " union all select 20 + i, dy, dx, g, false from unit where m = 1),"
    " mid as (select k, dy, dx, v - case when centred then avg(v) over (partition by k) else 0 end as v from raw), lm as (select cast(k as int) as k, cast(dy as int) as dy, cast(dx as int) as dx, v / sum(abs(v)) over (partition by k) as w from mid)"
)


@query(f"with {_AXES_SQL} select k as kernel, dy, dx, round(w, 6) + 0.0 as weight from lm")
def lm_bank_axes(spark, d):
    """Weights of the derivative bank at two angles."""
    return _weights(spark, kernels.derivative_bank(angles=2))


@query()
def lm_kernels(spark, d):
    """The 48 kernels of the derivative bank applied to every plane; mean absolute response."""
    rows = planes.filter_bank(fx.plane_rows(spark, d), kernels.derivative_bank(), "v", H, W)
    return rows.select(F.posexplode("responses").alias("kernel", "o")).select("kernel", F.explode("o").alias("v")).groupBy("kernel").agg(r6(F.avg(F.abs("v")), "mean_abs"), F.count("*").alias("n"))


@query(f"with {fx.G}, {_AXES_SQL}, small as (select * from lm where k in (select k from lm group by k having max(dy) <= 8)), resp as (select a.image_id, k, a.y, a.x, sum(w * b.v) as v from g a cross join small join g b on b.image_id = a.image_id and b.y = {_REFLECT('a.y + dy')} and b.x = {_REFLECT('a.x + dx')} group by all) select k as kernel, round(avg(abs(v)), 6) as mean_abs, count(*) as n from resp group by k")
def lm_responses_axes(spark, d):
    """Mean absolute responses of every plane to the kernels at two angles that no plane is smaller than."""
    bank = [(k, a) for k, a in enumerate(kernels.derivative_bank(angles=2)) if a.shape[0] // 2 <= H]
    rows = planes.filter_bank(fx.plane_rows(spark, d), [a for _, a in bank], "v", H, W)
    names = F.array(*[F.lit(k) for k, _ in bank])
    rows = rows.select(F.posexplode("responses").alias("at", "o")).select(F.get(names, F.col("at")).alias("kernel"), F.explode("o").alias("v"))
    return rows.groupBy("kernel").agg(r6(F.avg(F.abs("v")), "mean_abs"), F.count("*").alias("n"))


def _median_sql(size: int) -> str:
    r = size // 2
    return f"with {fx.M}, o as (select dy, dx from range({-r}, {r + 1}) a(dy), range({-r}, {r + 1}) b(dx)) select a.image_id, a.y, a.x, list_sort(list(b.pred))[{size * size // 2 + 1}] as label from m a cross join o join m b on b.image_id = a.image_id and b.y = least(greatest(a.y + dy, 0), 7) and b.x = least(greatest(a.x + dx, 0), 7) group by a.image_id, a.y, a.x"


@query(_median_sql(3))
def median_blur_3(spark, d):
    return _pixels(fx.mask_planes(spark, d).withColumn("o", planes.median_blur(F.col("pred"), H, W, 3)), "o", "label")


@query(_median_sql(5))
def median_blur_5(spark, d):
    return _pixels(fx.mask_planes(spark, d).withColumn("o", planes.median_blur(F.col("pred"), H, W)), "o", "label")


def _set(spark, d, col="gt"):
    return fx.mask_planes(spark, d).select("image_id", F.transform(col, lambda v: v > 0).alias("mask"))


_BIN = fx.M + ", o as (select dy, dx from range(-1, 2) a(dy), range(-1, 2) b(dx)), e as (select a.image_id, a.y, a.x, a.gt > 0 as s, count(*) filter (b.gt > 0) = 9 as eroded, count(*) filter (b.gt > 0) > 0 as grown from m a cross join o left join m b on b.image_id = a.image_id and b.y = a.y + dy and b.x = a.x + dx group by all)"


@query(f"with {_BIN} select image_id, y, x, eroded as v from e")
def erode_3x3(spark, d):
    return _pixels(_set(spark, d).withColumn("o", planes.erode(F.col("mask"), H, W)), "o", "v")


@query(f"with {_BIN} select image_id, y, x, grown as v from e")
def dilate_3x3(spark, d):
    return _pixels(_set(spark, d).withColumn("o", planes.dilate(F.col("mask"), H, W)), "o", "v")


@query(f"with {_BIN} select image_id, y, x, s and not eroded as v from e")
def boundary_map(spark, d):
    return _pixels(_set(spark, d).withColumn("o", planes.boundary(F.col("mask"), H, W)), "o", "v")


@query(f"with {_BIN}, l as (select dy, dx from range(-2, 3) a(dy), range(-2, 3) b(dx) where abs(dy) + abs(dx) <= 2) select a.image_id, a.y, a.x, bool_or(coalesce(b.s and not b.eroded, false)) as v from e a cross join l left join e b on b.image_id = a.image_id and b.y = a.y + dy and b.x = a.x + dx group by all")
def dilate_l1(spark, d):
    return _pixels(_set(spark, d).withColumn("o", planes.dilate_l1(planes.boundary(F.col("mask"), H, W), H, W, 2)), "o", "v")


@query(f"with {fx.G} select image_id, cast(y // 2 as int) as y, cast(x // 2 as int) as x, round(avg(v), 6) + 0.0 as v from g group by image_id, y // 2, x // 2")
def resize_area_half(spark, d):
    rows = planes.resize_area(fx.plane_rows(spark, d).select("image_id", "v"), ["v"], H, W, 0.5)
    return planes.to_pixels(rows, {"v": "v"}, F.col("w")).select("image_id", "y", "x", r6(F.col("v"), "v"))


@query(f"with {fx.M}, t as (select ty, tx from range(0, 11) a(ty), range(0, 5) b(tx)) select image_id, cast(ty as int) as y, cast(tx as int) as x, gt as label from m join t on m.y = cast(floor((ty + 0.5) * 8 / 11) as int) and m.x = cast(floor((tx + 0.5) * 8 / 5) as int)")
def resize_nearest(spark, d):
    rows = planes.resize_nearest(fx.mask_planes(spark, d).select("image_id", "gt"), "gt", H, W, 11, 5, "o")
    return planes.to_pixels(rows.select("image_id", "o"), {"label": "o"}, 5)


# Regions

_REGIONS = "q as (select image_id, y, x, y * 8 + x as p, pred as l from m), reach as (select image_id, p as a, p as b, y, x, l from q union select r.image_id, r.a, q.p, q.y, q.x, q.l from reach r join q on q.image_id = r.image_id and q.l = r.l and abs(q.y - r.y) <= 1 and abs(q.x - r.x) <= 1), reg as (select image_id, b as p, min(a) as region from reach group by image_id, b)"


def _image_rows(spark, d):
    return fx.mask_planes(spark, d).select("image_id", F.lit(H).alias("h"), F.lit(W).alias("w"), F.col("pred").alias("labels"))


@query(f"with recursive {fx.M}, {_REGIONS} select image_id, y, x, l as label, cast(region as int) as region from q join reg using (image_id, p)")
def connected_components(spark, d):
    return planes.to_pixels(regions.regions(_image_rows(spark, d)).drop("h", "w"), {"label": "labels", "region": "regions"}, W)


@query(f"with recursive {fx.M}, {_REGIONS} select image_id, l as label, cast(region as int) as region, count(*) as area from q join reg using (image_id, p) group by all")
def region_areas(spark, d):
    return regions.region_areas(regions.regions(_image_rows(spark, d)))


def _clean_sql(source: str, least: int) -> str:
    return f"""with recursive {fx.M}, {source}, {_REGIONS.partition("), reach")[2].join(["reach", ""])},
    z as (select image_id, p, region, y, x, l from q join reg using (image_id, p)), small as (select image_id, region from z group by all having count(*) < {least}),
    ring as (select distinct a.image_id, a.region, b.p, b.l from z a join small using (image_id, region) join z b on b.image_id = a.image_id and abs(b.y - a.y) <= 1 and abs(b.x - a.x) <= 1 and b.region <> a.region),
    top as (select image_id, region, l as fresh from (select image_id, region, l, row_number() over (partition by image_id, region order by count(*) desc, l) as k from ring group by image_id, region, l) where k = 1)
    select image_id, y, x, cast(coalesce(fresh, l) as int) as label from z left join top using (image_id, region)"""


@query(_clean_sql("q as (select image_id, y, x, y * 8 + x as p, pred as l from m)", 3))
def small_component_removal(spark, d):
    return _pixels(regions.clean(_image_rows(spark, d), 3), "cleaned", "label")


@query(_clean_sql("q as (select a.image_id, a.y, a.x, a.y * 8 + a.x as p, list_sort(list(b.pred))[5] as l from m a cross join (select dy, dx from range(-1, 2) i(dy), range(-1, 2) j(dx)) join m b on b.image_id = a.image_id and b.y = least(greatest(a.y + dy, 0), 7) and b.x = least(greatest(a.x + dx, 0), 7) group by a.image_id, a.y, a.x)", 4))
def median_then_clean(spark, d):
    return _pixels(regions.median_then_clean(_image_rows(spark, d), H, W, 4, size=3), "cleaned", "label")


# Matching


def _counts(spark, d):
    return matching.contingency(fx.mask_pixels(spark, d), IMG)


@query(f"with {fx.M} select * from c")
def contingency(spark, d):
    return _counts(spark, d)


@query("select o_orderstatus as grp, o_orderpriority as gt, l_returnflag as pred, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by all")
def contingency_tables(spark, d):
    rows = fx.read(spark, d, "orders").join(fx.read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return matching.contingency(rows.withColumnRenamed("o_orderstatus", "grp"), ["grp"], "o_orderpriority", "l_returnflag")


_DENSE = "dense as (select image_id, cast(gt as int) as gt, cast(pred as int) as pred, coalesce(n, 0) as n from (select image_id, unnest(range(0, g + 1)) as gt, p from (select image_id, max(gt) as g, max(pred) as p from c group by image_id)) join (select image_id, unnest(range(0, p + 1)) as pred from (select image_id, max(pred) as p from c group by image_id)) using (image_id) left join c using (image_id, gt, pred))"


@query(f"with {fx.M}, {_DENSE} select * from dense")
def contingency_dense(spark, d):
    return matching.dense(_counts(spark, d), IMG)


@query(f"with {fx.M}, {_DENSE} select image_id, gt, pred, n, round(coalesce(n / nullif(sum(n) over (partition by image_id, gt), 0), 0), 6) as share from dense")
def row_normalized(spark, d):
    return matching.row_normalised(matching.dense(_counts(spark, d), IMG), IMG).withColumn("share", r6(F.col("share"), "share"))


_ONE = "one as (select image_id, pred, gt as matched, n as overlap from (select *, row_number() over (partition by image_id, pred order by n desc, gt) as k from c) where k = 1)"


@query(f"with {fx.M}, {_ONE} select image_id, pred, matched, overlap, false as is_extra from one")
def match_many_to_one(spark, d):
    return matching.many_to_one(_counts(spark, d), IMG)


# All ways to give each gt label one predicted label or none, with their totals; several best ones are ties.
_WAYS = """labels as (select image_id, list(distinct pred order by pred) as ps, cast(max(gt) + 1 as int) as n_gt from c group by image_id),
walk0 as (select image_id, ps, n_gt, []::int[] as used, 0::bigint as total from labels),
s1 as (select w.image_id, ps, n_gt, list_append(used, p) as used, total + coalesce(n, 0) as total from (select *, unnest(list_concat(ps, [-1])) as p from walk0) w left join c on c.image_id = w.image_id and c.gt = 0 and c.pred = p),
s2 as (select w.image_id, ps, n_gt, list_append(used, p) as used, total + coalesce(n, 0) as total from (select *, unnest(list_concat(ps, [-1])) as p from s1) w left join c on c.image_id = w.image_id and c.gt = 1 and c.pred = p where p = -1 or n_gt > 1 and not list_contains(used, p)),
s3 as (select w.image_id, ps, n_gt, list_append(used, p) as used, total + coalesce(n, 0) as total from (select *, unnest(list_concat(ps, [-1])) as p from s2) w left join c on c.image_id = w.image_id and c.gt = 2 and c.pred = p where p = -1 or n_gt > 2 and not list_contains(used, p)),
full_ways as (select * from s3 where len(list_filter(used, lambda u: u >= 0)) = least(n_gt, len(ps))),
best as (select image_id, ps, n_gt, used, total, count(*) over (partition by image_id) as ways from (select *, max(total) over (partition by image_id) as top from full_ways) where total = top)"""


@query(f"with {fx.M}, {_WAYS} select image_id, total as total_overlap, any_value(len(ps)) as n_labels from best group by image_id, total")
def match_hungarian(spark, d):
    rows = matching.hungarian(_counts(spark, d), IMG)
    return rows.groupBy("image_id").agg(F.sum(F.when(~F.col("is_extra"), F.col("overlap")).otherwise(0)).alias("total_overlap"), F.count("*").alias("n_labels"))


# The matches, extra labels included; null where several ways are best, since any of them would do.
_HUNG = """uniq as (select * from best where ways = 1), pl as (select image_id, ps, n_gt, used, unnest(ps) as pred from uniq),
spare as (select image_id, pred, row_number() over (partition by image_id order by pred) - 1 + n_gt as extra from pl where not list_contains(used, pred)),
hung as (select pl.image_id, pl.pred, cast(coalesce(extra, list_position(used, pl.pred) - 1) as int) as matched,
 coalesce((select max(case when extra is not null or c.gt = list_position(used, pl.pred) - 1 then n end) from c where c.image_id = pl.image_id and c.pred = pl.pred), 0) as overlap, extra is not null as is_extra
 from pl left join spare using (image_id, pred))"""


def _single_best(spark, d):
    """image_id and whether its best one-to-one matching is single, by trying all."""
    import itertools

    def ways(g, p, n):
        preds = np.unique(p)
        table = np.zeros((int(g.max()) + 1, len(preds)), np.int64)
        table[g, np.searchsorted(preds, p)] = n
        wide = table if table.shape[0] <= table.shape[1] else table.T
        totals = sorted((sum(int(wide[i, c]) for i, c in enumerate(way)) for way in itertools.permutations(range(wide.shape[1]), wide.shape[0])), reverse=True)
        return (len(totals) == 1 or totals[0] > totals[1],)

    rows = _counts(spark, d).groupBy("image_id").agg(F.collect_list(F.struct("gt", "pred", "n")).alias("c")).select("image_id", "c.gt", "c.pred", "c.n")
    return planes.with_arrays(rows, ["gt", "pred", "n"], {"single": "boolean"}, ways, keep=IMG)


def _if_single(c: str):
    return F.when(F.col("single"), F.col(c)).alias(c)


@query(f"with {fx.M}, {_WAYS}, {_HUNG} select image_id, pred, matched, overlap, is_extra from (select distinct image_id, pred from c) left join hung using (image_id, pred)")
def match_hungarian_pairs(spark, d):
    """The matches themselves; null where several matchings are best."""
    rows = matching.hungarian(_counts(spark, d), IMG).join(_single_best(spark, d), "image_id")
    return rows.select("image_id", "pred", *map(_if_single, ("matched", "overlap", "is_extra")))


_CONF = _ONE + ", conf as (select image_id, gt, matched as pred, cast(sum(n) as bigint) as n from c join one using (image_id, pred) group by all)"


def _confusion(spark, d):
    counts = _counts(spark, d)
    return matching.remapped(counts, matching.many_to_one(counts, IMG), IMG)


@query(f"with {fx.M}, {_CONF} select * from conf")
def confusion_matched(spark, d):
    return _confusion(spark, d)


@query(f"with {fx.M}, {_CONF}, w as (select image_id, unnest(range(0, 41)) as k from (select distinct image_id from conf)) select conf.* from conf where gt < 40 and pred < 40")
def confusion_corner(spark, d):
    from ..sources.sinks import confusion_corner as corner

    return corner(_confusion(spark, d))


@query(f"with {fx.M}, {_ONE}, left_over as (select distinct image_id, pred from c where pred not in (select 1)), sizes as (select image_id, max(gt) + 1 as n_gt from c group by image_id) select image_id, pred, cast(row_number() over (partition by image_id order by pred) - 1 + n_gt as int) as extra_id from left_over join sizes using (image_id)")
def extra_label_ids(spark, d):
    """Labels without a match, where only label 1 is matched."""
    counts = _counts(spark, d)
    return matching.extra_ids(counts, counts.where("pred = 1"), IMG)


@query("select l_orderkey, l_linenumber, cast(dense_rank() over (partition by l_orderkey order by l_suppkey) - 1 as int) as label from lineitem")
def compact_labels(spark, d):
    return matching.compact(fx.read(spark, d, "lineitem"), ["l_orderkey"], "l_suppkey", "label").select("l_orderkey", "l_linenumber", "label")


@query("select l_orderkey, l_returnflag, cast(row_number() over (partition by l_orderkey order by min(l_linenumber), l_returnflag) as int) as class_id from lineitem group by l_orderkey, l_returnflag")
def first_seen_ids(spark, d):
    return matching.first_seen(fx.read(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", "l_linenumber", "class_id").select("l_orderkey", "l_returnflag", "class_id")


@query(f"with {fx.M}, top as (select * from (select *, row_number() over (partition by image_id, gt order by n desc, pred) as k from c) where k = 1) select image_id, gt, case when n < 10 then 'class_' || gt when pred = 0 then 'background_or_' || gt when pred = 3 then 'class_' || gt else 'part_' || pred end as class_name from top")
def class_names_by_overlap(spark, d):
    counts = _counts(spark, d)
    names = counts.where("pred in (0, 1, 2)").select("image_id", "pred", F.concat(F.lit("part_"), F.col("pred")).alias("name")).distinct()
    return matching.names_by_overlap(counts, names, IMG)


# Scores

_CLASSES = (
    _CONF + ", cls as (select image_id, cast(unnest(range(0, g + 1)) as int) as class_id from (select image_id, max(gt) as g from conf group by image_id)),"
    " sums as (select image_id, class_id, cast(coalesce(sum(n) filter (gt = class_id), 0) as bigint) as support, cast(coalesce(sum(n) filter (gt = class_id and pred = class_id), 0) as bigint) as tp, cast(coalesce(sum(n) filter (pred = class_id), 0) as bigint) as predicted from cls join conf using (image_id) group by all),"
    " cm as (select image_id, class_id, support, tp, predicted - tp as fp, support - tp as fn, coalesce(tp / nullif(predicted, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall, coalesce(tp / nullif(support + predicted - tp, 0), 0) as iou, class_id <> 0 as included from sums)"
)


def _classes(spark, d):
    return metrics.class_metrics(metrics.class_counts(_confusion(spark, d), IMG))


@query(f"with {fx.M}, {_CLASSES} select image_id, class_id, support, tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(iou, 6) as iou, included from cm")
def class_metrics(spark, d):
    return _classes(spark, d).select("image_id", "class_id", "support", "tp", "fp", "fn", *[r6(F.col(m), m) for m in ("precision", "recall", "iou")], "included")


_MACRO = ", ".join(f"round(avg({m}) filter (included), 6) as macro_{m}" for m in ("precision", "recall", "iou"))
_WEIGHTED = ", ".join(f"round(sum(support * {m}) filter (included) / nullif(sum(support) filter (included), 0), 6) as weighted_{m}" for m in ("precision", "recall", "iou"))


@query(f"with {fx.M}, {_CLASSES} select image_id, {_MACRO} from cm group by image_id")
def macro_metrics(spark, d):
    rows = metrics.macro(_classes(spark, d), IMG, ["precision", "recall", "iou"])
    return rows.select("image_id", *[r6(F.col(c), c) for c in rows.columns if c.startswith("macro")])


@query(f"with {fx.M}, {_CLASSES} select image_id, {_WEIGHTED} from cm group by image_id")
def weighted_metrics(spark, d):
    rows = metrics.macro(_classes(spark, d), IMG, ["precision", "recall", "iou"])
    return rows.select("image_id", *[r6(F.col(c), c) for c in rows.columns if c.startswith("weighted")])


@query(f"with {fx.M}, {_CONF} select image_id, round(sum(n) filter (gt = pred) / sum(n), 6) as pixel_accuracy from conf group by image_id")
def pixel_accuracy(spark, d):
    return metrics.pixel_accuracy(_confusion(spark, d), IMG).select("image_id", r6(F.col("pixel_accuracy"), "pixel_accuracy"))


@query(f"with {fx.M} select image_id, y, x, gt <> pred as error from m")
def error_flags(spark, d):
    return fx.mask_pixels(spark, d).select("image_id", "y", "x", metrics.error_flag(F.col("gt"), F.col("pred")).alias("error"))


_BF = (
    ", cells as (select image_id, y, x, k as class_id, gt = k as g, pred2 = k as p from lab, range(0, 3) r(k)), o as (select dy, dx from range(-1, 2) a(dy), range(-1, 2) b(dx)),"
    " edges as (select a.image_id, a.class_id, a.y, a.x, a.g and count(*) filter (b.g) < 9 as bg, a.p and count(*) filter (b.p) < 9 as bp from cells a cross join o left join cells b on b.image_id = a.image_id and b.class_id = a.class_id and b.y = a.y + dy and b.x = a.x + dx group by a.image_id, a.class_id, a.y, a.x, a.g, a.p),"
    " l1 as (select dy, dx from range(-2, 3) a(dy), range(-2, 3) b(dx) where abs(dy) + abs(dx) <= 2),"
    " near as (select a.image_id, a.class_id, a.y, a.x, a.bg, a.bp, bool_or(coalesce(b.bg, false)) as dg, bool_or(coalesce(b.bp, false)) as dp from edges a cross join l1 left join edges b on b.image_id = a.image_id and b.class_id = a.class_id and b.y = a.y + dy and b.x = a.x + dx group by all),"
    " tot as (select image_id, class_id, count(*) filter (bg) as ng, count(*) filter (bp) as np, count(*) filter (bp and dg) as hp, count(*) filter (bg and dp) as hg from near group by all),"
    " pr as (select *, coalesce(hp / nullif(np, 0), 0) as pp, coalesce(hg / nullif(ng, 0), 0) as rr from tot),"
    " bf as (select image_id, cast(class_id as int) as class_id, case when ng = 0 and np = 0 then 1.0 when ng = 0 or np = 0 then 0.0 else coalesce(2.0 * pp * rr / nullif(pp + rr, 0), 0) end as boundary_f1 from pr where class_id <= (select max(gt) from lab where lab.image_id = pr.image_id))"
)


@query(f"with {fx.M}, lab as (select image_id, y, x, gt, pred as pred2 from m){_BF} select image_id, class_id, round(boundary_f1, 6) as boundary_f1 from bf")
def boundary_f1(spark, d):
    rows = metrics.boundary_f1(fx.mask_planes(spark, d).drop("label"), H, W)
    return rows.select("image_id", "class_id", r6(F.col("boundary_f1"), "boundary_f1"))


_EVAL = (
    f"with {fx.M}, {_CLASSES}, lab as (select image_id, y, x, gt, matched as pred2 from m join one using (image_id, pred)){_BF},"
    f" full_rows as (select cm.*, boundary_f1 from cm join bf using (image_id, class_id)), im as (select image_id, avg(iou) filter (included) as macro_iou, avg(boundary_f1) filter (included) as macro_boundary_f1, avg(precision) filter (included) as macro_precision, sum(support * boundary_f1) filter (included) / nullif(sum(support) filter (included), 0) as weighted_boundary_f1 from full_rows group by image_id)"
)
_SETTINGS = evaluation.Settings(matching="many_to_one")


@query(_EVAL + " select image_id, round(macro_iou, 6) as macro_iou, round(macro_boundary_f1, 6) as macro_boundary_f1, round(macro_precision, 6) as macro_precision, round(weighted_boundary_f1, 6) as weighted_boundary_f1 from im")
def full_evaluation(spark, d):
    rows = evaluation.evaluate(fx.mask_planes(spark, d), H, W, _SETTINGS)["per_image"]
    return rows.select("image_id", *[r6(F.col(c), c) for c in ("macro_iou", "macro_boundary_f1", "macro_precision", "weighted_boundary_f1")])


_EVAL_H = (
    f"with {fx.M}, {_WAYS}, {_HUNG}, one as (select image_id, pred, matched, overlap from hung), conf as (select image_id, gt, matched as pred, cast(sum(n) as bigint) as n from c join one using (image_id, pred) group by all)"
    + _CLASSES[len(_CONF):] + f", lab as (select image_id, y, x, gt, matched as pred2 from m join one using (image_id, pred)){_BF},"
    " full_rows as (select cm.*, boundary_f1 from cm join bf using (image_id, class_id)), acc as (select image_id, sum(n) filter (gt = pred) / sum(n) as pixel_accuracy from conf group by image_id)"
    ", im as (select image_id, round(avg(iou) filter (included), 6) as macro_iou, round(avg(boundary_f1) filter (included), 6) as macro_boundary_f1, round(any_value(coalesce(pixel_accuracy, 0)), 6) as pixel_accuracy from full_rows join acc using (image_id) group by image_id)"
    " select image_id, macro_iou, macro_boundary_f1, pixel_accuracy from (select distinct image_id from c) left join im using (image_id)"
)


@query(_EVAL_H)
def full_evaluation_hungarian(spark, d):
    """One-to-one scoring; null where several matchings are best."""
    rows = evaluation.evaluate(fx.mask_planes(spark, d), H, W)["per_image"].join(_single_best(spark, d), "image_id")
    rows = rows.select("image_id", "single", *[r6(F.col(c), c) for c in ("macro_iou", "macro_boundary_f1", "pixel_accuracy")])
    return rows.select("image_id", *map(_if_single, ("macro_iou", "macro_boundary_f1", "pixel_accuracy")))


@query(_EVAL + ", best as (select image_id, label, macro_iou, macro_boundary_f1 from (select im.*, label, row_number() over (partition by label order by macro_iou desc, macro_boundary_f1 desc, macro_precision desc, image_id) as k from im join (select vec_id as image_id, label from embeddings) using (image_id)) where k = 1) select label, best.image_id, round(macro_iou, 6) as selected_macro_iou, round(macro_boundary_f1, 6) as selected_boundary_f1, round(sum(n) filter (gt = pred) / sum(n), 6) as peer_accuracy from best join conf using (image_id) group by all")
def peer_rescore(spark, d):
    """The best scored image of each label, and its accuracy against its own truth again."""
    masks = fx.mask_planes(spark, d)
    rows = evaluation.evaluate(masks, H, W, _SETTINGS)["per_image"]
    best = report.best_per(rows, ["label"], [F.desc("macro_iou"), F.desc("macro_boundary_f1"), F.desc("macro_precision"), F.asc("image_id")]).select("label", "image_id", "macro_iou", "macro_boundary_f1")
    again = metrics.pixel_accuracy(_confusion(spark, d).join(best.select("image_id"), "image_id", "left_semi"), IMG)
    return best.join(again, "image_id").select("label", "image_id", r6(F.col("macro_iou"), "selected_macro_iou"), r6(F.col("macro_boundary_f1"), "selected_boundary_f1"), r6(F.col("pixel_accuracy"), "peer_accuracy"))


_TREE = (
    f"with {fx.G}, m0 as (select a.image_id, a.y, a.x, case when a.v > 0.1 then 2 when a.v > 0 then 1 else 0 end as gt, case when b.v > 0.12 then 3 when b.v > 0.05 then 2 when b.v > 0 then 1 else 0 end as pred from g a join g b on a.image_id = b.image_id and a.y = b.y and b.x = least(a.x + 1, 7)),"
    " m as (select image_id, y, x, cast(dense_rank() over (partition by image_id order by gt) - 1 as int) as gt, cast(dense_rank() over (partition by image_id order by pred) - 1 as int) as pred from m0), c as (select image_id, gt, pred, count(*) as n from m group by all), "
    + _EVAL.partition(fx.M + ", ")[2]
    + ", acc as (select image_id, round(sum(n) filter (gt = pred) / sum(n), 6) as pixel_accuracy from conf group by image_id), kinds as (select image_id, cast(max(gt) + 1 as bigint) as n_gt_labels, cast(max(pred) + 1 as bigint) as n_pred_labels from m group by image_id)"
    " select image_id, round(macro_iou, 6) as macro_iou, round(macro_boundary_f1, 6) as macro_boundary_f1, round(macro_precision, 6) as macro_precision, round(coalesce(weighted_boundary_f1, 0), 6) as weighted_boundary_f1, pixel_accuracy, n_gt_labels, n_pred_labels, '8x8' as gt_shape, 'KMeans' as algorithm from im join acc using (image_id) join kinds using (image_id)"
)


@query(_TREE)
def score_result_tree(spark, d):
    """Every mask written as a file of a result tree in the shared folder, and the tree scored."""
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    gray = lambda c: F.transform(c, lambda v: v * 60).alias("o")
    masks = fx.mask_planes(spark, d).withColumn("folder", F.concat(F.lit("Img"), F.col("image_id").cast("string")))
    truth = masks.select(F.concat(F.lit("GT/"), F.col("folder"), F.lit("/mask")).alias("name"), gray("gt"))
    found = masks.select(F.concat(F.col("folder"), F.lit("/lab/KMeans/PostProcessed-1")).alias("name"), gray("pred"))
    sinks.write_png(sinks.encode_png(truth.unionByName(found).withColumns({"h": F.lit(H), "w": F.lit(W)}), ["o"]), root, "name")
    rows = scoring.score_tree(spark, root, _SETTINGS)["per_image_results"]  # a written table
    remove(spark, root)
    return rows.select(F.substring("image_id", 4, 20).cast("long").alias("image_id"), *[r6(F.col(c), c) for c in ("macro_iou", "macro_boundary_f1", "macro_precision", "weighted_boundary_f1", "pixel_accuracy")], "n_gt_labels", "n_pred_labels", "gt_shape", "algorithm")


# Reports

_METRICS = ["iou", "boundary_f1", "precision"]
_MEANS = ", ".join(f"round(avg({m}), 6) as mean_{m}" for m in _METRICS)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c), c) if c.startswith("mean_") else F.col(c) for c in df.columns])


@query(f"with {fx.T} select method_key, feature_set, algorithm, count(distinct image_id) as n_images, count(*) as n_predictions, {_MEANS} from t group by all")
def summary_by_group(spark, d):
    return _rounded(report.group_summary(fx.report_rows(spark, d), ["method_key", "feature_set", "algorithm"], _METRICS))


@query(f"with {fx.T} select count(distinct image_id) as n_images, count(*) as n_predictions, {_MEANS} from t")
def summary_overall(spark, d):
    return _rounded(report.overall(fx.report_rows(spark, d), _METRICS))


@query(f"with {fx.T} select method_key, feature_set, algorithm, case grouping(method_key) * 4 + grouping(feature_set) * 2 + grouping(algorithm) when 0 then 0 when 6 then 1 when 4 then 2 else 3 end as level, count(distinct image_id) as n_images, count(*) as n_predictions, {_MEANS} from t group by grouping sets ((method_key, feature_set, algorithm), (algorithm), (feature_set, algorithm), ())")
def summary_grouping_sets(spark, d):
    return _rounded(report.all_levels(fx.report_rows(spark, d), [["method_key", "feature_set", "algorithm"], ["algorithm"], ["feature_set", "algorithm"], []], _METRICS))


@query(f"with {fx.T}, a as (select method_key, {_MEANS} from t group by method_key) select method_key, left(method_key, 80) as short_method, mean_iou, mean_boundary_f1 from a order by mean_iou desc, mean_boundary_f1 desc, method_key limit 30")
def top_n_methods(spark, d):
    rows = _rounded(report.group_summary(fx.report_rows(spark, d), ["method_key"], _METRICS))
    top = report.top_n(rows, [F.desc("mean_iou"), F.desc("mean_boundary_f1"), F.asc("method_key")])
    return top.select("method_key", scalar.short_method(F.col("method_key")).alias("short_method"), "mean_iou", "mean_boundary_f1")


@query(f"with {fx.T} select image_id, order_key, run, round(iou, 6) as iou from (select *, row_number() over (partition by image_id order by iou desc, boundary_f1 desc, precision desc, order_key, run) as k from t) where k = 1")
def best_per_image(spark, d):
    order = [F.desc("iou"), F.desc("boundary_f1"), F.desc("precision"), F.asc("order_key"), F.asc("run")]
    return report.best_per(fx.report_rows(spark, d), IMG, order).select("image_id", "order_key", "run", r6(F.col("iou"), "iou"))


# Names, paths and sources


@query("select page_id, left(trim(regexp_replace(url, '[^\\w\\-.]+', '__', 'g'), '._'), 180) as name, '8x8' as shape from pages")
def safe_name(spark, d):
    return fx.read(spark, d, "pages").select("page_id", scalar.safe_name(F.col("url")).alias("name"), scalar.shape_text(F.lit(H), F.lit(W)).alias("shape"))


@query("select p_partkey, array_to_string([case when regexp_matches(x, '^[0-9]') then lpad(len(coalesce(nullif(ltrim(x, '0'), ''), '0'))::varchar, 4, '0') || coalesce(nullif(ltrim(x, '0'), ''), '0') else x end for x in regexp_extract_all(lower(p_brand), '[0-9]+|[^0-9]+')], '') as sort_key from part")
def natural_sort(spark, d):
    return fx.read(spark, d, "part").select("p_partkey", scalar.natural_key(F.col("p_brand")).alias("sort_key"))


_PATHS = """k as (select p_partkey as k, case p_partkey % 4 when 0 then 'KMeans' when 1 then 'Sampled Mean Shift' when 2 then 'Half Resize PCA 95 mean_shift' else 'other' end as method, case p_partkey % 5 when 0 then '' when 1 then 'hsv' when 2 then 'lab_xy' when 3 then 'rgb' else 'xy' end as space,
 (case p_partkey % 3 when 0 then 'Post Processed' when 1 then 'postprocessed' else 'raw' end) || ' a-' || p_partkey as name, case p_partkey % 7 % 3 when 0 then '.png' when 1 then '.JPG' else '.txt' end as ext, 'Img' || lpad(cast(p_partkey % 20 as varchar), 2, '0') as img from part)"""


@query(f"""with {_PATHS} select img as image_id, case when space = '' then 'unknown_feature' else space end as feature_set, method as method_dir, case k % 4 when 0 then 'KMeans' else 'Mean Shift' end as algorithm, name as prediction_name,
(k % 20) % 3 = 0 as has_mask, (k % 20) % 2 = 0 as has_json from k where k % 4 < 3 and k % 3 < 2 and ext <> '.txt' and ((k % 20) % 3 = 0 or (k % 20) % 2 = 0)""")
def discover_predictions(spark, d):
    rows = files.discover_predictions(fx.result_paths(spark, d), fx.truth_paths(spark, d))
    return rows.select("image_id", "feature_set", "method_dir", "algorithm", "prediction_name", F.col("gt_mask_path").isNotNull().alias("has_mask"), F.col("gt_json_path").isNotNull().alias("has_json"))


@query("select p_partkey, p_partkey % 3 as policy, case p_partkey % 3 when 0 then case when p_size % 2 = 0 then 'mask' end when 1 then case when p_size % 3 = 0 then 'json' end else case when p_size % 2 = 0 then 'mask' when p_size % 3 = 0 then 'json' end end as source from part")
def gt_source_policy(spark, d):
    k = F.col("p_partkey") % 3
    mask, json = F.when(F.col("p_size") % 2 == 0, "m.png"), F.when(F.col("p_size") % 3 == 0, "a.json")
    policy = F.when(k == 0, "mask").when(k == 1, "json").otherwise("auto")
    return fx.read(spark, d, "part").select("p_partkey", k.alias("policy"), files.truth_source(mask, json, policy).alias("source"))


@query("with p as (select p_partkey as k, case when p_partkey % 2 = 0 then '.png' else '.jpg' end as ext, p_partkey // 3 as img from part) select img as image_id, 'i' || k || ext as path from (select *, row_number() over (partition by img order by ext, 'i' || k || ext) as n from p) where n = 1")
def prefer_extension(spark, d):
    k = F.col("p_partkey")
    paths = fx.read(spark, d, "part").select(F.expr("p_partkey div 3").alias("image_id"), F.concat(F.lit("i"), k.cast("string"), F.when(k % 2 == 0, ".png").otherwise(".jpg")).alias("path"))
    return files.prefer_extension(paths)


@query("select event_id, cast(props ->> '$.k' as int) as k from events")
def json_extract(spark, d):
    return fx.read(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# Annotations


def _shapes(spark, d):
    return raster.shapes(raster.parse_annotations(fx.annotations(spark, d), "json").drop("json"))


_IDS = f"with {fx.S}, ids as (select image_id, label, row_number() over (partition by image_id order by min(position)) as class_id from s group by image_id, label)"


@query(f"with {fx.S} select image_id, position, label, kind as shape_type, len(pts) as n_points, len(pts) >= case when kind in ('rectangle', 'circle', 'line') then 2 when kind = 'point' then 1 else 3 end as valid from s")
def labelme_shapes(spark, d):
    return _shapes(spark, d).select("image_id", "position", "label", "shape_type", F.size("points").cast("long").alias("n_points"), "valid")


_SEG = lambda reach: f"(px - (x1 + t * (x2 - x1))) ** 2 + (py - (y1 + t * (y2 - y1))) ** 2 <= {reach}"
_RASTER = (
    _IDS + ", grid as (select px, py from range(0, 16) a(py), range(0, 16) b(px)), ends as (select image_id, position, kind, class_id, len(pts) as n, i, pts[i][1]::double as x1, pts[i][2]::double as y1, pts[i % len(pts) + 1][1]::double as x2, pts[i % len(pts) + 1][2]::double as y2 from (select *, unnest(range(1, len(pts) + 1)) as i from s join ids using (image_id, label))),"
    " tests as (select *, least(1.0, greatest(0.0, coalesce(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / nullif((x2 - x1) ** 2 + (y2 - y1) ** 2, 0), 0))) as t from ends cross join grid),"
    " hit as (select image_id, position, class_id, px, py, any_value(kind) as kind, count(*) filter ((y1 > py) <> (y2 > py) and px < (x2 - x1) * (py - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 as inside,"
    f" bool_or(i = 1 and px between least(x1, x2) and greatest(x1, x2) and py between least(y1, y2) and greatest(y1, y2)) as box, bool_or(i = 1 and (px - x1) ** 2 + (py - y1) ** 2 <= (x2 - x1) ** 2 + (y2 - y1) ** 2) as disc, bool_or(i < n and {_SEG(0.25)}) as line, bool_or(i = 1 and (px - x1) ** 2 + (py - y1) ** 2 <= 1) as dot, bool_or({_SEG(1)}) as rim from tests group by image_id, position, class_id, px, py)"
)


@query(_RASTER + " select image_id, cast(py as int) as y, cast(px as int) as x, cast(coalesce(max_by(class_id, position) filter (case kind when 'rectangle' then box when 'circle' then disc when 'line' then line when 'point' then dot else inside end), 0) as int) as label from hit group by image_id, py, px")
def rasterize_overwrite(spark, d):
    rows = raster.rasterise(raster.class_ids(_shapes(spark, d), IMG), IMG, 16, 16)
    return planes.to_pixels(rows.drop("h", "w"), {"label": "labels"}, 16)


@query(_RASTER + " select image_id, cast(py as int) as y, cast(px as int) as x, cast(coalesce(max_by(class_id, position) filter (inside), 0) as int) as mask, cast(coalesce(max_by(class_id, position) filter (rim), 0) as int) as contour, cast(coalesce(max_by(class_id, position) filter (inside or rim), 0) as int) as overlay from hit where kind = 'polygon' group by image_id, py, px")
def rasterize_polygon(spark, d):
    rows = raster.ground_truth(raster.class_ids(_shapes(spark, d), IMG), IMG, 16, 16)
    return planes.to_pixels(rows.drop("h", "w"), {"mask": "mask", "contour": "contour", "overlay": "overlay"}, 16)


# Clustering

_D2 = lambda a, b: f"list_sum([(x[1] - x[2]) ** 2 for x in list_zip({a}, {b})])"
_ASSIGN = lambda k, centres: f"a{k} as (select id, cast(arg_min(c, {{'d': dd, 'c': c}}) as int) as c from (select v.id, z.c, {_D2('v.f', 'z.f')} as dd from v cross join {centres} z) group by id)"
_UPDATE = lambda k: f"e{k} as (select c, i, avg(f[i]) as m from (select c, f, unnest(range(1, 65)) as i from a{k} join v using (id)) group by c, i), z{k} as (select c, list(m order by i) as f from e{k} group by c)"
_LLOYD = f"with {fx.V}, z0 as (select cast(row_number() over (order by id) - 1 as int) as c, f from v order by id limit 5), {_ASSIGN(1, 'z0')}, {_UPDATE(1)}, {_ASSIGN(2, 'z1')}, {_UPDATE(2)}, {_ASSIGN(3, 'z2')}"


@query(_LLOYD + " select id, c as cluster from a3")
def kmeans_lloyd_3(spark, d):
    rows = fx.vectors(spark, d)
    return clustering.lloyd(rows, clustering.first_vectors(rows, 5, "id"), 3)[1].select("id", "cluster")


@query(f"with {fx.V}, z0 as (select cast(row_number() over (order by id) - 1 as int) as c, f from v order by id limit 5), {_ASSIGN(1, 'z0')} select id, c as cluster from a1")
def assign_nearest(spark, d):
    rows = fx.vectors(spark, d)
    return clustering.assign(rows, clustering.first_vectors(rows, 5, "id")).select("id", "cluster")


def _mini_sql(rounds: int) -> str:
    drawn = lambda t: f"b{t} as (select id, f from v where left(md5(concat_ws(':', id::varchar, '42', '{t}')), 8) < '80000000')"
    near = lambda name, rows, centres: f"{name} as (select id, cast(arg_min(c, {{'d': dd, 'c': c}}) as int) as c from (select v.id, z.c, {_D2('v.f', 'z.f')} as dd from {rows} v cross join {centres} z) group by id)"
    means = lambda t: f"m{t} as (select c, list(m order by i) as mf, any_value(n) as n from (select c, i, avg(f[i]) as m, count(*) as n from (select c, f, unnest(range(1, 65)) as i from a{t} join v using (id)) group by c, i) group by c)"
    moved = lambda t: f"z{t + 1} as (select c, s + coalesce(n, 0) as s, case when n is null then f else list_transform(list_zip(f, mf), lambda x: x[1] + (x[2] - x[1]) * n / (s + n)) end as f from z{t} left join m{t} using (c))"
    parts = [f"{drawn(t)}, {near(f'a{t}', f'b{t}', f'z{t}')}, {means(t)}, {moved(t)}" for t in range(rounds)]
    return f"with {fx.V}, z0 as (select cast(row_number() over (order by id) - 1 as int) as c, 0 as s, f from v order by id limit 5), {', '.join(parts)}, {near('last', 'v', f'z{rounds}')} select id, c as cluster from last"


@query(_mini_sql(3))
def kmeans_mini_batch_3(spark, d):
    """Three rounds on half of the rows each, from the first five vectors."""
    rows = fx.vectors(spark, d)
    return clustering.mini_batch_kmeans(rows, "id", iterations=3, centres=clustering.first_vectors(rows, 5, "id"), share=0.5, tolerance=0.0)[1].select("id", "cluster")


@query()
def kmeans_mini_batch(spark, d):
    return clustering.mini_batch_kmeans(fx.vectors(spark, d), "id", iterations=10)[1].select("id", "cluster")


@query()
def kmeans_ml(spark, d):
    return clustering.kmeans(fx.vectors(spark, d)).select("id", "cluster")


@query(f"with {fx.V}, o as (select f as q from v order by id limit 1), t as (select id, {_D2('f', 'q')} as d2 from v cross join o) select id, round(d2, 6) as d2, round(case when d2 > 9 * 0.25 then 0 else exp(-d2 / 0.5) end, 6) as gaussian, round(greatest(0, 1 - d2 / 1.44), 6) as epanechnikov from t")
def kernel_weights(spark, d):
    rows = fx.vectors(spark, d)
    origin = clustering.literal(clustering.first_vectors(rows, 1, "id"))[0]
    d2 = weights.dist2(F.col("features"), origin)
    return rows.withColumn("q", d2).select("id", r6(F.col("q"), "d2"), r6(weights.kernel_weight("gaussian", F.col("q"), 0.5), "gaussian"), r6(weights.kernel_weight("flat", F.col("q"), 1.2), "epanechnikov"))


def _shift_sql(weight: str) -> str:
    step = lambda k, src: f"w{k} as (select p.id, q.id as j, {_D2('p.f', 'q.f')} as d2 from {src} p cross join v q), u{k} as (select id, j, {weight} as w from w{k}), s{k} as (select u{k}.id, i, sum(w * f[i]) / sum(w) as m from u{k} join (select id as j, f, unnest(range(1, 65)) as i from v) using (j) where w > 0 group by all), p{k} as (select id, list(m order by i) as f from s{k} group by id)"
    return f"with {fx.V}, {step(1, 'v')}, {step(2, 'p1')} select id, [round(x, 5) + 0.0 for x in f[1:3]] as head, round(list_sum([x * x for x in f]), 5) as norm2 from p2"


def _shifted(spark, d, kind, h):
    rows = fx.vectors(spark, d)
    moved = clustering.mean_shift(rows, rows, h, kind, max_iter=2, threshold=0.0)
    return moved.select("id", F.transform(F.slice("mode", 1, 3), lambda v: F.round(v, 5) + 0.0).alias("head"), F.round(weights.dist2(F.col("mode"), F.transform("mode", lambda v: F.lit(0.0))), 5).alias("norm2"))


@query(_shift_sql("case when d2 > 9 * 0.16 then 0 else exp(-d2 / (2 * 0.16)) end"))
def mean_shift_gaussian_2(spark, d):
    return _shifted(spark, d, "gaussian", 0.4)


@query(_shift_sql("greatest(0, 1 - d2 / 1.44)"))
def mean_shift_epanechnikov_2(spark, d):
    return _shifted(spark, d, "epanechnikov", 1.2)


@query(f"with {fx.V}, b as (select [round_even(x / 0.3, 0) for x in f[1:3]] as bin, count(*) as n from v group by 1) select round(bin[1] * 0.3, 6) + 0.0 as s0, round(bin[2] * 0.3, 6) + 0.0 as s1, round(bin[3] * 0.3, 6) + 0.0 as s2, n from b")
def mean_shift_seeds(spark, d):
    rows = fx.vectors(spark, d).select(F.slice("features", 1, 3).alias("features"))
    seeds = clustering.bin_seeds(rows, 0.3)
    return seeds.select(*[r6(F.get("seed", F.lit(i)), f"s{i}") for i in range(3)], "n")


@query()
def mean_shift_full(spark, d):
    rows = fx.vectors(spark, d)
    return clustering.flat_mean_shift(rows, rows, 1.2)[1].select("id", "cluster")


@query()
def merge_modes(spark, d):
    rows = fx.vectors(spark, d)
    modes = clustering.mean_shift(rows, rows, 0.5, "gaussian")
    return clustering.merge_modes(modes, 0.25, "id").select("center_id", "n")


def _knn_sql(k: int, most: int, ranks, extra: str = "") -> str:
    rows = ", ".join(f"({r})" for r in ranks)
    value = "case rank " + " ".join(f"when {r} then quantile_cont(dd, {r / 100})" for r in ranks) + " end"
    return f"with {fx.V}, d as (select * from v order by md5(cast(id as varchar)), id limit {most}), p as (select a.id, sqrt({_D2('a.f', 'b.f')}) as dd from d a cross join d b), n as (select id, list_sort(list(dd))[{k + 1}] as dd from p group by id), r(rank) as (values {rows}) select rank, round({value}, 6) as value{extra} from n cross join r group by rank"


@query(_knn_sql(30, 2000, (10, 25, 50, 75, 90), ", rank >= 25 as candidate"))
def bandwidth_knn_percentiles(spark, d):
    rows = clustering.sample_fixed(fx.vectors(spark, d), "id", 1.0, 2000)
    return stats.bandwidth_percentiles(rows).select("rank", r6(F.col("value"), "value"), "candidate")


@query(_knn_sql(1, 3000, (10, 25, 50, 75, 90, 95)))
def nearest_mode_percentiles(spark, d):
    rows = clustering.sample_fixed(fx.vectors(spark, d), "id", 1.0, 3000)
    return stats.nearest_percentiles(rows).select("rank", r6(F.col("value"), "value"))


@query(f"with {fx.V}, e as (select unnest(range(1, 65)) as k, unnest(f) as x from v), s as (select k, var_pop(x) as s from e group by k) select round(sum(s), 5) as total_variance, (select count(*) from v) as n from s")
def pca_explained(spark, d):
    """Total variance of all components, which a rotation keeps."""
    rows, shares = stats.pca(fx.vectors(spark, d), DIMS, 1.0)
    total = sum(F.var_pop(F.get("components", F.lit(i))) for i in range(len(shares)))
    return rows.agg(F.round(total, 5).alias("total_variance"), F.count("*").alias("n"))


@query()
def pca_95(spark, d):
    """The components kept for 95 % of the variance, and their shares."""
    shares = stats.pca(fx.vectors(spark, d), DIMS)[1]
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(shares)], "component int, share double").select("component", r6(F.col("share"), "share"))


@query("select vec_id as id from embeddings order by md5(cast(vec_id as varchar)), vec_id limit (select least(greatest(1, cast(floor(0.07 * count(*)) as bigint)), 12000, count(*)) from embeddings)")
def sample_fixed_size(spark, d):
    return clustering.sample_fixed(fx.vectors(spark, d), "id").select("id")


# Whole segmentations


def _segmented(spark, d, run):
    """Labels of every pixel before and after cleaning; the last image is less high than the others."""
    images = planes.to_planes(fx.color_pixels(spark, d).drop("h", "w"), ["r", "g", "b"])
    out = segmentation.segment(images, F.col("h"), F.col("w"), run)
    return planes.to_pixels(out.select("image_id", "w", "labels", "cleaned"), {"label": "labels", "cleaned": "cleaned"}, F.col("w")).drop("w")


@query()
def segment_kmeans(spark, d):
    return _segmented(spark, d, segmentation.Run("rgb_xy", "kmeans", min_area=3))


@query()
def segment_mean_shift_half_pca(spark, d):
    return _segmented(spark, d, segmentation.Run("lab_xy", "mean shift", "4", bandwidth=1.5, min_area=2))
