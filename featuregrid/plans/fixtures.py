"""Images, masks, vectors and reports built from the generic tables, and the same in SQL.

Every vector of ``embeddings`` is read as an 8 x 8 plane. Its values give true labels by
thresholds; the values one column to the right give predicted ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import planes

#: Side of a plane, and dimensions of a vector.
SIDE, DIMS = 8, 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plane_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, label, v: one plane in each row."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label", F.col("embedding").cast("array<double>").alias("v"))


def pixel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.to_pixels(plane_rows(spark, sf_dir).select("image_id", "v"), {"v": "v"}, SIDE)


def _true(v: Column) -> Column:
    return F.when(v > 0.1, 2).when(v > 0, 1).otherwise(0)


def _predicted(v: Column) -> Column:
    return F.when(v > 0.12, 3).when(v > 0.05, 2).when(v > 0, 1).otherwise(0)


def mask_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, label, gt, pred: label planes."""
    rows = plane_rows(spark, sf_dir)
    right = planes.stencil(F.col("v"), SIDE, SIDE, [(0, 1)], "replicate", None, lambda values: values[0])
    return rows.select("image_id", "label", F.transform("v", _true).alias("gt"), F.transform(right, _predicted).alias("pred"))


def mask_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.to_pixels(mask_planes(spark, sf_dir).drop("label"), {"gt": "gt", "pred": "pred"}, SIDE)


def color_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, h, w, y, x, r, g, b: 64 parts make an image of 8 x 8 colours."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        F.expr("p_partkey div 64").alias("image_id"), F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), F.expr("cast((p_partkey % 64) div 8 as int)").alias("y"), F.expr("cast(p_partkey % 8 as int)").alias("x"),
        (k * 37 % 256).cast("int").alias("r"), (k * 91 % 256).cast("int").alias("g"), (k * 151 % 256).cast("int").alias("b"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id and annotation JSON: each part draws a polygon, a rectangle, a circle, a line and a
    point, some without label or type, on a 16 x 16 image."""
    n = lambda m, a: (F.col("p_partkey") % m + a).cast("string")
    text = F.concat(
        F.lit('{"version":"5","imagePath":"p.png","imageHeight":16,"imageWidth":16,"shapes":['),
        F.lit('{"label":"body","points":[['), n(7, 1), F.lit(","), n(5, 1), F.lit("],["), n(6, 9), F.lit(","), n(3, 2), F.lit("],["), n(4, 8), F.lit(","), n(7, 8), F.lit("],["), n(3, 1), F.lit(","), n(6, 8), F.lit(']],"shape_type":"polygon"},'),
        F.lit('{"label":" ","points":[['), n(9, 1), F.lit(","), n(4, 9), F.lit("],["), n(3, 12), F.lit(","), n(5, 10), F.lit(']],"shape_type":"rectangle"},'),
        F.lit('{"label":"body","points":[['), n(8, 4), F.lit(","), n(9, 3), F.lit("],["), n(8, 6), F.lit(","), n(9, 4), F.lit(']],"shape_type":"circle"},'),
        F.lit('{"label":"rim","points":[['), n(5, 0), F.lit(","), n(3, 13), F.lit("],["), n(4, 10), F.lit(","), n(3, 0), F.lit(']],"shape_type":"line"},'),
        F.lit('{"label":"dot","points":[['), n(13, 1), F.lit(","), n(11, 2), F.lit(']],"shape_type":"point"},'),
        F.lit('{"label":"rim","points":[['), n(11, 0), F.lit(","), n(13, 0), F.lit("],["), n(9, 4), F.lit(","), n(5, 6), F.lit("],["), n(7, 1), F.lit(","), n(8, 7), F.lit("]]}]}"),
    )
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), text.alias("json"))


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, feature_set, algorithm, method_key and metrics of rows of ``lineitem`` read as scores."""
    from ..functions.scalar import method_key

    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    fs = F.when(F.col("l_linenumber") == 7, None).otherwise(F.concat(F.lit("fs_"), flag))
    alg = F.when(status == "O", "KMeans").otherwise("Mean Shift")
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey")).alias("image_id"), fs.alias("feature_set"), alg.alias("algorithm"), F.col("l_linenumber").alias("run"), F.col("l_orderkey").alias("order_key"),
        method_key(fs, alg, F.col("l_linenumber").cast("string")).alias("method_key"),
        (F.col("l_discount") * 10).alias("iou"), (F.col("l_tax") * 10).alias("boundary_f1"), (F.col("l_quantity") / 50).alias("precision"),
    )


def result_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the result layout, good and bad ones, one for each part."""
    k = F.col("p_partkey")
    method = F.when(k % 4 == 0, "KMeans").when(k % 4 == 1, "Sampled Mean Shift").when(k % 4 == 2, "Half Resize PCA 95 mean_shift").otherwise("other")
    space = F.when(k % 5 == 0, "").otherwise(F.concat(F.element_at(F.array(*map(F.lit, ("hsv", "lab_xy", "rgb", "xy"))), (k % 5).cast("int")), F.lit("/")))
    name = F.when(k % 3 == 0, "Post Processed").when(k % 3 == 1, "postprocessed").otherwise("raw")
    ext = F.element_at(F.array(*map(F.lit, (".png", ".JPG", ".txt"))), (k % 7 % 3 + 1).cast("int"))
    path = F.concat(F.lit("/data/outputs/Img"), F.lpad((k % 20).cast("string"), 2, "0"), F.lit("/"), space, method, F.lit("/"), name, F.lit(" a-"), k.cast("string"), ext)
    return read(spark, sf_dir, "part").select(path.alias("path"))


def truth_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, gt_mask_path, gt_json_path of twenty images; some have neither file."""
    rows = read(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("k")).distinct()
    name = F.concat(F.lit("Img"), F.lpad(F.col("k").cast("string"), 2, "0"))
    return rows.select(name.alias("image_id"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("gt/"), name, F.lit(".png"))).alias("gt_mask_path"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("gt/"), name, F.lit(".json"))).alias("gt_json_path"))


# The same tables in SQL, as parts of WITH.
G = "g as (select image_id, cast((p - 1) // 8 as int) as y, cast((p - 1) % 8 as int) as x, cast(e[p] as double) as v from (select vec_id as image_id, embedding as e, unnest(range(1, 65)) as p from embeddings))"
M = (
    G + ", m as (select a.image_id, a.y, a.x, case when a.v > 0.1 then 2 when a.v > 0 then 1 else 0 end as gt, case when b.v > 0.12 then 3 when b.v > 0.05 then 2 when b.v > 0 then 1 else 0 end as pred"
    " from g a join g b on a.image_id = b.image_id and a.y = b.y and b.x = least(a.x + 1, 7)), c as (select image_id, gt, pred, count(*) as n from m group by all)"
)
C = "px as (select p_partkey // 64 as image_id, cast((p_partkey % 64) // 8 as int) as y, cast(p_partkey % 8 as int) as x, cast(p_partkey * 37 % 256 as int) as r, cast(p_partkey * 91 % 256 as int) as g, cast(p_partkey * 151 % 256 as int) as b from part)"
V = "v as (select vec_id as id, [cast(e as double) for e in embedding] as f, label from embeddings)"
T = (
    "t as (select l_suppkey as image_id, case when l_linenumber = 7 then null else 'fs_' || l_returnflag end as feature_set, case when l_linestatus = 'O' then 'KMeans' else 'Mean Shift' end as algorithm, l_linenumber as run, l_orderkey as order_key,"
    " concat_ws(' | ', case when l_linenumber = 7 then null else 'fs_' || l_returnflag end, case when l_linestatus = 'O' then 'KMeans' else 'Mean Shift' end, cast(l_linenumber as varchar)) as method_key,"
    " l_discount * 10 as iou, l_tax * 10 as boundary_f1, l_quantity / 50 as precision from lineitem)"
)
_N = lambda m, a: f"(p_partkey % {m} + {a})"
S = (
    "s as (select p_partkey as image_id, unnest(["
    f"{{'position': 0, 'label': 'body', 'kind': 'polygon', 'pts': [[{_N(7, 1)}, {_N(5, 1)}], [{_N(6, 9)}, {_N(3, 2)}], [{_N(4, 8)}, {_N(7, 8)}], [{_N(3, 1)}, {_N(6, 8)}]]}},"
    f"{{'position': 1, 'label': 'unlabeled', 'kind': 'rectangle', 'pts': [[{_N(9, 1)}, {_N(4, 9)}], [{_N(3, 12)}, {_N(5, 10)}]]}},"
    f"{{'position': 2, 'label': 'body', 'kind': 'circle', 'pts': [[{_N(8, 4)}, {_N(9, 3)}], [{_N(8, 6)}, {_N(9, 4)}]]}},"
    f"{{'position': 3, 'label': 'rim', 'kind': 'line', 'pts': [[{_N(5, 0)}, {_N(3, 13)}], [{_N(4, 10)}, {_N(3, 0)}]]}},"
    f"{{'position': 4, 'label': 'dot', 'kind': 'point', 'pts': [[{_N(13, 1)}, {_N(11, 2)}]]}},"
    f"{{'position': 5, 'label': 'rim', 'kind': 'polygon', 'pts': [[{_N(11, 0)}, {_N(13, 0)}], [{_N(9, 4)}, {_N(5, 6)}], [{_N(7, 1)}, {_N(8, 7)}]]}}"
    "], recursive := true) from part)"
)
