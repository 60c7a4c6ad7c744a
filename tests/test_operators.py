"""Operators on small grids with hand-made or brute-force results."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from featuregrid.functions import color, kernels, scalar
from featuregrid.operators import clustering, evaluation, features, matching, metrics, planes, raster, regions, report, segmentation, stats
from featuregrid.sources import files, sinks


def plane_of(spark, values, expr):
    df = spark.createDataFrame([(values,)], "v array<double>")
    return df.select(expr(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("border,mode", [("reflect", "symmetric"), ("reflect101", "reflect"), ("constant", "constant")])
def test_correlation_borders(spark, border, mode):
    rng = np.random.default_rng(1)
    a, k = rng.normal(size=(4, 5)), rng.normal(size=(3, 3))
    padded = np.pad(a, 1, mode=mode)
    want = [[(padded[y : y + 3, x : x + 3] * k).sum() for x in range(5)] for y in range(4)]
    got = plane_of(spark, a.ravel().tolist(), lambda v: planes.correlate(v, 4, 5, k, border))
    assert np.allclose(np.array(got).reshape(4, 5), want)


def test_large_bank_equals_small_stencil(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(9, 7))
    df = spark.createDataFrame([(1, a.ravel().tolist())], "image_id long, v array<double>")
    big = rng.normal(size=(13, 11))
    rows = planes.filter_bank(df, [big, big[5:8, 4:7]], "v", 9, 7).first()["responses"]
    padded = np.pad(a, ((6, 6), (5, 5)), mode="symmetric")
    want = [[(padded[y : y + 13, x : x + 11] * big).sum() for x in range(7)] for y in range(9)]
    assert np.allclose(np.array(rows[0]).reshape(9, 7), want)
    small = plane_of(spark, a.ravel().tolist(), lambda v: planes.correlate(v, 9, 7, big[5:8, 4:7]))
    assert np.allclose(rows[1], small)


def test_kernel_banks():
    assert len(kernels.gabor_bank()) == 32 and kernels.gabor_bank()[0].shape == (31, 31)
    bank = kernels.derivative_bank()
    assert len(bank) == 48
    assert all(abs(k.sum()) < 1e-6 for k in bank[:44]) and all(abs(k.sum() - 1) < 1e-9 for k in bank[44:])
    assert np.allclose(kernels.rotated(np.eye(5), 0.0), np.eye(5))
    assert np.allclose(kernels.rotated(np.arange(9.0).reshape(3, 3), np.pi / 2)[1, 1], 4)


def test_resize(spark):
    a = np.arange(24.0)
    def resized(values, h, w, scale):
        row = planes.resize_area(spark.createDataFrame([(values,)], "v array<double>"), ["v"], h, w, scale).first()
        assert len(row["v"]) == row["h"] * row["w"]
        return row["v"]

    half = resized(a.tolist(), 4, 6, 0.5)
    assert half == [3.5, 5.5, 7.5, 15.5, 17.5, 19.5]
    assert resized(a.tolist(), 4, 6, 1.0) == a.tolist()
    third = resized([1.0] * 25, 5, 5, 0.4)
    assert np.allclose(third, 1.0) and len(third) == 4
    assert len(resized(a.tolist(), 4, 6, 2.0)) == 96
    with pytest.raises(ValueError):
        planes.scaled_size(4, 0)


def test_minmax_of_flat_plane(spark):
    assert plane_of(spark, [2.0, 2.0], planes.minmax_u8) == [0, 0]


def test_regions_and_clean(spark):
    labels = np.array([[1, 1, 0], [0, 2, 0], [1, 1, 0]])
    region = regions.label_regions(labels)
    assert region.tolist() == [[0, 0, 2], [3, 4, 2], [6, 6, 2]]
    assert regions.remove_small(labels, 1).tolist() == labels.tolist()
    cleaned = regions.remove_small(labels, 2)
    assert cleaned[1, 1] == 0 and cleaned[1, 0] == 1  # a tie goes to the least label
    assert regions.remove_small(np.zeros((2, 2), int), 100).tolist() == [[0, 0], [0, 0]]


def test_regions_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a = rng.integers(0, 2, (6, 7))
        want = np.arange(42).reshape(6, 7)
        changed = True
        while changed:
            changed = False
            for (y, x), (dy, dx) in itertools.product(np.ndindex(6, 7), itertools.product((-1, 0, 1), repeat=2)):
                yy, xx = y + dy, x + dx
                if 0 <= yy < 6 and 0 <= xx < 7 and a[y, x] == a[yy, xx] and want[yy, xx] < want[y, x]:
                    want[y, x], changed = want[yy, xx], True
        assert (regions.label_regions(a) == want).all()


def test_best_assignment_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = rng.integers(0, 9, (rng.integers(1, 6), rng.integers(1, 6)))
        pairs = matching.best_assignment(a)
        n, m = a.shape
        wide = a if n <= m else a.T
        best = max(sum(wide[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert len(pairs) == min(n, m) and sum(a[i, j] for i, j in pairs) == best


def test_perfect_prediction_and_permutation(spark):
    gt = [0, 0, 1, 1, 2, 2, 2, 0, 1]
    masks = spark.createDataFrame([(1, gt, [{0: 2, 1: 0, 2: 1}[v] for v in gt])], "image_id long, gt array<int>, pred array<int>")
    for how in ("hungarian", "many_to_one"):
        row = evaluation.evaluate(masks, 3, 3, evaluation.Settings(matching=how))["per_image"].first()
        assert row["macro_iou"] == row["macro_boundary_f1"] == row["pixel_accuracy"] == 1.0


def test_hungarian_extra_labels(spark):
    counts = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 1, 4), (1, 0, 2, 3)], "image_id long, gt int, pred int, n long")
    rows = {r["pred"]: r for r in matching.hungarian(counts, ["image_id"]).collect()}
    assert rows[0]["matched"] == 0 and [rows[k]["matched"] for k in (1, 2)] == [1, 2]
    assert rows[1]["is_extra"] and rows[1]["overlap"] == 4
    ids = {r["pred"]: r["extra_id"] for r in matching.extra_ids(counts, counts.where("pred = 0"), ["image_id"]).collect()}
    assert ids == {1: 1, 2: 2}


def test_macro_without_classes_is_null(spark):
    counts = spark.createDataFrame([(1, 0, 0, 5)], "image_id long, gt int, pred int, n long")
    row = metrics.macro(metrics.class_metrics(metrics.class_counts(counts, ["image_id"])), ["image_id"], ["iou"]).first()
    assert row["macro_iou"] is None and row["weighted_iou"] is None
    row = metrics.macro(metrics.class_metrics(metrics.class_counts(counts, ["image_id"]), include_background=True), ["image_id"], ["iou"]).first()
    assert row["macro_iou"] == 1.0


def test_published_class_row(spark):
    """Precision, recall and IoU follow from tp, fp and fn alone."""
    counts = spark.createDataFrame([(1, 1, 100, 80, 20, 20)], "image_id long, class_id int, support long, tp long, fp long, fn long")
    row = metrics.class_metrics(counts).first()
    assert (row["precision"], row["recall"], round(row["iou"], 6)) == (0.8, 0.8, 0.666667)


def test_names_and_scalars(spark):
    row = spark.range(1).select(
        scalar.safe_name(F.lit("._a b/ü-c.png_.")).alias("s"), scalar.natural_key(F.lit("Img10 a2")).alias("n"), scalar.label_text(F.lit("  ")).alias("l"),
        scalar.nearest_int(F.lit(2.5)).alias("r"), scalar.safe_div(F.lit(1), F.lit(0)).alias("z"), scalar.stem(F.lit("a/b.c.png")).alias("stem"), scalar.extension(F.lit("a/b.PNG")).alias("ext"),
        scalar.method_key(F.lit("a"), F.lit("b")).alias("k"),
    ).first()
    assert row.asDict() == {"s": "a__b__ü-c.png", "n": "img000210 a00012", "l": "unlabeled", "r": 2, "z": 0.0, "stem": "b.c", "ext": ".png", "k": "a | b"}


def test_colours(spark):
    df = spark.createDataFrame([(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255), (0, 0, 0)], "r int, g int, b int")
    hsv = [tuple(r) for r in df.select(*color.hsv(F.col("r"), F.col("g"), F.col("b"))).collect()]
    assert hsv == [(0, 255, 255), (60, 255, 255), (120, 255, 255), (0, 0, 255), (0, 0, 0)]
    lab = [tuple(r) for r in df.select(*color.lab(F.col("r"), F.col("g"), F.col("b"))).collect()]
    assert lab[0] == (136, 208, 195) and lab[3] == (255, 128, 128) and lab[4] == (0, 128, 128)


def test_shapes_and_raster(spark):
    text = '{"imageHeight":5,"imageWidth":5,"shapes":[{"label":"a","points":[[-0.5,-0.5],[2.5,-0.5],[2.5,2.5],[-0.5,2.5]]},{"label":" ","points":[[4,4]],"shape_type":"point"},{"label":"b","points":[[1,1]],"shape_type":"line"}]}'
    rows = raster.shapes(raster.parse_annotations(spark.createDataFrame([("i", text)], "image_id string, j string"), "j").drop("j"))
    assert [(r["label"], r["shape_type"], r["valid"]) for r in rows.orderBy("position").collect()] == [("a", "polygon", True), ("unlabeled", "point", True), ("b", "line", False)]
    plane = raster.rasterise(raster.class_ids(rows, ["image_id"]), ["image_id"], 5, 5).first()["labels"]
    assert np.array(plane).reshape(5, 5).tolist() == [[1, 1, 1, 0, 0]] * 3 + [[0, 0, 0, 0, 2], [0, 0, 0, 2, 2]]


def test_class_ids_broadcast_nothing(spark):
    """Few bytes of keys make many shapes, so an estimate from the keys must not decide on a broadcast."""
    labels = F.when(F.col("id") % 2 == 0, '"b","a","b","c"').otherwise('"c"," ","c"')
    shapes = F.transform(F.split(labels, ","), lambda v: F.concat(F.lit('{"label":'), v, F.lit(',"points":[[1,1]],"shape_type":"point"}')))
    df = spark.range(2000).select(F.col("id").alias("image_id"), F.concat(F.lit('{"shapes":['), F.array_join(shapes, ","), F.lit("]}")).alias("j"))
    rows = raster.class_ids(raster.shapes(raster.parse_annotations(df, "j").drop("j")), ["image_id"])
    drawn = raster.rasterise(rows, ["image_id"], 3, 3)
    assert drawn.count() == 2000 and "Broadcast" not in drawn._jdf.queryExecution().executedPlan().toString()
    found = {(r["even"], r["position"], r["label"], r["class_id"]): r["n"] for r in rows.groupBy((F.col("image_id") % 2 == 0).alias("even"), "position", "label", "class_id").agg(F.count("*").alias("n")).collect()}
    even, odd = [("b", 1), ("a", 2), ("b", 1), ("c", 3)], [("c", 1), ("unlabeled", 2), ("c", 1)]
    assert found == {(side, i, *v): 1000 for side, values in ((True, even), (False, odd)) for i, v in enumerate(values)}
    hot = spark.createDataFrame([("i", 3, "x"), ("i", 1, "y"), ("i", 1, "a"), ("i", 5, "y"), (None, 0, "x")], "image_id string, position int, label string")
    assert sorted((r["position"], r["label"], r["class_id"]) for r in raster.class_ids(hot, ["image_id"]).collect()) == [(1, "a", 1), (1, "y", 2), (3, "x", 3), (5, "y", 2)]


def test_png_round_trip(spark, tmp_path):
    rgb = [list(range(12)), list(range(100, 112)), list(range(200, 212))]
    df = spark.createDataFrame([("Img01", 3, 4, *rgb)], "image_id string, h int, w int, r array<int>, g array<int>, b array<int>")
    assert sinks.write_png(sinks.encode_png(df, ["r", "g", "b"]), str(tmp_path)) == 1
    images = files.read_images(spark, str(tmp_path))
    pixels = files.image_pixels(images).orderBy("y", "x").collect()
    assert [p["r"] for p in pixels] == rgb[0] and [p["b"] for p in pixels] == rgb[2]
    labels = files.mask_labels(files.image_pixels(images)).orderBy("y", "x").collect()
    assert [r["label"] for r in labels] == list(range(12)) and labels[0]["label_name"] == "#0064c8"
    assert files.list_files(spark, str(tmp_path)).count() == 1


def test_report_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7), (None, 1, 0.1)], "fs string, image_id int, iou double")
    out = report.group_summary(rows, ["fs"], ["iou"])
    sinks.write_report(out, str(tmp_path / "r"))
    back = files.read_report(spark, str(tmp_path / "r"), out.schema)
    assert {r["fs"]: (r["n_images"], round(r["mean_iou"], 6)) for r in back.collect()} == {"a": (2, 0.6), None: (1, 0.1)}
    assert sinks.output_dir("Img01", "hsv", "KMeans", "gabor") == "outputs/Img01/hsv_gabor/KMeans"


def test_annotation_files(spark, tmp_path):
    (tmp_path / "Img07.json").write_text('{"version":"1","imageHeight":2,"imageWidth":3,\n"shapes":[{"label":"x","points":[[0,0],[1,1],[2,0]],"shape_type":"polygon"}]}')
    row = files.read_annotations(spark, str(tmp_path)).first()
    assert row["image_id"] == "Img07" and row["annotation"]["shapes"][0]["points"][1] == [1.0, 1.0]


def test_truth_is_required(spark):
    df = spark.createDataFrame([("Img01", "auto")], "image_id string, policy string")
    source = files.truth_source(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("policy"))
    with pytest.raises(Exception, match="no ground truth for Img01"):
        df.select(files.require_truth(source, F.col("image_id"))).collect()


def test_feature_spaces(spark):
    df = spark.createDataFrame([(0, 0, 1, 2, 1, 2, 3, [9.0])], "y int, x int, h int, w int, r int, g int, b int, texture array<double>")
    assert len(features.SPACES) >= 15
    row = features.feature_space(df, "rgb_xy_texture").first()["features"]
    assert row == [1.0, 2.0, 3.0, 0.0, 0.0, 9.0]
    features.register_part("ones", lambda d: [F.lit(1.0)])
    assert features.feature_space(df, ("ones", "xy")).first()["features"] == [1.0, 0.0, 0.0]


def test_kmeans_empty_cluster(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id int, features array<double>")
    assert clustering.lloyd(df, [[0.0], [1.0], [9.0]], 1)[0][2] == [0.0]
    assert clustering.lloyd(df, [[0.0], [1.0], [9.0]], 1, empty="keep")[0][2] == [9.0]


def test_mean_shift_finds_two_hills(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(0, 0.1, (40, 2)), rng.normal(5, 0.1, (40, 2))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id int, features array<double>")
    centres, labels = clustering.flat_mean_shift(df, df, 1.0)
    assert len(centres) == 2 and labels.select("cluster").distinct().count() == 2
    for kind in ("gaussian", "epanechnikov"):
        modes = clustering.mean_shift(df, df, 0.5, kind)
        merged = clustering.merge_modes(modes, 0.5, "id").orderBy("center_id").collect()
        assert [r["n"] for r in merged] == [40, 40]
    with pytest.raises(ValueError):
        stats.neighbour_distance(df.limit(3), 3)


def test_mean_shift_beyond_the_cap(spark, monkeypatch):
    """All rows count, whatever their number; blocks give what one array gives."""
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.normal(0, 0.1, (40, 2)), rng.normal(5, 0.1, (40, 2)), [[9.0, 9.0]]])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id int, features array<double>")
    climbed = lambda kind: [r["mode"] for r in clustering.mean_shift(df, df, 0.5, kind).orderBy("id").collect()]
    flat = lambda: [r["cluster"] for r in clustering.flat_mean_shift(df, df, 1.0)[1].orderBy("id").collect()]
    whole = [climbed("gaussian"), climbed("epanechnikov"), flat()]
    monkeypatch.setattr(clustering, "MAX_SAMPLES", 20)
    monkeypatch.setattr(clustering, "BLOCK", 7, raising=False)
    assert np.allclose(climbed("gaussian"), whole[0]) and np.allclose(climbed("epanechnikov"), whole[1])
    assert flat() == whole[2] and len(set(whole[2])) == 3


@pytest.mark.parametrize("run", [segmentation.Run("rgb", "kmeans", k=2, min_area=2), segmentation.Run("rgb", "mean shift", "2", bandwidth=0.8, min_area=1), segmentation.Run("lab_xy", "mean shift", "4", bandwidth=1.2, min_area=1), segmentation.Run("rgb", "mean shift", "1", bandwidth=0.8, min_area=2)])
def test_segmentation_splits_two_halves(spark, run):
    """Left half dark, right half bright; one odd pixel is cleaned away."""
    plane = [[20] * 8 + [230] * 8 for _ in range(16)]
    flat = [v for line in plane for v in line]
    images = spark.createDataFrame([("a", flat, flat, flat), ("b", flat, flat, flat)], "image_id string, r array<int>, g array<int>, b array<int>")
    for row in segmentation.segment(images, 16, 16, run).collect():
        got = np.array(row["cleaned"]).reshape(row["h"], row["w"])
        half = row["w"] // 2
        assert not set(got[:, :half].ravel()) & set(got[:, half:].ravel())
        assert row["h"] == {"2": 4, "4": 8}.get(run.mode, 16) or run.algorithm == "kmeans"


def test_pca_keeps_the_variance_asked_for(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 1)) * 10 + 3
    points = np.concatenate([x, 2 * x + rng.normal(size=(200, 1)) * 0.01, rng.normal(size=(200, 1)) * 0.01], 1)
    df = spark.createDataFrame([(p.tolist(),) for p in points], "features array<double>")
    out, shares = stats.pca(df, 3)
    assert len(shares) == 1 and len(out.first()["components"]) == 1
    assert abs(out.agg(F.avg(F.get("components", F.lit(0)))).first()[0]) < 1e-6
    assert clustering.mode_settings("9")["name"] == "sampled" and len(clustering.experiment_grid(["rgb", "hsv"])) == 6


def test_streaming_contingency(spark, tmp_path):
    from featuregrid.streaming.contingency import running_contingency

    spark.createDataFrame([(1, 0, 0), (1, 0, 0), (1, 1, 0)], "image_id int, gt int, pred int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("image_id int, gt int, pred int").parquet(str(tmp_path / "in"))
    q = running_contingency(stream, ["image_id"]).writeStream.outputMode("complete").format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["gt"], r["n"]) for r in spark.table("cells").collect()} == {(0, 2), (1, 1)}
