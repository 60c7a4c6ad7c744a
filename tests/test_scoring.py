"""Scoring result files end to end, against a plain NumPy scorer, and images of many sizes."""

from __future__ import annotations

import json
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from featuregrid.functions import color, kernels
from featuregrid.operators import evaluation, features, matching, metrics, planes, regions, scoring, segmentation
from featuregrid.schema import CONFUSION, LABEL_MATCHES, PER_CLASS, PER_IMAGE
from featuregrid.sources import files, sinks

COLOURS = [(0, 0, 0), (255, 0, 0), (0, 128, 0), (9, 9, 200), (80, 80, 80)]


def write_mask(path, labels):
    path.parent.mkdir(parents=True, exist_ok=True)
    rgb = np.array(COLOURS, np.uint8)[labels]
    path.write_bytes(sinks.png_bytes(rgb.tobytes(), *labels.shape, 3))


def compact(labels):
    codes = [(r << 16) + (g << 8) + b for r, g, b in COLOURS]
    values, out = np.unique(np.array(codes)[labels], return_inverse=True)
    return out.reshape(labels.shape), [f"#{v:06x}" for v in values]


def brute(gt, pred, how, tolerance=2):
    """Per-class scores and matches of one pair of label planes, place by place."""
    n_gt, n_pred = gt.max() + 1, pred.max() + 1
    table = np.array([[((gt == g) & (pred == p)).sum() for p in range(n_pred)] for g in range(n_gt)])
    to = dict(enumerate(table.argmax(0).tolist()))
    if how == "hungarian":
        to = {c: r for r, c in matching.best_assignment(table)}
        for p in range(n_pred):
            to.setdefault(p, n_gt + sum(q >= n_gt for q in to.values()))
    new = np.vectorize(to.get)(pred)
    rows = {}
    for c in range(n_gt):
        a, b = gt == c, new == c

        def edge(m):
            pad = np.pad(m, 1)
            return m & ~np.min([pad[1 + dy : 1 + dy + m.shape[0], 1 + dx : 1 + dx + m.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0).astype(bool)

        ea, eb = np.argwhere(edge(a)), np.argwhere(edge(b))
        near = lambda p, others: any(abs(p - q).sum() <= tolerance for q in others)  # noqa: E731, B023
        p = np.mean([near(x, ea) for x in eb]) if len(eb) else 0
        r = np.mean([near(x, eb) for x in ea]) if len(ea) else 0
        f1 = 1.0 if not len(ea) and not len(eb) else 2 * p * r / (p + r) if p + r else 0.0
        tp, fp, fn = (a & b).sum(), (~a & b).sum(), (a & ~b).sum()
        rows[c] = (int(tp), int(fp), int(fn), tp / max(tp + fp + fn, 1), f1)
    return rows, to, (gt == new).mean()


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root, rng, want = tmp_path_factory.mktemp("tree"), np.random.default_rng(3), {}
    for k, (h, w) in enumerate([(9, 12), (16, 10), (7, 7)]):
        image = f"Img{k + 1:02}"
        gt = np.kron(rng.integers(0, 3, (h // 3 + 1, w // 3 + 1)), np.ones((3, 3), int))[:h, :w]
        write_mask(root / "GT" / image / "mask.png", gt)
        write_mask(root / "Peer" / image / "mask.png", gt[::-1])
        shapes = [{"label": "Stone", "points": [[0, 0], [w - 1, h - 1]], "shape_type": "rectangle"}]
        (root / "GT" / image / f"{image}.json").write_text(json.dumps({"imageHeight": h, "imageWidth": w, "shapes": shapes}))
        for method, size in (("KMeans", (h, w)), ("Sampled Mean Shift", (h * 2, w + 3))):
            pred = np.where(rng.random(size) < 0.25, rng.integers(0, 5, size), planes.nearest(gt, *size))
            rel = f"{image}/lab/deep/{method}/Post Processed {k}.png"
            write_mask(root / rel, pred)
            want[rel] = (gt, pred)
    write_mask(root / "Img01/lab/other/Post Processed x.png", np.zeros((3, 3), int))
    write_mask(root / "Img09/lab/KMeans/Post Processed x.png", np.zeros((3, 3), int))
    return root, want


@pytest.mark.parametrize("how", ["hungarian", "many_to_one"])
def test_tree_against_plain_scores(spark, tree, how):
    root, want = tree
    tables = scoring.score_tree(spark, str(root), evaluation.Settings(matching=how))
    images = {r["prediction_rel_path"]: r for r in tables["per_image_results"].collect()}
    assert images.keys() == want.keys()
    classes, matches = defaultdict(dict), defaultdict(dict)
    for r in tables["per_class_results"].collect():
        classes[r["prediction_rel_path"]][r["class_id"]] = r
    for r in tables["label_matches"].collect():
        matches[r["prediction_rel_path"]][r["pred_label_id"]] = r
    for rel, (gt, pred) in want.items():
        gt, names = compact(gt)
        pred, pred_names = compact(planes.nearest(pred, *gt.shape))
        rows, to, accuracy = brute(gt, pred, how)
        assert {c: (r["tp"], r["fp"], r["fn"], round(r["iou"], 9), round(r["boundary_f1"], 9)) for c, r in classes[rel].items()} == {c: (*v[:3], round(v[3], 9), round(v[4], 9)) for c, v in rows.items()}
        assert {p: r["matched_gt_label_id"] for p, r in matches[rel].items()} == to
        for p, r in matches[rel].items():
            assert r["pred_label_value"] == pred_names[p] and r["matched_gt_label_value"] == (names[to[p]] if to[p] < len(names) else f"extra_pred_{p}")
        r = images[rel]
        assert np.isclose(r["macro_iou"], np.mean([rows[c][3] for c in rows if c])) and np.isclose(r["pixel_accuracy"], accuracy)
        assert r["feature_set"] == "lab__deep" and r["gt_shape"] == f"{gt.shape[0]}x{gt.shape[1]}" and r["n_gt_labels"] == len(names) and r["n_pred_labels"] == len(pred_names)
    cells = tables["confusion_matrices_long"].collect()
    for rel, (gt, _) in want.items():
        own = [c for c in cells if c["prediction_rel_path"] == rel]
        assert sum(c["raw_count"] for c in own) == gt.size
        assert all(c["pred_label_after_matching_name"] == (f"extra_pred_{c['pred_label_after_matching_id'] - c['n_gt_labels']}" if c["pred_label_after_matching_id"] >= c["n_gt_labels"] else compact(gt)[1][c["pred_label_after_matching_id"]]) for c in own)
        assert len(own) == len({c["gt_label_id"] for c in own}) * len({c["pred_label_after_matching_id"] for c in own})


def test_tables_are_written(spark, tree, tmp_path):
    root, want = tree
    settings = evaluation.Settings(matching="many_to_one", names_from_json=True, gt_source="mask")
    tables = scoring.score_tree(spark, str(root), settings)
    paths = scoring.write_tables(tables, str(tmp_path), settings)
    assert len(tables) == 9 and len(paths) == 11
    for name, schema in (("per_image_results", PER_IMAGE), ("per_class_results", PER_CLASS), ("confusion_matrices_long", CONFUSION), ("label_matches", LABEL_MATCHES)):
        back = files.read_report(spark, f"{tmp_path}/output/{name}.csv", schema)
        assert back.columns == schema.names and back.count() == tables[name].count()
    names = {r["class_name"] for r in files.read_report(spark, f"{tmp_path}/output/per_class_results.csv", PER_CLASS).collect()}
    assert any(n.startswith("Stone (#") for n in names)
    best = spark.read.csv(f"{tmp_path}/performance/macro_by_algorithm.csv", header=True).collect()
    assert {(r["algorithm"], r["n_predictions"], r["n_images"]) for r in best} == {("KMeans", "3", "3"), ("Mean Shift", "3", "3")}
    assert float(best[0]["macro_iou"]) >= float(best[1]["macro_iou"])


def test_annotations_as_truth(spark, tree):
    root, want = tree
    rows = scoring.score_tree(spark, str(root), evaluation.Settings(gt_source="json"))["per_class_results"].collect()
    assert {(r["class_id"], r["class_name"]) for r in rows} == {(0, "background"), (1, "Stone")}
    assert all(r["support_pixels"] == np.prod(list(map(int, r["gt_shape"].split("x")))) for r in rows if r["class_id"] == 1)


def test_peer_scores(spark, tree):
    root, want = tree
    own = scoring.score_tree(spark, str(root), evaluation.Settings(matching="many_to_one"))["per_image_results"]
    peer = scoring.score_peer(spark, str(root), own, evaluation.Settings(matching="many_to_one", gt_folder="Peer"))
    rows = peer["peer_best_per_image_results"].collect()
    best = {i: max(r["macro_iou"] for r in own.collect() if r["image_id"] == i) for i in ("Img01", "Img02", "Img03")}
    assert {r["image_id"]: r["selected_from_own_gt_macro_iou"] for r in rows} == best
    for r in rows:
        gt, pred = want[r["prediction_rel_path"]]
        gt, _ = compact(gt[::-1])
        found, _, accuracy = brute(gt, compact(planes.nearest(pred, *gt.shape))[0], "many_to_one")
        assert np.isclose(r["macro_iou"], np.mean([found[c][3] for c in found if c])) and np.isclose(r["pixel_accuracy"], accuracy)
    assert peer["peer_best_overall_summary"].first()["n_results"] == 3


def test_unreadable_mask_is_an_error(spark, tmp_path):
    (tmp_path / "Img01.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="could not read image"):
        files.read_images(spark, str(tmp_path)).select("path").collect()
    assert files.image_pixels(files.read_images(spark, str(tmp_path), "drop")).count() == 0


def test_missing_pixels_are_an_error(spark):
    pixels = spark.createDataFrame([(1, 2, 2, y, x) for y in range(2) for x in range(2)][:3], "image_id int, h int, w int, y int, x int")
    with pytest.raises(Exception, match="image 1 has 3 pixels of 2 x 2"):
        features.check_pixel_count(pixels).collect()


def test_planes_of_different_sizes(spark):
    """One call takes images of any size; columns with odd names stay."""
    rng = np.random.default_rng(4)
    rows = [(k, h, w, rng.integers(0, 3, h * w).tolist()) for k, (h, w) in enumerate([(5, 7), (4, 4), (1, 9), (321, 481)])]
    df = spark.createDataFrame(rows, "`an id` int, h int, w int, labels array<int>")
    cleaned = {r["an id"]: r["cleaned"] for r in regions.clean(df, 3).collect()}
    assert all(cleaned[k] == regions.remove_small(np.array(v).reshape(h, w), 3).ravel().tolist() for k, h, w, v in rows)
    small = {r["an id"]: (r["h"], r["w"], r["labels"]) for r in planes.resize_area(df, ["labels"], F.col("h"), F.col("w"), 0.25).collect()}
    for k, h, w, v in rows:
        want = planes.resized_area(np.array(v, float).reshape(h, w), 0.25)
        assert small[k][:2] == want.shape and np.allclose(small[k][2], want.ravel())
    blurred = df.where("h < 300").select("an id", "h", "w", planes.median_blur(F.col("labels"), F.col("h"), F.col("w"), 3).alias("o"), "labels")
    for r in blurred.collect():
        a = np.pad(np.array(r["labels"]).reshape(r["h"], r["w"]), 1, mode="edge")
        want = np.median([a[dy : dy + r["h"], dx : dx + r["w"]] for dy in range(3) for dx in range(3)], axis=0)
        assert r["o"] == want.astype(int).ravel().tolist()
    scored = evaluation.evaluate(df.select(F.col("an id").alias("image_id"), F.col("labels").alias("gt"), F.col("labels").alias("pred"), "h", "w"), F.col("h"), F.col("w"))
    assert {r["macro_iou"] for r in scored["per_image"].collect()} == {1.0}


def test_boundaries_by_brute_force(spark):
    rng = np.random.default_rng(7)
    for _ in range(20):
        h, w, t = rng.integers(1, 9), rng.integers(1, 9), int(rng.integers(0, 4))
        gt, pred = rng.integers(0, 3, (h, w)), rng.integers(0, 4, (h, w))
        ng, np_, hp, hg = metrics.boundary_tallies(gt, pred, t)
        edge = lambda m, c: [(y, x) for y, x in np.argwhere(m == c) if any(not (0 <= y + dy < h and 0 <= x + dx < w) or m[y + dy, x + dx] != c for dy in (-1, 0, 1) for dx in (-1, 0, 1))]  # noqa: E731, B023
        for c in range(gt.max() + 1):
            a, b = edge(gt, c), edge(pred, c)
            near = lambda p, others: any(abs(p[0] - q[0]) + abs(p[1] - q[1]) <= t for q in others)  # noqa: E731, B023
            assert (ng[c], np_[c], hp[c], hg[c]) == (len(a), len(b), sum(near(p, a) for p in b), sum(near(p, b) for p in a))


def test_derivative_bank_by_definition():
    """Sides, order and values of the 48 kernels, each weight computed on its own."""
    bank, root = kernels.derivative_bank(), np.sqrt(2.0)
    sides = [7] * 12 + [11] * 12 + [13] * 12 + [7, 11, 13, 19, 19, 27, 37, 53] + [7, 11, 13, 19]
    assert [k.shape for k in bank] == [(n, n) for n in sides]

    def cubic(t, a=-0.75):
        t = abs(t)
        return (a + 2) * t**3 - (a + 3) * t**2 + 1 if t <= 1 else a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a if t < 2 else 0.0

    for k, scale, theta, order in ((1, 1.0, 0.0, 2), (2, 1.0, np.pi / 6, 1), (19, root, np.pi / 2, 2), (30, 2.0, np.pi / 2, 1), (35, 2.0, 5 * np.pi / 6, 2)):
        n = bank[k].shape[0]
        r = n // 2
        total = sum(np.exp(-(y * y + x * x) / (2 * scale**2)) for y in range(-r, r + 1) for x in range(-r, r + 1))
        flat = lambda y, x: (-x / scale**2 if order == 1 else (x * x - scale**2) / scale**4) * np.exp(-(y * y + x * x) / (2 * scale**2)) / total if max(abs(y), abs(x)) <= r else 0.0  # noqa: E731, B023
        want = np.zeros((n, n))
        for y in range(-r, r + 1):
            for x in range(-r, r + 1):
                sy, sx = (np.floor(32 * v + 0.5) / 32 for v in (x * np.sin(theta) + y * np.cos(theta), x * np.cos(theta) - y * np.sin(theta)))
                want[y + r, x + r] = sum(flat(int(np.floor(sy)) + i, int(np.floor(sx)) + j) * cubic(sy - np.floor(sy) - i) * cubic(sx - np.floor(sx) - j) for i in range(-1, 3) for j in range(-1, 3))
        want -= want.mean()
        assert np.allclose(bank[k], want / np.abs(want).sum(), atol=1e-9), k


def test_palette_of_many_labels(spark):
    labels = list(range(300))
    row = planes.painted(spark.createDataFrame([(labels,)], "labels array<int>"), "labels").first()
    assert len(set(zip(row["r"], row["g"], row["b"]))) > 295 and (row["r"][0], row["g"][0], row["b"][0]) == (0, 0, 0)
    assert (color.palette(300)[:4] == color.palette(4)).all() and color.palette(2)[1].tolist() == [148, 178, 71]


def test_columns_of_any_name(spark):
    counts = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 0, 2)], "k int, gt int, pred int, n long")
    assert [tuple(r) for r in matching.many_to_one(counts, ["k"]).collect()] == [(1, 0, 0, 5, False)]
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], 2, 2)], "`a b:c` int, v array<double>, h int, w int")
    assert planes.filter_bank(df, [np.ones((1, 1))], "v", 2, 2).first()["responses"] == [[1.0, 2.0, 3.0, 4.0]]


@pytest.mark.parametrize("method,n", [("gabor", 32), ("leung_malik", 48)])
def test_texture_spaces_are_segmented(spark, method, n):
    """Stripes beside a flat half of the same mean are told apart by texture alone."""
    rows = [[(255 if (x // 2) % 2 else 0) if x < 24 else 128 for x in range(48)] for _ in range(24)]
    plane = [v for line in rows for v in line]
    images = spark.createDataFrame([("a", 24, 48, plane, plane, plane)], "image_id string, h int, w int, r array<int>, g array<int>, b array<int>")
    made = features.texture_planes(images, method)
    assert len(made.first()["texture"][0]) == n
    row = segmentation.segment(made, F.col("h"), F.col("w"), segmentation.Run("texture", "kmeans", k=2, min_area=30)).first()
    got = np.array(row["cleaned"]).reshape(24, 48)
    assert len(set(got[:, 40:].ravel())) == 1 and (got[:, :16] != got[0, 47]).mean() > 0.4


def test_experiment_grid_runs(spark):
    plane = ([10] * 4 + [240] * 4) * 6
    images = spark.createDataFrame([("a", plane, plane, plane)], "image_id string, r array<int>, g array<int>, b array<int>")
    rows = segmentation.run_grid(images, 6, 8, ["rgb", "hsv"], k=2, bandwidths=(0.8,), mode="3", min_area=2).collect()
    assert {(r["feature_set"], r["algorithm"]) for r in rows} == {(s, a) for s in ("rgb", "hsv") for a in ("kmeans", "mean shift")}
    assert all(len(r["cleaned"]) == 48 and r["cleaned"][0] != r["cleaned"][7] for r in rows)


def vectors_of(data):
    import duckdb

    rows = duckdb.sql(f"select vec_id, embedding from '{data}/embeddings.parquet' order by 1").fetchall()
    return [r[0] for r in rows], np.array([r[1] for r in rows], float)


def test_flat_mean_shift_query_by_brute_force(spark, data):
    """Clusters of all vectors: seeds on the grid climb, the strongest centre of a neighbourhood stays."""
    from featuregrid.plans import catalog

    ids, x = vectors_of(data)
    h, found = 1.2, {}
    seeds = np.unique(np.rint(x / h), axis=0) * h
    for p in x if len(seeds) == len(x) else seeds:
        for _ in range(100):
            near = x[((x - p) ** 2).sum(1) <= h * h]
            if not len(near):
                break
            before, p = p, near.mean(0)
            if np.linalg.norm(p - before) <= 1e-3 * h:
                break
        if len(near):
            found[tuple(p)] = len(near)
    kept = []
    for c, _ in sorted(found.items(), key=lambda f: (f[1], f[0]), reverse=True):
        if all(np.linalg.norm(np.array(c) - k) > h for k in kept):
            kept.append(np.array(c))
    want = dict(zip(ids, ((x[:, None] - np.array(kept)[None]) ** 2).sum(2).argmin(1).tolist()))
    got = {r["id"]: r["cluster"] for r in catalog.queries()["mean_shift_full"](spark, data).collect()}
    assert got == want


def test_merged_modes_query_by_brute_force(spark, data):
    from featuregrid.plans import catalog

    _, x = vectors_of(data)
    h, modes = 0.5, []
    for p in x:
        for _ in range(30):
            d2 = ((x - p) ** 2).sum(1)
            w = np.where(d2 > 9 * h * h, 0, np.exp(-d2 / (2 * h * h)))
            before, p = p, w @ x / w.sum()
            if np.linalg.norm(p - before) < 0.01 * h:
                break
        modes.append(p)
    centres, sizes = [], []
    for m in modes:
        d = [np.linalg.norm(m - c) for c in centres]
        if d and min(d) < 0.25:
            k = int(np.argmin(d))
            centres[k] = (centres[k] * sizes[k] + m) / (sizes[k] + 1)
            sizes[k] += 1
        else:
            centres.append(m)
            sizes.append(1)
    got = [r["n"] for r in catalog.queries()["merge_modes"](spark, data).orderBy("center_id").collect()]
    assert got == sizes


def test_pca_query_by_decomposition(spark, data):
    from featuregrid.plans import catalog

    _, x = vectors_of(data)
    shares = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    shares = shares / shares.sum()
    rows = catalog.queries()["pca_95"](spark, data).orderBy("component").collect()
    assert len(rows) == int(np.searchsorted(np.cumsum(shares), 0.95, side="right")) + 1
    assert np.allclose([r["share"] for r in rows], shares[: len(rows)], atol=1e-6)


@pytest.mark.parametrize("name", ["kmeans_ml", "kmeans_mini_batch"])
def test_kmeans_queries_are_good_clusterings(spark, data, name):
    """Every row has a cluster, and the spread within is near that of plain k-means from the best of many starts."""
    from featuregrid.plans import catalog

    ids, x = vectors_of(data)
    got = {r["id"]: r["cluster"] for r in catalog.queries()[name](spark, data).collect()}
    labels = np.array([got[i] for i in ids])
    spread = lambda l: sum(((x[l == k] - x[l == k].mean(0)) ** 2).sum() for k in set(l.tolist()))  # noqa: E731, E741
    best = min(spread(segmentation.kmeans_labels(x, segmentation.Run("rgb", "kmeans", k=5, seed=s))) for s in range(8))
    assert len(set(labels.tolist())) == 5 and spread(labels) <= 1.1 * best


def test_segmentation_queries_by_brute_force(spark, data):
    """Labels of every pixel from NumPy alone, image by image."""
    from featuregrid.plans import catalog
    from featuregrid.plans import fixtures as fx

    rows = defaultdict(list)
    for r in fx.color_pixels(spark, data).collect():
        rows[r["image_id"]].append((r["y"], r["x"], r["r"], r["g"], r["b"]))
    got = defaultdict(dict)
    for r in catalog.queries()["segment_kmeans"](spark, data).collect():
        got[r["image_id"]][r["y"], r["x"]] = r["label"], r["cleaned"]
    assert got.keys() == rows.keys()
    for image, cells in rows.items():
        a = np.array(sorted(cells), float)
        h, w = int(a[:, 0].max()) + 1, int(a[:, 1].max()) + 1
        x = np.concatenate([a[:, 2:], a[:, [1]] / max(w - 1, 1), a[:, [0]] / max(h - 1, 1)], 1)
        labels = segmentation.kmeans_labels(segmentation.standardised(x), segmentation.Run("rgb_xy", "kmeans"))
        cleaned = regions.remove_small(labels.reshape(h, w), 3).ravel()
        assert [got[image][int(y), int(c)] for y, c in a[:, :2]] == list(zip(labels.tolist(), cleaned.tolist()))


def test_truth_products_are_written(spark, tmp_path):
    from featuregrid.operators import raster

    text = '{"imageHeight":9,"imageWidth":7,"shapes":[{"label":"a","points":[[1.4,1.5],[5.6,1.2],[5.1,6.5],[0.5,6.4]]}]}'
    df = spark.createDataFrame([("i1", text), ("i2", text)], "image_id string, j string")
    shapes = raster.class_ids(raster.shapes(raster.parse_annotations(df, "j").drop("j")), ["image_id"])
    made = raster.ground_truth(shapes, ["image_id"], 9, 7)
    assert sinks.write_truth(made, str(tmp_path)) == 6
    back = {r["path"].rpartition("/")[2]: r for r in files.label_planes(files.read_images(spark, str(tmp_path / "i1"))).collect()}
    mask = np.array(made.where("image_id = 'i1'").first()["mask"]).reshape(9, 7)
    assert (np.array(back["mask.png"]["labels"]).reshape(9, 7) == mask).all() and back["mask.png"]["names"] == ["0", "1"]
    # Corners are rounded, halves to even: (1, 2), (6, 1), (5, 6), (0, 6).
    assert mask[3, 2] == 1 and mask[7, 3] == 0


def test_corner_of_a_large_confusion(spark):
    cells = spark.range(60 * 50).selectExpr("cast(id div 50 as int) as gt", "cast(id % 50 as int) as pred", "id as n")
    corner = sinks.confusion_corner(cells)
    assert corner.count() == 1600 and corner.agg(F.max("gt"), F.max("pred")).first()[:] == (39, 39)


def test_mini_batches_are_drawn_anew(spark):
    df = spark.range(2000).select("id")
    first, second = ({r["id"] for r in clustering_batches(df, t)} for t in (0, 1))
    assert abs(len(first) - 500) < 100 and first != second


def clustering_batches(df, t):
    from featuregrid.operators import clustering

    return clustering.mini_batches(df, "id", 0.25, t).collect()
