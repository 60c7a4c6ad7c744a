"""Whole segmentation of many images at once: features, clustering and clean-up.

Images are independent, so each is fitted in one task with NumPy: its pixels are one group of
bounded size. Between images nothing is shared but the settings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features, planes, regions
from .clustering import MAX_SAMPLES, SAMPLE_RATIO, experiment_grid, mode_settings


@dataclass(frozen=True)
class Run:
    """Settings of one run; bandwidth is used by 'mean shift', k by 'kmeans'."""

    space: str = "lab_xy"
    algorithm: str = "mean shift"
    mode: str = "1"
    k: int = 5
    bandwidth: float = 0.8
    min_area: int = 100
    max_iter: int = 100
    seed: int = 42


def standardised(x: np.ndarray, epsilon: float = 1e-6) -> np.ndarray:
    return (x - x.mean(0)) / (x.std(0) + epsilon)


def leading_components(x: np.ndarray, keep: float = 0.95) -> np.ndarray:
    """Scores on the fewest components whose variance shares exceed ``keep``; one column stays."""
    if x.shape[1] == 1:
        return x
    centred = x - x.mean(0)
    _, s, axes = np.linalg.svd(centred, full_matrices=False)
    shares = np.cumsum(s**2) / max((s**2).sum(), 1e-300)
    return centred @ axes[: min(int(np.searchsorted(shares, keep, side="right")) + 1, len(s))].T


def nearest_index(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre, by blocks; the least on ties."""
    out = np.empty(len(x), np.int64)
    for s in range(0, len(x), 4096):
        out[s : s + 4096] = ((x[s : s + 4096, None, :] - centres[None]) ** 2).sum(2).argmin(1)
    return out


def kmeans_labels(x: np.ndarray, run: Run) -> np.ndarray:
    """Lloyd's k-means from k random distinct vectors; an empty cluster becomes the zero vector."""
    rng = np.random.default_rng(run.seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.choice(len(distinct), min(run.k, len(distinct)), replace=False)]
    labels = nearest_index(x, centres)
    for _ in range(run.max_iter):
        fresh = np.stack([x[labels == k].mean(0) if (labels == k).any() else np.zeros(x.shape[1]) for k in range(len(centres))])
        if np.allclose(fresh, centres):
            break
        centres = fresh
        labels = nearest_index(x, centres)
    return labels


def flat_modes(points: np.ndarray, h: float, max_iter: int = 100) -> np.ndarray:
    """Centres of flat-kernel mean shift from binned seeds, strongest first, none within h of another."""
    seeds = np.unique(np.rint(points / h), axis=0) * h
    starts = points if len(seeds) == len(points) else seeds
    found = {}
    for p in starts:
        near = np.zeros((0, points.shape[1]))
        for _ in range(max_iter):
            near = points[((points - p) ** 2).sum(1) <= h * h]
            if not len(near):
                break
            before, p = p, near.mean(0)
            if np.linalg.norm(p - before) <= 1e-3 * h:
                break
        if len(near):
            found[tuple(p)] = len(near)
    kept: list[np.ndarray] = []
    for centre, _ in sorted(found.items(), key=lambda c: (c[1], c[0]), reverse=True):
        if all(np.linalg.norm(np.array(centre) - other) > h for other in kept):
            kept.append(np.array(centre))
    if not kept:
        raise ValueError(f"no seed has points within {h}; choose a larger bandwidth")
    return np.array(kept)


def mean_shift_labels(x: np.ndarray, run: Run) -> np.ndarray:
    """Modes of all pixels, or of a sample in a sampling mode; every pixel takes the nearest."""
    if mode_settings(run.mode)["sample"]:
        n = min(max(1, int(SAMPLE_RATIO * len(x))), MAX_SAMPLES, len(x))
        points = x[np.random.default_rng(run.seed).choice(len(x), n, replace=False)]
    else:
        points = x
    return nearest_index(x, flat_modes(points, run.bandwidth, run.max_iter))


def segment(images: DataFrame, h: planes.Side, w: planes.Side, run: Run = Run()) -> DataFrame:
    """image_id, h, w, labels, cleaned from rows (image_id, r, g, b) of planes.

    Mean shift in the resizing modes works on smaller images, and so are its label planes.
    Texture spaces need a ``texture`` plane of arrays beside the colours.
    """
    scale = mode_settings(run.mode)["scale"] if run.algorithm != "kmeans" else 1.0
    names = ["r", "g", "b"] + (["texture"] if "texture" in features.SPACES[run.space] else [])
    if scale != 1.0:
        if "texture" in names:
            raise ValueError("compute texture on the resized image")
        images = planes.resize_area(images.select("image_id", *names, planes.side(h).alias("h"), planes.side(w).alias("w")), names, F.col("h"), F.col("w"), scale)
        images = images.select("image_id", "h", "w", *[F.transform(c, lambda v: F.floor(v + 0.5).cast("int")).alias(c) for c in names])
    else:
        images = images.select("image_id", planes.side(h).alias("h"), planes.side(w).alias("w"), *names)
    pixels = planes.to_pixels(images, {c: c for c in names}, F.col("w"))
    vectors = features.feature_space(pixels, run.space).select("image_id", "h", "w", "y", "x", "features")
    kind = dict(vectors.dtypes)["image_id"]

    def fit(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["y", "x"])
        x = standardised(np.array(pdf["features"].tolist(), float))
        if run.algorithm != "kmeans" and mode_settings(run.mode)["pca"]:
            x = leading_components(x)
        labels = kmeans_labels(x, run) if run.algorithm == "kmeans" else mean_shift_labels(x, run)
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "h": [pdf["h"].iloc[0]], "w": [pdf["w"].iloc[0]], "labels": [labels.tolist()]})

    fitted = vectors.groupBy("image_id").applyInPandas(fit, f"image_id {kind}, h int, w int, labels array<int>")
    return regions.clean(fitted, run.min_area)


def run_grid(images: DataFrame, h: planes.Side, w: planes.Side, spaces: list[str], k: int = 5, bandwidths: tuple[float, ...] = (0.8, 1.5), mode: str = "1", **options) -> DataFrame:
    """Every run of the experiment grid over all images: ``feature_set, algorithm, run`` and the
    columns of ``segment``. Runs are independent plans whose rows are united."""
    out = None
    for cell in experiment_grid(spaces, k, bandwidths, mode):
        run = Run(cell["space"], cell["algorithm"], mode, k=k, bandwidth=cell.get("bandwidth", 0.0), **options)
        name = f"k={k}" if run.algorithm == "kmeans" else f"{cell['mode']} h={run.bandwidth}"
        rows = segment(images, h, w, run).select(F.lit(run.space).alias("feature_set"), F.lit(run.algorithm).alias("algorithm"), F.lit(name).alias("run"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out
