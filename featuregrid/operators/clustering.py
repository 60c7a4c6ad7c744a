"""Clustering of vectors: k-means, kernel and flat mean shift, and the merging of modes.

Centres are small and travel as literals. The points of a kernel estimate travel with the function
up to a stated bound; beyond it they are all read in blocks from the shared folder, and the partial
weights of the blocks are summed. The vectors that climb never leave their partitions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.weights import dist2
from ..shared import shared_dir
from .planes import arrays_of, once

#: Points that are sampled at most, and the share; up to so many travel with a function.
MAX_SAMPLES, SAMPLE_RATIO = 12_000, 0.07
#: Points of a block beyond that, and rows that climb together.
BLOCK, TOGETHER, TOGETHER_BLOCKS = 2048, 256, 2048


def literal(vectors) -> Column:
    """A small list of vectors as one constant."""
    rows = ", ".join("array(" + ", ".join(f"{float(v)!r}D" for v in row) + ")" for row in vectors)
    return F.expr(f"array({rows})")


def nearest(features: Column, centres: Column) -> Column:
    """The index of the nearest centre, the least on ties."""
    distances = F.transform(centres, lambda c: dist2(features, c))
    return once(distances, lambda d: F.array_position(d, F.array_min(d)) - 1).cast("int")


def assign(df: DataFrame, centres, col: str = "features", out: str = "cluster") -> DataFrame:
    """``df`` with the nearest of a small list of centres."""
    return df.withColumn(out, nearest(F.col(col), literal(centres)))


def centre_means(assigned: DataFrame, dims: int, col: str = "features", cluster: str = "cluster") -> DataFrame:
    """Mean vector and size of each cluster."""
    means = F.array(*[F.avg(F.get(col, F.lit(i))) for i in range(dims)])
    return assigned.groupBy(cluster).agg(means.alias("centre"), F.count("*").alias("n"))


def lloyd(df: DataFrame, centres, iterations: int = 100, empty: str = "zero", col: str = "features") -> tuple[list[list[float]], DataFrame]:
    """Lloyd's k-means from given centres: final centres, and ``df`` with clusters.

    An empty cluster becomes the zero vector, or stays with ``empty='keep'``. It ends when no
    centre moves by more than 1e-8 + 1e-5 of its size; the labels are then those of the last
    assignment. Each round is one scan with a partial aggregate; only centres reach the driver.
    """
    centres = [list(map(float, c)) for c in centres]
    dims = len(centres[0])
    used = centres
    for _ in range(iterations):
        used = centres
        got = {r["cluster"]: r["centre"] for r in centre_means(assign(df, centres, col), dims, col).collect()}
        fresh = [list(got[k]) if k in got else ([0.0] * dims if empty == "zero" else c) for k, c in enumerate(centres)]
        if np.allclose(fresh, centres):
            break
        centres = fresh
    return centres, assign(df, used, col)


def first_vectors(df: DataFrame, k: int, key: str, col: str = "features") -> list[list[float]]:
    """The vectors of the k least keys, as starting centres."""
    return [r[col] for r in df.orderBy(key).limit(k).select(col).collect()]


def kmeans(df: DataFrame, k: int = 5, max_iter: int = 100, seed: int = 42, col: str = "features") -> DataFrame:
    """k-means|| and full passes from the ML library."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = df.withColumn("__v", array_to_vector(col))
    model = KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="__v", predictionCol="cluster", initMode="k-means||").fit(vectors)
    return model.transform(vectors).drop("__v")


def plus_plus(points: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """k starting centres out of bounded points, each drawn in proportion to its squared distance to the
    ones before it; fewer if there are fewer different points."""
    rng = np.random.default_rng(seed)
    centres = [points[rng.integers(len(points))]]
    while len(centres) < k:
        d2 = ((points[:, None, :] - np.array(centres)[None]) ** 2).sum(2).min(1)
        if not d2.sum():
            break
        centres.append(points[rng.choice(len(points), p=d2 / d2.sum())])
    return np.array(centres)


def mini_batches(df: DataFrame, key: str, share: float, round_no: int, seed: int = 42) -> DataFrame:
    """About ``share`` of the rows, drawn for a round by a hash of the key."""
    drawn = F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)), F.lit(str(round_no)))), 1, 8)
    return df if share >= 1 else df.where(drawn < f"{int(share * (1 << 32)):08x}")


def mini_batch_kmeans(df: DataFrame, key: str, k: int = 5, batch: int = 8192, iterations: int = 100, seed: int = 42, col: str = "features", centres=None, share: float | None = None, tolerance: float = 1e-4) -> tuple[list[list[float]], DataFrame]:
    """Mini-batch k-means: final centres, and ``df`` with the nearest one of each row.

    Each round draws about ``batch`` rows (or a ``share``) and moves every centre towards the mean of its
    batch rows by their part in all rows it has seen. It starts from k-means++ on three batches of rows
    at most, and ends when no centre moves by more than ``tolerance``. Only sums of clusters reach the
    driver, and a round costs one scan with a filter, whatever the batch.
    """
    if centres is None:
        centres = plus_plus(np.array([r[0] for r in sample_fixed(df, key, 1.0, min(3 * batch, MAX_SAMPLES)).select(col).collect()], float), k, seed)
    if share is None:
        share = batch / max(df.count(), 1)
    at, dims, seen = np.array(centres, float), len(centres[0]), np.zeros(len(centres))
    for t in range(iterations):
        moved = 0.0
        for r in centre_means(assign(mini_batches(df, key, share, t, seed), at, col), dims, col).collect():
            c = r["cluster"]
            seen[c] += r["n"]
            step = (np.array(r["centre"]) - at[c]) * (r["n"] / seen[c])
            at[c] += step
            moved = max(moved, float(np.linalg.norm(step)))
        if moved <= tolerance:
            break
    return at.tolist(), assign(df, at, col)


def sample_fixed(df: DataFrame, key: str, ratio: float = SAMPLE_RATIO, most: int = MAX_SAMPLES) -> DataFrame:
    """min(max(1, int(ratio * n)), most, n) rows, drawn by a hash of the key."""
    n = df.count()
    size = min(max(1, int(ratio * n)), most, n)
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(size)


def _bounded(sample: DataFrame, col: str) -> np.ndarray:
    """The vectors of a sample of at most MAX_SAMPLES rows, on the driver."""
    rows = sample.select(col).limit(MAX_SAMPLES + 1).collect()
    if len(rows) > MAX_SAMPLES:
        raise ValueError(f"a kernel estimate takes at most {MAX_SAMPLES} points; draw a sample first")
    return np.array([r[0] for r in rows], float)


def _blocks(sample: DataFrame, col: str) -> tuple[Callable[[], Iterable[np.ndarray]], int]:
    """All vectors of ``sample`` as a function that passes once over them in blocks, and the rows
    that should share a pass. Up to MAX_SAMPLES rows are one block in the function; more are
    written to the shared folder and read from there, block by block, in every pass."""
    rows = sample.select(col).limit(MAX_SAMPLES + 1).collect()
    if len(rows) <= MAX_SAMPLES:
        points = np.array([r[0] for r in rows], float)
        return lambda: [points], TOGETHER
    path = f"{shared_dir(sample.sparkSession)}/points-{uuid.uuid4().hex}"
    sample.select(F.col(col).cast("array<double>").alias("p")).write.parquet(path)

    def read():
        import pyarrow.dataset

        for batch in pyarrow.dataset.dataset(path, format="parquet").to_batches(columns=["p"], batch_size=BLOCK):
            if batch.num_rows:
                yield batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

    return read, TOGETHER_BLOCKS


def _kernel(kind: str, d2: np.ndarray, h: float) -> np.ndarray:
    if kind == "gaussian":
        return np.where(d2 > (3 * h) ** 2, 0.0, np.exp(-d2 / (2 * h * h)))
    return np.maximum(0.0, 1 - d2 / (h * h))


def shift_points(points: np.ndarray, blocks: Callable[[], Iterable[np.ndarray]], h: float, kind: str, max_iter: int = 30, threshold: float = 1e-3) -> np.ndarray:
    """Each point moved to the weighted mean of all blocks around it, until it moves less than
    ``threshold``, no weight is left, or ``max_iter`` rounds are over."""
    points = points.copy()
    live = np.arange(len(points))
    for _ in range(max_iter):
        if not len(live):
            break
        here = points[live]
        total, sums = np.zeros(len(live)), np.zeros_like(here)
        for block in blocks():
            if block.size * len(live) <= 2_000_000:
                d2 = ((here[:, None, :] - block[None, :, :]) ** 2).sum(2)
            else:
                d2 = np.maximum((here**2).sum(1)[:, None] + (block**2).sum(1)[None, :] - 2 * here @ block.T, 0)
            weight = _kernel(kind, d2, h)
            total += weight.sum(1)
            sums += weight @ block
        moving = total > 1e-12
        fresh = sums[moving] / total[moving, None]
        step = np.linalg.norm(fresh - here[moving], axis=1)
        points[live[moving]] = fresh
        live = live[moving][step >= threshold]
    return points


def mean_shift(df: DataFrame, sample: DataFrame, h: float, kind: str, max_iter: int = 30, threshold: float | None = None, col: str = "features", out: str = "mode") -> DataFrame:
    """``df`` with the mode that every row climbs to over all rows of a sample (0.01 h ends a climb)."""
    points, together = _blocks(sample, col)
    stop = 0.01 * h if threshold is None else threshold
    columns = df.columns
    at = columns.index(col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for s in range(0, batch.num_rows, together):
                part = batch.slice(s, together)
                moved = shift_points(np.array(part.column(at).to_pylist(), float), points, h, kind, max_iter, stop)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(moved.tolist(), pa.list_(pa.float64()))], names=[*columns, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def merge_modes(modes: DataFrame, threshold: float, order: str, col: str = "mode") -> DataFrame:
    """Leader clustering in the given order: a mode joins the nearest centre closer than
    ``threshold``, which then moves to the mean of its members, or founds a new one.

    The rule depends on the order, so rounded modes are counted first and one task walks through
    the distinct ones, batch by batch; it holds the centres, whose number is that of hills, not of rows.
    """
    distinct = modes.groupBy(F.transform(col, lambda v: F.round(v, 6)).alias("mode")).agg(F.count("*").alias("n"), F.min(order).alias("first"))

    def walk(batches):
        import pyarrow as pa

        centres, sizes = np.zeros((0, 0)), np.zeros(0, np.int64)
        for batch in batches:
            for mode, n in zip(arrays_of(batch.column(0)), batch.column(1).to_pylist()):
                d = np.sqrt(((centres - mode) ** 2).sum(1)) if len(centres) else np.zeros(0)
                k = int(d.argmin()) if len(d) else -1
                if k >= 0 and d[k] < threshold:
                    centres[k] = (centres[k] * sizes[k] + mode * n) / (sizes[k] + n)
                    sizes[k] += n
                else:
                    centres = np.vstack([centres, mode]) if len(centres) else mode[None].copy()
                    sizes = np.append(sizes, n)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int32()), pa.array(centres.tolist(), pa.list_(pa.float64())), pa.array(sizes, pa.int64())], names=["center_id", "center", "n"])

    # Sorted on all tasks; the last one streams through the parts in order and holds the centres alone.
    return distinct.orderBy("first").select("mode", "n").coalesce(1).mapInArrow(walk, "center_id int, center array<double>, n long")


def bin_seeds(df: DataFrame, h: float, col: str = "features") -> DataFrame:
    """Distinct grid points of spacing h (half to even), as starts of climbs, with their counts."""
    return df.groupBy(F.transform(col, lambda v: F.rint(v / h)).alias("bin")).agg(F.count("*").alias("n")).select(F.transform("bin", lambda b: b * h).alias("seed"), "n")


def climb_flat(seeds: np.ndarray, blocks: Callable[[], Iterable[np.ndarray]], h: float, max_iter: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Where seeds end that climb to the mean of all points within h, and their points there;
    seeds without points are left out."""
    seeds = seeds.copy()
    counts = np.zeros(len(seeds), np.int64)
    live = np.arange(len(seeds))
    for _ in range(max_iter):
        if not len(live):
            break
        sums = np.zeros((len(live), seeds.shape[1]))
        counts[live] = 0
        for block in blocks():
            for at, k in enumerate(live):
                near = block[((block - seeds[k]) ** 2).sum(1) <= h * h]
                counts[k] += len(near)
                sums[at] += near.sum(0)
        there = counts[live] > 0
        live, fresh = live[there], sums[there] / counts[live[there], None]
        moved = np.linalg.norm(fresh - seeds[live], axis=1)
        seeds[live] = fresh
        live = live[moved > 1e-3 * h]
    return seeds[counts > 0], counts[counts > 0]


def flat_mean_shift(df: DataFrame, sample: DataFrame, h: float, max_iter: int = 100, col: str = "features") -> tuple[np.ndarray, DataFrame]:
    """Flat-kernel mean shift with binned seeds over all rows of a sample: centres, and ``df`` with
    every row's nearest centre.

    Seeds climb to the mean of points within h until they move at most 1e-3 h; without points a
    seed goes. Centres are taken by falling count of points, then value; one within h of a
    taken centre goes.
    """
    points, together = _blocks(sample, col)
    seeds = bin_seeds(sample, h, col)
    starts = sample.select(F.col(col).alias("seed")) if seeds.count() == sample.count() else seeds.select("seed")

    def climb(batches):
        import pyarrow as pa

        for batch in batches:
            for s in range(0, batch.num_rows, together):
                centres, counts = climb_flat(np.array(batch.column(0).slice(s, together).to_pylist(), float), points, h, max_iter)
                yield pa.RecordBatch.from_arrays([pa.array(centres.tolist(), pa.list_(pa.float64())), pa.array(counts, pa.int64())], names=["centre", "n"])

    found = starts.mapInArrow(climb, "centre array<double>, n long").distinct().orderBy(F.desc("n"), F.desc("centre"))
    kept: list[np.ndarray] = []
    for r in found.toLocalIterator():  # a partition at a time: only the centres kept stay
        c = np.array(r["centre"])
        if all(np.linalg.norm(c - k) > h for k in kept):
            kept.append(c)
    if not kept:
        raise ValueError(f"no seed has points within {h}; choose a larger bandwidth")
    return np.array(kept), assign(df, kept, col)


#: How mean shift is prepared in each mode: share of rows or scale, and PCA.
MODES = {"1": {"name": "sampled", "sample": True, "scale": 1.0, "pca": False}, "2": {"name": "quarter resize", "sample": False, "scale": 0.25, "pca": False}, "3": {"name": "pca 95", "sample": False, "scale": 1.0, "pca": True}, "4": {"name": "half resize pca 95", "sample": False, "scale": 0.5, "pca": True}}


def mode_settings(mode: str) -> dict:
    """Settings of a processing mode; an unknown one is the first."""
    return MODES.get(mode, MODES["1"])


def experiment_grid(spaces, k: int = 5, bandwidths=(0.8, 1.5), mode: str = "1") -> list[dict]:
    """All runs: k-means and each bandwidth of mean shift for every feature space."""
    return [{"space": s, "algorithm": a, "mode": mode_settings(mode)["name"] if a == "mean shift" else None, **p} for s in spaces for a, p in [("kmeans", {"k": k}), *(("mean shift", {"bandwidth": b}) for b in bandwidths)]]
