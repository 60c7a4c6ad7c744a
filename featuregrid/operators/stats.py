"""Distances between neighbours, their percentiles, and principal components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import _bounded


def neighbour_distance(sample: DataFrame, kth: int, col: str = "features") -> DataFrame:
    """The distance of every row of a bounded sample to its k-th nearest row, counting itself as
    the 0th. A sample of kth rows or fewer is an error."""
    points = _bounded(sample, col)
    if len(points) <= kth:
        raise ValueError(f"{kth + 1} points are needed, there are {len(points)}")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for p in batch.column(0).to_pylist():
                d2 = ((points - np.array(p, float)) ** 2).sum(1)
                out.append(float(np.sqrt(np.partition(d2, kth)[kth])))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], names=["distance"])

    return sample.select(col).mapInArrow(run, "distance double")


def percentiles(df: DataFrame, col: str, ranks: list[int]) -> DataFrame:
    """One row for each rank (in percent), with linear interpolation."""
    shares = F.array(*[F.lit(r / 100.0) for r in ranks])
    values = df.agg(F.percentile(col, shares).alias("v"))
    return values.select(F.explode(F.arrays_zip(F.array(*[F.lit(r) for r in ranks]).alias("rank"), F.col("v").alias("value"))).alias("z")).select("z.rank", "z.value")


def bandwidth_percentiles(sample: DataFrame, kth: int = 30, col: str = "features", ranks=(10, 25, 50, 75, 90)) -> DataFrame:
    """Percentiles of k-th neighbour distances; ranks 25 to 90 are bandwidth candidates."""
    return percentiles(neighbour_distance(sample, kth, col), "distance", list(ranks)).withColumn("candidate", F.col("rank") >= 25)


def nearest_percentiles(sample: DataFrame, col: str = "features", ranks=(10, 25, 50, 75, 90, 95)) -> DataFrame:
    """Percentiles of the distance to the nearest other row."""
    return percentiles(neighbour_distance(sample, 1, col), "distance", list(ranks))


def pca(df: DataFrame, dims: int, keep: float = 0.95, col: str = "features", out: str = "components") -> tuple[DataFrame, list[float]]:
    """``df`` on its leading components, and the variance shares of those kept: the fewest whose
    shares exceed ``keep``. Means are taken off first. One column is left as it is."""
    if dims == 1:
        return df.withColumn(out, F.col(col)), [1.0]
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    means = df.agg(F.array(*[F.avg(F.get(col, F.lit(i))) for i in range(dims)]).alias("m")).first()["m"]
    mean = F.array(*[F.lit(m) for m in means])
    centred = df.withColumn("__v", array_to_vector(F.zip_with(col, mean, lambda a, b: a - b)))
    model = PCA(k=dims, inputCol="__v", outputCol="__p").fit(centred)
    shares = model.explainedVariance.toArray()
    k = min(int(np.searchsorted(np.cumsum(shares), keep, side="right")) + 1, dims)
    return model.transform(centred).withColumn(out, F.slice(vector_to_array("__p"), 1, k)).drop("__v", "__p"), shares[:k].tolist()
