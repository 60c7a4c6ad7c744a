"""Contingency of two labelings and the matching of predicted to true labels.

All inputs are rows (keys, gt, pred) or their counts; keys name what is scored on its own,
such as an image and a prediction.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .planes import with_arrays


def compact(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """``df`` with labels 0..K-1 in the order of the distinct values of each key.

    The distinct values are ranked, not the rows, so a large key costs a join, not one sort.
    """
    ranks = df.select(*keys, col).distinct().withColumn(out, (F.dense_rank().over(W.partitionBy(*keys).orderBy(col)) - 1).cast("int"))
    return df.join(ranks, [*keys, col])


def first_seen(df: DataFrame, keys: list[str], col: str, position: str, out: str, start: int = 1) -> DataFrame:
    """Distinct values with ids in the order in which each key first has them."""
    seen = df.groupBy(*keys, col).agg(F.min(position).alias("first_position"))
    return seen.withColumn(out, (F.row_number().over(W.partitionBy(*keys).orderBy("first_position", col)) - 1 + start).cast("int"))


def contingency(df: DataFrame, keys: list[str], gt: str = "gt", pred: str = "pred") -> DataFrame:
    """Counts of (gt, pred): a partial and a final hash aggregate."""
    return df.groupBy(*keys, F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def dense(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts with zeros for all labels from 0 to the largest of each key."""
    cells = counts.groupBy(*keys).agg(F.max("gt").alias("g"), F.max("pred").alias("p"))
    cells = cells.select(*keys, F.explode(F.sequence(F.lit(0), F.col("g"))).alias("gt"), "p").select(*keys, "gt", F.explode(F.sequence(F.lit(0), F.col("p"))).alias("pred"))
    return cells.join(counts, [*keys, "gt", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def row_normalised(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts with their share of the row's sum; an empty row has zeros."""
    total = F.sum("n").over(W.partitionBy(*keys, "gt"))
    return counts.withColumn("share", F.coalesce(F.try_divide(F.col("n").cast("double"), total.cast("double")), F.lit(0.0)))


def many_to_one(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pred, matched, overlap, is_extra: the gt label of largest overlap, the least on ties."""
    best = F.row_number().over(W.partitionBy(*keys, "pred").orderBy(F.desc("n"), F.asc("gt")))
    return counts.withColumn("__rank", best).where("__rank = 1").select(*keys, "pred", F.col("gt").alias("matched"), F.col("n").alias("overlap"), F.lit(False).alias("is_extra"))


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column), one to one, of largest total gain, by shortest augmenting paths."""
    turned = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if turned else gain).astype(float)
    n, m = cost.shape
    row_of = np.full(m, -1)
    u, v = np.zeros(n), np.zeros(m)
    for i in range(n):
        reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, base, last = i, 0.0, -1
        while True:
            slack = base + cost[row] - u[row] - v
            better = ~done & (slack < reach)
            reach[better], via[better] = slack[better], last
            j = int(np.where(done, np.inf, reach).argmin())
            done[j] = True
            base = reach[j]
            if row_of[j] < 0:
                break
            row, last = row_of[j], j
        u[i] += base
        for k in np.flatnonzero(done):
            if k != j:
                u[row_of[k]] += base - reach[k]
            v[k] += reach[k] - base
        while j >= 0:
            before = via[j]
            row_of[j] = i if before < 0 else row_of[before]
            j = before
    pairs = [(int(r), int(c)) for c, r in enumerate(row_of) if r >= 0]
    return sorted((c, r) for r, c in pairs) if turned else sorted(pairs)


def one_to_one(gt: np.ndarray, pred: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """(pred, matched, overlap, is_extra) for the cells of one table."""
    n_gt, preds = int(gt.max()) + 1, np.unique(pred)
    table = np.zeros((n_gt, len(preds)), np.int64)
    table[gt, np.searchsorted(preds, pred)] = n
    matched = {c: r for r, c in best_assignment(table)}
    extra = iter(range(n_gt, n_gt + len(preds)))
    return [(int(p), matched[c], int(table[matched[c], c]), False) if c in matched else (int(p), next(extra), int(table[:, c].max()), True) for c, p in enumerate(preds.tolist())]


def hungarian(counts: DataFrame, keys: list[str]) -> DataFrame:
    """As ``many_to_one``, but one to one with the largest total overlap. Predicted labels left
    over get ids from the number of gt labels on, in their order, as extra labels whose
    overlap is their best. The label pairs of a key, not its pixels, are one row, and many rows
    are solved in one batch."""
    cells = F.collect_list(F.struct(F.col("gt").cast("int").alias("gt"), F.col("pred").cast("int").alias("pred"), "n"))
    rows = counts.groupBy(*keys).agg(cells.alias("__cells"))
    rows = rows.select(*keys, *[F.col(f"__cells.{c}").alias(f"__{c}") for c in ("gt", "pred", "n")])
    solved = with_arrays(rows, ["__gt", "__pred", "__n"], {"__m": "array<struct<pred:int,matched:int,overlap:bigint,is_extra:boolean>>"}, lambda g, p, n: ([dict(zip(("pred", "matched", "overlap", "is_extra"), m)) for m in one_to_one(g, p, n)],), keep=keys)
    return solved.select(*keys, F.inline("__m"))


def extra_ids(counts: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Ids of predicted labels without a match: they follow the gt labels, in pred order."""
    sizes = counts.groupBy(*keys).agg((F.max("gt") + 1).alias("n_gt"))
    left = counts.select(*keys, "pred").distinct().join(matches.select(*keys, "pred"), [*keys, "pred"], "left_anti").join(sizes, keys)
    return left.select(*keys, "pred", (F.row_number().over(W.partitionBy(*keys).orderBy("pred")) - 1 + F.col("n_gt")).cast("int").alias("extra_id"))


def remapped(counts: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts (gt, matched) after predicted labels take their matched ids."""
    joined = counts.join(matches.select(*keys, "pred", "matched"), [*keys, "pred"])
    return joined.groupBy(*keys, "gt", F.col("matched").alias("pred")).agg(F.sum("n").alias("n"))


def names_by_overlap(counts: DataFrame, names: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """A name for each gt label from the annotation label it overlaps most: the annotation is the
    ``pred`` of ``counts``, ``names`` has (keys, pred, name). Fewer than ``least`` common pixels
    give 'class_<id>'; an overlap with the background, label 0, gives 'background_or_<id>'."""
    best = F.row_number().over(W.partitionBy(*keys, "gt").orderBy(F.desc("n"), F.asc("pred")))
    top = counts.withColumn("__rank", best).where("__rank = 1").drop("__rank").join(names, [*keys, "pred"], "left")
    text = F.col("gt").cast("string")
    named = F.when(F.col("n") < least, F.concat(F.lit("class_"), text)).when(F.col("pred") == 0, F.concat(F.lit("background_or_"), text)).otherwise(F.coalesce("name", F.concat(F.lit("class_"), text)))
    return top.select(*keys, "gt", named.alias("class_name"))
