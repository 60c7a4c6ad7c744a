"""Sharding by sampled splitters, DataFrame operations only.

Records are ordered by (hash of the text, id, row), so equal texts lie together, yet a group of
any size can be cut. Size-weighted samples of that key give splitters at quantiles; the
splitters deal the records into many ranges of near equal bytes, and ranges that came out
overfull are sampled again and subdivided. Exact totals of the ranges then place every record in
the global order, and shards are cut where the bytes reach equal parts of the total, a group of
equal texts that is small against a shard going whole to one side. The cut depends on the order
alone, so it is the same whatever was sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, table

#: Ranges for each shard, and sampled keys for each range (the sample is bounded by both).
RANGES, SAMPLES = 32, 16
#: A range is overfull with more than so many times the mean bytes; rounds of subdividing.
OVERFULL, ROUNDS = 3, 8
#: Bytes that a record takes beside its text.
OVERHEAD = 8
#: A group of equal texts is kept whole if it has no more than this part of a shard's mean bytes.
WHOLE = 1 / 128
_LEAST = -(1 << 63)


def _key() -> Column:
    return F.struct("key", "id", "seq")


def _sample(rows: DataFrame, n: int, total: int) -> list[tuple[int, int, int]]:
    """About n keys out of ``total`` bytes, each drawn with a chance in proportion to its size by a
    hash, so that only the drawn keys reach the driver."""
    u = (F.pmod(F.xxhash64("key", "id", "seq", F.lit(17)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    drawn = rows.where(u < F.col("size") * (n / max(total, 1))).select("key", "id", "seq")
    return sorted(map(tuple, drawn.collect()))


def _range_of(splitters: list[tuple[int, int, int]]) -> Column:
    """The number of splitters at or below a record's key, by binary search."""
    if not splitters:
        return F.lit(0)
    whole = lambda v: f"cast('{v}' as long)"
    cuts = F.expr("array(" + ", ".join(f"named_struct('key', {whole(k)}, 'id', {whole(i)}, 'seq', {whole(s)})" for k, i, s in splitters) + ")")
    n = len(splitters)
    steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)]
    step = lambda at, k: F.when((at + k <= n) & (F.element_at(cuts, F.least(at + k, F.lit(n))) <= _key()), at + k).otherwise(at)
    return F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(0), step)


def _at_edges(rows: DataFrame, splitters: list[tuple[int, int, int]], most: float) -> tuple[list[tuple[int, int, int]], list[int]]:
    """The splitters moved to the start of their group unless it has more than ``most`` bytes, and the
    keys of those groups. There are no more keys than splitters."""
    if not splitters:
        return [], []
    keys = rows.sparkSession.createDataFrame([(k,) for k in sorted({k for k, _, _ in splitters})], "key long")
    large = {r["key"] for r in rows.join(F.broadcast(keys), "key").groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > most).collect()}
    return sorted({(k, i, s) if k in large else (k, _LEAST, -1) for k, i, s in splitters}), sorted(large)


def assign_shards(df: DataFrame, shards: int, work: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, size, text_crc32, shard, slot`` for each row of ``df``.

    size is the UTF-8 bytes of the text and 8 more; a null text counts as empty. Shards are runs
    of the global order: each ends within one record, or one small group of equal texts, of its equal
    part of all bytes, and slots number its records from 0. Rows that repeat an id or text are records of their own; null
    ids are placed like any other. An empty table gives no rows; shards may stay empty if
    there are few records. Only the id and text columns are read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("named"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("id"), F.monotonically_increasing_id().alias("seq"),
        F.xxhash64(text).alias("key"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = work.save(rows)
    ranges = shards * RANGES
    total = rows.agg(F.sum("size")).first()[0] or 0
    sample = _sample(rows, ranges * SAMPLES, total)
    whole = WHOLE * total / shards
    splitters, large = _at_edges(rows, sample[SAMPLES::SAMPLES], whole)
    for _ in range(ROUNDS):
        ranged = rows.withColumn("range", _range_of(splitters))
        totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
        mean = total / ranges
        over = {r["range"]: r["bytes"] for r in totals if r["bytes"] > OVERFULL * mean and r["n"] > 1}
        if not over:
            break
        more = _sample(ranged.where(F.col("range").isin(*over)), ranges * SAMPLES, sum(over.values()))[SAMPLES // 2 :: SAMPLES]
        finer, large_too = _at_edges(rows, [*splitters, *more], whole)
        if finer == splitters:
            break
        splitters, large = finer, large_too
    offsets, at_bytes, at_row = [], 0, 0
    for r in sorted(totals, key=lambda r: r["range"]):
        offsets.append((r["range"], at_bytes, at_row))
        at_bytes, at_row = at_bytes + r["bytes"], at_row + r["n"]
    # One row for each range: at most a few times shards * RANGES.
    offsets = work.spark.createDataFrame(offsets, "range int, bytes_before long, rows_before long")
    order = W.partitionBy("range").orderBy("key", "id", "seq")
    placed = ranged.withColumns({"cum": F.sum("size").over(order), "nth": F.row_number().over(order)}).join(F.broadcast(offsets), "range")
    # A small group lies in one range, and its records take the middle of the group for theirs.
    group = W.partitionBy("range", "key")
    keys = work.spark.createDataFrame([(k, True) for k in large], "key long, large boolean")
    placed = placed.join(F.broadcast(keys), "key", "left").withColumns({"begins": F.min(F.col("cum") - F.col("size")).over(group), "group_bytes": F.sum("size").over(group)})
    small = F.col("large").isNull() & (F.col("group_bytes") <= whole)
    middle = 2 * F.col("bytes_before") + F.when(small, 2 * F.col("begins") + F.col("group_bytes")).otherwise(2 * F.col("cum") - F.col("size"))
    shard = F.least(F.floor(middle.cast("decimal(38,0)") * shards / (2 * max(total, 1))).cast("int"), F.lit(shards - 1))
    placed = placed.select("named", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("at"))
    placed = work.save(placed)
    firsts = placed.groupBy("shard").agg(F.min("at").alias("first"))
    out = placed.join(F.broadcast(firsts), "shard")  # one row for each shard
    work.drop(rows)
    return out.select(F.col("named").alias(id_col), "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))


def write_shards(df: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the records of ``df`` (with unique ids) into one folder for each shard, in slot order."""
    joined = df.join(assigned.select(id_col, "shard", "slot"), id_col)
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    out = assign_shards(table(spark, sf_dir, "documents"), 24, Workspace(spark, "sharding"))
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
