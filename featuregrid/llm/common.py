"""Shared helpers: reading tables, the shared work folder, and Arrow batch plumbing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it while ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Workspace:
    """Tables written to the shared folder to cut lineage.

    ``save`` writes a frame as Parquet and returns it reread, so later stages and lost
    executors restart from files, not from the first scan. ``drop`` removes a table that
    nothing later reads; what a returned frame still reads must stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._held: list[tuple[DataFrame, str]] = []

    def save(self, df: DataFrame, codec: str = "snappy") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.option("compression", codec).option("parquet.block.size", ROW_GROUP).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._held.append((out, path))
        trim_driver(self.spark)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete the tables behind these frames, which ``save`` returned."""
        jvm = self.spark.sparkContext._jvm
        for path in [p for held, p in self._held if any(held is df for df in frames)]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        self._held = [(held, p) for held, p in self._held if not any(held is df for df in frames)]

    def drop_others(self, *kept: DataFrame) -> None:
        """Delete all tables but those behind ``kept``."""
        self.drop(*[held for held, _ in self._held if not any(held is df for df in kept)])


#: Bytes of a row group that a Parquet writer holds in memory.
ROW_GROUP = 16 << 20
#: Bytes of one Arrow batch between the JVM and Python at most.
ARROW_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on Arrow batches to ``ARROW_BYTES`` if it is higher, so that batches
    of long texts take bounded memory on both sides. It counts when a plan runs, so it stays; a
    bound that was set with a unit, such as 32m, is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if now.isdigit() and int(now) > ARROW_BYTES:
        spark.conf.set(key, ARROW_BYTES)


def release_memory() -> None:
    """Hand freed memory of a Python worker back, since idle workers stay beside the next stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trim_driver(spark: SparkSession) -> None:
    """Hand freed native memory of the driver's JVM back. What compiling plans takes there is freed, but
    stays in the C library's pools, so without this a driver grows with the number of plans it has run."""
    gateway = spark.sparkContext._gateway
    jvm = gateway.jvm
    kinds = [jvm.java.lang.Class.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    signature, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for i, kind in enumerate(kinds):
        signature[i] = kind
    values[1] = "systemTrimNativeHeap"
    try:
        values[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", signature)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JJavaError:  # another JVM or system, where this command is unknown
        pass


def map_arrow(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable], batch_bytes: int = 2 << 20) -> DataFrame:
    """Run a batch function over ``columns`` of ``df``.

    ``make`` is called once in each Python task and returns a function from a pyarrow table
    to a pyarrow RecordBatch. Large Arrow batches are handed on in slices of about
    ``batch_bytes``, so memory does not grow with the length of texts in a batch.
    """

    def run(batches: Iterator) -> Iterator:
        work = make()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            step = max(1, int(n * batch_bytes / max(1, batch.nbytes)))
            for i in range(0, n, step):
                yield work(batch.slice(i, step))
            del batch
        release_memory()

    bound_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; else the plan shuffles it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows that a key must have to count as hot; of n rows fewer than n / HOT keys are hot.
HOT = 500_000


def join_by_key(big: DataFrame, small: DataFrame, key: str, size: str, rows: int) -> DataFrame:
    """``big`` joined on ``key`` to ``small``, which has one row for each key and in ``size`` how many
    rows of ``big`` bear it (``size`` is in the result).

    A small table of at most ``rows`` rows is broadcast. Beyond, the few hot keys are broadcast and
    their rows stay where they are; only the rows of other keys are shuffled, at most HOT to a key.
    """
    if small.limit(rows + 1).count() <= rows:
        return big.join(F.broadcast(small), key)
    hot = small.where(F.col(size) > HOT)
    rest = big.join(broadcast_if_small(hot.select(key), rows), key, "left_anti")
    return big.join(broadcast_if_small(hot, rows), key).unionByName(rest.join(small.where(F.col(size) <= HOT), key))
