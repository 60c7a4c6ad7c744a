"""What the driver holds: the features of a fit, and native memory that its JVM has freed."""

from __future__ import annotations

import re
import time
from pathlib import Path

import numpy as np

from featuregrid.llm import common, factorisation


def test_fit_takes_narrow_features(spark, data):
    """The driver holds at most 12 bytes for each feature, and the model is the one that wide types give."""
    docs, labels = (spark.read.parquet(f"{data}/{name}.parquet") for name in ("documents", "labels"))
    rows, cols, values, stats, marks = factorisation.training_sample(docs, labels, "text", "n_chars", "doc_id", "quality", 500)
    assert len(marks) and rows.nbytes + cols.nbytes + values.nbytes <= 12 * len(rows)
    narrow = factorisation.fit(rows, cols, values, stats, marks)
    wide = factorisation.fit(rows.astype(np.int64), cols.astype(np.int64), values.astype(float), stats, marks)
    assert narrow.bias == wide.bias and np.array_equal(narrow.weights, wide.weights) and np.array_equal(narrow.factors, wide.factors)


def test_freed_native_memory_goes_back(spark):
    """Small native blocks between others that stay are not kept by the JVM's process once they are freed."""
    jvm = spark.sparkContext._jvm
    smaps = Path(f"/proc/{spark.sparkContext._gateway.proc.pid}/smaps_rollup")
    held = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", smaps.read_text())[1]) / 1024
    stay, go = jvm.java.util.ArrayList(), jvm.java.util.ArrayList()
    for i in range(1600):
        (go if i % 8 else stay).add(jvm.java.nio.ByteBuffer.allocateDirect(1 << 16))
    del go
    for _ in range(2):
        jvm.java.lang.System.gc()
        time.sleep(0.5)
    before = held()
    common.trim_driver(spark)
    assert before - held() > 40
    assert stay.size() == 200


def test_saving_trims_the_driver(spark, work, monkeypatch):
    seen = []
    monkeypatch.setattr(common, "trim_driver", seen.append)
    assert work.save(spark.range(3)).count() == 3 and seen == [spark]
