"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A text becomes sparse features: hashed lower-cased words (counts, scaled to unit length), bins
of structure statistics, and bins of the declared length against the real one. The score is
w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j through the logistic function; the pairwise sum is
half of (sum v x)^2 - sum v^2 x^2 for each factor, so scoring takes time linear in the
features. The model is fitted on the driver over a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, map_arrow, release_memory, table, trim_driver

#: Labelled rows that a fit uses at most, chosen by a hash of the id.
TRAIN_ROWS = 6000
#: Hash buckets for words, factors, passes over the sample, rows of a step.
BUCKETS, RANK, EPOCHS, STEP = 1 << 14, 8, 14, 128
#: Bins of each statistic, at quantiles of the sample.
BINS = 10
RATE, WORD_DECAY, DECAY = 0.08, 2e-3, 1e-5
#: Bytes of text that features are taken from at once.
SLICE_BYTES = 1 << 19
#: A row is predicted to be of quality from this score on.
THRESHOLD = 0.3

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>", "mark": b"!?", "stop": b".,;:", "line": b"\n", "markup": b"=\"'()[]{}/\\@_~^`"}
STATISTICS = ["words", "word_bytes", "distinct", "top_share", "repeat_next", "distinct_pairs", "long_words", *_CLASSES, "declared"]


def extract(data: np.ndarray, offsets: np.ndarray, declared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: rows, word buckets and values of the sparse part, and a dense row of statistics.

    ``declared`` is the length in characters that the metadata claims, NaN where it has none.
    """
    from .shingles import mix, word_hashes

    n = len(offsets) - 1
    words, begins = word_hashes(data, offsets)
    count = np.diff(begins)
    row = np.repeat(np.arange(n), count)
    per = np.maximum(count, 1)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])
    key, times = np.unique(row << 14 | (words & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
    rows, cols = key >> 14, key & (BUCKETS - 1)
    values = np.sqrt(times)
    norm = np.sqrt(np.bincount(rows, values**2, n))
    values = values / np.maximum(norm, 1e-9)[rows]
    top = np.zeros(n)
    np.maximum.at(top, rows, times)
    same = np.zeros(len(words), bool)
    pairs = np.zeros(n)
    if len(words) > 1:
        inner = row[1:] == row[:-1]
        same[1:] = (words[1:] == words[:-1]) & inner
        joint = (mix(words[1:] * np.uint64(3) + words[:-1]) & np.uint64((1 << 24) - 1)).astype(np.int64)
        pairs = np.bincount(np.unique((row[1:] << 24 | joint)[inner]) >> 24, minlength=n)
    size = np.diff(offsets)
    chars = total((data & 0xC0) != 0x80)
    blanks = np.zeros(256, bool)
    blanks[[0x20, *range(9, 14)]] = True
    in_words = total(~blanks[data])
    flags = np.zeros(256, bool)
    starts = np.zeros(len(data), bool)
    if len(data):
        starts[0] = True
        starts[1:] = blanks[data[:-1]]
    wordy = np.concatenate([[0], np.cumsum(~blanks[data], dtype=np.int64)])
    # Words of over 12 bytes: a word byte whose 12 predecessors are word bytes as well.
    long_words = np.zeros(len(data), bool)
    if len(data) > 12:
        long_words[12:] = (wordy[13:] - wordy[:-13]) == 13
        long_words[1:] &= ~long_words[:-1]
    stats = [np.log1p(count), in_words / per, np.bincount(rows, minlength=n) / per, top / per, np.bincount(row, same, n) / per, pairs / per, total(long_words) / per]
    for members in _CLASSES.values():
        flags[:] = False
        flags[list(members)] = True
        stats.append(total(flags[data]) / np.maximum(size, 1))
    claimed = np.where(np.isfinite(declared), declared, chars)
    stats.append(np.log1p(np.abs(claimed - chars)) * np.sign(claimed - chars))
    return rows, cols, values, np.stack(stats, 1)


@dataclass
class Machine:
    """A fitted model: bin edges of the statistics, bias, weights and factors."""

    edges: list[np.ndarray]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def sparse(self, rows, cols, values, stats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All features of each text, sorted by row."""
        n, d = stats.shape
        bins = np.stack([np.searchsorted(e, stats[:, k], side="right") + BUCKETS + k * (BINS + 1) for k, e in enumerate(self.edges)], 1)
        r = np.concatenate([rows, np.repeat(np.arange(n, dtype=rows.dtype), d)])
        c = np.concatenate([cols, bins.ravel().astype(cols.dtype)])
        v = np.concatenate([values, np.full(n * d, 0.5, values.dtype)])
        order = np.argsort(r, kind="stable")
        return r[order], c[order], v[order]

    def logits(self, r, c, v, n) -> np.ndarray:
        begin = np.searchsorted(r, np.arange(n))  # every text has its bins, so no run is empty
        linear = np.add.reduceat(self.weights[c] * v, begin)
        vx = self.factors[c] * v[:, None]
        sums, squares = np.add.reduceat(vx, begin, axis=0), np.add.reduceat(vx * vx, begin, axis=0)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(1)

    def score(self, rows, cols, values, stats) -> np.ndarray:
        if not len(stats):
            return np.zeros(0)
        r, c, v = self.sparse(rows, cols, values, stats)
        return 1 / (1 + np.exp(-np.clip(self.logits(r, c, v, len(stats)), -30, 30)))


def fit(rows, cols, values, stats, labels, seed: int = 7) -> Machine:
    """Fit on sparse features; with no rows or a single class the score is the class's share."""
    labels = np.asarray(labels, float)
    n = len(labels)
    edges = [np.unique(np.quantile(stats[:, k], np.arange(1, BINS) / BINS)) if n else np.zeros(0) for k in range(len(STATISTICS))]
    size = BUCKETS + len(STATISTICS) * (BINS + 1)
    rng = np.random.Generator(np.random.PCG64(seed))
    share = (labels.sum() + 1) / (n + 2)
    model = Machine(edges, float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    if n == 0 or labels.min() == labels.max():
        model.factors[:] = 0
        return model
    r, c, v = model.sparse(rows, cols, values, stats)
    begin = np.searchsorted(r, np.arange(n + 1, dtype=r.dtype))
    gw, gv, gb = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    decay = np.where(np.arange(size) < BUCKETS, WORD_DECAY, DECAY)
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for s in range(0, n, STEP):
            batch = order[s : s + STEP]
            pick = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in batch])
            local = np.repeat(np.arange(len(batch)), begin[batch + 1] - begin[batch])
            cc, vv = c[pick], v[pick].astype(float)
            starts = np.searchsorted(local, np.arange(len(batch)))
            vx = model.factors[cc] * vv[:, None]
            sums = np.add.reduceat(vx, starts, axis=0)
            z = model.bias + np.add.reduceat(model.weights[cc] * vv, starts) + 0.5 * (sums**2 - np.add.reduceat(vx * vx, starts, axis=0)).sum(1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)
            gb += error.sum() ** 2
            model.bias -= RATE * error.sum() / np.sqrt(gb)
            used, back = np.unique(cc, return_inverse=True)
            dw = np.bincount(back, error[local] * vv) + decay[used] * model.weights[used]
            each = (error[local] * vv)[:, None] * (sums[local] - vx)
            dv = np.stack([np.bincount(back, each[:, f]) for f in range(RANK)], 1) + decay[used][:, None] * model.factors[used]
            gw[used] += dw**2
            gv[used] += dv**2
            model.weights[used] -= RATE * dw / np.sqrt(gw[used])
            model.factors[used] -= RATE * dv / np.sqrt(gv[used])
    return model


def _declared(column) -> np.ndarray:
    return np.array(column.cast(pa.float64()).to_numpy(zero_copy_only=False), float)


def training_sample(docs: DataFrame, labels: DataFrame, text_col: str, chars_col: str, id_col: str, label_col: str, rows: int) -> tuple:
    """Features and labels of at most ``rows`` labelled documents, for ``fit``.

    With more labels than that, a hash of the id keeps a share that gives nine tenths of ``rows``.
    """
    labelled = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("label"))
    n = labelled.count()
    if n > rows:
        labelled = labelled.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(1 << 32)) < int((1 << 32) * 0.9 * rows / n))
    chosen = labelled.limit(rows)
    joined = docs.select(id_col, text_col, chars_col).join(F.broadcast(chosen), id_col)  # at most ``rows`` rows

    def make():
        from .shingles import text_bytes

        def work(batch):
            r, c, v, s = extract(*text_bytes(batch.column(0)), _declared(batch.column(1)))
            cut = np.searchsorted(r, np.arange(batch.num_rows + 1))
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, kind))
            dense = pa.array(s.tolist(), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), lists(c, pa.int32()), lists(v, pa.float32()), dense], names=["id", "label", "cols", "vals", "stats"])

        return work

    slim = joined.select(text_col, chars_col, F.col(id_col).cast("long").alias("id"), F.col("label").cast("int").alias("label"))
    found = map_arrow(slim, [text_col, chars_col, "id", "label"], "id long, label int, cols array<int>, vals array<float>, stats array<double>", make, batch_bytes=SLICE_BYTES)
    got = found.limit(rows).toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    flat = lambda k: np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in got.column(k).chunks] or [np.zeros(0)])
    lens = np.concatenate([pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in got.column("cols").chunks] or [np.zeros(0, np.int64)])
    stats = flat("stats").astype(float).reshape(got.num_rows, len(STATISTICS))
    # Narrow types, since the driver holds all features at once; a step of the fit widens its own.
    return np.repeat(np.arange(got.num_rows, dtype=np.int32), lens), flat("cols").astype(np.int32), flat("vals").astype(np.float32), stats, got.column("label").to_pylist()


def score_documents(docs: DataFrame, model: Machine, text_col: str = "text", chars_col: str = "n_chars", out_col: str = "score") -> DataFrame:
    """``docs`` and ``out_col`` of each row, a score from 0 to 1; only the text and its declared
    length are inputs, and only they go to Python. All other columns stay; one that is already called
    ``out_col`` is replaced.

    A null text counts as empty and has a score as well; a null declared length is taken from
    the text. Equal texts with equal declared lengths get equal scores; an empty table gives no rows.
    """

    @F.arrow_udf("double")
    def score(text: pa.Array, chars: pa.Array) -> pa.Array:
        from .shingles import text_bytes

        out, start = [], 0
        step = max(1, int(len(text) * SLICE_BYTES / max(1, text.nbytes)))
        for start in range(0, len(text), step):
            out.append(model.score(*extract(*text_bytes(text.slice(start, step)), _declared(chars.slice(start, step)))))
        release_memory()
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    bound_batches(docs.sparkSession)
    return docs.withColumn(out_col, score(F.col(text_col), F.col(chars_col).cast("long")))


def held_out(id_col: str = "doc_id"):
    """Whether a row's label must not be learnt: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    model = fit(*training_sample(docs, labels.where(~held_out()), "text", "n_chars", "doc_id", "quality", rows))
    release_memory()
    trim_driver(docs.sparkSession)
    return model


def op1_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    out = score_documents(docs.select("doc_id", "text", "n_chars"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
