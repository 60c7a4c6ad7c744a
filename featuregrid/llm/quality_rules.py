"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gets exact statistics of its whole text. Ratios, in thousandths, are counted
into log-linear buckets (the top eight bits of a value, so within 1/128), for each language,
source and ratio. Such a sketch merges by adding counts, in any order, and gives the same
quantiles on every run. Fences follow from the quantiles of the document's own group and nothing
else: three times the way from the median to the last tenth beyond that tenth. So a group whose
documents are alike gets near fences and a mixed one gets far ones. Up to a tenth of a group may be
junk without moving them. Groups with few documents take the merged sketch of their language, then
of all. A document is held against its fence by what it has beyond it, in characters, symbols,
lines or words: a few of these tell nothing, however short the text. The fences are joined to the
documents, salted where they are too many to broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, map_arrow, table

#: Ratios, each with the units (characters, symbols, lines, words) that a text may have beyond its fence.
ALLOWED = {"length": 30, "symbols": 5, "dup_lines": 3, "repeats": 20}
#: Fences lie so many times the way from the median to the last tenth beyond that tenth.
FENCE = 3
#: Documents a group needs for fences of its own.
GROUP = 50
#: Fences broadcast up to so many rows; beyond, they are copied to salts and shuffled.
BROADCAST_ROWS, SALTS = 20_000, 16

#: Symbols, and the width of a window for repeats.
SYMBOLS, RUN = b"#*$%&|<>", 5


def _repeat_words(hashes: np.ndarray) -> int:
    """Words in windows of five that occur twice or more."""
    n = len(hashes) - RUN + 1
    if n < 2:
        return 0
    order = np.argsort(hashes[:n], kind="stable")
    ranked = hashes[:n][order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(hashes) + 1, np.int32)
    at = np.flatnonzero(twice)
    steps[at] += 1
    np.add.at(steps, at + RUN, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def text_statistics(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and the statistics of each text; a null text counts as empty."""
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

    def make():
        import re

        import pyarrow as pa

        from .shingles import SEPARATORS, mix, text_bytes, word_hashes

        symbol = np.zeros(256, bool)
        symbol[list(SYMBOLS)] = True
        counted = np.array([(b & 0xC0) != 0x80 and b not in SEPARATORS for b in range(256)])
        has_word = re.compile(r"[^\x20\x09-\x0D]").search

        def work(batch):
            column = batch.column(len(keep))
            data, offsets = text_bytes(column)
            words, begins = word_hashes(data, offsets, fold=False)
            total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])
            chars, symbols = total(counted[data]), total(symbol[data])
            grams = words
            if len(words) >= RUN:
                grams = words.copy()
                for k in range(1, RUN):
                    grams[: len(words) - k] = mix(grams[: len(words) - k]) * np.uint64(3) + words[k:]
            repeats, lines, dups = [], [], []
            for text, a, b in zip(column.to_pylist(), begins[:-1].tolist(), begins[1:].tolist()):
                repeats.append(_repeat_words(grams[a:b]))
                own = [x for x in (text or "").split("\n") if has_word(x)]
                lines.append(len(own))
                dups.append(len(own) - len(set(own)))
            out = [np.diff(begins), chars, symbols, lines, dups, repeats]
            return pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(x, pa.int64()) for x in out], names=[*keep, *names])

        return work

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"{x} long" for x in names])
    return map_arrow(df, [*keep, text_col], schema, make, batch_bytes=1 << 19)


def _ratios() -> dict[str, Column]:
    per = lambda a, b: F.expr(f"1000 * {a} div greatest({b}, 1)")
    return {"length": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words")}


def _bucket(value: Column) -> Column:
    """The top eight bits of a whole number, the rest zero."""
    shift = F.greatest(F.length(F.bin(value)) - 8, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def _top(bucket: Column) -> Column:
    """The greatest whole number of a bucket."""
    return bucket + F.call_function("shiftleft", F.lit(1), F.greatest(F.length(F.bin(bucket)) - 8, F.lit(0))) - 1


def sketches(stats: DataFrame) -> DataFrame:
    """``lang, source, ratio, bucket, n``: the mergeable sketch of each group and ratio."""
    cells = F.array(*[F.struct(F.lit(k).alias("ratio"), _bucket(v).alias("bucket")) for k, v in _ratios().items()])
    cells = stats.where("n_words > 0").select("lang", "source", F.explode(cells).alias("c"))
    return cells.groupBy("lang", "source", "c.ratio", "c.bucket").agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The first tenth, median and last tenth of each ratio and group named by ``keys``, and its documents."""
    merged = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "ratio")
    ranked = merged.withColumn("below", F.sum("n").over(group.orderBy("bucket"))).withColumn("docs", F.sum("n").over(group))
    reach = lambda k: F.min(F.when(F.col("below") * 10 >= F.col("docs") * k, F.col("bucket")))
    return ranked.groupBy(*keys, "ratio").agg(F.max("docs").alias("docs"), reach(1).alias("q10"), reach(5).alias("q50"), reach(9).alias("q90"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source): the least and greatest value of each ratio that passes."""
    values = ("docs", "q10", "q50", "q90")
    own = _quantiles(sketch, ["lang", "source"])
    lang = _quantiles(sketch, ["lang"]).select(F.col("lang").alias("l2"), F.col("ratio").alias("r2"), F.struct(*values).alias("by_lang"))
    every = _quantiles(sketch, []).select(F.col("ratio").alias("r3"), F.struct(*values).alias("by_all"))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("ratio") == F.col("r2"))).join(every, F.col("ratio") == F.col("r3"))
    use = F.when(F.col("docs") >= GROUP, F.struct(*values)).when(F.col("by_lang.docs") >= GROUP, F.col("by_lang")).otherwise(F.col("by_all"))
    joined = joined.withColumn("use", use)
    low = F.col("use.q10") - FENCE * (F.col("use.q50") - F.col("use.q10"))
    high = _top(F.col("use.q90")) + FENCE * (F.col("use.q90") - F.col("use.q50"))
    limits = joined.select("lang", "source", "ratio", F.struct(low.alias("low"), high.alias("high")).alias("f"))
    return limits.groupBy("lang", "source").agg(*[F.max(F.when(F.col("ratio") == k, F.col("f.low"))).alias(f"{k}_low") for k in ALLOWED], *[F.max(F.when(F.col("ratio") == k, F.col("f.high"))).alias(f"{k}_high") for k in ALLOWED])


def quality_rules(df: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Statistics, ``base_failed``, the failed ratios and ``kept`` of each row of ``df``.

    A null or empty text has no words and fails the base rules. Null languages and sources
    form groups of their own. Equal rows get equal verdicts, each counts in the sketches; an empty
    table gives no rows; other columns are not read and may have any names.
    """
    slim = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    stats = work.save(text_statistics(slim, ["id", "lang", "source"]))
    limits = work.save(fences(sketches(stats)))
    if limits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        stats, limits, salts = stats.withColumn("salt", F.lit(0)), F.broadcast(limits.withColumn("salt2", F.lit(0))), 1
    else:
        stats = stats.withColumn("salt", F.pmod(F.xxhash64("id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
        limits = limits.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    limits = limits.withColumnsRenamed({"lang": "lang2", "source": "source2"})
    joined = stats.join(limits, F.col("lang").eqNullSafe(F.col("lang2")) & F.col("source").eqNullSafe(F.col("source2")) & (F.col("salt") == F.col("salt2")), "left")
    ratio = _ratios()
    unit = {k: F.expr(f"1000 * {n} div greatest({'n_lines' if k == 'dup_lines' else 'n_words'}, 1)") for k, n in ALLOWED.items()}
    bad = [F.when((ratio[k] > F.col(f"{k}_high") + unit[k]) | (F.lit(k == "length") & (ratio[k] < F.col(f"{k}_low") - unit[k])), F.lit(k)) for k in ALLOWED]
    base = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    failed = F.array_compact(F.array(*bad))
    out = joined.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), failed.alias("failed_ratios"))
    out = work.save(out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_ratios") == 0)))
    work.drop_others(out)
    return out


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents"), Workspace(spark, "quality")).drop("failed_ratios")


OP8_SQL = rf"""
with docs as (
  select row_number() over () as row, doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), grams as (
  select row, s, hash(w[s:s + 4]) as h from (select row, w, unnest(range(1, len(w) - 3)) as s from docs where len(w) >= 5)
), repeats as (
  select row, count(distinct p) as n from (select row, unnest(range(s, s + 5)) as p from grams join (select row, h from grams group by all having count(*) > 1) using (row, h)) group by row
), lines as (
  select row, count(*) as n, count(*) - count(distinct x) as dup from (select row, unnest(string_split(text, chr(10))) as x from docs) where regexp_matches(x, '[^\x20\x09-\x0D]') group by row
), stats as (
  select row, doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
         cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, cast(coalesce(l.n, 0) as bigint) as n_lines,
         cast(coalesce(dup, 0) as bigint) as n_dup_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words
  from docs left join repeats r using (row) left join lines l using (row)
), ratios as (
  select row, unnest([
    {{'ratio': 'length', 'v': 1000 * word_chars // greatest(n_words, 1), 'unit': 1000 * {ALLOWED["length"]} // greatest(n_words, 1)}}, {{'ratio': 'symbols', 'v': 1000 * n_symbols // greatest(n_words, 1), 'unit': 1000 * {ALLOWED["symbols"]} // greatest(n_words, 1)}},
    {{'ratio': 'dup_lines', 'v': 1000 * n_dup_lines // greatest(n_lines, 1), 'unit': 1000 * {ALLOWED["dup_lines"]} // greatest(n_lines, 1)}}, {{'ratio': 'repeats', 'v': 1000 * n_repeat_words // greatest(n_words, 1), 'unit': 1000 * {ALLOWED["repeats"]} // greatest(n_words, 1)}}], recursive := true)
  from stats where n_words > 0
), buckets as (
  select lang, source, ratio, (v >> greatest(length(bin(v)) - 8, 0)) << greatest(length(bin(v)) - 8, 0) as b from ratios join stats using (row)
), own as (select lang, source, ratio, len(l) as docs, l[(len(l) + 9) // 10] as q10, l[(5 * len(l) + 9) // 10] as q50, l[(9 * len(l) + 9) // 10] as q90 from (select lang, source, ratio, list_sort(list(b)) as l from buckets group by all)
), langs as (select lang, ratio, len(l) as docs, l[(len(l) + 9) // 10] as q10, l[(5 * len(l) + 9) // 10] as q50, l[(9 * len(l) + 9) // 10] as q90 from (select lang, ratio, list_sort(list(b)) as l from buckets group by all)
), every as (select ratio, l[(len(l) + 9) // 10] as q10, l[(5 * len(l) + 9) // 10] as q50, l[(9 * len(l) + 9) // 10] as q90 from (select ratio, list_sort(list(b)) as l from buckets group by all)
), used as (
  select o.lang, o.source, o.ratio, case when o.docs >= {GROUP} then struct_pack(a := o.q10, m := o.q50, z := o.q90) when l.docs >= {GROUP} then struct_pack(a := l.q10, m := l.q50, z := l.q90) else struct_pack(a := e.q10, m := e.q50, z := e.q90) end as q
  from own o join langs l on o.lang is not distinct from l.lang and o.ratio = l.ratio join every e on o.ratio = e.ratio
), failed as (
  select distinct r.row from ratios r join stats s using (row) join used u on s.lang is not distinct from u.lang and s.source is not distinct from u.source and r.ratio = u.ratio
  where v > q.z + (1 << greatest(length(bin(q.z)) - 8, 0)) - 1 + {FENCE} * (q.z - q.m) + unit or r.ratio = 'length' and v < q.a - {FENCE} * (q.m - q.a) - unit
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and f.row is null as kept
from stats left join failed f using (row)
"""
