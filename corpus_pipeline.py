"""Corpus pipeline: quality, near copies, benchmark passages, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. The
filtering stages keep whole rows; all stages but the last return the columns of their input, whose
names may be any beside those of ``documents``. An empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featuregrid.llm import byte_bpe, decontamination, factorisation, minhash_dedup, pii
from featuregrid.llm.common import Workspace, broadcast_if_small, table, unused

#: Ids of removed documents are broadcast up to so many rows, and shuffled beyond.
BROADCAST_ROWS = 500_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = factorisation.fit_quality(docs, table(spark, sf_dir, "labels"))
    name = unused(docs, "score")
    return factorisation.score_documents(docs, model, out_col=name).where(F.col(name) >= factorisation.THRESHOLD).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the least
    id. Documents without words or without an id are in no group. Repeated rows count as copies. Width and
    similarity are those that stages on word shingles take unless a contract says otherwise; documents
    that differ more, such as copies with a word in ten changed, are no copies by it."""
    work = Workspace(spark, "near-dedup")
    verdicts = minhash_dedup.near_duplicates(docs, Workspace(spark, "minhash"))
    ids = verdicts.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.sum(F.col("kept").cast("long")).alias("n"))
    ids = work.save(ids.where("not kept or n > 1"))
    gone = broadcast_if_small(ids.where("not kept").select("doc_id"), BROADCAST_ROWS)
    out = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if ids.where("n > 1").isEmpty():
        return out
    named = out.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return named.unionByName(out.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without more than a few words of benchmark passages."""
    key = lambda: F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    found = decontamination.contamination(docs.select(key().alias("doc"), "text"), table(spark, sf_dir, "benchmark"), Workspace(spark, "decontamination"), id_col="doc")
    names = unused(docs, "bad_id"), unused(docs, "bad_hash")
    bad = found.where(decontamination.is_contaminated()).select("doc.doc_id", "doc.text_hash").distinct()
    bad = Workspace(spark, "contaminated").save(bad.toDF(*names))
    same = F.col("doc_id").eqNullSafe(F.col(names[0])) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(names[1]))
    return docs.join(broadcast_if_small(bad, BROADCAST_ROWS), same, "left_anti")


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    name = unused(docs, "pii")
    found = pii.find_pii(docs, out_col=name)
    changed = F.size(name) > 0
    out = pii.redact(found, spans_col=name)
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of ids and decoded bytes."""
    out = byte_bpe.encode_documents(docs, byte_bpe.default_ranks(), byte_bpe.default_pattern())
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("pii", remove_pii),
    ("byte-level bpe", encode),
]

#: The stages use a trained model and exact set similarity, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread by the next, after
    which the table before it goes."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir))
        work.drop_others(docs)
    return docs
