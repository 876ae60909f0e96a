"""A training corpus from `documents`: toxic ones go, near copies go, benchmark leaks go, sources are mixed, ids are written.

Each stage works on all rows that its predecessor kept and takes decisions for rows by doc_id; rows that share
a doc_id share the decision of near_dedup, where one of them stays, and a null doc_id is kept there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WORDS, discard, fresh, materialize, small_batches, table
from tessera.llm.decontaminate import without_leaks
from tessera.llm.mixing import mix_rows
from tessera.llm.near_dedup import near_dedup
from tessera.llm.token_files import token_files
from tessera.llm.toxicity import fit, without_toxic


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field trained on `labels` scores under one half stay."""
    return without_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, similarity 0.8) stays, the smallest doc_id."""
    key, found = fresh(docs, "_gone_id"), near_dedup(docs)
    same = F.col("doc_id") == F.col(key)
    # compressed files of ids say nothing of their size, so they are merged, not broadcast by it
    stay = docs.join(found.where(~F.col("kept")).select(F.col("doc_id").alias(key)).hint("merge"), same, "left_anti")
    twice = found.where("kept and n_shingles > 0").groupBy(F.col("doc_id").alias(key)).count().where("count > 1").select(key)
    if twice.isEmpty():
        return stay
    # rows that share a kept id are copies of one another but for empty texts; one of them stays
    words = F.coalesce(F.col("text").rlike(WORDS), F.lit(False))
    shared = stay.join(twice, same, "left_semi")
    return stay.join(twice, same, "left_anti").unionByName(shared.where(words).dropDuplicates(["doc_id"])).unionByName(shared.where(~words))


def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an item of `benchmark` go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to weights 5, 2, 1; a document that is taken twice is there twice."""
    return mix_rows(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids are written to wavelet-matrix shards and read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files(docs)


STAGES = [
    ("toxicity", toxic_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", leaks_stage),
    ("mixing", mixing_stage),
    ("token_files", tokens_stage),
]
#: Neither a trained model nor a tokenizer can be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


@small_batches
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each stage's rows are written as Parquet and read by the next."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        if last:
            discard(spark, last)
        last = docs._written
    return docs
