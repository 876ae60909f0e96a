"""Exact duplicates by progressive refinement, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, bit_slots, bitmap_of, in_bitmap, materialize, table, text_of, tidy

#: Copies of one text are pre-aggregated in so many parts, so no task gets a whole hot group.
SALTS = 64


@tidy
def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix: int = 128, bits: int = 22, digest: bool = False) -> DataFrame:
    """Group equal texts; one row per input row: doc_id, keep_id, group_size, kept.

    Texts are equal when identical without ASCII white space; null counts as empty. Refinement: a first scan
    writes each row's length and the hash of its first `prefix` characters. Lengths are counted, then pairs of length and
    prefix hash among rows whose length is shared; rows alone at either level are done and are never
    shuffled. Shared values are passed on as bitmaps of 2**bits bits (512 KB at the default, whatever the
    input, so they can be broadcast). Only for the rest whole contents are hashed, in a second scan, and
    grouped by digest. A bit set by chance costs one more hash and never changes a result.

    Of equal texts the longest original stays, then the smallest doc_id (null is smallest); of rows that repeat both,
    one. No text is shuffled. With digest=True every row also gets `sha256`, the binary SHA-256 of its
    normalised text; as all texts are hashed for it, the first scan does that and there is no second one.
    """
    norm = F.translate(text_of(text_col), SPACES, "")
    base = docs.select(F.col(id_col).alias("doc_id"), norm.alias("_norm"), F.char_length(text_of(text_col)).alias("_chars"))
    base = base.withColumns({"_len": F.octet_length("_norm"), "_head": F.xxhash64(F.substring("_norm", 1, prefix))})
    sha = F.unhex(F.sha2(F.col("_norm").cast("binary"), 256))
    rows = materialize(base.select("doc_id", "_chars", "_len", "_head", F.monotonically_increasing_id().alias("_row"), *([sha.alias("sha256")] if digest else [])))

    levels = []
    for keys in (["_len"], ["_len", "_head"]):
        slot = bit_slots(F.xxhash64(*keys), bits)
        counted = _marked(rows, levels).where("_in").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        levels.append((slot, materialize(bitmap_of(counted.select(slot.alias("_slot")), "_slot"))))
    if digest:
        rows = _marked(rows, levels).withColumn("_key", F.when(F.col("_in"), F.col("sha256")))
    else:
        again = base.withColumn("_row", F.monotonically_increasing_id())
        rows = materialize(_marked(again, levels).select("doc_id", "_chars", "_row", "_in", F.when(F.col("_in"), sha).alias("_key")))

    done = rows.where("not _in").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), *(["sha256"] if digest else []))
    rank = F.struct((-F.col("_chars")).alias("chars"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    some = rows.where("_in").select("doc_id", rank.alias("_rank"), "_key", F.pmod("_row", F.lit(SALTS)).alias("_salt"))
    parts = some.groupBy("_key", "_salt").agg(F.min("_rank").alias("_best"), F.count(F.lit(1)).alias("_n"))
    groups = parts.groupBy("_key").agg(F.min("_best").alias("_keep"), F.sum("_n").alias("group_size"))
    found = parts.select("_key", "_salt").join(groups, "_key")
    some = some.join(found, ["_key", "_salt"]).select("doc_id", F.col("_keep.id").alias("keep_id"), "group_size", (F.col("_rank.row") == F.col("_keep.row")).alias("kept"), *([F.col("_key").alias("sha256")] if digest else []))
    return done.unionByName(some)


def _marked(rows: DataFrame, levels: list) -> DataFrame:
    """Adds _in: whether the row's values are shared at all these levels, by their bitmaps."""
    rows = rows.withColumn("_in", F.lit(True))
    for slot, bitmap in levels:
        rows = rows.withColumn("_slot", slot).withColumn("_bucket", F.bitmap_bucket_number("_slot")).join(F.broadcast(bitmap), "_bucket", "left")
        rows = rows.withColumn("_in", F.col("_in") & in_bitmap("_slot")).drop("_slot", "_bucket", "_bitmap")
    return rows


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents: doc_id, keep_id, group_size, kept, text_sha256."""
    found = exact_dedup(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


OP1_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
