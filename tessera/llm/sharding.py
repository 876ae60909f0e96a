"""Reproducible shuffling into shards by a Feistel permutation, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import table, text_of

#: Rows are numbered in the order of a hash of their id; its first digits cut them into so many parts.
PARTS = 4096
ROUNDS = 6
#: Most steps of a cycle walk. With n rows the domain has under sqrt(n) + 2 numbers too many, so a walk of k steps
#: has a chance of about n ** (-k / 2); a row whose walk didn't end raises an error rather than a wrong place.
#: Up to 2000 rows there are fewer than 48 such numbers, and as a walk meets none twice it always ends.
WALK = 48


def _mixed(x: Column, key: int) -> Column:
    """A round function of 31 bits; products stay below 2**62."""
    x = F.pmod(x * F.lit(1103515245) + F.lit(key), F.lit(1 << 31))
    return F.pmod(x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(1299721 + 2 * key % 65536), F.lit(1 << 31))


def keys_of(seed: int) -> list[int]:
    return [(seed * 7919 + i * 104729 + 12345) % (1 << 30) for i in range(1, ROUNDS + 1)]


def _permuted(x: Column, a: Column, b: Column, seed: int) -> Column:
    """A permutation of 0 .. a*b-1: alternate Feistel rounds on the pair (x mod a, x div a)."""
    left, right = F.pmod(x, a), F.floor(x / a).cast("bigint")
    for i, key in enumerate(keys_of(seed)):
        if i % 2 == 0:
            left = F.pmod(left + _mixed(right, key), a)
        else:
            right = F.pmod(right + _mixed(left, key), b)
    return right * a + left


def feistel_shards(docs: DataFrame, id_col: str = "doc_id", shards: int = 8, seed: int = 1, extra: dict[str, Column] | None = None) -> DataFrame:
    """A shard and a slot for each row: doc_id, row_no, place, shard, slot, and the extra columns.

    Rows get global numbers 0 .. n-1 in the order of (md5 of the id, id, extra columns): counted in 4096 parts
    by the hash's first digits, so no task sorts all of them, and the counts (4096 rows, broadcast) give
    each part's first number. The number is permuted by Feistel rounds over a*b >= n numbers, a and b about
    sqrt(n), walking the cycle until a number below n comes; the place mod `shards` is the shard and the place
    div `shards` the slot. Shards thus differ by one row at most and slots have no gaps. A null id sorts
    as the empty string; repeated rows get different places in an order that doesn't matter. An empty table gives no rows.
    """
    extra = extra or {}
    sid = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.md5(sid).alias("_h"), *[c.alias(k) for k, c in extra.items()])
    rows = rows.withColumn("_part", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_first"), F.sum("_n").over(W.partitionBy()).alias("_rows"))
    rows = rows.withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy("_h", "doc_id", *extra)) - 1)
    rows = rows.join(F.broadcast(counts), "_part").withColumn("row_no", F.col("_first") + F.col("_at"))
    # the square root as an integer that is surely large enough
    rows = rows.withColumn("_a", F.ceil(F.sqrt(F.col("_rows").cast("double"))).cast("bigint") + 1)
    rows = rows.withColumn("_b", F.ceil(F.col("_rows") / F.col("_a")).cast("bigint"))
    # the domain is walked from a number outside of it too, so one step is always taken first
    rows = rows.withColumn("_p", _permuted(F.col("row_no"), F.col("_a"), F.col("_b"), seed))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col("_p"), lambda p, _: F.when(p < F.col("_rows"), p).otherwise(_permuted(p, F.col("_a"), F.col("_b"), seed)))
    rows = rows.withColumn("place", F.when(F.col("_p") < F.col("_rows"), F.col("_p")).otherwise(walk))
    rows = rows.withColumn("place", F.when(F.col("place") < F.col("_rows"), F.col("place")).otherwise(F.raise_error(F.lit("a cycle walk did not end; take another seed")).cast("bigint")))
    return rows.select("doc_id", "row_no", "place", F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"), *extra)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards whose counts differ by one at most: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = text_of()
    placed = feistel_shards(table(spark, sf_dir, "documents"), extra={"size": F.octet_length(text).cast("bigint") + 1, "text_crc32": F.crc32(text.cast("binary"))})
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _permuted_sql(x: str) -> str:
    """The rows of a table d that has a and b, with both halves of the permuted x as l and r."""

    def mixed(v: str, key: int) -> str:
        y = f"(({v} * 1103515245 + {key}) % 2147483648)"
        return f"(xor({y}, {y} >> 15) * {1299721 + 2 * key % 65536} % 2147483648)"

    out = f"(SELECT *, {x} % a AS l, {x} // a AS r FROM d)"
    for i, key in enumerate(keys_of(1)):
        new = f"(l + {mixed('r', key)}) % a AS l, r" if i % 2 == 0 else f"l, (r + {mixed('l', key)}) % b AS r"
        out = f"(SELECT * EXCLUDE (l, r), {new} FROM {out})"
    return out


#: CRC-32 has no function there: eight steps a byte over the text's bytes. Walks are a recursion over the rows that are still outside.
OP8_SQL = f"""
WITH RECURSIVE c AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
m AS (SELECT list(CAST(t AS BIGINT) ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i) AS t FROM range(256) r(i))),
s AS (SELECT doc_id, h, octet_length(raw) + 1 AS size, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(raw), '..'), lambda y: CAST(('0x' || y) AS BIGINT)), lambda x, v: xor(t[xor(x, v) % 256 + 1], x >> 8), 4294967295)) AS crc FROM c, m),
n AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) + 1 AS a FROM c),
o AS (SELECT doc_id, size, crc, row_number() OVER (ORDER BY h, doc_id, size, crc) - 1 AS row_no, n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM s, n),
w AS (SELECT row_no, n, a, b, r * a + l AS p FROM {_permuted_sql('row_no').replace('FROM d)', 'FROM o)')}
      UNION ALL SELECT row_no, n, a, b, r * a + l AS p FROM {_permuted_sql('p').replace('FROM d)', 'FROM (SELECT * FROM w WHERE p >= n))')})
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(p % 8 AS INT) AS shard, p // 8 AS slot, CAST(NULL AS INT) AS grown_shard FROM o JOIN w USING (row_no) WHERE p < w.n
"""
