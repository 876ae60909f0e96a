"""Sample planes in long form: image, y, x, v.

`embeddings` is the carrier of the registered queries: a vector is a row of samples, its elements the columns.
Every plane carries an `image` key, so all operators work on many images at once and partition by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clip(low: int | Column, high: int | Column, x: Column) -> Column:
    as_column = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.least(as_column(high), F.greatest(as_column(low), x))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, e of each vector's element; only the two columns are read."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "e"))
    return rows.select("y", "x", F.col("e").cast("double").alias("e"))


def plane(rows: DataFrame, scaled: Column) -> DataFrame:
    return rows.select(F.lit(0).alias("image"), "y", "x", clip(0, 255, F.floor(scaled + 128)).cast("int").alias("v"))


def e_plane(spark: SparkSession, sf_dir: str, scale: int = 256) -> DataFrame:
    return plane(elements(spark, sf_dir), F.col("e") * scale)


def m_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast varies from 32x32 group to group."""
    gain = 1 + (F.shiftright("y", 5) * 5 + F.shiftright("x", 5) * 3) % 16
    return plane(elements(spark, sf_dir), F.col("e") * 16 * gain)


def repeat_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each band of eight rows four times: every aligned 8x8 block has three copies."""
    top = F.shiftright("y", 3) * 32 + F.col("y") % 8
    rows = e_plane(spark, sf_dir).withColumn("y", F.explode(F.array(*[top + 8 * i for i in range(4)])))
    return rows.select("image", "y", "x", "v")


def quant_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e_plane(spark, sf_dir).withColumn("v", F.shiftright("v", 5))


def rgb_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels image, y, x, r, g, b of width 21: three neighbours of the E-plane each."""
    rows = e_plane(spark, sf_dir).where("x < 63").groupBy("image", "y", F.floor(F.col("x") / 3).cast("int").alias("x_"))
    channel = lambda i: F.max(F.when(F.col("x") % 3 == i, F.col("v")))
    return rows.agg(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b")).withColumnRenamed("x_", "x")


#: The same carriers for DuckDB.
S_SQL = "s AS (SELECT CAST(vec_id AS INT) AS y, CAST(unnest(range(64)) AS INT) AS x, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings)"
E_SQL = S_SQL + ", p AS (SELECT y, x, CAST(least(255, greatest(0, floor(e * 256 + 128))) AS INT) AS v FROM s)"
M_SQL = S_SQL + ", p AS (SELECT y, x, CAST(least(255, greatest(0, floor(e * 16 * (1 + ((y >> 5) * 5 + (x >> 5) * 3) % 16) + 128))) AS INT) AS v FROM s)"
REPEAT_SQL = E_SQL.replace(", p AS", ", p0 AS") + ", p AS (SELECT (y >> 3) * 32 + y % 8 + 8 * CAST(i AS INT) AS y, x, v FROM p0, range(4) r(i))"
QUANT_SQL = E_SQL.replace(", p AS", ", p0 AS") + ", p AS (SELECT y, x, v >> 5 AS v FROM p0)"
RGB_SQL = E_SQL + ", rgb AS (SELECT a.y, a.x // 3 AS x, a.v AS r, b.v AS g, c.v AS b FROM p a JOIN p b ON a.y = b.y AND b.x = a.x + 1 JOIN p c ON a.y = c.y AND c.x = a.x + 2 WHERE a.x % 3 = 0 AND a.x < 63)"
