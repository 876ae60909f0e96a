"""Colour projections on integer columns, and chroma subsampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.planes import clip

#: Q13 luma weights of r, g, b, and the scales of b - y and r - y.
KR, KG, KB, SCALE_CB, SCALE_CR = 2449, 4808, 933, 4623, 5843


def luma(r: Column, g: Column, b: Column, depth: int = 8) -> Column:
    return clip(0, (1 << depth) - 1, F.shiftright(r * KR + g * KG + b * KB + 4096, 13))


def _chroma(c: Column, y: Column, scale: int, depth: int) -> Column:
    return F.shiftright((c - y) * scale + 4096, 13) + (1 << (depth - 1))


def to_ycc(pixels: DataFrame, depth: int = 8) -> DataFrame:
    """Adds y_, cb, cr; chroma is not clipped here, as subsampling rounds before it clips."""
    pixels = pixels.withColumn("y_", luma(F.col("r"), F.col("g"), F.col("b"), depth))
    return pixels.withColumns({"cb": _chroma(F.col("b"), F.col("y_"), SCALE_CB, depth), "cr": _chroma(F.col("r"), F.col("y_"), SCALE_CR, depth)})


def subsampled(pixels: DataFrame, rows: int = 2, depth: int = 8) -> DataFrame:
    """Chroma of 2 x rows cells: rounded by pixel, then by horizontal pair, then vertically; edges use what is there.

    One aggregation over cells with map-side combine; the pairs are picked by position, never averaged.
    """
    top = (1 << depth) - 1
    key = ["image", F.shiftright("y", rows - 1).alias("cy"), F.shiftright("x", 1).alias("cx")]
    at = lambda c, dy, dx: F.max(F.when((F.col("y") % rows == dy) & (F.col("x") % 2 == dx), F.col(c)))
    parts = {f"{c}{dy}{dx}": at(c, dy, dx) for c in ("cb", "cr") for dy in range(rows) for dx in (0, 1)}
    cells = to_ycc(pixels, depth).groupBy(*key).agg(*[v.alias(k) for k, v in parts.items()])

    def blended(c: str) -> Column:
        line = [clip(0, top, F.coalesce(F.shiftright(F.col(f"{c}{dy}0") + F.col(f"{c}{dy}1") + 1, 1), F.col(f"{c}{dy}0"))) for dy in range(rows)]
        if rows == 1:
            return line[0]
        return F.when(F.col(f"{c}10").isNull(), line[0]).otherwise(F.shiftright(line[0] + line[1] + 1, 1))

    return cells.select("image", "cy", "cx", blended("cb").alias("cb"), blended("cr").alias("cr"))


def to_gbr(pixels: DataFrame) -> DataFrame:
    """The lossless permutation: planes are g, b, r."""
    return pixels.select("image", "y", "x", F.col("g").alias("p0"), F.col("b").alias("p1"), F.col("r").alias("p2"))


def to_ycgco(pixels: DataFrame, depth: int = 8) -> DataFrame:
    half, r, g, b = 1 << (depth - 1), F.col("r"), F.col("g"), F.col("b")
    mean = F.shiftright(r + b, 2)
    return pixels.select("image", "y", "x", (F.shiftright(g, 1) + mean).alias("luma"), (F.shiftright(g, 1) - mean + half).alias("cg"), (F.shiftright(r - b, 1) + half).alias("co"))
