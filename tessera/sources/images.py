"""Interleaved images to planes: image_id, width, height, samples ARRAY<INT> in; rows that fail validation are told apart.

The layouts are every entry point of the coder: gray or RGB, with alpha dropped or kept, at 8, 10 or 12 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    channels: tuple[str, ...]
    depth: int = 8
    keep_alpha: bool = False


LAYOUTS = {
    f"{'rgb' if len(c) > 2 else 'gray'}{'a' if 'a' in c else ''}{depth}{'_with_alpha' if keep else ''}": Layout(tuple(c), depth, keep)
    for depth in (8, 10, 12)
    for c, keep in (("rgb", False), ("rgba", False), ("rgba", True), ("v", False), ("va", False), ("va", True))
}
MOST = 16384


def problem(layout: Layout) -> Column:
    """What is wrong with an image, null if nothing: a null, its dimensions, its buffer's length, a sample out of range."""
    w, h, s = F.col("width").cast("bigint"), F.col("height").cast("bigint"), F.col("samples")
    return (
        F.when(w.isNull() | h.isNull() | s.isNull(), "missing")
        .when((w < 1) | (h < 1) | (w > MOST) | (h > MOST), "dimensions")
        .when(F.size(s) != w * h * len(layout.channels), "length")
        .when(F.coalesce(F.exists(s, lambda v: v.isNull() | (v < 0) | (v >= 1 << layout.depth)), F.lit(False)), "range")
    )


def invalid(images: DataFrame, layout: Layout) -> DataFrame:
    return images.select("image_id", problem(layout).alias("error")).where("error is not null")


def pixels(images: DataFrame, layout: Layout) -> DataFrame:
    """image_id, y, x and a column per channel of the valid images; a dropped alpha is never unpacked."""
    n, kept = len(layout.channels), [c for c in layout.channels if c != "a" or layout.keep_alpha]
    rows = images.where(problem(layout).isNull())
    picked = F.transform(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1), lambda i: F.struct(*[F.get(F.col("samples"), i * n + layout.channels.index(c)).alias(c) for c in kept]))
    rows = rows.select("image_id", "width", F.posexplode(picked).alias("k", "p"))
    return rows.select("image_id", F.floor(F.col("k") / F.col("width")).cast("int").alias("y"), (F.col("k") % F.col("width")).alias("x"), *[F.col(f"p.{c}").alias(c) for c in kept])


def planar_problem(sub_w: int, sub_h: int, alpha: bool = False) -> Column:
    """The first plane that is too short, 'missing' for a null or 'dimensions'; longer planes pass. A mono picture (sub_w 0) has no chroma."""
    w, h = F.col("width").cast("bigint"), F.col("height").cast("bigint")
    short = lambda c, n: F.when(F.size(c) < n, c)
    chroma = [F.when(F.size(c) > 0, c) if not sub_w else short(c, F.ceil(w / sub_w) * F.ceil(h / sub_h)) for c in ("cb", "cr")]
    any_null = w.isNull() | h.isNull() | F.col("y").isNull() | F.col("cb").isNull() | F.col("cr").isNull() | (F.col("alpha").isNull() if alpha else F.lit(False))
    size = F.when((w < 1) | (h < 1) | (w > MOST) | (h > MOST), "dimensions")
    return F.when(any_null, "missing").otherwise(F.coalesce(size, short("y", w * h), *chroma, *([F.when(F.size("alpha") != w * h, "alpha")] if alpha else [])))


def invalid_planes(pictures: DataFrame, sub_w: int, sub_h: int, alpha: bool = False) -> DataFrame:
    return pictures.select("image_id", planar_problem(sub_w, sub_h, alpha).alias("error")).where("error is not null")


def planar(pictures: DataFrame, sub_w: int, sub_h: int, alpha: bool = False) -> DataFrame:
    """image_id, plane, y, x, v of the valid planar pictures: luma, chroma at its own size, and alpha of luma's size."""
    w, h = F.col("width"), F.col("height")
    cw, ch = (F.ceil(w / sub_w).cast("int"), F.ceil(h / sub_h).cast("int")) if sub_w else (F.lit(0), F.lit(0))
    part = lambda c, pw, ph: F.struct(F.lit(c).alias("plane"), pw.cast("int").alias("w"), F.slice(c, F.lit(1), (pw * ph).cast("int")).alias("v"))
    parts = [part("y", w, h), part("cb", cw, ch), part("cr", cw, ch), *([part("alpha", w, h)] if alpha else [])]
    rows = pictures.where(planar_problem(sub_w, sub_h, alpha).isNull()).select("image_id", F.inline(F.array(*parts)))
    rows = rows.select("image_id", "plane", "w", F.posexplode("v").alias("k", "v"))
    return rows.select("image_id", "plane", F.floor(F.col("k") / F.col("w")).cast("int").alias("y"), (F.col("k") % F.col("w")).alias("x"), "v")


def mono(rows: DataFrame) -> DataFrame:
    """A plane alone (image_id, width, height, samples) as a planar picture without chroma."""
    none = F.array().cast("array<int>")
    return rows.select("image_id", "width", "height", F.col("samples").alias("y"), none.alias("cb"), none.alias("cr"))


#: Cells of a grid, and the side beyond which a picture becomes one.
CELL = 512


def plans(sizes: DataFrame) -> DataFrame:
    """Adds to w, h, sw, sh (luma columns and rows of a chroma sample): grid, columns, rows, and the coded size.

    A side over CELL makes a grid of cells coded on their own, else a picture is one; sides round up to whole chroma samples.
    """
    grid = (F.col("w") > CELL) | (F.col("h") > CELL)
    cells = lambda c: F.when(grid, F.ceil(F.col(c) / CELL)).otherwise(1).cast("int")
    coded = lambda c, s: (F.ceil(F.col(c) / F.col(s)) * F.col(s)).cast("int")
    return sizes.withColumns({"grid": grid.cast("int"), "columns": cells("w"), "rows": cells("h"), "coded_width": coded("w", "sw"), "coded_height": coded("h", "sh")})
