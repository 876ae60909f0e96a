"""Block statistics, padding, grid cells, adaptive quantisation and split scores.

Statistics aggregate samples by (image, block) with map-side combine: the shuffle carries one row per block and
task, not samples. Stencils shuffle samples once by tile, with a halo of what they reach beyond it, and all
their directions reuse that partitioning, so no task depends on a picture's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.planes import clip


def at(c: str, n: int) -> Column:
    """The block index of a coordinate."""
    return F.floor(F.col(c) / n).cast("int")


def tiled(plane: DataFrame, size: int = 64, up: int = 0, down: int = 0, left: int = 0, right: int = 0, y: str = "y", x: str = "x") -> DataFrame:
    """Samples dealt to tiles (_ty, _tx), with those that a tile's own reach above, below and beside it; _own tells them apart.

    One shuffle; windows over the tile and a line in it need no other. A few samples in a hundred go to two or
    more tiles. Lines of a tile have no gaps, so an offset in rows of a window is one in places.
    """
    tiles = lambda c, back, ahead: F.explode(F.sequence(F.floor((F.col(c) - back) / size).cast("int"), F.floor((F.col(c) + ahead) / size).cast("int")))
    rows = plane.withColumn("_ty", tiles(y, down, up)).withColumn("_tx", tiles(x, right, left))
    rows = rows.withColumn("_own", (F.col("_ty") == at(y, size)) & (F.col("_tx") == at(x, size)))
    return rows.repartition("image", "_ty", "_tx")


def line(*keys) -> W:
    """A window over a tile's lines with these keys."""
    return W.partitionBy("image", "_ty", "_tx", *keys)


def block_stats(plane: DataFrame, size: int = 8) -> DataFrame:
    v = F.col("v")
    return plane.groupBy("image", at("y", size).alias("by"), at("x", size).alias("bx")).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.count_distinct(v).alias("colours"), F.min(v).alias("low"), F.max(v).alias("high")
    )


def as_8_bit(plane: DataFrame, depth: int) -> DataFrame:
    """Samples of a deeper plane without the bits beyond eight, on which all activity is measured."""
    return plane.withColumn("v", F.shiftright("v", depth - 8)) if depth > 8 else plane


def log_variances(plane: DataFrame, depth: int = 8) -> DataFrame:
    """ln(1 + variance) of 8x8 blocks, edge blocks by their own count."""
    v = F.col("v")
    b = as_8_bit(plane, depth).groupBy("image", at("y", 8).alias("by"), at("x", 8).alias("bx")).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    mean = F.col("s") / F.col("n")
    return b.select("image", "by", "bx", F.log1p(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("lv"))


def activity(plane: DataFrame, depth: int = 8, octile: int = 4) -> DataFrame:
    """Of each CTU: low (the octile blend of log variances), mean (luma) and energy (of middle frequencies).

    Energy is the root of the mean Laplacian of the samples times that of the means of 2x2 cells, both over the
    interior of the CTU; a side of fewer than three has none.
    """
    plane = as_8_bit(plane, depth)
    full = laplacian(plane).select("image", "cy", "cx", (F.col("energy") / F.greatest("n", F.lit(1))).alias("full"))
    half = plane.groupBy("image", at("y", 2).alias("y"), at("x", 2).alias("x")).agg(F.avg("v").alias("v"))
    half = laplacian(half, 32).select("image", "cy", "cx", (F.col("energy") / F.greatest("n", F.lit(1))).alias("half"))
    mean = plane.groupBy("image", at("y", 64).alias("cy"), at("x", 64).alias("cx")).agg(F.avg("v").alias("mean"))
    low = _blend(log_variances(plane), octile).select("image", "cy", "cx", F.col("blend").alias("low"))
    key = ["image", "cy", "cx"]
    return low.join(mean, key).join(full, key).join(half, key).select(*key, "low", "mean", F.sqrt(F.col("full") * F.col("half")).alias("energy"))


def aq_enabled(qp: int, lossless: bool = False) -> bool:
    """Whether offsets are used at all."""
    return not lossless and qp >= 8


def aq_offsets(plane: DataFrame, qp: int = 38, most: int = 3, *, depth: int = 8, octile: int = 4, strength: float = 1.0, boost_only: bool = False, lossless: bool = False, outside: int = 0) -> DataFrame:
    """QP offset of each 32x32 group: image, ctu, quad, off; no rows where adaptive quantisation is off.

    Masking is centred on its rounded mean, then each CTU is protected by its flat or dark boost, whichever is larger;
    with boost_only nothing is masked. Groups outside the picture stay in the spine, as the mean counts them; masking
    leaves them at `outside`. Windows are over groups of one image: about one row for 1024 samples.
    """
    groups = log_variances(plane, depth).groupBy("image", at("by", 4).alias("gy"), at("bx", 4).alias("gx")).agg(F.avg("lv").alias("lv"))
    size = groups.groupBy("image").agg((F.floor(F.max("gy") / 2) + 1).cast("int").alias("h"), (F.floor(F.max("gx") / 2) + 1).cast("int").alias("w"))
    spine = size.select("image", "w", F.explode(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)).alias("ctu")).withColumn("quad", F.explode(F.array(*map(F.lit, range(4)))))
    spine = spine.withColumns({"gy": F.floor(F.col("ctu") / F.col("w")).cast("int") * 2 + at("quad", 2), "gx": F.col("ctu") % F.col("w") * 2 + F.col("quad") % 2})
    rows = spine.join(groups, ["image", "gy", "gx"], "left").withColumns({"cy": at("gy", 2), "cx": at("gx", 2)})
    whole, off = W.partitionBy("image"), lambda x: clip(-most, most, x)
    masked = off(F.round((F.col("lv") - F.avg("lv").over(whole)) * 1.25))
    first = F.lit(0.0) if boost_only else F.when(F.col("lv").isNull(), float(outside)).otherwise(masked)  # off() of a null is no null
    rows = rows.withColumn("o", first)
    rows = rows.withColumn("o", F.col("o") if boost_only else off(F.col("o") - F.round(F.avg("o").over(whole))))
    shield = activity(plane, depth, octile).select("image", "cy", "cx", F.round(F.greatest(flat_boost(F.col("low"), qp, strength), dark_boost(F.col("mean"), F.col("energy"), qp, strength))).alias("shield"))
    rows = rows.join(shield, ["image", "cy", "cx"]).select("image", "ctu", "quad", off(F.col("o") - F.col("shield")).cast("int").alias("off"))
    return rows if aq_enabled(qp, lossless) else rows.limit(0)


def _blend(lv: DataFrame, octile: int) -> DataFrame:
    ctus = lv.groupBy("image", at("by", 8).alias("cy"), at("bx", 8).alias("cx")).agg(F.array_sort(F.collect_list("lv")).alias("l"))
    n = F.size("l")
    rank = lambda k: F.element_at("l", F.greatest(F.lit(1), F.ceil(n * k / 8)).cast("int"))
    return ctus.select("image", "cy", "cx", n.alias("n"), ((rank(max(octile - 1, 1)) + 2 * rank(octile) + rank(min(octile + 1, 8))) / 4).alias("blend"))


def octile_blend(plane: DataFrame, octile: int = 4) -> DataFrame:
    """Of each CTU: the 1-2-1 blend of log variances at ranks around an octile."""
    return _blend(log_variances(plane), octile).withColumn("blend", F.round("blend", 6))


def laplacian(plane: DataFrame, size: int = 64) -> DataFrame:
    """Sum and count of |4c - l - r - t - b| over CTU-interior samples."""
    rows = tiled(plane, size)
    along, down = line("y").orderBy("x"), line("x").orderBy("y")
    around = F.lag("v").over(along) + F.lead("v").over(along) + F.lag("v").over(down) + F.lead("v").over(down)
    rows = rows.withColumn("e", F.abs(4 * F.col("v") - around))
    return rows.groupBy("image", "_ty", "_tx").agg(F.count("e").alias("n"), F.coalesce(F.sum("e"), F.lit(0)).alias("energy")).withColumnsRenamed({"_ty": "cy", "_tx": "cx"})


#: Fixed values of the boosts: ln(257) and ln(65), at which they end; the mean luma under which, over 16, a CTU is dark; its exponent and most weight.
FLAT_END, DARK_END, DARK_MEAN, DARK_POWER, DARK_MOST = 5.549076, 4.1743875, 72, 1.2, 4.0
FLAT_SHARE, DARK_SHARE = 0.575, 0.75


def _from_qp_32(qp: int) -> float:
    """No boost up to QP 32, all of it from 39 on."""
    return min(1.0, max(0.0, (qp - 32) / 7))


def flat_boost(lv: Column, qp: int, strength: float = 1.0) -> Column:
    """Steps of QP that a CTU of such a blended log variance is spared."""
    return clip(F.lit(0.0), F.lit(1.0), (FLAT_END - lv) / FLAT_END) * _from_qp_32(qp) * strength * FLAT_SHARE


def dark_boost(mean: Column, energy: Column, qp: int, strength: float = 1.0) -> Column:
    """Steps of QP that a dark CTU with structure of middle frequency is spared."""
    weight = clip(F.lit(1.0), F.lit(DARK_MOST), F.pow(DARK_MEAN / (16 + mean), DARK_POWER))
    return clip(F.lit(0.0), F.lit(1.0), F.log1p(energy * (weight - 1)) / DARK_END) * _from_qp_32(qp) * strength * DARK_SHARE


def chroma_qp_offset(plane: DataFrame) -> DataFrame:
    """-round(4 * clip01((mean log variance - 1.2) / 1.4)) of the CTUs' means, one row per image."""
    ctus = log_variances(plane).groupBy("image", at("by", 8).alias("cy"), at("bx", 8).alias("cx")).agg(F.avg("lv").alias("lv"))
    scale = clip(F.lit(0.0), F.lit(1.0), (F.avg("lv") - 1.2) / 1.4)
    return ctus.groupBy("image").agg((-F.round(4 * scale)).cast("int").alias("off"))


def split_score(plane: DataFrame, size: int = 32, qp: int = 30, lam: float = 36.48) -> DataFrame:
    """How much splitting a whole block would gain, from one pass of sums (blocks beyond the picture are left out)."""
    half, px = size // 2, size * size
    rows = tiled(plane, size).withColumnsRenamed({"_ty": "cy", "_tx": "cx"})
    along, down = (W.partitionBy("image", "cy", "cx", c).orderBy(o) for c, o in (("y", "x"), ("x", "y")))
    dx, dy = F.col("v") - F.lag("v").over(along), F.col("v") - F.lag("v").over(down)
    rows = rows.withColumns({"dx": dx, "dy": dy, "q": at("y", half) % 2 * 2 + at("x", half) % 2})
    v, q = F.col("v"), F.col("q")
    mid = F.coalesce(F.sum(F.when(F.col("x") % size == half, F.col("dx") * F.col("dx"))), F.lit(0)) + F.coalesce(F.sum(F.when(F.col("y") % size == half, F.col("dy") * F.col("dy"))), F.lit(0))
    quarters = [f(F.when(q == i, x)).alias(f"{n}{i}") for i in range(4) for n, f, x in (("s", F.sum, v), ("t", F.sum, v * v))]
    b = rows.groupBy("image", "cy", "cx").agg(
        F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("t"), (F.max(v) - F.min(v)).alias("range"), mid.alias("mid"),
        (F.sum(F.abs("dx")) + F.sum(F.abs("dy"))).alias("grad"), (F.abs(F.sum("dx")) + F.abs(F.sum("dy"))).alias("net"), *quarters,
    ).where(F.col("n") == px)
    var = lambda s, t, n: F.greatest(F.lit(0.0), F.col(t) / n - (F.col(s) / n) * (F.col(s) / n))
    b = b.withColumns({"var": var("s", "t", px), "within": sum((var(f"s{i}", f"t{i}", px // 4) for i in range(4)), F.lit(0.0)) / 4})
    coherence = F.when(F.col("grad") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("net") / F.col("grad")))
    gain = F.greatest(F.lit(0.0), F.col("var") - F.col("within")) * px * F.pow(1 - coherence, 2) + F.col("mid") * (0.35 if size == 32 else 0.5)
    score = gain / max(lam * (52 if size == 32 else 76), 1.0)
    texture, slope = (48 + qp * 2.0, 6 + qp * 0.1) if size == 32 else (96 + qp * 2.8, 9 + qp * 0.12)
    rough = (F.col("within") >= texture) & (F.col("grad") / (2 * size * (size - 1)) >= slope) & (coherence < 0.55)
    flat = (F.col("range") <= 2 + qp // 18) & (F.col("var") <= 1.5 + qp * 0.12)
    return b.select("image", "cy", "cx", F.round(F.when(flat, 0.0).when(rough, F.greatest(F.lit(1.25), score)).otherwise(score), 6).alias("score"))


def padded(plane: DataFrame, to: int = 64) -> DataFrame:
    """Replicates the last row and column up to multiples of `to`: an explode of edge samples only, no join with a spine."""
    size = plane.groupBy("image").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))  # a row per image
    rows = plane.join(size, "image")  # Spark broadcasts it where it is small
    up = lambda n: (F.ceil(n / to) * to).cast("int")
    grown = lambda c, n: F.explode(F.when(F.col(c) == F.col(n) - 1, F.sequence(F.col(c), up(F.col(n)) - 1)).otherwise(F.array(c)))
    return rows.withColumn("py", grown("y", "h")).withColumn("px", grown("x", "w")).select("image", F.col("py").alias("y"), F.col("px").alias("x"), "v")


def grid_cells(plane: DataFrame, cell: int = 512) -> DataFrame:
    """The key of a sample's cell and its place inside; cells are independent pictures."""
    return plane.select("image", at("y", cell).alias("row"), at("x", cell).alias("col"), (F.col("y") % cell).alias("y"), (F.col("x") % cell).alias("x"), "v")


def cut(plane: DataFrame, cell: int = 512) -> DataFrame:
    """Whole cells of a plane, edge cells filled by their last row and column: image, row, col, y, x, v; cells are independent pictures."""
    return grid_cells(padded(plane, cell), cell)


def tile_of(plane: DataFrame, columns: int, rows: int, width_ctus: Column, height_ctus: Column, ctu: int = 64) -> DataFrame:
    """The uniform coding tile of each sample and its place inside: image, row, col, y, x, v. Tile i starts at CTU i * n div tiles."""

    def part(c: str, n: Column, tiles: int) -> tuple[Column, Column]:
        at_ctu = F.floor(F.col(c) / ctu)
        starts = [F.floor(n * i / tiles) for i in range(tiles)]
        index, first = F.lit(0), F.lit(0)
        for i in range(1, tiles):
            index, first = F.when(at_ctu >= starts[i], i).otherwise(index), F.when(at_ctu >= starts[i], starts[i]).otherwise(first)
        return index, F.col(c) - first * ctu

    (row, y), (col, x) = part("y", height_ctus, rows), part("x", width_ctus, columns)
    return plane.select("image", row.cast("int").alias("row"), col.cast("int").alias("col"), y.cast("int").alias("y"), x.cast("int").alias("x"), "v")


def reassembled(cells: DataFrame, sizes: DataFrame, cell: int = 512) -> DataFrame:
    """The plane of its cells, without what filled them; sizes: image, h, w."""
    rows = cells.select("image", (F.col("row") * cell + F.col("y")).alias("y"), (F.col("col") * cell + F.col("x")).alias("x"), "v")
    return rows.join(sizes, "image").where("y < h and x < w").select("image", "y", "x", "v")


def planes_sse(pairs: DataFrame, size: int = 64, sub_w: int = 2, sub_h: int = 2) -> DataFrame:
    """Squared error of luma and chroma together in each region: pairs hold image, plane, y, x, d."""
    in_luma = lambda c, sub: F.floor(F.col(c) * F.when(F.col("plane") == "y", 1).otherwise(sub) / size).cast("int")
    return pairs.groupBy("image", in_luma("y", sub_h).alias("by"), in_luma("x", sub_w).alias("bx")).agg(F.sum(F.col("d") * F.col("d")).alias("sse"))


def cell_bias(offsets: DataFrame, ctus_wide: int, cell_ctus: int) -> DataFrame:
    """Lift a cell's rounded mean offset into its QP (12 at most), clamp the rest to 3."""
    rows = offsets.withColumns({"row": F.floor(F.floor(F.col("ctu") / ctus_wide) / cell_ctus).cast("int"), "col": F.floor(F.col("ctu") % ctus_wide / cell_ctus).cast("int")})
    bias = clip(-12, 12, F.round(F.avg("off").over(W.partitionBy("image", "row", "col"))).cast("int"))
    return rows.withColumn("bias", bias).select("image", "ctu", "quad", "row", "col", "bias", clip(-3, 3, F.col("off") - F.col("bias")).alias("off"))


def satd(pairs: DataFrame, size: int = 8) -> DataFrame:
    """Sum over 4x4 parts of (sum |Hadamard(a - b)| + 1) >> 1; pairs hold image, y, x, d. One aggregation of 16 signed sums."""
    y, x = F.col("y") % 4, F.col("x") % 4
    odd = lambda a, m: F.bit_count(a.bitwiseAND(m))
    sums = [F.sum(F.when((odd(y, i) + odd(x, j)) % 2 == 1, -F.col("d")).otherwise(F.col("d"))).alias(f"h{i}{j}") for i in range(4) for j in range(4)]
    parts = pairs.groupBy("image", at("y", 4).alias("ty"), at("x", 4).alias("tx")).agg(F.count("d").alias("n"), *sums).where("n = 16")
    cost = F.shiftright(sum((F.abs(F.col(f"h{i}{j}")) for i in range(4) for j in range(4)), F.lit(0)) + 1, 1)
    return parts.withColumn("cost", cost).groupBy("image", at("ty", size // 4).alias("by"), at("tx", size // 4).alias("bx")).agg(F.sum("cost").alias("satd"))


def sse(pairs: DataFrame, size: int = 8) -> DataFrame:
    return pairs.groupBy("image", at("y", size).alias("by"), at("x", size).alias("bx")).agg(F.sum(F.col("d") * F.col("d")).alias("sse"))


def above(plane: DataFrame, rows: int = 4, name: str = "rec") -> DataFrame:
    """Adds the sample so many rows above, in place of a prediction; samples without one go."""
    dealt = tiled(plane, up=rows).withColumn(name, F.lag("v", rows).over(line("x").orderBy("y")))
    return dealt.where(F.col("_own") & F.col(name).isNotNull()).drop("_ty", "_tx", "_own")


def against_above(plane: DataFrame, rows: int = 4) -> DataFrame:
    """Differences from the sample so many rows above."""
    return above(plane, rows).select("image", "y", "x", (F.col("v") - F.col("rec")).alias("d"))
