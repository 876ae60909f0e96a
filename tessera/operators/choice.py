"""Candidate ranking: source-based mode costs, top-k with stable ties, relative gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.blocks import at, line, satd, tiled

#: Mode, evaluation order, bins of its signalling: planar, DC, vertical, horizontal.
MODES = ((0, 0, 2), (1, 1, 3), (26, 2, 3), (10, 3, 6))


def source_references(plane: DataFrame, size: int = 8) -> DataFrame:
    """References of each inner block from source samples: image, by, bx, top, left (size + 1 each, the last beyond the block).

    A sample is sent to the blocks that it borders, three at most, and gathered by block; nothing is joined.
    """
    y, x, v = F.col("y"), F.col("x"), F.col("v")
    row, col = at("y", size), at("x", size)
    below = F.struct((row + 1).alias("by"), col.alias("bx"), F.lit("t").alias("side"), (x % size).alias("k"))
    corner = F.struct((row + 1).alias("by"), (col - 1).alias("bx"), F.lit("t").alias("side"), F.lit(size).alias("k"))
    right = F.struct(row.alias("by"), (col + 1).alias("bx"), F.lit("l").alias("side"), (y % size).alias("k"))
    under = F.struct((row - 1).alias("by"), (col + 1).alias("bx"), F.lit("l").alias("side"), F.lit(size).alias("k"))
    sent = F.filter(F.array(F.when(y % size == size - 1, below), F.when((y % size == size - 1) & (x % size == 0), corner), F.when(x % size == size - 1, right), F.when((x % size == size - 1) & (y % size == 0), under)), lambda s: s.isNotNull())
    rows = plane.select("image", v.alias("v"), F.inline(sent))
    line = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("k", "v"))))["v"]
    return rows.groupBy("image", "by", "bx").agg(line("t").alias("top"), line("l").alias("left")).where((F.size("top") == size + 1) & (F.size("left") == size + 1))


def mode_costs(plane: DataFrame, size: int = 8) -> DataFrame:
    """Sum of absolute differences plus four per bin, of each block and mode: image, by, bx, mode, eval_order, cost."""
    log2n = size.bit_length() - 1
    rows = plane.withColumns({"by": at("y", size), "bx": at("x", size)}).join(source_references(plane, size), ["image", "by", "bx"])
    r, c = F.col("y") % size, F.col("x") % size
    ref = lambda a, i: F.element_at(a, (i + 1).cast("int"))
    total = lambda a: F.aggregate(F.slice(a, 1, size), F.lit(0), lambda s, e: s + e)
    n = F.lit(size)
    planar = F.shiftright((size - 1 - c) * ref("left", r) + (c + 1) * ref("top", n) + (size - 1 - r) * ref("top", c) + (r + 1) * ref("left", n) + size, log2n + 1)
    dc = F.shiftright(total("top") + total("left") + size, log2n + 1)
    predictions = dict(zip((0, 1, 26, 10), (planar, dc, ref("top", c), ref("left", r)), strict=True))
    costs = rows.groupBy("image", "by", "bx").agg(*[(F.sum(F.abs(F.col("v") - predictions[m])) + 4 * bins).alias(f"m{m}") for m, _, bins in MODES])
    each = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(o).alias("eval_order"), F.col(f"m{m}").alias("cost")) for m, o, _ in MODES])
    return costs.select("image", "by", "bx", F.inline(each))


def ranked(candidates: DataFrame, keys: list[str], most: int, ratio: tuple[int, int] = (6, 5)) -> DataFrame:
    """The `most` cheapest of each key, the first evaluated on ties; beyond two only within ratio of the best."""
    w = W.partitionBy(*keys)
    rows = candidates.withColumns({"rank": F.row_number().over(w.orderBy("cost", "eval_order")), "_best": F.min("cost").over(w)})
    return rows.where((F.col("rank") <= most) & ((F.col("rank") <= 2) | (F.col("cost") * ratio[1] <= F.col("_best") * ratio[0]))).drop("_best")


def shortlist(candidates: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The `most` cheapest modes of each key, each mode once at its least cost, lower modes first on ties."""
    once = candidates.groupBy(*keys, "mode").agg(F.min("cost").alias("cost"))
    return once.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("cost", "mode"))).where(F.col("rank") <= most)


def parting_gate(pairs: DataFrame, lam: float, depth: int = 8) -> DataFrame:
    """Of each 8x8 block whether four predictions are worth a search: image, by, bx, parted; pairs hold v and rec, the prediction.

    The Hadamard cost must exceed a floor, means of the four residuals must explain enough of them, and either these means or the
    directions of gradients must differ. Gradients don't cross quarters. One shuffle by tile serves the whole.
    """
    scale, root = 1 << max(0, depth - 8), lam**0.5
    d = F.col("v") - F.col("rec")
    quarter = [at("y", 4).alias("qy"), at("x", 4).alias("qx")]
    rows = tiled(pairs)
    gx = F.when(F.col("x") % 4 != 0, F.abs(F.col("v") - F.lag("v").over(line("y").orderBy("x"))))
    gy = F.when(F.col("y") % 4 != 0, F.abs(F.col("v") - F.lag("v").over(line("x").orderBy("y"))))
    rows = rows.select("image", "_ty", "_tx", *quarter, d.alias("d"), gx.alias("gx"), gy.alias("gy"))
    key = ["image", "_ty", "_tx", "qy", "qx"]
    total = rows.groupBy(*key).agg(F.collect_list("d").alias("all"), F.sum("d").alias("s"), F.sum(F.abs("d")).alias("abs"), F.coalesce(F.sum("gx"), F.lit(0)).alias("gx"), F.coalesce(F.sum("gy"), F.lit(0)).alias("gy"))
    mean = F.signum("s") * F.floor((F.abs("s") + 8) / 16)
    total = total.withColumns({"mean": mean.cast("bigint"), "act": F.col("gx") + F.col("gy")})
    total = total.withColumn("left", F.aggregate("all", F.lit(0).cast("bigint"), lambda a, e: a + F.abs(e - F.col("mean"))))
    busy = F.col("act") >= 12 * scale
    turn = F.when(busy, F.floor((F.col("gx") * 256 + F.floor(F.col("act") / 2)) / F.col("act")))
    b = total.groupBy("image", "_ty", "_tx", at("qy", 2).alias("by"), at("qx", 2).alias("bx")).agg(
        F.count("mean").alias("n"), F.sum("abs").alias("abs"), F.sum("left").alias("left"), F.sum("act").alias("act"), F.count_if(busy).alias("busy"), (F.max(turn) - F.min(turn)).alias("turn"), (F.max("mean") - F.min("mean")).alias("span"), F.sum(F.size("all")).alias("px")
    )
    gain = F.greatest(F.lit(0), F.col("abs") - F.col("left"))
    useful = (gain > max(int(root * 18) * scale, 8 * scale)) & (gain * 100 >= F.col("abs") * 15)
    mixed = (F.col("busy") >= 2) & (F.col("turn") >= 88) & (F.col("act") >= 64 * scale)
    cost = satd(pairs.select("image", "y", "x", d.alias("d")))
    b = b.where("px = 64").join(cost, ["image", "by", "bx"])
    parted = (F.col("satd") > 48.0 * scale + root * 8.0) & (F.col("abs") > 0) & useful & ((F.col("span") >= 5 * scale) | mixed)
    return b.select("image", "by", "bx", F.coalesce(parted, F.lit(False)).cast("int").alias("parted"))


def near_best(candidates: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """The cheapest candidate of each key, and the second one if it costs at most so many percent of it."""
    w = W.partitionBy(*keys)
    rows = candidates.withColumns({"rank": F.row_number().over(w.orderBy("cost", "eval_order")), "_best": F.min("cost").over(w)})
    return rows.where((F.col("rank") == 1) | ((F.col("rank") == 2) & (F.col("cost") * 100 <= F.col("_best") * percent))).drop("_best")
