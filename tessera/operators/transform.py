"""Integer transforms as two aggregations of signed sums, coefficient by coefficient."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalars import QUANT, quantised
from tessera.operators.blocks import at
from tessera.sources.planes import clip

#: 64 * sqrt(2) * cos(m * pi / 64), rounded by the standard, for m = 1..31; and the 4-point sine basis.
COSINES = (90, 90, 90, 89, 88, 87, 85, 83, 82, 80, 78, 75, 73, 70, 67, 64, 61, 57, 54, 50, 46, 43, 38, 36, 31, 25, 22, 18, 13, 9, 4)
SINES = ((29, 55, 74, 84), (74, 74, 0, -74), (84, -29, -74, 55), (55, -84, 74, -29))


def cosine(n: int) -> list[list[int]]:
    """The n-point basis: row k holds the k-th frequency, from the angle (2 * column + 1) * k * 32 / n modulo a turn of 128."""

    def value(m: int) -> int:
        m %= 128
        m = 128 - m if m > 64 else m
        sign, m = (-1, 64 - m) if m > 32 else (1, m)
        return sign * (COSINES[m - 1] if 0 < m < 32 else 0)

    return [[64 if k == 0 else value((2 * c + 1) * k * (32 // n)) for c in range(n)] for k in range(n)]


def basis(kind: str, n: int) -> list[list[int]]:
    return [list(r) for r in SINES] if kind == "dst" else cosine(n)


def _weighted(rows: DataFrame, keys: list[str], place: str, value: str, matrix: list[list[int]]) -> DataFrame:
    """For each key the sums over places of matrix[k][place] * value, as rows k, total."""
    sums = [F.sum(F.element_at(F.array(*map(F.lit, line)), (F.col(place) + 1).cast("int")) * F.col(value)).alias(f"k{k}") for k, line in enumerate(matrix)]
    out = rows.groupBy(*keys).agg(F.count(value).alias("n"), *sums).where(F.col("n") == len(matrix[0]))  # whole lines only
    return out.select(*keys, F.posexplode(F.array(*[f"k{k}" for k in range(len(matrix))])).alias("k", "total"))


def forward(residual: DataFrame, n: int = 4, kind: str = "dct", depth: int = 8) -> DataFrame:
    """Coefficients image, by, bx, row, col, c of whole n x n blocks of image, y, x, d."""
    log2n = n.bit_length() - 1
    rows = residual.select("image", at("y", n).alias("by"), at("x", n).alias("bx"), (F.col("y") % n).alias("r"), (F.col("x") % n).alias("q"), "d")
    rows = rows.repartition("image", "by", "bx")  # both passes aggregate within a block's task
    t = basis(kind, n)
    shift = log2n + depth - 9
    first = F.shiftright(F.col("total") + (1 << (shift - 1)), shift) if shift > 0 else F.col("total")
    lines = _weighted(rows, ["image", "by", "bx", "r"], "q", "d", t).select("image", "by", "bx", "r", F.col("k").alias("col"), first.alias("t"))
    out = _weighted(lines, ["image", "by", "bx", "col"], "r", "t", t)
    shift = log2n + 6
    return out.select("image", "by", "bx", F.col("k").alias("row"), "col", F.shiftright(F.col("total") + (1 << (shift - 1)), shift).alias("c"))


def inverse(coefficients: DataFrame, n: int = 4, kind: str = "dct", depth: int = 8) -> DataFrame:
    """Residuals image, by, bx, r, q, d from coefficients image, by, bx, row, col, c."""
    t = [list(r) for r in zip(*basis(kind, n), strict=True)]
    lines = _weighted(coefficients.repartition("image", "by", "bx"), ["image", "by", "bx", "col"], "row", "c", t).select("image", "by", "bx", "col", F.col("k").alias("r"), clip(-32768, 32767, F.shiftright(F.col("total") + 64, 7)).alias("t"))
    out = _weighted(lines, ["image", "by", "bx", "r"], "col", "t", t)
    return out.select("image", "by", "bx", "r", F.col("k").alias("q"), F.shiftright(F.col("total") + (1 << (19 - depth)), 20 - depth).alias("d"))


def diagonal_order(n: int) -> list[tuple[int, int]]:
    """(row, col) of the up-right diagonal scan: each diagonal from its lowest row upwards."""
    return sorted(((r, c) for r in range(n) for c in range(n)), key=lambda p: (p[0] + p[1], -p[0]))


def scan(n: int, index: int = 0) -> list[tuple[int, int]]:
    """(row, col) in the order of coefficients: 4x4 groups, and places within them, both diagonal (0), by rows (1) or by columns (2)."""
    order = {0: diagonal_order, 1: lambda m: [(r, c) for r in range(m) for c in range(m)], 2: lambda m: [(r, c) for c in range(m) for r in range(m)]}[index]
    return [(4 * a + r, 4 * b + c) for a, b in order(n // 4) for r, c in order(4)]


def hidden_signs(levels: DataFrame) -> DataFrame:
    """Of each 4x4 block: places of the first and last level, whether a sign hides there (last - first >= 4), and the sum's parity."""
    places = {p: i for i, p in enumerate(diagonal_order(4))}
    place = F.element_at(F.array(*[F.lit(places[r, c]) for r in range(4) for c in range(4)]), F.col("row") * 4 + F.col("col") + 1)
    some = levels.where("level <> 0").groupBy("image", "by", "bx").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.pmod(F.sum(F.abs("level")), F.lit(2)).alias("parity"))
    return some.withColumn("hidden", (F.col("last") - F.col("first") >= 4).cast("int"))


def with_hidden_signs(coefficients: DataFrame, n: int, qp: int, depth: int = 8) -> DataFrame:
    """Levels in which the parity of a group's sum tells its first sign: image, by, bx, row, col, level.

    A group of 16 hides a sign if its first and last level are four places apart or more, in blocks whose magnitudes sum up to
    two at least. Where parity is wrong, the change by one that costs least in rounding repairs it: of all places,
    up to the last level in the block's last group; the later place wins ties. A first level of one is not removed, and before it only
    a level of the hidden sign may come. Windows share one shuffle by block.
    """
    log2n = n.bit_length() - 1
    bits = 14 + qp // 6 + 15 - depth - log2n
    places = {p: i for i, p in enumerate(scan(n))}
    place = F.element_at(F.array(*[F.lit(places[r, c]) for r in range(n) for c in range(n)]), F.col("row") * n + F.col("col") + 1)
    rows = coefficients.repartition("image", "by", "bx").withColumns({"level": quantised(F.col("c"), qp, log2n, depth), "_k": place})
    rows = rows.withColumns({"_g": at("_k", 16), "_i": F.col("_k") % 16})
    block, group = W.partitionBy("image", "by", "bx"), W.partitionBy("image", "by", "bx", "_g")
    there, level, i = F.col("level") != 0, F.col("level"), F.col("_i")
    rows = rows.withColumns({
        "_total": F.sum(F.abs(level)).over(block), "_last_g": F.max(F.when(there, F.col("_g"))).over(block),
        "_first": F.min(F.when(there, i)).over(group), "_last": F.max(F.when(there, i)).over(group),
        "_sum": F.sum(level).over(group), "_sign": F.min(F.when(there, F.struct(i.alias("i"), (level < 0).alias("s")))).over(group)["s"].cast("int"),
    })
    scaled = F.abs(F.col("c")).cast("bigint") * QUANT[qp % 6]
    whole = F.shiftright(scaled + (171 << (bits - 9)), bits)
    delta = F.shiftright(scaled - F.shiftleft(whole, bits), bits - 8)
    up = F.struct((-delta).alias("cost"), (-i).alias("later"), F.lit(1).alias("change"))
    down = F.struct(delta.alias("cost"), (-i).alias("later"), F.lit(-1).alias("change"))
    lone, own = (i == F.col("_first")) & (F.abs(level) == 1), (F.col("c") < 0).cast("int") == F.col("_sign")
    choice = F.when(there, F.when(delta > 0, up).when(~lone, down)).when((i >= F.col("_first")) | own, up)
    wrong = (F.col("_total") >= 2) & (F.col("_last") - F.col("_first") >= 4) & (F.pmod(F.col("_sum"), F.lit(2)) != F.col("_sign"))
    reach = F.when(F.col("_g") == F.col("_last_g"), F.col("_last")).otherwise(15)
    rows = rows.withColumn("_try", F.when(wrong & (i <= reach), choice)).withColumn("_best", F.min("_try").over(group))
    change = F.when(F.abs(level) >= 32767, -1).otherwise(F.col("_best.change"))
    moved = F.when(F.col("_best.later") == -i, level + F.when(F.col("c") >= 0, change).otherwise(-change)).otherwise(level)
    return rows.select("image", "by", "bx", "row", "col", F.when(F.col("_best").isNotNull(), moved).otherwise(level).alias("level"))
