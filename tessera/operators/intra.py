"""Intra prediction of blocks from source references: gathering, smoothing, all 35 modes, costs and mode signalling.

References and samples of a block are gathered by one shuffle; prediction runs on Arrow batches of blocks, a mode at a
time over a whole batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import morton
from tessera.operators.blocks import at

PLANAR, DC, ACROSS, DOWN = 0, 1, 10, 26
#: How far a reference moves for each line, in 32nds, of modes 2 to 34.
ANGLES = (32, 26, 21, 17, 13, 9, 5, 2, 0, -2, -5, -9, -13, -17, -21, -26, -32, -26, -21, -17, -13, -9, -5, -2, 0, 2, 5, 9, 13, 17, 21, 26, 32)
#: Modes closer to a pure direction than this are not smoothed, by block size.
SMOOTH_FROM = {8: 7, 16: 1, 32: 0}
#: Modes of 4:2:2 chroma for modes of luma.
MODE_422 = (0, 1, 2, 2, 2, 2, 3, 5, 7, 8, 10, 12, 13, 15, 17, 18, 19, 20, 21, 22, 23, 23, 24, 24, 25, 25, 26, 27, 27, 28, 28, 29, 29, 30, 31)


def smoothed(mode: int, n: int) -> bool:
    """Whether a mode predicts from smoothed references: by its distance from pure directions, planar counting as 10."""
    if mode == DC or n == 4:
        return False
    return (10 if mode == PLANAR else min(abs(mode - DOWN), abs(mode - ACROSS))) > SMOOTH_FROM[n]


def coding_place(y: Column, x: Column, unit: int = 8, ctu: int = 64) -> Column:
    """A struct that orders samples as their units are coded: CTUs in raster order, units in Z-order."""
    inside = lambda c: F.floor(F.pmod(c, F.lit(ctu)) / unit).cast("int")
    return F.struct(F.floor(y / ctu).cast("int").alias("cy"), F.floor(x / ctu).cast("int").alias("cx"), morton(inside(y), inside(x)).alias("z"))


def gathered(plane: DataFrame, n: int = 8, depth: int = 8, unit: int = 8) -> DataFrame:
    """Whole blocks with samples and references: image, by, bx, samples, refs.

    refs holds 4n + 3 samples from the lowest on the left up to the corner and on to the farthest above. Those outside the
    picture or coded later are missing and take the one before them, a leading gap the first there is; without
    any, all are neutral. A sample goes to its own block and to the six at most that it borders.
    """
    y, x = F.col("y"), F.col("x")
    own = F.array(F.struct(at("y", n).alias("by"), at("x", n).alias("bx"), F.lit(False).alias("ref"), (y % n * n + x % n).alias("k")))
    row, col = at("y", n), at("x", n)
    left = [F.struct((row - j).alias("by"), (col + 1).alias("bx"), F.lit(True).alias("ref"), (2 * n - (y % n + j * n)).alias("k")) for j in range(3)]
    over = [F.struct((row + 1).alias("by"), (col - j).alias("bx"), F.lit(True).alias("ref"), (2 * n + 2 + x % n + j * n).alias("k")) for j in range(3)]
    corner = F.array(F.struct((row + 1).alias("by"), (col + 1).alias("bx"), F.lit(True).alias("ref"), F.lit(2 * n + 1).alias("k")))
    none = F.filter(own, lambda s: F.lit(False))
    right, low = x % n == n - 1, y % n == n - 1
    sent = F.concat(own, F.when(right, F.array(*left)).otherwise(none), F.when(low, F.array(*over)).otherwise(none), F.when(right & low, corner).otherwise(none))
    rows = plane.select("image", "y", "x", "v", F.inline(sent))
    earlier = coding_place(y, x, unit) < coding_place(F.col("by") * n, F.col("bx") * n, unit)
    rows = rows.where(~F.col("ref") | (F.col("k").between(0, 4 * n + 2) & earlier))
    some = lambda ref: F.array_sort(F.collect_list(F.when(F.col("ref") == ref, F.struct("k", "v"))))
    blocks = rows.groupBy("image", "by", "bx").agg(some(False).alias("s"), some(True).alias("r")).where(F.size("s") == n * n)
    # runs from one reference that is there to the next
    after = lambda i: F.coalesce(F.get("r", i + 1)["k"], F.lit(4 * n + 3))
    held = F.flatten(F.transform("r", lambda e, i: F.array_repeat(e["v"], (after(i) - F.when(i == 0, 0).otherwise(e["k"])).cast("int"))))
    refs = F.when(F.size("r") == 0, F.array_repeat(F.lit(1 << (depth - 1)), 4 * n + 3)).otherwise(held)
    return blocks.select("image", "by", "bx", F.col("s.v").alias("samples"), refs.alias("refs"))


def smooth(refs, n: int, depth: int = 8):
    """[1 2 1]/4 along references but for the two at either end; nearly straight edges of 32 become straight lines."""
    import numpy as np

    out = refs.copy()
    out[:, 2:-2] = (refs[:, 1:-3] + 2 * refs[:, 2:-2] + refs[:, 3:-1] + 2) >> 2
    if n == 32:
        c = 2 * n + 1
        bent = lambda far, middle: np.abs(refs[:, c] + refs[:, far] - 2 * refs[:, middle]) < 1 << (depth - 5)
        straight = bent(c + 64, c + 32) & bent(c - 64, c - 32)
        k = np.arange(1, 64)
        for side in (1, -1):
            line = ((64 - k) * refs[:, c, None] + k * refs[:, c + side * 64, None] + 32) >> 6
            out[:, c + side * k] = np.where(straight[:, None], line, out[:, c + side * k])
            out[:, c + side * 64] = refs[:, c + side * 64]
        out[straight, c] = refs[straight, c]
    return out


def predict(refs, mode: int, n: int, top: int = 255, edge: bool = True):
    """Predictions (blocks, n, n) of a mode from references as they are; `edge` blends the first line of luma blocks under 32."""
    import numpy as np

    left, above, corner = refs[:, 2 * n :: -1], refs[:, 2 * n + 2 :], refs[:, 2 * n + 1]
    i, log2n = np.arange(n), n.bit_length() - 1
    edge = edge and n < 32
    if mode == PLANAR:
        across = (n - 1 - i)[None, None, :] * left[:, :n, None] + (i + 1)[None, None, :] * above[:, n, None, None]
        down = (n - 1 - i)[None, :, None] * above[:, None, :n] + (i + 1)[None, :, None] * left[:, n, None, None]
        return (across + down + n) >> (log2n + 1)
    if mode == DC:
        mean = (above[:, :n].sum(axis=1) + left[:, :n].sum(axis=1) + n) >> (log2n + 1)
        out = np.repeat(mean, n * n).reshape(-1, n, n)
        if edge:
            out[:, 0, 1:] = (above[:, 1:n] + 3 * mean[:, None] + 2) >> 2
            out[:, 1:, 0] = (left[:, 1:n] + 3 * mean[:, None] + 2) >> 2
            out[:, 0, 0] = (left[:, 0] + 2 * mean + above[:, 0] + 2) >> 2
        return out
    angle, vertical = ANGLES[mode - 2], mode >= 18
    main, side = (above, left) if vertical else (left, above)
    line = np.concatenate([np.zeros((len(refs), n), dtype=refs.dtype), corner[:, None], main[:, : 2 * n]], axis=1)  # the corner is at n
    if angle < 0:
        step = round(8192 / angle)
        for k in range(-1, n * angle >> 5, -1):
            line[:, n + k] = side[:, (k * step + 128 >> 8) - 1]
    out = np.empty((len(refs), n, n), dtype=refs.dtype)
    for j in range(n):
        whole, part = (j + 1) * angle >> 5, (j + 1) * angle & 31
        a = line[:, n + 1 + whole : n + 1 + whole + n]
        out[:, j] = a if not part else ((32 - part) * a + part * line[:, n + 2 + whole : n + 2 + whole + n] + 16) >> 5
    if angle == 0 and edge:
        out[:, :, 0] = np.clip(main[:, :1] + (side[:, :n] - corner[:, None] >> 1), 0, top)
    return out if vertical else out.transpose(0, 2, 1)


def hadamard_cost(d):
    """Sum over 4x4 parts of (sum |Hadamard| + 1) >> 1, of differences (blocks, n, n)."""
    import numpy as np

    h = np.array([[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]])
    n = d.shape[1]
    parts = d.reshape(-1, n // 4, 4, n // 4, 4).transpose(0, 1, 3, 2, 4)
    return (np.abs(h @ parts @ h.T).sum(axis=(3, 4)) + 1 >> 1).sum(axis=(1, 2))


def modes(plane: DataFrame, n: int = 8, depth: int = 8, *, luma: bool = True) -> DataFrame:
    """Every block under every mode: image, by, bx, mode, satd, and weighted, the prediction's samples summed with weights 1, 2, ..."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            b = batch.num_rows
            if not b:
                continue
            refs = batch.column("refs").flatten().to_numpy().astype(np.int64).reshape(b, 4 * n + 3)
            samples = batch.column("samples").flatten().to_numpy().astype(np.int64).reshape(b, n, n)
            soft, weight, out = smooth(refs, n, depth), np.arange(1, n * n + 1).reshape(n, n), []
            for mode in range(35):
                p = predict(soft if luma and smoothed(mode, n) else refs, mode, n, (1 << depth) - 1, luma)
                out.append((hadamard_cost(samples - p), (p * weight).sum(axis=(1, 2))))
            key = [pa.array(np.repeat(batch.column(c).to_numpy(), 35), pa.int32()) for c in ("image", "by", "bx")]
            mode = pa.array(np.tile(np.arange(35), b), pa.int32())
            yield pa.RecordBatch.from_arrays([*key, mode, *[pa.array(np.stack([o[i] for o in out], axis=1).ravel(), pa.int64()) for i in (0, 1)]], names=["image", "by", "bx", "mode", "satd", "weighted"])

    return gathered(plane, n, depth).mapInArrow(run, "image int, by int, bx int, mode int, satd bigint, weighted bigint")


def smoothed_references(plane: DataFrame, n: int, depth: int = 8) -> DataFrame:
    """The smoothed references of every block: image, by, bx, k, v."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = 4 * n + 3
        for batch in batches:
            if b := batch.num_rows:
                soft = smooth(batch.column("refs").flatten().to_numpy().astype(np.int64).reshape(b, m), n, depth)
                key = [pa.array(np.repeat(batch.column(c).to_numpy(), m), pa.int32()) for c in ("image", "by", "bx")]
                yield pa.RecordBatch.from_arrays([*key, pa.array(np.tile(np.arange(m), b), pa.int32()), pa.array(soft.ravel(), pa.int64())], names=["image", "by", "bx", "k", "v"])

    return gathered(plane, n, depth).drop("samples").mapInArrow(run, "image int, by int, bx int, k int, v bigint")


def likely_modes(left: Column, above: Column) -> Column:
    """The three most probable modes, from those of the left and upper neighbours."""
    angular = F.array(left, 2 + (left + 29) % 32, 2 + (left - 1) % 32)
    third = F.when((left != PLANAR) & (above != PLANAR), PLANAR).when((left != DC) & (above != DC), DC).otherwise(DOWN)
    return F.when(left != above, F.array(left, above, third)).when(left < 2, F.array(F.lit(PLANAR), F.lit(DC), F.lit(DOWN))).otherwise(angular)


def mode_bins(mode: Column, likely: Column) -> Column:
    """Bins that signal a luma mode."""
    place = F.array_position(likely, mode)
    return F.when(place == 1, 2).when(place > 1, 3).otherwise(6)


def signalled(costs: DataFrame, n: int, root_lambda: float) -> DataFrame:
    """Adds bins and cost = satd + root_lambda * bins; neighbours' modes are their cheapest ones before signalling.

    A neighbour that is missing counts as DC, and so does the upper one in another row of CTUs. Joins carry a row per block.
    """
    first = costs.groupBy("image", "by", "bx").agg(F.min(F.struct("satd", "mode"))["mode"].alias("own"))
    left = first.select("image", "by", (F.col("bx") + 1).alias("bx"), F.col("own").alias("left"))
    over = first.where(F.col("by") % (64 // n) != 64 // n - 1).select("image", (F.col("by") + 1).alias("by"), "bx", F.col("own").alias("over"))
    around = first.join(left, ["image", "by", "bx"], "left").join(over, ["image", "by", "bx"], "left")
    around = around.select("image", "by", "bx", likely_modes(F.coalesce("left", F.lit(DC)), F.coalesce("over", F.lit(DC))).alias("likely"))
    rows = costs.join(around, ["image", "by", "bx"]).withColumn("bins", mode_bins(F.col("mode"), F.col("likely")))
    return rows.withColumn("cost", F.col("satd") + root_lambda * F.col("bins"))


def chroma_modes(luma: Column, chroma_422: bool = False) -> Column:
    """The five chroma candidates as (mode, syntax, eval_order): the derived mode is tried first, 34 stands in for one equal to luma's."""
    mapped = lambda m: F.element_at(F.array(*map(F.lit, MODE_422)), (m + 1).cast("int")) if chroma_422 else m.cast("int")
    fixed = [F.struct(mapped(F.when(luma == m, F.lit(34)).otherwise(F.lit(m))).alias("mode"), F.lit(s).alias("syntax"), F.lit(o).alias("eval_order")) for m, s, o in ((PLANAR, 0, 1), (DC, 3, 2), (DOWN, 1, 3), (ACROSS, 2, 4))]
    return F.array(F.struct(mapped(luma).alias("mode"), F.lit(4).alias("syntax"), F.lit(0).alias("eval_order")), *fixed)
