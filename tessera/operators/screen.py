"""Screen content: repeated blocks by equi-join, palettes by histogram, index runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalars import dequantised_escape, escape_level
from tessera.operators.blocks import at
from tessera.operators.intra import coding_place

#: A probe looks at so many blocks of its content, the last in raster order, before any other condition.
BUCKET = 12
COLOURS = 64


def block_arrays(plane: DataFrame, size: int = 8) -> DataFrame:
    """image, by, bx, samples in raster order; flat blocks are left out."""
    place = F.col("y") % size * size + F.col("x") % size
    rows = plane.groupBy("image", at("y", size).alias("by"), at("x", size).alias("bx")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.array_sort(F.collect_list(F.struct(place.alias("k"), "v"))).alias("s"))
    return rows.where((F.col("low") < F.col("high")) & (F.size("s") == size * size)).select("image", "by", "bx", F.col("s.v").alias("samples"))


def repeated_blocks(plane: DataFrame, size: int = 8) -> DataFrame:
    """Candidates for copying: for each block the earlier blocks among the last BUCKET ones with equal content.

    The cut comes first and the test of order second, so a long bucket may offer nothing. Because the cut keeps BUCKET
    rows of a content, a content that a third of all blocks hold joins with BUCKET rows only; the cut is a
    max-BUCKET aggregate by (content, salt), then by content, so no task gets a hot content whole.
    """
    # keys are hashes of the samples, so that these aren't shuffled; the samples of what they join are compared
    blocks = block_arrays(plane, size).withColumns({"h1": F.xxhash64("samples"), "h2": F.xxhash64(F.lit(7), F.reverse("samples"))})
    key = ["image", "h1", "h2"]
    ranked = blocks.withColumn("salt", F.pmod(F.xxhash64("by", "bx"), F.lit(16)))
    for keys in ([*key, "salt"], key):
        ranked = ranked.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("by"), F.desc("bx")))).where(F.col("r") <= BUCKET)
    last = ranked.select(*key, F.col("samples").alias("copied"), F.col("by").alias("sy"), F.col("bx").alias("sx"))
    return blocks.join(last, key).where("samples = copied and (sy < by or sy = by and sx < bx)").select("image", "by", "bx", "sy", "sx", (F.col("sx") - F.col("bx")).alias("vx"), (F.col("sy") - F.col("by")).alias("vy"))


def legal(candidates: DataFrame, height: Column, width: Column, size: int = 8, ctu: int = 64) -> DataFrame:
    """Vectors whose source lies in the picture, above or left of the block, within the coded wavefront, and coded before it.

    A source in an upper row of CTUs may reach one CTU farther right for each row that it lies above.
    """
    y, x = F.col("sy") * size, F.col("sx") * size
    last_y, last_x = y + size - 1, x + size - 1
    row = lambda c: F.floor(c / ctu)
    inside = (y >= 0) & (x >= 0) & (last_y < height) & (last_x < width)
    apart = (F.col("vx") * size + size <= 0) | (F.col("vy") * size + size <= 0)
    ahead = row(last_x) - row(F.col("bx") * size) <= row(F.col("by") * size) - row(last_y)
    here = coding_place(F.col("by") * size, F.col("bx") * size)
    return candidates.where(inside & apart & ahead & (coding_place(y, x) < here) & (coding_place(last_y, last_x) < here))


def vector_predictors(field: DataFrame, blocks: DataFrame) -> DataFrame:
    """Two predictors of each block: image, by, bx, p0, p1 (structs vy, vx; zero where there is none).

    field: image, by, bx, vy, vx of blocks that copy. Of the lower left and the left one the first that copies and is coded before,
    of the upper right, upper and upper left one the first; without a left one the upper one counts for both.
    Each block asks five places, so joins carry rows of blocks, not of pairs.
    """
    places = [("a", 0, 1, -1), ("a", 1, 0, -1), ("b", 0, -1, 1), ("b", 1, -1, 0), ("b", 2, -1, -1)]
    around = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(o).alias("nth"), (F.col("by") + dy).alias("ny"), (F.col("bx") + dx).alias("nx")) for s, o, dy, dx in places])
    asked = blocks.select("image", "by", "bx", F.inline(around))
    asked = asked.where(coding_place(F.col("ny") * 8, F.col("nx") * 8) < coding_place(F.col("by") * 8, F.col("bx") * 8))
    held = field.select("image", F.col("by").alias("ny"), F.col("bx").alias("nx"), F.struct("vy", "vx").alias("v"))
    found = asked.join(held, ["image", "ny", "nx"]).groupBy("image", "by", "bx").agg(*[F.min(F.when(F.col("side") == s, F.struct("nth", "v")))["v"].alias(s) for s in "ab"])
    rows = blocks.select("image", "by", "bx").join(found, ["image", "by", "bx"], "left")
    none = F.struct(F.lit(0).alias("vy"), F.lit(0).alias("vx"))
    first = F.coalesce("a", "b")
    second = F.when(F.col("a").isNotNull() & (F.col("a") != F.col("b")), F.col("b"))
    return rows.select("image", "by", "bx", F.coalesce(first, none).alias("p0"), F.coalesce(second, none).alias("p1"))


def copy_vectors(candidates: DataFrame) -> DataFrame:
    """The shortest vector of each block in bits of its size, the latest source on ties."""
    bits = F.length(F.bin(F.abs("vx") + 1)) + F.length(F.bin(F.abs("vy") + 1))
    return candidates.groupBy("image", "by", "bx").agg(F.min(F.struct(bits.alias("bits"), (-F.col("sy")).alias("a"), (-F.col("sx")).alias("b"))).alias("m")).select("image", "by", "bx", F.col("m.bits").alias("bits"), (-F.col("m.a")).alias("sy"), (-F.col("m.b")).alias("sx"))


def histogram(plane: DataFrame, size: int = 8) -> DataFrame:
    """Colours of each block with counts and first places."""
    place = F.col("y") % size * size + F.col("x") % size
    return plane.groupBy("image", at("y", size).alias("by"), at("x", size).alias("bx"), F.col("v").alias("colour")).agg(F.count("v").alias("n"), F.min(place).alias("first"))


def palettes(plane: DataFrame, size: int = 8, most: int = COLOURS) -> DataFrame:
    """Colours by falling count, then first place: image, by, bx, idx, colour, n. Blocks with too many colours have none."""
    w = W.partitionBy("image", "by", "bx")
    rows = histogram(plane, size).withColumn("idx", F.row_number().over(w.orderBy(F.desc("n"), "first")) - 1)
    rows = rows.withColumns({"colours": F.count("colour").over(w), "pixels": F.sum("n").over(w)})
    return rows.where((F.col("colours") <= most) & (F.col("colours") * 2 <= F.col("pixels"))).select("image", "by", "bx", "idx", "colour", "n")


def nearest_entry(plane: DataFrame, palette: DataFrame, tolerance: int, size: int = 8) -> DataFrame:
    """Index of each sample's nearest palette entry, the smallest on ties; -1 (escape) beyond the tolerance.

    The palette of a block is gathered to an array of COLOURS entries at most, so samples join one row each.
    """
    entries = palette.groupBy("image", "by", "bx").agg(F.array_sort(F.collect_list(F.struct("idx", "colour"))).alias("entries"))
    rows = plane.withColumns({"by": at("y", size), "bx": at("x", size)}).join(entries, ["image", "by", "bx"])
    best = F.array_min(F.transform("entries", lambda e: F.struct(F.abs(e["colour"] - F.col("v")).alias("far"), e["idx"].alias("idx"))))
    return rows.select("image", "y", "x", best.alias("b")).select("image", "y", "x", F.when(F.col("b.far") <= tolerance, F.col("b.idx")).otherwise(-1).alias("idx"))


def index_runs(plane: DataFrame, size: int = 8) -> DataFrame:
    """Runs of equal samples along the traverse scan of each block: start, length, value."""
    row, col = F.col("y") % size, F.col("x") % size
    rows = plane.select("image", at("y", size).alias("by"), at("x", size).alias("bx"), (row * size + F.when(row % 2 == 1, size - 1 - col).otherwise(col)).alias("k"), "v")
    w = W.partitionBy("image", "by", "bx").orderBy("k")
    rows = rows.withColumn("new", F.when(F.lag("v").over(w) == F.col("v"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return rows.groupBy("image", "by", "bx", "run").agg(F.min("k").alias("start"), F.count("k").alias("length"), F.min("v").alias("value")).drop("run")


#: Entries of a palette predictor.
PREDICTOR = 128


def palette_update(current: list, old: list, most: int = PREDICTOR) -> list:
    """The next predictor: the current palette, then old entries that it didn't reuse, `most` in all."""
    held = set(current)
    return [*current, *(c for c in old if c not in held)][:most]


def palette_predictors(palette: DataFrame, row: int = 8, most: int = PREDICTOR) -> DataFrame:
    """The predictor after each block: image, by, bx, idx, colour. Each follows from the one before it.

    Blocks of a coding row, `row` blocks high, are taken CTU by CTU in raster order, from an empty predictor on; rows are
    independent, as wavefronts start them. A group is a coding row of palettes, streamed block by block.
    """
    rows = palette.groupBy("image", "by", "bx").agg(F.array_sort(F.collect_list(F.struct("idx", "colour")))["colour"].alias("cur"))
    rows = rows.withColumns({"_row": at("by", row), "_ctu": at("bx", row)}).repartition("image", "_row").sortWithinPartitions("image", "_row", "_ctu", "by", "bx")

    def run(batches):
        import pyarrow as pa

        now, old = None, []
        for batch in batches:
            out: list[tuple] = []
            for image, by, bx, cur, line in zip(*[batch.column(c).to_pylist() for c in ("image", "by", "bx", "cur", "_row")], strict=True):
                if now != (image, line):
                    now, old = (image, line), []
                old = palette_update(cur, old, most)
                out += [(image, by, bx, i, c) for i, c in enumerate(old)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int32()) for i in range(5)], names=["image", "by", "bx", "idx", "colour"])

    return rows.mapInArrow(run, "image int, by int, bx int, idx int, colour int")


def painted(blocks: DataFrame, size: int = 8, unit: int = 4) -> DataFrame:
    """The attributes of blocks on a map of units: image, uy, ux and the rest."""
    each = lambda c: F.explode(F.sequence(F.col(c) * (size // unit), (F.col(c) + 1) * (size // unit) - 1))
    return blocks.withColumn("uy", each("by")).withColumn("ux", each("bx")).drop("by", "bx")


def copied(plane: DataFrame, vectors: DataFrame, size: int = 8) -> DataFrame:
    """Samples of blocks copied by their vectors (image, by, bx, sy, sx, in blocks): image, y, x, v. A sample goes to the blocks that copy its own."""
    source = plane.withColumns({"sy": at("y", size), "sx": at("x", size)})
    rows = source.join(vectors, ["image", "sy", "sx"])
    return rows.select("image", (F.col("by") * size + F.col("y") % size).alias("y"), (F.col("bx") * size + F.col("x") % size).alias("x"), "v")


def rebuilt(plane: DataFrame, indices: DataFrame, palette: DataFrame, qp: int, size: int = 8, depth: int = 8) -> DataFrame:
    """Samples of palette blocks: an entry's colour, or of an escape the sample that its level gives."""
    rows = indices.withColumns({"by": at("y", size), "bx": at("x", size)}).join(palette.select("image", "by", "bx", "idx", "colour"), ["image", "by", "bx", "idx"], "left").join(plane, ["image", "y", "x"])
    escape = dequantised_escape(escape_level(F.col("v"), F.lit(qp), depth), F.lit(qp), depth)
    return rows.select("image", "y", "x", F.coalesce(F.col("colour").cast("bigint"), escape).alias("v"))


def mixed_runs(indices: list[int], size: int) -> list[tuple[int, int, int, int]]:
    """Runs of an index map along the traverse scan: (start, length, 1 if copied from the row above, value that is signalled).

    At each start, from the second row on and not straight after one, a run copied from above is taken if it is as long as the run of the
    index at least. The value is less one where it exceeds the one that is excluded: the index above after a copied run, else the one before.
    """
    n, out, at_, copied_before = len(indices), [], 0, False
    over = lambda k: indices[2 * (k // size) * size - 1 - k]
    while at_ < n:
        same = at_ + 1
        while same < n and indices[same] == indices[at_]:
            same += 1
        end = at_
        if at_ >= size and not copied_before:
            while end < n and indices[end] == over(end):
                end += 1
        if end > at_ and end >= same:
            out.append((at_, end - at_, 1, 0))
            at_, copied_before = end, True
            continue
        value = indices[at_]
        if at_:
            value -= value > (over(at_) if copied_before else indices[at_ - 1])
        out.append((at_, same - at_, 0, value))
        at_, copied_before = same, False
    return out


def map_runs(plane: DataFrame, size: int = 8) -> DataFrame:
    """mixed_runs of each whole block of indices: image, by, bx, start, length, above, value."""
    row, col = F.col("y") % size, F.col("x") % size
    scan = (row * size + F.when(row % 2 == 1, size - 1 - col).otherwise(col)).alias("k")
    blocks = plane.groupBy("image", at("y", size).alias("by"), at("x", size).alias("bx")).agg(F.array_sort(F.collect_list(F.struct(scan, "v")))["v"].alias("map")).where(F.size("map") == size * size)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [(i, by, bx, *r) for i, by, bx, m in zip(*[batch.column(c).to_pylist() for c in ("image", "by", "bx", "map")], strict=True) for r in mixed_runs(m, size)]
            names = ["image", "by", "bx", "start", "length", "above", "value"]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int32()) for j in range(7)], names=names)

    return blocks.mapInArrow(run, "image int, by int, bx int, start int, length int, above int, value int")


def analysed(colours: list[tuple], old: list[tuple], tolerance: int, most: int = COLOURS) -> tuple[list[tuple], list[bool]] | None:
    """A block's palette and which predictor entries it reuses; None if its colours repeat too seldom.

    Colours come by falling count, then first place; one within the tolerance of an earlier one, in its worst component, merges with it.
    Predictor entries near a colour that is still free stand in for it, first in the palette.
    """
    counts: dict[tuple, int] = {}
    for c in colours:
        counts[c] = counts.get(c, 0) + 1
    if len({c[0] for c in colours}) > min(len(colours) // 2, 128) or len(counts) > 128 or len(counts) * 2 > len(colours):
        return None
    near = lambda a, b: max(abs(x - y) for x, y in zip(a, b, strict=True)) <= tolerance
    own: list[tuple] = []
    for c in sorted(counts, key=lambda c: -counts[c]):  # stable: first places stay in order
        if len(own) < most and not any(near(o, c) for o in own):
            own.append(c)
    free, reused, palette = [*own], [False] * len(old), []
    for i, entry in enumerate(old):
        hit = next((c for c in free if near(entry, c)), None)
        if hit is not None and len(palette) < most:
            free.remove(hit)
            reused[i] = True
            palette.append(entry)
    return (palette + free)[:most], reused


def palette_blocks(pixels: DataFrame, components: list[str], qp: int, tolerance: int, size: int = 8, row: int = 8, depth: int = 8) -> DataFrame:
    """Palettes of blocks of several components with reuse of the predictor: image, by, bx, palette, n_reused, indices, escapes, sse.

    Indices run along the traverse scan, the palette's length standing for an escape. Blocks with more than a quarter of escapes,
    or too many colours, have no palette and leave the predictor as it is. As in palette_predictors, each coding row starts anew.
    """
    r, c = F.col("y") % size, F.col("x") % size
    scan = (r * size + F.when(r % 2 == 1, size - 1 - c).otherwise(c)).alias("k")
    blocks = pixels.groupBy("image", at("y", size).alias("by"), at("x", size).alias("bx")).agg(F.array_sort(F.collect_list(F.struct(scan, *components))).alias("s")).where(F.size("s") == size * size)
    blocks = blocks.select("image", "by", "bx", *[F.col(f"s.{x}").alias(x) for x in components], at("by", row).alias("_row"), at("bx", row).alias("_ctu"))
    blocks = blocks.repartition("image", "_row").sortWithinPartitions("image", "_row", "_ctu", "by", "bx")
    step, top = (40, 45, 51, 57, 64, 72)[qp % 6] << (qp // 6), (1 << depth) - 1

    def escaped(v: int) -> int:
        near = [max(0, int(v * 64 / step + 0.5) + d) for d in (-1, 0, 1)]
        return min((min(top, (lv * step + 32) >> 6) for lv in near), key=lambda x: abs(x - v))

    def run(batches):
        import pyarrow as pa

        now, old = None, []
        for batch in batches:
            out: list[tuple] = []
            for image, by, bx, line, *planes in zip(*[batch.column(x).to_pylist() for x in ("image", "by", "bx", "_row", *components)], strict=True):
                if now != (image, line):
                    now, old = (image, line), []
                colours = list(zip(*planes, strict=True))
                found = analysed(first_places(colours, size), old, tolerance)
                if found is None:
                    continue
                palette, reused = found
                far = lambda v, p=palette: min((max(abs(x - y) for x, y in zip(v, e, strict=True)), i) for i, e in enumerate(p))
                nearest = {v: far(v) for v in set(colours)}
                indices = [nearest[v][1] if nearest[v][0] <= tolerance else len(palette) for v in colours]
                escapes = sum(i == len(palette) for i in indices)
                if escapes * 4 > len(colours):
                    continue
                rec = [palette[i] if i < len(palette) else tuple(map(escaped, v)) for i, v in zip(indices, colours, strict=True)]
                sse = sum((x - y) ** 2 for a, b in zip(rec, colours, strict=True) for x, y in zip(a, b, strict=True))
                out.append((image, by, bx, [list(e) for e in palette], sum(reused), indices, escapes, sse))
                old = [*palette, *(e for e, used in zip(old, reused, strict=True) if not used)][:PREDICTOR]
            types = [pa.int32()] * 3 + [pa.list_(pa.list_(pa.int32())), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int64()]
            names = ["image", "by", "bx", "palette", "n_reused", "indices", "escapes", "sse"]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(types)], names=names)

    return blocks.mapInArrow(run, "image int, by int, bx int, palette array<array<int>>, n_reused int, indices array<int>, escapes int, sse bigint")


def first_places(colours: list[tuple], size: int) -> list[tuple]:
    """Colours of a traverse scan in raster order."""
    return [c for r in range(size) for c in (colours[r * size : (r + 1) * size][:: -1 if r % 2 else 1])]
