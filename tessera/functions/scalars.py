"""Scalar rules of the coder as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.sources.planes import clip

#: Picture sizes of the levels and their codes; quantiser scales by qp mod 6; chroma QPs from 30 to 43.
LEVELS = ((36864, 30), (122880, 60), (245760, 63), (552960, 90), (983040, 93), (2228224, 120), (8912896, 150), (35651584, 180))
QUANT = (26214, 23302, 20560, 18396, 16384, 14564)
DEQUANT = (40, 45, 51, 57, 64, 72)
CHROMA_QP = (29, 30, 31, 32, 33, 33, 34, 34, 35, 35, 36, 36, 37, 37)


def table(values, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def quality_to_qp(q: Column) -> Column:
    return F.least(F.lit(51), F.floor((100 - q) * 41 / 99) + 10).cast("int")


def level_idc(width: Column, height: Column) -> Column:
    """Of the picture padded to multiples of 64."""
    padded = (F.ceil(width / 64) * 64) * (F.ceil(height / 64) * 64)
    out = F.lit(186)
    for most, code in reversed(LEVELS):
        out = F.when(padded <= most, F.lit(code)).otherwise(out)
    return out


def chroma_qp(qp: Column, offset: Column | int = 0) -> Column:
    """The 4:2:0 chroma QP."""
    q = clip(0, 57, qp + offset)
    return F.when(q < 30, q).when(q > 43, q - 6).otherwise(table(CHROMA_QP, clip(0, 13, q - 30)))


def rd_lambda(qp: Column) -> Column:
    return F.lit(0.57) * F.pow(F.lit(2.0), (qp - 12) / 3.0)


def morton(y: Column, x: Column, bits: int = 4) -> Column:
    """Z-order: bits of y and x in turn, y's above."""
    out = F.lit(0)
    for i in range(bits):
        out = out + F.shiftleft(F.shiftright(x, i) % 2, 2 * i) + F.shiftleft(F.shiftright(y, i) % 2, 2 * i + 1)
    return out


def decode_order(y: Column, x: Column, width_ctus: Column | int, unit: int = 4, ctu: int = 64) -> Column:
    """Raster order of CTUs, Z-order of units within."""
    per, inside = (ctu // unit) ** 2, ctu // unit
    index = F.floor(y / ctu) * width_ctus + F.floor(x / ctu)
    return index * per + morton(F.floor(y / unit).cast("int") % inside, F.floor(x / unit).cast("int") % inside)


def snake(y: Column, x: Column, size: int) -> Column:
    """Place in the traverse scan: odd rows run backwards."""
    return y * size + F.when(y % 2 == 1, size - 1 - x).otherwise(x)


def quantised(c: Column, qp: int, log2n: int, depth: int = 8) -> Column:
    shift = 14 + qp // 6 + 15 - depth - log2n
    level = F.shiftright(F.abs(c).cast("bigint") * QUANT[qp % 6] + (171 << (shift - 9)), shift)
    return clip(-32768, 32767, F.signum(c).cast("bigint") * level)


def dequantised(level: Column, qp: int, log2n: int, depth: int = 8) -> Column:
    shift = depth + log2n - 5
    return clip(-32768, 32767, F.shiftright(level.cast("bigint") * (DEQUANT[qp % 6] << (qp // 6)) * 16 + (1 << (shift - 1)), shift))


def unsigned_golomb(v: Column) -> Column:
    code = F.bin(v + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(code) - 1), code)


def signed_golomb(v: Column) -> Column:
    return unsigned_golomb(F.when(v > 0, 2 * v - 1).otherwise(-2 * v))


def remaining_level_bits(v: Column, rice: Column | int) -> Column:
    """Bins of a remaining coefficient level: unary prefix to 4, then an escape whose prefix and suffix grow with it.

    With v >> rice = head over 3, head - 2 lies in a group of 2**g numbers from 2**g on; g + 3 ones, a zero and g + rice bits follow.
    """
    head = F.call_function("shiftright", v, rice if isinstance(rice, Column) else F.lit(rice))
    group = F.length(F.bin(head - 2)) - 1
    return F.when(head <= 3, head + 1 + rice).otherwise(group + 3 + 1 + group + rice)


def context_state(init: Column, qp: Column) -> tuple[Column, Column]:
    """State index and most probable bin of a context with this initial value."""
    slope, offset = F.shiftright(init, 4) * 5 - 45, F.shiftleft(init.bitwiseAND(15), 3) - 16
    p = clip(1, 126, F.shiftright(slope * clip(0, 51, qp), 4) + offset)
    return F.when(p >= 64, p - 64).otherwise(63 - p), F.when(p >= 64, 1).otherwise(0)


def chroma_qp_full(qp: Column, offset: Column | int = 0) -> Column:
    """The chroma QP of 4:2:2 and 4:4:4."""
    return F.least(clip(0, 57, qp + offset), F.lit(51))


def chroma_lambda_scale(qp: Column, chroma: Column) -> Column:
    """What the multiplier of rate is scaled by for chroma: two to a third of the QP's difference."""
    return F.pow(F.lit(2.0), (chroma - qp) / 3.0)


def _escape_step(qp: Column) -> Column:
    return F.call_function("shiftleft", table(DEQUANT, qp % 6).cast("bigint"), F.floor(qp / 6).cast("int"))


def dequantised_escape(level: Column, qp: Column, depth: int = 8) -> Column:
    """The sample of an escape level."""
    return clip(0, (1 << depth) - 1, F.shiftright(level * _escape_step(qp) + 32, 6))


def escape_level(value: Column, qp: Column, depth: int = 8) -> Column:
    """The level whose sample comes nearest, of the rounded one and those beside it; the lower one on ties."""
    start = F.round(value * 64.0 / _escape_step(qp)).cast("bigint")
    near = F.transform(F.array(start - 1, start, start + 1), lambda c: F.greatest(c, F.lit(0).cast("bigint")))
    return F.array_min(F.transform(near, lambda c: F.struct(F.abs(dequantised_escape(c, qp, depth) - value).alias("far"), c.alias("level"))))["level"]


def colour_tolerance(qp: Column, lossless: Column | bool = False) -> Column:
    """How far colours may differ and share a palette entry: half a quantiser step, 16 at most."""
    half = F.round(0.5 * _escape_step(qp) / 64.0)
    return F.when(F.lit(lossless) if isinstance(lossless, bool) else lossless, 0).otherwise(clip(0, 16, half).cast("int"))


def split_transform_context(size: Column) -> Column:
    """The context of a transform split flag, by block size."""
    return F.least(5 - (F.length(F.bin(size)) - 1), F.lit(2))


def scan_index(mode: Column, log2n: Column, luma: Column, full_chroma: Column) -> Column:
    """0 diagonal, 1 horizontal, 2 vertical: by mode in 4x4 blocks and in 8x8 ones of luma or full chroma."""
    by_mode = (log2n == 2) | ((log2n == 3) & (luma | full_chroma))
    return F.when(~by_mode, 0).when(mode.between(6, 14), 2).when(mode.between(22, 30), 1).otherwise(0)


def chroma_escape_there(chroma: Column, transposed: Column, y: Column, x: Column) -> Column:
    """Whether an escaped luma position carries chroma, by its absolute place."""
    even = lambda c: c % 2 == 0
    return F.when(chroma == 1, even(x) & even(y)).when(chroma == 2, F.when(transposed, even(y)).otherwise(even(x))).otherwise(chroma == 3)


def row_prediction(mode: Column, on: Column) -> Column:
    """0 none, 1 along rows, 2 down columns: implied by pure directions where it is on."""
    return F.when(on & (mode == 10), 1).when(on & (mode == 26), 2).otherwise(0)


def shares_chroma(parent: Column, sub_w: Column, sub_h: Column) -> Column:
    """Whether the four parts of a luma block have one chroma block, as their own would be under four samples."""
    part = F.floor(parent / 2)
    return (F.floor(part / sub_w) < 4) | (F.floor(part / sub_h) < 4)
