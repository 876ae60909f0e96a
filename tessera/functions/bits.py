"""Bit strings as columns: fields of parameter sets and slice headers, written most significant bit first.

A picture's fields are columns, so the headers of any number of pictures are one projection. Syntax is a list of
(name, bits) in the order of the standard; strings of 0 and 1 are packed to bytes at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalars import level_idc, signed_golomb, unsigned_golomb

#: Largest palette, and what the predictor may hold beyond it.
PALETTE_MOST, PREDICTOR_EXTRA = 64, 64
VPS, SPS, PPS, SLICE = 32, 33, 34, 20


def u(value: Column | int | bool, n: int) -> Column:
    """An unsigned field of n bits."""
    if isinstance(value, Column):
        return F.lpad(F.bin(value.cast("bigint")), n, "0")
    return F.lit(f"{int(value):0{n}b}")


def flag(value: Column | bool) -> Column:
    return F.when(value, "1").otherwise("0") if isinstance(value, Column) else F.lit("1" if value else "0")


def ue(value: Column | int) -> Column:
    return unsigned_golomb(value if isinstance(value, Column) else F.lit(value))


def se(value: Column | int) -> Column:
    return signed_golomb(value if isinstance(value, Column) else F.lit(value))


def when(condition: Column, *fields: Column) -> Column:
    """Fields that are there under a condition only."""
    return F.when(condition, F.concat(*fields)).otherwise("")


def stopped(*fields: Column) -> Column:
    """A payload's end: a one, then zeros up to a whole byte."""
    bits = F.concat(*fields, F.lit("1"))
    return F.concat(bits, F.repeat(F.lit("0"), F.pmod(-F.length(bits), F.lit(8))))


def packed(bits: Column) -> Column:
    """Bytes of a string of whole bytes of bits."""
    byte = lambda i: F.lpad(F.conv(F.substring(bits, 8 * i + 1, F.lit(8)), 2, 16), 2, "0")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), (F.length(bits) / 8).cast("int") - 1), byte), ""))


@dataclass(frozen=True)
class Picture:
    """What headers depend on, as columns. chroma: 0 mono, 1 4:2:0, 2 4:2:2, 3 4:4:4; primaries null: colours aren't described."""

    width: Column
    height: Column
    chroma: Column
    depth: Column
    qp: Column
    lossless: Column
    rdpcm: Column
    rice: Column
    screen: Column
    copies: Column  # whether blocks may copy from the picture itself
    wavefront: Column
    chroma_offset: Column
    primaries: Column
    transfer: Column
    matrix: Column
    full_range: Column

    @property
    def plain_chroma(self) -> Column:
        return self.chroma <= 1

    @property
    def range_tools(self) -> Column:
        """Whether the stream needs the range extensions."""
        return self.rdpcm | ~self.plain_chroma | (self.depth > 10)

    def coded(self, side: Column) -> Column:
        return F.ceil(side / 64) * 64

    @property
    def sub_w(self) -> Column:
        return F.when((self.chroma == 1) | (self.chroma == 2), 2).otherwise(1)

    @property
    def sub_h(self) -> Column:
        return F.when(self.chroma == 1, 2).otherwise(1)


def unit_header(kind: int) -> Column:
    return F.concat(u(0, 1), u(kind, 6), u(0, 6), u(1, 3))


def profile(p: Picture) -> Column:
    """Profile, its constraints and level."""
    extended = p.screen | p.range_tools
    idc = F.when(p.screen, 9).when(extended, 4).when(p.depth <= 8, 3).otherwise(2)
    compatible = F.when(p.screen, 0x00400000).when(extended, 0x08000000).when(p.depth <= 8, 0x70000000).otherwise(0x20000000)
    wide = p.rdpcm | (p.chroma == 3)
    tools = F.concat(
        flag(p.depth <= 12), flag(p.depth <= 10), flag(p.depth <= 8), flag(~wide), flag(~wide & p.plain_chroma), flag(~wide & (p.chroma == 0)),
        flag(~p.copies), flag(False), flag(True), flag(p.depth <= 14), u(0, 34),
    )
    return F.concat(u(0, 2), flag(False), u(idc, 5), u(compatible, 32), u(0b1011, 4), F.when(extended, tools).otherwise(u(0, 44)), u(level_idc(p.width, p.height), 8))


def vps(p: Picture) -> Column:
    return stopped(unit_header(VPS), u(0, 4), flag(True), flag(True), u(0, 6), u(0, 3), flag(True), u(0xFFFF, 16), profile(p), flag(False), ue(0), ue(0), ue(0), u(0, 6), ue(0), flag(False), flag(False))


def vui(p: Picture) -> Column:
    """Colours only; the range is always told."""
    described = p.primaries.isNotNull()
    colours = when(described, u(p.primaries, 8), u(p.transfer, 8), u(p.matrix, 8))
    return F.concat(flag(False), flag(False), flag(True), u(5, 3), flag(F.coalesce(p.full_range, F.lit(True))), flag(described), colours, u(0, 7))


def sps(p: Picture) -> Column:
    right, bottom = ((p.coded(side) - side) / sub for side, sub in ((p.width, p.sub_w), (p.height, p.sub_h)))
    right, bottom = F.floor(right).cast("int"), F.floor(bottom).cast("int")
    cropped = (right > 0) | (bottom > 0)
    extended = p.range_tools | p.screen
    range_extension = when(p.range_tools, flag(False), flag(False), flag(p.rdpcm), u(0, 4), flag(p.rice), flag(False))
    screen_extension = when(p.screen, flag(p.copies), flag(True), ue(PALETTE_MOST), ue(PREDICTOR_EXTRA), flag(False), u(0, 2), flag(False))
    return stopped(
        unit_header(SPS), u(0, 4), u(0, 3), flag(True), profile(p), ue(0), ue(p.chroma), when(p.chroma == 3, flag(False)),
        ue(p.coded(p.width)), ue(p.coded(p.height)), flag(cropped), when(cropped, ue(0), ue(right), ue(0), ue(bottom)),
        ue(p.depth - 8), ue(p.depth - 8), ue(4), flag(False), ue(0), ue(0), ue(0),
        *map(ue, (0, 3, 0, 3, 0, 3)),  # coding blocks from 8 to 64, transforms from 4 to 32, their depths between and within pictures
        flag(False), flag(False), flag(True), flag(False), ue(0), flag(False), flag(True), flag(True), flag(True), vui(p),
        flag(extended), when(extended, flag(p.range_tools), u(0, 2), flag(p.screen), u(0, 4), range_extension, screen_extension),
    )


def pps(p: Picture, columns: int = 1, rows: int = 1) -> Column:
    adaptive = ~p.lossless & (p.qp >= 8)
    tiled = columns > 1 or rows > 1
    tiles = [ue(columns - 1), ue(rows - 1), flag(True), flag(False)] if tiled else []
    return stopped(
        unit_header(PPS), ue(0), ue(0), flag(False), flag(False), u(0, 3), flag(~p.lossless), flag(False), ue(0), ue(0), se(p.qp - 26), flag(False), flag(False),
        flag(adaptive), when(adaptive, ue(1)), se(p.chroma_offset), se(p.chroma_offset), flag(False), flag(False), flag(False), flag(p.lossless), flag(tiled), flag(p.wavefront),
        *tiles, flag(True), flag(False), flag(False), flag(False), ue(0), flag(False), flag(p.copies), when(p.copies, u(0b0001, 4), u(0, 4), flag(True), flag(False), flag(False)),
    )


def entry_points(lengths: Column) -> Column:
    """Lengths, once escaped, of all substreams but the last: their number, the width of a field, and each less one."""
    told = F.slice(lengths, 1, F.size(lengths) - 1)
    width = F.greatest(F.lit(1), F.length(F.bin(F.array_max(told) - 1)))
    each = F.array_join(F.transform(told, lambda n: F.lpad(F.bin((n - 1).cast("bigint")), width, "0")), "")
    return F.concat(ue(F.size(told)), F.when(F.size(told) > 0, F.concat(ue(width - 1), each)).otherwise(""))


def slice_header(p: Picture, sao: Column, qp_bias: Column, lengths: Column, tiled: bool = False) -> Column:
    """The header of a picture's one slice; lengths: of its substreams, an array."""
    apart = p.wavefront | F.lit(tiled)
    return stopped(
        unit_header(SLICE), flag(True), flag(False), ue(0), ue(F.when(p.copies, 1).otherwise(2)), flag(sao), when(p.chroma > 0, flag(False)),
        when(p.copies, flag(False), ue(4)), se(qp_bias), flag(True), when(apart, entry_points(lengths)),
    )
