"""HEIF files: items, their properties and references, laid out by one writer for single pictures, grids and alpha.

A file's parts are described first (items with properties and payloads), then framed; offsets follow from the
sizes of what stands before, so nothing is patched afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

VPS, SPS, PPS = 32, 33, 34
ALPHA_URN = b"urn:mpeg:hevc:2015:auxid:1\0"


def u(value: int, size: int) -> bytes:
    return value.to_bytes(size, "big")


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return u(len(body) + 8, 4) + kind + body


def full_box(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, u(version, 1) + u(flags, 3), *parts)


def escaped(data: bytes) -> bytes:
    """A 3 goes in after two zeros when the next byte is 3 or less."""
    out, zeros = bytearray(), 0
    for b in data:
        if zeros >= 2 and b <= 3:
            out.append(3)
            zeros = 0
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


def escaped_lengths(parts: list[bytes]) -> list[int]:
    """Lengths of consecutive parts once escaped, with the count of zeros carried from part to part."""
    out, zeros = [], 0
    for part in parts:
        n = len(part)
        for b in part:
            if zeros >= 2 and b <= 3:
                n += 1
                zeros = 0
            zeros = zeros + 1 if b == 0 else 0
        out.append(n)
    return out


def slices(nals: list[tuple[int, bytes]]) -> bytes:
    """A picture's payload: units but parameter sets, two header bytes as they are, each with a 4-byte length."""
    return b"".join(u(len(e), 4) + e for t, d in nals if t not in (VPS, SPS, PPS) for e in [d[:2] + escaped(d[2:])])


def decoder_record(nals: list[tuple[int, bytes]], depth: int, chroma: int, profile: int, level: int) -> bytes:
    """The hvcC payload with the parameter sets of the first picture."""
    head = bytes([1, profile & 31]) + u(1 << (31 - profile), 4) + bytes(6) + bytes([level]) + u(0xF000, 2) + bytes([0xFC, 0xFC | chroma, 0xF8 | (depth - 8), 0xF8 | (depth - 8), 0, 0, 0x0F, 3])
    sets = [[d[:2] + escaped(d[2:]) for t, d in nals if t == kind] for kind in (VPS, SPS, PPS)]
    arrays = (bytes([0x80 | kind]) + u(len(s), 2) + b"".join(u(len(d), 2) + d for d in s) for kind, s in zip((VPS, SPS, PPS), sets, strict=True))
    return head + b"".join(arrays)


@dataclass
class Item:
    number: int
    kind: bytes
    properties: list[tuple[bytes, bool]]  # boxes, and whether they are essential
    payload: bytes
    hidden: bool = False
    inline: bool = False  # in the metadata instead of the media data
    refs: list[tuple[bytes, list[int]]] = field(default_factory=list)


def colour_box(cicp_payload: bytes | None, icc: bytes | None) -> list[bytes]:
    """The code points first, an ICC profile second; unspecified code points without either."""
    boxes = [box(b"colr", cicp_payload)] if cicp_payload else []
    boxes += [box(b"colr", b"prof", icc)] if icc else []
    return boxes or [box(b"colr", b"nclx" + u(2, 2) * 3 + b"\0")]


def ispe(width: int, height: int) -> bytes:
    return full_box(b"ispe", 0, 0, u(width, 4), u(height, 4))


def pixi(channels: int, depth: int) -> bytes:
    return full_box(b"pixi", 0, 0, bytes([channels] + [depth] * channels))


def file_of(items: list[Item], primary: int, extended: bool, exif: bytes | None = None) -> bytes:
    """The whole file. iloc has version 1 where an item is inline, version 0 otherwise."""
    if exif:
        items = [*items, Item(max(i.number for i in items) + 1, b"Exif", [], u(0, 4) + exif, refs=[(b"cdsc", [primary])])]
    shared: list[bytes] = []
    links = []
    for i in items:
        places = []
        for p, essential in i.properties:
            if p not in shared:
                shared.append(p)
            places.append((shared.index(p) + 1) | (essential << 7))
        if places:
            links.append(u(i.number, 2) + bytes([len(places), *places]))
    brand = b"heix" if extended else b"heic"
    ftyp = box(b"ftyp", brand, u(0, 4), b"mif1", brand)
    hdlr = full_box(b"hdlr", 0, 0, u(0, 4), b"pict", bytes(12), b"\0")
    pitm = full_box(b"pitm", 0, 0, u(primary, 2))
    infos = b"".join(full_box(b"infe", 2, int(i.hidden), u(i.number, 2), u(0, 2), i.kind, b"\0") for i in items)
    iinf = full_box(b"iinf", 0, 0, u(len(items), 2), infos)
    refs = b"".join(box(kind, u(i.number, 2), u(len(to), 2), *(u(t, 2) for t in to)) for i in items for kind, to in i.refs)
    iref = full_box(b"iref", 0, 0, refs) if refs else b""
    iprp = box(b"iprp", box(b"ipco", *shared), full_box(b"ipma", 0, 0, u(len(links), 4), *links))
    inline = b"".join(i.payload for i in items if i.inline)
    idat = box(b"idat", inline) if inline else b""
    version = 1 if inline else 0

    def iloc(start: int) -> bytes:
        rows, media, meta = [], start, 0
        for i in items:
            at = meta if i.inline else media
            rows.append(u(i.number, 2) + (u(int(i.inline), 2) if version else b"") + u(0, 2) + u(1, 2) + u(at, 4) + u(len(i.payload), 4))
            meta, media = (meta + len(i.payload), media) if i.inline else (meta, media + len(i.payload))
        return full_box(b"iloc", version, 0, b"\x44\0", u(len(items), 2), *rows)

    def meta(start: int) -> bytes:
        return full_box(b"meta", 0, 0, hdlr, pitm, iloc(start), iinf, iref, iprp, idat)

    start = len(ftyp) + len(meta(0)) + 8  # offsets have a fixed width, so the size is known before they are
    return ftyp + meta(start) + box(b"mdat", *(i.payload for i in items if not i.inline))


@dataclass(frozen=True)
class Shape:
    """What a picture's cells have in common."""

    width: int
    height: int
    depth: int = 8
    chroma: int = 1
    profile: int = 3
    level: int = 60
    cell: int = 512


def picture_items(cells: list[list[tuple[int, bytes]]], shape: Shape, first: int, colours: list[bytes], alpha: bool = False) -> list[Item]:
    """One item for one cell, or a grid item followed by hidden cells in row-major order."""
    record = box(b"hvcC", decoder_record(cells[0], shape.depth, 0 if alpha else shape.chroma, shape.profile, shape.level))
    extra = [(full_box(b"auxC", 0, 0, ALPHA_URN), True)] if alpha else []
    about = [(c, False) for c in ([] if alpha else colours)]
    size, channels = (ispe(shape.width, shape.height), False), (pixi(1 if alpha else 3, shape.depth), False)
    if len(cells) == 1:
        return [Item(first, b"hvc1", [(record, True), *about, size, channels, *extra], slices(cells[0]))]
    columns, rows = -(-shape.width // shape.cell), -(-shape.height // shape.cell)
    if columns * rows != len(cells):
        raise ValueError("a grid needs all its cells")
    numbers = list(range(first + 1, first + 1 + len(cells)))
    grid = bytes([0, 1, rows - 1, columns - 1]) + u(shape.width, 4) + u(shape.height, 4)
    parts = [Item(n, b"hvc1", [(record, True), (ispe(shape.cell, shape.cell), False)], slices(c), hidden=True) for n, c in zip(numbers, cells, strict=True)]
    return [Item(first, b"grid", [size, *about, channels, *extra], grid, inline=True, refs=[(b"dimg", numbers)]), *parts]


def heif(colour: list[list[tuple[int, bytes]]], shape: Shape, *, alpha: list[list[tuple[int, bytes]]] | None = None, cicp_payload: bytes | None = None, icc: bytes | None = None, exif: bytes | None = None) -> bytes:
    items = picture_items(colour, shape, 1, colour_box(cicp_payload, icc))
    if alpha:
        more = picture_items(alpha, shape, len(items) + 1, [], alpha=True)
        more[0].refs.append((b"auxl", [1]))
        items += more
    return file_of(items, 1, shape.profile == 4, exif)


def containers(nals: DataFrame, shapes: DataFrame) -> DataFrame:
    """Files of images: nals hold image_id, role ('colour' or 'alpha'), cell, seq, nal_type, data; shapes a row per image.

    shapes may also hold cicp (code points as boxes have them), icc and exif, each binary or null. One group is one
    image's coded bytes, which a file holds in any case.
    """
    rows = nals.join(shapes, "image_id")
    more = [c for c in ("cicp", "icc", "exif") if c in shapes.columns]

    def build(key, group):
        import pandas as pd

        r = group.iloc[0]
        parts = {role: [[(int(t), bytes(b)) for t, b in zip(c.nal_type, c.data, strict=True)] for _, c in g.sort_values(["cell", "seq"]).groupby("cell")] for role, g in group.groupby("role")}
        shape = Shape(*(int(r[c]) for c in ("width", "height", "depth", "chroma", "profile", "level", "cell_size")))
        about = {"cicp_payload" if c == "cicp" else c: bytes(r[c]) if r[c] is not None else None for c in more}
        return pd.DataFrame({"image_id": [key[0]], "content": [heif(parts["colour"], shape, alpha=parts.get("alpha"), **about)]})

    return rows.groupBy("image_id").applyInPandas(build, "image_id bigint, content binary")


def substreams(parts: DataFrame) -> DataFrame:
    """A slice's data from its substreams (image_id, k, data): image_id, lengths once escaped, and data in the order of k.

    A group is one slice's coded bytes, which its unit holds in any case.
    """

    def build(key, group):
        import pandas as pd

        data = [bytes(b) for b in group.sort_values("k").data]
        return pd.DataFrame({"image_id": [key[0]], "lengths": [escaped_lengths(data)], "data": [b"".join(data)]})

    return parts.groupBy("image_id").applyInPandas(build, "image_id bigint, lengths array<bigint>, data binary")
