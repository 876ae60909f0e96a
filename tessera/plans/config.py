"""Settings of an encode as an immutable value, checked when made."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from enum import Enum, IntEnum


class BitDepth(IntEnum):
    EIGHT, TEN, TWELVE = 8, 10, 12

    @property
    def top(self) -> int:
        return (1 << self) - 1

    @property
    def neutral(self) -> int:
        return 1 << (self - 1)

    @property
    def qp_offset(self) -> int:
        return 6 * (self - 8)


class Chroma(Enum):
    """Name, code, and how many luma columns and rows a chroma sample covers."""

    MONO = ("4:0:0", 0, 1, 1)
    C420 = ("4:2:0", 1, 2, 2)
    C422 = ("4:2:2", 2, 2, 1)
    C444 = ("4:4:4", 3, 1, 1)

    @property
    def code(self) -> int:
        return self.value[1]

    def padded(self, width: int, height: int) -> tuple[int, int]:
        """Dimensions rounded up to whole chroma samples."""
        _, _, w, h = self.value
        return -(-width // w) * w, -(-height // h) * h


class Orientation(IntEnum):
    """Exif orientation; mirror axis (None: no mirror) and quarter turns anticlockwise follow from it."""

    NORMAL, MIRRORED, HALF_TURN, FLIPPED, TRANSPOSED, RIGHT, TRANSVERSED, LEFT = range(1, 9)

    @property
    def mirror_axis(self) -> int | None:
        return {Orientation.MIRRORED: 1, Orientation.FLIPPED: 0, Orientation.TRANSPOSED: 1, Orientation.TRANSVERSED: 1}.get(self)

    @property
    def quarter_turns(self) -> int:
        return {Orientation.HALF_TURN: 2, Orientation.RIGHT: 3, Orientation.LEFT: 1, Orientation.TRANSPOSED: 1, Orientation.TRANSVERSED: 3}.get(self, 0)


class Speed(Enum):
    FAST, SLOW = "fast", "slow"


@dataclass(frozen=True)
class Cicp:
    """Code points of primaries, transfer and matrix; the defaults are sRGB's."""

    primaries: int = 1
    transfer: int = 13
    matrix: int = 1
    full_range: bool = True

    def payload(self) -> bytes:
        return b"nclx" + b"".join(v.to_bytes(2, "big") for v in (self.primaries, self.transfer, self.matrix)) + bytes([self.full_range << 7])


@dataclass(frozen=True)
class EncodeConfig:
    quality: int = 80
    lossless: bool = False
    chroma: Chroma = Chroma.C420
    cicp: Cicp | None = Cicp()
    icc: bytes | None = None
    orientation: Orientation = Orientation.NORMAL
    light_level: tuple[int, int] | None = None
    exif: bytes | None = None
    grid: bool = True
    sao: bool = True
    boost_octile: int = 4
    boost_strength: float = 1.0
    speed: Speed = Speed.FAST
    screen_content: bool = False

    def __post_init__(self) -> None:
        if not 1 <= self.quality <= 100:
            raise ValueError("quality must be from 1 to 100")
        if not 1 <= self.boost_octile <= 8:
            raise ValueError("the octile must be from 1 to 8")
        if not (math.isfinite(self.boost_strength) and 0 <= self.boost_strength <= 4):
            raise ValueError("the strength must be from 0 to 4")

    def having(self, **changes) -> EncodeConfig:
        return replace(self, **changes)

    @property
    def qp(self) -> int:
        return min(51, (100 - self.quality) * 41 // 99 + 10)

    def extended_profile(self, depth: int) -> bool:
        """Whether the range-extensions profile is needed (screen content has a profile of its own)."""
        return not self.screen_content and (self.lossless or depth == 12 or self.chroma in (Chroma.C422, Chroma.C444))


def tile_grid(columns: int, rows: int, workers: int) -> tuple[int, int]:
    """(rows, columns) of tiles for so many workers: the fewest beyond the need, then the squarest, then the first."""
    best = None
    for r in range(1, rows + 1):
        for c in range(1, columns + 1):
            if r * c >= min(workers, rows * columns):
                cost = (r * c - workers) * 1000 + abs(columns / c - rows / r)
                if best is None or cost < best[0]:
                    best = (cost, r, c)
    return best[1], best[2]
