"""Decoding of intra-coded JPEG frames: sequential DCT (SOF0, SOF1) and lossless with predictor 1 (SOF3).

Of DCT frames the first component (luminance) is returned, of lossless ones the only one. Frames without
Huffman tables have the standard's. Other kinds raise ValueError. Codes are looked up in tables of 16 bits;
blocks are transformed as whole arrays.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: The typical Huffman tables of the JPEG standard (ITU-T T.81, annex K.3): numbers of codes by
#: length, then the values; of the AC tables the first values, after which all others follow in order.
DC = {0: [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], 1: [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]}
AC = {0: [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], 1: [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]}
AC_FIRST = {
    0: "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82",
    1: "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1",
}
_K = np.arange(8)
_DCT = np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * _K[None] + 1) * _K[:, None] * np.pi / 16))
#: The places of a block from the top left, by diagonals that turn at the edges.
ZIGZAG = sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))


def lookup(counts: list[int], values: list[int]) -> list[tuple[int, int]]:
    """(length, value) for each possible 16 bits that begin with a code; length 0 where none does."""
    out: list[tuple[int, int]] = []
    at = 0
    for length, n in enumerate(counts, 1):
        for value in values[at : at + n]:
            out += [(length, value)] * (1 << (16 - length))
        at += n
    return (out + [(0, 0)] * (65536 - len(out)))[:65536]


def _standard() -> dict[tuple[int, int], list[tuple[int, int]]]:
    tables = {}
    for k in (0, 1):
        first = [int(x, 16) for x in AC_FIRST[k].split()]
        every = {run << 4 | size for run in range(16) for size in range(1, 11)} | {0x00, 0xF0}
        tables[0, k] = lookup(DC[k], list(range(12)))
        tables[1, k] = lookup(AC[k], first + sorted(every - set(first)))
    return tables


_STANDARD: dict[tuple[int, int], list[tuple[int, int]]] = {}


class Bits:
    """Entropy-coded bytes without stuffing, read from the front."""

    def __init__(self, data: bytes):
        padded = np.frombuffer(data + b"\xff" * 8, np.uint8).astype(np.uint32)
        self.words = (padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]).tolist()
        self.at, self.end = 0, 8 * len(data)

    def code(self, table: list[tuple[int, int]]) -> int:
        length, value = table[(self.words[self.at >> 3] >> (16 - (self.at & 7))) & 0xFFFF]
        self.at += length
        if not length or self.at > self.end:
            raise ValueError("broken entropy code")
        return value

    def signed(self, size: int) -> int:
        """A number of so many bits, negative ones by their complement."""
        if not size:
            return 0
        value = (self.words[self.at >> 3] >> (32 - size - (self.at & 7))) & ((1 << size) - 1)
        self.at += size
        return value if value >> (size - 1) else value - (1 << size) + 1


@dataclass
class Frame:
    kind: int = 0
    height: int = 0
    width: int = 0
    parts: dict[int, tuple[int, int, int]] = field(default_factory=dict)  # id: across, down, quantisation table
    quantise: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[tuple[int, int], list[tuple[int, int]]] = field(default_factory=dict)
    restart: int = 0


def _huffman(body: bytes, frame: Frame) -> None:
    while body:
        counts = list(body[1:17])
        n = sum(counts)
        frame.tables[body[0] >> 4, body[0] & 15] = lookup(counts, list(body[17 : 17 + n]))
        body = body[17 + n :]


def _quantisation(body: bytes, frame: Frame) -> None:
    while body:
        wide = body[0] >> 4
        frame.quantise[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.float64)
        body = body[65 + 64 * wide :]


def decode(jpeg: bytes) -> np.ndarray:
    """The samples (height, width) of a frame."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    if not _STANDARD:
        _STANDARD.update(_standard())
    frame, at = Frame(tables=dict(_STANDARD)), 2
    while at + 4 <= len(jpeg):
        if jpeg[at] != 0xFF:
            raise ValueError("broken JPEG frame")
        marker = jpeg[at + 1]
        if marker == 0xFF or marker in (0x01, *range(0xD0, 0xD9)):
            at += 1 if marker == 0xFF else 2
            continue
        size = int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC4:
            _huffman(body, frame)
        elif marker == 0xDB:
            _quantisation(body, frame)
        elif marker == 0xDD:
            frame.restart = int.from_bytes(body[:2], "big")
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            if marker not in (0xC0, 0xC1, 0xC3) or body[0] != 8:
                raise ValueError(f"JPEG frames of kind {marker - 0xC0} with {body[0]} bits aren't read")
            frame.kind, (frame.height, frame.width) = marker, struct.unpack(">HH", body[1:5])
            frame.parts = {body[k]: (body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)}
        elif marker == 0xDA:
            if not frame.parts or not frame.height or not frame.width:
                raise ValueError("a scan before its frame")
            return (_lossless if frame.kind == 0xC3 else _sequential)(frame, body, _intervals(jpeg[at:]))
    raise ValueError("a JPEG frame without a scan")


def _intervals(data: bytes) -> list[Bits]:
    """The scan's bytes up to its end, parted at restart markers, stuffing removed."""
    own, at = [], 0
    begin = 0
    while (at := data.find(b"\xff", at)) >= 0:
        marker = data[at + 1] if at + 1 < len(data) else 0xD9
        if marker == 0:
            at += 2
        elif 0xD0 <= marker <= 0xD7:
            own.append(data[begin:at])
            at = begin = at + 2
        elif marker == 0xFF:
            at += 1
        else:
            break
    own.append(data[begin : at if at >= 0 else len(data)])
    return [Bits(x.replace(b"\xff\x00", b"\xff")) for x in own]


def _lossless(frame: Frame, scan: bytes, parts: list[Bits]) -> np.ndarray:
    if len(frame.parts) != 1 or scan[0] != 1 or scan[3] != 1 or scan[5] & 15 or frame.restart:
        raise ValueError("another predictor, point transform or number of components")
    table, bits = frame.tables[0, scan[2] >> 4], parts[0]
    diff = np.array([bits.signed(bits.code(table)) for _ in range(frame.height * frame.width)], np.int64).reshape(frame.height, frame.width)
    diff[0, 0] += 128
    diff[:, 0] = np.cumsum(diff[:, 0])
    return np.cumsum(diff, axis=1).astype(np.uint8)


def _block(bits: Bits, dc: list[tuple[int, int]], ac: list[tuple[int, int]], before: int, out: np.ndarray) -> int:
    value = before + bits.signed(bits.code(dc))
    out[0], k = value, 1
    while k < 64:
        code = bits.code(ac)
        run, size = code >> 4, code & 15
        if not size:
            if run != 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("a block of more than 64 coefficients")
        out[k] = bits.signed(size)
        k += 1
    return value


def _sequential(frame: Frame, scan: bytes, parts: list[Bits]) -> np.ndarray:
    order = [(scan[1 + 2 * k], scan[2 + 2 * k] >> 4, scan[2 + 2 * k] & 15) for k in range(scan[0])]
    first = next(iter(frame.parts))
    if order[0][0] != first:
        raise ValueError("a scan that doesn't begin with the first component")
    across, down = (max(p[k] for p in frame.parts.values()) for k in (0, 1))
    if len(order) == 1:  # not interleaved: blocks in rows
        sizes = {first: (1, 1)}
        a, d, _ = frame.parts[first]
        wide, high = -(-frame.width * a // (8 * across)), -(-frame.height * d // (8 * down))
    else:
        sizes = {c: frame.parts[c][:2] for c, _, _ in order}
        wide, high = -(-frame.width // (8 * across)), -(-frame.height // (8 * down))
    a, d = sizes[first]
    found = np.zeros((high, d, wide, a, 64), np.int32)
    spare, before = np.zeros(64, np.int32), {}
    for unit in range(wide * high):
        interval = unit // frame.restart if frame.restart else 0
        if interval >= len(parts):
            raise ValueError("a scan that ends early")
        if not frame.restart or unit % frame.restart == 0:
            before = before if unit and not frame.restart else {c: 0 for c, _, _ in order}
        for c, dc, ac in order:
            for y in range(sizes[c][1]):
                for x in range(sizes[c][0]):
                    out = found[unit // wide, y, unit % wide, x] if c == first else spare
                    before[c] = _block(parts[interval], frame.tables[0, dc], frame.tables[1, ac], before[c], out)
    blocks = np.zeros(found.shape)
    blocks[..., ZIGZAG] = found * frame.quantise[frame.parts[first][2]]
    planes = _DCT.T @ blocks.reshape(high * d, wide * a, 8, 8) @ _DCT + 128
    plane = np.clip(np.rint(planes), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(8 * high * d, 8 * wide * a)
    own = frame.parts[first]
    return plane[: -(-frame.height * own[1] // down), : -(-frame.width * own[0] // across)]
