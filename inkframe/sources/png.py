"""PNG files of uint8 arrays, with zlib alone."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_KIND = {1: 0, 3: 2, 4: 6}


def encode(image: np.ndarray) -> bytes:
    """Grey (h, w), BGR or BGRA (h, w, 3 or 4) to a PNG file."""
    image = image[:, :, None] if image.ndim == 2 else image
    height, width, channels = image.shape
    order = {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[channels]
    rows = np.concatenate((np.zeros((height, 1), np.uint8), np.ascontiguousarray(image[:, :, order]).reshape(height, -1)), axis=1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", width, height, 8, _KIND[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """The array of a PNG file of 8-bit grey, BGR or BGRA samples without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, head = 8, [], None
    while at + 8 <= len(data):
        size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 8 + size])
        elif name == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    kinds = {kind: n for n, kind in _KIND.items()}
    if head is None or head[2] != 8 or head[3] not in kinds or head[6]:
        raise ValueError("a PNG file of another kind")
    width, height, channels = head[0], head[1], kinds[head[3]]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, -1)
    out = np.zeros((height + 1, width + 1, channels), np.uint8)  # a row above and a pixel before, both 0
    for y in range(height):
        own, up = rows[y, 1:].reshape(width, channels), out[y, 1:]
        match rows[y, 0]:
            case 0:
                out[y + 1, 1:] = own
            case 1:
                out[y + 1, 1:] = np.cumsum(own, axis=0, dtype=np.uint8)
            case 2:
                out[y + 1, 1:] = own + up
            case kind:
                _unfilter(own.astype(np.int64), out, y, int(kind))
    image = out[1:, 1:][:, :, {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[channels]]
    return image[:, :, 0] if channels == 1 else image


def _unfilter(own: np.ndarray, out: np.ndarray, y: int, kind: int) -> None:
    """Filters that need each pixel's left neighbour: the mean (3) and the nearest of three to their gradient (4)."""
    above = out[y].astype(np.int64)
    left = np.zeros(own.shape[1], np.int64)
    for x in range(len(own)):
        up, corner = above[x + 1], above[x]
        if kind == 3:
            guess = (left + up) // 2
        else:
            far = np.abs(left + up - corner - np.stack((left, up, corner)))
            guess = np.choose(np.argmin(far, axis=0), (left, up, corner))
        left = (own[x] + guess) % 256
        out[y + 1, x + 1] = left
