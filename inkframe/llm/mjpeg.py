"""AVI with lossless intra-coded JPEG frames: bytes as 8-bit samples, and back; shots of the frames.

A frame is 64 samples wide and up to 16 high, coded as lossless JPEG (SOF3, predictor 1). Its Huffman
table gives the difference category s a code of 9 - s bits; the category's s further bits make nine
bits for every sample, so frames are packed and unpacked as whole arrays. The file is RIFF/AVI with
hdrl, movi and idx1; the payload's length is in the stream's strd chunk, frames beyond it are zero.

Null and empty texts are one block of zeros. Equal texts have equal files; repeated rows are stored each,
extra columns ignored; an empty table gives no rows. Files of others are read as well (`jpeg.decode`):
any Huffman table, DCT frames, no index. A file that can't be read is a row with its error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from .common import arrow_rows, ddl, slices, small_batches

WIDTH, HEIGHT, FPS, BINS = 64, 16, 25, 16


def _codes() -> tuple[np.ndarray, np.ndarray]:
    encode, decode = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        prefix = (1 << (9 - size)) - 2  # the canonical codes 0, 10, 110, ...
        code = prefix << size | (diff if diff >= 0 else diff + (1 << size) - 1)
        encode[diff + 255], decode[code] = code, diff
    return encode, decode


_ENCODE, _DECODE = _codes()
_DHT = bytes([0, *[1] * 9, *[0] * 7, *range(8, -1, -1)])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(height: int) -> bytes:
    return b"\xff\xd8" + _segment(0xC3, struct.pack(">BHHB3B", 8, height, WIDTH, 1, 1, 0x11, 0)) + _segment(0xC4, _DHT) + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """Lossless JPEG files of (n, height, 64) samples."""
    wide = frames.astype(np.int16)
    diff = np.empty_like(wide)
    diff[:, :, 1:] = wide[:, :, 1:] - wide[:, :, :-1]
    diff[:, 1:, 0] = wide[:, 1:, 0] - wide[:, :-1, 0]
    diff[:, 0, 0] = wide[:, 0, 0] - 128
    codes = (_ENCODE[diff + 255] << np.uint16(7)).astype(">u2").reshape(-1, 1).view(np.uint8)
    data = np.packbits(np.unpackbits(codes, axis=1)[:, :9].reshape(-1))
    size = len(data) // len(frames)
    step = 1 + (data == 255)
    to = np.cumsum(step)
    out = np.zeros(to[-1], np.uint8)
    out[to - step] = data  # a zero follows each 0xFF
    ends = to[size - 1 :: size]
    head = _head(frames.shape[1])
    return [head + out[a:b].tobytes() + b"\xff\xd9" for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _scan_of(jpeg: bytes) -> tuple[int, int, bytes] | None:
    """Height, width and entropy-coded bytes of a frame with the head that `encode_frames` writes; None of others."""
    height, width = struct.unpack(">HH", jpeg[7:11]) if len(jpeg) > 11 else (0, 0)
    head = _head(height)
    return (height, width, jpeg[len(head) : -2]) if jpeg.startswith(head) else None


def decode_frames(jpegs: list[bytes]) -> np.ndarray:
    """The samples of frames of one size, (n, height, width). Frames of our own are unpacked all at once."""
    scans = [_scan_of(j) for j in jpegs]
    if None in scans or len({s[:2] for s in scans}) != 1:
        frames = [jpeg.decode(j) for j in jpegs]
        if len({f.shape for f in frames}) != 1:
            raise ValueError("frames of several sizes" if frames else "no frames")
        return np.stack(frames)
    height, width = scans[0][:2]
    data = np.frombuffer(b"".join(s[2].replace(b"\xff\x00", b"\xff") for s in scans), np.uint8)
    bits = np.unpackbits(data).reshape(-1, 9)
    padded = np.zeros((len(bits), 16), np.uint8)
    padded[:, :9] = bits
    codes = np.packbits(padded, axis=1).view(">u2").reshape(len(jpegs), height, width) >> 7
    diff = _DECODE[codes].astype(np.int32)
    diff[:, 0, 0] += 128
    diff[:, :, 0] = np.cumsum(diff[:, :, 0], axis=1)
    return np.cumsum(diff, axis=2).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """An AVI file of the payload, a positive multiple of 64 bytes."""
    rows = len(payload) // WIDTH
    height = min(HEIGHT, rows)
    count = -(-rows // height)
    samples = np.zeros(count * height * WIDTH, np.uint8)
    samples[: len(payload)] = np.frombuffer(payload, np.uint8)
    frames = encode_frames(samples.reshape(count, height, WIDTH))
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, count, 0, 1, largest, WIDTH, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, count, largest, 10_000, 0, 0, 0, WIDTH, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", WIDTH * height, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", len(payload))))
    movi, index, at = [b"movi"], [], 4
    for frame in frames:
        movi.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(movi[-1])
    body = b"AVI " + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], at + 8, at + 8 + size
        at += 8 + size + (size & 1)


def open_avi(media: bytes) -> tuple[np.ndarray, int | None, float]:
    """The frames that the index lists (or, without one, that are there), the length of our payload and the frames a second."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    length, movi, index, fps, found = None, 0, b"", 0.0, []
    todo = list(_chunks(media, 12, len(media)))[::-1]
    while todo:
        name, a, b = todo.pop()
        kind = media[a : a + 4]
        if name == b"LIST":
            movi = a if kind == b"movi" else movi
            todo += list(_chunks(media, a + 4, b))[::-1] if kind in (b"hdrl", b"strl", b"rec ") or kind == b"movi" else []
        elif name == b"strd":
            length = int.from_bytes(media[a : a + 8], "little")
        elif name == b"strh" and kind == b"vids":
            scale, rate = struct.unpack_from("<II", media, a + 20)
            fps = rate / scale if scale else 0.0
        elif name == b"idx1":
            index = media[a:b]
        elif name[2:] in (b"dc", b"db") and movi and b <= len(media):
            found.append((a - 8, b - a))
    places = [struct.unpack_from("<4sIII", index, k) for k in range(0, len(index) - 15, 16)]
    places = [(at, size) for name, _, at, size in places if name[2:] in (b"dc", b"db")]
    base = movi if not places or not found or movi + places[0][0] == found[0][0] else 0  # some writers count from the file's start
    frames = [(base + at, size) for at, size in places] or found
    return decode_frames([media[at + 8 : at + 8 + size] for at, size in frames if size]), length, fps or float(FPS)


def read_avi(media: bytes) -> tuple[np.ndarray, bytes]:
    """The frames of a file of our own, and its payload."""
    frames, length, _ = open_avi(media)
    return frames, frames.tobytes()[:length]


def shot_cuts(frames: np.ndarray, reach: int = 8, factor: float = 2.0, least: float = 0.1) -> list[int]:
    """Frames that begin a new shot: their histogram is further from the one before than the mean plus
    ``factor`` deviations of the distances up to ``reach`` frames around, and further than ``least``."""
    count = len(frames)
    if count < 2:
        return []
    bins = (frames.reshape(count, -1) >> 4).astype(np.int64) + BINS * np.arange(count)[:, None]
    shares = np.bincount(bins.ravel(), minlength=count * BINS).reshape(count, BINS) / bins.shape[1]
    far = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    sums, squares = (np.concatenate(([0.0], np.cumsum(x))) for x in (far, far * far))
    at = np.arange(len(far))
    low, high = np.maximum(at - reach, 0), np.minimum(at + reach + 1, len(far))
    n = np.maximum(high - low - 1, 1)
    mean = (sums[high] - sums[low] - far) / n
    spread = np.sqrt(np.maximum((squares[high] - squares[low] - far * far) / n - mean * mean, 0))
    return (np.flatnonzero(far > np.maximum(mean + factor * spread, least)) + 1).tolist()


def clips(frames: np.ndarray, fps: float = FPS) -> list[tuple[int, float, float]]:
    """(first frame, start, end) of each shot, in seconds."""
    cuts = [0, *shot_cuts(frames), len(frames)]
    return [(a, a / fps, b / fps) for a, b in zip(cuts, cuts[1:], strict=False)]


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + b"\0" * (-len(data) % 64 if data else 64)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_clips", pa.int64())])
_CLIP = pa.schema([("doc_id", pa.int64()), ("clip", pa.int32()), ("first_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("error", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            size, payload = payload_of(text)
            media = write_avi(payload)
            frames, back = read_avi(media)
            shots = clips(frames)
            feature = f"{len(frames)}x{frames.shape[1]}x{frames.shape[2]}@{FPS};mean={frames.mean():.3f};shots=" + "|".join(f"{a:.2f}-{b:.2f}" for _, a, b in shots)
            rows.append((doc_id, size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(shots)))
        yield arrow_rows(_OUT, **dict(zip(_OUT.names, zip(*rows, strict=True), strict=True)))


def media_digests(docs: DataFrame) -> DataFrame:
    """Each text stored as an AVI file and read back: sizes, digests and its timed shots. Null is empty: one block of zeros."""
    small_batches(docs.sparkSession)
    ddl = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_clips bigint"
    return docs.select("doc_id", "text").mapInArrow(_digests, ddl)


def _clip_rows(doc_id: int | None, media: bytes) -> list[tuple]:
    try:
        frames, _, fps = open_avi(media)
    except (ValueError, IndexError, KeyError, struct.error) as wrong:  # a broken file is data
        return [(doc_id, None, None, None, None, f"{type(wrong).__name__}: {wrong}")]
    return [(doc_id, k, *shot, None) for k, shot in enumerate(clips(frames, fps))]


def media_clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of AVI files (doc_id, media binary); a null file has none, an unreadable one a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = [r for d, m in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True) if m is not None for r in _clip_rows(d, m)]
            if rows:
                yield arrow_rows(_CLIP, **dict(zip(_CLIP.names, zip(*rows, strict=True), strict=True)))

    small_batches(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(run, ddl(_CLIP))


def as_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text as an AVI file."""
    schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield arrow_rows(schema, doc_id=batch.column("doc_id").cast(pa.int64()), media=[write_avi(payload_of(t)[1]) for t in batch.column("text").to_pylist()])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, ddl(schema))
