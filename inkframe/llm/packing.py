"""Packing documents into windows by best-fit decreasing.

Whole texts are tokenised (ids of the tokenizer, then the end id) and cut into full windows and a
rest; a full window is a sequence of its own. Rests are dealt evenly into groups of some ten thousand
pieces, each sorted by descending length in Spark and streamed through a segment tree indexed by
remaining capacity, which finds the tightest open window. Only the open windows' remaining capacities
are held. Sequence ids are even for packed windows (twice group * 2^32 + number), odd for full ones.

Tokenising goes over whole Arrow batches as byte arrays: words are found and hashed with numpy, the ids
of each distinct word are learned from the tokenizer once and kept, and gathered for the whole batch.
Two words are told apart by 64-bit hashes, among at most ``KEPT`` words that are kept at a time. Stretches
between white space that hold anything but Latin letters, digits, ASCII signs and usual punctuation go
to the tokenizer as they are, which gives the same ids, as it never joins what white space parts. Texts
over a megabyte are tokenised in parts cut at white space.

Null and empty texts are the end id alone. Repeated rows are packed each; ties go by doc_id, start and
place. Rows without doc_id are packed too. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, ddl, mix64, raw, slices, small_batches, stash
from .shingles import span_hashes

WINDOW, END, GROUP = 2048, 1, 20_000
KEPT, PART = 1_000_000, 1 << 20
_GAP, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
#: What each byte is by itself: ASCII as the tokenizer parts it; of the others only lead bytes of plain letters and signs.
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[0x20, *range(0x09, 0x0E)]] = _GAP
_KIND[0x30:0x3A] = _DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3, 0xC4]] = _LETTER
_KIND[0xE2] = _SIGN
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Fixed value: endings that the tokenizer parts from a word where an apostrophe begins a run of signs.
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def _lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes in lower case, and the kind of each; `_ODD` where only the tokenizer knows."""
    low, kind = _LOWER[data], _KIND[data]
    high = np.flatnonzero(data >= 0x80)
    if not len(high):
        return low, kind
    lead = high[data[high] >= 0xC0]
    value, after = data[lead], data[lead + 1]
    latin, more, sign = value == 0xC3, value == 0xC4, value == 0xE2  # U+00C0.., U+0100.., U+2000..
    low[lead[latin & (after < 0x9F)] + 1] += 0x20
    low[lead[more & (after % 2 == 0)] + 1] += 1
    kind[lead[latin & ((after == 0x97) | (after == 0xB7)) | more & (after > 0xAF)]] = _ODD
    last = np.minimum(lead[sign] + 2, len(data) - 1)
    usual = (after[sign] == 0x80) & ((data[last] >= 0x90) & (data[last] <= 0x9F) | (data[last] == 0xA6))  # dashes, quotes, dots
    kind[lead[sign][~usual]] = _ODD
    for k in (1, 2):
        kind[np.minimum(lead[sign] + k, len(data) - 1)] = _SIGN
    return low, kind


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokenizer's words, which of them are left to the tokenizer, and the bytes to look at."""
    n = len(data)
    low, kind = _lowered(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    new = edge[:n] | np.concatenate(([True], kind[1:] != kind[:-1])) | (kind == _DIGIT)
    ticks = np.flatnonzero((data == 0x27) & new)
    for ending in _ENDINGS if len(ticks) else ():
        size = len(ending)
        own = ticks[ticks + size < n]
        fits = np.ones(len(own), bool)
        for k, byte in enumerate(ending, 1):
            fits &= (low[own + k] == byte) & ~edge[own + k]
        own = own[fits]
        new[own + 1] = False
        rest = own[own + size + 1 < n] + size + 1
        new[rest] = True
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)) if n else np.zeros(0, np.int64)
    odd = np.flatnonzero(kind == _ODD)
    left = np.zeros(0, np.int64)
    if len(odd) or len(special):
        gap = kind == _GAP
        border = np.flatnonzero(edge[:n] | gap)
        first = np.unique(np.searchsorted(border, np.concatenate((odd, special)), "right") - 1)
        left = border[first] + gap[border[first]]
        until = np.append(border, n)[first + 1]
        depth = np.zeros(n + 1, np.int8)
        depth[left] += 1
        depth[until] -= 1
        new &= np.cumsum(depth[:n]) == 0
        new[left] = True
        new[until[until < n]] = True
    new &= kind != _GAP
    starts = np.flatnonzero(new)
    solid = np.append(kind != _GAP, False)
    stops = np.flatnonzero(np.append(new, True) | edge | ~solid)
    ends = stops[np.searchsorted(stops, starts, "right")]
    whole = np.zeros(n, bool)
    whole[left] = True
    return starts, ends, whole[starts], low


class Ids:
    """Ids of texts, a batch at a time. Of each distinct word the ids are kept; more than ``KEPT`` begin anew."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # hashes of the known words, ascending
        self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)  # where their ids are in ``ids``
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, plain: list[bytes], alone: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the ids of new words. Plain ones go in one call: a word's last id has the word's end."""
        ids = np.array(self._encode([b" ".join(plain).decode()])[0] if plain else [], np.uint32)
        count = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(count) != len(plain):
            each = self._encode([w.decode() for w in plain])
            ids, count = np.array([i for own in each for i in own], np.uint32), np.array([len(own) for own in each])
        each = self._encode([w.decode() for w in alone])
        count = np.concatenate((count, np.array([len(own) for own in each], np.int64)))
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate((self.ids, ids, np.array([i for own in each for i in own], np.uint32)))
        return first.astype(np.int32), count.astype(np.int32)

    def of_part(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows end to end, and the offsets of the rows."""
        starts, ends, whole, low = _units(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes = span_hashes(low, starts, ends)
        if whole.any():
            hashes[whole] = mix64(span_hashes(data, starts[whole], ends[whole]) + np.uint64(1))
        if len(self.keys) > KEPT or len(self.ids) > 8 * KEPT:
            self.clear()
        codes, keys = pd.factorize(hashes)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        first, count = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int32)
        first[known], count[known] = self.first[at[known]], self.count[at[known]]
        if not known.all():
            seen = np.empty(len(keys), np.int64)
            seen[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            new = np.flatnonzero(~known)
            new = new[np.argsort(whole[seen[new]], kind="stable")]
            own, plain = seen[new], len(new) - int(whole[seen[new]].sum())
            spans = list(zip(starts[own].tolist(), ends[own].tolist(), strict=True))
            lower, exact = low.tobytes(), data.tobytes() if plain < len(new) else b""
            first[new], count[new] = self._learn([lower[a:b] for a, b in spans[:plain]], [exact[a:b] for a, b in spans[plain:]])
            new = new[np.argsort(keys[new])]
            self.keys, self.first, self.count = (np.insert(x, at[new], y[new]) for x, y in ((self.keys, keys), (self.first, first), (self.count, count)))
        first, count = first[codes], count[codes]
        reach = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
        source = np.arange(reach[-1]) + np.repeat(first - reach[:-1], count)
        return self.ids[source], reach[np.searchsorted(starts, offsets)]

    def of_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `of_part`; a longer row than ``PART`` bytes comes alone and goes in parts cut at white space."""
        if len(data) <= PART or len(offsets) > 2:
            return self.of_part(data, offsets)
        parts, at = [], 0
        while at < len(data):
            to = at + PART
            while to < len(data) and _KIND[data[to]] != _GAP:
                to += 1
            to = min(to, len(data))
            parts.append(self.of_part(data[at:to], np.array([0, to - at]))[0])
            at = to
        ids = np.concatenate(parts)
        return ids, np.array([0, len(ids)])

    def of_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out = []
        for batch in slices([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])], limit=PART):
            ids, offsets = self.of_rows(*raw(batch.column("text")))
            out += [ids[a:b].astype("<u4").tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return out


_IDS: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One for each worker process."""
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree of which capacities there are."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.some = bytearray(2 * self.size)
        self.open: dict[int, list[int]] = {}

    def put(self, capacity: int, sequence: int) -> None:
        self.open.setdefault(capacity, []).append(sequence)
        node = capacity + self.size
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest window with room for ``least``: (capacity, sequence)."""
        node = least + self.size
        if not self.some[node]:
            while node & 1 or not self.some[node + 1]:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.size:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        capacity = node - self.size
        sequence = self.open[capacity].pop()
        if not self.open[capacity]:
            while node and not (node < self.size and (self.some[2 * node] or self.some[2 * node + 1])):
                self.some[node] = 0
                node >>= 1
        return capacity, sequence


def best_fit(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(sequence, offset) of each length; they come in descending order."""
    windows, count, out = OpenWindows(window), 0, []
    for length in lengths:
        if (found := windows.take(length)) is None:
            found, count = (window, count), count + 1
        capacity, sequence = found
        out.append((sequence, window - capacity))
        if capacity > length:
            windows.put(capacity - length, sequence)
    return out


_PIECE = pa.schema([("slot", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
_PACKED = pa.schema([*list(_PIECE)[1:], ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _pieces(path: str, window: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, slot = ids_of(path), TaskContext.get().partitionId() << 36
        for batch in slices(batches, limit=PART):
            ids, offsets = known.of_rows(*raw(batch.column("text")))
            rows = batch.num_rows
            tokens = np.diff(offsets) + 1
            coded = np.insert(ids, offsets[1:], np.uint32(end)).astype("<u4", copy=False)  # the end id after each row
            count = -(-tokens // window)
            of = np.repeat(np.arange(rows), count)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * window
            length = np.minimum(window, tokens[of] - start)
            at = 4 * ((offsets[:-1] + np.arange(rows))[of] + start)
            view = memoryview(coded).cast("B")
            crcs = [zlib.crc32(view[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            doc_id = batch.column("doc_id").cast(pa.int64()).take(pa.array(of))
            yield arrow_rows(_PIECE, slot=slot + np.arange(len(of)), doc_id=doc_id, start=start, length=length, ids_crc32=crcs, doc_tokens=tokens[of])
            slot += len(of)

    return run


def _pack(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, windows, count = None, OpenWindows(window), 0
        for batch in batches:
            sequences, offsets = [], []
            for g, length in zip(batch.column("grp").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if g != group:
                    group, windows, count = g, OpenWindows(window), 0
                if (found := windows.take(length)) is None:
                    found, count = (window, count), count + 1
                capacity, sequence = found
                sequences.append(2 * ((g << 32) + sequence))
                offsets.append(window - capacity)
                if capacity > length:
                    windows.put(capacity - length, sequence)
            yield arrow_rows(_PACKED, **{c: batch.column(c) for c in _PACKED.names[:5]}, sequence_id=sequences, offset=offsets)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end: int = END, group: int = GROUP) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of ``docs`` (doc_id, text)."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    small_batches(docs.sparkSession)
    pieces = stash(docs.select("doc_id", "text").mapInArrow(_pieces(str(tokenizer), window, end), ddl(_PIECE)), "pieces")
    columns = [F.col(c) for c in _PIECE.names[1:]]
    full = pieces.filter(F.col("length") == window).select(*columns, (2 * F.col("slot") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < window)
    groups = max(1, rest.count() // group)
    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "slot"), F.lit(groups)))
    dealt = dealt.repartition("grp").sortWithinPartitions("grp", F.desc("length"), "doc_id", "start", "slot")
    return dealt.mapInArrow(_pack(window), ddl(_PACKED)).unionByName(full)
