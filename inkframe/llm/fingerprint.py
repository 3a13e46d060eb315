"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A fingerprint is a vector summed over the paragraphs (parts between line feeds) of a text:
8 lanes modulo 2^64 from a wide hash of the paragraph, which tell multisets of paragraphs apart,
and 128 lanes modulo 2^32, read as signed, with +1 or -1 for each 12-byte window of the paragraph and one for the
paragraph itself, whose cosine estimates how much two texts share. Sums don't depend on the order,
and a paragraph is inserted or deleted by adding or subtracting its vector (`add`, `remove`).

Null and empty texts have no paragraph: the zero vector. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, raw, slices, small_batches

EXACT, ROUGH, WINDOW = 8, 128, 12
_STEP = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(9)]
_VALUE = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
_VALUE ^= _VALUE >> np.uint64(31)
_VALUE *= np.uint64(0xA0761D6478BD642F)
_SPREAD = np.uint64(0xE7037ED1A0B428DB)


def vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x 8 uint64, rows x 128 uint32): the summed lanes of each text."""
    rows, n = len(offsets) - 1, len(data)
    exact = np.zeros((rows, EXACT), np.uint64)
    rough = np.zeros(rows * 2 * ROUGH, np.int64)
    whole = data.tobytes()
    for r in range(rows):
        if offsets[r] == offsets[r + 1]:
            continue
        paragraphs = whole[offsets[r] : offsets[r + 1]].split(b"\n")
        own = np.frombuffer(b"".join([hashlib.blake2b(p).digest() for p in paragraphs]), "<u8").reshape(-1, EXACT)
        exact[r] = own.sum(axis=0, dtype=np.uint64)
        rough[r * 2 * ROUGH : (r + 1) * 2 * ROUGH] += np.bincount((own[:, 0] >> np.uint64(56)).astype(np.int64), minlength=2 * ROUGH)
    if n >= WINDOW:
        one = _VALUE[data]
        two = one[:-1] + _STEP[1] * one[1:]
        four = two[:-2] + _STEP[2] * two[2:]
        eight = four[:-4] + _STEP[4] * four[4:]
        window = eight[: n - WINDOW + 1] + _STEP[8] * four[8 : n - 3]
        lane = ((window ^ (window >> np.uint64(32))) * _SPREAD) >> np.uint64(56)
        cut = np.zeros(n + 1, np.int8)
        breaks = np.flatnonzero(data == 10)
        np.add.at(cut, breaks, 1)
        np.add.at(cut, breaks + 1, 1)
        cut[offsets[1:-1]] += 1
        part = np.cumsum(cut[:n], dtype=np.int32)
        inside = part[: n - WINDOW + 1] == part[WINDOW - 1 :]
        inside &= data[: n - WINDOW + 1] != 10
        of = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))[: n - WINDOW + 1]
        rough += np.bincount(of[inside] * (2 * ROUGH) + lane[inside].astype(np.int64), minlength=len(rough))
    rough = rough.reshape(rows, 2, ROUGH)
    return exact, (rough[:, 0] - rough[:, 1]).astype(np.uint32)


def pack(exact: np.ndarray, rough: np.ndarray) -> list[str]:
    both = np.concatenate((exact.astype("<u8").view(np.uint8).reshape(len(exact), -1), rough.astype("<u4").view(np.uint8).reshape(len(rough), -1)), axis=1)
    return [row.tobytes().hex() for row in both]


def unpack(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    data = bytes.fromhex(fingerprint)
    return np.frombuffer(data[: 8 * EXACT], "<u8").astype(np.uint64), np.frombuffer(data[8 * EXACT :], "<u4").astype(np.uint32)


def fingerprint(text: str | None) -> str:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return pack(*vectors(data, np.array([0, len(data)])))[0]


def add(a: str, b: str) -> str:
    """The fingerprint of the paragraphs of both."""
    (x, r), (y, s) = unpack(a), unpack(b)
    return pack((x + y)[None], (r + s)[None])[0]


def remove(a: str, b: str) -> str:
    """The fingerprint of what is left of ``a`` without the paragraphs of ``b``."""
    (x, r), (y, s) = unpack(a), unpack(b)
    return pack((x - y)[None], (r - s)[None])[0]


def likeness(exact_a: np.ndarray, rough_a: np.ndarray, exact_b: np.ndarray, rough_b: np.ndarray) -> np.ndarray:
    """Row by row: 1 for equal fingerprints, else the cosine of the rough lanes, at least 0."""
    a, b = rough_a.astype(np.int32).astype(np.float64), rough_b.astype(np.int32).astype(np.float64)
    size = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    cosine = np.divide((a * b).sum(axis=1), size, out=np.zeros(len(a)), where=size > 0)
    equal = (exact_a == exact_b).all(axis=1) & (rough_a == rough_b).all(axis=1)
    return np.where(equal, 1.0, np.clip(cosine, 0.0, 1.0))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_DDL = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, halo, descending doc_id; the row after each is its next document."""
    held: pa.RecordBatch | None = None
    for batch in slices(batches):
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        held = batch.slice(batch.num_rows - 1)
        if batch.num_rows < 2:
            continue
        buckets, halo = batch.column("bucket").to_numpy(), batch.column("halo").to_numpy()
        own = np.flatnonzero((halo[:-1] == 0) & (buckets[:-1] == buckets[1:]))
        if not len(own):
            continue
        texts = batch.column("text").to_pylist()
        data, offsets = raw(batch.column("text"))
        exact, rough = vectors(data, offsets)
        edited, lengths = [], []
        for i in own:
            text, after = texts[i] or "", texts[i + 1] or ""
            third = len(text) // 3
            edited.append((text[: len(text) - third] + after[:third]).encode())
            lengths.append(len(text))
        exact_e, rough_e = vectors(np.frombuffer(b"".join(edited), np.uint8), np.concatenate(([0], np.cumsum([len(e) for e in edited]))).astype(np.int64))
        yield arrow_rows(
            _OUT,
            doc_id=batch.column("doc_id").cast(pa.int64()).take(pa.array(own)),
            n_chars=lengths,
            edited_sha256=[hashlib.sha256(e).hexdigest() for e in edited],
            fingerprint=pack(exact[own], rough[own]),
            edited_fingerprint=pack(exact_e, rough_e),
            near_edited=likeness(exact[own], rough[own], exact_e, rough_e),
            near_next=likeness(exact[own], rough[own], exact[own + 1], rough[own + 1]),
        )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit with the next document, by descending doc_id.

    The texts are shuffled once, by quantiles of doc_id; the first document of each bucket is sent
    to the bucket above it as well (to the lowest from the highest), so no window over all rows is
    needed. Equal doc_ids go by text; rows without doc_id come last.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), "text")
    rows = rows.withColumn("at", F.col("key").cast("double"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    bounds = sorted(set(rows.approxQuantile("at", [k / n for k in range(1, n)], 1 / (8 * n))))
    rows = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="at", outputCol="bucket").transform(rows) if bounds else rows.withColumn("bucket", F.lit(0.0))
    rows = rows.select(F.col("bucket").cast("int").alias("bucket"), "key", "doc_id", "text")
    tops = rows.groupBy("bucket").agg(F.max("key").alias("key")).orderBy("bucket").collect()  # a row for each bucket
    above = [(top["key"], after["bucket"]) for top, after in zip(tops, [*tops[1:], *tops[:1]], strict=True)]
    halo = spark.createDataFrame(above, "key bigint, target int")
    first = rows.filter(F.col("key").isin([k for k, _ in above])).join(F.broadcast(halo), "key")
    both = rows.withColumn("halo", F.lit(0)).unionByName(first.select(F.col("target").alias("bucket"), "key", "doc_id", "text", F.lit(1).alias("halo")))
    dealt = both.repartition("bucket").sortWithinPartitions("bucket", "halo", F.desc("key"), F.asc_nulls_first("text"))
    return dealt.select("bucket", "halo", "doc_id", "text").mapInArrow(_edit_rows, _DDL)
