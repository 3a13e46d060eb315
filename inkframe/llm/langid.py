"""Language ID by string kernels: blended-spectrum n-gram presence kernels, Nystrom landmarks, one-versus-rest kernel ridge regression.

A text's features are the presences of its n-grams of 1 to 3 code points (lower case), hashed to 8192
places. The kernel of two texts is the number of places both have, over the geometric mean of theirs.
``LANDMARKS`` training texts, or one a language if there are more languages, span the Nystrom features;
ridge regression against +1/-1 for each language is solved in closed form on the driver from some
``SAMPLE`` labelled texts, but at least one and about ``EACH`` or more of each language (a documented
bound; of each a kilobyte of presence bits is collected, never text). Every language with a usable label
is learned. Scoring is two matrix products for each batch of whole texts; long texts are read in parts.

Training uses only text and non-null lang of rows whose crc32(doc_id as text) mod 3 is not 1. Null
texts and texts without letters are `und` with score 0, and so is everything when nothing was learned.
Equal texts get equal predictions, ties go to the first name; repeated rows are judged each, rows
without doc_id count as training rows. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, drop, slices, small_batches, stash

PLACES, GRAMS, LANDMARKS, SAMPLE, EACH, RIDGE = 8192, 3, 128, 2400, 8, 1e-3
ROWS, PART, LEAST_LIKE = 256, 1 << 20, 0.01


def presence(texts: list[str]) -> np.ndarray:
    """(texts, 8192) of 0 and 1. A text that is long and alone goes in parts."""
    if len(texts) == 1 and len(texts[0]) > PART:
        lowered, out = texts[0].lower(), np.zeros((1, PLACES), np.uint8)
        for at in range(0, len(lowered), PART):
            out |= _presence([lowered[at : at + PART + GRAMS - 1]])
        return out
    return _presence([t.lower() for t in texts])


def _presence(lowered: list[str]) -> np.ndarray:
    out = np.zeros((len(lowered), PLACES), np.uint8)
    coded = [t.encode("utf-32-le", "surrogatepass") for t in lowered]
    points = np.frombuffer(b"".join(coded), "<u4").astype(np.uint32)
    of = np.repeat(np.arange(len(lowered), dtype=np.int32), [len(c) // 4 for c in coded])
    flat, gram = out.reshape(-1), np.zeros(len(points), np.uint32)
    for n in range(1, GRAMS + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        gram = gram[:size] * np.uint32(0x9E3779B1) + points[n - 1 :] * np.uint32(0x85EBCA6B) + np.uint32(n)
        at = ((gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(19)
        own = of[:size]
        index = own.astype(np.int64) * PLACES + at
        flat[index if n == 1 else index[own == of[n - 1 :]]] = 1
    return out


def normed(bits: np.ndarray) -> np.ndarray:
    x = bits.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def _root(matrix: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(matrix)
    keep = values > 1e-6 * values[-1]
    return vectors[:, keep] / np.sqrt(values[keep])


def train(langs: list[str], bits: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages, the landmarks (places x landmarks) and the weights (landmarks x languages)."""
    names = sorted(set(langs))
    x, y = normed(bits), np.where(np.array(langs)[:, None] == np.array(names)[None], 1.0, -1.0)
    each, rows, count = max(1, LANDMARKS // len(names)), defaultdict(list), Counter(langs)
    for i, lang in enumerate(langs):
        rows[lang].append(i)
    chosen = [i for name in names for i in rows[name][:each]]
    marks = np.unique(bits[chosen], axis=0)
    marks = normed(marks)
    root = _root((marks @ marks.T).astype(np.float64))
    features = (x @ marks.T).astype(np.float64) @ root
    balance = np.array([1.0 / count[lang] for lang in langs])[:, None]
    gram = features.T @ (features * balance) + RIDGE * np.eye(features.shape[1])
    return names, np.ascontiguousarray(marks.T), (root @ np.linalg.solve(gram, features.T @ (y * balance))).astype(np.float32)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("bits", pa.binary())])
    for batch in slices(batches):
        bits = np.packbits(presence(batch.column("text").to_pylist()), axis=1)
        yield arrow_rows(schema, lang=batch.column("lang"), bits=[row.tobytes() for row in bits])


def _judged(model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The language and the score of each text, and its likeness to the nearest landmark."""
    names, marks, weights = model
    lang, score, like = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts))
    known = np.array([bool(names) and any(map(str.isalpha, t or "")) for t in texts], bool)
    if known.any():
        near = normed(presence([t for t, k in zip(texts, known, strict=True) if k])) @ marks
        marginal = near @ weights
        lang[known] = np.array(names, object)[marginal.argmax(axis=1)]
        score[known] = np.clip((1 + marginal.max(axis=1)) / 2, 0, 1)
        like[known] = near.max(axis=1)
    return lang, score, like


def _predict(model):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for small in slices(batches):
            for at in range(0, small.num_rows, ROWS):
                batch = small.slice(at, ROWS)
                lang, score, _ = _judged(model.value, batch.column("text").to_pylist())
                yield arrow_rows(schema, doc_id=batch.column("doc_id").cast(pa.int64()), held_out=batch.column("held_out"), lang_pred=lang.tolist(), score=score)

    return run


def learn(docs: DataFrame, broadcast_languages: int = 10_000):
    """A broadcast of what `train` gives for a bounded sample of the training rows of ``docs``.

    The sample is drawn by a hash of doc_id and text against a limit for each language; the limits are broadcast up to
    ``broadcast_languages`` languages, else joined. Repeated rows would be drawn together, however many, so they count once.
    """
    spark = docs.sparkSession
    usable = docs.filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    usable = usable.withColumn("draw", F.pmod("key", F.lit(1 << 30)))
    counts = stash(usable.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("first")), "languages")
    languages = counts.count()
    if not languages:
        return spark.sparkContext.broadcast(([], None, None))
    each = max(EACH, SAMPLE // languages)
    limits = counts.select("lang", F.greatest(F.col("first") + 1, F.least(F.lit(1.0), F.lit(each) / F.col("n")) * (1 << 30)).alias("limit"))
    limits = F.broadcast(limits) if languages <= broadcast_languages else limits
    drawn = usable.join(limits, "lang").filter("draw < limit").dropDuplicates(["lang", "key"])
    rows = drawn.select("lang", "text").mapInArrow(_sampled, "lang string, bits binary").collect()
    drop(counts)
    rows = sorted(((r["lang"], bytes(r["bits"])) for r in rows), key=lambda r: (r[0], zlib.crc32(r[1]), r[1]))
    bits = np.unpackbits(np.frombuffer(b"".join(b for _, b in rows), np.uint8).reshape(len(rows), -1), axis=1)
    return spark.sparkContext.broadcast(train([lang for lang, _ in rows], bits))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, text, lang)."""
    small_batches(docs.sparkSession)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", "text", "lang", F.coalesce(crc % 3 == 1, F.lit(False)).alias("held_out"))
    model = learn(docs)
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predict(model), "doc_id bigint, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in a learned language; lang is the predicted one where it was null.

    Rejected are null texts, texts without letters and texts that are like no landmark at all (nearest likeness
    under ``LEAST_LIKE``, as of a script that no learned language uses). Where no language was learned, all
    texts with letters stay as they are.
    """
    small_batches(docs.sparkSession)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    model = learn(docs.select("doc_id", "text", "lang", F.coalesce(crc % 3 == 1, F.lit(False)).alias("held_out")))
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for small in slices(batches):
            for at in range(0, small.num_rows, ROWS):
                batch = small.slice(at, ROWS)
                texts = batch.column("text").to_pylist()
                if not model.value[0]:
                    yield batch.filter(pa.array([any(map(str.isalpha, t or "")) for t in texts], pa.bool_()))
                    continue
                lang, _, like = _judged(model.value, texts)
                columns, place = list(batch.columns), batch.schema.get_field_index("lang")
                columns[place] = pc.coalesce(batch.column("lang"), pa.array(lang.tolist(), batch.schema.field("lang").type)) if batch.column("lang").null_count else columns[place]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(like >= LEAST_LIKE))

    return docs.mapInArrow(run, fields)
