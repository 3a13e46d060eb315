"""Operators with state across rows: variant choice with recent and least use, band alignment, similarity."""

from __future__ import annotations

import difflib
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of trimmed lower-case texts; 1 where both are empty, 0 where one is."""

    def ratio(x: str | None, y: str | None) -> float:
        x, y = (x or "").lower().strip(), (y or "").lower().strip()
        if not x or not y:
            return float(not x and not y)
        return difflib.SequenceMatcher(None, x, y).ratio()

    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def draw(*key: object) -> float:
    """A number in 0..1 that depends on the key alone, so that a lost task draws the same again."""
    return int.from_bytes(hashlib.md5("|".join(map(str, key)).encode()).digest()[:7], "big") / float(1 << 56)


class VariantChoice:
    """Choice among a key's variants: not of the last two uses (any, if those are all), of these the least
    used, of these by weight."""

    def __init__(self, variants: int, weights: list[float] | None = None, recency: int = 2):
        self.uses, self.recent, self.recency = [0] * variants, [], recency
        self.weights = [max(0.01, w) for w in weights or [0.85] * variants]

    def next(self, u: float) -> int:
        if len(self.uses) < 2:
            return 0
        free = [v for v in range(len(self.uses)) if v not in self.recent] or list(range(len(self.uses)))
        least = min(self.uses[v] for v in free)
        free = [v for v in free if self.uses[v] == least]
        mark, chosen = u * sum(self.weights[v] for v in free), free[-1]
        for v in free:
            mark -= self.weights[v]
            if mark <= 0:
                chosen = v
                break
        self.uses[chosen] += 1
        self.recent = [*self.recent, chosen][-self.recency :]
        return chosen


def weighted_variants(rows: DataFrame, document: str, char: str, order: list[str], variants: int, seed: int = 0) -> DataFrame:
    """(document, char, order..., variant): state is kept for each character of a document.

    Documents spread over tasks; a task streams its rows in order and holds one document's states.
    """

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, states = object(), {}
        for frame in frames:
            chosen = []
            for doc, token in zip(frame[document].tolist(), frame[char].tolist(), strict=True):
                if doc != held:
                    held, states = doc, {}
                state, n = states.get(token) or (VariantChoice(variants), 0)
                states[token] = state, n + 1
                chosen.append(state.next(draw(seed, doc, token, n)))
            yield frame.assign(variant=chosen)

    kept = rows.select(document, char, *order).repartition(document).sortWithinPartitions(document, *order)
    return kept.mapInPandas(choose, f"{kept.schema.simpleString()[7:-1].replace(':', ' ')}, variant bigint")


def align(bands: list[int], expected: list[int], slack: int = 2) -> list[tuple[int, int, str]]:
    """(first band, bands taken, kind) for each expected count in turn: exact with one band, merged_bands with two, else partial."""
    out, at = [], 0
    for want in expected:
        if at >= len(bands):
            break
        if abs(bands[at] - want) <= slack:
            out.append((at, 1, "exact"))
        elif at + 1 < len(bands) and abs(bands[at] + bands[at + 1] - want) <= slack:
            out.append((at, 2, "merged_bands"))
        else:
            out.append((at, 1, "partial"))
        at += out[-1][1]
    return out


def align_bands(rows: DataFrame, key: str, order: str, count: str, expected: list[int]) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        counts = frame.sort_values(order)[count].tolist()
        return pd.DataFrame([(frame[key].iloc[0], n, *found) for n, found in enumerate(align(counts, expected))], columns=[key, "sentence", "band", "taken", "kind"])

    return rows.select(key, order, count).groupBy(key).applyInPandas(run, f"{key} bigint, sentence bigint, band bigint, taken bigint, kind string")
