"""Placements: the place of each glyph that sets a text, and pages drawn from them.

A document's layout depends on nothing but itself and the glyphs it uses. Banks up to ``BANK_ROWS`` glyphs
go to the tasks by value and documents are laid out where they are; of larger banks each document is joined
with the glyphs it can use. Zero jitter gives the deterministic layout; jitter is drawn from the document,
the place and a seed, so that a lost task gives the same again.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.functions.codec import swap_case
from inkframe.operators import kernels, photo, realism
from inkframe.operators.stateful import draw
from inkframe.sources import png
from inkframe.sources.dims import DESCENDERS, KERNING, LIGATURES, TALL

BANK_ROWS, BANK_BYTES, LONGEST = 10_000, 64 << 20, 4


@dataclass(frozen=True)
class Layout:
    page_width: int = 1200
    page_height: int = 1600
    margin_left: int = 100
    margin_top: int = 150
    line_height: int = 55
    char_height: int = 30
    letter_gap: float = 2.0
    word_gap: float = 30.0
    line_mult: float = 1.0
    cramming: float = 1.0
    jitter: float = 0.0  # of the gaps between letters
    size_jitter: float = 0.0
    angle_jitter: float = 0.0
    slant: float = 0.0
    wander: float = 0.0
    pressure: float = 0.0
    fatigue: float = 0.0
    ink: float = 1.0
    fade: float = 0.0
    thickness: int = 0
    bleed: float = 0.0
    seed: int = 0


#: How phrases are set where their legibility is scored.
PHRASE = Layout(page_width=1600, page_height=400, margin_left=60, margin_top=80, line_height=110, char_height=70, letter_gap=4.0, word_gap=28.0)


@dataclass(frozen=True)
class Glyph:
    w: int
    h: int
    ink_w: int
    ink_h: int
    variant: int = 0
    file: bytes | None = None

    def image(self) -> np.ndarray:
        """The glyph's file, or the closed form: a filled box inside a margin."""
        if self.file is not None:
            return png.decode(self.file)
        out = np.zeros((self.h, self.w, 4), np.uint8)
        top, left = (self.h - self.ink_h) // 2, (self.w - self.ink_w) // 2
        out[top : top + self.ink_h, left : left + self.ink_w] = (*(30 + 15 * self.variant,) * 3, 240)
        return out


Bank = dict[str, list[Glyph]]


def bank_of(rows: Iterable) -> Bank:
    found: Bank = {}
    for r in sorted(rows, key=lambda r: (r["char"], r["variant"])):
        file = r["png"] if "png" in r else None
        found.setdefault(r["char"], []).append(Glyph(r["w"], r["h"], r["ink_w"], r["ink_h"], r["variant"], None if file is None else bytes(file)))
    return found


def bank_medians(bank: DataFrame) -> DataFrame:
    """(ink_h, ink_w): medians over the first variant of each character."""
    first = bank.groupBy("char").agg(F.min_by(F.struct("ink_h", "ink_w"), "variant").alias("g"))
    return first.agg(F.expr("percentile(g.ink_h, 0.5)").alias("ink_h"), F.expr("percentile(g.ink_w, 0.5)").alias("ink_w"))


def usual_width(medians: tuple[float | None, float | None], char_height: int) -> int:
    """The ink width of a usual character at a height; without ink 0.55 of it."""
    high, wide = medians
    return int((wide or 0.0) * (char_height / high if high else 1.0)) or int(char_height * 0.55)


def place_text(doc: object, text: str, bank: Bank, p: Layout, usual: int) -> list[tuple]:
    """(pos, word, token, char, variant, line, x, y, w, h, strength, degrees) for each glyph; text beyond the page isn't set.

    Glyphs stand on the line's y, descenders below it. The wrap limit is the page's width less the left
    margin. ``usual`` is the ink width by which the number of lines is guessed, for the page's progress.
    """
    ngrams = sorted((k for k in bank if len(k) > 1), key=lambda k: (-len(k), k))
    pattern = re.compile("|".join([*map(re.escape, ngrams), "."]), re.I | re.S)
    right = p.page_width - p.margin_left
    crammed = p.margin_left + 0.65 * (right - p.margin_left)
    lines = max(1.0, len(text) * (usual + 2) / max(1, p.page_width - 2 * p.margin_left))
    used: dict[str, int] = {}
    out: list[tuple] = []
    x, y, line = float(p.margin_left), p.margin_top, 0

    def either(kind: str) -> float:
        """-1..1 for the next glyph."""
        return 2 * draw(p.seed, doc, len(out), kind) - 1

    def key(token: str) -> str | None:
        low = token.lower() if len(token) > 1 else token
        return low if low in bank else token.swapcase() if token.swapcase() in bank else None

    def size(token: str, glyph: Glyph) -> tuple[int, int, float]:
        target = int(p.char_height * 1.4) if token.isupper() or len(token) == 1 and token in TALL else p.char_height
        scale = target / max(glyph.h, 1)
        return max(1, min(int(glyph.w * scale), 3 * p.char_height)), target, glyph.ink_w * scale

    def squeeze(gap: float) -> float:
        if x > crammed and p.cramming < 1:
            gap *= 1 - (1 - p.cramming) * min(1.0, (x - crammed) / max(1, right - crammed))
        return gap

    for w, word in enumerate(text.split()):
        width = sum(max(size(c, g)[0] for g in bank[k]) + int(p.letter_gap) if (k := key(c)) else int(p.char_height * 0.3) for c in word)
        if x + width > right and x > p.margin_left + 50:
            x, line = float(p.margin_left), line + 1
            y += int(p.line_height * p.line_mult)
        if y + p.char_height > p.page_height - p.margin_top:
            break
        spacing = 1 - 0.05 * (line / lines)
        tired = 1 + p.fatigue * min(1.0, y / max(1, p.page_height))
        tokens = pattern.findall(word)
        for k, token in enumerate(tokens):
            after = "".join(tokens[k + 1 :])[:1]
            x += LIGATURES.get((token + after)[:2].lower(), 0) * spacing
            if (char := key(token)) is None:
                x += p.char_height * 0.3
                continue
            variants = bank[char]
            variant = used.get(char, 0) % len(variants)
            used[char] = variant + 1
            wide, high, ink = size(token, variants[variant])
            strength, degrees, lift = p.ink, p.slant, 0.0
            if p.size_jitter:
                grown = 1 + p.size_jitter * either("size") * tired
                wide, high, ink = max(1, int(wide * grown)), max(1, int(high * grown)), ink * grown
            if p.pressure:
                strength *= max(0.35, 1 - p.pressure * draw(p.seed, doc, len(out), "pressure") * tired)
            if p.fade:
                strength *= max(0.25, 1 - p.fade * y / max(1, p.page_height))
            if p.angle_jitter:
                degrees += p.angle_jitter * either("angle") * tired
            if p.wander:
                lift = p.wander * tired * math.sin(x / 90 + 2 * math.pi * draw(p.seed, doc, line, "line"))
            low = int(0.22 * p.char_height) if len(token) == 1 and token in DESCENDERS else 0
            out.append((len(out), w, token, char, variants[variant].variant, line, x, float(int(y - high + low + lift)), wide, high, strength, degrees))
            gap = p.letter_gap
            if p.jitter:
                gap += p.jitter * tired * math.sqrt(-2 * math.log(1 - draw(p.seed, doc, len(out), "r") * 0.999999)) * math.cos(2 * math.pi * draw(p.seed, doc, len(out), "a"))
            gap *= KERNING.get((token[-1] + after).lower(), 1.0) if after else 1.0
            x += int(ink) + squeeze(gap)
        x += squeeze(p.word_gap) * spacing
    return out


def _usable(text: Column) -> Column:
    """All keys that a bank could have for parts of a text: stretches of up to four characters, single ones in either case."""
    text = F.coalesce(text, F.lit(""))
    at = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(at, lambda i: F.concat(F.array(F.substring(text, i, F.lit(1)), swap_case(F.substring(text, i, F.lit(1)))), F.transform(F.sequence(F.lit(2), F.lit(LONGEST)), lambda n: F.lower(F.substring(text, i, n)))))
    return F.array_distinct(F.flatten(parts))


def _per_document(docs: DataFrame, key: str, bank: DataFrame, rows_of: Callable[[object, str, Bank], list[tuple]], schema: str, most: int) -> DataFrame:
    """Rows of ``rows_of`` for each document and its glyphs, a frame for each batch of documents."""
    columns = ["char", "variant", "w", "h", "ink_w", "ink_h", *(["png"] if "png" in bank.columns else [])]
    bank = bank.select(*columns)
    size = bank.agg(F.count("*").alias("n"), (F.sum(F.length("png")) if "png" in columns else F.lit(0)).alias("bytes")).first()
    shared = None
    if size["n"] <= most and (size["bytes"] or 0) <= BANK_BYTES:
        shared = bank_of(r.asDict() for r in bank.collect())
        rows = docs.select(key, "text")
    else:
        needed = docs.select(key, F.explode(_usable(F.col("text"))).alias("char")).distinct().join(bank, "char")
        glyphs = needed.groupBy(key).agg(F.collect_list(F.struct(*columns)).alias("glyphs")).withColumnRenamed(key, "glyphs_of")
        rows = docs.select(key, "text").join(glyphs, F.equal_null(F.col(key), F.col("glyphs_of")), "left").select(key, "text", "glyphs")
    names = [key, *[c.split()[0] for c in schema.split(", ")]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            banks = [shared] * len(frame) if shared is not None else [bank_of(g if g is not None else ()) for g in frame["glyphs"]]
            found = [(doc, *r) for doc, text, own in zip(frame[key], frame["text"], banks, strict=True) for r in rows_of(doc, text or "", own)]
            if found:
                yield pd.DataFrame(found, columns=names)

    return rows.mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, {schema}")


SCHEMA = "pos int, word int, token string, char string, variant int, line int, x double, y double, w int, h int, strength double, degrees double"


def _usual(bank: DataFrame, p: Layout) -> int:
    return usual_width(tuple(bank_medians(bank).first()), p.char_height)


def placements(docs: DataFrame, key: str, bank: DataFrame, params: Layout | None = None, most: int = BANK_ROWS) -> DataFrame:
    """A row for each glyph of each document (key, text)."""
    p = params or Layout()
    usual = _usual(bank, p)
    return _per_document(docs, key, bank, lambda doc, text, own: place_text(doc, text, own, p, usual), SCHEMA, most)


def draw_page(rows: list[tuple], bank: Bank, p: Layout, ink: tuple[int, int, int] = (10, 10, 10), paper: str | None = None) -> np.ndarray:
    """A page of placements: the bank's glyphs stamped on a transparent layer, then set on paper (white without one)."""
    layer = np.zeros((p.page_height, p.page_width, 4), np.uint8)
    images: dict[tuple[str, int], np.ndarray] = {}
    for _, _, token, char, variant, _, x, y, w, h, strength, degrees in rows:
        if (char, variant) not in images:
            images[char, variant] = next(g for g in bank[char] if g.variant == variant).image()
        left, top = int(x), int(y)
        realism.stamp(layer, images[char, variant], left, top, h, w, strength, p.thickness, degrees)
        if token.lower() in ("i", "t") and 0 <= left < p.page_width and 0 <= top < p.page_height:
            realism.dot(layer, left + w // 2, top, p.char_height)
    if p.bleed:
        layer = photo.bleed(layer, p.bleed)
    sheet = photo.paper(paper, p.page_height, p.page_width) if paper else np.full((p.page_height, p.page_width, 3), 255, np.uint8)
    return kernels.composite(sheet, layer, ink, noise=0.0)


def rendered(docs: DataFrame, key: str, bank: DataFrame, params: Layout | None = None, paper: str | None = "college", most: int = BANK_ROWS) -> DataFrame:
    """(key, n_glyphs, n_lines, png) of each document as a page image, drawn from the bank's glyphs (its column png, if it has one)."""
    p = params or Layout()
    usual = _usual(bank, p)

    def page(doc: object, text: str, own: Bank) -> list[tuple]:
        rows = place_text(doc, text, own, p, usual)
        return [(len(rows), rows[-1][5] + 1 if rows else 0, png.encode(draw_page(rows, own, p, paper=paper)))]

    return _per_document(docs, key, bank, page, "n_glyphs int, n_lines int, png binary", most)
