"""Layers that make a transparent page of handwriting (BGRA) look written by hand, and the stamping of one glyph.

A layer is a field of moves or of ink strength over the page, given by its reach and shape. An amount of 0
or less leaves a page as it is. Random shapes have fixed seeds, so a repeated task gives the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from inkframe.operators import kernels, photo

#: A layer's strength at every place of a page of some height and width, as an array that broadcasts over it.
Shape = Callable[[int, int], np.ndarray]


def _steps(size: int) -> np.ndarray:
    return np.arange(size) / size


def _down(shape: Callable[[np.ndarray], np.ndarray]) -> Shape:
    return lambda h, w: shape(_steps(h))[:, None]


def _across(shape: Callable[[np.ndarray], np.ndarray]) -> Shape:
    return lambda h, w: shape(_steps(w))[None]


def _shaken(seed: int) -> Shape:
    """Pushes to either side at every fourth row, straight lines between, growing down the page."""

    def shape(h: int, w: int) -> np.ndarray:
        knots = np.random.default_rng(seed).uniform(-1, 1, max(h // 4, 4))
        return (np.interp(np.arange(h), np.linspace(0, h, len(knots)), knots) * _steps(h) ** 0.7)[:, None]

    return shape


def _patches(seed: int) -> Shape:
    """0..1 in patches of some 25 pixels."""

    def shape(h: int, w: int) -> np.ndarray:
        light = np.random.default_rng(seed).random((max(h // 25, 2), max(w // 25, 2)))
        return 1 - kernels.resize(photo.clip8(light * 255), h, w) / 255.0

    return shape


@dataclass(frozen=True)
class Layer:
    """A field over the page: ``reach`` times the amount is the share of the page's width or height by which
    ink moves right or down, or the share of its strength that it loses. ``whole`` cuts the furthest move to
    whole pixels before the shape is taken."""

    kind: str  # right, down or ink
    reach: float
    shape: Shape
    whole: bool = False

    def laid(self, page: np.ndarray, amount: float) -> np.ndarray:
        h, w = page.shape[:2]
        field = self.shape(h, w)
        if self.kind == "ink":
            return fainter(page, 1 - amount * self.reach * field)
        most = amount * self.reach * (w if self.kind == "right" else h)
        move = np.trunc((np.trunc(most) if self.whole else most) * field).astype(int)
        if self.kind == "down":
            return np.take_along_axis(page, np.broadcast_to(np.clip(np.arange(h)[:, None] - move, 0, h - 1), (h, w))[..., None], axis=0)
        return moved(page, move)


def moved(page: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Each pixel from ``right`` places before it; what would come from beyond the page is empty."""
    h, w = page.shape[:2]
    framed = np.pad(page, ((0, 0), (1, 1), (0, 0)))
    source = np.clip(np.arange(1, w + 1)[None] - right, 0, w + 1)
    return np.take_along_axis(framed, np.broadcast_to(source, (h, w))[..., None], axis=1)


def fainter(page: np.ndarray, factor: np.ndarray) -> np.ndarray:
    out = page.copy()
    out[:, :, 3] = photo.clip8(page[:, :, 3] * factor)
    return out


#: Reaches and seeds, in the order in which layers are laid.
LAYERS: dict[str, Layer] = {
    "fatigue": Layer("right", 0.012, _shaken(7)),
    "wander": Layer("down", 0.012, _down(lambda t: np.sin(3 * np.pi * t))),
    "drift": Layer("right", 0.04, _down(lambda t: t), whole=True),
    "pressure": Layer("ink", 0.3, _patches(13)),
    "fading": Layer("ink", 0.5, lambda h, w: np.linspace(0, 1, h)[:, None]),
    "cramming": Layer("right", -0.06, _across(lambda t: t * t)),
}

#: Amounts by preset, in the order of the layers.
PRESETS = {
    "perfect": (0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "natural": (0.15, 0.2, 0.1, 0.2, 0.1, 0.1),
    "rushed": (0.4, 0.45, 0.3, 0.35, 0.25, 0.4),
    "messy": (0.8, 0.75, 0.6, 0.6, 0.5, 0.7),
}


def preset(name: str) -> dict[str, float]:
    """The amounts of a preset; of an unknown one natural's."""
    return dict(zip(LAYERS, PRESETS.get(name, PRESETS["natural"]), strict=True))


def realism(page: np.ndarray, amounts: dict[str, float]) -> np.ndarray:
    """All layers with an amount over 0."""
    for name in [n for n in LAYERS if amounts.get(n, 0) > 0]:
        page = LAYERS[name].laid(page, amounts[name])
    return page


def thickened(alpha: np.ndarray, steps: int) -> np.ndarray:
    """Strokes grown by 2x2 maxima, or thinned by minima, a number of times."""
    for _ in range(abs(steps)):
        alpha = photo.extreme(alpha, 2, np.maximum if steps > 0 else np.minimum)
    return alpha


def stamp(page: np.ndarray, glyph: np.ndarray, x: int, y: int, height: int, width: int, strength: float = 1.0, steps: int = 0, degrees: float = 0.0) -> np.ndarray:
    """A glyph over a page in place: resized, its ink weakened, thickened and turned; off the page it isn't drawn."""
    if not (0 <= x < page.shape[1] and 0 <= y < page.shape[0]):
        return page
    glyph = fainter(kernels.resize(glyph, height, width), np.array(strength))
    glyph[:, :, 3] = thickened(glyph[:, :, 3], steps)
    if abs(degrees) > 0.1:
        reach = int(np.ceil((np.hypot(height, width) - min(height, width)) / 2))
        glyph = photo.rotate(np.pad(glyph, ((reach, reach), (reach, reach), (0, 0))), degrees, 0)
        box = kernels.ink_bbox(glyph[:, :, 3], 0)
        glyph = glyph[box[1] : box[3], box[0] : box[2]] if box else glyph
    own = page[y : y + glyph.shape[0], x : x + glyph.shape[1]]
    glyph = glyph[: own.shape[0], : own.shape[1]]
    over = glyph[:, :, 3:] / 255.0
    own[:] = photo.clip8(np.rint(own * (1 - over) + glyph * over))
    return page


def dot(page: np.ndarray, x: int, y: int, char_height: int, alpha: int = 180) -> np.ndarray:
    """The dot of an i, above its place; small letters get none."""
    if char_height < 30:
        return page
    size = max(2, char_height // 20)
    rows, cols = np.ogrid[: page.shape[0], : page.shape[1]]
    on = (rows - int(y - 0.7 * char_height)) ** 2 + (cols - x) ** 2 <= size * size
    page[on] = (0, 0, 0, alpha)
    return page
