"""Pixel kernels in numpy, and their Arrow wrappers over image rows.

Images are uint8 arrays: grey (h, w), BGR (h, w, 3) or BGRA glyphs with ink in alpha (h, w, 4). The
wrappers work on Spark's image struct; statistics come back as rows, so pixels are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ink_plane(image: np.ndarray) -> np.ndarray:
    """Ink as 0..255: alpha where there is one, else the darkness."""
    if image.ndim == 3 and image.shape[2] == 4:
        return image[:, :, 3]
    grey = image if image.ndim == 2 else image[:, :, :3].mean(axis=2).astype(np.uint8)
    return 255 - grey


def ink_bbox(ink: np.ndarray, threshold: int = 10) -> tuple[int, int, int, int] | None:
    """(left, top, right, bottom), ends exclusive, of what is over the threshold."""
    rows, cols = np.flatnonzero((ink > threshold).any(axis=1)), np.flatnonzero((ink > threshold).any(axis=0))
    return (int(cols[0]), int(rows[0]), int(cols[-1]) + 1, int(rows[-1]) + 1) if len(rows) else None


def normalise_alpha(alpha: np.ndarray, top: int = 240) -> np.ndarray:
    most = int(alpha.max(initial=0))
    return alpha if most == 0 else np.minimum(255, alpha.astype(np.float64) * (top / most)).astype(np.uint8)


def largest_gap_crop(alpha: np.ndarray, gap: int = 8, share: float = 0.7, pad: int = 3) -> np.ndarray:
    """Drops a label above the ink: what is over the largest empty band that begins in the upper part; then crops."""
    rows = np.flatnonzero((alpha > 0).any(axis=1))
    if len(rows) > 1:
        wide = np.diff(rows)
        at = len(wide) - 1 - int(np.argmax(wide[::-1]))
        if wide[at] > gap and rows[at] < share * alpha.shape[0]:
            alpha = alpha.copy()
            alpha[: rows[at] + 1] = 0
    box = ink_bbox(alpha, 0)
    if box is None:
        return alpha
    left, top, right, bottom = box
    return alpha[max(0, top - pad) : bottom + pad, max(0, left - pad) : right + pad]


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-connected components: labels (0 is background) and rows of left, top, width, height, area.

    Runs of each row are joined to touching runs of the row above.
    """
    height, width = mask.shape
    up: list[int] = []
    spans: list[tuple[int, int, int]] = []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    above: list[int] = []
    for y in range(height):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask[y].astype(np.int8), [0]))))
        own = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            k = len(spans)
            spans.append((y, a, b))
            up.append(k)
            own.append(k)
            for j in above:
                if spans[j][1] <= b and a <= spans[j][2]:
                    x, z = find(j), find(k)
                    up[max(x, z)] = min(x, z)
        above = own
    labels = np.zeros(mask.shape, np.int32)
    roots = {r: n + 1 for n, r in enumerate(sorted({find(k) for k in range(len(spans))}))}
    stats = np.zeros((len(roots), 5), np.int64)
    stats[:, 0], stats[:, 1] = width, height
    far = np.zeros((len(roots), 2), np.int64)
    for k, (y, a, b) in enumerate(spans):
        n = roots[find(k)]
        labels[y, a:b] = n
        s = stats[n - 1]
        s[0], s[1], s[4] = min(s[0], a), min(s[1], y), s[4] + b - a
        far[n - 1] = max(far[n - 1, 0], b), max(far[n - 1, 1], y + 1)
    stats[:, 2:4] = far - stats[:, :2]
    return labels, stats


def drop_small(mask: np.ndarray, least: int = 12) -> np.ndarray:
    labels, stats = components(mask)
    keep = np.concatenate(([False], stats[:, 4] >= least))
    return keep[labels]


def _slide(mask: np.ndarray, size: tuple[int, int], pick: Callable, edge: bool, back: bool) -> np.ndarray:
    h, w = size
    top, left = (h - 1) // 2, (w - 1) // 2
    if back:
        top, left = h - 1 - top, w - 1 - left
    padded = np.pad(mask, ((top, h - 1 - top), (left, w - 1 - left)), constant_values=edge)
    rows = pick(np.stack([padded[k : k + mask.shape[0]] for k in range(h)]), axis=0)
    return pick(np.stack([rows[:, k : k + mask.shape[1]] for k in range(w)]), axis=0)


def erode(mask: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    return _slide(mask, size, np.all, True, False)


def dilate(mask: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    return _slide(mask, size, np.any, False, True)


def opening(mask: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    return dilate(erode(mask, size), size)


def distance(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of each set pixel to the nearest unset one (infinite without any)."""
    height, width = mask.shape
    far = float(height + width) ** 2
    column = np.where(mask, far, 0.0)
    for y in range(1, height):
        column[y] = np.minimum(column[y], (np.sqrt(column[y - 1]) + 1) ** 2)
    for y in range(height - 2, -1, -1):
        column[y] = np.minimum(column[y], (np.sqrt(column[y + 1]) + 1) ** 2)
    x = np.arange(width)
    steps = (x[:, None] - x[None]) ** 2
    out = np.sqrt((column[:, None, :] + steps[None]).min(axis=2))
    return np.where(mask.all(), np.inf, out)


def stroke_width(alpha: np.ndarray) -> float:
    """Twice the median distance of ink pixels to the background."""
    mask = np.pad(alpha > 0, 1)
    return float(2 * np.median(distance(mask)[mask])) if mask.any() else 0.0


def line_spans(ink: np.ndarray, threshold: int = 10) -> tuple[float, float]:
    """The largest share of ink in a row and in a column."""
    mask = ink > threshold
    return (float(mask.mean(axis=1).max()), float(mask.mean(axis=0).max())) if mask.size else (0.0, 0.0)


def line_ink(ink: np.ndarray, share: float = 0.6) -> tuple[float, float, int, int, int, float]:
    """Largest shares of ink in a row and in a column, the first such row and column if over ``share`` (else -1), the ink
    of all rows and columns over it (at most all), and its share of the ink."""
    mask = ink > 0
    if not mask.size:
        return 0.0, 0.0, -1, -1, 0, 0.0
    by_row, by_col, total = mask.sum(axis=1), mask.sum(axis=0), int(mask.sum())
    h, w = mask.shape
    lined = min(total, int(by_row[by_row > share * w].sum() + by_col[by_col > share * h].sum()))
    across, down = by_row.max() / w, by_col.max() / h
    return float(across), float(down), int(by_row.argmax()) if across > share else -1, int(by_col.argmax()) if down > share else -1, lined, lined / max(1, total)


def ncc(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised correlation of two images of one size; 0 where one is flat."""
    x, y = a.astype(np.float64).ravel(), b.astype(np.float64).ravel()
    x, y = x - x.mean(), y - y.mean()
    size = float(np.linalg.norm(x) * np.linalg.norm(y))
    return float(x @ y) / size if size >= 1e-6 else 0.0


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, at pixel centres."""
    h, w = image.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    if image.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    f = image.astype(np.float64)
    top = f[y0][:, x0] * (1 - fx) + f[y0][:, x1] * fx
    low = f[y1][:, x0] * (1 - fx) + f[y1][:, x1] * fx
    return np.clip(np.rint(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8)


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian, mirrored at the edges."""
    if sigma <= 0:
        return image.astype(np.float64)
    reach = max(1, int(3 * sigma + 0.5))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        padded = np.pad(out, [(reach, reach) if k == axis else (0, 0) for k in range(out.ndim)], mode="symmetric")
        size = out.shape[axis]
        out = sum(k * padded.take(range(i, i + size), axis=axis) for i, k in enumerate(kernel))
    return out


def cell_to_glyph(cell: np.ndarray, threshold: int = 100, least: int = 12, line: float = 0.6, pad: int = 4) -> np.ndarray | None:
    """A cell's BGR crop to a BGRA glyph: dark ink, opened, without long straight lines and specks; null without ink."""
    mask = opening(cell[:, :, :3].min(axis=2) < threshold, (2, 2))
    height, width = mask.shape
    straight = opening(mask, (1, max(2, int(width * line)))) | opening(mask, (max(2, int(height * line)), 1))
    mask = drop_small(mask & ~straight, least)
    box = ink_bbox(mask.astype(np.uint8) * 255)
    if box is None:
        return None
    left, top, right, bottom = max(0, box[0] - pad), max(0, box[1] - pad), box[2] + pad, box[3] + pad
    own = mask[top:bottom, left:right]
    out = np.zeros((*own.shape, 4), np.uint8)
    out[:, :, 3] = own * np.uint8(255)
    return out


def cell_crop(page: np.ndarray, grid: tuple[int, int], cell: int, margins: tuple[int, int, int, int], inset: float = 0.08, label: float = 0.15) -> np.ndarray:
    """The drawing zone of a template cell; margins are left, right, top, bottom."""
    cols, rows = grid
    height, width = page.shape[0] - margins[2] - margins[3], page.shape[1] - margins[0] - margins[1]
    w, h = width / cols, height / rows
    left, top = margins[0] + (cell % cols) * w, margins[2] + (cell // cols) * h
    x0, x1 = int(left + w * inset), int(left + w * (1 - inset))
    y0, y1 = int(top + h * inset), int(top + h * (1 - inset))
    return page[y0 + int((y1 - y0) * label) : y1, x0:x1]


def composite(paper: np.ndarray, glyphs: np.ndarray, ink: tuple[int, int, int] = (10, 10, 10), softness: float = 0.4, noise: float = 6.0, seed: int = 0) -> np.ndarray:
    """Ink over paper by a softened alpha, with seeded ink noise."""
    alpha = blur(glyphs[:, :, 3], softness)[..., None] / 255.0
    grain = np.random.default_rng(seed).normal(0, noise, paper.shape[:2])[..., None] if noise else 0.0
    return np.clip(paper[:, :, :3] * (1 - alpha) + (np.array(ink, float) + grain) * alpha, 0, 255).astype(np.uint8)


def ruled_paper(height: int, width: int, spacing: int = 42, margin: int = 204, tint: tuple[int, int, int] = (250, 252, 253), seed: int = 7) -> np.ndarray:
    """College-ruled paper in BGR: grain, lines and a margin line."""
    page = np.empty((height, width, 3), np.float64)
    page[:] = tint
    page += np.random.default_rng(seed).normal(0, 1.5, (height, width, 1))
    page[spacing::spacing] = page[spacing::spacing] * 0.4 + np.array((230, 200, 170)) * 0.6
    if margin < width:
        page[:, margin] = page[:, margin] * 0.4 + np.array((170, 170, 235)) * 0.6
    return np.clip(page, 0, 255).astype(np.uint8)


def wander(image: np.ndarray, amount: float, seed: int = 13) -> np.ndarray:
    """Columns shifted along a smooth random baseline; the image itself at 0 or less."""
    if amount <= 0:
        return image
    width = image.shape[1]
    knots = np.random.default_rng(seed).normal(0, 3 * amount, max(2, width // 60 + 2))
    shift = np.rint(np.interp(np.linspace(0, len(knots) - 1, width), np.arange(len(knots)), knots)).astype(int)
    rows = np.clip(np.arange(image.shape[0])[:, None] - shift[None], 0, image.shape[0] - 1)
    return np.take_along_axis(image, rows[..., None] if image.ndim == 3 else rows, axis=0)


def from_struct(row: dict) -> np.ndarray:
    shape = (row["height"], row["width"]) if row["nChannels"] == 1 else (row["height"], row["width"], row["nChannels"])
    return np.frombuffer(bytes(row["data"]), np.uint8).reshape(shape)


STATS = "width int, height int, ink_px int, ink_density double, left int, top int, right int, bottom int, h_span double, v_span double, stroke double, components int, ok boolean, error string"


def glyph_stats(image: np.ndarray) -> tuple:
    """A glyph's statistics; a bad image is a row with ok false."""
    try:
        ink = ink_plane(image)
        box = ink_bbox(ink) or (0, 0, 0, 0)
        across, down = line_spans(ink)
        count = int((ink > 10).sum())
        return (image.shape[1], image.shape[0], count, count / max(1, ink.size), *box, across, down, stroke_width(np.where(ink > 10, ink, 0)), len(components(ink > 10)[1]), True, None)
    except Exception as e:  # noqa: BLE001  errors become data
        return (0, 0, 0, 0.0, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0, False, f"{type(e).__name__}: {e}")


def stats_of(images: Column) -> Column:
    """An Arrow UDF: image struct to a struct of statistics."""

    @F.pandas_udf(STATS)
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in STATS.split(", ")]
        return pd.DataFrame([glyph_stats(from_struct(r)) for r in frame.to_dict("records")], columns=names)

    return run(images)


def raster_rows(df: DataFrame, key: str, array: str, side: int, scale: int, kernel: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Rows of a kernel over arrays of side * side floats, drawn as grey images of ``scale`` pixels a value (ink above 0)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, values in zip(frame[key], frame[array], strict=True):
                if values is None:
                    continue
                ink = np.clip(np.asarray(values, np.float64).reshape(side, side) * 1000, 0, 255).astype(np.uint8)
                rows += [(k, *r) for r in kernel(ink.repeat(scale, axis=0).repeat(scale, axis=1))]
            yield pd.DataFrame(rows, columns=names)

    return df.select(key, array).mapInPandas(run, schema)
