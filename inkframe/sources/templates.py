"""Templates: geometry of both versions, the scan map, capture sentences, and pages filled in from a bank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.operators import kernels, layout, realism
from inkframe.sources import dims, png

# The second template's drawing, the first one's pages in points, margin ratios, and sentences to copy.
BLUE, BASELINE = (255, 210, 170), 0.70  # BGR
POINTS = {"width": 612, "height": 792, "margin": 36, "cell_w": 34, "cell_h": 42, "h_gap": 4, "v_gap": 14, "title": 20, "baseline": 0.60}
V1_PUNCT = (".", ",", "!", "?", "'", '"', "-", ":", ";", "(", ")", "/", "@", "&", "#", "+", "=", "*")
V1_COLUMNS = {1: 8, 2: 9, 3: 8}
RATIOS = {"left": 0.5 / 8.5, "right": 0.5 / 8.5, "top": 0.95 / 11, "bottom": 0.45 / 11}
SENTENCES = (
    "the quick brown fox jumped over the lazy dog while the gentle breeze swept through the evening air",
    "Dr. James K. Blackwell from New York City asked, 'Why don't we visit Quebec and Zimbabwe next August?'",
    "On July 4, 1776, exactly 56 men signed it; by 1790 (14 years later) the population was 3,928,214.",
    "She just explained that the situation was quite complicated, and that nothing would change everything, but working hard enough can bring some truly surprising results over time.",
    "The freezing wind blew six heavy packages across the vast empty parking lot while Jasmine joyfully and quickly photographed the whole extraordinary scene.",
)


def sentences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SENTENCES)), "sentence long, text string")


def scan_map(spark: SparkSession, pages: dict[str, int]) -> DataFrame:
    """(file, page): which scan is which page."""
    return spark.createDataFrame(list(pages.items()), "file string, page int")


def v1_cells(spark: SparkSession) -> DataFrame:
    """(page, cell, row, col, char, x, y) of the first template, places in points from the page's bottom left; spare cells have no char."""
    upper = [c for c in dims.UPPER for _ in range(3)] + [None] * 3
    digits = [c for c in dims.DIGITS for _ in range(2)]
    signs = [c for c in V1_PUNCT for _ in range(2)]
    pages = {1: [c for c in dims.LOWER for _ in range(4)], 2: [*upper, *digits, *[None] * (-len(digits) % 9)], 3: [*signs, *[None] * (-len(signs) % 8)]}
    rows = [(page, k, k // V1_COLUMNS[page], k % V1_COLUMNS[page], c) for page, own in pages.items() for k, c in enumerate(own)]
    p = POINTS
    cells = spark.createDataFrame(rows, "page long, cell long, row long, col long, char string")
    x = p["margin"] + F.col("col") * (p["cell_w"] + p["h_gap"])
    y = p["height"] - p["margin"] - p["title"] - (F.col("row") + 1) * p["cell_h"] - F.col("row") * p["v_gap"]
    return cells.withColumns({"x": x, "y": y})


def cell_boxes(cells: DataFrame, by_ratio: bool = False, width: int = 2550, height: int = 3300) -> DataFrame:
    """Adds x0, y0, x1, y1, baseline of the second template's cells in pixels; margins are fixed, or shares of the page."""
    page = dims.PAGE
    margins = {k: int((width if k in ("left", "right") else height) * r) for k, r in RATIOS.items()} if by_ratio else page
    across, down = width - margins["left"] - margins["right"], height - margins["top"] - margins["bottom"]
    cols, rows = (F.element_at(dims.map_of({p: g[k] for p, g in dims.GRIDS.items()}), F.col("page").cast("int")) for k in (0, 1))
    w, h = F.lit(float(across)) / cols, F.lit(float(down)) / rows
    edge = lambda base, k, size: F.lit(base) + F.floor(k * size)
    y0 = edge(margins["top"], F.col("row"), h)
    return cells.withColumns({"x0": edge(margins["left"], F.col("col"), w), "y0": y0, "x1": edge(margins["left"], F.col("col") + 1, w), "y1": edge(margins["top"], F.col("row") + 1, h), "baseline": y0 + F.floor(h * BASELINE)})


def filled_page(cells: list[tuple], bank: layout.Bank, width: int = 2550, height: int = 3300) -> np.ndarray:
    """A template page with a glyph of the bank in each labelled cell, in black on its baseline; grid and baselines in blue.

    ``cells``: (display, variant, x0, y0, x1, y1, baseline); no display, no glyph.
    """
    page = np.full((height, width, 3), 255, np.uint8)
    ink = np.zeros((height, width, 4), np.uint8)
    for display, variant, x0, y0, x1, y1, baseline in cells:
        page[y0 : y1 + 1, [x0, x1]] = BLUE
        page[[y0, y1, baseline], x0 : x1 + 1] = BLUE
        if glyphs := bank.get(display or ""):
            glyph = glyphs[variant % len(glyphs)]
            tall = int((y1 - y0) * 0.4)
            wide = max(1, min(int(glyph.w * tall / max(1, glyph.h)), x1 - x0 - 8))
            realism.stamp(ink, glyph.image(), (x0 + x1 - wide) // 2, baseline - tall, tall, wide)
    return kernels.composite(page, ink, (0, 0, 0), softness=0, noise=0)


def filled_pages(spark: SparkSession, bank: DataFrame, by: int = 1) -> tuple[DataFrame, DataFrame]:
    """(page, png) of the four pages filled in, and the manifest of their labelled cells. ``by`` makes pages smaller by that factor."""
    width, height = 2550 // by, 3300 // by
    boxes = cell_boxes(dims.template_cells(spark), by_ratio=True, width=width, height=height)
    glyphs = layout.bank_of(r.asDict() for r in bank.collect())  # a bank, a dimension table
    own = boxes.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("cell", "display", "variant", "x0", "y0", "x1", "y1", "baseline"))).alias("cells"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names = ("display", "variant", "x0", "y0", "x1", "y1", "baseline")
            pages = [png.encode(filled_page([tuple(c[n] for n in names) for c in cells], glyphs, width, height)) for cells in frame["cells"]]
            yield pd.DataFrame({"page": frame["page"], "png": pages})

    manifest = boxes.filter("label IS NOT NULL").select("page", "cell", "row", "col", "label", "variant", "display")
    return own.mapInPandas(run, "page long, png binary"), manifest
