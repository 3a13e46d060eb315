"""Sinks: glyph files, contact sheets, JSON reports, and writes that replace or fail as a whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.operators import kernels
from inkframe.sources import png
from inkframe.sources.glyphs import contact_sheet

# A contact sheet's colours (BGR), thumbnails and gaps.
GROUND, INK, FRAME, THUMB, COLUMNS, LABEL = (24, 18, 18), (210, 200, 200), (55, 40, 40), (80, 64), 16, 16


def _files(spark: SparkSession, path: str) -> tuple[object, Callable[[str], object]]:
    jvm = spark._jvm.org.apache.hadoop.fs
    return jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), jvm.Path


def written_whole(rows: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> None:
    """Writes to a folder beside ``path`` and renames it, so that a failure leaves what was there and no half of the new."""
    fs, at = _files(rows.sparkSession, path)
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    try:
        write(rows, staged)
        fs.delete(at(path), True)
        if not fs.rename(at(staged), at(path)):
            raise OSError(f"{staged} could not be renamed")
    finally:
        fs.delete(at(staged), True)


def replace_glyphs(new: DataFrame, path: str) -> None:
    """A glyph table of (stem, ...) in place of the one at ``path``, whose fallback glyphs are kept where ``new`` lacks them."""
    spark = new.sparkSession
    fs, at = _files(spark, path)
    if fs.exists(at(path)):
        old = spark.read.schema(new.schema).parquet(path).filter(F.contains("stem", F.lit("_fallback")))
        new = new.unionByName(old.join(new.select("stem"), "stem", "left_anti").select(new.columns))
    written_whole(new, path, lambda rows, staged: rows.write.parquet(staged))


def export_png(glyphs: DataFrame, path: str) -> int:
    """A file `stem.png` for each row of (stem, png) of one bank, for other tools; their number.

    Spark's sinks give files no names, so the driver writes these, a row at a time. Large tables stay Parquet.
    """
    fs, at = _files(glyphs.sparkSession, path)
    count = 0
    for row in glyphs.select("stem", "png").toLocalIterator():
        out = fs.create(at(f"{path.rstrip('/')}/{row['stem']}.png"), True)
        out.write(bytearray(row["png"]))
        out.close()
        count += 1
    return count


def json_page(rows: DataFrame, png_column: str = "png") -> DataFrame:
    """(value): each row as JSON, its image as base64 text."""
    return rows.select(F.to_json(F.struct(*[F.base64(c).alias(c) if c == png_column else F.col(c) for c in rows.columns])).alias("value"))


def write_report(report: DataFrame, path: str) -> None:
    """A report, one row or a row a case, as JSON lines in place of the one before."""
    written_whole(report, path, lambda rows, staged: rows.coalesce(1).write.json(staged))


def scorecard(scores: DataFrame, version: str, baseline: dict[str, float]) -> DataFrame:
    """(value): the scorecard as JSON: results, their differences from a baseline, and the baseline. ``scores`` is one row."""
    results = F.struct(*[F.round(c, 2).alias(c) for c in scores.columns])
    delta = F.struct(*[F.round(F.col(c) - v, 2).alias(c) for c, v in baseline.items() if c in scores.columns])
    return scores.select(F.to_json(F.struct(F.lit(version).alias("version"), F.struct(*[F.lit(v).alias(k) for k, v in baseline.items()]).alias("baseline"), results.alias("results"), delta.alias("delta_vs_baseline"))).alias("value"))


def _thumb(glyph: np.ndarray) -> np.ndarray:
    """A glyph scaled to fit and centred on the sheet's ground."""
    scale = min(THUMB[0] / max(1, glyph.shape[1]), THUMB[1] / max(1, glyph.shape[0]))
    w, h = max(1, int(glyph.shape[1] * scale)), max(1, int(glyph.shape[0] * scale))
    layer = np.zeros((THUMB[1], THUMB[0], 4), np.uint8)
    x, y = (THUMB[0] - w) // 2, (THUMB[1] - h) // 2
    layer[y : y + h, x : x + w] = kernels.resize(glyph, h, w)
    ground = np.broadcast_to(np.array(GROUND, np.uint8), (THUMB[1], THUMB[0], 3))
    return kernels.composite(ground, layer, INK, softness=0, noise=0)


def sheet_images(glyphs: DataFrame, sheet: str = "sheet") -> DataFrame:
    """(sheet, n, png) of (sheet, stem, width, height, png): rows of 16 framed thumbnails by stem, with room for a label.

    The strips of 16 are drawn on their own, so a long sheet isn't one task's raster until it is put together.
    """
    placed = contact_sheet(glyphs, sheet, ["stem"], COLUMNS, THUMB).select(sheet, F.col("sheet_row").cast("long").alias("row"), F.col("sheet_col").cast("long").alias("col"), "png")
    strips = placed.groupBy(sheet, "row").agg(F.array_sort(F.collect_list(F.struct("col", "png"))).alias("cells"))
    cell_w, cell_h = THUMB[0] + 2, THUMB[1] + LABEL + 4

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for cells in frame["cells"]:
                strip = np.empty((cell_h, COLUMNS * cell_w + 2, 3), np.uint8)
                strip[:] = GROUND
                for c in cells:
                    x = c["col"] * cell_w + 2
                    strip[3 : cell_h - 1, x - 1 : x + THUMB[0] + 1] = FRAME
                    strip[4 : cell_h - 2, x : x + THUMB[0]] = GROUND
                    strip[4 : 4 + THUMB[1], x : x + THUMB[0]] = _thumb(png.decode(bytes(c["png"])))
                out.append(strip.tobytes())
            yield frame.assign(strip=out, n=[len(c) for c in frame["cells"]])[[sheet, "row", "n", "strip"]]

    kind = dict(glyphs.dtypes)[sheet]
    drawn = strips.mapInPandas(draw, f"{sheet} {kind}, row long, n long, strip binary")
    sheets = drawn.groupBy(sheet).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("row", "strip"))).alias("strips"))

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pages = [np.concatenate([np.frombuffer(bytes(s["strip"]), np.uint8).reshape(cell_h, -1, 3) for s in strips]) for strips in frame["strips"]]
            yield pd.DataFrame({sheet: frame[sheet], "n": frame["n"], "png": [png.encode(p) for p in pages]})

    return sheets.mapInPandas(join, f"{sheet} {kind}, n long, png binary")
