"""Style scores of handwriting, 0 to 100, as aggregate columns over component rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkframe.functions.params import clamp


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def size_consistency(h: Column) -> Column:
    return clamp(100.0 * (1 - F.stddev_pop(h) / F.avg(h) / 0.5))


def average_size(h: Column, image_height: float) -> Column:
    return clamp(median(h) / image_height / 0.08 * 100.0)


def slant_score(angle: Column) -> Column:
    return clamp(50.0 + median(angle) * 50.0 / 30.0)


def slant_consistency(angle: Column) -> Column:
    return clamp(100.0 * (1 - F.stddev_pop(angle) / 20.0))


def pressure(width: Column) -> Column:
    return clamp(150.0 * F.stddev_pop(width) / F.greatest(F.lit(1.0), F.avg(width)))


def letter_like(area: Column, w: Column, h: Column, page_w: int, page_h: int) -> Column:
    """Components of a letter's size and shape."""
    low_h = max(5, page_h // 80)
    return area.between(max(15, 3 * low_h), 0.04 * page_w * page_h) & h.between(low_h, page_h // 3) & w.between(3, 0.25 * page_w) & (w / h).between(0.05, 6)


def baseline_straightness(rows: DataFrame, line: str, least: int = 4) -> DataFrame:
    """(line, n, residual): mean distance of bottoms from the line's fit over its median height. ``rows``: (line, x, bottom, h)."""
    fit = rows.groupBy(line).agg(F.count("*").alias("n"), F.regr_slope("bottom", "x").alias("a"), F.regr_intercept("bottom", "x").alias("b"), median(F.col("h")).alias("m")).filter(F.col("n") >= least)
    off = rows.join(fit, line).groupBy(line, "n").agg(F.avg(F.abs(F.col("bottom") - (F.col("a") * F.col("x") + F.col("b")))).alias("d"), F.first("m").alias("m"))
    return off.select(line, "n", (F.col("d") / F.col("m")).alias("residual"))


def margin_and_spacing(rows: DataFrame, page: str, line: str, width: float) -> DataFrame:
    """(page, margin, spacing) from rows (page, line, left, centre, h); 70 and 50 where a page has one line."""
    lines = rows.groupBy(page, line).agg(F.min("left").alias("left"), F.avg("centre").alias("centre"), F.avg("h").alias("h"))
    gap = F.lead("centre").over(Window.partitionBy(page).orderBy(line)) - F.col("centre")
    pages = lines.withColumn("gap", gap).groupBy(page).agg(F.count("*").alias("n"), F.stddev_pop("left").alias("s"), F.avg("gap").alias("g"), F.avg("h").alias("h"))
    margin = F.when(F.col("n") >= 2, clamp(100.0 * (1 - F.col("s") / width / 0.05))).otherwise(70.0)
    return pages.select(page, margin.alias("margin"), F.coalesce(clamp((F.col("g") / F.col("h") - 1) * 28.0), F.lit(50.0)).alias("spacing"))
