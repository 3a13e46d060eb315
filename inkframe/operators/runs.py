"""Runs, gaps and windows over signals: rows (key..., i, v) in, intervals out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def signal(df: DataFrame, key: str, array: str) -> DataFrame:
    """(key, i, v) of an array column."""
    return df.select(key, F.posexplode(array).alias("i", "v")).select(key, F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))


def find_runs(rows: DataFrame, key: str, threshold: float = 0.0) -> DataFrame:
    """(key, start, stop) of the half-open runs above the threshold."""
    above = rows.filter(F.col("v") > threshold)
    island = F.col("i") - F.row_number().over(Window.partitionBy(key).orderBy("i"))
    return above.withColumn("island", island).groupBy(key, "island").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop")).drop("island")


def merge_runs(intervals: DataFrame, key: str, min_gap: int) -> DataFrame:
    """Disjoint runs joined where the gap to the one before is under ``min_gap``."""
    w = Window.partitionBy(key).orderBy("start")
    new = F.when(F.col("start") - F.lag("stop").over(w) < min_gap, 0).otherwise(1)
    marked = intervals.withColumn("new", new).withColumn("grp", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "grp").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("grp")


def moving_average(rows: DataFrame, key: str, width: int) -> DataFrame:
    """Adds ``smooth``: the mean over an odd width, zeros beyond the ends."""
    half = (width - 1) // 2
    return rows.withColumn("smooth", F.sum("v").over(Window.partitionBy(key).orderBy("i").rowsBetween(-half, half)) / width)


def gaps(rows: DataFrame, key: list[str] | str, at: Column, end: Column | None = None) -> DataFrame:
    """Adds ``gap``: from a row's end (or place) to the next row's place, null for the last."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy("at", "tie")
    return rows.withColumn("at", at).withColumn("gap", F.lead("at").over(w) - (end if end is not None else F.col("at")))


def largest_gap(with_gaps: DataFrame, key: str) -> DataFrame:
    """(key, split_at, largest_gap); of equal gaps the later one."""
    return with_gaps.filter("gap IS NOT NULL").groupBy(key).agg(F.max(F.struct("gap", "at")).alias("m")).select(key, F.col("m.at").alias("split_at"), F.col("m.gap").alias("largest_gap"))


def segment(with_gaps: DataFrame, key: str, expected: Column, scales: tuple[float, ...] = (1.0, 0.8, 1.2, 0.6, 1.5)) -> DataFrame:
    """(key, words, scale): words parted at gaps of 1.3 medians times the first scale that gives the expected number, else times 1."""
    own = with_gaps.filter("gap IS NOT NULL").groupBy(key).agg(F.expr("percentile(gap, 0.5)").alias("median"))
    joined = with_gaps.filter("gap IS NOT NULL").join(own, key)
    counts = joined.groupBy(key).agg(*[(F.count_if(F.col("gap") >= F.col("median") * 1.3 * s) + 1).alias(f"n{k}") for k, s in enumerate(scales)])
    counts = counts.withColumn("want", expected)
    choice = F.lit(None).cast("int")
    for k in reversed(range(len(scales))):
        choice = F.when(F.col(f"n{k}") == F.col("want"), k).otherwise(choice)
    choice = F.coalesce(choice, F.lit(0))
    return counts.select(key, F.get(F.array(*[f"n{k}" for k in range(len(scales))]), choice).alias("words"), F.get(F.array(*map(F.lit, scales)), choice).alias("scale"))


def nearest_interval(points: DataFrame, lines: list[tuple[int, float, float]], value: Column) -> DataFrame:
    """Adds ``line``: the interval (line, start, stop) that a value lies in or is nearest to; of equals the first.

    The intervals are a short literal list, so nothing is joined.
    """
    choices = [F.struct(F.greatest(F.lit(a) - value, value - F.lit(b), F.lit(0.0)).alias("d"), F.lit(k).cast("long").alias("line")) for k, a, b in lines]
    return points.withColumn("line", F.array_min(F.array(*choices))["line"])


def gaussian(values: Column, sigma: float, truncate: float = 4.0) -> Column:
    """An array smoothed by a Gaussian cut at ``truncate`` sigmas, mirrored at its ends; empty stays empty."""
    reach = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    weights = [w / sum(raw) for w in raw]

    def whole(v: Column) -> Column:
        n = F.size(v)

        def near(i: Column) -> Column:
            j = F.pmod(i, 2 * n)
            return F.get(v, F.when(j < n, j).otherwise(2 * n - 1 - j)).cast("double")

        def smooth(i: Column) -> Column:
            steps = F.array(*[F.struct(F.lit(k - reach).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(weights)])
            return F.aggregate(steps, F.lit(0.0), lambda total, s: total + s["w"] * near(i + s["k"]))

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), smooth)).when(n == 0, F.array().cast("array<double>"))

    return F.get(F.transform(F.array(values), whole), F.lit(0))  # bound once, or each access would compute the array again


def split_bands(bands: DataFrame, key: str, values: str, sigma: float = 3.0, valley: float = 0.2, min_gap: int = 4) -> DataFrame:
    """(key, start, stop): bands parted where their smoothed signal falls to ``valley`` of its maximum or less; a band
    with at most one part stays as it is. ``bands``: (key, start, stop, values of the band)."""
    rows = bands.select(F.struct(key, "start", "stop").alias("band"), F.posexplode(gaussian(F.col(values), sigma)).alias("i", "s"))
    most = F.max("s").over(Window.partitionBy("band"))
    rows = rows.withColumn("v", F.col("s") - valley * F.when(most > 0, most).otherwise(1.0))
    parts = merge_runs(find_runs(rows.select("band", F.col("i").cast("long").alias("i"), "v"), "band"), "band", min_gap)
    n = F.count("*").over(Window.partitionBy("band"))
    split = parts.withColumn("n", n).filter("n > 1").select(F.col(f"band.{key}").alias(key), (F.col("band.start") + F.col("start")).alias("start"), (F.col("band.start") + F.col("stop")).alias("stop"), "band")
    whole = bands.join(split.select(F.col(f"band.{key}").alias(key), F.col("band.start").alias("start")).distinct(), [key, "start"], "left_anti")
    return whole.select(key, "start", "stop").unionByName(split.drop("band"))


def places(rows: DataFrame, by: list[str], rank: Column, key: str, name: str, span: int = 65_536) -> DataFrame:
    """Adds ``name``: the place, from 1, of each row among those of ``by``, by rank and then by a whole-number key.

    Rows are numbered in stretches of ``span`` keys, and the stretches' sizes are summed up beside them, so
    a group with a third of all rows isn't one task's.
    """
    cut = rows.withColumns({"_rank": rank, "_span": F.floor(F.col(key) / span)})
    parts = [*by, "_rank", "_span"]
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_rank", "_span").rowsBetween(Window.unboundedPreceding, -1))
    sizes = cut.groupBy(*parts).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*parts).orderBy(key))
    return cut.join(sizes, parts).withColumn(name, (F.col("_before") + own).cast("long")).drop("_rank", "_span", "_before")
