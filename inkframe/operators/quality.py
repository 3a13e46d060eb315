"""Quality gates as first-match rules, rule breaches as rows, coverage and per-key statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkframe.sources.dims import TEMPLATE_NGRAMS

WIDE = ("m", "w", "M", "W", *TEMPLATE_NGRAMS)


def extraction_gate(ink: Column, w: Column, h: Column) -> Column:
    ratio = ink / F.greatest(F.lit(1), w * h)
    aspect = w / F.greatest(F.lit(1), h)
    return F.when(ink < 15, "empty").when(ratio > 0.85, "contaminated").when((aspect > 4) | (aspect < 0.08), "oversized").otherwise("good")


def review_quality(char: Column, w: Column, h: Column, ink: Column) -> Column:
    """rejected, warning or good."""
    most = F.when(char.isin(*WIDE), 3.5).otherwise(2.2)
    return F.when((w < 8) | (h < 8), "rejected").when((w / h > most) | (w / h < 0.15) | (ink < 50), "rejected").when(ink < 150, "warning").otherwise("good")


def loader_valid(char: Column, w: Column, h: Column, ink: Column, span: Column) -> Column:
    most = F.when(char.isin(*WIDE), 3.5).otherwise(2.2)
    return (w >= 8) & (h >= 8) & (w / h <= most) & (w / h >= 0.15) & (ink >= 50) & (span >= 15)


def tiered_keep(rows: DataFrame, key: str, tier: Column, ink: str, tie: str) -> DataFrame:
    """All rows of a key's tier 0; where there are none, the one with most ink of its best tier."""
    rows = rows.withColumn("tier", tier)
    best = F.min("tier").over(Window.partitionBy(key))
    place = F.row_number().over(Window.partitionBy(key, "tier").orderBy(F.desc(ink), tie))
    return rows.withColumns({"best": best, "place": place}).filter("tier = best AND (tier = 0 OR place = 1)").drop("best", "place")


def breaches(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, rule): a row for each rule that a row breaks; null conditions count as kept."""
    found = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    return rows.select(*key, F.explode(found).alias("rule"))


def upper_median(value: str) -> Column:
    """An aggregate: the middle value, the larger one of two. It holds distinct values with their counts, not rows."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def coverage(chars: DataFrame, alphabet: DataFrame, by: list[str]) -> DataFrame:
    """(by..., class, covered, total, pct) of the alphabet's classes. ``chars``: (by..., char)."""
    sizes = alphabet.groupBy("class").agg(F.count("*").alias("total"))
    hit = chars.join(alphabet, "char").groupBy(*by, "class").agg(F.count_distinct("char").alias("covered"))
    classes = F.array(*[F.lit(r["class"]) for r in alphabet.select("class").distinct().collect()])  # a handful of names
    keys = chars.select(*by).distinct().withColumn("class", F.explode(classes)).join(sizes, "class") if by else sizes
    joined = keys.join(hit, [*by, "class"], "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return joined.select(*by, "class", "covered", "total", F.round(F.col("covered") / F.col("total") * 100, 1).alias("pct"))


def overlay(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """All rows of ``other``, and those of ``base`` whose key it lacks."""
    return other.unionByName(base.join(other.select(key).distinct(), key, "left_anti"))


def forward_fill(rows: DataFrame, key: list[str], order: list[str], value: Column) -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def stratified(rows: DataFrame, stratum: str, key: Column, n: int) -> DataFrame:
    """``n`` rows of each stratum by an order that depends on the key alone."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(key.cast("string").cast("binary"))))
    return rows.withColumn("place", place.cast("long")).filter(F.col("place") <= n)
