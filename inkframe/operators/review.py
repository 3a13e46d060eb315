"""Review of extracted glyphs: rows of the review page, its filters and orders, cleaning rules, checks and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.functions import codec
from inkframe.operators.quality import WIDE
from inkframe.sources.dims import DIGITS, LOWER, TEMPLATE_NGRAMS, UPPER, map_of

# What a template can hold, characters that may be wide and flat, explicit source methods.
VALID = (*LOWER, *UPPER, *DIGITS, *".,!?'-:;()#@&/\"", *TEMPLATE_NGRAMS)
FLAT = (".", ",", "-", "'", '"', ":", ";", "!", "?")
ORDERS = ("char", "quality", "size", "ar")


def quality_reason(char: Column, w: Column, h: Column, ink: Column) -> Column:
    """A struct of quality and reason, by the first rule that fits."""
    most = F.when(char.isin(*WIDE), 3.5).otherwise(2.2)
    said = lambda quality, reason: F.struct(F.lit(quality).alias("quality"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    return (
        F.when((w < 8) | (h < 8), said("rejected", "too small"))
        .when(w / h > most, said("rejected", F.format_string("AR %.2f > %.1f", (w / h).cast("double"), most.cast("double"))))
        .when(w / h < 0.15, said("rejected", "too narrow"))
        .when(ink < 50, said("rejected", "insufficient ink"))
        .when(ink < 150, said("warning", "low ink count"))
        .otherwise(said("good", ""))
    )


def review_rows(glyphs: DataFrame, profile: Column) -> DataFrame:
    """The review page's rows of (stem, char, variant, w, h, ink, span): a glyph that would only be warned of and whose
    ink spans under 15 rows is skipped by the loader."""
    judged = glyphs.withColumn("q", quality_reason(F.col("char"), F.col("w"), F.col("h"), F.col("ink")))
    skipped = (F.col("q.quality") == "warning") & (F.col("span") < 15)
    file = F.concat("stem", F.lit(".png"))
    return judged.select(
        file.alias("filename"), "char", "variant", F.col("w").alias("width"), F.col("h").alias("height"), F.round(F.col("w") / F.greatest("h", F.lit(1)), 3).alias("aspect_ratio"), F.col("ink").alias("ink_pixels"),
        F.when(skipped, "skipped").otherwise(F.col("q.quality")).alias("quality"), F.when(skipped, "loader skips (short ink span)").otherwise(F.col("q.reason")).alias("quality_reason"),
        codec.category(F.col("char")).alias("category"), F.concat(F.lit("/api/glyph-image/"), profile, F.lit("/"), file).alias("image_url"),
    )


def review_filter(rows: DataFrame, shown: str = "all") -> DataFrame:
    """All rows, those that aren't good (`flagged`), or those of a category."""
    return rows if shown == "all" else rows.filter("quality <> 'good'") if shown == "flagged" else rows.filter(F.col("category") == shown)


def review_order(order: str = "char") -> list[Column]:
    """The columns that a review page is sorted by; ties by file name."""
    level = F.element_at(map_of({"rejected": 0, "skipped": 1, "warning": 2, "good": 3}), F.col("quality"))
    by = {"char": [F.col("char"), F.col("variant")], "quality": [level], "size": [F.desc(F.col("width") * F.col("height"))], "ar": [F.desc("aspect_ratio")]}
    return [*by[order], F.col("filename")]


def cleaned(glyphs: DataFrame) -> DataFrame:
    """Extracted glyphs (char, w, h) without those of no template character, fake boxes of 60 by 70 and flat lines."""
    fake, line = (F.col("w") == 60) & (F.col("h") == 70), (F.col("w") > 3 * F.col("h")) & ~F.col("char").isin(*FLAT)
    return glyphs.filter(F.col("char").isin(*VALID) & ~fake & ~line)


def size_problems(w: Column, h: Column) -> Column:
    """What the last look at written glyphs finds, as a list."""
    size = F.format_string("(%dx%d)", w.cast("long"), h.cast("long"))
    return F.array_compact(F.array(F.when((w == 60) & (h == 70), "FAKE 60x70"), F.when((w < 10) | (h < 10), F.concat(F.lit("TINY "), size)), F.when(w > 3 * h, F.concat(F.lit("HLINE "), size))))


def extraction_errors(there: Column, loads: Column, w: Column, h: Column, ink: Column, ocr_ok: Column, ncc: Column) -> Column:
    """The six checks of an extracted cell, as a list: a missing or unreadable glyph is nothing else; the content is
    compared by correlation only where the OCR read another character for sure (null: unsure)."""
    share = ink / (w * h)
    errors = F.array_compact(
        F.array(
            F.when(ink < 15, F.format_string("LOW_INK(%d<15)", ink.cast("long"))),
            F.when(share > 0.85, F.format_string("FULL_CELL(%.2f)", share.cast("double"))),
            F.when(~(w / h).between(0.08, 8), F.format_string("BAD_AR(%.2f)", (w / h).cast("double"))),
            F.when((ocr_ok == F.lit(False)) & (ncc < 0.25), F.format_string("MISMATCH(ncc=%.2f)", ncc.cast("double"))),
        )
    )
    return F.when(~there, F.array(F.lit("MISSING"))).when(~loads, F.array(F.lit("LOAD_FAIL"))).otherwise(errors)


def source_method(profile: Column, known: dict[str, str] | None = None) -> Column:
    """How a profile was captured: as listed, else by its name, else freeform."""
    listed = F.element_at(map_of(known), profile) if known else F.lit(None).cast("string")
    return F.coalesce(listed, F.when(profile.contains("template"), "template").otherwise("freeform"))


def coverage_text(found: dict[str, tuple[Column, int]]) -> Column:
    """A line like `Lowercase: 96% | Digits: 70%` of texts like `25/26`; a null text counts as none. Halves go to the even
    number (23 of 26 is 88.5 and then 88), where Java's formats round them up."""
    parts = [F.format_string(f"{name}: %.0f%%", F.rint(F.round(F.split(F.coalesce(text, F.lit(f"0/{total}")), "/")[0].cast("int") / total * 100, 1))) for name, (text, total) in found.items()]
    return F.concat_ws(" | ", *parts)


def zipped(left: DataFrame, right: DataFrame, key: list[str], place: str) -> DataFrame:
    """Rows of the same place; the longer side's last rows have no partner and go."""
    return left.join(right, [*key, place])


def variant_counts(glyphs: DataFrame, alphabet: DataFrame) -> DataFrame:
    """(char, n, flag) of an alphabet: MISSING without a variant, `only 1` with one."""
    n = F.coalesce("n", F.lit(0))
    counts = alphabet.select("char").join(glyphs.groupBy("char").agg(F.count("*").alias("n")), "char", "left")
    return counts.select("char", n.alias("n"), F.when(n == 0, "MISSING").when(n == 1, "only 1").otherwise("").alias("flag"))


def preview(values: Column, most: int = 10) -> Column:
    """The first of a sorted list, for a summary: `a, b, ...`."""
    return F.concat(F.array_join(F.slice(F.array_sort(values), 1, most), ", "), F.when(F.size(values) > most, ", ...").otherwise(""))


def by_position(cells: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Cells with the glyph found at their page and place; cells without a label, or beyond the grid, have none."""
    return cells.filter("label IS NOT NULL").join(glyphs, ["page", "cell"], "left")


