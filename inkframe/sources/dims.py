"""Constant tables of the glyph model, as small DataFrames and column maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Character classes, n-grams, pair tables, levels and slider ranges of the glyph model.
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
DIGITS = "0123456789"
BANK_PUNCT = ".,!?'-:;"
TALL = "bdfhklt"
DESCENDERS = "gjpqy"
TEMPLATE_NGRAMS = ("th", "he", "in", "an", "er", "ou", "ed", "re", "on", "es", "ti", "at", "st", "en", "or", "ng", "ing", "the", "and", "tion")
PRINTED_NGRAMS = ("th", "he", "in", "an", "er", "on", "ed", "re", "ou", "es", "ti", "at", "st", "en", "or", "ng", "ing", "the", "and", "tion")
MATCH_NGRAMS = ("tion", "the", "ing", "and", "th", "he", "in", "an", "ed", "en", "er", "es", "ng", "on", "or", "ou", "re", "st", "ti")
PUNCT_NAMES = {
    "period": ".", "comma": ",", "exclaim": "!", "question": "?", "apostrophe": "'", "quote": '"', "hyphen": "-", "colon": ":",
    "semicolon": ";", "lparen": "(", "rparen": ")", "slash": "/", "atsign": "@", "ampersand": "&", "hash": "#", "dollar": "$",
}
MORE_PUNCT_NAMES = {
    "underscore": "_", "percent": "%", "caret": "^", "asterisk": "*", "plus": "+", "equals": "=", "less": "<", "greater": ">",
    "lbracket": "[", "rbracket": "]", "lbrace": "{", "rbrace": "}", "pipe": "|", "backtick": "`", "tilde": "~", "backslash": "\\",
}
KERNING = {
    "av": 0.70, "ay": 0.70, "aw": 0.70, "fa": 0.70, "fo": 0.70, "ly": 0.70, "oy": 0.70, "to": 0.70, "va": 0.70, "vo": 0.70,
    "wa": 0.70, "we": 0.70, "wo": 0.70, "ya": 0.70, "yo": 0.70, "ri": 1.15, "fl": 1.15, "fi": 1.15, "ll": 1.15,
}
LIGATURES = {"th": -3, "he": -2, "in": -2, "re": -2, "an": -1, "on": -1, "en": -1, "er": -1, "ed": -1}
GRIDS = {1: (6, 10), 2: (6, 10), 3: (6, 10), 4: (8, 11)}
PAGE = {"width": 2550, "height": 3300, "left": 150, "right": 150, "top": 285, "bottom": 135}
INKS = {"black": (10, 10, 10), "blue": (15, 25, 110), "dark_blue": (5, 15, 80), "green": (10, 60, 35), "red": (130, 15, 15), "pencil": (80, 80, 80)}
PAPERS = {"college": (42, 30, 204, 120), "wide": (51, 36, 204, 120), "legal": (51, 36, 204, 201), "blank": (55, 40, 100, 150), "graph": (30, 18, 100, 100), "dot": (42, 25, 100, 100), "sticky": (40, 24, 30, 30)}
SLIDERS = ("font_size", "stroke_thickness", "letter_spacing", "word_spacing", "slant", "baseline_straightness", "line_spacing", "margin_consistency", "line_end_behavior", "size_variation", "spacing_variation", "angle_variation", "pressure_variation", "page_fatigue", "ink_fading", "ink_bleed")
PRESETS = {
    "perfect_student": (55, 50, 42, 48, 52, 92, 50, 92, 50, 8, 8, 8, 10, 5, 5, 8),
    "natural_notes": (65, 50, 35, 50, 55, 75, 50, 75, 60, 25, 25, 20, 30, 15, 10, 25),
    "rushed_homework": (42, 50, 35, 58, 45, 42, 55, 38, 82, 55, 55, 52, 55, 58, 32, 42),
    "messy_scrawl": (48, 50, 25, 65, 38, 18, 62, 18, 95, 82, 82, 78, 78, 82, 62, 68),
    "custom": (50,) * 16,
}


def map_of(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def dummy_bank(spark: SparkSession, ngrams: tuple[str, ...] = ()) -> DataFrame:
    """(char, variant, w, h, ink_w, ink_h) of the closed-form bank, and a glyph for each of ``ngrams``."""
    rows = [(c, v, 25 + 3 * v + i % 5, 40 + 2 * v, 6, 6) for i, c in enumerate(LOWER) for v in range(3)]
    rows += [(c, v, 35 + 3 * v, 55 + 2 * v, 6, 6) for c in UPPER for v in range(2)]
    rows += [(c, 0, 8, 15, 4, 6) for c in BANK_PUNCT]
    rows += [(n, 0, 25 * len(n), 40, 6, 6) for n in ngrams]
    return table(spark, [(c, v, w, h, w - a, h - b) for c, v, w, h, a, b in rows], "char string, variant long, w long, h long, ink_w long, ink_h long")


def template_cells(spark: SparkSession, ngrams: tuple[str, ...] = TEMPLATE_NGRAMS) -> DataFrame:
    """(page, cell, row, col, label, variant, display) of all cells; label and display are null in empty ones."""
    pages = {
        1: [(c, v) for c in LOWER[:15] for v in range(4)],
        2: [(c, v) for c in LOWER[15:] for v in range(4)],
        3: [(f"upper_{c}", v) for c in UPPER for v in range(2)],
        4: [(f"digit_{c}", v) for c in DIGITS for v in range(3)] + [(n, v) for n in PUNCT_NAMES for v in range(2)] + [(n, 0) for n in ngrams],
    }
    rows = []
    for page, (cols, height) in GRIDS.items():
        for cell in range(cols * height):
            label, variant = pages[page][cell] if cell < len(pages[page]) else (None, 0)
            rows.append((page, cell, cell // cols, cell % cols, label, variant))
    from inkframe.functions.codec import label_display

    cells = table(spark, rows, "page long, cell long, row long, col long, label string, variant long")
    return cells.withColumn("display", label_display(F.col("label")))


def alphabet(spark: SparkSession) -> DataFrame:
    rows = [(c, k) for k, cs in (("lowercase", LOWER), ("uppercase", UPPER), ("digits", DIGITS), ("punctuation", BANK_PUNCT)) for c in cs]
    return table(spark, rows, "char string, class string")
