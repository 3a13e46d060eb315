"""Glyph keys as columns: file stem to character and back, display, category, method, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkframe.sources.dims import MORE_PUNCT_NAMES, PUNCT_NAMES, map_of

ALIASES = PUNCT_NAMES | MORE_PUNCT_NAMES


def label_display(label: Column) -> Column:
    named = F.element_at(map_of(PUNCT_NAMES), label)
    return F.when(label.startswith("upper_") | label.startswith("digit_"), label.substr(F.lit(7), F.length(label))).otherwise(F.coalesce(named, label))


def stem_of(char: Column) -> Column:
    """The file stem of a character or n-gram."""
    named = F.element_at(map_of({v: k for k, v in PUNCT_NAMES.items()}), char)
    return F.coalesce(named, F.when(char.rlike(r"^\p{Lu}$"), F.concat(F.lit("upper_"), char)).when(char.rlike(r"^\p{Nd}$"), F.concat(F.lit("digit_"), char)).otherwise(char))


def parse_stem(stem: Column, dialect: str = "loader") -> Column:
    """The character that a stem names, null if none. Dialects `migrate` and `web` read at_0 as @ and know
    no n-grams; `web` gives ? for what it doesn't know."""
    bare = F.regexp_replace(stem, r"_fallback$", "")
    aliases = ALIASES if dialect == "loader" else ALIASES | {"at": "@"}
    alias = F.element_at(map_of(aliases), F.regexp_extract(bare, r"^([a-z]+)(?:_|$)", 1))
    first, last = F.split(bare, "_")[0], F.element_at(F.split(bare, "_"), -1)
    second = F.get(F.split(bare, "_"), F.lit(1))
    ngram = F.when((F.size(F.split(bare, "_")) >= 2) & last.rlike(r"^[0-9]+$") & first.rlike(r"^\p{Ll}+$"), first) if dialect == "loader" else F.lit(None).cast("string")
    found = (
        F.when(alias.isNotNull(), alias)
        .when(bare.startswith("upper_"), F.when(F.length(second) == 1, second))
        .when(bare.startswith("digit_"), F.when(second.rlike(r"^[0-9]+$"), second))
        .when(F.length(first) == 1, first)
        .otherwise(ngram)
    )
    return F.coalesce(found, F.lit("?")) if dialect == "web" else found


def category(char: Column) -> Column:
    return (
        F.when(F.length(char) > 1, "bigrams").when(char.rlike(r"^\p{Ll}$"), "lowercase").when(char.rlike(r"^\p{Lu}$"), "uppercase").when(char.rlike(r"^\p{Nd}$"), "digits").otherwise("punctuation")
    )


def extraction_method(stem: Column, source: Column) -> Column:
    return F.when(stem.endswith("_fallback"), "fallback").when(source == "template", "template_cell").otherwise("connected_component")


def confidence(density: Column, fallback: Column | bool = False) -> Column:
    """Piecewise linear in the ink density."""
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return (
        F.when(fallback, 0.70)
        .when(density < 0.03, 0.20)
        .when(density < 0.08, 0.30 + (density - 0.03) / 0.05 * 0.30)
        .when(density < 0.40, 0.60 + (density - 0.08) / 0.32 * 0.35)
        .otherwise(0.90)
    )


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9_-]", "_")


def swap_case(char: Column) -> Column:
    return F.when(char.rlike(r"^\p{Ll}$"), F.upper(char)).otherwise(F.lower(char))
