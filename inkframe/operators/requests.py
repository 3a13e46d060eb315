"""Requests for a page: defaults, old names of fields, and what is wrong with them, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_given(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def with_defaults(requests: DataFrame, defaults: dict[str, str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Each field of ``defaults`` filled: from itself, else from its alias, else the default."""
    aliases, own = aliases or {}, set(requests.columns)
    filled = {name: first_given(*[F.col(c) for c in (name, aliases.get(name)) if c in own], F.lit(default)) for name, default in defaults.items()}
    return requests.withColumns(filled)


def problems(text: Column, known: dict[str, tuple[Column, list[str]]]) -> Column:
    """What is wrong, as a list: blank text, and each field whose value isn't known."""
    blank = F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit("text"))
    other = [F.when(~F.coalesce(value.isin(names), F.lit(False)), F.lit(field)) for field, (value, names) in known.items()]
    return F.array_compact(F.array(blank, *other))


def listing(profiles: DataFrame, glyphs: DataFrame, key: str, declared: str, letters: int = 26) -> DataFrame:
    """Profiles with their number of glyphs and coverage: the declared one, else from the number, 100 at most."""
    counts = glyphs.groupBy(key).agg(F.count("*").alias("n_glyphs"))
    n = F.coalesce("n_glyphs", F.lit(0))
    guess = F.least(F.lit(100.0), F.round(n * 100.0 / letters, 1))
    return profiles.join(counts, key, "left").withColumns({"n_glyphs": n, "coverage": F.coalesce(declared, guess)})
