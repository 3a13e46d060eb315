"""Text operators: tokens, case fallback against a bank, pair tables, variants, widths and line layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkframe.functions.codec import swap_case
from inkframe.sources.dims import KERNING, LIGATURES, MATCH_NGRAMS, TALL, map_of

SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def bank_ngrams(bank: DataFrame) -> tuple[str, ...]:
    """The n-grams that a bank has glyphs of, longest first: at most those that are known."""
    held = {r["char"] for r in bank.filter(F.col("char").isin(*MATCH_NGRAMS)).select("char").distinct().collect()}
    return tuple(n for n in MATCH_NGRAMS if n in held)


def tokens(text: Column, ngrams: tuple[str, ...] = MATCH_NGRAMS) -> Column:
    """Longest n-grams first, in any case, else single characters; white space parts.

    Give the n-grams that the bank has (`bank_ngrams`): others are set by their letters.
    """
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?is)({'|'.join([*ngrams, ''])}[^\\x20\\x09-\\x0D])"), F.lit(1))
    return F.transform(found, lambda t: F.when(F.length(t) > 1, F.lower(t)).otherwise(t))


def characters(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")


def with_fallback(tokens: DataFrame, bank: DataFrame, token: str = "token") -> DataFrame:
    """Adds ``char`` (the bank's key for a token: itself, else in swapped case, else null) and ``k`` (its variants).

    ``bank`` has a row for each glyph; its keys are a dimension table and are broadcast by size.
    """
    keys = bank.groupBy("char").agg(F.count("*").alias("k"))
    exact = keys.select(F.col("char").alias("exact"), F.col("k").alias("exact_k"))
    other = keys.select(F.col("char").alias("other"), F.col("k").alias("other_k"))
    swapped = F.when(F.length(token) == 1, swap_case(F.col(token)))
    joined = tokens.join(exact, F.col(token) == F.col("exact"), "left").join(other, swapped == F.col("other"), "left")
    return joined.withColumns({"char": F.coalesce("exact", "other"), "k": F.coalesce("exact_k", "other_k")}).drop("exact", "exact_k", "other", "other_k")


def variant_uses(counts: DataFrame, bank: DataFrame) -> DataFrame:
    """How often round robin uses each variant: of n uses of a key with k variants, variant v has ceil((n - v) / k).

    No order of the text is needed, so no window over its tokens.
    """
    uses = F.greatest(F.lit(0), F.floor((F.col("n") - F.col("variant") + F.col("k") - 1) / F.col("k"))).cast("long")
    return counts.join(bank, "char").withColumn("uses", uses).filter("uses > 0")


def round_robin(rows: DataFrame, document: list[str], key: str, order: list[str], variants: Column) -> DataFrame:
    """Adds ``variant``: the uses of a key in a document take its variants in turn."""
    at = F.row_number().over(Window.partitionBy(*document, key).orderBy(*order)) - 1
    return rows.withColumn("variant", F.pmod(at, variants).cast("long"))


def kerning(word: Column) -> Column:
    """The factors of the gaps inside a word, by pairs of characters in any case; 1 where there is no pair."""
    pairs = F.when(F.length(word) > 1, F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.lower(F.substring(word, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))
    return F.transform(pairs, lambda p: F.coalesce(F.element_at(map_of(KERNING), p), F.lit(1.0)))


def ligature_delta(text: Column) -> Column:
    """Pixels that all ligature pairs of a text add."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for pair, delta in LIGATURES.items():
        total = total + F.regexp_count(lowered, F.lit(pair)) * delta
    return total.cast("long")


def char_widths(bank: DataFrame, char_height: int, gap: int) -> DataFrame:
    """(char, width): the widest variant scaled to the target height, at most three times the height, and the gap."""
    tall = F.col("char").rlike(r"^\p{Lu}$") | F.col("char").isin(*TALL)
    target = F.when(tall, int(char_height * 1.4)).otherwise(char_height)
    width = F.greatest(F.lit(1), F.least((F.col("w") * target / F.greatest(F.col("h"), F.lit(1))).cast("int"), F.lit(3 * char_height)))
    return bank.groupBy("char").agg((F.max(width) + gap).cast("long").alias("width"))


def width_of(word: Column, sizes: dict[str, int], default: int) -> Column:
    """The sum of a word's character widths; a character that ``sizes`` lacks in either case has the default.

    Each character is translated to one whose code point is its width, so nothing is exploded or joined.
    """
    widths = {c.swapcase(): w for c, w in sizes.items() if len(c) == 1 and len(c.swapcase()) == 1} | {c: w for c, w in sizes.items() if len(c) == 1}
    base, other = 0x100, "\u0001"
    known = "".join(sorted(widths))
    bare = F.regexp_replace(word, "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in known) + "]", other)
    coded = F.translate(bare, known + other, "".join(chr(base + widths[c]) for c in known) + chr(base + default))
    return F.aggregate(F.split(coded, ""), F.lit(0).cast("long"), lambda total, c: total + F.when(c != "", F.ascii(c) - base).otherwise(0))


def word_widths(docs: DataFrame, key: str, bank: DataFrame, char_height: int = 30, gap: int = 2) -> DataFrame:
    """(key, pos, word, width) for each word; characters outside the bank take three tenths of the height.

    The bank's widths, a dimension table of a row a character, are literals of the plan.
    """
    sizes = {r["char"]: r["width"] for r in char_widths(bank, char_height, gap).collect()}
    spread = docs.select(key, F.posexplode(words(F.col("text"))).alias("pos", "word"))
    return spread.withColumn("width", width_of(F.col("word"), sizes, int(char_height * 0.3)))


def wrap_lines(words: DataFrame, key: str, left: int = 100, right: int = 1100, gap: int = 30) -> DataFrame:
    """The deterministic layout fold: (key, n_words, n_lines, last_x). ``words``: (key, pos, width).

    A word goes to a new line where it would pass the right edge, unless the line has hardly begun.
    """
    ordered = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "width"))).alias("ws"))
    start = F.struct(F.lit(left).cast("long").alias("x"), F.lit(1).cast("long").alias("line"))

    def step(acc: Column, w: Column) -> Column:
        wraps = (acc["x"] + w["width"] > right) & (acc["x"] > left + 50)
        x = F.when(wraps, F.lit(left)).otherwise(acc["x"])
        return F.struct((x + w["width"] + gap).cast("long").alias("x"), (acc["line"] + F.when(wraps, 1).otherwise(0)).cast("long").alias("line"))

    folded = ordered.select(key, F.size("ws").cast("long").alias("n_words"), F.aggregate("ws", start, step).alias("at"))
    return folded.select(key, "n_words", F.col("at.line").alias("n_lines"), F.col("at.x").alias("last_x"))
