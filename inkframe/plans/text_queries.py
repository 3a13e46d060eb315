"""Queries over texts: tokens, banks, coverage, codec and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.functions import codec
from inkframe.operators import quality, text
from inkframe.plans import sqltext as sql
from inkframe.runtime import spread
from inkframe.sources import dims


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose rows take much work."""
    return spread(read(spark, sf_dir, name).select(*columns))


#: N-grams of the bank that texts are set with; the others are set by their letters.
HELD = ("ing", "th", "he")


def glyph_review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs that setting all documents uses, reviewed: uses by category and quality."""
    bank = dims.dummy_bank(spark, HELD)
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    counts = docs.select("doc_id", F.explode(text.tokens(F.col("text"), text.bank_ngrams(bank))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    found = text.with_fallback(counts, bank)
    kind = codec.category(F.col("token")).alias("category")
    missing = found.filter("char IS NULL").select(kind, F.lit("missing").alias("quality"), F.col("n").alias("uses"))
    used = text.variant_uses(found.filter("char IS NOT NULL"), bank)
    judged = used.select(kind, quality.review_quality(F.col("char"), F.col("w"), F.col("h"), F.col("ink_w") * F.col("ink_h")).alias("quality"), "uses")
    return judged.unionByName(missing).groupBy("category", "quality").agg(F.sum("uses").alias("uses")).orderBy("category", "quality")


def char_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = texts(spark, sf_dir, "documents", "text").select(F.explode(text.characters(F.col("text"))).alias("char")).groupBy("char").agg(F.count("*").alias("n"))
    rows = dims.alphabet(spark).join(chars, "char", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("char", "class", "n", F.when(F.col("n") == 0, "missing").when(F.col("n") < 3, "low").otherwise("sufficient").alias("status"))


def char_coverage_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "lang", "text").filter("lang IS NOT NULL")
    chars = docs.select("lang", F.explode(F.array_distinct(text.characters(F.col("text")))).alias("char")).distinct()
    return quality.coverage(chars, dims.alphabet(spark), ["lang"])


def missing_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read(spark, sf_dir, "benchmark").select(F.explode(text.characters(F.col("text"))).alias("char")).distinct()
    return dims.alphabet(spark).join(seen, "char", "left_anti").groupBy("class").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("char")), "").alias("chars"))


def bank_coverage_case_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read(spark, sf_dir, "benchmark").select(F.explode(text.characters(F.col("text"))).alias("token")).filter("token NOT RLIKE '^[\\\\x20\\\\x09-\\\\x0D]$'").distinct()
    found = text.with_fallback(seen, dims.dummy_bank(spark))
    return found.agg(F.count("*").alias("seen"), F.count("char").alias("covered"), F.count_if(F.col("char") != F.col("token")).alias("by_other_case"), F.round(F.count("char") / F.count("*") * 100, 2).alias("pct"))


def ngram_tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.filter("t", lambda t: F.length(t) > 1)).cast("long").alias("n_ngrams"))


def ligature_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", text.ligature_delta(F.col("text")).alias("delta_px"))


def kerning_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = F.flatten(F.transform(text.words(F.col("text")), text.kerning))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", factors.alias("f"))
    count = lambda test: F.size(F.filter("f", test)).cast("long")
    return rows.select("conv_id", "turn", F.size("f").cast("long").alias("gaps"), count(lambda x: x < 1).alias("tight"), count(lambda x: x > 1).alias("loose"))


def variant_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = dims.dummy_bank(spark, HELD)
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text.tokens(F.col("text"), text.bank_ngrams(bank))).alias("pos", "token"))
    found = text.with_fallback(rows, bank).filter("char IS NOT NULL")
    placed = text.round_robin(found, ["conv_id"], "char", ["turn", "pos"], F.col("k"))
    return placed.groupBy("conv_id", "char", "variant").agg(F.count("*").alias("uses"), F.min(F.struct("turn", "pos"))["pos"].cast("long").alias("first_pos"))


def peek_word_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    widths = text.word_widths(texts(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", dims.dummy_bank(spark))
    return widths.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.sum("width").alias("total_width"), F.max("width").alias("max_width"))


def layout_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    widths = text.word_widths(read(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", dims.dummy_bank(spark))
    return text.wrap_lines(widths, "item_id")


def template_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.template_cells(spark)


def stem_codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = dims.template_cells(spark).filter("label IS NOT NULL").select("label", "variant", "display")
    stem = F.concat(codec.stem_of(F.col("display")), F.lit("_"), F.col("variant").cast("string"))
    named = cells.withColumn("stem", stem)
    return named.select("stem", "display", codec.parse_stem(F.col("stem")).alias("parsed"), codec.parse_stem(F.col("stem"), "migrate").alias("migrated"), codec.category(F.col("display")).alias("category"))


def manifest_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = dims.template_cells(spark).filter("label IS NOT NULL")
    bank = dims.dummy_bank(spark).select(F.col("char").alias("display"), "variant", (F.col("ink_w") * F.col("ink_h")).alias("ink"))
    joined = cells.join(bank, ["display", "variant"], "left")
    status = F.when(F.col("ink").isNull(), "MISSING").when(F.col("ink") < 50, "LOW_INK").otherwise("OK")
    return joined.groupBy("page", status.alias("status")).agg(F.count("*").alias("n"))


def score_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = dims.template_cells(spark).filter("label IS NOT NULL")
    bank = dims.dummy_bank(spark).select(F.col("char").alias("display"), "variant", (F.col("ink_w") * F.col("ink_h")).alias("ink"))
    return cells.join(bank, ["display", "variant"], "left").agg(F.count_if(F.col("ink") >= 15).alias("score"), F.count_if(F.col("ink").isNull() | (F.col("ink") < 15)).alias("blank"), F.count("*").alias("total"))


def bank_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n")).withColumn("origin", F.lit("base"))
    other = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n")).withColumn("origin", F.lit("override"))
    return quality.overlay(base, other, "nation")


def phrase_category_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    header = F.when(F.col("role") == "user", F.col("turn"))
    return rows.select("conv_id", "turn", "role", quality.forward_fill(rows, ["conv_id"], ["turn"], header).alias("category"))


def profile_rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rules = {
        "blank": F.length(F.trim(F.coalesce("text", F.lit("")))) == 0,
        "short": F.length("text") < 60,
        "long": F.length("text") > 10_000,
        "no_upper": ~F.col("text").rlike(r"\p{Lu}"),
        "digits": F.col("text").rlike("[0-9]{9}"),
        "size_differs": F.length("text") != F.col("n_chars"),
    }
    return quality.breaches(docs, ["doc_id"], rules)


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.stratified(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", F.col("doc_id"), 20)


QUERIES = {f.__name__: f for f in (glyph_review_summary, char_frequency, char_coverage_by_class, missing_chars, bank_coverage_case_fallback, ngram_tokenise, ligature_spacing, kerning_pairs, variant_round_robin, peek_word_width, layout_wrap, template_cells, stem_codec_roundtrip, manifest_left_join, score_blank, bank_overlay, phrase_category_ffill, profile_rule_violations, stratified_sample)}

_WIDTHS = f"""{sql.BANK},
sizes AS (SELECT char, CAST(max(greatest(1, least(CAST(trunc(w * (CASE WHEN regexp_matches(char, '^\\p{{Lu}}$') OR char IN ('b','d','f','h','k','l','t') THEN 42 ELSE 30 END) / h) AS INTEGER), 90))) + 2 AS BIGINT) AS width FROM bank GROUP BY char)"""


def _word_widths(key: str, table: str) -> str:
    return f"""{_WIDTHS},
ws AS (SELECT {key}, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM (SELECT {key}, {sql.WORDS} AS w FROM {table})),
cs AS (SELECT {key}, pos, unnest({sql.CHARS.format('word')}) AS token FROM ws),
widths AS (SELECT cs.{key}, cs.pos, CAST(sum(coalesce(a.width, b.width, 9)) AS BIGINT) AS width FROM cs LEFT JOIN sizes a ON a.char = cs.token LEFT JOIN sizes b ON b.char = {sql.SWAP.format('cs.token')} GROUP BY 1, 2)"""


_FOUND = f"LEFT JOIN keys a ON a.char = t.token LEFT JOIN keys b ON length(t.token) = 1 AND b.char = {sql.SWAP.format('t.token')}"

ORACLES = {
    "glyph_review_summary": f"""
WITH {sql.bank_with(HELD)}, {sql.KEYS},
t AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({sql.bank_tokens(HELD)}) AS token FROM documents) GROUP BY 1, 2),
f AS (SELECT t.token, t.n, coalesce(a.char, b.char) AS char, coalesce(a.k, b.k) AS k FROM t {_FOUND}),
u AS (SELECT {sql.CATEGORY.format('token')} AS category,
    CASE WHEN w < 8 OR h < 8 OR w / h > (CASE WHEN f.char IN ('m','w','M','W','ing','th','he') THEN 3.5 ELSE 2.2 END) OR w / h < 0.15 OR ink_w * ink_h < 50 THEN 'rejected' WHEN ink_w * ink_h < 150 THEN 'warning' ELSE 'good' END AS quality,
    greatest(0, (n - variant + k - 1) // k) AS uses FROM f JOIN bank ON bank.char = f.char
  UNION ALL SELECT {sql.CATEGORY.format('token')}, 'missing', n FROM f WHERE char IS NULL)
SELECT category, quality, CAST(sum(uses) AS BIGINT) AS uses FROM u WHERE uses > 0 GROUP BY 1, 2""",
    "char_frequency": f"""
WITH {sql.ALPHABET}, c AS (SELECT char, count(*) AS n FROM (SELECT unnest({sql.CHARS.format('text')}) AS char FROM documents) GROUP BY 1)
SELECT a.char, a.class, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n < 3 THEN 'low' ELSE 'sufficient' END AS status FROM alphabet a LEFT JOIN c ON a.char = c.char""",
    "char_coverage_by_class": f"""
WITH {sql.ALPHABET}, c AS (SELECT DISTINCT lang, unnest({sql.CHARS.format('text')}) AS char FROM documents WHERE lang IS NOT NULL),
s AS (SELECT class, count(*) AS total FROM alphabet GROUP BY 1), h AS (SELECT lang, class, count(*) AS covered FROM c JOIN alphabet USING (char) GROUP BY 1, 2)
SELECT l.lang, s.class, coalesce(covered, 0) AS covered, total, round(coalesce(covered, 0) / total * 100, 1) AS pct FROM (SELECT DISTINCT lang FROM c) l CROSS JOIN s LEFT JOIN h ON h.lang = l.lang AND h.class = s.class""",
    "missing_chars": f"""
WITH {sql.ALPHABET}, c AS (SELECT DISTINCT unnest({sql.CHARS.format('text')}) AS char FROM benchmark)
SELECT class, count(*) AS n, string_agg(char, '' ORDER BY char) AS chars FROM alphabet WHERE char NOT IN (SELECT char FROM c) GROUP BY 1""",
    "bank_coverage_case_fallback": f"""
WITH {sql.BANK}, {sql.KEYS}, t AS (SELECT DISTINCT token FROM (SELECT unnest({sql.CHARS.format('text')}) AS token FROM benchmark) WHERE NOT regexp_matches(token, '^[\\x20\\x09-\\x0D]$')),
f AS (SELECT t.token, coalesce(a.char, b.char) AS char FROM t {_FOUND})
SELECT count(*) AS seen, count(char) AS covered, count(*) FILTER (char <> token) AS by_other_case, round(count(char) / count(*) * 100, 2) AS pct FROM f""",
    "ngram_tokenise": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_filter(t, lambda x: length(x) > 1)) AS BIGINT) AS n_ngrams FROM (SELECT doc_id, {sql.TOKENS} AS t FROM documents)",
    "ligature_spacing": "SELECT item_id, CAST(" + " + ".join(f"len(regexp_extract_all(lower(coalesce(text, '')), '{p}')) * {d}" for p, d in dims.LIGATURES.items()) + " AS BIGINT) AS delta_px FROM benchmark",
    "kerning_pairs": f"""
WITH {sql.KERN}, w AS (SELECT conv_id, turn, unnest({sql.WORDS}) AS word FROM conversations),
p AS (SELECT conv_id, turn, lower(substr(word, CAST(i AS INTEGER), 2)) AS pair FROM (SELECT conv_id, turn, word, unnest(range(1, length(word))) AS i FROM w)),
f AS (SELECT p.*, coalesce(factor, 1.0::DOUBLE) AS f FROM p LEFT JOIN kern USING (pair)),
s AS (SELECT conv_id, turn, count(*) AS gaps, count(*) FILTER (f < 1) AS tight, count(*) FILTER (f > 1) AS loose FROM f GROUP BY 1, 2)
SELECT c.conv_id, c.turn, coalesce(gaps, 0) AS gaps, coalesce(tight, 0) AS tight, coalesce(loose, 0) AS loose FROM conversations c LEFT JOIN s ON s.conv_id = c.conv_id AND s.turn = c.turn""",
    "variant_round_robin": f"""
WITH {sql.bank_with(HELD)}, {sql.KEYS}, t AS (SELECT conv_id, turn, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS token FROM (SELECT conv_id, turn, {sql.bank_tokens(HELD)} AS x FROM conversations)),
f AS (SELECT t.*, coalesce(a.char, b.char) AS char, coalesce(a.k, b.k) AS k FROM t {_FOUND}),
r AS (SELECT conv_id, char, turn, pos, (row_number() OVER (PARTITION BY conv_id, char ORDER BY turn, pos) - 1) % k AS variant FROM f WHERE char IS NOT NULL)
SELECT conv_id, char, variant, count(*) AS uses, CAST(arg_min(pos, turn * 1000000 + pos) AS BIGINT) AS first_pos FROM r GROUP BY 1, 2, 3""",
    "peek_word_width": f"WITH {_word_widths('doc_id', 'documents')} SELECT doc_id, count(*) AS n_words, CAST(sum(width) AS BIGINT) AS total_width, max(width) AS max_width FROM widths GROUP BY 1",
    "layout_wrap": f"""
WITH RECURSIVE {_word_widths('item_id', 'benchmark')},
fold AS (
  SELECT item_id, CAST(0 AS BIGINT) AS pos, CAST(100 AS BIGINT) AS x, CAST(1 AS BIGINT) AS line FROM (SELECT DISTINCT item_id FROM widths)
  UNION ALL SELECT f.item_id, f.pos + 1, CASE WHEN f.x + w.width > 1100 AND f.x > 150 THEN 100 ELSE f.x END + w.width + 30, f.line + CASE WHEN f.x + w.width > 1100 AND f.x > 150 THEN 1 ELSE 0 END
  FROM fold f JOIN widths w ON w.item_id = f.item_id AND w.pos = f.pos + 1)
SELECT item_id, max(pos) AS n_words, max(line) AS n_lines, arg_max(x, pos) AS last_x FROM fold GROUP BY 1""",
    "template_cells": f"WITH {sql.cells_sql()} SELECT * FROM cells",
    "stem_codec_roundtrip": f"""
WITH {sql.cells_sql()}, s AS (SELECT label || '_' || variant AS stem, display FROM cells WHERE label IS NOT NULL)
SELECT stem, display, display AS parsed, CASE WHEN stem = 'at_0' THEN '@' WHEN length(display) > 1 THEN NULL ELSE display END AS migrated, {sql.CATEGORY.format('display')} AS category FROM s""",
    "manifest_left_join": f"""
WITH {sql.BANK}, {sql.cells_sql()}
SELECT page, CASE WHEN b.char IS NULL THEN 'MISSING' WHEN ink_w * ink_h < 50 THEN 'LOW_INK' ELSE 'OK' END AS status, count(*) AS n FROM cells c LEFT JOIN bank b ON b.char = c.display AND b.variant = c.variant WHERE label IS NOT NULL GROUP BY 1, 2""",
    "score_blank": f"""
WITH {sql.BANK}, {sql.cells_sql()}
SELECT count(*) FILTER (ink_w * ink_h >= 15) AS score, count(*) FILTER (b.char IS NULL OR ink_w * ink_h < 15) AS blank, count(*) AS total FROM cells c LEFT JOIN bank b ON b.char = c.display AND b.variant = c.variant WHERE label IS NOT NULL""",
    "bank_overlay": """
WITH o AS (SELECT s_nationkey AS nation, count(*) AS n, 'override' AS origin FROM supplier GROUP BY 1)
SELECT * FROM o UNION ALL SELECT c_nationkey, count(*), 'base' FROM customer WHERE c_nationkey NOT IN (SELECT nation FROM o) GROUP BY 1""",
    "phrase_category_ffill": "SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS category FROM conversations",
    "profile_rule_violations": """
SELECT doc_id, unnest(list_filter([CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 'blank' END, CASE WHEN length(text) < 60 THEN 'short' END, CASE WHEN length(text) > 10000 THEN 'long' END,
  CASE WHEN NOT regexp_matches(text, '\\p{Lu}') THEN 'no_upper' END, CASE WHEN regexp_matches(text, '[0-9]{9}') THEN 'digits' END, CASE WHEN length(text) <> n_chars THEN 'size_differs' END], lambda x: x IS NOT NULL)) AS rule FROM documents""",
    "stratified_sample": "SELECT * FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR))) AS place FROM documents) WHERE place <= 20",
}
