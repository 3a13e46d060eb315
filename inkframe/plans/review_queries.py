"""Queries of reviews, checks, summaries, templates and sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.functions import codec
from inkframe.operators import layout, review
from inkframe.plans import sqltext as sql
from inkframe.plans.text_queries import HELD, read
from inkframe.sources import dims, glyphs, sinks, templates


def _review(spark: SparkSession) -> DataFrame:
    bank = dims.dummy_bank(spark, HELD).withColumns({"ink": F.col("ink_w") * F.col("ink_h"), "span": F.col("ink_h"), "stem": F.concat(codec.stem_of(F.col("char")), F.lit("_"), F.col("variant").cast("string"))})
    return review.review_rows(bank, F.lit("p1"))


def review_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review rows of the closed-form bank."""
    return _review(spark)


def review_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the filter `flagged`, in the order of quality."""
    return review.review_filter(_review(spark), "flagged").orderBy(*review.review_order("quality")).select("filename", "quality", "quality_reason")


def extraction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cells: w, h, ink, what the OCR said and the correlation; counts by list of errors."""
    w, h = F.col("l_quantity"), F.col("l_linenumber") * 4
    ink = F.floor(F.col("l_tax") * 1000 * F.col("l_linenumber"))
    said = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)
    errors = review.extraction_errors(F.col("l_linestatus") == "F", F.col("l_discount") > 0.005, w, h, ink, said, F.col("l_discount") * 5)
    return read(spark, sf_dir, "lineitem").groupBy(F.array_join(F.transform(errors, lambda e: F.regexp_extract(e, "^[A-Z_]+", 0)), ",").alias("errors")).agg(F.count("*").alias("n"))


def cleaning_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as extracted glyphs, cleaned; problems that are left, by kind."""
    part = read(spark, sf_dir, "part").select(F.substring("p_name", 1, 1).alias("char"), (F.col("p_size") + 20).alias("w"), F.when(F.col("p_size") == 40, 70).otherwise(F.pmod("p_partkey", F.lit(40)) + 3).alias("h"))
    kept = review.cleaned(part)
    found = F.explode_outer(F.transform(review.size_problems(F.col("w"), F.col("h")), lambda p: F.split(p, " ")[0]))
    return kept.select("char", found.alias("problem")).groupBy("problem").agg(F.count("*").alias("n"), F.count_distinct("char").alias("chars"))


def source_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document sources as profile names."""
    name = F.concat(F.col("source"), F.when(F.col("doc_id") % 3 == 0, "_template").when(F.col("doc_id") % 3 == 1, "_free").otherwise(""))
    return read(spark, sf_dir, "documents").groupBy(review.source_method(name, {"src1": "hybrid", "src2_free": "template"}).alias("method")).agg(F.count("*").alias("n"))


def coverage_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count_distinct(F.col("c_custkey") % 26).alias("n"))
    text = F.concat(F.col("n").cast("string"), F.lit("/26"))
    return counts.select("c_nationkey", review.coverage_text({"Lowercase": (text, 26), "Digits": (F.lit(None).cast("string"), 10)}).alias("line"))


def word_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a turn with those of the next turn, by place; the shorter turn ends the zip."""
    words = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("place", "word"))
    after = words.select("conv_id", (F.col("turn") - 1).alias("turn"), "place", F.col("word").alias("region"))
    found = review.zipped(words, after, ["conv_id", "turn"], "place")
    return found.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.max_by("region", "place").alias("last"))


def variant_shortage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitals that begin documents' texts, as variants of glyphs."""
    used = read(spark, sf_dir, "benchmark").select(F.substring("text", 1, 1).alias("char"))
    return review.variant_counts(used, dims.alphabet(spark).filter("class = 'uppercase'"))


def bank_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.bank_medians(dims.dummy_bank(spark, HELD))


def dry_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small letters that texts of a language lack, the first ten by name."""
    seen = read(spark, sf_dir, "documents").filter("lang IS NOT NULL").select("lang", F.explode(F.array_distinct(F.split(F.substring_index("text", " ", 3), ""))).alias("char")).distinct()
    letters = F.array(*map(F.lit, dims.LOWER + dims.UPPER))
    own = seen.groupBy("lang").agg(F.array_except(letters, F.collect_set("char")).alias("missing"))
    return own.select("lang", F.size("missing").cast("long").alias("n_missing"), review.preview(F.col("missing")).alias("first"))


def worst_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three turns of the lowest share of small letters: a top-k report."""
    share = F.round(F.regexp_count("text", F.lit("[a-z]")) / F.length("text"), 6)
    return read(spark, sf_dir, "conversations").filter("length(text) > 0").select("conv_id", "turn", share.alias("share")).orderBy("share", "conv_id", "turn").limit(3)


def punctuation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Punctuation of the capture sentences, the most frequent first."""
    chars = templates.sentences(spark).select(F.explode(F.split("text", "")).alias("char")).filter("char RLIKE '[^A-Za-z0-9 ]'")
    return chars.groupBy("char").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "char")


def page_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs of a bank's cells, page by page, as one bag of variants."""
    cells = dims.template_cells(spark).filter("label IS NOT NULL")
    bags = [cells.filter(F.col("page") == p).select("display", F.lit(p).alias("page")) for p in dims.GRIDS]
    whole = bags[0]
    for bag in bags[1:]:
        whole = whole.unionAll(bag)
    return whole.groupBy("display").agg(F.count("*").alias("variants"), F.count_distinct("page").alias("pages")).orderBy("display")


def template_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.v1_cells(spark)


def cell_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of all cells by fixed margins and by shares of the page."""
    cells = dims.template_cells(spark).select("page", "cell", "row", "col")
    both = [templates.cell_boxes(cells, by_ratio).withColumn("margins", F.lit(name)) for name, by_ratio in (("fixed", False), ("ratio", True))]
    return both[0].unionByName(both[1])


def paper_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as papers, with how text is set on them; unknown ones are set as on college paper."""
    papers = spark.createDataFrame([(k, *v) for k, v in dims.PAPERS.items()], "paper string, line_height long, char_height long, margin_left long, margin_top long")
    asked = read(spark, sf_dir, "nation").select("n_nationkey", F.get(F.array(*map(F.lit, [*dims.PAPERS, "parchment"])), F.col("n_nationkey").cast("int") % 8).alias("asked"))
    known = asked.join(F.broadcast(papers), asked["asked"] == papers["paper"], "left")
    default = dims.PAPERS["college"]
    return known.select("n_nationkey", "asked", *[F.coalesce(c, F.lit(default[k])).cast("long").alias(c) for k, c in enumerate(("line_height", "char_height", "margin_left", "margin_top"))])


def glyph_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact sheets of the bank by category; sizes and digests."""
    bank = glyphs.with_files(dims.dummy_bank(spark, HELD)).select(codec.category(F.col("char")).alias("sheet"), F.concat("char", F.lit("_"), "variant").alias("stem"), F.col("w").alias("width"), F.col("h").alias("height"), "png")
    return sinks.sheet_images(bank).select("sheet", "n", F.sha2("png", 256).alias("sha256"))


def filled_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four template pages filled in from the bank, at a third of their size; sizes and digests."""
    pages, _ = templates.filled_pages(spark, dims.dummy_bank(spark, HELD), by=3)
    return pages.select("page", F.sha2("png", 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (review_page, review_flagged, extraction_checks, cleaning_rules, source_methods, coverage_line, word_regions, variant_shortage, bank_scale, dry_run_summary, worst_phrases, punctuation_counts, page_bags, template_v1, cell_geometry, paper_settings, glyph_sheets, filled_templates)}

_STEM = "coalesce((SELECT name FROM punct WHERE sign = char), CASE WHEN regexp_matches(char, '^\\p{Lu}$') THEN 'upper_' || char ELSE char END) || '_' || variant"
_REVIEW = f"""{sql.bank_with(HELD)}, punct(name, sign) AS {sql.values([*dims.PUNCT_NAMES.items()])},
g AS (SELECT {_STEM} || '.png' AS filename, char, variant, w, h, ink_w * ink_h AS ink, ink_h AS span, CASE WHEN char IN ('m','w','M','W','ing','th','he') THEN 3.5::DOUBLE ELSE 2.2::DOUBLE END AS most FROM bank),
q AS (SELECT *, CASE WHEN w < 8 OR h < 8 OR w / h > most OR w / h < 0.15 OR ink < 50 THEN 'rejected' WHEN ink < 150 THEN CASE WHEN span < 15 THEN 'skipped' ELSE 'warning' END ELSE 'good' END AS quality,
  CASE WHEN w < 8 OR h < 8 THEN 'too small' WHEN w / h > most THEN printf('AR %.2f > %.1f', w / h, most) WHEN w / h < 0.15 THEN 'too narrow' WHEN ink < 50 THEN 'insufficient ink' WHEN ink < 150 THEN CASE WHEN span < 15 THEN 'loader skips (short ink span)' ELSE 'low ink count' END ELSE '' END AS quality_reason FROM g)"""
_BOXES = """SELECT c.page, c.cell, c."row", c.col, {l} + CAST(floor(c.col * (({w}::DOUBLE - {l} - {r}) / cols)) AS BIGINT) AS x0, {t} + CAST(floor(c."row" * (({h}::DOUBLE - {t} - {b}) / rows)) AS BIGINT) AS y0,
  {l} + CAST(floor((c.col + 1) * (({w}::DOUBLE - {l} - {r}) / cols)) AS BIGINT) AS x1, {t} + CAST(floor((c."row" + 1) * (({h}::DOUBLE - {t} - {b}) / rows)) AS BIGINT) AS y1,
  {t} + CAST(floor(c."row" * (({h}::DOUBLE - {t} - {b}) / rows)) AS BIGINT) + CAST(floor(({h}::DOUBLE - {t} - {b}) / rows * 0.7::DOUBLE) AS BIGINT) AS baseline, '{name}' AS margins FROM cells c JOIN grids g ON g.page = c.page"""

ORACLES = {
    "review_page": f"WITH {_REVIEW} SELECT filename, char, variant, w AS width, h AS height, round(w / greatest(h, 1), 3) AS aspect_ratio, ink AS ink_pixels, quality, quality_reason, {sql.CATEGORY.format('char')} AS category, '/api/glyph-image/p1/' || filename AS image_url FROM q",
    "review_flagged": f"WITH {_REVIEW} SELECT filename, quality, quality_reason FROM q WHERE quality <> 'good' ORDER BY list_position(['rejected', 'skipped', 'warning'], quality), filename",
    "extraction_checks": """
WITH c AS (SELECT l_quantity AS w, l_linenumber * 4 AS h, floor(l_tax * 1000 * l_linenumber) AS ink, l_returnflag AS f, l_discount * 5 AS ncc, l_discount, l_linestatus FROM lineitem)
SELECT CASE WHEN l_linestatus <> 'F' THEN 'MISSING' WHEN l_discount <= 0.005 THEN 'LOAD_FAIL' ELSE concat_ws(',', CASE WHEN ink < 15 THEN 'LOW_INK' END, CASE WHEN ink / (w * h) > 0.85 THEN 'FULL_CELL' END,
  CASE WHEN w / h < 0.08 OR w / h > 8 THEN 'BAD_AR' END, CASE WHEN f = 'R' AND ncc < 0.25 THEN 'MISMATCH' END) END AS errors, count(*) AS n FROM c GROUP BY 1""",
    "cleaning_rules": f"""
WITH p AS (SELECT substr(p_name, 1, 1) AS char, p_size + 20 AS w, CASE WHEN p_size = 40 THEN 70 ELSE p_partkey % 40 + 3 END AS h FROM part),
k AS (SELECT * FROM p WHERE char IN ({', '.join(sql.quote(c) for c in review.VALID)}) AND NOT (w = 60 AND h = 70) AND NOT (w > 3 * h AND char NOT IN ({', '.join(sql.quote(c) for c in review.FLAT)}))),
f AS (SELECT char, unnest(CASE WHEN w < 10 OR h < 10 OR w > 3 * h THEN list_filter([CASE WHEN w < 10 OR h < 10 THEN 'TINY' END, CASE WHEN w > 3 * h THEN 'HLINE' END], lambda x: x IS NOT NULL) ELSE [NULL] END) AS problem FROM k)
SELECT problem, count(*) AS n, count(DISTINCT char) AS chars FROM f GROUP BY 1""",
    "source_methods": """
WITH s AS (SELECT source || CASE doc_id % 3 WHEN 0 THEN '_template' WHEN 1 THEN '_free' ELSE '' END AS name FROM documents)
SELECT CASE WHEN name = 'src1' THEN 'hybrid' WHEN name = 'src2_free' THEN 'template' WHEN contains(name, 'template') THEN 'template' ELSE 'freeform' END AS method, count(*) AS n FROM s GROUP BY 1""",
    "coverage_line": "SELECT c_nationkey, printf('Lowercase: %.0f%% | Digits: 0%%', round(count(DISTINCT c_custkey % 26) / 26.0::DOUBLE * 100, 1)) AS line FROM customer GROUP BY 1",
    "word_regions": """
WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)
SELECT a.conv_id, a.turn, CAST(least(len(a.w), len(b.w)) AS BIGINT) AS n, b.w[least(len(a.w), len(b.w))] AS last FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
    "variant_shortage": f"""
WITH u AS (SELECT substr(text, 1, 1) AS char, count(*) AS n FROM benchmark GROUP BY 1)
SELECT a.char, coalesce(n, 0) AS n, CASE coalesce(n, 0) WHEN 0 THEN 'MISSING' WHEN 1 THEN 'only 1' ELSE '' END AS flag FROM (SELECT unnest(string_split('{dims.UPPER}', '')) AS char) a LEFT JOIN u ON u.char = a.char""",
    "bank_scale": f"WITH {sql.bank_with(HELD)} SELECT median(ink_h::DOUBLE) AS ink_h, median(ink_w::DOUBLE) AS ink_w FROM bank WHERE variant = 0",
    "dry_run_summary": f"""
WITH s AS (SELECT DISTINCT lang, unnest(string_split(array_to_string(string_split(text, ' ')[1:3], ' '), '')) AS char FROM documents WHERE lang IS NOT NULL),
m AS (SELECT l.lang, a.char FROM (SELECT DISTINCT lang FROM s) l, (SELECT unnest(string_split('{dims.LOWER}{dims.UPPER}', '')) AS char) a WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.lang = l.lang AND s.char = a.char)),
r AS (SELECT l.lang, list(m.char ORDER BY m.char) FILTER (m.char IS NOT NULL) AS c FROM (SELECT DISTINCT lang FROM s) l LEFT JOIN m ON m.lang = l.lang GROUP BY 1)
SELECT lang, CAST(coalesce(len(c), 0) AS BIGINT) AS n_missing, coalesce(array_to_string(c[1:10], ', '), '') || CASE WHEN len(c) > 10 THEN ', ...' ELSE '' END AS first FROM r""",
    "worst_phrases": "SELECT conv_id, turn, round(length(regexp_replace(text, '[^a-z]', '', 'g')) / length(text), 6) AS share FROM conversations WHERE length(text) > 0 ORDER BY share, conv_id, turn LIMIT 3",
    "punctuation_counts": f"""
WITH s(text) AS (VALUES {', '.join(f'({sql.quote(s)})' for s in templates.SENTENCES)})
SELECT char, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS char FROM s) WHERE regexp_matches(char, '[^A-Za-z0-9 ]') GROUP BY 1 ORDER BY n DESC, char""",
    "page_bags": f"WITH {sql.cells_sql()} SELECT display, count(*) AS variants, count(DISTINCT page) AS pages FROM cells WHERE label IS NOT NULL GROUP BY 1 ORDER BY 1",
    "template_v1": f"""
WITH p AS (
  SELECT 1 AS page, 8 AS cols, i AS cell, substr('{dims.LOWER}', CAST(i // 4 + 1 AS INTEGER), 1) AS char FROM range(104) t(i)
  UNION ALL SELECT 2, 9, i, CASE WHEN i < 78 THEN substr('{dims.UPPER}', CAST(i // 3 + 1 AS INTEGER), 1) WHEN i BETWEEN 81 AND 100 THEN substr('{dims.DIGITS}', CAST((i - 81) // 2 + 1 AS INTEGER), 1) END FROM range(108) t(i)
  UNION ALL SELECT 3, 8, i, CASE WHEN i < 36 THEN substr({sql.quote(''.join(templates.V1_PUNCT))}, CAST(i // 2 + 1 AS INTEGER), 1) END FROM range(40) t(i))
SELECT CAST(page AS BIGINT) AS page, cell, cell // cols AS "row", cell % cols AS col, char, 36 + cell % cols * 38 AS x, 736 - (cell // cols + 1) * 42 - cell // cols * 14 AS y FROM p""",
    "cell_geometry": f"WITH {sql.cells_sql()} {_BOXES.format(l=150, r=150, t=285, b=135, w=2550, h=3300, name='fixed')} UNION ALL {_BOXES.format(l=150, r=150, t=285, b=135, w=2550, h=3300, name='ratio')}",
    "paper_settings": f"""
WITH p(k, paper, line_height, char_height, margin_left, margin_top) AS {sql.values([(i, k, *v) for i, (k, v) in enumerate(dims.PAPERS.items())] + [(7, 'parchment', *dims.PAPERS['college'])])}
SELECT n_nationkey, paper AS asked, CAST(line_height AS BIGINT) AS line_height, CAST(char_height AS BIGINT) AS char_height, CAST(margin_left AS BIGINT) AS margin_left, CAST(margin_top AS BIGINT) AS margin_top FROM nation JOIN p ON k = n_nationkey % 8""",
}
