"""Queries of glyph sources, profiles and pixel kernels: parts as glyph files, customers as audits, embeddings as 8x8 rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.functions import codec, params
from inkframe.operators import kernels, style
from inkframe.plans import sqltext as sql
from inkframe.plans.text_queries import read, texts
from inkframe.sources import dims, glyphs


def _glyph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the glyph files of their brands' profiles; the key gives the character, its height and ink."""
    key, chars = F.col("p_partkey"), dims.LOWER + dims.UPPER + dims.DIGITS
    return read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("profile_id"), F.substring(F.lit(chars), (key % 31 + key % 32 + 1).cast("int"), F.lit(1)).alias("char"), F.concat(F.lpad(key.cast("string"), 8, "0"), F.lit(".png")).alias("file"),
        F.col("p_size").alias("width"), (key % 30 + 20).cast("int").alias("height"), (F.col("p_size") * (key % 7)).cast("int").alias("ink_px"),
    )


def built_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heads of the profile documents that glyph files make."""
    found = glyphs.build_profiles(_glyph_files(spark, sf_dir), least_lower=20)
    weak = F.array_join("weak_characters", "")
    return found.select("profile_id", "source_method", "usable", "total_variants", F.size("per_character").cast("int").alias("n_chars"), "lowercase_pct", weak.alias("weak"), F.round("style_metrics.avg_glyph_width", 1).alias("width"))


def profile_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each variant file that profile documents list."""
    documents = glyphs.build_profiles(_glyph_files(spark, sf_dir)).withColumn("folder", F.lower(F.replace("profile_id", F.lit("#"), F.lit("_"))))
    return glyphs.profile_glyphs(documents)


def bank_file_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank files, one of each brand, read as variants."""
    own = _glyph_files(spark, sf_dir).groupBy("profile_id", "char").agg(F.array_sort(F.collect_list("file")).alias("files"))
    banks = own.groupBy("profile_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("char", "files")))).alias("value"))
    return glyphs.bank_variants(banks, "profile_id")


def audit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as scored glyphs of their nations' audit reports; balances under zero have no score."""
    entry = F.struct(F.concat(F.lit("glyphs/"), F.col("c_name"), F.lit(".png")).alias("file"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 10_000).alias("quality_score"))
    reports = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list(entry).alias("per_glyph"))
    return glyphs.audit_scores(reports, "c_nationkey")


def layout_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as profiles; some have layout metadata that say some fields."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("profile_id"), (F.col("n_nationkey") * 1.5).alias("v"))
    said = F.when(F.col("profile_id") % 3 == 0, F.create_map(F.lit("inter_word_gap_mean"), F.col("v"))).when(F.col("profile_id") % 3 == 1, F.create_map(F.lit("inter_letter_gap_std"), F.col("v"), F.lit("other"), F.col("v")))
    metadata = nation.filter("profile_id % 5 <> 4").select("profile_id", said.alias("layout"))
    return glyphs.with_layout(nation, metadata).drop("v")


def upload_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as uploaded pages of a customer's request; those of a high price name their page."""
    page = F.when(F.col("o_totalprice") > 300_000, F.lit(9))
    uploads = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request_id"), page.alias("page"), F.col("o_orderkey").alias("place"), F.col("o_orderstatus").alias("content"))
    return glyphs.uploaded_pages(uploads).groupBy("page", "content").agg(F.count("*").alias("n"), F.sum("request_id").alias("requests"))


def extraction_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.concat(F.substring("c_name", -2, 2), F.when(F.col("c_nationkey") == 3, "_fallback").otherwise("_0"))
    source = F.when(F.col("c_mktsegment").startswith("B"), "template").otherwise("freeform")
    return read(spark, sf_dir, "customer").groupBy("c_nationkey", codec.extraction_method(stem, source).alias("method")).agg(F.count("*").alias("n"))


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of part types and segments that are safe for files."""
    name = codec.safe_name(F.concat_ws(" / ", "p_type", "p_name", F.lit("é-1.png")))
    return read(spark, sf_dir, "part").groupBy(name.alias("name")).agg(F.count("*").alias("n"))


def line_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as places on lines: the baseline's drift there, and the factor of gaps near the line's end."""
    x, line = F.col("l_quantity") * 20, F.col("l_linenumber")
    drift = params.baseline_drift(x, line, 2.0, 0.015)
    crammed = params.cramming(x, F.lit(650.0), F.lit(1000.0), 0.6)
    return read(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", F.round(drift, 6).alias("drift"), F.round(crammed, 6).alias("gap_factor")).distinct()


def letter_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as components of a page; how many could be letters, by flag."""
    w, h = F.col("l_quantity") * 3, F.col("l_linenumber") * 9
    like = style.letter_like(w * h * (1 - F.col("l_discount") * 9), w, h, 400, 160)
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count_if(like).alias("letters"), F.count("*").alias("n"))


def sheet_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of thumbnails on the contact sheets of the brands."""
    found = glyphs.contact_sheet(_glyph_files(spark, sf_dir), "profile_id", ["file"])
    return found.select("profile_id", "file", F.col("sheet_col").cast("int").alias("sheet_col"), F.col("sheet_row").cast("long").alias("sheet_row"), F.round("scale", 6).alias("scale"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


def _rasters(spark: SparkSession, sf_dir: str, least: float = 0.0) -> DataFrame:
    """Embeddings whose values under ``least`` are paper."""
    kept: Column = F.transform("embedding", lambda v: F.when(v >= least, v).otherwise(F.lit(0.0).cast("float")))
    return texts(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", kept.alias("embedding"))


def normalised_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ink of rasters brought to a maximum of 240."""

    def kernel(ink):
        alpha = kernels.normalise_alpha(ink)
        return [(int(alpha.max()), int(alpha.sum()))]

    return kernels.raster_rows(_rasters(spark, sf_dir), "vec_id", "embedding", 8, 1, kernel, "vec_id long, most long, total long")


def label_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of little ink, four pixels a value, without what stands over their largest gap."""

    def kernel(ink):
        crop = kernels.largest_gap_crop(ink)
        return [(*crop.shape, int((crop > 0).sum()))]

    return kernels.raster_rows(_rasters(spark, sf_dir, 0.22), "vec_id", "embedding", 8, 4, kernel, "vec_id long, height long, width long, ink_px long")


def small_parts_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the components of five or more."""
    kernel = lambda ink: [(int((ink > 0).sum()), int(kernels.drop_small(ink > 0, 5).sum()))]
    return kernels.raster_rows(_rasters(spark, sf_dir, 0.1), "vec_id", "embedding", 8, 1, kernel, "vec_id long, ink_px long, kept_px long")


def opened_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that openings by a square and by lines leave; what is beyond the edge doesn't count."""
    sizes = {"square": (2, 2), "across": (1, 3), "down": (3, 1)}
    kernel = lambda ink: [(name, int(kernels.opening(ink > 0, size).sum())) for name, size in sizes.items()]
    return kernels.raster_rows(_rasters(spark, sf_dir), "vec_id", "embedding", 8, 1, kernel, "vec_id long, shape string, kept_px long")


def line_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of rasters that are lines, and their ink."""
    return kernels.raster_rows(_rasters(spark, sf_dir), "vec_id", "embedding", 8, 1, lambda ink: [kernels.line_ink(ink)], "vec_id long, across double, down double, line_row long, line_col long, lined long, share double")


QUERIES = {
    f.__name__: f
    for f in (
        built_profiles, profile_variants, bank_file_variants, audit_scores, layout_defaults, upload_pages, extraction_methods, safe_names, line_drift, letter_components, sheet_places,
        normalised_alpha, label_crops, small_parts_dropped, opened_ink, line_ink,
    )
}

_FILES = f"""g AS (SELECT p_brand AS profile_id, substr('{dims.LOWER}{dims.UPPER}{dims.DIGITS}', CAST(p_partkey % 31 + p_partkey % 32 + 1 AS INTEGER), 1) AS char, lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.png' AS file,
  p_size AS width, CAST(p_partkey % 30 + 20 AS INTEGER) AS height, CAST(p_size * (p_partkey % 7) AS INTEGER) AS ink_px FROM part),
c AS (SELECT profile_id, char, list(file ORDER BY file) AS files, avg(width) AS width, round(max(least(1.0::DOUBLE, ink_px / greatest(1, width * height) * 10)), 3) AS confidence FROM g GROUP BY 1, 2)"""
_INK = "a AS (SELECT vec_id, i, i // 8 AS y, i % 8 AS x, CAST(trunc(least(255.0::DOUBLE, greatest(0.0::DOUBLE, v * 1000))) AS INTEGER) AS a FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings){})"

ORACLES = {
    "built_profiles": f"""
WITH {_FILES} SELECT profile_id, 'template' AS source_method, count(*) FILTER (regexp_matches(char, '^[a-z]$')) >= 20 AS usable, CAST(sum(len(files)) AS INTEGER) AS total_variants, CAST(count(*) AS INTEGER) AS n_chars,
  round(count(*) FILTER (regexp_matches(char, '^[a-z]$')) / 26 * 100, 1) AS lowercase_pct, coalesce(string_agg(char, '' ORDER BY char) FILTER (confidence < 0.5), '') AS weak, round(round(avg(round(width, 2)), 2), 1) AS width FROM c GROUP BY 1""",
    "profile_variants": f"""
WITH {_FILES} SELECT profile_id, char, CAST(generate_subscripts(files, 1) - 1 AS INTEGER) AS variant, unnest(files) AS file, lower(replace(profile_id, '#', '_')) AS folder, confidence FROM c""",
    "bank_file_variants": f"WITH {_FILES} SELECT profile_id, char, CAST(row_number() OVER (PARTITION BY profile_id, char ORDER BY file) - 1 AS INTEGER) AS variant, file FROM g",
    "audit_scores": "SELECT c_nationkey, c_name AS stem, CASE WHEN c_acctbal >= 0 THEN c_acctbal / 10000 ELSE 0.85::DOUBLE END AS quality FROM customer",
    "layout_defaults": """
SELECT n_nationkey AS profile_id, 3.0::DOUBLE AS inter_letter_gap_mean, CASE WHEN n_nationkey % 5 <> 4 AND n_nationkey % 3 = 1 THEN n_nationkey * 1.5::DOUBLE ELSE 2.0::DOUBLE END AS inter_letter_gap_std,
  CASE WHEN n_nationkey % 5 <> 4 AND n_nationkey % 3 = 0 THEN n_nationkey * 1.5::DOUBLE ELSE 22.0::DOUBLE END AS inter_word_gap_mean, 5.0::DOUBLE AS inter_word_gap_std, 2.0::DOUBLE AS baseline_drift_amplitude FROM nation""",
    "upload_pages": """
SELECT CAST(CASE WHEN o_totalprice > 300000 THEN 9 ELSE place END AS INTEGER) AS page, o_orderstatus AS content, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS requests
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders) GROUP BY 1, 2""",
    "extraction_methods": """
SELECT c_nationkey, CASE WHEN c_nationkey = 3 THEN 'fallback' WHEN c_mktsegment LIKE 'B%' THEN 'template_cell' ELSE 'connected_component' END AS method, count(*) AS n FROM customer GROUP BY 1, 2""",
    "safe_names": """SELECT array_to_string(list_transform(string_split(p_type || ' / ' || p_name || ' / é-1.png', ''), lambda c: CASE WHEN c BETWEEN 'a' AND 'z' OR c BETWEEN 'A' AND 'Z' OR c BETWEEN '0' AND '9' OR c IN ('_', '-') THEN c ELSE '_' END), '') AS name, count(*) AS n FROM part GROUP BY 1""",
    "line_drift": """
SELECT DISTINCT l_linenumber, l_quantity, round(2.0::DOUBLE * sin(0.3::DOUBLE * l_quantity + l_linenumber) + sin(0.69::DOUBLE * l_quantity + 1.7::DOUBLE * l_linenumber), 6) AS drift,
  round(CASE WHEN l_quantity > 32.5::DOUBLE THEN 1 - 0.4::DOUBLE * least(1.0::DOUBLE, (20 * l_quantity - 650) / 350) ELSE 1.0::DOUBLE END, 6) AS gap_factor FROM lineitem""",
    "letter_components": """
WITH c AS (SELECT l_returnflag, l_linenumber, l_quantity * 3 AS w, l_linenumber * 9 AS h, l_quantity * 3 * (l_linenumber * 9) * (1 - l_discount * 9) AS area FROM lineitem)
SELECT l_returnflag, l_linenumber, count(*) FILTER (area >= 15 AND area <= 2560 AND h >= 5 AND h <= 53 AND w >= 3 AND w <= 100 AND w / h >= 0.05::DOUBLE AND w / h <= 6) AS letters, count(*) AS n FROM c GROUP BY 1, 2""",
    "sheet_places": f"""
WITH {_FILES}, n AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY file) - 1 AS n, least(80.0::DOUBLE / width, 64.0::DOUBLE / height) AS s FROM g)
SELECT profile_id, file, CAST(n % 16 AS INTEGER) AS sheet_col, n // 16 AS sheet_row, round(s, 6) AS scale, CAST(n % 16 * 80 + trunc((80 - width * s) / 2) AS INTEGER) AS x, CAST(n // 16 * 64 + trunc((64 - height * s) / 2) AS INTEGER) AS y FROM n""",
    "normalised_alpha": f"""
WITH {_INK.format('')}, m AS (SELECT vec_id, max(a) AS m FROM a GROUP BY 1)
SELECT vec_id, CAST(max(trunc(a * (240.0::DOUBLE / m))) AS BIGINT) AS most, CAST(sum(trunc(a * (240.0::DOUBLE / m))) AS BIGINT) AS total FROM a JOIN m USING (vec_id) WHERE m > 0 GROUP BY 1
UNION ALL SELECT vec_id, 0, 0 FROM m WHERE m = 0""",
    "label_crops": f"""
WITH {_INK.format(' WHERE v >= 0.22')}, r AS (SELECT DISTINCT vec_id, y FROM a WHERE a > 0), d AS (SELECT vec_id, y, (lead(y) OVER (PARTITION BY vec_id ORDER BY y) - y) * 4 - 3 AS gap FROM r),
w AS (SELECT vec_id, max(struct_pack(gap := gap, y := y)) AS w FROM d WHERE gap IS NOT NULL GROUP BY 1),
k AS (SELECT a.* FROM a LEFT JOIN w ON w.vec_id = a.vec_id WHERE a.a > 0 AND NOT coalesce(w.w.gap > 8 AND w.w.y * 4 + 3 < 22.4 AND a.y <= w.w.y, false)),
b AS (SELECT vec_id, greatest(0, min(y) * 4 - 3) AS top, least(32, max(y) * 4 + 7) AS bottom, greatest(0, min(x) * 4 - 3) AS l, least(32, max(x) * 4 + 7) AS r, count(*) * 16 AS n FROM k GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(bottom - top, 32) AS BIGINT) AS height, CAST(coalesce(r - l, 32) AS BIGINT) AS width, coalesce(n, 0) AS ink_px FROM embeddings e LEFT JOIN b ON b.vec_id = e.vec_id""",
    "small_parts_dropped": f"""
WITH RECURSIVE {_INK.format(' WHERE v >= 0.1')}, near AS (SELECT p.vec_id, p.i AS i, q.i AS j FROM a p JOIN a q ON q.vec_id = p.vec_id AND abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1),
reach AS (SELECT vec_id, i, i AS j FROM a UNION SELECT r.vec_id, r.i, n.j FROM reach r JOIN near n ON n.vec_id = r.vec_id AND n.i = r.j),
sizes AS (SELECT vec_id, i, count(*) AS n FROM reach GROUP BY 1, 2)
SELECT e.vec_id, count(i) AS ink_px, count(i) FILTER (n >= 5) AS kept_px FROM embeddings e LEFT JOIN sizes s ON s.vec_id = e.vec_id GROUP BY 1""",
    "opened_ink": f"""
WITH {_INK.format('')}, s(shape, h, w) AS (VALUES ('square', 2, 2), ('across', 1, 3), ('down', 3, 1)),
f AS (SELECT p.vec_id, shape, p.i AS i, q.i AS j, q.a > 0 AS inked FROM a p CROSS JOIN s JOIN a q ON q.vec_id = p.vec_id AND q.y - p.y + (h - 1) // 2 BETWEEN 0 AND h - 1 AND q.x - p.x + (w - 1) // 2 BETWEEN 0 AND w - 1),
e AS (SELECT vec_id, shape, i, bool_and(inked) AS whole FROM f GROUP BY 1, 2, 3),
k AS (SELECT DISTINCT f.vec_id, f.shape, f.j FROM f JOIN e ON e.vec_id = f.vec_id AND e.shape = f.shape AND e.i = f.i WHERE whole)
SELECT v.vec_id, s.shape, count(j) AS kept_px FROM embeddings v CROSS JOIN s LEFT JOIN k ON k.vec_id = v.vec_id AND k.shape = s.shape GROUP BY 1, 2""",
    "line_ink": f"""
WITH {_INK.format('')}, l AS (SELECT vec_id, 'row' AS axis, y AS place, count(*) FILTER (a > 0) AS n FROM a GROUP BY 1, 3 UNION ALL SELECT vec_id, 'col', x, count(*) FILTER (a > 0) FROM a GROUP BY 1, 3),
t AS (SELECT vec_id, count(*) FILTER (a > 0) AS total FROM a GROUP BY 1),
m AS (SELECT vec_id, max(n) FILTER (axis = 'row') AS nr, max(n) FILTER (axis = 'col') AS nc, CAST(coalesce(sum(n) FILTER (n > 4.8), 0) AS BIGINT) AS lined FROM l GROUP BY 1)
SELECT m.vec_id, nr / 8 AS across, nc / 8 AS down, CASE WHEN nr > 4.8 THEN (SELECT min(place) FROM l WHERE l.vec_id = m.vec_id AND axis = 'row' AND n = nr) ELSE -1 END AS line_row,
  CASE WHEN nc > 4.8 THEN (SELECT min(place) FROM l WHERE l.vec_id = m.vec_id AND axis = 'col' AND n = nc) ELSE -1 END AS line_col, least(total, lined) AS lined, least(total, lined) / greatest(1, total) AS share FROM m JOIN t USING (vec_id)""",
}
