"""The queries over the training-data operators, and SQL with the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .fingerprint import edited_fingerprints
from .langid import identify
from .licenses import license_scan
from .mixing import mix
from .mjpeg import as_media, media_clips, media_digests
from .ngram_join import jaccard_components
from .packing import pack
from .pages import main_text
from .secrets import secret_scan
from .urls import LISTED, RULES, judge_by_rules


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


def op4_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(read_table(spark, sf_dir, "documents"))


def avi_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed clips of every document's AVI file."""
    return media_clips(as_media(read_table(spark, sf_dir, "documents")))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents the mix gives, how often and where; no source is repeated more than four times."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, max_repeats=4.0, keep_text=False)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read_table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_by_rules(read_table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_join, op2_fingerprints, op3_license_scan, op4_avi_mjpeg, op5_source_mix, op6_language_id, op7_secret_scan, op8_main_text, op9_url_filter, op10_packing, avi_clips)
}

_RULES = ", ".join(f"('{k}', '{v}')" for k, v in RULES)
_LISTED = ", ".join(f"('{k}')" for k in LISTED)
_FITS = "(h.host = split_part({k}, '/', 1) OR ends_with(h.host, '.' || split_part({k}, '/', 1))) AND starts_with(h.path, substr({k}, strpos({k}, '/')))"

ORACLES: dict[str, str] = {
    "op1_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
reach AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(m.low, d.doc_id)) AS BIGINT) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT u, min(v) AS low FROM reach GROUP BY u) m ON m.u = d.doc_id""",
    "op9_url_filter": rf"""
WITH h AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(k, v) AS (VALUES {_RULES}), listed(k) AS (VALUES {_LISTED}),
best AS (
  SELECT url, arg_max(k, length(k)) AS rule, arg_max(v, length(k)) AS verdict FROM (SELECT DISTINCT url, host, path FROM h) h
  JOIN rules ON {_FITS.format(k="rules.k")} GROUP BY url),
other AS (SELECT DISTINCT url FROM h JOIN listed ON {_FITS.format(k="listed.k")})
SELECT h.page_id, h.host, h.path, best.rule, coalesce(best.verdict, CASE WHEN other.url IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM h LEFT JOIN best ON h.url = best.url LEFT JOIN other ON h.url = other.url""",
}
