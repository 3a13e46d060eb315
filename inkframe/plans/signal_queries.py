"""Queries over signals and rasters (embeddings as 64-long signals and 8x8 rasters), and kernel and stateful operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkframe.operators import kernels, layout, runs, stateful
from inkframe.plans import sqltext as sql
from inkframe.plans.text_queries import HELD, read, texts
from inkframe.sources import dims, glyphs
from inkframe.streaming import counts


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.signal(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def signal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.find_runs(_signal(spark, sf_dir), "vec_id")


def merge_close_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.merge_runs(runs.find_runs(_signal(spark, sf_dir), "vec_id"), "vec_id", 2)


def moving_average_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.moving_average(_signal(spark, sf_dir), "vec_id", 5).select("vec_id", "i", F.round("smooth", 6).alias("smooth"))


def row_col_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signal(spark, sf_dir).withColumns({"y": F.floor(F.col("i") / 8), "x": F.col("i") % 8})
    sums = lambda axis: rows.groupBy("vec_id", F.col(axis).alias("at")).agg(F.round(F.sum(F.greatest("v", F.lit(0.0))), 6).alias("ink")).withColumn("axis", F.lit(axis))
    return sums("x").unionByName(sums("y"))


def ink_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    ink = _signal(spark, sf_dir).filter("v > 0.1").withColumns({"y": F.floor(F.col("i") / 8), "x": F.col("i") % 8})
    return ink.groupBy("vec_id").agg(F.min("x").alias("left"), F.min("y").alias("top"), (F.max("x") + 1).alias("right"), (F.max("y") + 1).alias("bottom"), F.count("*").alias("ink_px"))


def line_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters with ink in over 60 % of a row or column, by label and of all: counts, share and the first five."""
    inked = F.transform("embedding", lambda v: F.when(v > 0, 1).otherwise(0))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", inked.alias("on"))
    share = lambda places: F.aggregate(F.array(*[F.get("on", F.lit(k)) for k in places]), F.lit(0), lambda a, b: a + b) / 8
    spans = [share(range(8 * k, 8 * k + 8)) for k in range(8)], [share(range(k, 64, 8)) for k in range(8)]
    found = rows.select("vec_id", "label", ((F.greatest(*spans[0]) > 0.6) | (F.greatest(*spans[1]) > 0.6)).alias("bad"))
    counts = found.groupingSets([["label"], []], "label").agg(F.grouping("label").cast("long").alias("is_total"), F.count("*").alias("total"), F.count_if("bad").alias("contaminated"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    first = found.filter("bad").withColumn("place", place).filter("place <= 5")  # cut in each task before the shuffle
    first = first.groupingSets([["label"], []], "label").agg(F.grouping("label").cast("long").alias("is_total"), F.array_join(F.slice(F.array_sort(F.collect_list("vec_id")), 1, 5), ",").alias("first_five"))
    joined = counts.join(first, F.equal_null(counts["label"], first["label"]) & (counts["is_total"] == first["is_total"]), "left")
    return joined.select(counts["label"], counts["is_total"], "total", "contaminated", F.coalesce("first_five", F.lit("")).alias("first_five"), F.round(F.col("contaminated") / F.col("total") * 100, 2).alias("pct"))


def ncc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of each vector with the one of the next vec_id."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    mean = F.aggregate("e", F.lit(0.0), lambda a, x: a + x) / F.size("e")
    rows = rows.withColumn("m", mean).withColumn("c", F.transform("e", lambda x: x - F.col("m")))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("c").alias("d"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot("c", "c") * dot("d", "d"))
    return rows.join(after, "vec_id").select("vec_id", F.round(F.when(size >= 1e-6, dot("c", "d") / size).otherwise(0.0), 5).alias("ncc"))


def percentile_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _signal(spark, sf_dir).groupBy("vec_id").agg(F.expr("percentile(v, 0.05)").alias("low"), F.expr("percentile(v, 0.95)").alias("high"), F.avg("v").alias("mean"))
    return own.select("vec_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round((F.col("mean") - F.col("low")) / (F.col("high") - F.col("low")) * 255, 4).alias("stretched_mean"))


def similarity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching-blocks similarity of each benchmark text with the next one's."""
    rows = read(spark, sf_dir, "benchmark")
    after = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    return rows.join(after, "item_id").select("item_id", F.round(stateful.similarity(F.col("text"), F.col("next")) * 100, 1).alias("accuracy"))


def weighted_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "")).alias("pos", "char")).filter("char RLIKE '[a-z]'")
    return stateful.weighted_variants(rows, "conv_id", "char", ["turn", "pos"], variants=3)


def band_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts of turns aligned with expected counts by taking one or two bands each."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.split("text", " ")).alias("words"))
    return stateful.align_bands(rows, "conv_id", "turn", "words", expected=[20, 30, 25, 40, 20])


def component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of rasters drawn at four pixels a value."""
    kernel = lambda ink: [(n, *map(int, s)) for n, s in enumerate(kernels.components(ink > 60)[1])]
    return kernels.raster_rows(texts(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 8, 4, kernel, "vec_id long, component long, left long, top long, width long, height long, area long")


def glyph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernel = lambda ink: [kernels.glyph_stats(255 - ink)]
    return kernels.raster_rows(texts(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 8, 4, kernel, "vec_id long, " + kernels.STATS)


def process_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters as template cells: extracted glyph size and ink, and the mean of the glyph set on ruled paper."""

    def kernel(ink):
        import numpy as np

        glyph = kernels.cell_to_glyph(np.repeat((255 - ink)[..., None], 3, axis=2))
        if glyph is None:
            return [(0, 0, 0, None)]
        page = kernels.composite(kernels.ruled_paper(*glyph.shape[:2], spacing=6, margin=2), kernels.wander(glyph, 0.3))
        return [(glyph.shape[1], glyph.shape[0], int((glyph[:, :, 3] > 0).sum()), round(float(page.mean()), 3))]

    return kernels.raster_rows(texts(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 8, 6, kernel, "vec_id long, width long, height long, ink_px long, page_mean double")


def document_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every glyph that sets the benchmark texts, with a bank of some n-grams."""
    found = layout.placements(read(spark, sf_dir, "benchmark"), "item_id", dims.dummy_bank(spark, HELD))
    return found.select("item_id", "pos", "word", "token", "char", "variant", "line", F.round("x", 4).alias("x"), "y", "w", "h")


def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark texts as page images; their digests."""
    small = layout.Layout(page_width=600, page_height=800, margin_left=40, margin_top=40)
    pages = layout.rendered(texts(spark, sf_dir, "benchmark", "item_id", "text"), "item_id", dims.dummy_bank(spark), small)
    return pages.select("item_id", "n_glyphs", "n_lines", F.length("png").alias("png_bytes"), F.sha2("png", 256).alias("png_sha256"))


def rendered_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation names as phrases, set in the fixed way of the legibility score on white, from a bank of glyph files."""
    bank = glyphs.with_files(dims.dummy_bank(spark))
    phrases = read(spark, sf_dir, "nation").select("n_nationkey", F.initcap("n_name").alias("text"))
    pages = layout.rendered(phrases, "n_nationkey", bank, layout.PHRASE, paper=None)
    return pages.select("n_nationkey", "n_glyphs", "n_lines", F.length("png").alias("png_bytes"), F.sha2("png", 256).alias("png_sha256"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.event_windows(read(spark, sf_dir, "events"))


QUERIES = {f.__name__: f for f in (document_placements, rendered_pages, rendered_phrases, event_windows, signal_runs, merge_close_runs, moving_average_same, row_col_projection, ink_bbox, line_contamination, ncc_pairs, percentile_stretch, similarity_ratio, weighted_variant, band_alignment, component_stats, glyph_stats, process_cells)}

_S = "s AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
_RUNS = f"{_S}, a AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS island FROM s WHERE v > 0), r AS (SELECT vec_id, min(i) AS start, max(i) + 1 AS stop FROM a GROUP BY vec_id, island)"

_TALL = "(regexp_matches(token, '^\\p{Lu}+$') OR token IN ('b','d','f','h','k','l','t'))"

ORACLES = {
    "document_placements": f"""
WITH RECURSIVE {sql.bank_with(HELD)}, {sql.KEYS}, {sql.KERN},
lig(pair, delta) AS {sql.values([*dims.LIGATURES.items()])},
usual AS (SELECT CAST(trunc(median(ink_w::DOUBLE) * (30 / median(ink_h::DOUBLE))) AS BIGINT) AS u FROM bank WHERE variant = 0),
lines AS (SELECT item_id, greatest(1.0::DOUBLE, length(text) * (u + 2) / 1000.0::DOUBLE) AS n FROM benchmark, usual),
ws AS (SELECT item_id, generate_subscripts(w, 1) - 1 AS word, unnest(w) AS w FROM (SELECT item_id, {sql.WORDS} AS w FROM benchmark)),
wide AS (SELECT item_id, word, sum(coalesce(z.width, y.width, 9)) AS width FROM (SELECT item_id, word, unnest({sql.CHARS.format('w')}) AS token FROM ws) c
  LEFT JOIN (SELECT char, max(least(CAST(trunc(w * ((CASE WHEN regexp_matches(char, '^\\p{{Lu}}$') OR char IN ('b','d','f','h','k','l','t') THEN 42 ELSE 30 END) / h)) AS BIGINT), 90)) + 2 AS width FROM bank GROUP BY 1) z ON z.char = c.token
  LEFT JOIN (SELECT char, max(least(CAST(trunc(w * ((CASE WHEN regexp_matches({sql.SWAP.format('char')}, '^\\p{{Lu}}$') OR {sql.SWAP.format('char')} IN ('b','d','f','h','k','l','t') THEN 42 ELSE 30 END) / h)) AS BIGINT), 90)) + 2 AS width FROM bank WHERE length(char) = 1 GROUP BY 1) y ON y.char = {sql.SWAP.format('c.token')} GROUP BY 1, 2),
ts AS (SELECT item_id, word, i, tokens[i] AS token, left(tokens[i + 1], 1) AS after, i = 1 AS begins, i = len(tokens) AS finishes FROM (
  SELECT item_id, word, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM (
    SELECT item_id, word, regexp_extract_all(w, '(?is)(ing|th|he|.)', 1) AS tokens FROM ws))),
fs AS (SELECT ts.*, coalesce(a.char, b.char) AS char, coalesce(a.k, b.k) AS k, row_number() OVER (PARTITION BY item_id ORDER BY word, i) AS n
  FROM ts LEFT JOIN keys a ON a.char = CASE WHEN length(token) > 1 THEN lower(token) ELSE token END LEFT JOIN keys b ON length(token) = 1 AND b.char = {sql.SWAP.format('token')}),
vs AS (SELECT *, CASE WHEN char IS NOT NULL THEN (row_number() OVER (PARTITION BY item_id, char ORDER BY n) - 1) % k END AS variant FROM fs),
gs AS (SELECT vs.*, CASE WHEN {_TALL} THEN 42 ELSE 30 END AS high, bank.w, bank.h AS bank_h, bank.ink_w, wide.width, coalesce(lig.delta, 0) AS delta, CASE WHEN after IS NULL THEN 1.0::DOUBLE ELSE coalesce(kern.factor, 1.0::DOUBLE) END AS kern
  FROM vs LEFT JOIN bank ON bank.char = vs.char AND bank.variant = vs.variant JOIN wide ON wide.item_id = vs.item_id AND wide.word = vs.word
  LEFT JOIN lig ON lig.pair = lower(left(token || coalesce(after, ''), 2)) LEFT JOIN kern ON kern.pair = lower(right(token, 1) || coalesce(after, ''))),
walk AS (
  SELECT item_id, CAST(0 AS BIGINT) AS n, 100.0::DOUBLE AS pen, 100.0::DOUBLE AS x, CAST(150 AS BIGINT) AS y, CAST(0 AS BIGINT) AS line FROM (SELECT DISTINCT item_id FROM gs)
  UNION ALL
  SELECT item_id, n, CASE WHEN char IS NULL THEN start + 9.0::DOUBLE ELSE start + trunc(ink_w * (high / bank_h)) + 2.0::DOUBLE * kern END + CASE WHEN finishes THEN 30.0::DOUBLE * (1 - 0.05::DOUBLE * (line / lines)) ELSE 0 END, start, y, line FROM (
    SELECT s.*, s.from_x + s.delta * (1 - 0.05::DOUBLE * (s.line / s.lines)) AS start FROM (
      SELECT g.*, l.n AS lines, CASE WHEN g.begins AND f.pen + g.width > 1100 AND f.pen > 150 THEN 100.0::DOUBLE ELSE f.pen END AS from_x,
        CASE WHEN g.begins AND f.pen + g.width > 1100 AND f.pen > 150 THEN f.y + 55 ELSE f.y END AS y, CASE WHEN g.begins AND f.pen + g.width > 1100 AND f.pen > 150 THEN f.line + 1 ELSE f.line END AS line
      FROM walk f JOIN gs g ON g.item_id = f.item_id AND g.n = f.n + 1 JOIN lines l ON l.item_id = g.item_id) s WHERE s.y + 30 <= 1450))
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY n) - 1 AS INTEGER) AS pos, CAST(word AS INTEGER) AS word, token, char, CAST(variant AS INTEGER) AS variant, CAST(line AS INTEGER) AS line, round(walk.x, 4) AS x,
  CAST(walk.y - high + CASE WHEN token IN ('g','j','p','q','y') THEN 6 ELSE 0 END AS DOUBLE) AS y, CAST(least(CAST(trunc(w * (high / bank_h)) AS BIGINT), 90) AS INTEGER) AS w, CAST(high AS INTEGER) AS h
FROM walk JOIN gs USING (item_id, n) WHERE char IS NOT NULL""",
    "band_alignment": """
WITH RECURSIVE b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS band, len(string_split(text, ' ')) AS words FROM conversations),
e(n, want) AS (VALUES (0, 20), (1, 30), (2, 25), (3, 40), (4, 20)),
p AS (SELECT x.conv_id, x.band, x.words, y.words AS more FROM b x LEFT JOIN b y ON y.conv_id = x.conv_id AND y.band = x.band + 1),
walk AS (
  SELECT DISTINCT conv_id, -1 AS sentence, CAST(0 AS BIGINT) AS upcoming, CAST(0 AS BIGINT) AS band, CAST(0 AS BIGINT) AS taken, '' AS kind FROM b
  UNION ALL
  SELECT conv_id, n, band + taken, band, taken, kind FROM (
    SELECT w.conv_id, e.n, p.band, CASE WHEN abs(words - want) > 2 AND abs(words + more - want) <= 2 THEN 2 ELSE 1 END AS taken,
      CASE WHEN abs(words - want) <= 2 THEN 'exact' WHEN abs(words + more - want) <= 2 THEN 'merged_bands' ELSE 'partial' END AS kind
    FROM walk w JOIN e ON e.n = w.sentence + 1 JOIN p ON p.conv_id = w.conv_id AND p.band = w.upcoming))
SELECT conv_id, CAST(sentence AS BIGINT) AS sentence, band, taken, kind FROM walk WHERE sentence >= 0""",
    "component_stats": f"""
WITH RECURSIVE {_S}, c AS (SELECT vec_id, i, i // 8 AS y, i % 8 AS x FROM s WHERE v * 1000 >= 61),
near AS (SELECT a.vec_id, a.i AS i, b.i AS j FROM c a JOIN c b ON b.vec_id = a.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach AS (SELECT vec_id, i, i AS j FROM c UNION SELECT r.vec_id, r.i, n.j FROM reach r JOIN near n ON n.vec_id = r.vec_id AND n.i = r.j),
own AS (SELECT vec_id, i, min(j) AS root FROM reach GROUP BY 1, 2),
parts AS (SELECT vec_id, root, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS n FROM own JOIN c USING (vec_id, i) GROUP BY 1, 2)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY root) - 1 AS component, x0 * 4 AS "left", y0 * 4 AS top, (x1 - x0 + 1) * 4 AS width, (y1 - y0 + 1) * 4 AS height, n * 16 AS area FROM parts""",
    "weighted_variant": """
WITH c AS (SELECT conv_id, turn, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS char FROM (SELECT conv_id, turn, string_split(text, '') AS w FROM conversations)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, char ORDER BY turn, pos) - 1 AS n FROM c WHERE regexp_matches(char, '[a-z]')),
d AS (SELECT DISTINCT conv_id, char, [CAST('0x' || substr(md5('0|' || conv_id || '|' || char || '|' || k), 1, 14) AS BIGINT) / 72057594037927936.0::DOUBLE FOR k IN [0, 1]] AS u FROM n),
one AS (SELECT conv_id, char, u[2] AS u, CASE WHEN u[1] <= 1.0::DOUBLE / 3 THEN 0 WHEN u[1] <= 2.0::DOUBLE / 3 THEN 1 ELSE 2 END AS a FROM d),
two AS (SELECT conv_id, char, a, list_filter([0, 1, 2], lambda v: v <> a)[CASE WHEN u <= 0.5 THEN 1 ELSE 2 END] AS b FROM one)
SELECT n.conv_id, n.char, n.turn, CAST(n.pos AS INTEGER) AS pos, CAST(CASE n.n % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE 3 - a - b END AS BIGINT) AS variant FROM n JOIN two USING (conv_id, char)""",
    "glyph_stats": f"""
WITH RECURSIVE {_S}, c AS (SELECT vec_id, i, i // 8 AS y, i % 8 AS x FROM s WHERE v * 1000 >= 11), o AS (SELECT vec_id, i // 8 AS y, i % 8 AS x FROM s WHERE v * 1000 < 11),
near AS (SELECT a.vec_id, a.i AS i, b.i AS j FROM c a JOIN c b ON b.vec_id = a.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach AS (SELECT vec_id, i, i AS j FROM c UNION SELECT r.vec_id, r.i, n.j FROM reach r JOIN near n ON n.vec_id = r.vec_id AND n.i = r.j),
parts AS (SELECT vec_id, count(DISTINCT root) AS n FROM (SELECT vec_id, i, min(j) AS root FROM reach GROUP BY 1, 2) GROUP BY 1),
px AS (SELECT vec_id, y * 4 + k // 4 AS py, x * 4 + k % 4 AS px FROM c CROSS JOIN range(16) t(k)),
far AS (SELECT p.vec_id, py, px, least(min(pow(greatest(0, y * 4 - py, py - y * 4 - 3), 2) + pow(greatest(0, x * 4 - px, px - x * 4 - 3), 2)), pow(least(py + 1, 32 - py, px + 1, 32 - px), 2)) AS d
  FROM px p LEFT JOIN o ON o.vec_id = p.vec_id GROUP BY 1, 2, 3),
stroke AS (SELECT vec_id, 2 * median(sqrt(d)) AS stroke FROM far GROUP BY 1),
spans AS (SELECT vec_id, max(n) FILTER (axis = 0) / 8 AS h_span, max(n) FILTER (axis = 1) / 8 AS v_span FROM (SELECT vec_id, 0 AS axis, y AS place, count(*) AS n FROM c GROUP BY 1, 3 UNION ALL SELECT vec_id, 1, x, count(*) FROM c GROUP BY 1, 3) GROUP BY 1),
box AS (SELECT vec_id, count(*) * 16 AS n, min(x) * 4 AS x0, min(y) * 4 AS y0, max(x) * 4 + 4 AS x1, max(y) * 4 + 4 AS y1 FROM c GROUP BY 1)
SELECT e.vec_id, CAST(32 AS INTEGER) AS width, CAST(32 AS INTEGER) AS height, CAST(coalesce(box.n, 0) AS INTEGER) AS ink_px, coalesce(box.n, 0) / 1024.0::DOUBLE AS ink_density, CAST(coalesce(x0, 0) AS INTEGER) AS "left", CAST(coalesce(y0, 0) AS INTEGER) AS top,
  CAST(coalesce(x1, 0) AS INTEGER) AS "right", CAST(coalesce(y1, 0) AS INTEGER) AS bottom, coalesce(h_span, 0.0::DOUBLE) AS h_span, coalesce(v_span, 0.0::DOUBLE) AS v_span, coalesce(stroke, 0.0::DOUBLE) AS stroke,
  CAST(coalesce(parts.n, 0) AS INTEGER) AS components, true AS ok, CAST(NULL AS VARCHAR) AS error
FROM embeddings e LEFT JOIN box ON box.vec_id = e.vec_id LEFT JOIN parts ON parts.vec_id = e.vec_id LEFT JOIN spans ON spans.vec_id = e.vec_id LEFT JOIN stroke ON stroke.vec_id = e.vec_id""",
    "event_windows": "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2",
    "signal_runs": f"WITH {_RUNS} SELECT * FROM r",
    "merge_close_runs": f"""
WITH {_RUNS}, n AS (SELECT *, CASE WHEN start - lag(stop) OVER (PARTITION BY vec_id ORDER BY start) < 2 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY vec_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS grp FROM n)
SELECT vec_id, min(start) AS start, max(stop) AS stop FROM g GROUP BY vec_id, grp""",
    "moving_average_same": f"WITH {_S} SELECT vec_id, i, round(sum(v) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM s",
    "row_col_projection": f"""
WITH {_S} SELECT vec_id, i % 8 AS "at", round(sum(greatest(v, 0)), 6) AS ink, 'x' AS axis FROM s GROUP BY 1, 2
UNION ALL SELECT vec_id, i // 8, round(sum(greatest(v, 0)), 6), 'y' FROM s GROUP BY 1, 2""",
    "ink_bbox": f"""WITH {_S} SELECT vec_id, min(i % 8) AS "left", min(i // 8) AS top, max(i % 8) + 1 AS "right", max(i // 8) + 1 AS bottom, count(*) AS ink_px FROM s WHERE v > 0.1::DOUBLE GROUP BY 1""",
    "line_contamination": """
WITH f AS (
  SELECT label, vec_id, list_max(list_transform(range(8), lambda k: len(list_filter(embedding[8 * k + 1:8 * k + 8], lambda v: v > 0)))) > 0.6::DOUBLE * 8
    OR list_max(list_transform(range(8), lambda k: len(list_filter(range(8), lambda r: embedding[8 * r + k + 1] > 0)))) > 0.6::DOUBLE * 8 AS bad FROM embeddings)
SELECT label, CAST(grouping(label) AS BIGINT) AS is_total, count(*) AS total, count(*) FILTER (bad) AS contaminated, coalesce(array_to_string(list_sort(list(vec_id) FILTER (bad))[1:5], ','), '') AS first_five,
  round(count(*) FILTER (bad) / count(*) * 100, 2) AS pct FROM f GROUP BY GROUPING SETS ((label), ())""",
    "ncc_pairs": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
c AS (SELECT vec_id, list_transform(e, lambda x: x - list_avg(e)) AS c FROM e)
SELECT a.vec_id, round(list_dot_product(a.c, b.c) / sqrt(list_dot_product(a.c, a.c) * list_dot_product(b.c, b.c)), 5) AS ncc FROM c a JOIN c b ON b.vec_id = a.vec_id + 1""",
    "percentile_stretch": f"""
WITH {_S}, p AS (SELECT vec_id, quantile_cont(v, 0.05::DOUBLE) AS low, quantile_cont(v, 0.95::DOUBLE) AS high, avg(v) AS mean FROM s GROUP BY 1)
SELECT vec_id, round(low, 6) AS low, round(high, 6) AS high, round((mean - low) / (high - low) * 255, 4) AS stretched_mean FROM p""",
}
