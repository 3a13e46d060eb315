"""Queries over measurements: gates, statistics, sorts, scores and parameter mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkframe.functions import codec, params
from inkframe.operators import quality, runs, style
from inkframe.plans.text_queries import read


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as glyph boxes: w from quantity, h from line number, ink from discount."""
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("w"), (F.col("l_linenumber") * 6.0).alias("h"), F.floor(F.col("l_discount") * 1000 * F.col("l_linenumber")).alias("ink"))
    return rows.groupBy("l_returnflag", quality.extraction_gate(F.col("ink"), F.col("w"), F.col("h")).alias("status")).agg(F.count("*").alias("n"))


def loader_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_brand", F.col("p_size").alias("w"), F.lit(20).alias("h"), (F.col("p_size") * 4).alias("ink"), (F.col("p_size") + 5).alias("span"), F.substring("p_name", 1, 1).alias("char"))
    return rows.groupBy("p_brand").agg(F.count_if(quality.loader_valid(*map(F.col, ("char", "w", "h", "ink", "span")))).alias("valid"), F.count("*").alias("total"))


def tiered_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    tier = F.when(F.col("o_totalprice") >= 400_000, 0).when(F.col("o_totalprice") >= 200_000, 1).otherwise(2)
    return quality.tiered_keep(orders, "o_custkey", tier, "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", F.col("tier").cast("long").alias("tier"))


def per_key_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    stats = items.groupBy("l_partkey").agg(F.count("*").alias("variants"), F.round(F.avg("l_quantity"), 2).alias("avg_width"), F.max("l_discount").alias("confidence"), F.min(F.struct("l_orderkey", "l_linenumber"))["l_orderkey"].alias("first_order"))
    return stats.withColumn("is_weak", F.col("confidence") < 0.05)


def style_metrics_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.expr("percentile(p_size, 0.5)").alias("m"), F.avg("p_size").alias("a"))
    return own.agg(F.expr("percentile(m, 0.5)").alias("median_of_medians"), (F.expr("percentile(m, 0.5)") * 0.7).alias("threshold"), F.round(F.avg("a"), 6).alias("mean_of_means"))


def upper_median_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderpriority", F.floor(F.col("o_totalprice") / 1000).alias("h"))
    target = rows.groupBy("o_orderpriority").agg(quality.upper_median("h").cast("long").alias("target"), F.min("h").alias("low"), F.max("h").alias("high"))
    skip = (F.col("high") - F.col("low")) / F.greatest(F.col("high"), F.lit(1)) < 0.2
    return target.select("o_orderpriority", "target", F.when(skip, "skip").otherwise("resize").alias("action"))


def confidence_piecewise(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_linenumber", codec.confidence(F.col("l_discount") * 5, F.col("l_returnflag") == "A").alias("c"))
    return items.groupBy("l_linenumber").agg(F.round(F.avg("c"), 6).alias("mean"), F.round(F.min("c"), 6).alias("low"), F.round(F.max("c"), 6).alias("high"))


def slider_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("font_size"), F.floor("value").cast("int"), F.lit("slant"), F.floor(F.col("value") * 2 - 50).cast("int"), F.lit("page_fatigue"), F.pmod("event_id", F.lit(130)).cast("int")).alias("s"))
    found = params.slider_params(F.col("s"))
    return events.select("event_id", *[(c if name in ("char_height", "stroke_thickness") else F.round(c, 6)).alias(name) for name, c in found.items()])


def _scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", *[F.least(F.lit(100.0), F.abs(F.col("embedding")[k].cast("double")) * 50).alias(n) for k, n in enumerate(("tight", "size", "word", "base", "slant", "margin", "pressure", "spacing"))])
    rows = rows.withColumn("neat", params.neatness(*map(F.col, ("base", "size", "slant", "margin", "spacing"))))
    return rows, {n: F.col(n) for n in rows.columns[1:]}


def style_to_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, score = _scores(spark, sf_dir)
    found = params.score_params(score) | {f"r_{k}": v for k, v in params.realism_params(score).items()}
    return rows.select("vec_id", F.round("neat", 4).alias("neat"), *[F.round(c, 4).alias(k) for k, c in found.items()])


def nearest_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts to the nearest of six levels (the first of equals), with the level's score."""
    levels = (0.0, 0.025, 0.045, 0.06, 0.085, 0.1)
    choice = F.array_min(F.array(*[F.struct(F.round(F.abs(F.col("l_discount") - v), 9).alias("d"), F.lit(k).cast("long").alias("level")) for k, v in enumerate(levels)]))["level"]
    score = F.get(F.array(*map(F.lit, (100, 90, 70, 50, 20, 5))), choice.cast("int"))
    rows = read(spark, sf_dir, "lineitem").select(choice.alias("level"), score.cast("long").alias("score"))
    return rows.groupBy("level", "score").agg(F.count("*").alias("n"))


def quadrant_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    best = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.max(F.struct("c_acctbal", F.col("c_custkey").alias("k"))).alias("m"))
    return nation.join(best, "n_nationkey", "left").select("n_nationkey", F.coalesce("m.k", F.lit(-1).cast("long")).alias("best"), F.coalesce("m.c_acctbal", F.lit(0.0)).alias("area"))


def bottleneck_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's two event types with the largest shortfall, then how often each is the first or second."""
    risk = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.lit(100.0) - F.min("value"), 6).alias("risk"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("risk"), "event_type"))
    top = risk.withColumn("place", place.cast("long")).filter("place <= 2")
    return top.groupBy("event_type", "place").agg(F.count("*").alias("n"))


def breakpoint_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return orders.groupBy("o_custkey").agg(F.min(F.when(F.col("o_totalprice") < 100_000, F.struct("o_orderdate", "o_orderkey")))["o_orderkey"].alias("first_low"), F.count("*").alias("levels"))


def eval_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id").select("lang", F.when(F.col("quality") == 1, 80.0).otherwise(35.0).alias("ocr"), (F.col("n_chars") / 20000.0).alias("seconds"), F.col("toxic"))
    cube = rows.groupingSets([["lang"], []], "lang").agg(F.grouping("lang").cast("long").alias("is_total"), F.count("*").alias("n"), F.avg("ocr").alias("o"), F.avg("seconds").alias("t"), F.avg(F.col("toxic") * 1.0).alias("x"))
    return cube.select("lang", "is_total", "n", F.round("o", 6).alias("ocr"), F.round("t", 6).alias("seconds"), F.round(params.overall(F.col("o"), F.lit(95.59), F.col("t"), F.col("x")), 6).alias("overall"))


def review_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of parts by quality, then by size descending; ties by key."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    level = F.when(F.col("p_size") < 5, 0).when(F.col("p_size") < 15, 2).otherwise(3)
    quality_places = runs.places(part, ["p_brand"], level, "p_partkey", "by_quality")
    return runs.places(quality_places, ["p_brand"], -F.col("p_size"), "p_partkey", "by_size").select("p_partkey", "by_quality", "by_size")


def worst_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten line items of the highest tax and price: a top-k report."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_extendedprice").orderBy(F.desc("l_tax"), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(10)


def baseline_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as letters of a line: residuals from the line's fit, relative to the median price."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("line"), (F.col("o_orderkey") * 1.0).alias("x"), (F.col("o_totalprice") / 1000).alias("bottom"), (F.col("o_totalprice") / 1000 + 10).alias("h"))
    return style.baseline_straightness(rows, "line").select("line", "n", F.round("residual", 4).alias("residual"))


def style_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    size = style.size_consistency(F.col("l_quantity"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(size, 4).alias("size"), F.round(style.slant_consistency(F.col("l_discount") * 100), 4).alias("slant"), F.round(style.slant_score(F.col("l_tax") * 100), 4).alias("slant_score"), F.round(style.pressure(F.col("l_quantity")), 4).alias("pressure"))


def margin_line_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("page"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("left"), (F.col("l_linenumber") * 40.0 + F.col("l_discount") * 100).alias("centre"), (F.col("l_tax") * 100 + 10).alias("h"))
    return style.margin_and_spacing(rows, "page", "line", 500.0).select("page", F.round("margin", 4).alias("margin"), F.round("spacing", 4).alias("spacing"))


def nearest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = [(k, 12.0 * k, 12.0 * k + 5.0) for k in range(9)]
    points = runs.nearest_interval(read(spark, sf_dir, "events"), lines, F.col("value"))
    return points.groupBy("line").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return runs.gaps(read(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("tie")), "user_id", at)


def largest_gap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.largest_gap(_timed(spark, sf_dir), "user_id")


def word_gap_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.segment(_timed(spark, sf_dir), "user_id", F.pmod("user_id", F.lit(7)) + 2)


def letter_gap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of each user's events: those under 2.5 medians are inside words; a score from their mean."""
    gaps = _timed(spark, sf_dir).filter("gap IS NOT NULL")
    own = gaps.groupBy("user_id").agg(F.expr("percentile(gap, 0.5)").alias("median"))
    joined = gaps.join(own, "user_id")
    inside = F.when(F.col("gap") < 2.5 * F.col("median"), F.col("gap") / F.col("median"))
    return joined.groupBy("user_id").agg(F.count("*").alias("gaps"), F.count(inside).alias("inside"), F.round(F.coalesce(F.avg(inside), F.lit(0.5)), 6).alias("mean_inside"))


QUERIES = {f.__name__: f for f in (quality_gate, loader_gate, tiered_keep_best, per_key_profile, style_metrics_median, upper_median_normalise, confidence_piecewise, slider_params, style_to_params, nearest_level, quadrant_argmax, bottleneck_top2, breakpoint_first, eval_scorecard, review_sorts, worst_ten, baseline_regression, style_consistency, margin_line_spacing, nearest_line, largest_gap_split, word_gap_segmentation, letter_gap_stats)}

_GAPS = "g AS (SELECT user_id, us, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) - us AS gap FROM (SELECT user_id, event_id, epoch_us(ts) AS us FROM events))"
_LERP = "round({lo}::DOUBLE + {d}::DOUBLE * {t} / 100.0::DOUBLE, 6)"


def _lerp(t: str, low: float, high: float) -> str:
    return _LERP.format(lo=float(low), d=repr(float(high - low)), t=f"CAST({t} AS DOUBLE)")


ORACLES = {
    "quality_gate": """
WITH r AS (SELECT l_returnflag, l_quantity AS w, l_linenumber * 6.0::DOUBLE AS h, floor(l_discount * 1000 * l_linenumber) AS ink FROM lineitem)
SELECT l_returnflag, CASE WHEN ink < 15 THEN 'empty' WHEN ink / greatest(1, w * h) > 0.85 THEN 'contaminated' WHEN w / greatest(1, h) > 4 OR w / greatest(1, h) < 0.08 THEN 'oversized' ELSE 'good' END AS status, count(*) AS n FROM r GROUP BY 1, 2""",
    "loader_gate": """
SELECT p_brand, count(*) FILTER (p_size >= 8 AND p_size / 20 <= CASE WHEN substr(p_name, 1, 1) IN ('m','w','M','W') THEN 3.5 ELSE 2.2 END AND p_size / 20 >= 0.15 AND p_size * 4 >= 50 AND p_size + 5 >= 15) AS valid, count(*) AS total FROM part GROUP BY 1""",
    "tiered_keep_best": """
WITH t AS (SELECT o_custkey, o_orderkey, o_totalprice, CASE WHEN o_totalprice >= 400000 THEN 0 WHEN o_totalprice >= 200000 THEN 1 ELSE 2 END AS tier FROM orders),
r AS (SELECT *, min(tier) OVER (PARTITION BY o_custkey) AS best, row_number() OVER (PARTITION BY o_custkey, tier ORDER BY o_totalprice DESC, o_orderkey) AS place FROM t)
SELECT o_custkey, o_orderkey, CAST(tier AS BIGINT) AS tier FROM r WHERE tier = best AND (tier = 0 OR place = 1)""",
    "per_key_profile": "SELECT l_partkey, count(*) AS variants, round(avg(l_quantity), 2) AS avg_width, max(l_discount) AS confidence, min(l_orderkey) AS first_order, max(l_discount) < 0.05 AS is_weak FROM lineitem GROUP BY 1",
    "style_metrics_median": "SELECT median(m) AS median_of_medians, median(m) * 0.7::DOUBLE AS threshold, round(avg(a), 6) AS mean_of_means FROM (SELECT median(p_size) AS m, avg(p_size) AS a FROM part GROUP BY p_brand)",
    "upper_median_normalise": """
WITH r AS (SELECT o_orderpriority, CAST(floor(o_totalprice / 1000) AS BIGINT) AS h FROM orders)
SELECT o_orderpriority, list_sort(list(h))[len(list(h)) // 2 + 1] AS target, CASE WHEN (max(h) - min(h)) / greatest(max(h), 1) < 0.2 THEN 'skip' ELSE 'resize' END AS action FROM r GROUP BY 1""",
    "confidence_piecewise": """
WITH c AS (SELECT l_linenumber, CASE WHEN l_returnflag = 'A' THEN 0.7::DOUBLE WHEN d < 0.03::DOUBLE THEN 0.2::DOUBLE WHEN d < 0.08::DOUBLE THEN 0.3::DOUBLE + (d - 0.03::DOUBLE) / 0.05::DOUBLE * 0.3::DOUBLE WHEN d < 0.4::DOUBLE THEN 0.6::DOUBLE + (d - 0.08::DOUBLE) / 0.32::DOUBLE * 0.35::DOUBLE ELSE 0.9::DOUBLE END AS c
  FROM (SELECT l_linenumber, l_returnflag, l_discount * 5 AS d FROM lineitem))
SELECT l_linenumber, round(avg(c), 6) AS mean, round(min(c), 6) AS low, round(max(c), 6) AS high FROM c GROUP BY 1""",
    "slider_params": "WITH s AS (SELECT event_id, least(greatest(CAST(floor(value) AS INTEGER), 0), 100) AS f, least(greatest(CAST(floor(value * 2 - 50) AS INTEGER), 0), 100) AS sl, least(event_id % 130, 100) AS pf FROM events) SELECT event_id, "
    + f"CAST(trunc({_lerp('f', 55 * 0.30, 55 * 0.80)}) AS BIGINT) AS char_height, CAST(trunc({_lerp('50', -1, 3)}) AS BIGINT) AS stroke_thickness, "
    + ", ".join(
        f"{_lerp(t, a, b)} AS {n}"
        for n, t, a, b in (("inter_letter_mean", "35", -2, 5), ("inter_word_mean", "50", 55 * 0.25, 55 * 1.2), ("slant_deg", "sl", -12, 12), ("baseline_wander_px", "25", 0, 10), ("line_spacing_mult", "50", 0.85, 2), ("margin_drift_px", "25", 0, 35), ("line_end_cramming", "60", 0.2, 1), ("size_jitter", "25", 0, 0.35), ("spacing_jitter", "25", 0, 5), ("angle_jitter_deg", "20", 0, 12), ("pressure_range", "30", 0, 0.45), ("fatigue_factor", "pf", 0, 0.6), ("ink_fade", "10", 0, 0.6), ("bleed_radius", "25", 0, 3))
    )
    + " FROM s",
    "style_to_params": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: least(100.0::DOUBLE, abs(CAST(x AS DOUBLE)) * 50)) AS v FROM embeddings),
s AS (SELECT vec_id, v[1] AS tight, v[2] AS size, v[3] AS word, v[4] AS base, v[5] AS slant, v[6] AS margin, v[7] AS pressure, v[8] AS spacing FROM e),
n AS (SELECT *, 0.30::DOUBLE * base + 0.25::DOUBLE * size + 0.20::DOUBLE * slant + 0.15::DOUBLE * margin + 0.10::DOUBLE * spacing AS neat0 FROM s)
SELECT vec_id, round(neat0, 4) AS neat, round(greatest(0.5::DOUBLE, 8.0::DOUBLE - 0.07::DOUBLE * tight), 4) AS letter_mean, round(1.0::DOUBLE + 3.0::DOUBLE * (100.0::DOUBLE - size) / 100.0::DOUBLE, 4) AS letter_std, round(10.0::DOUBLE + 0.32::DOUBLE * word, 4) AS word_mean,
  round(3.0::DOUBLE + 8.0::DOUBLE * (100.0::DOUBLE - size) / 100.0::DOUBLE, 4) AS word_std, round(greatest(0.2::DOUBLE, 5.5::DOUBLE - 0.05::DOUBLE * base), 4) AS amplitude, round(0.5::DOUBLE + 4.0::DOUBLE * (100.0::DOUBLE - slant) / 100.0::DOUBLE, 4) AS rotation,
  round(greatest(0.005::DOUBLE, 0.01::DOUBLE + 0.14::DOUBLE * (100.0::DOUBLE - size) / 100.0::DOUBLE), 4) AS scale_var, round(neat0 / 100.0::DOUBLE, 4) AS neatness, round(0.75::DOUBLE * (100.0::DOUBLE - base) / 100.0::DOUBLE, 4) AS r_wander, round(0.60::DOUBLE * (100.0::DOUBLE - margin) / 100.0::DOUBLE, 4) AS r_drift,
  round(0.80::DOUBLE * pressure / 100.0::DOUBLE, 4) AS r_pressure, round(0.80::DOUBLE * ((100.0::DOUBLE - base) + (100.0::DOUBLE - margin)) / 200.0::DOUBLE, 4) AS r_fatigue, round(0.50::DOUBLE * pressure / 100.0::DOUBLE, 4) AS r_fading, round(0.60::DOUBLE * (100.0::DOUBLE - neat0) / 100.0::DOUBLE, 4) AS r_cramming FROM n""",
    "nearest_level": """
WITH l(level, v, score) AS (VALUES (0, 0.0::DOUBLE, 100), (1, 0.025::DOUBLE, 90), (2, 0.045::DOUBLE, 70), (3, 0.06::DOUBLE, 50), (4, 0.085::DOUBLE, 20), (5, 0.1::DOUBLE, 5)),
d AS (SELECT l_discount, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_discount, n, arg_min(level, round(abs(l_discount - v), 9) * 1000 + level * 0.0000001::DOUBLE) AS level FROM d, l GROUP BY 1, 2)
SELECT CAST(b.level AS BIGINT) AS level, CAST(score AS BIGINT) AS score, CAST(sum(n) AS BIGINT) AS n FROM b JOIN l ON l.level = b.level GROUP BY 1, 2""",
    "quadrant_argmax": """
SELECT n_nationkey, coalesce(k, -1) AS best, coalesce(a, 0.0::DOUBLE) AS area FROM nation LEFT JOIN (
  SELECT c_nationkey, c_custkey AS k, c_acctbal AS a FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) = 1) ON c_nationkey = n_nationkey""",
    "bottleneck_top2": """
WITH r AS (SELECT user_id, event_type, round(100.0::DOUBLE - min(value), 6) AS risk FROM events GROUP BY 1, 2)
SELECT event_type, place, count(*) AS n FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id ORDER BY risk DESC, event_type) AS place FROM r) WHERE place <= 2 GROUP BY 1, 2""",
    "breakpoint_first": """
WITH f AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice < 100000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1)
SELECT o.o_custkey, any_value(f.o_orderkey) AS first_low, count(*) AS levels FROM orders o LEFT JOIN f ON f.o_custkey = o.o_custkey GROUP BY 1""",
    "eval_scorecard": """
WITH r AS (SELECT lang, CASE WHEN quality = 1 THEN 80.0::DOUBLE ELSE 35.0::DOUBLE END AS ocr, n_chars / 20000.0::DOUBLE AS seconds, toxic FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, CAST(grouping(lang) AS BIGINT) AS is_total, count(*) AS n, avg(ocr) AS o, avg(seconds) AS t, avg(toxic) AS x FROM r GROUP BY GROUPING SETS ((lang), ()))
SELECT lang, is_total, n, round(o, 6) AS ocr, round(t, 6) AS seconds, round(0.40::DOUBLE * o + 0.30::DOUBLE * 95.59::DOUBLE + 0.20::DOUBLE * least(greatest(100.0::DOUBLE - (t - 0.05::DOUBLE) / 0.95::DOUBLE * 100.0::DOUBLE, 0), 100) + 0.10::DOUBLE * least(100.0::DOUBLE, 4.0::DOUBLE * x), 6) AS overall FROM c""",
    "review_sorts": """
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size < 5 THEN 0 WHEN p_size < 15 THEN 2 ELSE 3 END, p_partkey) AS by_quality, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS by_size FROM part""",
    "worst_ten": "SELECT l_orderkey, l_linenumber, l_tax, l_extendedprice FROM lineitem ORDER BY l_tax DESC, l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10",
    "baseline_regression": """
WITH r AS (SELECT o_custkey AS line, o_orderkey * 1.0::DOUBLE AS x, o_totalprice / 1000 AS bottom, o_totalprice / 1000 + 10 AS h FROM orders),
f AS (SELECT line, count(*) AS n, regr_slope(bottom, x) AS a, regr_intercept(bottom, x) AS b, median(h) AS m FROM r GROUP BY 1 HAVING count(*) >= 4)
SELECT line, n, round(avg(abs(bottom - (a * x + b))) / any_value(m), 4) AS residual FROM r JOIN f USING (line) GROUP BY 1, 2""",
    "style_consistency": """
SELECT l_returnflag, l_linestatus, round(least(greatest(100.0::DOUBLE * (1 - stddev_pop(l_quantity) / avg(l_quantity) / 0.5::DOUBLE), 0), 100), 4) AS size, round(least(greatest(100.0::DOUBLE * (1 - stddev_pop(l_discount * 100) / 20.0::DOUBLE), 0), 100), 4) AS slant,
  round(least(greatest(50.0::DOUBLE + median(l_tax * 100) * 50.0::DOUBLE / 30.0::DOUBLE, 0), 100), 4) AS slant_score, round(least(greatest(150.0::DOUBLE * stddev_pop(l_quantity) / greatest(1.0::DOUBLE, avg(l_quantity)), 0), 100), 4) AS pressure FROM lineitem GROUP BY 1, 2""",
    "margin_line_spacing": """
WITH l AS (SELECT l_partkey AS page, l_linenumber AS line, min(l_quantity) AS lm, avg(l_linenumber * 40.0::DOUBLE + l_discount * 100) AS centre, avg(l_tax * 100 + 10) AS h FROM lineitem GROUP BY 1, 2),
g AS (SELECT *, lead(centre) OVER (PARTITION BY page ORDER BY line) - centre AS gap FROM l)
SELECT page, CASE WHEN count(*) >= 2 THEN round(least(greatest(100.0::DOUBLE * (1 - stddev_pop(lm) / 500.0::DOUBLE / 0.05::DOUBLE), 0), 100), 4) ELSE 70.0::DOUBLE END AS margin, coalesce(round(least(greatest((avg(gap) / avg(h) - 1) * 28.0::DOUBLE, 0), 100), 4), 50.0::DOUBLE) AS spacing FROM g GROUP BY 1""",
    "nearest_line": """
WITH p AS (SELECT value, arg_min(k, greatest(12.0::DOUBLE * k - value, value - (12.0::DOUBLE * k + 5.0::DOUBLE), 0) * 1000 + k * 0.0000001::DOUBLE) AS line FROM (SELECT DISTINCT value FROM events), range(9) t(k) GROUP BY 1)
SELECT line, count(*) AS n, min(value) AS low, max(value) AS high FROM events JOIN p USING (value) GROUP BY 1""",
    "largest_gap_split": f"WITH {_GAPS} SELECT user_id, us AS split_at, gap AS largest_gap FROM g WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY gap DESC, us DESC) = 1",
    "word_gap_segmentation": f"""
WITH {_GAPS}, m AS (SELECT user_id, median(gap) AS median FROM g WHERE gap IS NOT NULL GROUP BY 1), s(k, scale) AS (VALUES (1, 1.0::DOUBLE), (2, 0.8::DOUBLE), (3, 1.2::DOUBLE), (4, 0.6::DOUBLE), (5, 1.5::DOUBLE)),
c AS (SELECT user_id, k, scale, count(*) FILTER (gap >= median * 1.3::DOUBLE * scale) + 1 AS words FROM g JOIN m USING (user_id), s WHERE gap IS NOT NULL GROUP BY 1, 2, 3)
SELECT user_id, words, scale FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN words = user_id % 7 + 2 THEN k WHEN k = 1 THEN 10 ELSE 20 END) = 1""",
    "letter_gap_stats": f"""
WITH {_GAPS}, m AS (SELECT user_id, median(gap) AS median FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT user_id, count(*) AS gaps, count(*) FILTER (gap < 2.5::DOUBLE * median) AS inside, round(coalesce(avg(gap / median) FILTER (gap < 2.5::DOUBLE * median), 0.5::DOUBLE), 6) AS mean_inside FROM g JOIN m USING (user_id) WHERE gap IS NOT NULL GROUP BY 1""",
}
