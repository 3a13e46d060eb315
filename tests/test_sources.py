import json

import numpy as np
from pyspark.sql import functions as F

from inkframe.operators import kernels
from inkframe.sources import dims, glyphs, png
from inkframe.streaming import counts


def glyph(ink=200, side=30):
    image = np.zeros((side, side, 4), np.uint8)
    image[3:-3, 3:-3, 3] = ink
    return image


def test_images_to_bank(spark, tmp_path):
    for stem in ("a_0", "a_1", "upper_Q_0", "period_0", "junk-name"):
        (tmp_path / f"{stem}.png").write_bytes(png.encode(glyph()))
    (tmp_path / "b_0.png").write_bytes(png.encode(glyph(0)))
    (tmp_path / "c_0.png").write_bytes(b"not an image")
    images = glyphs.read_images(spark, str(tmp_path))
    assert sorted((r.char, r.variant) for r in images.select("char", "variant").collect()) == [(".", 0), ("Q", 0), ("a", 0), ("a", 1), ("b", 0)]
    rows = {(r.char, r.variant): r for r in images.withColumn("s", kernels.stats_of(F.col("image"))).select("char", "variant", "s.*").collect()}
    assert rows["a", 0].ink_px == 24 * 24 and rows["b", 0].ink_px == 0 and rows["a", 0].components == 1
    bank = glyphs.glyph_bank(images)
    assert sorted((r.char, r.tier) for r in bank.select("char", "tier").collect()) == [(".", 0), ("Q", 0), ("a", 0), ("a", 0), ("b", 2)]
    filled = glyphs.with_dummies(bank.select("char", F.col("variant").cast("long").alias("variant")), dims.dummy_bank(spark).select("char", "variant"))
    assert filled.select("char").distinct().count() == 60
    assert glyphs.contact_sheet(bank, "tier", ["char", "variant"], 2).filter("sheet_row = 1").count() == 2
    assert glyphs.without(images, ["a_0"]).count() == 4
    back = glyphs.png_rows(images).filter("stem = 'a_0'").first()
    assert bytes(back.png) == png.encode(glyph())


def test_profiles_round_trip(spark, tmp_path):
    entry = {"variants": ["glyphs/a_0.png", "glyphs/a_1.png"], "avg_width": 30, "avg_height": 30, "confidence": 0.4, "extraction_method": "template_cell"}
    (tmp_path / "one").mkdir()
    (tmp_path / "one/profile.json").write_text(json.dumps({"profile_id": "one", "source_method": "odd", "per_character": {"a": entry, "b": entry | {"variants": []}}, "usable": True}, indent=2))
    found = glyphs.read_profiles(spark, str(tmp_path / "*/profile.json"))
    assert sorted((r.char, r.variant) for r in glyphs.profile_glyphs(found).collect()) == [("a", 0), ("a", 1)]
    rules = {r.rule for r in glyphs.profile_breaches(found).collect()}
    assert {"missing created_at", "source_method", "entry variants", "coverage digits_pct"} <= rules and "entry method" not in rules
    rows = spark.createDataFrame([("p", c, f"{c}_{v}.png", 30, 40, 300) for c in "abA" for v in range(2)], "profile_id string, char string, file string, width int, height int, ink_px int")
    built = glyphs.build_profiles(rows, least_lower=2)
    first = built.first()
    assert first.usable and first.total_variants == 6 and first.lowercase_pct == 7.7 and first.per_character["a"].variants == ["a_0.png", "a_1.png"]
    glyphs.write_profiles(built, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1


def test_phrases(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# category: short\nHello\n\n# loose\nWorld\n")
    assert [(r.category, r.phrase) for r in glyphs.read_phrases(spark, str(tmp_path)).orderBy("line").collect()] == [("short", "Hello"), ("short", "World")]
    assert [r.category for r in glyphs.read_phrases(spark, str(tmp_path), True).orderBy("line").collect()] == ["short", "loose"]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    docs.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = counts.read_stream(spark, str(tmp_path / "in"), "doc_id long, text string", 2)
    query = counts.run_once(counts.character_counts(stream), str(tmp_path / "c"), lambda df, _: df.write.mode("overwrite").parquet(str(tmp_path / "out")), "complete")
    query.awaitTermination()
    batch = counts.character_counts(docs)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(batch.collect())
