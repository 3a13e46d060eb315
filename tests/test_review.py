import json

import numpy as np
import pytest
from oracle import connect, same_rows
from pyspark.sql import functions as F

from inkframe.__main__ import main
from inkframe.operators import kernels, layout, photo, review
from inkframe.plans import catalogue
from inkframe.sources import dims, glyphs, png, sinks, templates


def test_checks_and_problems(spark):
    rows = spark.createDataFrame(
        [(False, True, 20, 30, 99, None, None), (True, False, 20, 30, 99, None, None), (True, True, 20, 30, 9, None, None), (True, True, 2, 30, 59, False, 0.1), (True, True, 20, 30, 99, False, 0.5), (True, True, 20, 30, 99, True, 0.0)],
        "there boolean, loads boolean, w int, h int, ink int, ocr boolean, ncc double",
    )
    found = [r.e for r in rows.select(review.extraction_errors(*map(F.col, rows.columns)).alias("e")).collect()]
    assert found == [["MISSING"], ["LOAD_FAIL"], ["LOW_INK(9<15)"], ["FULL_CELL(0.98)", "BAD_AR(0.07)", "MISMATCH(ncc=0.10)"], [], []]
    sizes = spark.createDataFrame([("a", 60, 70), ("a", 40, 9), ("-", 40, 9), ("é", 20, 20), ("th", 30, 20)], "char string, w int, h int")
    assert [r.char for r in review.cleaned(sizes).collect()] == ["-", "th"]
    assert [r.p for r in sizes.select(review.size_problems(F.col("w"), F.col("h")).alias("p")).collect()][:3] == [["FAKE 60x70"], ["TINY (40x9)", "HLINE (40x9)"], ["TINY (40x9)", "HLINE (40x9)"]]


def test_review_filters_and_orders(spark):
    rows = spark.createDataFrame([("b.png", "b", 0, 10, 20, 0.5, "good", "lowercase"), ("a.png", "a", 0, 30, 20, 1.5, "rejected", "lowercase"), ("A.png", "A", 0, 5, 20, 0.25, "skipped", "uppercase")], "filename string, char string, variant int, width int, height int, aspect_ratio double, quality string, category string")
    names = lambda df: [r.filename for r in df.collect()]
    assert names(review.review_filter(rows, "flagged").orderBy(*review.review_order("quality"))) == ["a.png", "A.png"]
    assert names(review.review_filter(rows, "uppercase")) == ["A.png"] and len(names(review.review_filter(rows))) == 3
    for order, want in (("char", ["A.png", "a.png", "b.png"]), ("size", ["a.png", "b.png", "A.png"]), ("ar", ["a.png", "b.png", "A.png"])):
        assert names(rows.orderBy(*review.review_order(order))) == want


def test_coverage_rounds_halves_to_even(spark, tmp_path):
    found = spark.range(27).select(F.concat("id", F.lit("/26")).alias("small"), F.concat(F.col("id") % 9, F.lit("/8")).alias("other"), F.lit(None).cast("string").alias("none"))
    lines = [r.line for r in found.select(review.coverage_text({"a": (F.col("small"), 26), "b": (F.col("other"), 8), "c": (F.col("none"), 10)}).alias("line")).collect()]
    assert lines == [f"a: {round(n / 26 * 100, 1):.0f}% | b: {round(n % 9 / 8 * 100, 1):.0f}% | c: 0%" for n in range(27)]
    assert lines[10].startswith("a: 38%") and lines[23].startswith("a: 88%")
    keys = [(26 * again + k, n) for n in range(27) for k in range(n) for again in range(2)] + [(None, 0)]
    spark.createDataFrame(keys, "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    same_rows(catalogue.QUERIES["coverage_line"](spark, str(tmp_path)), connect(tmp_path), catalogue.ORACLES["coverage_line"])


def test_replace_keeps_fallbacks_and_failures_leave_the_old(spark, tmp_path):
    path = str(tmp_path / "glyphs")
    table = lambda *stems: spark.createDataFrame([(s, n) for n, s in enumerate(stems)], "stem string, n int")
    stems = lambda: sorted(r.stem for r in spark.read.parquet(path).collect())
    sinks.replace_glyphs(table("a_0", "b_fallback", "c_fallback"), path)
    sinks.replace_glyphs(table("d_0", "c_fallback"), path)
    assert stems() == ["b_fallback", "c_fallback", "d_0"]
    with pytest.raises(Exception, match="raise_error|broken|USER_RAISED"):
        sinks.replace_glyphs(table("x_0").withColumn("n", F.raise_error(F.lit("broken")).cast("int")), path)
    assert stems() == ["b_fallback", "c_fallback", "d_0"] and [p.name for p in tmp_path.iterdir()] == ["glyphs"]


def test_reports_and_files(spark, tmp_path):
    sinks.write_report(spark.createDataFrame([("a", 1)], "name string, n int"), str(tmp_path / "r"))
    assert [json.loads(x.read_text()) for x in (tmp_path / "r").glob("part-*")] == [{"name": "a", "n": 1}]
    card = json.loads(sinks.scorecard(spark.createDataFrame([(70.126, 20.0)], "overall double, ocr double"), "v2", {"overall": 63.6}).first().value)
    assert card == {"version": "v2", "baseline": {"overall": 63.6}, "results": {"overall": 70.13, "ocr": 20.0}, "delta_vs_baseline": {"overall": 6.53}}
    bank = glyphs.with_files(dims.dummy_bank(spark).filter("char = 'a'")).withColumn("stem", F.concat("char", F.lit("_"), "variant"))
    assert sinks.export_png(bank, str(tmp_path / "files")) == 3
    assert png.decode((tmp_path / "files" / "a_1.png").read_bytes()).shape == (42, 28, 4)
    assert json.loads(sinks.json_page(bank.select("stem", "png")).first().value)["png"].startswith("iVBOR")


def test_sheets_and_records(spark):
    bank = glyphs.with_files(dims.dummy_bank(spark).filter("char < 'g' AND char >= 'a'")).selectExpr("'s' AS sheet", "concat(char, '_', variant) AS stem", "w AS width", "h AS height", "png")
    row = sinks.sheet_images(bank).first()
    image = png.decode(bytes(row.png))
    assert row.n == 18 and image.shape == (2 * 84, 16 * 82 + 2, 3)
    assert (image[84 + 30, 40] > 150).all() and (image[84 + 30, 3 * 82 + 40] == sinks.GROUND).all()
    files = bank.selectExpr("'p' AS profile_id", "stem", "png").union(spark.createDataFrame([("p", "zz_0", bytearray(b"no")), ("q", "a_0", None)], "profile_id string, stem string, png binary"))
    profiles, outcome = glyphs.migrated(files)
    assert sorted((r.profile_id, r.ok, r.errors) for r in outcome.collect()) == [("p", True, 1), ("q", False, 1)]
    assert [(r.profile_id, sorted(r.per_character)) for r in profiles.collect()] == [("p", list("abcdef"))]
    with pytest.raises(FileNotFoundError, match="there are .*p"):
        glyphs.one_profile(profiles, "nobody")
    assert glyphs.one_profile(profiles, "p").count() == 1


def test_filled_pages_are_read_again(spark):
    pages, manifest = templates.filled_pages(spark, dims.dummy_bank(spark), by=2)
    assert manifest.count() == 238
    page = png.decode(bytes(pages.filter("page = 1").first().png))
    boxes = templates.cell_boxes(dims.template_cells(spark).filter("page = 1"), by_ratio=True, width=1275, height=1650).collect()
    for box in boxes[::7]:
        cell = page[box.y0 + 3 : box.y1 - 2, box.x0 + 3 : box.x1 - 2]
        assert photo.extract_cell(cell, photo.BARE, scale=0.5) is not None and photo.extract_cell(np.full_like(cell, 255), photo.BARE) is None


def test_line_ink():
    ink = np.zeros((10, 20), np.uint8)
    ink[4, :13] = 255
    ink[:5, 2] = 255
    assert kernels.line_ink(ink) == pytest.approx((0.65, 0.5, 4, -1, 13, 13 / 17))
    assert kernels.line_ink(ink[:0]) == (0.0, 0.0, -1, -1, 0, 0.0)


def test_phrases_and_command(spark, tmp_path, monkeypatch):
    rows = layout.rendered(spark.createDataFrame([(1, "Hi it")], "k long, text string"), "k", glyphs.with_files(dims.dummy_bank(spark)), layout.PHRASE, paper=None).first()
    image = png.decode(bytes(rows.png))
    assert image.shape == (400, 1600, 3) and rows.n_glyphs == 4 and (image < 100).any()
    (tmp_path / "t.txt").write_text("Some words to set")
    monkeypatch.setattr("inkframe.__main__.local_session", lambda: spark)
    assert main(["render", str(tmp_path / "t.txt"), str(tmp_path / "o.png")]) == 0
    assert png.decode((tmp_path / "o.png").read_bytes()).shape == (3200, 2400, 3)
