import json

import numpy as np
import pytest

from inkframe.operators import kernels, photo, realism
from inkframe.sources import dims, glyphs


def page(h=200, w=160):
    out = np.zeros((h, w, 4), np.uint8)
    out[20:-20:10, 10:-20, 3] = 240
    return out


@pytest.mark.parametrize("name", sorted(realism.LAYERS))
def test_layers(name):
    layer, own = realism.LAYERS[name], page()
    assert (realism.realism(own, {name: 0}) == own).all()
    done = layer.laid(own, 0.8)
    assert done.shape == own.shape and (done != own).any() and (layer.laid(own, 0.8) == done).all()
    assert done[:, :, 3].max() <= 240


def test_layers_move_as_named():
    own = page()
    far = realism.LAYERS["drift"].laid(own, 1.0)[:, :, 3]
    assert np.flatnonzero(far[20])[0] == 10 and np.flatnonzero(far[170])[0] == 10 + int(170 * 6 / 200)
    faded = realism.LAYERS["fading"].laid(own, 1.0)[:, 50, 3]
    assert faded[20] > faded[100] > faded[170] == pytest.approx(240 * (1 - 0.5 * 170 / 199), abs=1)
    crammed = realism.LAYERS["cramming"].laid(own, 1.0)[20, :, 3]
    assert np.flatnonzero(crammed)[-1] < 139 and crammed[-1] == 0
    assert (realism.realism(own, realism.preset("perfect")) == own).all()
    assert realism.preset("unheard of") == realism.preset("natural")


def test_stamp_and_dot():
    glyph = np.zeros((10, 6, 4), np.uint8)
    glyph[2:8, 2:4, 3] = 200
    blank = np.zeros((60, 60, 4), np.uint8)
    out = realism.stamp(blank.copy(), glyph, 5, 7, 20, 12, 0.5)
    assert out[:, :, 3].max() == 39 and out[:7].sum() == 0  # 100 over an alpha of 0 by its own alpha
    assert (realism.stamp(blank.copy(), glyph, 60, 5, 10, 6) == blank).all()
    assert realism.stamp(blank.copy(), glyph, 57, 57, 10, 6).shape == blank.shape
    turned = realism.stamp(blank.copy(), glyph, 5, 5, 20, 12, degrees=90)
    ys, xs = np.nonzero(turned[:, :, 3])
    assert np.ptp(xs) > np.ptp(ys)
    thick, thin = realism.thickened(glyph[:, :, 3], 1), realism.thickened(glyph[:, :, 3], -1)
    assert (thick > 0).sum() == 7 * 3 and (thin > 0).sum() == 5 * 1
    assert realism.dot(blank.copy(), 30, 50, 40)[22, 30, 3] == 180 and not realism.dot(blank.copy(), 30, 50, 20).any()


def test_bank_audit_and_layout_files(spark, tmp_path):
    (tmp_path / "bank.json").write_text(json.dumps({"a": ["x/a_0.png", "x/a_1.png"], "é": ["x/e.png"], "q": []}))
    assert sorted(map(tuple, glyphs.read_bank_file(spark, str(tmp_path / "bank.json")).collect())) == [("a", 0, "x/a_0.png"), ("a", 1, "x/a_1.png"), ("é", 0, "x/e.png")]
    (tmp_path / "audit.json").write_text(json.dumps({"per_glyph": [{"file": "g/a_0.png", "quality_score": 0.4}, {"file": "b_1.png"}, {"file": "c"}]}, indent=2))
    assert sorted(map(tuple, glyphs.read_audit(spark, str(tmp_path / "audit.json")).collect())) == [("a_0", 0.4), ("b_1", 0.85), ("c", 0.85)]
    profiles = spark.createDataFrame([("p",), ("q",)], "profile_id string")
    found = glyphs.with_layout(profiles, spark.createDataFrame([("p", {"inter_word_gap_mean": 9.0})], "profile_id string, layout map<string, double>"))
    assert sorted((r.profile_id, r.inter_word_gap_mean, r.inter_word_gap_std) for r in found.collect()) == [("p", 9.0, 5.0), ("q", 22.0, 5.0)]
    pages = spark.createDataFrame([("r", None, 5, "b"), ("r", None, 2, "a"), ("s", 4, 1, "d")], "request_id string, page int, place int, content string")
    assert sorted(map(tuple, glyphs.uploaded_pages(pages).collect())) == [("r", 1, "a"), ("r", 2, "b"), ("s", 4, "d")]


def test_fallback_capitals_only_where_missing(spark):
    bank = dims.dummy_bank(spark).filter("char IN ('a', 'b', 'B')")
    assert [tuple(r) for r in glyphs.fallback_capitals(bank, list("ABC")).collect()] == [("A", 0, 32, 52)]


def test_drawn_signs(spark):
    for sign in photo.PATHS:
        glyph = photo.drawn(sign)
        assert glyph[:, :, 3].max() == 220 and (glyph[:, :, 3] > 0).sum() >= 50 and min(glyph.shape[:2]) > 8
    assert photo.drawn("a") is None
    assert len(kernels.components(photo.drawn(":")[:, :, 3] > 0)[1]) == 2 and len(kernels.components(photo.drawn("8")[:, :, 3] > 0)[1]) == 1
    bank = spark.createDataFrame([("7",), ("a",)], "char string")
    made = {r.char: r for r in glyphs.drawn_fallbacks(spark, bank).collect()}
    assert set(made) == set(photo.PATHS) - {"7"} and bytes(made["0"].png)[:4] == b"\x89PNG"


def test_markdown(spark):
    rows = spark.createDataFrame([("b|c", 2.5), ("a", None)], "name string, score double")
    found = [r.text for r in glyphs.markdown(rows, "Scores", ["name"]).orderBy("line").collect()]
    assert found == ["## Scores", "", "| name | score |", "|---|---|", "| a |  |", "| b\\|c | 2.5 |"]
