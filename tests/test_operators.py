import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkframe.functions import codec, params
from inkframe.operators import kernels, layout, photo, quality, runs, stateful, text
from inkframe.sources import dims, png


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("stem", "char"),
    [("a_0", "a"), ("upper_P_0", "P"), ("digit_5_fallback", "5"), ("period_1", "."), ("lparen_0", "("), ("th_0", "th"), ("tion_0", "tion"), ("at_0", "at"), ("Th_0", None), ("upper_PQ_0", None), ("backslash", "\\"), ("nothing", None)],
)
def test_parse_stem(spark, stem, char):
    assert one(spark, codec.parse_stem(F.lit(stem))) == char


def test_stem_dialects(spark):
    assert one(spark, codec.parse_stem(F.lit("at_0"), "migrate")) == "@"
    assert one(spark, codec.parse_stem(F.lit("th_0"), "migrate")) is None
    assert one(spark, codec.parse_stem(F.lit("th_0"), "web")) == "?"


def test_template_has_238_cells(spark):
    cells = dims.template_cells(spark)
    assert cells.count() == 268 and cells.filter("label IS NOT NULL").count() == 238
    printed = dims.template_cells(spark, dims.PRINTED_NGRAMS)
    moved = cells.join(printed, ["page", "cell"]).filter(~cells["label"].eqNullSafe(printed["label"])).count()
    assert moved == 2  # on and ou


def test_sliders_clamp_and_default(spark):
    found = params.slider_params(dims.map_of({"slant": 300, "font_size": -4}))
    assert one(spark, found["slant_deg"]) == 12.0
    assert one(spark, found["char_height"]) == int(55 * 0.30)
    assert one(spark, found["bleed_radius"]) == pytest.approx(0.75)


def test_confidence_pieces(spark):
    for d, c in ((0.0, 0.2), (0.03, 0.3), (0.08, 0.6), (0.24, 0.775), (0.4, 0.9)):
        assert one(spark, codec.confidence(F.lit(d))) == pytest.approx(c)


def test_runs_and_merging(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "k long, a array<double>")
    found = runs.find_runs(runs.signal(rows, "k", "a"), "k")
    assert sorted((r.start, r.stop) for r in found.collect()) == [(1, 3), (4, 5), (8, 9)]
    assert sorted((r.start, r.stop) for r in runs.merge_runs(found, "k", 2).collect()) == [(1, 5), (8, 9)]


def test_rules_and_tiers(spark):
    rows = spark.createDataFrame([(1, 5), (2, None)], "k long, v int")
    assert [tuple(r) for r in quality.breaches(rows, ["k"], {"low": F.col("v") < 9, "none": F.col("v").isNull()}).collect()] == [(1, "low"), (2, "none")]
    kept = quality.tiered_keep(spark.createDataFrame([("a", 1, 9), ("a", 2, 7), ("b", 3, 3), ("b", 4, 3)], "c string, k long, ink long"), "c", F.when(F.col("ink") > 5, 0).otherwise(1), "ink", "k")
    assert sorted(r.k for r in kept.collect()) == [1, 2, 3]


def brute_components(mask):
    labels, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if labels[start]:
            continue
        n += 1
        todo = [start]
        while todo:
            y, x = todo.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not labels[y, x]:
                labels[y, x] = n
                todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return labels


@pytest.mark.parametrize("seed", range(8))
def test_components_and_distance(seed):
    mask = np.random.default_rng(seed).random((17, 23)) < 0.15 + 0.08 * seed
    labels, stats = kernels.components(mask)
    brute = brute_components(mask)
    assert len(stats) == brute.max() and stats[:, 4].sum() == mask.sum()
    assert len({(a, b) for a, b in zip(labels.ravel(), brute.ravel(), strict=True)}) == len(stats) + (not mask.all())
    off = np.argwhere(~mask)
    near = [[np.sqrt(((off - (y, x)) ** 2).sum(axis=1).min()) for x in range(23)] for y in range(17)]
    assert np.allclose(kernels.distance(mask), near)


def test_kernels_on_a_cell():
    cell = np.full((60, 50, 3), 255, np.uint8)
    cell[20:40, 15:30] = 20
    cell[50, :] = 0
    cell[5, 5] = 0
    glyph = kernels.cell_to_glyph(cell)
    assert glyph.shape[2] == 4 and (glyph[:, :, 3] > 0).sum() == 20 * 15
    assert kernels.cell_to_glyph(np.full((20, 20, 3), 255, np.uint8)) is None
    assert kernels.ncc(cell, cell) == pytest.approx(1) and kernels.ncc(cell, cell * 0) == 0
    assert (kernels.wander(cell, 0) == cell).all() and kernels.wander(cell, 0.5).shape == cell.shape
    assert kernels.stroke_width(np.pad(np.full((4, 40), 255, np.uint8), 3)) == pytest.approx(3, abs=1)
    for kind, (_, levels) in photo.LOSSES.items():
        assert (photo.degrade(cell, kind, levels[0]) == cell).mean() > 0.99
        assert photo.degrade(cell, kind, levels[-1]).shape == cell.shape
    assert (photo.degrade(cell, "lighting", 0.5)[0, 0] == 127).all()
    assert (photo.degrade(cell, "ink", 0.5)[30, 20] == 137).all() and (photo.degrade(cell, "ink", 0.5)[0, 0] == 255).all()
    assert kernels.glyph_stats(np.zeros((0, 3), np.uint8))[-2] in (True, False)


def test_variant_choice_never_repeats_of_three():
    state = stateful.VariantChoice(3)
    found = [state.next(stateful.draw(1, k)) for k in range(60)]
    assert all(a != b for a, b in zip(found, found[1:], strict=False)) and sorted(map(found.count, range(3))) == [20, 20, 20]


def test_band_alignment():
    assert stateful.align([10, 5, 6, 20], [10, 11, 3]) == [(0, 1, "exact"), (1, 2, "merged_bands"), (3, 1, "partial")]


def test_placements_wrap_and_stop(spark):
    bank = dims.dummy_bank(spark)
    docs = spark.createDataFrame([(1, "word " * 400), (2, None), (3, ""), (4, "éé Th")], "doc_id long, text string")
    p = layout.Layout(page_height=600)
    rows = layout.placements(docs, "doc_id", bank, p).collect()
    first = [r for r in rows if r.doc_id == 1]
    assert max(r.y + 30 for r in first) <= 600 and max(r.line for r in first) > 2
    assert {r.doc_id for r in rows} == {1, 4}
    assert [r.variant for r in first if r.char == "w"][:4] == [0, 1, 2, 0]
    again = layout.placements(docs, "doc_id", bank, layout.Layout(jitter=2.0, seed=5)).collect()
    assert again == layout.placements(docs, "doc_id", bank, layout.Layout(jitter=2.0, seed=5)).collect()


def test_similarity(spark):
    rows = spark.createDataFrame([("Hello", "hello "), ("", None), ("a", ""), ("Hello", "L110")], "a string, b string")
    found = [r.s for r in rows.select(stateful.similarity("a", "b").alias("s")).collect()]
    assert found[:3] == [1.0, 1.0, 0.0] and round(found[3] * 100, 1) == 22.2


def test_ngrams_go_by_the_bank(spark):
    bank = dims.dummy_bank(spark, ("th", "ing"))
    assert text.bank_ngrams(bank) == ("ing", "th") and text.bank_ngrams(dims.dummy_bank(spark)) == ()
    assert one(spark, text.tokens(F.lit("The thing"), ("ing", "th"))) == ["th", "e", "th", "ing"]
    assert one(spark, text.tokens(F.lit("Th e"), ())) == ["T", "h", "e"]


def test_large_banks_are_joined(spark):
    bank = dims.dummy_bank(spark, ("th", "tion"))
    docs = spark.createDataFrame([(1, "The nation's thing"), (2, None), (3, "éa"), (None, "x")], "doc_id long, text string")
    by_value = layout.placements(docs, "doc_id", bank).collect()
    assert {r.char for r in by_value} >= {"th", "tion", "a"}
    assert sorted(by_value, key=str) == sorted(layout.placements(docs, "doc_id", bank, most=3).collect(), key=str)


def test_places_equal_one_window(spark):
    rows = spark.createDataFrame([(k % 3, k * k % 7, k) for k in range(200)], "g long, r long, k long")
    found = runs.places(rows, ["g"], F.col("r"), "k", "place", span=16)
    for g in range(3):
        own = sorted((r.r, r.k, r.place) for r in found.collect() if r.g == g)
        assert [p for *_, p in own] == list(range(1, len(own) + 1))


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png_round_trip(channels):
    image = np.random.default_rng(channels).integers(0, 255, (9, 7, channels)).astype(np.uint8)
    image = image[:, :, 0] if channels == 1 else image
    data = png.encode(image)
    assert (png.decode(data) == image).all()
    body = zlib.decompress(data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8])
    rows = np.frombuffer(body, np.uint8).reshape(9, -1)[:, 1:].reshape(9, 7, channels).astype(int)
    for kind in (1, 2, 3, 4):  # the same picture, filtered
        padded = np.pad(rows, ((1, 0), (1, 0), (0, 0)))
        left, up, corner = padded[1:, :-1], padded[:-1, 1:], padded[:-1, :-1]
        near = np.array([[[min((abs(p - a), k) for k, a in enumerate((l, u, c)))[1] for l, u, c, p in zip(*z)] for z in zip(lr, ur, cr, lr + ur - cr)] for lr, ur, cr in zip(left, up, corner)])
        guess = {1: left, 2: up, 3: (left + up) // 2, 4: np.choose(near, (left, up, corner))}[kind]
        filtered = np.concatenate((np.full((9, 1), kind), ((rows - guess) % 256).reshape(9, -1)), axis=1).astype(np.uint8)
        head, chunk = data[: data.index(b"IDAT") - 4], zlib.compress(filtered.tobytes())
        assert (png.decode(head + struct.pack(">I", len(chunk)) + b"IDAT" + chunk + b"\0" * 4) == image).all()
