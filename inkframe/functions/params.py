"""Parameter mapping: sliders and style scores to render parameters, and composite scores, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkframe.sources.dims import PRESETS, SLIDERS


def lerp(t: Column, low: float, high: float) -> Column:
    return F.lit(float(low)) + F.lit(float(high - low)) * t / F.lit(100.0)


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def slider(sliders: Column, name: str, preset: str = "natural_notes") -> Column:
    """A slider of a map, clamped to whole numbers 0..100; the preset's where the map has none."""
    default = dict(zip(SLIDERS, PRESETS[preset], strict=True))[name]
    return clamp(F.coalesce(F.element_at(sliders, name), F.lit(default)).cast("int").cast("double"))


def slider_params(sliders: Column, line_px: int = 55) -> dict[str, Column]:
    s = {name: slider(sliders, name) for name in SLIDERS}
    other = {name: F.lit(100.0) - s[name] for name in ("baseline_straightness", "margin_consistency")}
    line = max(1, line_px)
    return {
        "char_height": lerp(s["font_size"], line * 0.30, line * 0.80).cast("long"),
        "stroke_thickness": lerp(s["stroke_thickness"], -1, 3).cast("long"),
        "inter_letter_mean": lerp(s["letter_spacing"], -2, 5),
        "inter_word_mean": lerp(s["word_spacing"], line * 0.25, line * 1.2),
        "slant_deg": lerp(s["slant"], -12, 12),
        "baseline_wander_px": lerp(other["baseline_straightness"], 0, 10),
        "line_spacing_mult": lerp(s["line_spacing"], 0.85, 2),
        "margin_drift_px": lerp(other["margin_consistency"], 0, 35),
        "line_end_cramming": lerp(s["line_end_behavior"], 0.2, 1),
        "size_jitter": lerp(s["size_variation"], 0, 0.35),
        "spacing_jitter": lerp(s["spacing_variation"], 0, 5),
        "angle_jitter_deg": lerp(s["angle_variation"], 0, 12),
        "pressure_range": lerp(s["pressure_variation"], 0, 0.45),
        "fatigue_factor": lerp(s["page_fatigue"], 0, 0.6),
        "ink_fade": lerp(s["ink_fading"], 0, 0.6),
        "bleed_radius": lerp(s["ink_bleed"], 0, 3),
    }


def score_params(score: dict[str, Column]) -> dict[str, Column]:
    """Render parameters from style scores 0..100: tight, size, word, base, slant, neat."""
    off = {k: (F.lit(100.0) - v) / 100.0 for k, v in score.items()}
    return {
        "letter_mean": F.greatest(F.lit(0.5), 8.0 - 0.07 * score["tight"]),
        "letter_std": 1.0 + 3.0 * off["size"],
        "word_mean": 10.0 + 0.32 * score["word"],
        "word_std": 3.0 + 8.0 * off["size"],
        "amplitude": F.greatest(F.lit(0.2), 5.5 - 0.05 * score["base"]),
        "rotation": 0.5 + 4.0 * off["slant"],
        "scale_var": F.greatest(F.lit(0.005), 0.01 + 0.14 * off["size"]),
        "neatness": score["neat"] / 100.0,
    }


def realism_params(score: dict[str, Column]) -> dict[str, Column]:
    """Realism amounts from style scores 0..100: base, margin, pressure, neat."""
    off = {k: F.lit(100.0) - v for k, v in score.items()}
    return {
        "wander": 0.75 * off["base"] / 100.0,
        "drift": 0.60 * off["margin"] / 100.0,
        "pressure": 0.80 * score["pressure"] / 100.0,
        "fatigue": 0.80 * (off["base"] + off["margin"]) / 200.0,
        "fading": 0.50 * score["pressure"] / 100.0,
        "cramming": 0.60 * off["neat"] / 100.0,
    }


def neatness(base: Column, size: Column, slant: Column, margin: Column, spacing: Column) -> Column:
    return 0.30 * base + 0.25 * size + 0.20 * slant + 0.15 * margin + 0.10 * spacing


def overall(ocr: Column, coverage: Column, seconds: Column, real: Column) -> Column:
    speed = clamp(100.0 - (seconds - 0.05) / 0.95 * 100.0)
    return 0.40 * ocr + 0.30 * coverage + 0.20 * speed + 0.10 * F.least(F.lit(100.0), 4.0 * real)


def baseline_drift(x: Column, line: Column, amplitude: float, frequency: float) -> Column:
    """Sum of two sines along a line."""
    return F.lit(amplitude) * (F.sin(x * F.lit(frequency) + line) + 0.5 * F.sin(x * F.lit(2.3 * frequency) + 1.7 * line))


def cramming(x: Column, start: Column, right: Column, amount: float) -> Column:
    """The factor of gaps beyond 65 % of a line."""
    part = F.least(F.lit(1.0), (x - start) / F.greatest(F.lit(1.0), right - start))
    return F.when(x > start, 1.0 - (1.0 - amount) * part).otherwise(1.0)


def page_progress(line: Column, lines: Column) -> dict[str, Column]:
    """How writing changes down a page: jitter, spacing and size factors."""
    part = line / F.greatest(F.lit(1), lines)
    return {"jitter_scale": 1.0 + 0.3 * part, "spacing_scale": 1.0 - 0.05 * part, "size_scale": 1.0 - 0.03 * part}


def alpha_factor(darkness: Column, pressure: Column, fatigue: Column, fade: Column, y: Column, page_height: Column) -> Column:
    """Ink strength from darkness, the pressure drawn for a glyph (0.35 at least) and fading down the page (0.25 at least)."""
    pressed = F.greatest(F.lit(0.35), 1.0 - pressure * fatigue)
    faded = F.greatest(F.lit(0.25), 1.0 - fade * y / F.greatest(F.lit(1), page_height))
    return darkness * pressed * faded
