"""Glyph images, profiles, manifests and phrase files as DataFrames, and their sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkframe.functions.codec import parse_stem
from inkframe.operators import kernels, layout, photo, quality
from inkframe.sources import png

MANIFEST = "page int, cell int, row int, col int, label string, variant int, display string"
PROFILE = (
    "profile_id string, created_at string, source_method string, source_images array<string>, "
    "character_coverage struct<lowercase_pct: double, uppercase_pct: double, digits_pct: double, punctuation_pct: double, total_characters: int, total_variants: int>, "
    "per_character map<string, struct<variants: array<string>, avg_width: double, avg_height: double, confidence: double, is_weak: boolean, extraction_method: string>>, "
    "style_metrics struct<avg_glyph_width: double, avg_glyph_height: double, median_x_height: double, baseline_offset: double, slant_estimate_degrees: double, avg_stroke_width: double, ink_density: double>, "
    "missing_characters array<string>, weak_characters array<string>, usable boolean, total_variants int"
)
METHODS = ("template", "freeform", "hybrid")
ENTRY_METHODS = ("template_cell", "connected_component", "fallback")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(stem, char, variant, image) of a folder of PNG files; unknown stems and unreadable files are left out.

    Variants are numbered by file name within a character.
    """
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    stem = F.regexp_extract(F.col("image.origin"), r"([^/]+)\.[A-Za-z]+$", 1)
    named = images.withColumn("stem", stem).withColumn("char", parse_stem(F.col("stem"))).filter("char IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("char").orderBy("stem")) - 1
    return named.withColumn("variant", place.cast("int")).select("stem", "char", "variant", "image")


def glyph_bank(images: DataFrame) -> DataFrame:
    """Glyphs with statistics, kept by tier: all good ones of a character, else its most inked."""
    rows = images.withColumn("s", kernels.stats_of(F.col("image"))).select("stem", "char", "variant", "s.*", "image")
    valid = quality.loader_valid(F.col("char"), F.col("width"), F.col("height"), F.col("ink_px"), F.col("bottom") - F.col("top") - 1)
    tier = F.when(valid & (F.col("ink_px") >= 150), 0).when(valid, 1).otherwise(2)
    return quality.tiered_keep(rows, "char", tier, "ink_px", "stem")


def with_dummies(bank: DataFrame, dummies: DataFrame) -> DataFrame:
    """The bank, and dummy glyphs for characters that it lacks."""
    return quality.overlay(dummies, bank, "char")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profile documents, and the folder of each; fields that a writer leaves out are null."""
    found = spark.read.schema(PROFILE).option("multiLine", True).json(path)
    return found.withColumn("folder", F.regexp_extract(F.input_file_name(), r"^(.*)/[^/]*$", 1))


def list_profiles(profiles: DataFrame) -> list[str]:
    """The ids of profiles, sorted: a dimension table."""
    return sorted(r["profile_id"] for r in profiles.select("profile_id").distinct().collect())


def one_profile(profiles: DataFrame, profile_id: str) -> DataFrame:
    """The document of a profile; of an unknown one the error names those that there are."""
    found = profiles.filter(F.col("profile_id") == profile_id)
    if not found.limit(1).count():
        raise FileNotFoundError(f"profile {profile_id!r} not found; there are {list_profiles(profiles)}")
    return found


def glyph_records(files: DataFrame) -> DataFrame:
    """(profile_id, stem, width, height, ink_px, ink_density, ok, error) of (profile_id, stem, png): errors become data."""

    def record(data: bytes | None) -> tuple:
        try:
            ink = kernels.ink_plane(png.decode(bytes(data)))
            count = int((ink > 10).sum())
            return ink.shape[1], ink.shape[0], count, count / max(1, ink.size), True, None
        except Exception as wrong:  # noqa: BLE001
            return 0, 0, 0, 0.0, False, f"{type(wrong).__name__}: {wrong}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["width", "height", "ink_px", "ink_density", "ok", "error"]
        for frame in frames:
            found = pd.DataFrame([record(p) for p in frame["png"]], columns=names)
            yield pd.concat([frame[["profile_id", "stem"]].reset_index(drop=True), found], axis=1)

    schema = "profile_id string, stem string, width int, height int, ink_px int, ink_density double, ok boolean, error string"
    return files.select("profile_id", "stem", "png").mapInPandas(run, schema)


def migrated(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profile documents of all profiles' files, each built of its readable glyphs, and (profile_id, ok, errors) of each profile."""
    records = glyph_records(files).withColumn("char", parse_stem(F.col("stem"), "migrate"))
    good = records.filter("ok AND char IS NOT NULL").withColumn("file", F.concat("stem", F.lit(".png")))
    outcome = records.groupBy("profile_id").agg((F.count_if(F.col("ok") & F.col("char").isNotNull()) > 0).alias("ok"), F.count_if(~F.col("ok")).alias("errors"))
    return build_profiles(good), outcome


def profile_glyphs(profiles: DataFrame) -> DataFrame:
    """A row for each variant file of each profile."""
    chars = profiles.select("profile_id", "folder", F.explode("per_character").alias("char", "entry"))
    return chars.select("profile_id", "char", F.posexplode("entry.variants").alias("variant", "file"), "folder", "entry.confidence")


def profile_breaches(profiles: DataFrame) -> DataFrame:
    """(profile_id, rule) for each rule that a profile breaks."""
    rules = {f"missing {c}": F.col(c).isNull() for c in ("profile_id", "created_at", "source_method", "character_coverage", "per_character", "style_metrics", "missing_characters", "weak_characters", "usable")}
    rules["source_method"] = ~F.col("source_method").isin(*METHODS)
    for name in ("lowercase_pct", "uppercase_pct", "digits_pct", "punctuation_pct"):
        value = F.col(f"character_coverage.{name}")
        rules[f"coverage {name}"] = value.isNull() | ~value.between(0, 100)
    entries = F.map_values("per_character")
    rules["entry method"] = F.exists(entries, lambda e: F.coalesce(~e["extraction_method"].isin(*ENTRY_METHODS), F.lit(True)))
    rules["entry confidence"] = F.exists(entries, lambda e: F.coalesce(~e["confidence"].between(0, 1), F.lit(True)))
    rules["entry variants"] = F.exists(entries, lambda e: F.coalesce(F.size(e["variants"]) <= 0, F.lit(True)))
    return quality.breaches(profiles, ["profile_id"], rules)


def build_profiles(glyphs: DataFrame, least_lower: int = 26, source_method: str = "template") -> DataFrame:
    """Profile documents of (profile_id, char, file, width, height, ink_px); ``least_lower`` is the usable policy."""
    density = F.col("ink_px") / F.greatest(F.lit(1), F.col("width") * F.col("height"))
    rows = glyphs.withColumns({"density": density, "confidence": F.least(F.lit(1.0), density * 10)})
    chars = rows.groupBy("profile_id", "char").agg(F.array_sort(F.collect_list("file")).alias("variants"), F.round(F.avg("width"), 2).alias("avg_width"), F.round(F.avg("height"), 2).alias("avg_height"), F.round(F.max("confidence"), 3).alias("confidence"), F.avg("density").alias("density"))
    entry = F.struct("variants", "avg_width", "avg_height", "confidence", (F.col("confidence") < 0.5).alias("is_weak"), F.lit("template_cell").alias("extraction_method"))
    lower = F.count_if(F.col("char").rlike("^[a-z]$"))
    style = F.struct(F.round(F.avg("avg_width"), 2).alias("avg_glyph_width"), F.round(F.avg("avg_height"), 2).alias("avg_glyph_height"), F.round(F.avg("density"), 4).alias("ink_density"))
    found = chars.groupBy("profile_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("char", entry)))).alias("per_character"), style.alias("style_metrics"), (lower >= least_lower).alias("usable"), F.sum(F.size("variants")).cast("int").alias("total_variants"), F.array_sort(F.collect_list(F.when(F.col("confidence") < 0.5, F.col("char")))).alias("weak_characters"), F.round(lower / 26 * 100, 1).alias("lowercase_pct"))
    return found.withColumn("source_method", F.lit(source_method))


def write_profiles(profiles: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Profiles as JSON, a folder for each profile; a dry run only gives the rows."""
    rows = profiles.select("profile_id", F.to_json(F.struct(*[c for c in profiles.columns])).alias("value"))
    if not dry_run:
        rows.write.partitionBy("profile_id").mode("overwrite").text(path)
    return rows


def read_phrases(spark: SparkSession, path: str, loose_headers: bool = False) -> DataFrame:
    """(file, line, category, phrase): lines under their header `# category: name` (or any `# name`), else `general`."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("line", "raw")).withColumn("raw", F.trim("raw"))
    pattern = r"^#\s*(?:category:)?\s*(.+)$" if loose_headers else r"^#\s*category:\s*(.+)$"
    name = F.when(F.col("raw").rlike(pattern), F.trim(F.regexp_extract("raw", pattern, 1)))
    filled = lines.withColumn("category", F.coalesce(quality.forward_fill(lines, ["file"], ["line"], name), F.lit("general")))
    return filled.filter("raw <> '' AND NOT startswith(raw, '#')").select("file", "line", "category", F.col("raw").alias("phrase"))


def png_rows(images: DataFrame, column: str = "image") -> DataFrame:
    """(stem, png) of an image column, ready for a binary sink; ``base64`` gives the text form."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"stem": frame["stem"], "png": [png.encode(kernels.from_struct(i)) for i in frame[column]]})

    return images.select("stem", column).mapInPandas(run, "stem string, png binary")


def with_files(bank: DataFrame) -> DataFrame:
    """A bank of closed-form glyphs with their images as PNG files, ready for a sink."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(png=[png.encode(layout.Glyph(r.w, r.h, r.ink_w, r.ink_h, r.variant).image()) for r in frame.itertuples()])

    fields = ", ".join(f"{n} {t}" for n, t in bank.dtypes)
    return bank.mapInPandas(run, f"{fields}, png binary")


def contact_sheet(glyphs: DataFrame, sheet: str, order: list[str], columns: int = 16, thumb: tuple[int, int] = (80, 64)) -> DataFrame:
    """Adds the place of each glyph on its sheet: column, row, scale, x and y; thumbnails are centred and never cut."""
    place = F.row_number().over(Window.partitionBy(sheet).orderBy(*order)) - 1
    scale = F.least(F.lit(thumb[0]) / F.col("width"), F.lit(thumb[1]) / F.col("height"))
    rows = glyphs.withColumns({"sheet_col": place % columns, "sheet_row": F.floor(place / columns), "scale": scale})
    x = F.col("sheet_col") * thumb[0] + ((thumb[0] - F.col("width") * F.col("scale")) / 2).cast("int")
    y = F.col("sheet_row") * thumb[1] + ((thumb[1] - F.col("height") * F.col("scale")) / 2).cast("int")
    return rows.withColumns({"x": x, "y": y})


def without(glyphs: DataFrame, stems: list[str]) -> DataFrame:
    """The glyphs that are left when some are deleted; a rewrite, as the tables aren't edited in place."""
    return glyphs.filter(~F.col("stem").isin(*stems))


def fallback_capitals(bank: DataFrame, letters: list[str], scale: float = 1.30) -> DataFrame:
    """(char, variant, w, h) for the capitals among ``letters`` that a bank lacks, from the first variant of the small letter."""
    small = bank.filter(F.col("char").isin([c.lower() for c in letters]))
    first = small.groupBy("char").agg(F.min_by(F.struct("w", "h"), "variant").alias("s"))
    made = first.select(F.upper("char").alias("char"), F.lit(0).alias("variant"), (F.col("s.w") * scale).cast("int").alias("w"), (F.col("s.h") * scale).cast("int").alias("h"))
    return made.join(bank.select("char").distinct(), "char", "left_anti")


def bank_variants(banks: DataFrame, *keys: str) -> DataFrame:
    """(keys..., char, variant, file) of bank files (keys..., value), JSON objects from characters to lists of files."""
    found = banks.select(*keys, F.explode(F.from_json("value", "map<string, array<string>>")).alias("char", "files"))
    return found.select(*keys, "char", F.posexplode("files").alias("variant", "file"))


def read_bank_file(spark: SparkSession, path: str) -> DataFrame:
    """(char, variant, file) of a bank file."""
    return bank_variants(spark.read.text(path, wholetext=True))


AUDIT = "per_glyph array<struct<file: string, quality_score: double>>"


def read_audit(spark: SparkSession, path: str, default: float = 0.85) -> DataFrame:
    """(stem, quality) of an audit report."""
    return audit_scores(spark.read.schema(AUDIT).option("multiLine", True).json(path), default=default)


def audit_scores(reports: DataFrame, *keys: str, default: float = 0.85) -> DataFrame:
    """(keys..., stem, quality) of audit reports (keys..., per_glyph); a glyph without a score has the default."""
    rows = reports.select(*keys, F.explode("per_glyph").alias("g"))
    return rows.select(*keys, F.regexp_extract("g.file", r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"), F.coalesce("g.quality_score", F.lit(default)).alias("quality"))


#: A profile's layout where its metadata don't say.
LAYOUT = {"inter_letter_gap_mean": 3.0, "inter_letter_gap_std": 2.0, "inter_word_gap_mean": 22.0, "inter_word_gap_std": 5.0, "baseline_drift_amplitude": 2.0}


def with_layout(profiles: DataFrame, metadata: DataFrame) -> DataFrame:
    """Profiles with the layout of metadata (profile_id, layout map<string, double>), each field by itself defaulted."""
    joined = profiles.join(metadata.select("profile_id", "layout"), "profile_id", "left")
    return joined.withColumns({k: F.coalesce(F.element_at("layout", k), F.lit(v)) for k, v in LAYOUT.items()}).drop("layout")


def uploaded_pages(uploads: DataFrame) -> DataFrame:
    """(request_id, page, content) of uploads (request_id, page, place, content): the page that a field names, else the place in order."""
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("place"))
    return uploads.withColumn("page", F.coalesce("page", place)).select("request_id", "page", "content")


def drawn_fallbacks(spark: SparkSession, bank: DataFrame) -> DataFrame:
    """(char, variant, png) of digits and punctuation that a bank lacks, drawn along pen paths: a row for each sign at most."""
    rows = []
    for sign in photo.PATHS:
        rows.append((sign, 0, bytearray(png.encode(photo.drawn(sign)))))
    return spark.createDataFrame(rows, "char string, variant int, png binary").join(bank.select("char").distinct(), "char", "left_anti")


def markdown(report: DataFrame, title: str, order: list[str]) -> DataFrame:
    """(line, text) of a report, one row a phrase or category, as a Markdown table; bars in values are escaped.

    Reports are small; the lines are numbered in one task.
    """
    bars = lambda cells: F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in report.columns]
    numbered = report.select(F.row_number().over(Window.orderBy(*order)).alias("n"), bars(cells).alias("text"))
    body = numbered.select((F.col("n") + 3).cast("int").alias("line"), "text")
    names = report.columns
    head = [(0, f"## {title}"), (1, ""), (2, "| " + " | ".join(names) + " |"), (3, "|" + "---|" * len(names))]
    return report.sparkSession.createDataFrame(head, "line int, text string").unionByName(body)
