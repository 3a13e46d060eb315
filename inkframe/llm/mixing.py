"""Mixing sources to target weights, with DataFrame functions only.

A source's weight is its share of all tokens to the power of an exponent, normalised. The exponent is
bisected, six levels a job, until the weights have a target entropy, or until no source is repeated
more than a limit. Budgeted block permutations realise the weights: a source's documents are dealt
into blocks by hash and ordered by it inside a block; a source of e epochs gives each document
floor(e) times and those in front of the remaining token budget once more. Prefix sums go over spans of
blocks first, blocks of a span second and rows of a block third, so a source with a third of all rows is
no hot task at any level. Texts are counted once: the rows with their counts are written to the shared folder.

Null and empty texts have no tokens; they are given as often as their source's whole epochs. A source
without tokens is given once. Rows without source are a source of their own. Repeated rows count
each. Extra columns are kept, but for those that have a name of a result column. An empty table gives
an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash

BLOCK_ROWS = SPAN_BLOCKS = 1024
SPACE = "\x20\t\n\x0b\x0c\r"


def token_count(text: Column) -> Column:
    """Words parted by white space: the parts of a split, without the empty ones at the ends."""
    text = F.coalesce(text, F.lit(""))
    parts = F.size(F.split(text, r"[\x20\x09-\x0D]+"))
    empty = [reduce(or_, (at(text, F.lit(c)) for c in SPACE)).cast("int") for at in (F.startswith, F.endswith)]
    return F.when(text == "", F.lit(0)).otherwise(parts - empty[0] - empty[1]).cast("long")


def exponent(sources: DataFrame, budget: float | None = None, max_repeats: float | None = 4.0, target_entropy: float | None = None, jobs: int = 5) -> float:
    """The smallest exponent in 0..8 at which the entropy of the weights is at most ``target_entropy``
    (nats) and no source is repeated more than ``max_repeats``. ``sources``: (tokens), all above 0.

    Without a budget, the least one is meant that gives every token once.
    """
    total = sources.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("m")).first()
    if not total["t"]:
        return 1.0
    share = F.log(F.col("tokens") / F.lit(float(total["t"])))
    low, high = 0.0, 8.0
    for _ in range(jobs):
        step = (high - low) / 64
        grid = sources.select(share.alias("ln_p"), F.explode(F.sequence(F.lit(0), F.lit(64))).alias("k")).withColumn("a", F.lit(low) + F.col("k") * F.lit(step))
        power = F.exp(F.col("a") * F.col("ln_p"))
        rows = grid.groupBy("k").agg(F.sum(power).alias("z"), F.sum(power * F.col("a") * F.col("ln_p")).alias("e"), F.max(F.exp((F.col("a") - 1) * F.col("ln_p"))).alias("rare"), F.min(F.exp((F.col("a") - 1) * F.col("ln_p"))).alias("rich"))
        entropy = F.log("z") - F.col("e") / F.col("z")
        repeats = F.col("rare") / F.col("rich") if budget is None else F.col("rare") / F.col("z") * F.lit(budget / total["t"])
        fits = F.lit(True)
        if target_entropy is not None:
            fits = fits & (entropy <= target_entropy + 1e-12)
        if max_repeats is not None:
            fits = fits & (repeats <= max_repeats + 1e-12)
        first = rows.filter(fits).agg(F.min("k").alias("k")).first()["k"]
        if first is None:
            return high
        if first == 0:
            return low
        low, high = low + (first - 1) * step, low + first * step
    return high


def _before(value: str, by: list[str], *order: str) -> Column:
    """The sum of the rows before."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def mix(docs: DataFrame, budget: float | None = None, max_repeats: float | None = 4.0, target_entropy: float | None = None, out_blocks: int = 1024, keep_text: bool = True) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, ...) as often as the mix gives them, with columns

    mix_tokens, mix_weight (of the source), mix_epochs (of the source), mix_copy (0, 1, ...),
    mix_position (0 to 1, place in the mixed stream) and mix_block (the stream in ``out_blocks`` parts).
    Without ``keep_text`` the text is only counted.
    """
    own_columns = ("mix_tokens", "mix_weight", "mix_epochs", "mix_copy", "mix_position", "mix_block")
    columns = [c for c in docs.columns if c.lower() not in own_columns and (keep_text or c != "text")]
    kept = [F.col(f"mix_in_{k}").alias(c) for k, c in enumerate(columns)]
    key = F.coalesce(F.concat(F.lit("="), docs["source"]), F.lit("null"))
    counted = docs.select(*[docs[c].alias(f"mix_in_{k}") for k, c in enumerate(columns)], docs["doc_id"].alias("mix_doc"), token_count(docs["text"]).alias("mix_tokens"), key.alias("mix_key"), F.xxhash64(docs["doc_id"], docs["text"]).alias("mix_hash"))
    counted = stash(counted, "counted")
    blocks = max(1, -(-counted.count() // BLOCK_ROWS))
    dealt = counted.withColumn("mix_block", F.pmod("mix_hash", F.lit(blocks)).cast("int"))
    sums = stash(dealt.groupBy("mix_key", "mix_block").agg(F.sum("mix_tokens").alias("tokens")), "block-sums")
    sources = sums.groupBy("mix_key").agg(F.sum("tokens").alias("tokens"))
    sources = stash(sources, "sources")
    full = sources.filter("tokens > 0").select("tokens")
    a = exponent(full, budget, max_repeats, target_entropy)
    total = sources.agg(F.sum("tokens").alias("t")).first()["t"] or 1
    scale = full.agg(F.sum(F.pow(F.col("tokens") / total, F.lit(a))).alias("z"), F.max("tokens").alias("m")).first()
    z, most = scale["z"] or 1.0, scale["m"] or 1
    if budget is None:
        rich = full.agg(F.min(F.pow(F.col("tokens") / total, F.lit(a)) / F.col("tokens")).alias("r")).first()["r"]
        budget = z / rich if rich else float(most)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a)) / F.lit(z)).otherwise(0.0)
    epochs = F.when(F.col("tokens") > 0, F.round(weight * F.lit(float(budget)) / F.col("tokens"), 9)).otherwise(1.0)
    sources = sources.select("mix_key", F.col("tokens").alias("source_tokens"), weight.alias("mix_weight"), epochs.alias("mix_epochs"))
    spanned = sums.withColumn("span", F.floor(F.col("mix_block") / SPAN_BLOCKS))
    spans = spanned.groupBy("mix_key", "span").agg(F.sum("tokens").alias("tokens"))
    spans = spans.select("mix_key", "span", _before("tokens", ["mix_key"], "span").alias("span_start")).join(sources, "mix_key")
    in_span = spanned.withColumn("block_start", _before("tokens", ["mix_key", "span"], "mix_block"))
    starts = stash(in_span.drop("tokens").join(spans, ["mix_key", "span"]).withColumn("block_start", F.col("span_start") + F.col("block_start")).drop("span", "span_start"), "block-starts")

    placed = dealt.withColumn("mix_before", _before("mix_tokens", ["mix_key", "mix_block"], "mix_hash", "mix_doc")).join(starts, ["mix_key", "mix_block"])
    at = F.col("block_start") + F.col("mix_before")
    whole = F.floor("mix_epochs").cast("int")
    rest = (F.col("mix_epochs") - whole) * F.col("source_tokens")
    copies = whole + F.when((F.col("mix_tokens") > 0) & (at < rest), 1).otherwise(0)
    placed = placed.withColumn("mix_copies", copies).filter("mix_copies > 0")
    placed = placed.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    position = F.least(F.lit(1.0), (F.col("mix_copy") + F.when(F.col("source_tokens") > 0, at / F.col("source_tokens")).otherwise(0.0)) / F.col("mix_epochs"))
    placed = placed.withColumn("mix_position", position)
    return placed.select(*kept, "mix_tokens", "mix_weight", "mix_epochs", "mix_copy", "mix_position", F.least(F.lit(out_blocks - 1), F.floor(F.col("mix_position") * out_blocks)).cast("int").alias("mix_block"))
