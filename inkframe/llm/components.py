"""Connected components of an edge table, by min-label rounds with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stash

#: A key of more rows than this, and than a ten-thousandth of all, is dealt to several tasks.
HOT = 512


def join_spread(rows: DataFrame, one: DataFrame, key: str, how: str = "inner", hot: int = HOT) -> DataFrame:
    """``rows``, a stashed table, joined by ``key`` with ``one``, which has a row for each key at most.

    Rows of hot keys are dealt over several tasks, each with a copy of the key's row of ``one``, so a key
    with a third of all rows isn't one task's. There are at most ten thousand hot keys; they are broadcast.
    """
    limit = max(hot, rows.count() // 10_000)
    heavy = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))
    heavy = stash(heavy, "hot-keys")
    if not heavy.limit(1).count():
        return rows.join(one, key, how)
    others = [c for c in rows.columns if c != key]
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(F.broadcast(heavy), key, "left").withColumn("_part", F.pmod(F.xxhash64(*others), parts).cast("int")).drop("_parts")
    copied = one.join(F.broadcast(heavy), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"], how).drop("_part")


def components(edges: DataFrame, u: str = "u", v: str = "v", hot: int = HOT) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (two long columns) reaches.

    Labels stay distributed; each round is written to the shared scratch folder, so a lost
    executor costs one round, and the round before is deleted. Minima are combined before the shuffle;
    a hub's edges and a large component's nodes are dealt over several tasks (`join_spread`).
    """
    ways = F.array(F.struct(F.col(u).alias("node"), F.col(v).alias("near")), F.struct(F.col(v).alias("node"), F.col(u).alias("near")))
    both = stash(edges.filter(F.col(u) != F.col(v)).select(F.inline(ways)).distinct(), "edges")
    labels = stash(both.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(-1).cast("long").alias("old")), "labels")
    while True:
        told = join_spread(both, labels.select(F.col("node").alias("near"), "label"), "near", hot=hot)
        heard = told.groupBy("node").agg(F.min("label").alias("m"))
        own = stash(labels.join(heard, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label")), "heard")
        up = own.select(F.col("node").alias("label"), F.col("label").alias("top"))
        after = stash(join_spread(own, up, "label", "left", hot=hot).select("node", F.least("label", F.coalesce("top", "label")).alias("label"), "old"), "labels")
        drop(labels, own)
        labels = after
        if not labels.filter("label <> old").limit(1).count():
            drop(both)
            return labels.select("node", "label")
