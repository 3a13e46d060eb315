"""URL filters: a blocked Bloom filter of listed canonical URL prefixes, then an exact hash join.

A listed entry is a host and the beginning of a path, written together (`example.org/es/`); it fits
its host and all subdomains. The keys of a URL are its host's suffixes at label borders, each with the
beginnings of its path that have a listed length. Filter: 64-bit blocks, one a key, three bits in it,
packed into one array of at most ``FILTER_BYTES`` that is broadcast and probed in place, first for the
suffixes alone, then for the keys of suffixes that some entry has. Only URLs with possible hits go to the
exact join, which removes false positives (a filter too small for its list lets more through, and nothing
else changes); the longest entry wins. All other pages are judged where they are, without a shuffle.

Unnamed entries are compared with the canonical URL: no user, default port or trailing dot in its host;
`/` for an empty path, dot segments resolved, percent codes of letters, digits and `-._~` written out and
others in capitals. Named ones (the rules) and the columns host and path go by the URL as it stands.

Null URLs and those without :// have an empty host and path and fit nothing. Repeated pages are judged
each; entries of equal length go by name. Extra columns are ignored. An empty list lets all pass, an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, mix64, runs, stash
from .pages import host_of

# The rules, and hosts listed beside them.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
LISTED = ("cheap-pills.example.net/", "spam-farm.example.net/", "casino-win.example.net/")
BITS_A_KEY, FILTER_BYTES, SEGMENT = 16, 1 << 28, 1 << 16


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_host(url: Column, host: Column) -> Column:
    host = F.regexp_replace(host, r"^.*@", "")
    scheme = F.lower(F.substring_index(url, "://", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, r":(80)?$", "")).when(scheme == "https", F.regexp_replace(host, r":(443)?$", "")).otherwise(host)
    return F.regexp_replace(host, r"\.+$", "")


def canonical_path(path: Column) -> Column:
    """`/` where it is empty; plain characters instead of their percent codes; no dot segments."""
    part = lambda p: F.substring(p, 1, 2)
    char = lambda p: F.char(F.conv(part(p), 16, 10).cast("long"))
    code = lambda p: F.when(~p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.lit("%"), p)).otherwise(F.concat(F.when(char(p).rlike("^[A-Za-z0-9._~-]$"), char(p)).otherwise(F.concat(F.lit("%"), F.upper(part(p)))), F.substring(p, 3, 1 << 30)))
    parts = F.split(path, "%", -1)
    plain = F.when(F.contains(path, F.lit("%")), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), code), ""))).otherwise(path)
    segments = F.split(plain, "/", -1)
    none = F.array().cast("array<string>")
    kept = F.aggregate(segments, none, lambda out, s: F.when(s == ".", out).when(s == "..", F.when(F.size(out) > 1, F.slice(out, 1, F.size(out) - 1)).otherwise(out)).otherwise(F.concat(out, F.array(s))))
    whole = F.concat(F.array_join(kept, "/"), F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise(""))
    return F.when(path == "", "/").when(plain.rlike(r"(^|/)\.\.?(/|$)"), whole).otherwise(plain)


def hash_bits(hashes: np.ndarray) -> np.ndarray:
    """Three bits of a block for each hash."""
    more = mix64(hashes)
    out = np.zeros(len(hashes), np.uint64)
    for k in range(3):
        out |= np.uint64(1) << ((more >> np.uint64(6 * k)) & np.uint64(63))
    return out


def _segments(blocks: int):
    """Rows (segment, bits) of hashes that are sorted by segment."""
    schema = pa.schema([("segment", pa.int64()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bits = None, np.zeros(0, np.uint64)
        for table in runs(batches, "segment"):
            held, bits = table.column("segment")[0].as_py(), np.zeros(min(SEGMENT, blocks), np.uint64)
            hashes = table.column("hash").to_numpy().view(np.uint64)
            np.bitwise_or.at(bits, (hashes & np.uint64(len(bits) - 1)).astype(np.int64), hash_bits(hashes))
            yield arrow_rows(schema, segment=[held], bits=[bits.astype("<u8").tobytes()])

    return run


def filter_of(listed: DataFrame, count: int) -> np.ndarray:
    """The packed filter of the entries' keys and, each with a line feed, of their hosts."""
    blocks = min(FILTER_BYTES // 8, max(1, 1 << (2 * count * BITS_A_KEY // 64).bit_length()))
    names = F.explode(F.array(F.col("key"), F.concat(F.substring_index("key", "/", 1), F.lit("\n"))))
    hashes = listed.select(names.alias("name")).distinct().select(F.xxhash64("name").alias("hash"))
    segment = F.shiftright(F.col("hash").bitwiseAND(F.lit(blocks - 1)), SEGMENT.bit_length() - 1)
    dealt = hashes.select(segment.alias("segment"), "hash").repartition("segment").sortWithinPartitions("segment")
    bits = np.zeros(blocks, np.uint64)
    for row in dealt.mapInArrow(_segments(blocks), "segment bigint, bits binary").toLocalIterator():
        at = row["segment"] * SEGMENT
        bits[at : at + SEGMENT] = np.frombuffer(row["bits"], "<u8")
    return bits


def passing(rows: DataFrame, columns: list[str], bits) -> DataFrame:
    """``rows`` with only those strings of the array columns that the broadcast filter may hold."""
    order = rows.columns

    def kept(names: pa.Array, hashes: pa.Array) -> pa.Array:
        own = hashes.flatten().to_numpy().view(np.uint64)
        wanted = hash_bits(own)
        hit = bits.value[(own & np.uint64(len(bits.value) - 1)).astype(np.int64)] & wanted == wanted
        offsets = hashes.offsets.to_numpy()
        reach = np.concatenate(([0], np.cumsum(hit)))[offsets - offsets[0]]
        return pa.ListArray.from_arrays(pa.array(reach, pa.int32()), names.flatten().filter(pa.array(hit)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [kept(batch.column(c), batch.column(f"{c}_hash")) if c in columns else batch.column(c) for c in order]
                yield pa.RecordBatch.from_arrays(found, names=order)

    return rows.withColumns({f"{c}_hash": F.transform(c, lambda n: F.xxhash64(n)) for c in columns}).mapInArrow(run, rows.schema)


def possible_keys(pages: DataFrame, lengths: list[int], bits) -> DataFrame:
    """Adds ``keys``, for the URL as it stands, and ``its_keys``, for its canonical form: what the filter lets pass."""
    none = F.array().cast("array<string>")

    def suffixes(host: Column) -> Column:
        labels = F.split(host, r"\.")
        return F.when(host == "", none).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.array_join(F.slice(labels, k, F.size(labels)), "."), F.lit("\n"))))

    def keys(hosts: Column, path: Column) -> Column:
        fronts = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
        return F.flatten(F.transform(hosts, lambda s: F.transform(fronts, lambda p: F.concat(F.rtrim(s, F.lit("\n")), p))))

    columns = [F.col(c) for c in ("page_id", "url", "host", "path")]
    its_path = F.when(F.col("host") != "", canonical_path(F.col("path"))).otherwise("")
    hosts = passing(pages.select(*columns, its_path.alias("its_path"), suffixes(F.col("host")).alias("hosts"), suffixes(canonical_host(F.col("url"), F.col("host"))).alias("its_hosts")), ["hosts", "its_hosts"], bits)
    return passing(hosts.select(*columns, keys(F.col("hosts"), F.col("path")).alias("keys"), keys(F.col("its_hosts"), F.col("its_path")).alias("its_keys")), ["keys", "its_keys"], bits)


def judge_urls(pages: DataFrame, listed: DataFrame, broadcast_keys: int = 200_000) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) for ``pages`` (page_id, url) and ``listed`` (key, verdict, named).

    ``rule`` is the longest named entry that fits, with its verdict; else the verdict is block where
    an unnamed entry fits, and allow otherwise. The list, and the decisions on possible hits, are
    broadcast up to ``broadcast_keys`` rows; else they are joined by hash.
    """
    with_parts = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if not (count := listed.count()):
        return with_parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    sizes = listed.select((F.length("key") - F.instr("key", "/") + 1).alias("n")).distinct().collect()  # at most the longest path
    bits = pages.sparkSession.sparkContext.broadcast(filter_of(listed, count))
    probed = stash(possible_keys(with_parts, sorted(r["n"] for r in sizes), bits), "possible")
    hit = F.size("keys") + F.size("its_keys") > 0
    small = lambda df, n: F.broadcast(df) if n <= broadcast_keys else df
    key = lambda form, column: F.transform(column, lambda k: F.struct(k.alias("key"), F.lit(form).alias("named")))
    possible = probed.filter(hit).select("url", F.explode(F.concat(key(True, "keys"), key(False, "its_keys"))).alias("k")).select("url", "k.*").distinct()
    hits = possible.join(small(listed.select("key", "verdict", "named").distinct(), count), ["key", "named"])
    order = F.struct(F.length("key").alias("n"), F.col("key"), F.col("verdict"))
    decided = stash(hits.groupBy("url").agg(F.max(F.when(F.col("named"), order)).alias("best"), F.max(F.when(~F.col("named"), F.lit(1))).alias("other")), "decided")
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("other") == 1, "block"), F.lit("allow"))
    judged = probed.filter(hit).join(small(decided, decided.count()), "url", "left").select("page_id", "url", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))
    return judged.unionByName(probed.filter(~hit).select("page_id", "url", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict")))


def judge_by_rules(pages: DataFrame, unwanted: DataFrame | None = None) -> DataFrame:
    """`judge_urls` by the rules and the hosts beside them, and by the entries of ``unwanted`` (key) as well."""
    spark = pages.sparkSession
    listed = spark.createDataFrame([(k, v, True) for k, v in RULES] + [(k, "block", False) for k in LISTED], "key string, verdict string, named boolean")
    if unwanted is not None:
        listed = listed.unionByName(unwanted.select("key", F.lit("block").alias("verdict"), F.lit(False).alias("named")).distinct())
    return judge_urls(pages, listed).drop("url")
