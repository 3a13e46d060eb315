"""N-gram Jaccard self-join of whole texts, and its connected components.

Plan, exact at every size (up to 64-bit hash collisions):

1. One pass over the texts makes each document's set of distinct word shingles, its size, a token
   bitmap and a 64-bit class id (documents with equal sets are one class, so copies never meet each
   other), and a sketch of shingle counts over all documents, whose buckets grow with the input
   (2^18 up to 256 scan partitions, at most 2^24).
2. Prefix filter: under any one global order of the shingles, two sets of size n and m with a
   Jaccard of t or more share a shingle among the first n - ceil(t n) + 1 of the one and
   m - ceil(t m) + 1 of the other. The order puts shingles of rare sketch buckets first (buckets are
   ranked by their counts, none is cut), so a line that a third of all documents hold isn't in the
   prefix of documents that hold more than it.
   Postings are dealt by shingle and streamed; sets that share one are a group, broken where sizes
   are too far apart. A signature tree over each group's bitmaps is traversed against itself, and
   pairs that its bounds can't rule out become candidate edges, at most a spanning forest for each
   task. Groups over ``LARGE`` sets aren't held: as they stream by, each set becomes a candidate edge
   with the first, so the tree is traversed later, in the chunks of their block.
   Components of the candidate edges are blocks: no link leaves one.
3. Inside a block a signature tree is traversed against itself, and what it can't prune is compared
   exactly. A block over ``BLOCK`` shingles is dealt in chunks: chunks on their own, then one hub set
   against all chunks, then only the sets outside the hub's component against every chunk.

Joins on classes, blocks and components deal hot keys over several tasks. Intermediate tables are
deleted once all that was made of them is written.

Nulls, empty texts and texts without words have an empty set and are linked with nothing.
Repeated rows are copies. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, drop, raw, runs, slices, small_batches, stash
from .components import components, join_spread
from .shingles import WIDTH, shingle_sets
from .sigtree import Groups, Tree, bitmap, buckets_for, linked, set_tree, traverse

SLICE = 1 << 14
BLOCK = 2_000_000
LARGE = 4096
MAP = 256
_PASS = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("counts", pa.binary())])
_GROUP = pa.schema([("grp", pa.int64()), ("sid", pa.int64()), ("first", pa.int64())])
_POST = pa.schema([("token", pa.int64()), ("n", pa.int64()), ("sid", pa.int64())])
_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_LINK = pa.schema([("task", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("members", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def sketch_bits(partitions: int) -> int:
    """The binary logarithm of the sketch's buckets."""
    return min(24, 18 + max(0, partitions.bit_length() - 9) // 2)


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in slices(batches):
        yield batch, *shingle_sets(*raw(batch.column("text")), width)


def _maps(tokens: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """The token bitmap of each set as counts of one byte (255: that or more); none of an empty set.

    A bitmap has 256 buckets, or more for more than 16 tokens a bucket: by chance, unlike sets share
    fewer tokens by its bound than a link needs.
    """
    rows, sizes = len(at) - 1, np.diff(at)
    of = np.repeat(np.arange(rows), sizes)
    counts = np.bincount(of * MAP + (tokens & np.uint64(MAP - 1)).astype(np.int64), minlength=rows * MAP).reshape(rows, MAP)
    out = [row.tobytes() if n else None for row, n in zip(np.minimum(counts, 255).astype("u1"), sizes.tolist(), strict=True)]
    for i in np.flatnonzero(sizes > 16 * MAP).tolist():
        out[i] = np.minimum(bitmap(tokens[at[i] : at[i + 1]], 1 << int(sizes[i] // 16).bit_length()), 255).astype("u1").tobytes()
    return out


def _map_table(maps: list[bytes]) -> np.ndarray:
    """Bitmaps side by side, folded to the fewest buckets among them; 255 bounds nothing."""
    buckets = min(map(len, maps))
    counts = [np.frombuffer(m, "u1").astype(np.uint32) for m in maps]
    return np.stack([np.where(c == 255, 1 << 20, c).astype(np.uint32).reshape(-1, buckets).sum(axis=0, dtype=np.uint32) for c in counts])


def _first_pass(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, np.int64)
        for batch, tokens, at in _sets(batches, width):
            np.add.at(seen, (tokens >> np.uint64(64 - bits)).astype(np.int64), 1)
            n = np.diff(at)
            sids = [set_id(tokens[at[i] : at[i + 1]]) if n[i] else 0 for i in range(len(n))]
            rows = len(n)
            yield arrow_rows(_PASS, kind=[0] * rows, doc_id=batch.column("doc_id").cast(pa.int64()), n=n, sid=sids, counts=_maps(tokens, at))
        parts = [k for k in range(len(seen) // SLICE) if seen[k * SLICE : (k + 1) * SLICE].any()]
        none = [None] * len(parts)
        yield arrow_rows(_PASS, kind=[1] * len(parts), doc_id=none, n=parts, sid=none, counts=[zlib.compress(seen[k * SLICE : (k + 1) * SLICE].astype("<u4").tobytes(), 1) for k in parts])

    return run


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A slice's sums so far, a row per slice: the input is sorted by slice, at most one row of it from each task."""
    schema = pa.schema([("n", pa.int64()), ("counts", pa.binary())])
    for run in runs(batches, "n"):
        total = np.zeros(SLICE, np.int64)
        for x in run.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), "<u4")
        yield arrow_rows(schema, n=[run.column("n")[0].as_py()], counts=[total.astype("<i8").tobytes()])


def _postings(rank, percent: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = rank.value
        shift = np.uint64(65 - len(places).bit_length())
        done: set[int] = set()
        for _, tokens, at in _sets(batches, width):
            keys = (places[(tokens >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(40)) | (tokens & np.uint64((1 << 40) - 1))
            out, ns, sids = [], [], []
            for i in range(len(at) - 1):
                n = int(at[i + 1] - at[i])
                if not n or (sid := set_id(tokens[at[i] : at[i + 1]])) in done:
                    continue
                done.add(sid)
                prefix = n - (percent * n + 99) // 100 + 1
                out.append(np.unique(np.partition(keys[at[i] : at[i + 1]], prefix - 1)[:prefix]))
                ns.append(np.full(len(out[-1]), n))
                sids.append(np.full(len(out[-1]), sid))
            if out:
                yield arrow_rows(_POST, token=np.concatenate(out).astype(np.int64), n=np.concatenate(ns), sid=np.concatenate(sids))

    return run


def _groups(percent: int, most: int):
    """Rows (grp, sid) of the sets that share a shingle, sizes never too far apart from one to the next; groups
    that a task has met before are left out. Of larger groups rows with their first set, as they stream by,
    and each set as a group of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        kept = np.zeros((3, 0), np.int64)
        large: tuple[int, int, int] | None = None  # token, last size and first set of a group that goes on
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close(token: np.ndarray, n: np.ndarray, sid: np.ndarray) -> None:
            """All groups of these rows, whose last is complete."""
            if not len(token):
                return
            new = np.concatenate(([True], (token[1:] != token[:-1]) | (100 * n[:-1] < percent * n[1:])))
            first = np.flatnonzero(new)
            size = np.diff(np.concatenate((first, [len(token)])))
            for a, k in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                own = sid[a : a + k]
                if k == 2 and own[0] == own[1]:
                    continue
                own = np.unique(own)
                if len(own) > 1 and (key := hash(own.tobytes())) not in met:
                    met.add(key)
                    if len(own) > most:
                        out.append((own[1:], own[1:], own[1:] * 0 + own[0]))
                    else:
                        grp = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)
                        out.append((np.full(len(own), grp), own, np.zeros(len(own), np.int64)))

        def flush() -> pa.RecordBatch:
            grp, sid, first = (np.concatenate(x) for x in zip(*out, strict=True))
            out.clear()
            return arrow_rows(_GROUP, grp=grp, sid=sid, first=first)

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("token", "n", "sid")])
            if not rows.shape[1]:
                continue
            if large is not None:  # rows that go on a large group
                token, last, first = large
                ns = np.concatenate(([last], rows[1]))
                goes = np.logical_and.accumulate((rows[0] == token) & (100 * ns[:-1] >= percent * ns[1:]))
                k = int(goes.sum())
                if k:
                    out.append((rows[2][:k], rows[2][:k], rows[2][:k] * 0 + first))
                    large = (token, int(rows[1][k - 1]), first)
                if k == rows.shape[1]:
                    continue
                large, rows = None, rows[:, k:]
            rows = np.concatenate((kept, rows), axis=1)
            end = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            close(*rows[:, :end])
            kept = rows[:, end:]
            if kept.shape[1] > 2 * most:
                token, n, sid = kept
                cut = np.flatnonzero(100 * n[:-1] < percent * n[1:])
                at = int(cut[-1]) + 1 if len(cut) else 0
                close(token[:at], n[:at], sid[:at])
                if len(sid) - at > most:
                    large = (int(token[-1]), int(n[-1]), int(sid[at]))
                    out.append((sid[at:], sid[at:], sid[at:] * 0 + sid[at]))
                    kept = kept[:, :0]
                else:
                    kept = kept[:, at:]
            if out:
                yield flush()
        close(*kept)
        if out:
            yield flush()

    return run


def _candidates(percent: int):
    """Edges between sets of a group whose bitmaps allow a link; a spanning forest for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups()
        for table in runs(batches, "grp"):
            firsts = table.column("first").to_pylist()
            if any(firsts):
                pairs = [(u, v) for u, v in zip(table.column("sid").to_pylist(), firsts, strict=True) if v and groups.join(u, v)]
                yield arrow_rows(_EDGE, u=[u for u, _ in pairs], v=[v for _, v in pairs])
                continue
            rows = dict(zip(table.column("sid").to_pylist(), zip(table.column("n").to_pylist(), table.column("counts").to_pylist(), strict=True), strict=True))
            if len({groups.find(s) for s in rows}) < 2:
                continue
            members = sorted(rows, key=lambda s: (rows[s][0], s))
            tree = Tree(members, _map_table([rows[s][1] for s in members]), np.array([rows[s][0] for s in members], np.int64))
            if found := traverse(tree, tree, groups, percent, lambda i, j: True):
                yield arrow_rows(_EDGE, u=[i for i, _ in found], v=[j for _, j in found])

    return run


def _task_sets(table: pa.Table, width: int) -> tuple[list[np.ndarray], list[int], list[int]]:
    """The sets of a task's rows whose text is still that of their class, each class once; class ids and roles."""
    sets, sids, roles = [], [], []
    seen: set[tuple[int, int]] = set()
    table = table.combine_chunks()
    for batch in slices(table.to_batches()):
        tokens, at = shingle_sets(*raw(batch.column("text")), width)
        for i, (sid, role) in enumerate(zip(batch.column("sid").to_pylist(), batch.column("role").to_pylist(), strict=True)):
            own = tokens[at[i] : at[i + 1]]
            if (sid, role) not in seen and len(own) and set_id(own) == sid:
                seen.add((sid, role))
                sets.append(own.copy())
                sids.append(sid)
                roles.append(role)
    return sets, sids, roles


def _link_tasks(percent: int, width: int):
    """Role 0: sets to compare with each other; 1: the hub; 2: sets of a chunk; 3: sets outside the hub's component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "task"):
            sets, sids, roles = _task_sets(table, width)
            if len(sets) < 2:
                if sets and roles[0] == 0:
                    yield arrow_rows(_LINK, task=table.column("task")[:1].combine_chunks(), u=sids, v=sids, members=[1])
                continue
            groups = Groups()

            def check(i: int, j: int, sets: list[np.ndarray] = sets) -> bool:
                return linked(sets[i], sets[j], percent)

            buckets = buckets_for([len(x) for x in sets])
            task = table.column("task")[0].as_py()
            by = {r: [i for i, x in enumerate(roles) if x == r] for r in set(roles)}
            if 0 in by:
                tree = set_tree(sets, by[0], buckets)
                traverse(tree, tree, groups, percent, check)
                roots = [groups.find(i) for i in by[0]]
                size = {r: roots.count(r) for r in set(roots)} if len(roots) < 64 else dict(zip(*(x.tolist() for x in np.unique(roots, return_counts=True)), strict=True))
                yield arrow_rows(_LINK, task=[task] * len(roots), u=sids, v=[sids[r] for r in roots], members=[size[r] for r in roots])
            elif 1 in by:
                hub = by[1][0]
                hit = [i for i in by.get(2, []) if linked(sets[i], sets[hub], percent)]
                yield arrow_rows(_LINK, task=[task] * len(hit), u=[sids[i] for i in hit], v=[sids[hub]] * len(hit), members=[0] * len(hit))
            elif 2 in by and 3 in by:
                hits = traverse(set_tree(sets, by[2], buckets), set_tree(sets, by[3], buckets), groups, percent, check)
                yield arrow_rows(_LINK, task=[task] * len(hits), u=[sids[i] for i, _ in hits], v=[sids[j] for _, j in hits], members=[0] * len(hits))

    return run


def jaccard_components(docs: DataFrame, percent: int = 80, width: int = WIDTH, block: int = BLOCK, large: int = LARGE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable by links, the document itself included.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits = sketch_bits(docs.rdd.getNumPartitions())
    first = stash(docs.mapInArrow(_first_pass(width, bits), _ddl(_PASS)), "sets")
    sets = first.filter("kind = 0").select("doc_id", "n", "sid")
    maps = first.filter("kind = 0 AND n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("counts").alias("counts"))
    sums = first.filter("kind = 1").select("n", "counts").repartition("n").sortWithinPartitions("n").mapInArrow(_sum_slices, "n bigint, counts binary")
    counts = np.zeros(1 << bits, np.int64)
    for row in sums.toLocalIterator():  # at most 2^24 numbers, however large the input
        counts[row["n"] * SLICE : (row["n"] + 1) * SLICE] = np.frombuffer(row["counts"], "<i8")
    places = np.empty(len(counts), np.uint32)
    places[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint32)
    rank = spark.sparkContext.broadcast(places)

    posted = docs.mapInArrow(_postings(rank, percent, width), _ddl(_POST))
    grouped = posted.repartition("token").sortWithinPartitions("token", "n", "sid").mapInArrow(_groups(percent, large), _ddl(_GROUP))
    mapped = grouped.join(maps, "sid").repartition("grp").sortWithinPartitions("grp", "first")
    near = mapped.mapInArrow(_candidates(percent), _ddl(_EDGE))
    blocks = components(near).withColumnRenamed("node", "sid").withColumnRenamed("label", "block")

    classes = sets.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"))
    found_members = stash(blocks.join(classes, "sid"), "members")
    loads = found_members.groupBy("block").agg(F.sum("n").alias("load"), F.count("*").alias("size")).filter("size > 1")
    loads = loads.select("block", F.ceil(F.greatest(F.col("load") / block, F.col("size") * 500 / block)).cast("int").alias("chunks"))
    members = join_spread(found_members, loads, "block").withColumn("chunk", F.pmod(F.xxhash64("sid"), "chunks").cast("int"))
    fetched = docs.join(members.hint("merge"), docs["doc_id"] == members["low"]).select("sid", "block", "chunks", "chunk", "text")
    members = members.select("sid", "block", "chunks", "chunk")

    def link(rows: DataFrame) -> DataFrame:
        dealt = rows.select("task", "role", "sid", "text").repartition("task").sortWithinPartitions("task")
        return dealt.mapInArrow(_link_tasks(percent, width), _ddl(_LINK))

    alone = fetched.select(F.when(F.col("chunks") == 1, F.col("block")).otherwise(F.xxhash64("block", "chunk")).alias("task"), F.lit(0).alias("role"), "sid", "text")
    found = link(alone)
    if members.filter("chunks > 1").limit(1).count():
        labels = _across_chunks(docs, members, classes, stash(found, "chunks"), link)
    else:
        labels = found.select(F.col("u").alias("sid"), F.col("v").alias("label"))
    labels = stash(labels.join(classes.select("sid", "low"), "sid"), "linked")
    drop(found_members)
    lows = labels.groupBy("label").agg(F.min("low").alias("component"))
    linked_to = stash(join_spread(labels, lows, "label").select("sid", "component"), "components")
    drop(labels)
    copies = classes.join(linked_to, "sid", "left").select("sid", F.coalesce("component", "low").alias("component"))
    empty = sets.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    full = join_spread(sets.filter("n > 0"), copies, "sid").select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return full.unionByName(empty)


def _across_chunks(docs: DataFrame, members: DataFrame, classes: DataFrame, found: DataFrame, link) -> DataFrame:
    """Labels of all sets, links between the chunks of large blocks included."""
    own = found.select(F.col("u").alias("sid"), F.col("v").alias("root"), F.col("members").alias("size"))
    large = stash(members.filter("chunks > 1").join(own, "sid"), "large")
    hubs = large.groupBy("block").agg(F.max(F.struct("size", F.col("root").alias("hub")))["hub"].alias("hub"))
    texts = large.join(classes.select("sid", "low"), "sid").join(docs, F.col("doc_id") == F.col("low")).select("sid", "block", "chunks", "chunk", "root", "text")
    texts = stash(texts, "large-texts")
    hub_texts = hubs.join(texts.select(F.col("sid").alias("hub"), "text", "chunks"), "hub")
    to_chunks = hub_texts.select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("role"), F.col("hub").alias("sid"), "text")
    parts = texts.select("block", "chunk", F.lit(2).alias("role"), "sid", "text")
    key = F.xxhash64("block", "chunk").alias("task")
    by_hub = stash(link(parts.unionByName(to_chunks).select(key, "role", "sid", "text")), "hubs").select("u", "v")
    joined = by_hub.join(large.select(F.col("sid").alias("u"), "root"), "u").select("root").union(hubs.select(F.col("hub").alias("root"))).distinct()
    outside = stash(join_spread(texts, joined.withColumn("hit", F.lit(True)), "root", "left").filter("hit IS NULL").select(texts.columns), "outside")
    groups = outside.groupBy("block").agg(F.sum(F.length("text")).alias("b"), F.count("*").alias("c"))
    groups = groups.select("block", F.ceil(F.greatest(F.col("b") / 8_000_000, F.col("c") / 4000)).cast("int").alias("sides"))
    outside = join_spread(outside, groups, "block")
    right = outside.withColumn("side", F.pmod(F.xxhash64("sid", F.lit(1)), "sides").cast("int"))
    right = right.select("block", "side", "sid", "text", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(3).alias("role"))
    left = join_spread(texts, groups, "block").select("block", "chunk", "sid", "text", F.lit(2).alias("role"), F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side"))
    tasks = left.unionByName(right).select(F.xxhash64("block", "chunk", "side").alias("task"), "role", "sid", "text")
    across = link(tasks).select("u", "v")
    edges = own.select(F.col("sid").alias("u"), F.col("root").alias("v")).union(by_hub).union(across)
    wide = components(edges).withColumnRenamed("node", "sid")
    return own.select("sid").join(wide, "sid", "left").select("sid", F.coalesce("label", "sid").alias("label"))


def keep_one(docs: DataFrame, percent: int = 80, width: int = WIDTH) -> DataFrame:
    """The documents of ``docs`` that are the first of their component, each once; rows without a doc_id stay."""
    found = jaccard_components(docs, percent, width)
    firsts = found.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))
