import random
import re

import numpy as np
import pytest

from inkframe.llm import shingles as shingles_of
from inkframe.llm.common import drop, stash
from inkframe.llm.components import components, join_spread
from inkframe.llm.ngram_join import jaccard_components, keep_one, sketch_bits

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in sets}
    changed = True
    links = [(a, b) for a, x in sets for b, y in sets if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return sorted((i, len(s), label[i]) for i, s in sets)


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    line = " ".join(r.choices(words, k=9))
    rows = []
    for k in range(60):
        if rows and r.random() < 0.6:
            own = (r.choice(rows)[1] or "").split(" ")
            for _ in range(r.choice((0, 1, 1, 2))):
                if own:
                    own[r.randrange(len(own))] = r.choice(words)
        else:
            own = r.choices(words, k=r.choice((0, 1, 3, 5, 12, 60, 120)))
        text = r.choice((" ", "\n", "\t ")).join(own) + (f" {line}" if r.random() < 0.4 else "")
        rows.append((k * 3 + 1, text.upper() if r.random() < 0.2 else text))
    return [*rows, (500, None), (501, ""), (502, " \n"), (503, "é É ß"), (504, "É É ß"), (505, "é é ß")]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize(("block", "large"), [(2_000_000, 4096), (150, 3)])
def test_components_equal_brute_force(spark, seed, block, large):
    rows = corpus(seed)
    found = jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(5), block=block, large=large)
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_large_near_copies_over_several_chunks(spark):
    r = random.Random(1)
    base = [f"b{k}" for k in range(80)]
    rows = []
    for k in range(150):
        own = list(base)
        own[r.randrange(80)] = f"x{k}"
        rows.append((k, " ".join(own)))
    rows += [(200 + k, " ".join(base[:40] + [f"y{k}_{j}" for j in range(40)])) for k in range(20)]
    found = jaccard_components(spark.createDataFrame(rows, SCHEMA), block=2000, large=20)
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_repeated_rows_extra_columns_and_empty_table(spark):
    rows = [(1, "a b c d e f", 9, 9), (1, "a b c d e f", 9, 9), (2, "A b c d e f", 8, 8), (3, None, 1, 1), (None, "a b c d e f", 1, 1), (4, "word " * 30000, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sid long, block long")
    found = sorted(map(tuple, jaccard_components(docs).collect()), key=str)
    assert found == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (None, 2, 1), (4, 1, 4)], key=str)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, None]
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(50, 60)] + [(3, 3)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert {found[k] for k in range(100, 141)} == {100} and {found[k] for k in range(50, 60)} == {7}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hot_keys_are_dealt_and_stashes_deleted(spark, tmp_path):
    rows = stash(spark.createDataFrame([(k, 1 if k < 400 else k) for k in range(500)], "n long, k long"), "rows")
    one = spark.createDataFrame([(1, "hot"), (450, "x"), (9999, "none")], "k long, v string")
    for how, size in (("inner", 401), ("left", 500)):
        found = join_spread(rows, one, "k", how, hot=50)
        assert sorted(found.columns) == ["k", "n", "v"] and found.count() == size and found.filter("v = 'hot'").count() == 400
    assert join_spread(rows, one, "k", hot=1000).count() == 401
    drop(rows)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound|FILE_NOT_EXIST"):
        rows.count()
    edges = [(1, k) for k in range(2, 200)] + [(500 + k, 501 + k) for k in range(60)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long"), hot=10).collect()))
    assert {found[k] for k in range(1, 200)} == {1} and {found[k] for k in range(500, 561)} == {500}


def test_long_texts_are_read_in_parts(monkeypatch):
    r = random.Random(4)
    texts = ["", "Ab c", " ".join(r.choice(["x", "yy", "ÉÉ", "zz\tq"]) for _ in range(3000)), "", "w" * 5000, "one two three four five six"]
    data = [t.encode() for t in texts]
    buffer, offsets = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    whole = shingles_of.shingle_sets(buffer, offsets)
    monkeypatch.setattr(shingles_of, "PART", 700)
    parts = shingles_of.shingle_sets(buffer, offsets)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert np.diff(parts[1]).tolist() == [len(shingles(t)) for t in texts]


def test_sketch_grows_with_the_input():
    assert [sketch_bits(n) for n in (1, 32, 256, 1000, 100_000, 10**6, 10**9)] == [18, 18, 18, 18, 22, 23, 24]
