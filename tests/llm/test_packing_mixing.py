import bisect
import math
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from oracle import SF
from test_join import brute
from tokenizers import Tokenizer

from inkframe.llm import mixing, packing, secrets

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a\x0bb \x85 c d\x1ce İstanbul ΣΑΣ Σ é ́x it's 'S can't<|endoftext|>x <|endoftext|>  ﬁ ½ 12３", "ÀÉÿĀ ×÷ a'll..'s 'd'm''re \x7f ŉ Ĳ", " ", "", None, "日本語 テスト 🙂 word", "x" * 30000, "word " * 9000]


def check_packing(rows, found, window=2048):
    tokenizer = Tokenizer.from_file(PATH)
    want = defaultdict(int)
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), window):
            piece = ids[start : start + window]
            want[i, start, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)] += 1
    have, places = defaultdict(int), defaultdict(list)
    for r in found:
        have[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    return places


def test_pieces_cover_each_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    places = check_packing(rows, packing.pack(docs.repartition(4)).collect())
    tokens = sum(n for own in places.values() for _, n in own)
    assert tokens / (2048 * len(places)) > 0.95
    odd = [(k, t) for k, t in enumerate(ODD)] + [(0, ODD[0]), (None, "no id")]
    frame = spark.createDataFrame([(*r, 1) for r in odd], "doc_id long, text string, slot int")
    check_packing(odd, packing.pack(frame).collect())
    assert packing.pack(frame.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_equals_a_plain_one(seed):
    r = random.Random(seed)
    lengths = sorted((r.randrange(1, 101) for _ in range(400)), reverse=True)
    caps, plain = [], []
    for length in lengths:
        at = bisect.bisect_left(caps, length)
        cap = caps.pop(at) if at < len(caps) else 100
        plain.append(100 - cap)
        if cap > length:
            bisect.insort(caps, cap - length)
    found = packing.best_fit(lengths, 100)
    assert [offset for _, offset in found] == plain


def sources(rows):
    tokens = defaultdict(int)
    for _, text, source in rows:
        tokens[source] += len((text or "").split())
    return {s: t for s, t in tokens.items() if t}


def mix_rows(seed=0, n=400):
    r = random.Random(seed)
    return [(k, r.choice((None, "", *(["w " * r.randrange(1, 60)] * 8))), r.choice(["big"] * 12 + ["mid"] * 5 + ["small", None])) for k in range(n)]


@pytest.mark.parametrize("limit", [1.0, 1.5, 4.0])
def test_mix_repeats_up_to_the_limit(spark, limit):
    rows = mix_rows()
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_repeats=limit).toPandas()
    assert set(found.doc_id) == {r[0] for r in rows}
    assert not found.duplicated(["doc_id", "mix_copy"]).any() and found.mix_position.between(0, 1).all()
    tokens = sources(rows)
    low, high = 0.0, 1.0
    for _ in range(60):  # the exponent by plain bisection
        mid = (low + high) / 2
        epochs = [t ** (mid - 1) for t in tokens.values()]
        low, high = (mid, high) if max(epochs) / min(epochs) > limit else (low, mid)
    top = max(tokens.values())
    for source, total in tokens.items():
        own = found[found.source.isna() if source is None else found.source == source]
        epochs = (total / top) ** (high - 1)
        assert own.mix_epochs.iloc[0] == pytest.approx(epochs, rel=1e-5)
        assert epochs * total - 1e-3 <= own.mix_tokens.sum() + 1e-6 <= epochs * total + 60
        assert own.groupby("doc_id").size().max() <= math.ceil(limit)


def test_exponent_meets_an_entropy(spark):
    rows = spark.createDataFrame([(5000,), (900,), (40,), (3,)], "tokens long")
    a = mixing.exponent(rows, max_repeats=None, target_entropy=1.0)
    w = np.array([5000, 900, 40, 3], float) ** a
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(1.0, abs=1e-5)
    budget = mixing.exponent(rows, budget=2000.0, max_repeats=2.0)
    w = np.array([5000, 900, 40, 3], float) ** budget
    assert max(w / w.sum() * 2000 / np.array([5000, 900, 40, 3])) == pytest.approx(2.0, rel=1e-4)


def test_mix_with_a_small_budget_and_odd_tables(spark):
    rows = [(k, "w " * 10, "a") for k in range(100)] + [(100, None, "b"), (101, "", "b")]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, source string, mix_block int, block_start int")
    part = mixing.mix(docs, budget=500.0, max_repeats=4.0)
    assert part.filter("source = 'a'").count() == 50 and part.filter("source = 'b'").count() == 2
    assert part.columns.count("mix_block") == 1 and "block_start" in part.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_is_native(spark):
    rows = spark.createDataFrame(mix_rows(n=50), "doc_id long, text string, source string")
    plan = mixing.mix(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEval", "Arrow")


def test_pipeline_against_plain_python(spark):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    kept = [r for r in rows if any(map(str.isalpha, r.text or ""))]
    first = {i for i, _, c in brute([(r.doc_id, r.text) for r in kept]) if i == c}
    clean = []
    for r in kept:
        if r.doc_id in first:
            base = secrets.base_spans(r.text)
            clean.append((r.doc_id, secrets.redact(r.text, base + secrets.novel_spans(r.text, base, secrets.Novelty())), r.source))
    tokens = sources(clean)
    frame = spark.createDataFrame(clean, "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["count"] for r in mixing.mix(frame, max_repeats=corpus_pipeline.MAX_REPEATS).groupBy("doc_id").count().collect()}
    assert set(copies) == first and max(copies.values()) <= 2 and len(tokens) > 1
    found = corpus_pipeline.run(spark, SF).collect()
    check_packing([(i, t) for i, t, _ in clean for _ in range(copies[i])], found)


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
