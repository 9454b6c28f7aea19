import math
import zlib
from collections import Counter

import numpy as np

from orrery.llm import language_model as M
from orrery.llm.common import ascii_words
from orrery.llm.queries import op6_lm_scoring


def test_query_against_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: ascii_words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    c = Counter()
    for d, ws in docs.items():
        if not held[d]:
            c.update([*ws, M.END])
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in op6_lm_scoring(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    for d, ws in docs.items():
        r, tokens = got[d], [*ws, M.END]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), rel_tol=1e-9)
    for side in (True, False):
        own = [r for r in got.values() if r["held_out"] == side]
        assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own) * 0.97
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got.values())


def test_model_is_a_distribution():
    rng = np.random.default_rng(0)
    k = 5
    counts = rng.integers(0, 9, ((2 * k + 1), (2 * k + 1)))
    counts[2 * k], counts[:, 2 * k] = 0, 0
    p = 10 ** M.transitions(counts.ravel(), k)
    assert np.allclose(p.sum(axis=1), 1)


def test_exchange_finds_the_classes_of_an_alternating_text():
    rng = np.random.default_rng(1)
    kinds = rng.integers(0, 2, 400)
    kinds[0] = 0
    # Words of kind 0 are followed by kind 1 and the other way round.
    after, before, of = np.zeros((401, 4)), np.zeros((401, 4)), np.minimum(np.arange(401), 2)
    kind = np.append(-1, kinds)
    for _ in range(6):
        after[:], before[:] = 0, 0
        seq = [0]
        r = np.random.default_rng(2)
        pools = [np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)]
        seq += [int(r.choice(pools[i % 2])) for i in range(20_000)]
        for a, b in zip(seq, seq[1:], strict=False):
            after[a, of[b]] += 1
            before[b, of[a]] += 1
        of = M.exchange(after, before, of, 3)
    first = np.bincount(of[pools[0]], minlength=3)
    assert of[0] == 0 and max(first) > 0.98 * len(pools[0])
    assert np.argmax(np.bincount(of[pools[1]], minlength=3)) != np.argmax(first)


def test_odd_rows(spark):
    rows = [(None, "a b", 1), (1, None, 1), (1, "", 1), (2, "A  b\tc", 1), (3, "c " * 50_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = sorted((r["id"] or 0, r["n_tokens"], r["n_known"]) for r in M.class_bigram_scores(df, block_bytes=1000).collect())
    held = {i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 5 == 1}
    assert [g[:2] for g in got] == [(0, 3), (1, 1), (1, 1), (2, 4), (3, 50_001)]
    assert held or all(a[1] == a[2] for a in got)
    from pyspark.sql import functions as F

    none = M.class_bigram_scores(df, held_out=F.lit(True)).collect()
    assert len(none) == 5 and all(r["score"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 for r in none)
    assert M.class_bigram_scores(df.where("false")).count() == 0


def test_blocks_of_several_batches(spark):
    words = [f"w{i}" for i in range(60)]
    docs = {d: " ".join(words[(7 * d + 3 * j * j) % (20 + 2 * d)] for j in range(12)) for d in range(20)}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    c = Counter(w for d, t in docs.items() if not held[d] for w in [*ascii_words(t), M.END])
    n, v = sum(c.values()), len(c)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = {r["id"]: r for r in M.class_bigram_scores(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), core_words=4).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for d, t in docs.items():
        tokens = [*ascii_words(t), M.END]
        assert (got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert math.isclose(got[d]["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), rel_tol=1e-9)
