import math

import numpy as np
import pytest

from orrery.llm import vector_codes as V
from orrery.llm.queries import op12_vector_codes


def brute(rows, parts=8, entries=16, rounds=6):
    """Lloyd's rounds with all distances, in whole numbers."""
    kept = [(i, [math.floor(4096 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v: [v[p * w : p * w + w] for p in range(parts)]
    book = [[cut(v)[p] for _, v in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(book[p])), key=lambda e: (far(cut(v)[p], book[p][e]), e)) for p in range(parts)] for _, v in kept]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(book[p])):
                own = [cut(v)[p] for (_, v), c in zip(kept, codes, strict=True) if c[p] == e]
                if own:
                    book[p][e] = [sum(xs) // len(own) for xs in zip(*own, strict=True)]
    codes = assign()
    return {i: (c, sum(far(cut(v)[p], book[p][c[p]]) for p in range(parts))) for (i, v), c in zip(kept, codes, strict=True)}, book


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None if i is None or i % 3 == 0 else i % 3, 0.5) for i, v in rows], "vec_id long, embedding array<double>, label int, error double")


@pytest.mark.parametrize("case", ["normal", "ties", "few", "large"])
def test_against_brute_force(spark, case, monkeypatch):
    rng = np.random.default_rng(4)
    n, width = {"normal": (150, 16), "ties": (200, 8), "few": (7, 8), "large": (40, 8)}[case]
    x = rng.normal(size=(n, width))
    if case == "ties":
        x = rng.integers(-2, 3, size=(n, width)) / 4096
    if case == "large":
        x *= 10.0 ** rng.integers(0, 10, size=(n, 1))
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(n), x, strict=True)]
    monkeypatch.setattr(V, "BLOCK", 13)
    found, book = V.vector_codes(frame(spark, rows))
    want, want_book = brute(rows)
    assert book.tolist() == want_book
    got = {r["id"]: r for r in found.collect()}
    assert {i: (r["codes"], r["error"]) for i, r in got.items()} == {i: (c, e if e < 2**63 else None) for i, (c, e) in want.items()}
    for label in (None, 1, 2):
        total = sum(e for i, (_, e) in want.items() if (i % 3 or None) == label)
        assert {r["label_error"] for r in got.values() if r["label"] == label} == {total if total < 2**63 else None}


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(3000, 2, 4)) * 1000 + rng.integers(-20_000, 20_000, size=(12, 2, 4))[rng.integers(12, size=3000)]).astype(np.int64)
    old = x[:16].swapaxes(0, 1).copy()
    codes, high, low = V.first_codes(x, old)
    spent = 0
    for _ in range(5):
        new = old + rng.integers(-60, 60, old.shape)
        codes, high, low, n = V.next_codes(x, new, V.moved_by(old, new), codes, high, low)
        far = ((x[:, :, None] - new[None]) ** 2).sum(-1)
        assert (codes == far.argmin(2)).all()
        real = np.sqrt(far)
        assert (high.astype(float) >= np.take_along_axis(real, codes[:, :, None], 2)[:, :, 0]).all() and (low.astype(float) <= real).all()
        spent += n
        old = new
    assert spent < 0.5 * 5 * 3000 * 2 * 16


def test_rows_without_a_code(spark):
    nan, inf = float("nan"), float("inf")
    v = [float(i) for i in range(8)]
    rows = [(1, v), (2, None), (3, [nan] + v[1:]), (4, [None] + v[1:]), (5, [-inf] + v[1:]), (6, [1e300] + v[1:]), (7, []), (8, v + v), (9, v[:3]), (1, v), (None, v), (1, [-x for x in v])]
    found, book = V.vector_codes(frame(spark, rows))
    got = found.collect()
    assert sorted((str(r["id"]), r["codes"] is not None) for r in got) == sorted([("1", True), ("1", True), ("1", True), ("None", True), ("7", False), ("8", False), ("9", False)])
    assert book.shape == (8, 4, 1) and all(r["error"] == 0 for r in got if r["codes"] is not None)
    assert np.array_equal(V.decoded(next(r["codes"] for r in got if r["id"] is None), book), v)
    assert V.vector_codes(frame(spark, []))[0].count() == 0
    assert V.vector_codes(frame(spark, [(1, None)]))[0].count() == 0


def test_query_on_vectors_with_copies(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist() if i % 3 else [0.25] * 8, i % 2) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r for r in op12_vector_codes(spark, str(tmp_path)).collect()}
    want, _ = brute([(i, [float(np.float32(x)) for x in v]) for i, v, _ in rows])
    assert {i: (r["code"], r["error"]) for i, r in got.items()} == {i: ("".join(f"{x:02x}" for x in c), e) for i, (c, e) in want.items()}
    assert len({r["codebooks_sha256"] for r in got.values()}) == 1
