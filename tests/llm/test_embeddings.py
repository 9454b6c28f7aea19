import numpy as np

from orrery.llm import embeddings as E
from orrery.llm.embeddings import near_vectors
from orrery.llm.queries import op7_embedding_near_dedup


def brute(ids, vectors, threshold=0.9):
    ok = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)) if o else None for v, o in zip(vectors, ok, strict=True)]
    n, comp = [0] * len(ids), list(ids)
    links = [(i, j) for i in range(len(ids)) for j in range(i) if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
    for i, j in links:
        n[i] += 1
        n[j] += 1
    for _ in ids:
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
    return {d: (k, c, c == d) for d, k, c in zip(ids, n, comp, strict=True)}


def rows(df):
    return {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_against_brute_force_with_many_small_cells(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    x = np.concatenate([base, base[:25] + rng.normal(size=(25, 8)) * 0.3, base[:10], base[:10] + rng.normal(size=(10, 8)) * 0.1]).astype(float)
    ids = list(range(100, 100 + len(x)))
    df = spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), "vec_id long, embedding array<double>")
    want = brute(ids, list(x))
    assert rows(near_vectors(df, tile=4, exact=True)) == want
    assert rows(near_vectors(df)) == want
    assert sum(k for k, _, _ in want.values()) > 20


def test_recall_and_share_of_pairs_with_many_cells(spark):
    """Against brute force: links over borders of some 100 cells; the share of pairs that are compared falls with the cells."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9000, 64))
    noise = rng.normal(size=(1500, 64)) * np.linalg.norm(x[:1500], axis=1, keepdims=True) / 8
    x = np.concatenate([x, x[:1500] + noise * rng.uniform(0.1, 0.48, size=(1500, 1))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, 9000 + j) for i in range(1500) for j in range(1500) if i == j and unit[i] @ unit[9000 + j] >= 0.9}
    gram = unit @ unit.T
    assert {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(gram >= 0.9, 1)), strict=True)} == want and len(want) > 1300
    shares = []
    for k in (12, 50, 102):
        c = E._spherical_kmeans(unit, k)
        slope = np.sqrt(1 - 0.81) / 0.9 * min(1.0, E.REACH * E._spread(unit, c))
        home, visits = E.cells_of(unit, c, slope)
        size = np.bincount(home, minlength=k)
        shares.append((size @ (size - 1) / 2 + sum(size[v].sum() for v in visits)) / (len(unit) * (len(unit) - 1) / 2))
        met = sum(home[i] == home[j] or max(home[i], home[j]) in visits[i if home[i] < home[j] else j] for i, j in want)
        print(f"{k} cells: {shares[-1]:.3f} of the pairs compared, {met / len(want):.4f} of the links met")
        assert met >= 0.995 * len(want)
    assert shares[0] > shares[1] > shares[2]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = rows(near_vectors(df))
    assert sum(n for n, _, _ in got.values()) >= 2 * 0.995 * len(want)
    assert all(got[j][1] in (i, j) for i, j in want)


def test_each_length_has_a_sample_and_cells_of_its_own(spark):
    rng = np.random.default_rng(5)
    vs = [v for m, n in ((3, 900), (8, 60), (9, 5)) for v in rng.normal(size=(n, m)).tolist()]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "vec_id long, embedding array<double>")
    cells = E.fitted_cells(df.selectExpr("cast(vec_id as string) as key", "embedding as v"), 0.9, fit_rows=200, tile=50)
    assert {m: len(c) for m, (c, _) in cells.items()} == {3: 30, 8: 7}
    want = brute(list(range(len(vs))), vs)
    assert rows(near_vectors(df, fit_rows=200, tile=50, exact=True)) == want


def test_repeated_ids_and_ties(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    df = spark.createDataFrame([(1, a), (1, b), (2, b), (3, a), (3, a), (4, c), (None, a), (None, None)], "vec_id long, embedding array<double>")
    got = sorted((str(r["id"]), str(r["n_links"]), str(r["component_id"]), str(r["kept"])) for r in near_vectors(df).collect())
    one = [("1", "1", "1", "True"), ("1", "2", "1", "True"), ("2", "1", "1", "False"), ("3", "2", "1", "False"), ("3", "2", "1", "False"), ("4", "0", "4", "True")]
    assert got == sorted([*one, ("None", "None", "None", "None"), ("None", "None", "None", "None")])


def test_odd_vectors(spark):
    data = [(1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0, 0.0]), (6, [2.0, 0.0]), (7, [1.0, -0.0]), (8, [float("inf"), 0.0]), (9, [1.0]), (11, []), (12, [1e-200, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<double>, node string")
    got = rows(near_vectors(df))
    assert {k: got[k] for k in (5, 6, 7, 12)} == {5: (3, 5, True), 6: (3, 5, False), 7: (3, 5, False), 12: (3, 5, False)}
    assert all(got[k] == (0, k, True) for k in (1, 2, 3, 4, 8, 9, 11))
    assert near_vectors(df.where("false")).count() == 0
    assert rows(near_vectors(df.where("vec_id < 3"))) == {1: (0, 1, True), 2: (0, 2, True)}


def test_query(spark, sf_dir):
    data = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in op7_embedding_near_dedup(spark, sf_dir).collect()}
    assert got == brute([i for i, _ in data], [v for _, v in data])
