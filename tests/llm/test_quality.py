import math
import os
import random

import pytest
from pyspark.sql import functions as F

from orrery.llm.quality import accepted, posterior, quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else None
    if not sf:
        pytest.skip("no tables")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) != 0
    got = {r["id"]: r for r in quality(docs, labels.where(train), host=F.col("source"), path=F.col("lang")).collect()}
    assert len(got) == docs.count()
    held = labels.where(~train).collect()
    assert len(held) > 60
    good = [got[r["doc_id"]] for r in held if r["quality"] == 1 and r["toxic"] == 0]
    bad = [got[r["doc_id"]] for r in held if r["quality"] == 0]
    assert sum(r["kept"] for r in good) / len(good) > 0.95
    assert sum(not r["kept"] for r in bad) / len(bad) > 0.85


def test_sites_shrink_and_decide_without_evidence(spark):
    text = "plain words here"
    rows = [(i, text, "good", "p") for i in range(200)] + [(1000 + i, text, "bad", "p") for i in range(200)] + [(2000, text, "bad", "q"), (2001, text, "new", None), (None, None, None, None), (2001, "", "new", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(1000 + i, 0, 0) for i in range(150)] + [(None, 0, 1), (5000, None, 1)], "doc_id long, quality int, toxic int")
    out = quality(docs, labels, host=F.col("host"), path=F.col("path")).collect()
    assert len(out) == len(rows)
    p = {r["id"]: r["p_quality"] for r in out}
    assert p[190] > 0.7 and p[1190] < 0.3 and p[1190] < p[2000] < p[190]
    assert p[1190] < p[2001] < p[190]
    kept = accepted(docs, labels, host=F.col("host"), path=F.col("path"))
    assert kept.columns == docs.columns and kept.where("doc_id = 190").count() == 1 and kept.where("doc_id = 1190").count() == 0


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a", 3)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r["p_quality"], r["kept"]) for r in quality(docs, labels).collect()] == [(0.5, True)]
    assert quality(docs.where("false"), labels).count() == 0


def test_posterior_against_a_plain_version(spark):
    """The hierarchy by loops: shares of hosts and paths with their strengths by moments, each row left out of its own site."""
    rng = random.Random(3)
    rows = [(h, p, rng.gauss(0, 1), float(rng.random() < share)) for h, share in (("a", 0.9), ("b", 0.2), ("c", 0.5)) for p in "xyz" for _ in range(rng.randint(1, 40))] + [("d", "x", 0.3, 1.0)]

    def strength(groups):  # (n, s, mean)
        n, k = sum(g[0] for g in groups), len(groups)
        within = max(sum(g[0] * g[2] * (1 - g[2]) for g in groups) / n, 1e-9)
        between = max(sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups) / n - within * k / n, within / 1e5)
        return min(max(within / between - 1, 1.0), 1e5)

    total = sum(r[3] for r in rows) / len(rows)
    hosts, paths = {}, {}
    for h, p, _, s in rows:
        for d, key in ((hosts, h), (paths, (h, p))):
            n, m = d.get(key, (0, 0.0))
            d[key] = n + 1, m + s
    k_host = strength([(n, s, total) for n, s in hosts.values()])
    k_path = strength([(n, s, (hosts[h][1] + k_host * total) / (hosts[h][0] + k_host)) for (h, _), (n, s) in paths.items()])
    want = []
    for h, p, e, s in rows:
        of_host = (hosts[h][1] - s + k_host * total) / (hosts[h][0] - 1 + k_host)
        of_path = (paths[h, p][1] - s + k_path * of_host) / (paths[h, p][0] - 1 + k_path)
        of_path = min(max(of_path, 1e-6), 1 - 1e-6)
        want.append(1 / (1 + math.exp(-e - math.log(of_path / (1 - of_path)))))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, host string, path string, e_q double, s_q double")
    got = {r["i"]: r["p_q"] for r in posterior(df, ["q"]).collect()}
    assert all(abs(got[i] - w) < 1e-9 for i, w in enumerate(want))


def test_rows_of_one_id_repeated_labels_and_long_texts(spark):
    good, bad = "the quiet river runs through the old town", "$$$ %%% &&& ### buy buy buy"
    docs = [(i, f"{good} {i} ", "h", i) for i in range(60)] + [(100 + i, f"{bad} {i} " * 3, "h", i) for i in range(60)]
    docs += [(500, good, "h", 1), (500, bad * 3, "h", 2), (500, good + " and the long road " * 40_000, "h", 3), (None, bad * 3, "h", 4), (None, good, "h", 5)]
    labels = [(i, 1, 0) for i in range(50)] + [(100 + i, 0, 0) for i in range(50)] + [(0, 1, 0), (0, 1, 0), (55, 1, 0), (55, 0, 1), (55, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, row string, key int").repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    runs = [sorted((str(r["id"]), r["p_quality"], r["p_toxic"], r["key"]) for r in quality(df, known.repartition(n)).collect()) for n in (1, 7)]
    assert len(runs[0]) == len(docs) and [r[::3] for r in runs[0]] == [r[::3] for r in runs[1]]
    assert all(abs(a[k] - b[k]) < 1e-6 for a, b in zip(*runs) for k in (1, 2))
    kept = accepted(df, known)
    assert kept.columns == df.columns
    left = [(r["doc_id"], r["key"]) for r in kept.collect()]
    assert (500, 1) in left and (500, 2) not in left and (None, 5) in left and (None, 4) not in left
