import random

import xxhash
from pyspark.sql import functions as F

from orrery.llm import simhash
from orrery.llm.queries import op9_simhash_near_dedup


def brute_fp(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def test_query_against_brute_force(spark, sf_dir):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    fps = [brute_fp(t) for _, t in docs]
    want = {d: (f"{f:016x}", docs[c][0]) for (d, _), f, c in zip(docs, fps, brute_components(fps), strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op9_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == want
    assert any(c != d for d, (_, c) in got.items())


def test_links_find_every_pair_within_the_radius(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:40]:
        g = f
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
            g ^= 1 << b
        fps.append(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = brute_components(fps)
    for tile in (4, 2048):
        nodes = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
        from orrery.llm.components import connected_components

        got = {r["node"]: r["component"] for r in connected_components(simhash.simhash_links(nodes, 3, tile)).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == want


def test_odd_rows(spark):
    rows = [(5, None, 1), (6, "", 1), (7, " \n\t", 1), (None, "a b c d", 1), (8, "a b c d", 1), (8, "A b  c d", 1), (9, "one", 1), (10, "x" * 200_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = [(r["id"], r["component_id"]) for r in simhash.simhash_components(docs).collect()]
    assert sorted(got, key=str) == sorted([(5, 5), (6, 5), (7, 5), (None, 8), (8, 8), (8, 8), (9, 9), (10, 10)], key=str)
    assert simhash.simhash_components(docs.where("false")).count() == 0
    left = simhash.near_duplicates_removed(docs)
    assert left.columns == docs.columns
    # A null id's text stays with row 8, as do two texts that are alike in all but case and white space.
    assert sorted(r["doc_id"] for r in left.collect()) == [5, 8, 9, 10]


def brute_left(rows, texts):
    """One row of each group of near-duplicate rows: the smallest id, nulls last; equal rows are one."""
    distinct = sorted(set(rows), key=repr)
    comps = brute_components([brute_fp(texts(r)) for r in distinct])
    groups = {}
    for r, c in zip(distinct, comps, strict=True):
        groups.setdefault(c, []).append(r)
    return groups.values()


def test_rows_are_removed_one_by_one(spark):
    a, b, c = "the first text of all " * 4, "another text that nothing else has", "copies of one row"
    rows = [(1, a, 0, "x"), (7, a, 0, "x"), (7, b, 0, "x"), (8, c, 0, "x"), (8, c, 0, "x"), (None, a, 0, "x"), (None, "only here and nowhere else", 0, None), (9, None, 0, "x"), (9, "", 0, "x"), (6, c, 0, "x"), (6, c, 0, "y"), (6, c, 0, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row0 int, fp string")
    left = [tuple(r) for r in simhash.near_duplicates_removed(docs).collect()]
    assert sorted((str(r[0]), r[1]) for r in left) == sorted([("1", a), ("7", b), ("6", c), ("None", "only here and nowhere else"), ("9", left[[r[0] for r in left].index(9)][1])])
    assert len(left) == len(set(left)) and set(left) <= set(rows)


def test_removal_against_brute_force(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(30)]
    texts = [[rng.choice(words) for _ in range(60)] for _ in range(8)]
    rows = []
    for _ in range(120):
        t = list(rng.choice(texts))
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((rng.choice([None, *range(25)]), " ".join(t)))
    rows += rows[:20]
    left = [tuple(r) for r in simhash.near_duplicates_removed(spark.createDataFrame(rows, "doc_id int, text string")).collect()]
    groups = list(brute_left(rows, lambda r: r[1]))
    assert len(left) == len(groups) < len(set(rows))
    for g in groups:
        own = [r for r in left if r in g]
        ids = [r[0] for r in g if r[0] is not None]
        assert len(own) == 1 and own[0][0] == (min(ids) if ids else None)
