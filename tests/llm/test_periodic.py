import hashlib
import random
import zlib

import numpy as np
import pytest

from orrery.llm import periodic as P
from orrery.llm.queries import op13_periodic_runs


def brute(x, least=12):
    """All maximal runs by comparing every word with the one a period behind it."""
    n, found = len(x), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and x[j] == x[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p) and j > i:
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, length, p) for (s, length), p in found.items()), key=lambda r: (r[0], r[2]))


def sequence(rng, letters, n):
    x = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n > 4:
            at = rng.randrange(n)
            p = rng.randrange(1, (n - at) // 2 + 2)
            x = [x[min(n - 1, at + (i - at) % p)] if i >= at else x[i] for i in range(n)]
            x[rng.randrange(n)] = letters
    return x


@pytest.mark.parametrize("least", [1, 2, 3, 5, 8, 12, 13, 31])
def test_runs_against_brute_force(least):
    rng = random.Random(least)
    some = 0
    for _ in range(250):
        x = sequence(rng, rng.choice([1, 2, 3, 6]), rng.randrange(120))
        got = [tuple(r) for r in P.runs_of(np.array(x, np.int64), least).tolist()]
        assert got == brute(x, least)
        some += len(got)
    assert some > 50


def test_names_are_equal_where_blocks_are():
    x = np.random.default_rng(2).integers(0, 2, 200)
    levels = P.name_levels(x)
    for k, names in enumerate(levels):
        blocks = [tuple(x[i : i + (1 << k)]) if i + (1 << k) <= len(x) else (i,) * 500 for i in range(len(x))]
        assert all((names[i] == names[j]) == (blocks[i] == blocks[j]) for i in range(len(x)) for j in range(len(x)))
    assert not (levels[-1] >= 0).any() and (levels[-2] >= 0).any()


def test_long_texts_and_many_candidates():
    same = np.zeros(30_000, np.int64)
    assert P.runs_of(same).tolist() == [[0, 30_000, 1]]
    two = np.tile(np.arange(7_001), 3)
    assert P.runs_of(two).tolist() == [[0, 21_003, 7_001]]


def expected(texts, least=12):
    for t in texts:
        words = t.split() if t else []
        runs = brute(words, least)
        gone = {i for s, length, p in runs for i in range(s + p, s + length)}
        yield len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_texts_alone_and_in_groups(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(map(str, sequence(rng, 3, rng.randrange(60)))) for _ in range(60)]
    texts += [None, "", " \t\n ", "a", "x " * 40, " ".join("ab" * 9), "É é " * 9 + "\U0001f600 " * 12, "ab cd\n" * 3000]
    texts += [texts[-3]] * 3
    df = spark.createDataFrame([(None if i == 2 else i // 2, t, i) for i, t in enumerate(texts)], "doc_id long, text string, runs int")
    for group in (P.GROUP, 50):
        monkeypatch.setattr(P, "GROUP", group)
        got = [(r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in P.periodic_runs(df).collect()]
        # Only ASCII white space divides words.
        ascii_only = [t.replace(" ", "_") if t else t for t in texts]
        assert sorted(map(repr, got)) == sorted(repr((n, r, c.replace("_", " "))) for n, r, c in expected(ascii_only))
    assert P.periodic_runs(df.limit(0)).count() == 0
    assert sorted(str(r["id"]) for r in P.periodic_runs(df).collect()) == sorted(str(None if i == 2 else i // 2) for i in range(len(texts)))


def test_query_against_a_plain_version(spark, tmp_path):
    rng = random.Random(9)
    docs = [(i * 37, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(90)))) for i in range(80)] + [(5000, None), (5001, ""), (None, "a b " * 9)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op13_periodic_runs(spark, str(tmp_path)).collect()}
    changed = 0
    for key, text in docs:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
            changed += 1
        runs = brute(words)
        gone = {i for s, length, p in runs for i in range(s + p, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r, sha = got[key], lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{length},{p}\n" for s, length, p in runs))
        assert r["collapsed_sha256"] == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
    assert changed > 4
