import hashlib
import random

import numpy as np
import pytest

from orrery.llm import suffixes as S
from orrery.llm.queries import op4_suffix_array_dedup


def brute(docs, length=100):
    """For each id: (bytes, removed, spans, kept)."""
    seen, out = set(), {}
    for i, t in sorted(docs.items()):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 2, np.int8)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s + 1 : s + length + 1] = 1
            seen.add(w)
        d = np.diff(gone)
        out[i] = (len(raw), int(gone.sum()), int((d == 1).sum()), bytes(b for b, g in zip(raw, gone[1:], strict=False) if not g))
    return out


def test_query_against_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in brute(docs).items()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op4_suffix_array_dedup(spark, sf_dir).collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 10_000


def result(df):
    return {r["id"]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in df.collect()}


@pytest.mark.parametrize("hot", [8000, 3, 1])
def test_mixtures(spark, hot):
    rng = random.Random(hot)
    part = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    common = [part(n) for n in (35, 60, 99, 100, 101, 180, 400)]
    docs = {}
    for i in range(60):
        docs[i] = "".join(rng.choice([part(rng.randint(1, 60)), rng.choice(common), rng.choice(common)]) for _ in range(rng.randint(1, 9)))
    docs |= {60: "x" * 1000, 61: "x" * 300 + "ab" * 300, 62: "ab" * 100, 63: docs[5], 64: docs[5][1:], 65: "", 66: "short"}
    df = spark.createDataFrame([(i, t, "k") for i, t in docs.items()] + [(None, docs[5], "k"), (67, None, "k")], "doc_id long, text string, kept string")
    want = brute(docs | {67: ""})
    assert result(S.repeated_bytes_removed(df, bucket=40, hot=hot)) == want
    assert S.repeated_bytes_removed(df.where("false")).count() == 0


def test_repeated_ids_and_long_text(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(9_000_000))
    df = spark.createDataFrame([(1, long), (2, "z" + long[4_000_000:4_000_500] + "z"), (2, "~later"), (3, long[8_388_600:8_388_900])], "doc_id long, text string")
    got = result(S.repeated_bytes_removed(df))
    # Of the two rows with id 2 the smaller text counts.
    assert got[1][1] == 0 and got[3] == (300, 300, 1, b"")
    assert got[2] == ((502, 500, 1, b"zz") if "z" < "~" else got[2])


def test_merged_transforms_are_the_whole_transform():
    rng = random.Random(7)
    length = 32
    left = length - S.GRAM
    pieces = [bytes(rng.choice(b"ab") for _ in range(left + length)) for _ in range(30)]
    pieces += [p[:20] + bytes(rng.choice(b"ab") for _ in range(left + length - 20)) for p in pieces]
    before = np.full(len(pieces), left)
    cuts = [pieces[:25], pieces[25:26], pieces[26:]]
    got = S.merge_transforms([S.shard_transform(c, np.full(len(c), left), length) for c in cuts], np.arange(len(pieces)), length)
    whole = S.merge_transforms([S.shard_transform(pieces, before, length)], np.arange(len(pieces)), length)
    want = np.array([[any(q[c : c + length] == p[c : c + length] for q in pieces[:i]) for i, p in enumerate(pieces)] for c in range(left + 1)])
    assert (got == want).all() and (whole == want).all()


def test_widened_anchors_cover_each_window_once_and_end():
    """Down to whole windows: each window is in one part, holds the part's string, and equal windows take the same way."""
    for length, before, windows in [(100, 84, 85), (100, 84, 1), (100, 0, 1), (100, 50, 20), (33, 17, 18), (32, 5, 3)]:
        text = bytes(i % 251 for i in range(windows + length - 1))
        todo, ends = [(text, before, windows, 0, 0)], []
        for depth in range(8):
            nxt = []
            for piece, b, n, left, right in todo:
                if left + right == length - S.GRAM:
                    ends.append((b, n, left))
                    continue
                parts = list(S.widened(piece, b, n, left, right, length))
                assert sum(p[1] for p in parts) == n
                for first, m, off, lo, hi in parts:
                    assert off == b - first and lo + hi > left + right
                    for j in range(m):
                        assert off - j >= lo and length - S.GRAM - (off - j) >= hi
                    nxt.append((piece[first : first + m + length - 1], off, m, lo, hi))
            todo = nxt
        assert not todo, depth
        # One window each, told apart by how many bytes it has before the anchor.
        assert sorted(b for b, n, left in ends) == sorted(range(before - windows + 1, before + 1)) and all(n == 1 and b == left for b, n, left in ends)
