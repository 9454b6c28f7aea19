import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from orrery.llm import packing as K
from orrery.llm.queries import TOKENIZERS, op11_best_fit_packing
from orrery.llm.text_encoder import TextEncoder, has_long_run, vocabulary

PATH = str(TOKENIZERS / "byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_are_those_of_the_library(library):
    encoder = TextEncoder(vocabulary(PATH))
    rng = random.Random(1)
    letters = list("aeiounst THE'' '\n\t  1290.,<|>é中\U0001f600́ \u0085 　 ᠎​﻿\x1c\x00") + ["<|endoftext|>", "'re", " the", "ing", "\r\n"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(8000)]
    texts += [f"a{chr(c)}1 {chr(c) * 2} b" for c in range(0x3100) if c] + ["x" * 20_000, " " * 20_000, "\n " * 9000, "a b " + "y" * 300_000 + "<|endoftext|> c", " " * 200_000]
    for text, want in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert encoder.encode(text).tolist() == want.ids, text[:50]
    assert has_long_run("x" * 5000) and has_long_run("a b " * 999 + " " * 5000) and not has_long_run("word " * 9999)


def test_pieces(spark, library):
    texts = [None, "", "word", " ".join(str(i) for i in range(2000)), "a b " * 511 + "c", "a b " * 512, "é<|endoftext|>"]
    df = spark.createDataFrame([(i % 5 if i else None, t, i) for i, t in enumerate(texts)], "doc_id int, text string, piece int")
    got = K.token_pieces(df, PATH).orderBy("id", "start").collect()
    want = []
    for i, t in enumerate(texts):
        ids = [*(library.encode(t, add_special_tokens=False).ids if t else []), 2]
        first = len(ids) % 1024 if len(ids) > 1024 and len(ids) % 1024 else min(len(ids), 1024)
        at = [0, *range(first, len(ids), 1024)]
        want += [(i % 5 if i else None, k, a, np.array(ids[a:b], "<u4").tobytes()) for k, (a, b) in enumerate(zip(at, [*at[1:], len(ids)], strict=True))]
    assert sorted(map(repr, ((r["id"], r["piece"], r["start"], bytes(r["ids"])) for r in got))) == sorted(map(repr, want))
    assert all(r["length"] == len(r["ids"]) // 4 <= 1024 for r in got)
    assert K.token_pieces(df.limit(0), PATH).count() == 0


def whole(rows, capacity):
    """Sequences are gapless, within the capacity, and hold every piece once."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("kind", ["mixed", "large", "equal", "one", "none", "full"])
def test_packings_over_several_levels(spark, kind):
    rng = np.random.default_rng(3)
    sizes = {"mixed": rng.integers(1, 101, 900), "large": rng.integers(51, 101, 300), "equal": np.full(500, 34), "one": np.array([5]), "none": np.array([], int), "full": np.full(40, 100)}[kind]
    df = spark.createDataFrame([(int(i) % 7, int(s), "x") for i, s in enumerate(sizes)], "doc_id int, length long, sequence_id string")
    rows = K.packed(df, capacity=100, block=64).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == sorted((int(i) % 7, int(s)) for i, s in enumerate(sizes))
    n = whole(rows, 100)
    least = {"mixed": -(-int(sizes.sum()) // 100), "large": 300 if kind == "large" else 0, "equal": 250, "one": 1, "none": 0, "full": 40}[kind]
    assert least <= n <= least * (1.05 if kind == "mixed" else 1)


def test_odd_lengths(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 101), (4, 100), (5, 99), (None, 1)], "doc_id int, length int")
    rows = {r["doc_id"]: r for r in K.packed(df, capacity=100).collect()}
    assert all(rows[k]["sequence_id"] is None and rows[k]["offset"] is None for k in (1, 2, 3))
    assert rows[5]["sequence_id"] == rows[None]["sequence_id"] != rows[4]["sequence_id"]


def test_crossover_keeps_every_piece_and_generations_help():
    rng = np.random.default_rng(5)
    sizes = rng.integers(200, 700, 1000)
    first = K.settled(sizes, 1024, 6, rng)
    child = K.crossed(sizes, first[0], first[3], 1024, rng)
    assert len(child) == 1000 and K.loads_of(child, sizes).max() <= 1024 and K.loads_of(child, sizes).min() > 0
    best = K.evolved(sizes, first, 1024, 30, rng)
    assert K.loads_of(best[0], sizes).max() <= 1024
    assert best[0].max() <= first[0].max() and K.fitness(sizes, best[0], 1024) > K.fitness(sizes, first[0], 1024)
    a, b = (K.evolved(sizes, K.settled(sizes, 1024, 4, np.random.default_rng(1)), 1024, 5, np.random.default_rng(1)) for _ in range(2))
    assert all((x == y).all() for x, y in zip(a, b, strict=True))


def test_query_packs_every_id(spark, sf_dir, library):
    rows = op11_best_fit_packing(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by) == len(docs)
    for d in docs:
        ids = np.array([*(library.encode(d["text"], add_special_tokens=False).ids if d["text"] else []), 2], "<u4")
        own = sorted(by[d["doc_id"]], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 1024)))
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]]
        assert all(r["length"] == 1024 for r in own[1:]) and sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    assert whole(rows, 1024) <= -(-sum(r["length"] for r in rows) // 1024) + 1
