import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orrery.llm.bpe import Bpe, WordEncoder, encode_documents
from orrery.llm.queries import op2_bpe_encode_decode, op8_token_counts
from orrery.llm.text_encoder import vocabulary
from orrery.llm.token_counts import CountTree, PreTokenCounter, counted_trees, edited_trees

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "<|endoftext|>a<|startoftext|> b", "İSTANBUL ΟΔΟΣ Σ", "été \x1c\x1dx\x1fy", "don't we'll I'VE 123 ½²", "naïve café 日本語テキスト　x", "a" * 3000, "!?" * 500, "\u0000\u0001 ﻿​", "aaaa aaa aa", "ﬁ ǅ ß ẞ", "ཱི̈́ ẛ̣"]


@pytest.fixture(scope="module")
def word_lib():
    t = Tokenizer.from_file(WORD)
    t.no_truncation()
    t.no_padding()
    return t


def texts(spark, sf_dir):
    return [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ODD


def test_ids_and_decoding_as_the_library(spark, sf_dir, word_lib):
    enc = WordEncoder(Bpe.load(WORD))
    for t in texts(spark, sf_dir):
        want = word_lib.encode(t, add_special_tokens=False).ids
        (ids,), (decoded,) = enc.encode([t])
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want, t[:80]
        assert decoded == word_lib.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_speculation_is_right_wherever_all_pairs_fit(path):
    bpe, rng = Bpe.load(path), random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14))).encode() for _ in range(4000)] + [b"aaaaaaa", b"\xff\xfe", b"thththe"]
    got = bpe.encode_words(words)
    assert got == [bpe.merge(w) for w in words]
    held = sum(bpe.speculate(w) == g for w, g in zip(words, got, strict=True))
    assert 0 < held < len(words)


def test_query_and_odd_rows(spark, sf_dir, word_lib):
    import hashlib

    got = {r["doc_id"]: r for r in op2_bpe_encode_decode(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = word_lib.encode(d["text"], add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(word_lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "x", 3)], "doc_id long, text string, ids int")
    assert sorted((r["id"] or 0, r["n_tokens"], r["decoded"]) for r in encode_documents(odd, WORD).collect()) == [(0, 0, ""), (1, 0, ""), (1, 1, "x</w>")]
    assert encode_documents(odd.where("false"), WORD).count() == 0


@pytest.mark.parametrize("special", [True, False])
def test_edits_keep_the_count_right(special):
    """Also edits that make and break special tokens, wherever they are cut."""
    lib, counter, rng = Tokenizer.from_file(BYTE), PreTokenCounter((Bpe.load(BYTE), vocabulary(BYTE)), special), random.Random(2)
    lib.encode_special_tokens = not special
    alphabet = ["'", "r", "e", "l", "ve", " ", "  ", "\n", "\t\n ", "12", "é", "日", "!", "word", "'re", "s", "<|endoftext|>", "<|endof", "text|>", "<", "|", ">"]
    for n in (0, 1, 5, 60, 900):
        tree = CountTree(counter, "".join(rng.choice(alphabet) for _ in range(n)))
        assert tree.tokens == len(lib.encode(tree.text, add_special_tokens=False).ids)
        for _ in range(150):
            s = rng.randint(0, len(tree.text))
            e = s + rng.choice([0, 0, 1, 2, 5, 300])
            new = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 1, 2, 9, 200])))
            tree.edit(s, e, new)
            assert tree.tokens == len(lib.encode(tree.text, add_special_tokens=False).ids)
            assert sum(int(x[0].sum()) for x in tree.leaves) == len(tree.text)
    tree = CountTree(counter, "some words " * 5000)
    tree.edit(20_000, 20_001, "xyz")
    assert tree.encoded < 12
    tree = CountTree(counter, "a !!!!<|endoftext|>b")
    for at in range(5, 19):
        whole = tree.text
        tree.edit(at, at + 1, "")
        assert tree.tokens == len(lib.encode(tree.text, add_special_tokens=False).ids)
        tree.edit(at, at, whole[at])
        assert tree.text == whole and tree.tokens == len(lib.encode(whole, add_special_tokens=False).ids)


@pytest.mark.parametrize("special", [True, False])
def test_both_operators_take_special_tokens_alike(spark, special):
    rng = random.Random(5)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext", " ", "Word", "'s", "\n", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for path, run in ((WORD, encode_documents), (BYTE, counted_trees)):
        lib = Tokenizer.from_file(path)
        lib.no_truncation()
        lib.encode_special_tokens = not special
        got = {r["id"]: r["n_tokens"] for r in run(df, path, special_tokens=special).collect()}
        assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_edit_query(spark, sf_dir):
    lib = Tokenizer.from_file(BYTE)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op8_token_counts(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        t = docs[r["doc_id"]]
        assert r["n_tokens"] == len(lib.encode(t, add_special_tokens=False).ids)
        third = len(t) // 3
        t = t[:third] + t[third + 5 :]
        t = t[: 2 * third] + " [edited] " + t[2 * third :]
        assert r["n_tokens_edited"] == len(lib.encode(t, add_special_tokens=False).ids)
        assert 0 < r["n_reencoded"] < 40


def test_kept_trees_take_edits_without_a_second_encoding(spark, tmp_path):
    lib = Tokenizer.from_file(BYTE)
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["word", "it's", "12", "Über", "\n\n", "x" * 300]) for _ in range(n)) for n in (0, 1, 40, 3000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, tree string, id int")
    counted_trees(docs, BYTE).write.parquet(f"{tmp_path}/trees")
    kept = spark.read.parquet(f"{tmp_path}/trees")
    assert {r["id"]: r["n_tokens"] for r in kept.collect()} == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    edits = F.array(F.struct(F.lit(3).alias("start"), F.lit(5).alias("end"), F.lit("new'").alias("text")))
    for _ in range(2):  # the result takes further edits
        kept = edited_trees(kept.withColumn("edits", edits), BYTE)
        texts = [t[:3] + "new'" + t[5:] for t in texts]
        for r in kept.collect():
            assert r["text"] == texts[r["id"]] and r["n_tokens"] == len(lib.encode(r["text"], add_special_tokens=False).ids)
            assert r["n_reencoded"] < 12


def test_null_edits(spark):
    df = spark.createDataFrame([(1, None, None, "a"), (2, "a b", [], "a"), (2, "a b", [(0, 1, None), None], "a"), (None, "a", None, "a")], "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>, n_tokens string")
    run = lambda d: edited_trees(counted_trees(d, BYTE, edits_col="edits"), BYTE)
    assert sorted((r["id"] or 0, r["n_tokens_before"], r["n_tokens"], r["text"]) for r in run(df).collect()) == [(0, 1, 1, "a"), (1, 0, 0, ""), (2, 2, 1, " b"), (2, 2, 2, "a b")]
    assert run(df.where(F.lit(False))).count() == 0
