import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from orrery.llm import simhash
from orrery.llm.common import ascii_words
from tests.llm.test_simhash import brute_components, brute_fp


def test_stages_against_plain_versions(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept, frames = docs.columns, [], []
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    bench = [ascii_words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        if name != C.STAGES[-1][0]:
            assert out.columns == columns
        kept.append({r["doc_id"]: r for r in docs.collect()})
        frames.append({r["doc_id"]: r for r in out.collect()})
        docs = out
    # Quality: what goes is mostly labelled bad or toxic, and hardly any document labelled good goes.
    gone = [labels[d] for d in kept[0].keys() - frames[0].keys() if d in labels]
    good = [d for d in kept[0] if d in labels and labels[d]["quality"] == 1 and labels[d]["toxic"] == 0]
    assert gone and sum(r["quality"] == 0 or r["toxic"] == 1 for r in gone) > 0.8 * len(gone)
    assert sum(d in frames[0] for d in good) > 0.97 * len(good)
    # Near-duplicates: the first document of each group stays.
    ids = sorted(kept[1])
    comps = brute_components([brute_fp(kept[1][d]["text"]) for d in ids])
    assert sorted(frames[1]) == sorted({ids[c] for c in comps})
    # Passages: only shorter texts, no run of words that the text did not have, sizes right.
    assert frames[2].keys() <= kept[2].keys()
    for d, r in frames[2].items():
        assert r["n_chars"] == len(r["text"]) and len(r["text"]) <= len(kept[2][d]["text"])
    # No repeat of 60 words is left that starts in an earlier document.
    first, late = {}, 0
    for d in sorted(frames[2]):
        ws = ascii_words(frames[2][d]["text"])
        for i in range(len(ws) - 59):
            late += first.setdefault(b" ".join(ws[i : i + 60]), d) != d
    assert late == 0
    # Benchmark items.
    def contains(text):
        ws = ascii_words(text)
        own = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
        return any(len(own & g) >= 0.8 * len(g) for g in grams)

    grams = [{tuple(b[i : i + 5]) for i in range(len(b) - 4)} for b in bench]
    assert sorted(frames[3]) == sorted(d for d, r in kept[3].items() if not contains(r["text"]))
    # Encoding.
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    assert frames[4].keys() == kept[4].keys()
    for d, r in frames[4].items():
        ids = lib.encode(kept[4][d]["text"], add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r["n_tokens"], bytes(r["ids"]), r["ids_sha256"]) == (len(ids), raw, hashlib.sha256(raw).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_and_empty_documents(spark, sf_dir):
    assert C.run(spark, sf_dir).select("doc_id").distinct().count() > 50
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_stages_with_repeated_and_null_ids_and_a_clashing_column(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = [r for r in docs.where("length(text) between 400 and 2000").orderBy("doc_id").collect()]
    a, b, c = clean[3], clean[-3], clean[len(clean) // 2]
    rows = [(1, a.text), (7, a.text), (7, b.text), (8, c.text), (8, c.text), (None, b.text), (None, None), (3, ""), (2, "word " * 60_000)]
    odd = spark.createDataFrame([(i, t, a.lang, a.source, len(t or ""), "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, label string, id int").withColumn("n_chars", F.col("n_chars").cast(docs.schema["n_chars"].dataType))
    seen = odd
    for name, stage in C.STAGES:
        out = stage(spark, seen, sf_dir)
        if name == "bpe encoding and decoding":
            assert out.count() == seen.count()
            break
        assert out.columns == odd.columns, name
        out = spark.createDataFrame(out.collect(), out.schema)
        assert {r["doc_id"] for r in out.collect()} <= {r[0] for r in rows}, name
        seen = out
    left = simhash.near_duplicates_removed(odd)
    assert sorted((r["doc_id"], r["text"]) for r in left.where("doc_id in (1, 7, 8)").collect()) == sorted([(1, a.text), (7, b.text), (8, c.text)])
