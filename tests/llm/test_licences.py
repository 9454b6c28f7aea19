import pytest
from pyspark.sql import functions as F

from orrery.llm import licences as L
from orrery.llm.queries import op5_licence_scans

#: What the documents' licence lines say, and their families.
LINES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
}


@pytest.fixture(scope="module")
def classifier(spark):
    return L.train(spark)


def test_query_finds_every_licence_line(spark, sf_dir, classifier):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        for i, line in enumerate(r["text"].split("\n")):
            for text, family in LINES.items():
                if text in line:
                    want[r["doc_id"], i] = family
    q = op5_licence_scans(spark, sf_dir)
    got = {(r["doc_id"], r["paragraph"]): r for r in q.collect()}
    assert {k: r["family"] for k, r in got.items()} == want
    assert want and all(r["confirmed"] for r in got.values())
    plan = q._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_documents_own_sentences_teach_nothing(spark):
    stock = {r["text"] for r in L.training_paragraphs(spark).collect()}
    assert not stock & set(LINES) and not any(x.rstrip(".") in t for x in LINES for t in stock if "Version 2.0 (the" not in t)


def test_held_out_wordings_and_licences(spark):
    classifier = L.train(spark, whole=False)
    held = L.training_paragraphs(spark).where(F.col("fold") == L.TEST).select("text", F.col("family").alias("true")).distinct()
    scored = classifier.labelled(classifier.scores(held, ["text", "true"]))
    got = held.join(scored.select("text", "true", "family", "probability"), ["text", "true"], "left").fillna({"family": "none"}).collect()
    known = [r for r in got if r["true"] not in ("unknown", "none")]
    strange = [r for r in got if r["true"] == "unknown"]
    none = [r for r in got if r["true"] == "none"]
    share = lambda rows: sum(r["true"] == r["family"] for r in rows) / len(rows)
    sure = [r for r in known if r["family"] == r["true"]]
    print(f"held out: {len(known)} of known families {share(known):.3f}, {len(strange)} strange {share(strange):.3f}, {len(none)} without licence {share(none):.3f}; mean probability {sum(r['probability'] for r in sure) / len(sure):.3f}; temperature {classifier.temperature}, thresholds {classifier.threshold} {classifier.none}")
    for r in got:
        if r["true"] != r["family"]:
            print(r["true"], r["family"], r["probability"], r["text"])
    assert len(known) > 200 and share(known) > 0.95
    assert share(strange) > 0.8 and share(none) > 0.8


def test_odd_rows(spark, classifier):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a\n\nReleased under the MIT License.", "x"), (3, "Released under the MIT License.", "x"), (3, "Released under the MIT License.", "x"), (4, "He lost his driving licence on the way home.\n" + "long " * 50_000, "x"), (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "x"), (6, "Available under the Rosebud Public License, version 9.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, family string")
    got = sorted({(str(r["id"]), r["paragraph"], r["family"]) for r in L.licence_paragraphs(df, classifier=classifier).collect()})
    assert got == [("3", 0, "MIT"), ("5", 0, "MIT"), ("6", 0, "unknown"), ("None", 2, "MIT")]
    assert L.licence_paragraphs(df.where("false"), classifier=classifier).count() == 0
