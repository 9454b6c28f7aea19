"""Licence scans: a trained paragraph classifier, confirmed by templates. DataFrame functions only."""

from __future__ import annotations

import json
import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.lineage import cut

#: Paragraphs of licences and of the notices that they ask for.
TEXTS: dict[str, list[str]] = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
    ],
    "CC-BY-NC": [
        "To view a copy of this Creative Commons Attribution-NonCommercial 4.0 International license, visit https://creativecommons.org/licenses/by-nc/4.0/.",
        "NonCommercial means not primarily intended for or directed towards commercial advantage or monetary compensation.",
    ],
    "CC-BY-SA": [
        "To view a copy of this Creative Commons Attribution-ShareAlike 4.0 International license, visit https://creativecommons.org/licenses/by-sa/4.0/.",
        "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original, Attribution-ShareAlike.",
    ],
    "CC-BY": ["To view a copy of this Creative Commons Attribution 4.0 International license, visit https://creativecommons.org/licenses/by/4.0/."],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights and dedicated this work to the public domain worldwide under CC0.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of their rights to the work worldwide under copyright law.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
}
#: How families are called. They are the templates of short statements, too.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License", "MIT licence", "MIT-style license", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Apache License", "Apache 2.0 licence", "Apache-2.0", "Apache Software License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPLv3", "GPL-3.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPLv2", "GPL-2.0"],
    "LGPL": ["GNU Lesser General Public License", "GNU LGPL", "LGPL version 2.1", "LGPL-3.0"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD-style license", "2-clause BSD licence", "BSD-3-Clause"],
    "MPL-2.0": ["Mozilla Public License", "MPL 2.0", "MPL-2.0"],
    "CC-BY-NC": ["CC BY-NC", "Creative Commons Attribution-NonCommercial", "CC-BY-NC"],
    "CC-BY-SA": ["CC BY-SA", "Creative Commons Attribution-ShareAlike", "CC-BY-SA"],
    "CC-BY": ["CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution License"],
    "CC0": ["CC0", "Creative Commons Zero", "Creative Commons CC0 dedication"],
    "ISC": ["ISC License", "ISC licence", "ISC-style license"],
}
#: Sentences about licences. The first ones of each list teach, the last ones calibrate and test (see ``_fold``).
OPENINGS = ["Available under the", "The code is made available under the", "All content is published under the", "License:", "You may use this under the", "Covered by the", "Subject to the", "The source is provided under the", "Use of this material is governed by the", "Dual-licensed; you may choose the", "This file is distributed under the terms of the", "Everything here may be shared under the", "Distributed under the", "Please read the", "Contributions are accepted under the", "(c) the authors,"]
ENDINGS = ["", " by the authors", " unless stated otherwise", ", see the LICENSE file for details", " (see COPYING)"]
#: Licences of no known family. Whole licences teach, others calibrate the unknown class, others test it.
STRANGE = [
    "Zephyr Community License, version 7", "Northwind Source Agreement", "Example Corporation research license", "Harbour Data Licence 1.3", "Eclipse Public License 2.0", "zlib License", "Artistic License 2.0", "Boost Software License", "European Union Public Licence", "PostgreSQL License", "SIL Open Font License", "Academic Free License", "Open Software License 3.0", "Q Public License",
    "Sleepycat License", "IBM Public License", "Nokia Open Source License", "Ruby License", "PHP License 3.01", "OpenSSL License", "Vim License", "Educational Community License", "Meridian evaluation licence", "Orchard Open Terms", "Microsoft Public License", "Open Database License", "NCSA Open Source License", "Python Software Foundation License", "CeCILL licence", "Common Development and Distribution License",
    "Server Side Public License", "Business Source License 1.1", "Elastic License 2.0", "JSON License", "Lucent Public License", "Upstream Compatibility License", "Historical Permission Notice", "Unicode License", "Fair License", "Simple Public License", "Motosoto licence", "Entessa Public License", "Naumen Public License", "Sun Industry Standards License",
]
STRANGE_TEXTS = [
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "The accompanying materials are made available under the terms of this agreement, which accompanies this distribution.", "You may not provide the software to third parties as a hosted or managed service.",
    "The licensee may copy the programme for internal evaluation during thirty days after delivery.", "The font software may be bundled, redistributed and sold with any software, provided that each copy contains the above copyright notice and this license.", "The licensor grants you the right to make non-production use of the licensed work until the change date.",
]
#: Sentences that only sound like licences.
NONE = [
    "He lost his driving licence on the way home", "The fishing license must be renewed every year", "The council took poetic licence with the version of the story", "Students of the institute released a report", "The helicopter was distributed under the terms of the treaty", "A new public version of the work was published", "Attribution of the painting is disputed", "The software was published free of charge",
    "All rights of way are public", "Copies of the notice were included", "The bar sold drinks without a license", "A copy of the letter was sent to the author", "The foundation published version 3 of its general report", "Permission to enter the building was granted", "The apache pilot landed two times", "She studied at MIT for four years", "The creative team shares common goals",
    "Contributors to the magazine are paid by the word", "The file could not be opened by the program", "Any person may enter free of charge on Sunday", "The law requires a warranty of two years", "Conditions at the source of the river are fine", "The commercial was shown on public television", "The mozilla foundation employs many people", "He distributed copies of the list to the class", "See the manual for details",
    "The general read the public statement", "Lesser known works of the author were shown", "The domain of the function is open to the public", "Marriage licences were issued by the clerk", "Berkeley is a city in the west", "The new version is easier to use and modify", "The terms of the loan were stated in writing", "Nobody was held liable for the damages", "A source close to the family declined to comment", "The license plate was not readable",
]

#: Weighted n-grams at most.
VOCABULARY = 8192
OTHER, UNKNOWN = "none", "unknown"
TRAIN, CALIBRATE, TEST = "train", "calibrate", "test"
#: Share of words that a paragraph must have in common with a paragraph of the licence (of all words of either) to be confirmed.
CONFIRM = 0.5
#: Words too common to tell a licence; every weighted n-gram has another word.
COMMON = set("a an and all any are as at be been but by can for from had has have he her his home i if in into is it its may more my new no not of on one or other our out see she so some such than that the their them these they this those to under up use used was we were what when which who will with without word words work would year years you your".split())


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(ws: Column, n: int) -> Column:
    """All runs of n words, joined by a space."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(ws, i, n), " "))
    return F.when(F.size(ws) >= n, each).otherwise(F.array().cast("array<string>"))


def _grams(ws: Column) -> Column:
    """Distinct words, and runs of two and three words."""
    return F.array_distinct(F.concat(ws, _runs(ws, 2), _runs(ws, 3)))


def _local(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small table of known size from values, as part of the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


def _fold(i: int, n: int) -> str:
    """Of n members in a row, half teach, a quarter calibrates, and the last quarter tests."""
    return TRAIN if i < n // 2 else CALIBRATE if i < n - n // 4 else TEST


def _broken(text: str) -> list[str]:
    """A paragraph, and parts of it as when lines are broken."""
    w = text.split()
    return [text, *(" ".join(w[len(w) * a // 3 : len(w) * b // 3]) for a, b in ((0, 2), (1, 3), (0, 1), (1, 2), (2, 3)) if len(w) > 15)]


def training_paragraphs(spark: SparkSession) -> DataFrame:
    """``text, family, fold``: paragraphs and sentences of each family, strange licences, and other sentences.

    Folds divide wordings: whole openings of sentences, whole strange licences, and whole other sentences are held out.
    """
    rows = [(t, f, TRAIN) for f, ts in TEXTS.items() for whole in ts for t in _broken(whole)]
    rows += [(f"{o} {n}{e}.", f, _fold(i, len(OPENINGS))) for f, ns in NAMES.items() for n in ns for i, o in enumerate(OPENINGS) for e in ENDINGS]
    rows += [(f"{n}{e}", f, TRAIN) for f, ns in NAMES.items() for n in ns for e in ENDINGS]
    # Each fold has openings and strange licences of its own.
    for i, n in enumerate(STRANGE):
        fold = _fold(i, len(STRANGE))
        rows += [(f"{o} {n}{e}.", UNKNOWN, fold) for j, o in enumerate(OPENINGS) if _fold(j, len(OPENINGS)) == fold for e in ENDINGS]
    rows += [(t, UNKNOWN, _fold(i, len(STRANGE_TEXTS))) for i, whole in enumerate(STRANGE_TEXTS) for t in _broken(whole)]
    rows += [(t + e + ".", OTHER, _fold(i, len(NONE))) for i, t in enumerate(NONE) for e in ("", " in the spring", ", as the paper said", " by the authors")]
    return _local(spark, [{"text": t, "family": f, "fold": k} for t, f, k in rows], "text:string,family:string,fold:string")


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, paragraph`` (from 0, blank ones counted), ``text`` of the lines that are not blank."""
    split = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("paragraph", "text"))
    return split.where(F.trim("text") != "")


class Classifier:
    """Weights of n-grams for each family and for text without licence, a temperature, and the unknown class's threshold."""

    def __init__(self, spark: SparkSession, classes: list[str], weights: dict[str, list[float]], intercepts: list[float], anchors: list[str]):
        self.spark, self.classes, self.weights, self.intercepts, self.anchors = spark, classes, weights, intercepts, anchors
        self.temperature, self.threshold, self.none = 1.0, 0.5, 0.5

    def scores(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """``keys, words, logits`` of the paragraphs (keys, text) that hold a weighted n-gram; the others score the intercepts."""
        table = _local(self.spark, [{"gram": g, "w": w} for g, w in self.weights.items()], "gram:string,w:array<double>")
        with_words = rows.withColumn("words", _words(F.col("text"))).where(F.arrays_overlap("words", F.array(*map(F.lit, self.anchors)))).dropDuplicates(keys)
        grams = with_words.select(*keys, "words", F.explode(_grams(F.col("words"))).alias("gram")).join(F.broadcast(table), "gram")
        total = grams.groupBy(*keys).agg(F.first("words").alias("words"), *(F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(len(self.classes))))
        return total.select(*keys, "words", F.array(*((F.col(f"z{i}") + F.lit(b)) for i, b in enumerate(self.intercepts))).alias("logits"))

    def labelled(self, scores: DataFrame) -> DataFrame:
        """Adds ``family`` (none, unknown or a family), ``probability`` (of the best family) and ``p_none``."""
        other = self.classes.index(OTHER)
        out = scores.withColumn("z", F.transform("logits", lambda x: x / F.lit(self.temperature)))
        out = out.withColumn("z", F.transform("z", lambda x: F.exp(x - F.array_max("z"))))
        out = out.withColumn("z", F.transform("z", lambda x: x / F.aggregate("z", F.lit(0.0), lambda a, y: a + y)))
        out = out.withColumn("p_none", F.col("z")[other])
        named = F.arrays_zip(F.col("z").alias("p"), F.array(*map(F.lit, self.classes)).alias("family"))
        out = out.withColumn("best", F.array_max(F.filter(named, lambda x: x["family"] != OTHER)))
        family = F.when(F.col("p_none") >= self.none, OTHER).when(F.col("best.p") / F.greatest(1 - F.col("p_none"), F.lit(1e-12)) < self.threshold, UNKNOWN).otherwise(F.col("best.family"))
        return out.select("*", family.alias("family"), F.col("best.p").alias("probability")).drop("best", "z")


def _softmax(z: list[float], t: float) -> list[float]:
    e = [math.exp((x - max(z)) / t) for x in z]
    return [x / sum(e) for x in e]


def _fit(spark: SparkSession, stock: DataFrame) -> Classifier:
    classes = [*TEXTS, UNKNOWN, OTHER]
    anchors = sorted({r["w"] for r in stock.where(F.col("family") != OTHER).select(F.explode("ws").alias("w")).distinct().collect()} - COMMON)
    kept = F.filter(_grams(F.col("ws")), lambda g: F.arrays_overlap(F.split(g, " "), F.array(*map(F.lit, anchors))))
    # Texts without any licence word, as most are.
    empty = spark.range(200).coalesce(1).select(F.array().cast("array<string>").alias("grams"), F.lit(float(classes.index(OTHER))).alias("label"), F.lit(1.0).alias("weight"))
    # There are many sentences for each name, and few paragraphs.
    weight = F.when(F.size("ws") > 14, 10.0).when(F.col("family") == OTHER, 4.0).when(F.col("family") == UNKNOWN, 3.0).otherwise(1.0)
    data = stock.select(kept.alias("grams"), (F.array_position(F.array(*map(F.lit, classes)), F.col("family")) - 1).cast("double").alias("label"), weight.alias("weight"))
    data = cut(data.unionByName(empty).coalesce(1))
    vectors = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0, vocabSize=VOCABULARY).fit(data)
    model = LogisticRegression(family="multinomial", regParam=1e-4, elasticNetParam=0.0, maxIter=40, weightCol="weight", standardization=False).fit(cut(vectors.transform(data)))
    w = model.coefficientMatrix.toArray()
    weights = {g: [round(float(x), 5) for x in w[:, i]] for i, g in enumerate(vectors.vocabulary) if abs(w[:, i]).max() > 1e-3}
    return Classifier(spark, classes, weights, [float(x) for x in model.interceptVector], anchors)


def train(spark: SparkSession, whole: bool = True) -> Classifier:
    """Fit the classifier on the stock paragraphs of the first fold; no document has a say in it.

    The second fold, of other wordings and other strange licences, sets the temperature (least negative log-likelihood) and
    the thresholds that divide known families, strange licences and other texts best. With ``whole``, weights then come
    from a fit on all folds. Every weighted n-gram has a word that is not common, so a paragraph without any such word
    scores the intercepts; that these say "no licence" is checked here.
    """
    # A bounded table: one partition keeps the fit's many small steps from being many small tasks.
    stock = cut(training_paragraphs(spark).withColumn("ws", _words(F.col("text"))).coalesce(1))
    out = _fit(spark, stock.where(F.col("fold") == TRAIN))
    classes = out.classes
    other = classes.index(OTHER)
    rows = [(r["family"], list(r["logits"])) for r in out.scores(stock.where(F.col("fold") == CALIBRATE).select("text", "family").distinct(), ["text", "family"]).collect()]  # some thousand
    out.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=lambda t: -sum(math.log(max(_softmax(z, t)[classes.index(f)], 1e-12)) for f, z in rows))
    told = []
    for f, z in rows:
        p = _softmax(z, out.temperature)
        best = max((x, classes[i]) for i, x in enumerate(p) if i != other)
        told.append((f, p[other], best[0] / (1 - p[other] + 1e-12), best[1]))

    def right(none: float, least: float) -> float:
        """Mean share of right answers for known families, for strange licences, and for other texts."""
        kinds: dict[str, list[bool]] = {}
        for f, p_none, p, best in told:
            says = OTHER if p_none >= none else UNKNOWN if p < least else best
            kinds.setdefault(f if f in (OTHER, UNKNOWN) else "known", []).append(says == f)
        return sum(sum(x) / len(x) for x in kinds.values()) / len(kinds)

    # Nearly all paragraphs state no licence, so a doubtful one is not called one.
    out.none, out.threshold = max(((n / 20, t / 20) for n in range(6, 13) for t in range(4, 20)), key=lambda x: (right(*x), -abs(x[0] - 0.5), -x[1]))
    if whole:
        every = _fit(spark, stock)
        out.weights, out.intercepts, out.anchors = every.weights, every.intercepts, every.anchors
    if _softmax(out.intercepts, out.temperature)[other] < out.none:
        raise RuntimeError("the intercepts alone do not say that there is no licence")
    return out


_fitted: dict[str, Classifier] = {}


def fitted(spark: SparkSession) -> Classifier:
    """The classifier of this application: it is the same for all documents, so it is fitted once."""
    app = spark.sparkContext.applicationId
    if app not in _fitted:
        _fitted.clear()
        _fitted[app] = train(spark)
    return _fitted[app]


def template_share(words: Column, texts: Column, names: Column) -> Column:
    """How well a paragraph's words fit a family: 1 if they hold one of its names word by word, else the words that they
    share with the best of its paragraphs, of all words of either."""
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    named = F.exists(names, lambda n: F.contains(line, F.concat(F.lit(" "), n, F.lit(" "))))
    share = F.array_max(F.transform(texts, lambda t: F.size(F.array_intersect(words, t)) / F.size(F.array_union(words, t))))
    return F.when(named, F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0)))


def licence_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classifier: Classifier | None = None) -> DataFrame:
    """Paragraphs (lines) of documents that state a licence.

    Returns ``id, paragraph, family`` ("unknown" for a licence of no known family), ``probability`` (calibrated, of the
    best family), ``template_share`` (see there; 0 for unknown licences), ``confirmed`` (template_share >= CONFIRM). All
    paragraphs are judged; those that state none are left out. Null, empty and blank texts have no paragraphs; null and
    repeated ids are scanned like others; rows of one id with the same paragraph at the same place give one finding. An
    empty table gives no rows. Other columns are ignored, whatever their names. Of families that are equally likely the last by name counts.
    """
    spark = docs.sparkSession
    c = classifier or fitted(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = c.labelled(c.scores(paragraphs(rows, "id", "text"), ["id", "paragraph", "text"])).where(F.col("family") != OTHER)
    # Findings are few rows, each dear: dealt evenly, whatever their size is.
    found = found.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id", "paragraph")
    words = F.transform(F.col("x"), _words)
    stock = _local(spark, [{"family": f, "x": TEXTS[f], "n": NAMES[f]} for f in TEXTS], "family:string,x:array<string>,n:array<string>")
    stock = stock.select("family", words.alias("texts"), F.transform("n", lambda n: F.array_join(_words(n), " ")).alias("names"))
    out = found.join(F.broadcast(stock), "family", "left").withColumn("template_share", F.when(F.col("texts").isNull(), 0.0).otherwise(template_share(F.col("words"), F.col("texts"), F.col("names"))))
    return out.select("id", "paragraph", "family", "probability", "template_share", (F.col("template_share") >= CONFIRM).alias("confirmed"))
