"""Licence scans: a trained paragraph classifier confirmed by template comparison.

A multinomial logistic regression over sparse word bigrams and trigrams tells licence
families and an unknown class apart. It is fitted on sentences of the families, on
neutral ones, and on a bounded sample of the corpus' own paragraphs that share no trigram with a template;
its temperature is calibrated on variants of sentences and sampled paragraphs that a first fit
didn't see; how sentences fare that a fit saw no variant of is reported with the model. Scoring is one DataFrame plan: paragraphs are cut into n-grams, those of the vocabulary meet their
weights, and a prediction counts as confirmed if enough of a template of its family is there.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlloom.llm.common import discard, materialize

UNKNOWN = "unknown"
COVERAGE = 0.7
FOLDS = 4
#: Paragraphs of the corpus that a fit takes as examples of the unknown class, at most about.
NEGATIVES = 2000
#: One sentence each; digits and words are what tells versions apart.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "You may obtain a copy of the License at http www apache org licenses LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is available under the terms of the Apache License 2.0",
    ],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd-3-clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Use of this source code is governed by a BSD-style license",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Licensed under the BSD 3-Clause License",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "either version 3 of the License, or at your option any later version",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL version 3",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "either version 2 of the License, or at your option any later version",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Released under the GPL version 2",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "all-rights-reserved": [
        "All rights reserved",
        "No part of this publication may be reproduced without prior written permission",
    ],
}
NEUTRAL = [
    "The driver showed a license at the gate and went on to the work of the day",
    "You may use the copy of the recipe with or without salt and sugar",
    "The general public was free to walk in the source of the river",
    "This version of the story is subject to change and the terms are open",
    "The software was late and the project had no plan for the next release",
    "Parts of this work are under way and others are at an early stage",
    "It is hereby noted that any person in the hall heard the same song",
    "The mit of the catcher and the apache camp were found in the attic",
    "All the rights of way were reserved for the parade on the main road",
    "The international commons debate gave credit to the first speaker",
    "At your option the room comes with a view of the sea or of the hill",
    "Permission to leave was asked for and granted in the end",
    "Released from the cage the bird flew over the public garden",
    "The use of binary numbers in forms and tables is common",
    "No part of the house may be seen from the street",
]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def word_grams(words: Column, n: int) -> Column:
    """Runs of n words, each once; ``words`` should be a plain column, as it is read n + 1 times."""
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    grams = F.slice(words, F.lit(1), count)
    for j in range(1, n):
        grams = F.zip_with(grams, F.slice(words, F.lit(j + 1), count), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(grams)


def grams_of(words: Column) -> Column:
    """Word bigrams and trigrams."""
    return F.concat(word_grams(words, 2), word_grams(words, 3))


def paragraphs_of(text: Column) -> Column:
    """Lines, with those joined that only a line break within a sentence parts: no stop before it, a small letter after it."""
    return F.split(F.regexp_replace(text, r"(?<![.!?:;\s])[ \t]*\r?\n(?=[ \t]*[a-z])", " "), "\n", -1)


def training_rows() -> list[tuple[int, int, int, str]]:
    """(class number, fold, fold of the sentence, text): templates whole, with a word missing, and within neutral text."""
    out = []
    for number, sentences in enumerate([*TEMPLATES.values(), NEUTRAL]):
        own = number < len(TEMPLATES)
        for at, s in enumerate(sentences):
            w = s.split()
            made = [s, s]
            made += [" ".join(w[:i] + w[i + 1 :]) for i in range(len(w))] if not own or len(w) > 6 else []
            if own:
                made += [f"{a} {s}" for a in NEUTRAL[::3]] + [f"{s} {b}" for b in NEUTRAL[1::3]]
            out += [(number, i % FOLDS, (at + number) % FOLDS, m) for i, m in enumerate(made)]
    return out


def negative_paragraphs(docs: DataFrame, *, text: str = "text", limit: int = NEGATIVES) -> DataFrame:
    """(text): about ``limit`` paragraphs of the corpus at most, chosen by a hash of their text, that share no trigram with a template."""
    spark = docs.sparkSession
    grams = _literals(spark, [(t,) for ts in TEMPLATES.values() for t in ts], "template string").select(F.explode(word_grams(words_of(F.col("template")), 3)).alias("g")).agg(F.collect_set("g").alias("known"))
    n = docs.count()
    few = docs.select(F.col(text).alias("text")).filter("text is not null").filter(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, limit / max(n, 1))))
    lines = few.select(F.explode(paragraphs_of(F.col("text"))).alias("text")).filter(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(7)) == 0)
    worded = lines.select("text", F.explode(F.array(words_of(F.col("text")))).alias("words")).filter("size(words) > 3")
    clean = worded.join(F.broadcast(grams)).filter(~F.arrays_overlap(word_grams(F.col("words"), 3), F.col("known"))).select("text")
    return clean.orderBy(F.xxhash64("text", F.lit(2)), "text").limit(limit)


@dataclass
class LicenceModel:
    families: list[str]
    vocabulary: list[str]
    weights: list[list[float]]
    intercepts: list[float]
    temperature: float
    #: Of the held-out rows: their number, mean log loss before and after calibration, and share of right classes; then the share for held-out sentences.
    calibration: dict[str, float]


def _literals(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from one JSON literal."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))))


def train(spark: SparkSession, docs: DataFrame | None = None, *, text: str = "text", regularization: float = 2e-3) -> LicenceModel:
    """Fit on all folds but the last and calibrate the temperature on that one; the weights come from a fit on all.

    ``docs`` gives examples of the unknown class. The training set is bounded by the module's sentences and NEGATIVES.
    """
    rows = _literals(spark, training_rows(), "label int, fold int, sentence int, text string")
    if docs is not None:
        negatives = negative_paragraphs(docs, text=text)
        rows = rows.unionByName(negatives.select(F.lit(len(TEMPLATES)).alias("label"), *[F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias(c) for c in ("fold", "sentence")], "text"))
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("grams", grams_of(F.col("words")))
    table = materialize(rows.select("label", "fold", "sentence", "grams").coalesce(1), "licences")
    own = table.filter(F.col("label") < len(TEMPLATES))
    # The vocabulary is that of the sentences: grams that only the corpus has tell nothing about families.
    sentences = _literals(spark, [(t,) for ts in [*TEMPLATES.values(), NEUTRAL] for t in ts], "text string").withColumn("words", words_of(F.col("text"))).withColumn("grams", grams_of(F.col("words")))
    vectorizer = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=1 << 16).fit(own.select("grams").union(sentences.select("grams")))
    data = vectorizer.transform(table).coalesce(1).cache()
    regression = LogisticRegression(family="multinomial", regParam=regularization, maxIter=100, tol=1e-5)

    def left_out(by: str) -> list[tuple[int, list[float]]]:
        fitted = regression.fit(data.filter(F.col(by) != FOLDS - 1))
        scored = fitted.transform(data.filter(F.col(by) == FOLDS - 1)).select("label", F.expr("cast(rawPrediction as string)").alias("raw"))
        return [(r[0], r[1]) for r in scored.select("label", F.from_json("raw", "array<double>").alias("z")).collect()]

    held, unseen = left_out("fold"), left_out("sentence")
    model = regression.fit(data)
    data.unpersist()
    discard(table)

    def loss(t: float) -> float:
        return sum(math.log(sum(math.exp((x - z[label]) / t) for x in z)) for label, z in held) / len(held)

    temperature = min((0.25 * 1.25**i for i in range(14)), key=loss)
    right = lambda rows: sum(max(range(len(z)), key=z.__getitem__) == label for label, z in rows) / len(rows)
    figures = {"rows": len(held), "log_loss_raw": loss(1.0), "log_loss": loss(temperature), "accuracy": right(held), "accuracy_of_unseen_sentences": right(unseen)}
    matrix = model.coefficientMatrix.toArray()
    return LicenceModel([*TEMPLATES, UNKNOWN], list(vectorizer.vocabulary), matrix.T.tolist(), model.interceptVector.toArray().tolist(), temperature, figures)


def scan(
    docs: DataFrame,
    model: LicenceModel | None = None,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    least: float = 0.5,
    coverage: float = COVERAGE,
) -> DataFrame:
    """(doc_id, paragraph, family, probability, unknown, coverage, confirmed) of licence paragraphs.

    A paragraph is a line, or several that one sentence runs through; they are numbered from 0 in the whole text. One row for each
    paragraph whose likeliest class is a family with a probability of at least ``least``; ``unknown`` is the probability of
    the unknown class. All others are unknown and have no row. Paragraphs without an n-gram of the vocabulary get the
    intercepts' class, which must be unknown. coverage is the largest share of a template's n-grams
    (of that family) that the paragraph has. Null and empty texts have no rows, an empty table gives none; repeated rows repeat
    theirs, and a null id is kept. Equally likely classes go to the first family in order. Texts and paragraphs are taken whole.

    There is no shuffle. The vocabulary's weights and the templates, whose sizes the training
    sentences fix, are all that goes to the executors.
    """
    spark = docs.sparkSession
    model = model or train(spark, docs, text=text)
    names, n = model.families, len(model.families)
    if max(range(n), key=model.intercepts.__getitem__) != names.index(UNKNOWN):
        raise ValueError("a paragraph without known n-grams would not be unknown")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
    lines = rows.select("doc_id", F.posexplode(paragraphs_of(F.col("text"))).alias("paragraph", "line"))
    # Generating one row keeps words a plain column: nothing is cut twice.
    worded = lines.select("doc_id", "paragraph", F.explode(F.array(words_of(F.col("line")))).alias("words"))
    vocabulary = set(model.vocabulary)
    known_grams = lambda n: F.filter(word_grams(F.col("words"), n), lambda g: g.isin(vocabulary))
    # A trigram of the vocabulary consists of bigrams of the vocabulary.
    two = worded.select("doc_id", "paragraph", "words", F.explode(F.array(known_grams(2))).alias("two")).filter("size(two) > 0")
    found = two.select("doc_id", "paragraph", F.concat("two", known_grams(3)).alias("grams"))
    weights = F.from_json(F.lit(json.dumps(dict(zip(model.vocabulary, model.weights, strict=True)))), "map<string,array<double>>")
    start = F.array(*map(F.lit, model.intercepts))
    raw = F.aggregate("grams", start, lambda s, g: F.zip_with(s, F.element_at(weights, g), lambda x, w: x + w))
    sums = found.select("doc_id", "paragraph", "grams", F.explode(F.array(F.transform(raw, lambda x: x / model.temperature))).alias("z"))
    top = sums.withColumn("best", F.array_max("z"))
    top = top.withColumn("at", F.array_position("z", F.col("best")).cast("int")).withColumn(
        "probability", 1.0 / F.aggregate("z", F.lit(0.0), lambda s, z: s + F.exp(z - F.col("best")))
    )
    top = top.withColumn("unknown", F.exp(F.element_at("z", len(names)) - F.col("best")) * F.col("probability"))
    known = top.withColumn("family", F.element_at(F.array(*map(F.lit, names)), F.col("at"))).filter((F.col("family") != UNKNOWN) & (F.col("probability") >= least))
    sentences = _literals(spark, [(f, t) for f, ts in TEMPLATES.items() for t in ts], "t_family string, template string")
    templates = sentences.select("t_family", words_of(F.col("template")).alias("words")).select("t_family", grams_of(F.col("words")).alias("t_grams"))
    by_family = templates.groupBy("t_family").agg(F.collect_list("t_grams").alias("templates"))
    compared = known.join(F.broadcast(by_family), F.col("family") == F.col("t_family"))
    share = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("grams"))) / F.size(t)))
    return compared.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", F.round("probability", 6).alias("probability"), F.round("unknown", 6).alias("unknown"), F.round(share, 6).alias("coverage"), (share >= coverage).alias("confirmed"))
