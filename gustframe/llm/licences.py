"""License scans by a trained paragraph classifier.

Paragraphs are runs of lines between blank lines, their lines joined, so that a
wrapped notice is one paragraph. A line that holds a family's notice by itself is a
paragraph of its own and parts the run, unless the run as a whole holds another
notice of that family that no single line holds (the line begins a wrapped one).
A multinomial logistic regression over sparse
word 1- and 2-grams tells licence families, other licence talk (``unknown``) and
ordinary prose (``none``) apart. It is trained on a bounded sample of the corpus
itself (about ``TRAIN_ROWS`` paragraphs a class): those that hold the words of a
family's template are its examples, others that speak of licences (``TALK``) are
``unknown``, and the rest, with or without words of a template, is ``none``; the
templates and the notices of families without one (``OTHERS``) are examples too, so
that a family the sample lacks is known. Half of the sample fits the model, the
other half and every third of ``OTHERS`` calibrate it: the least probability at
which accepted predictions are wrong at most ``ERROR`` of the time is the bar; below
it a licence-like paragraph is ``unknown``. Above it, the paragraph is compared with
all families' templates: the family whose template shares the most of its 2-grams
wins, if that is ``CONFIRM`` of them; else the paragraph is ``unknown`` too.

Features are the n-grams of the templates and of ``OTHERS`` and the ``FEATURES`` most
frequent others of licence paragraphs, as far as they hold a word that is rare in
prose. A paragraph without any of these rare words has no feature and is ``none``;
all others are cut into words and scored. One regular expression finds the rare words, so most of the
corpus is read once and cut into nothing. All steps are DataFrame functions and
Spark ML stages.

Defined results: a null or empty text has no paragraphs; documents without a
licence paragraph give no row; a repeated row, or rows with one doc_id (null is
one, too), are counted together; texts of any length are read whole; if no prose is sampled the templates alone fit the model; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import store

#: Paragraphs of each class that the model is fitted and calibrated on, about.
TRAIN_ROWS = 1_000
#: Features besides those of the templates, and the share of prose paragraphs above which a word is common.
FEATURES, COMMON = 400, 0.002
ERROR, CONFIRM = 0.01, 0.8
NONE, UNKNOWN = "none", "unknown"
#: Marks the ends of single-line notices; no word holds it, so one in a text only parts a run.
CUT = "\x01"

# Notice lines of public licences.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl": ["licensed under the GNU Lesser General Public License, version 3.",
             "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Released under the BSD License."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "reserved": ["All rights reserved."],
}
# Notices of licences without a template, and words that speak of licences.
OTHERS = ["Distributed under the Boost Software License, Version 1.0.", "Made available under the terms of the Eclipse Public License 2.0.",
          "This software is governed by the CeCILL license under French law.", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: ISC",
          "Licensed under the European Union Public Licence.", "This file is subject to the terms of the Common Development and Distribution License.",
          "Use of this source code is governed by a license that can be found in the LICENSE file.", "Distributed under the Artistic License 2.0.",
          "The contents of this file are governed by the foo license.", "Copyright the authors. See the license file for details.", "SPDX-License-Identifier: MIT"]
TALK = "license licensed licenses licence licences licensing spdx copyleft".split()


def words(text: Column) -> Column:
    """Words of a lower-case text."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _plain(text: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def grams(w: Column) -> Column:
    """Words and pairs of neighbouring words."""
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(1))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1))),
                                             lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def runs_of(docs: DataFrame) -> DataFrame:
    """doc_id, run of every run of lines without a blank one, in lower case."""
    return docs.select("doc_id", F.explode(F.split(F.lower("text"), r"\n\s*\n")).alias("run"))


def _shares(have: Column, template: str) -> Column:
    """The share of a template's 2-grams that are in ``have``."""
    ws = _plain(template).split()
    pairs = sorted({f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)})
    return F.size(F.array_intersect(have, F.array(*map(F.lit, pairs)))) / len(pairs)


def paragraphs_of(runs: DataFrame) -> DataFrame:
    """``runs`` cut into paragraphs: the words of each instead of the run."""
    texts = [t for ts in TEMPLATES.values() for t in ts]
    # one step after the other: within a step, nothing that is used often would be shared
    flags = lambda c: F.transform(F.transform(F.transform(c, words), grams), lambda have: F.array(*(_shares(have, t) >= CONFIRM for t in texts)))
    cut = (runs.withColumn("lines", F.split("run", "\n"))
           .withColumn("whole", flags(F.array("run"))[0])
           .withColumn("each", F.when(F.exists("whole", lambda x: x), flags(F.col("lines")))))
    # notices that the run holds and no line of it does
    no_line = lambda i: ~F.exists("each", lambda x: x[i])
    wrapped = F.array(*(F.col("whole")[i] & no_line(i) for i in range(len(texts))))
    cut = cut.withColumn("wrapped", F.when(F.col("each").isNotNull(), wrapped))
    spans, at = [], 0
    for ts in TEMPLATES.values():
        spans.append(range(at, at := at + len(ts)))

    def stands(x: Column) -> Column:
        out = F.lit(False)
        for span in spans:
            holds, open_ = F.lit(False), F.lit(False)
            for i in span:
                holds, open_ = holds | x["each"][i], open_ | F.col("wrapped")[i]
            out = out | (holds & ~open_)
        return out

    marked = F.transform(F.arrays_zip("lines", "each"), lambda x: F.when(stands(x), F.concat(F.lit(CUT), x["lines"], F.lit(CUT))).otherwise(x["lines"]))
    text = F.when(F.col("each").isNull(), F.col("run")).otherwise(F.array_join(marked, "\n"))
    kept = [c for c in runs.columns if c != "run"]
    return cut.select(*kept, F.explode(F.split(text, CUT)).alias("text")).select(*kept, words(F.col("text")).alias("words")).where(F.size("words") > 0)


def _holds_any(text: Column, found: list[str]) -> Column:
    """A lower-case text holds one of ``found`` as a word: one search, in which the
    words are a tree by their letters, instead of one search a word."""
    return text.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{_tree(found)})(?![\p{{L}}\p{{N}}])") if found else F.lit(False)


def _tree(found: list[str]) -> str:
    """Pattern of ``found`` with common beginnings taken out."""
    by: dict[str, list[str]] = {}
    for w in found:
        by.setdefault(w[:1], []).append(w[1:])
    rest = {c: _tree(ws) for c, ws in sorted(by.items()) if c}
    parts = [("" if c.isalnum() else "\\") + c + (t if len(by[c]) == 1 else f"(?:{t})") for c, t in rest.items()]
    return "|".join([*parts, ""] if "" in by else parts)


def _template_of(text: Column) -> Column:
    """The family whose longest template the words of ``text`` hold."""
    plain = sorted(((_plain(t), f) for f, ts in TEMPLATES.items() for t in ts), key=lambda x: -len(x[0]))
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    out = F.lit(None).cast("string")
    for t, family in reversed(plain):
        out = F.when(padded.contains(f" {t} "), family).otherwise(out)
    return out


def _drawn(rows: DataFrame, key: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each ``key``, by the column ``order`` (a hash)."""
    share = F.least(F.lit(1.0), F.lit(float(per_class)) / F.count("*"))
    shares = rows.groupBy(key).agg(share.alias("share"))  # a row per class
    return rows.join(F.broadcast(shares), key).where(F.pmod("order", F.lit(1 << 30)) < F.col("share") * (1 << 30)).drop("share")


def training_rows(docs: DataFrame, per_class: int = TRAIN_ROWS) -> DataFrame:
    """family, words, holdout: the bounded sample, by a hash. Every template's
    longest word shows which runs may hold it."""
    spark = docs.sparkSession
    longest = sorted({max(_plain(t).split(), key=len) for ts in TEMPLATES.values() for t in ts} | set(TALK))
    order = lambda *what: F.xxhash64(F.lit(11), *what)
    n = docs.count()
    runs = runs_of(docs)
    found = paragraphs_of(runs.where(_holds_any(F.col("run"), longest)))
    talk = F.arrays_overlap("words", F.array(*map(F.lit, TALK)))
    found = found.withColumn("family", F.coalesce(_template_of(F.array_join("words", " ")), F.when(talk, UNKNOWN)))
    # paragraphs with a notice or talk of licences: few; the others come with the prose
    found = store(found.where("family is not null").select("family", "words", order("words", "doc_id").alias("order")), "licence-found")
    # prose, whatever words it holds: all runs of about 2 * per_class documents
    some = docs.where(F.pmod(order("doc_id"), F.lit(1 << 30)) < min(1.0, 2 * per_class / max(n, 1)) * (1 << 30))
    prose = paragraphs_of(runs_of(some)).where(_template_of(F.array_join("words", " ")).isNull() & ~talk)
    prose = store(prose.select(F.lit(NONE).alias("family"), "words", order("words").alias("order")), "licence-prose")
    rows = _drawn(found, "family", per_class).unionByName(_drawn(prose, "family", per_class))
    known = [(f, _plain(t).split(), False) for f, ts in TEMPLATES.items() for t in ts] + [(UNKNOWN, _plain(t).split(), i % 3 == 2) for i, t in enumerate(OTHERS)]
    known = spark.createDataFrame(known, "family string, words array<string>, holdout boolean")
    return store(rows.select("family", "words", (F.pmod(F.shiftright("order", 31), F.lit(2)) == 1).alias("holdout")).unionByName(known), "licence-sample")


def choose_features(sample: DataFrame) -> tuple[list[str], list[str]]:
    """(rare words, features): n-grams of all given notices and the most frequent
    others of the fitting half, as far as they hold a rare word; and those words."""
    fit = sample.where(~F.col("holdout"))
    is_none = F.col("family") == NONE
    n_none = max(1, fit.where(is_none).count())
    each = fit.select(is_none.alias("prose"), F.explode(F.array_distinct(grams(F.col("words")))).alias("gram"))
    counts = store(each.groupBy("gram").agg(F.sum(F.col("prose").cast("int")).alias("prose"), F.sum((~F.col("prose")).cast("int")).alias("licence"))
                   .where("licence > 0"), "licence-grams")
    given = set()
    for t in [t for ts in TEMPLATES.values() for t in ts] + OTHERS:
        ws = _plain(t).split()
        given |= {*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False))}
    common = {r["gram"] for r in counts.where(F.col("gram").isin(sorted(given)) & (F.col("prose") > COMMON * n_none)).collect()}  # of the given ones
    more = [r["gram"] for r in counts.where((F.col("prose") <= COMMON * n_none) & ~F.col("gram").isin(sorted(given)))
            .orderBy(F.desc("licence"), "gram").limit(FEATURES).collect()]
    grams_ = sorted(given - common) + more
    rare = {g for g in grams_ if " " not in g}
    feats = [g for g in grams_ if any(w in rare for w in g.split())]
    return sorted({w for g in feats for w in g.split() if w in rare}), feats


class LicenceModel:
    """Features, fitted regression, classes and the calibrated bar."""

    def __init__(self, rare: list[str], vectors: CountVectorizerModel, regression, classes: list[str], bar: float):
        self.rare, self.vectors, self.regression, self.classes, self.bar = rare, vectors, regression, classes, bar

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with words) and family, probability of the best class."""
        p = vector_to_array("probability")
        best = F.array_max(p)
        names = F.array(*map(F.lit, self.classes))
        out = self.regression.transform(self.vectors.transform(rows.withColumn("grams", grams(F.col("words")))))
        return (out.withColumns({"p": best, "best": names[(F.array_position(p, best) - 1).cast("int")]})
                .drop("features", "rawPrediction", "probability", "prediction"))


def train(docs: DataFrame, per_class: int = TRAIN_ROWS) -> LicenceModel:
    sample = training_rows(docs, per_class)
    rare, feats = choose_features(sample)
    vectors = CountVectorizerModel.from_vocabulary(feats, inputCol="grams", outputCol="features", binary=True)
    classes = [NONE, UNKNOWN, *TEMPLATES]
    index = F.lit(0.0)
    for i, c in enumerate(classes):
        index = F.when(F.col("family") == c, float(i)).otherwise(index)
    fit = vectors.transform(sample.where(~F.col("holdout")).withColumns({"grams": grams(F.col("words")), "label": index}))
    empty = docs.sparkSession.createDataFrame([(NONE, ["-"], False)], "family string, words array<string>, holdout boolean")
    fit = fit.unionByName(vectors.transform(empty.withColumns({"grams": grams(F.col("words")), "label": index})))
    sizes = {r["label"]: r["n"] for r in fit.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row per class
    weight = F.lit(1.0)
    for label, n in sizes.items():  # classes count alike, however many examples the corpus has
        weight = F.when(F.col("label") == label, sum(sizes.values()) / (len(sizes) * n)).otherwise(weight)
    regression = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60, standardization=False, weightCol="weight").fit(fit.withColumn("weight", weight))
    model = LicenceModel(rare, vectors, regression, classes, 0.5)

    # the least bar with few wrong predictions above it, over a grid of 0.5 to 0.99
    held = model.score(sample.where("holdout")).where(F.col("best") != NONE)
    bars = [0.5 + 0.01 * i for i in range(50)]
    n = [F.sum((F.col("p") >= b).cast("int")) for b in bars]
    wrong = [F.sum(((F.col("p") >= b) & (F.col("best") != F.col("family"))).cast("int")) for b in bars]
    row = held.agg(*(x.alias(f"n{i}") for i, x in enumerate(n)), *(x.alias(f"w{i}") for i, x in enumerate(wrong))).first()
    model.bar = next((b for i, b in enumerate(bars) if (row[f"w{i}"] or 0) <= ERROR * (row[f"n{i}"] or 0)), bars[-1])
    return model


def _nearest(have: Column) -> Column:
    """The family whose template shares most of its 2-grams with ``have``, if that
    is ``CONFIRM`` of them (the longer of templates that share as much)."""
    by_length = sorted(((t, f) for f, ts in TEMPLATES.items() for t in ts), key=lambda x: len(_plain(x[0]).split()))
    best = F.array_max(F.array(*(F.struct(_shares(have, t).alias("share"), F.lit(i).alias("i"), F.lit(f).alias("family")) for i, (t, f) in enumerate(by_length))))
    return F.when(best["share"] >= CONFIRM, best["family"])


def scan_paragraphs(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """doc_id, family, probability of every licence-like paragraph."""
    near = paragraphs_of(runs_of(docs).where(_holds_any(F.col("run"), model.rare)))
    scored = model.score(near).where(F.col("best") != NONE).withColumn("nearest", F.transform(F.array("grams"), _nearest)[0])
    sure = (F.col("p") >= model.bar) & (F.col("best") != UNKNOWN) & F.col("nearest").isNotNull()
    return scored.select("doc_id", F.when(sure, F.col("nearest")).otherwise(UNKNOWN).alias("family"), F.col("p").alias("probability"))


def scan(docs: DataFrame, per_class: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, family, n_paragraphs of every document with licence paragraphs."""
    found = scan_paragraphs(docs, train(docs, per_class))
    return found.groupBy("doc_id", "family").agg(F.count("*").alias("n_paragraphs"))
