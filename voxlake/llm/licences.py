"""Licence scan: sparse word n-gram logistic regression over paragraphs, a calibrated unknown class, template confirmation. DataFrame functions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm.common import stored, table

#: Notices of the licence families as their publishers word them, and the short forms in use.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.", "This project is licensed under the MIT License.", "This code is MIT licensed.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.", "This file is made available under the Apache License, Version 2.0.", "Apache 2.0 licensed.", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.", "Released under the GNU GPL version 3.",
        "Licensed under GPLv3.", "Licensed under the GPL-3.0.", "SPDX-License-Identifier: GPL-3.0-or-later", "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl-3.0": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", "Licensed under the LGPLv3.", "Released under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Released under the CC BY-NC 4.0 license.",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "cc0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"),
}
#: Sentences that speak of licences and grant none: examples of the unknown class.
HARD = (
    "All rights reserved. No part of this publication may be reproduced without written permission.", "See the license for details.", "Permission denied.", "You need a valid driver license.",
    "The software is provided to any person on request, free of charge for students.", "Use of this file requires a commercial license.", "Contact the author for a copy of the documentation.",
)
UNKNOWN = "unknown"
#: Words that make no pair by themselves (fixed values: English function words).
STOP = ("a", "an", "and", "any", "as", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "under", "was", "with", "you", "be", "may", "can", "are", "not")
#: Training takes at most so many background paragraphs, from at most so many documents (least hashes first).
BACKGROUND, BACKGROUND_DOCS = 2000, 200
EPOCHS, RATE, DECAY = 250, 4.0, 1e-4
#: Share of a template's word pairs that a paragraph must hold, one that no other family has among them, for the template to confirm the prediction.
CONFIRM = 0.6


def words_of(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def pairs_of(words: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, para, line, words): every line of every whole text that has words, and each paragraph of several lines as a whole, as line -1.

    Blank lines part paragraphs. Null texts have none.
    """
    blocks = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n")).alias("para", "block"))
    blocks = blocks.withColumn("lines", F.split("block", "\n")).withColumn("n", F.size("lines"))
    units = blocks.select("doc_id", "para", "n", F.posexplode(F.when(F.col("n") > 1, F.concat("lines", F.array("block"))).otherwise(F.col("lines"))).alias("at", "text"))
    line = F.when(F.col("at") < F.col("n"), F.col("at")).otherwise(-1)
    return units.select("doc_id", "para", line.alias("line"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)


def _made(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """(family, template, pairs) of sentences: their pairs in order, without those of function words alone."""
    made = spark.createDataFrame(rows, "family string, template string, text string")
    plain = lambda p: ~F.split(p, " ")[0].isin(*STOP) | ~F.split(p, " ")[1].isin(*STOP)
    return made.select("family", "template", F.filter(pairs_of(words_of(F.col("text"))), plain).alias("pairs"))


def template_pairs(spark: SparkSession, templates: dict = TEMPLATES) -> DataFrame:
    """(family, template, pair, own): the pairs of each template that hold more than function words; own: no other family has it."""
    rows = [(family, f"{family}#{i}", text) for family, texts in templates.items() for i, text in enumerate(texts)]
    made = _made(spark, rows).select("family", "template", F.explode("pairs").alias("pair"))
    families = made.groupBy("pair").agg(F.countDistinct("family").alias("n"))
    return made.join(F.broadcast(families), "pair").select("family", "template", "pair", (F.col("n") == 1).alias("own"))


def negated(templates: dict) -> list[str]:
    """The templates that say what something is, saying that it is not."""
    said = [re.sub(r"(?i)\b(licensed|released|distributed|available|permitted|granted)\b", r"not \1", t, count=1) for ts in templates.values() for t in ts]
    return [t for t in said if " not " in f" {t.lower()}"]


def _key_words(spark: SparkSession, templates: dict) -> list[str]:
    """The words of the templates that are no function words: a paragraph without any holds no pair."""
    texts = spark.createDataFrame([(t,) for ts in templates.values() for t in ts], "text string")
    return [r["w"] for r in texts.select(F.explode(words_of(F.col("text"))).alias("w")).filter(~F.col("w").isin(*STOP)).distinct().orderBy("w").collect()]


def fit_licences(docs: DataFrame, templates: dict, epochs: int = EPOCHS) -> DataFrame:
    """(family, pair, w): weights of one-against-rest logistic regressions; the empty pair has the bias, `?` the calibrated margin.

    Examples of a family are its templates, whole and without their last quarter; those of the unknown class
    are HARD, the negated templates, and one half of a bounded number of corpus paragraphs, told
    apart by their pairs and weighted by how many look alike. A corpus paragraph that holds most of a template is a
    notice and no background. Examples are sparse: gradient descent runs inside one expression over the
    places of their pairs. The margin is calibrated on what was not fitted: midway between the highest score
    of the other half of the paragraphs and of all other classes, and the lowest of the family's
    templates without their first quarter.
    """
    spark = docs.sparkSession
    rows = [(family, f"{family}#{i}", text) for family, texts in templates.items() for i, text in enumerate(texts)]
    own = _made(spark, rows)
    bad = _made(spark, [(UNKNOWN, f"{UNKNOWN}#{i}", t) for i, t in enumerate([*HARD, *negated(templates)])])
    vocabulary = own.unionByName(bad).select(F.explode("pairs").alias("p")).agg(F.sort_array(F.collect_set("p")).alias("vocabulary"))
    known = own.select(F.col("pairs").alias("whole"))
    few = docs.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(BACKGROUND_DOCS)
    back = paragraphs(few).filter("line >= 0").orderBy(F.xxhash64("doc_id", "para", "line"), "doc_id", "para", "line").limit(BACKGROUND).select(pairs_of(F.col("words")).alias("pairs"))
    back = back.crossJoin(F.broadcast(vocabulary)).crossJoin(F.broadcast(known.agg(F.collect_list("whole").alias("known"))))
    notice = F.exists("known", lambda t: F.size(F.array_intersect(t, "pairs")) >= CONFIRM * F.size(t))
    back = back.filter(~notice).select(F.sort_array(F.array_intersect("pairs", "vocabulary")).alias("pairs"))
    back = back.groupBy("pairs").agg(F.count("*").cast("double").alias("n"))
    half = F.pmod(F.xxhash64("pairs"), F.lit(2)) == 0
    n, quarter = F.size("pairs"), F.floor(F.size("pairs") / 4).cast("int")
    first, last = F.slice("pairs", 1, n - quarter), F.slice("pairs", quarter + 1, n - quarter)
    example = lambda df, pairs, weight, fit: df.select("family", pairs.alias("pairs"), weight.cast("double").alias("n"), fit.alias("fit"))
    yes, no = F.lit(True), F.lit(False)
    examples = example(own, F.col("pairs"), F.lit(20), yes).unionByName(example(own, first, F.lit(20), yes)).unionByName(example(own, last, F.lit(20), no))
    examples = examples.unionByName(example(bad, F.col("pairs"), F.lit(20), yes)).unionByName(example(back.withColumn("family", F.lit(UNKNOWN)), F.col("pairs"), F.col("n"), half))
    none = spark.range(1).select(F.lit(UNKNOWN).alias("family"), F.array().cast("array<string>").alias("pairs"))
    examples = examples.unionByName(example(none, F.col("pairs"), F.lit(1), yes)).crossJoin(F.broadcast(vocabulary))
    at = F.filter(F.transform("pairs", lambda p: (F.array_position("vocabulary", p) - 1).cast("int")), lambda i: i >= 0)
    examples = examples.select(F.struct("family", at.alias("at"), "n", "fit").alias("e"))
    examples = examples.agg(F.sort_array(F.collect_list("e")).alias("every")).crossJoin(F.broadcast(vocabulary))
    examples = examples.withColumn("ex", F.expr("filter(every, e -> e.fit)")).withColumn("total", F.expr("aggregate(ex, 0D, (s, e) -> s + e.n)"))
    examples = examples.withColumn("holders", F.expr("transform(sequence(0, size(vocabulary) - 1), v -> filter(sequence(0, size(ex) - 1), k -> array_contains(ex[k].at, v)))"))
    fits = own.select("family").distinct().crossJoin(F.broadcast(examples))
    score = "aggregate({e}.at, {w}[size(vocabulary)], (s, i) -> s + {w}[i])"  # the bias stands behind the pairs
    left = f"transform(ex, e -> e.n / total * (if(e.family = family, 1D, 0D) - 1D / (1D + exp(-{score.format(e='e', w='w')}))))"
    move = f"transform(array({left}), r -> concat(transform(holders, (hs, v) -> w[v] + {RATE}D * (aggregate(hs, 0D, (s, k) -> s + r[k]) - {DECAY}D * w[v])), array(w[size(vocabulary)] + {RATE}D * (aggregate(r, 0D, (s, x) -> s + x) - {DECAY}D * w[size(vocabulary)]))))[0]"
    zero = "transform(sequence(0, size(vocabulary)), i -> 0D)"
    fitted = fits.withColumn("w", F.expr(f"aggregate(sequence(1, {epochs}), {zero}, (w, t) -> {move})"))
    others = F.expr(f"transform(filter(every, e -> e.family <> family), e -> {score.format(e='e', w='w')})")
    mine = F.expr(f"transform(filter(every, e -> not e.fit and e.family = family), e -> {score.format(e='e', w='w')})")
    fitted = fitted.withColumn("margin", (F.coalesce(F.array_max(others), F.lit(0.0)) + F.array_min(mine)) / 2)
    named = F.concat(F.array(F.lit("?")), F.col("vocabulary"), F.array(F.lit("")))
    return fitted.select("family", F.explode(F.arrays_zip(named.alias("pair"), F.concat(F.array("margin"), F.col("w")).alias("w"))).alias("z")).select("family", "z.pair", "z.w")


def licence_notices(docs: DataFrame, templates: dict = TEMPLATES, confirm: float = CONFIRM) -> DataFrame:
    """(doc_id, para, line, family, score, share) for each notice in docs (doc_id, text); line is -1 where it runs over several lines.

    A line is a notice of its best-scoring family if the score passes that family's margin and a template of
    the family confirms it. A paragraph of several lines is, besides, a notice of each family that a template confirms
    in it as a whole and that none of its lines is a notice of; pairs that only other confirmed families explain do
    not count in the score then. A paragraph without any notice where it or a line of it scores past the best
    family's margin is one of the family unknown. Only units with some template word are expanded into pairs,
    as the others cannot score above the bias.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    known = stored(template_pairs(spark, templates), "templates")
    weights = stored(fit_licences(docs, templates), "weights")
    keys = F.array(*[F.lit(w) for w in _key_words(spark, templates)])
    para, unit = ["doc_id", "para"], ["doc_id", "para", "line"]
    units = paragraphs(docs).filter(F.arrays_overlap("words", keys)).select(*unit, F.explode(pairs_of(F.col("words"))).alias("pair"))
    vocabulary = weights.filter("pair not in ('', '?')").select("pair").distinct()
    hits = stored(units.join(F.broadcast(vocabulary), "pair", "left_semi"), "hits")
    base = weights.filter("pair in ('', '?')").groupBy("family").pivot("pair", ["", "?"]).agg(F.first("w")).toDF("family", "bias", "margin")

    def same(on: list[str], *more: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on] + list(more))

    scored = hits.join(F.broadcast(weights), "pair").groupBy(*unit, "family").agg(F.sum("w").alias("z")).join(F.broadcast(base), "family")
    scored = scored.withColumn("score", F.col("z") + F.col("bias"))
    best = scored.groupBy(*unit).agg(F.max_by(F.struct("family", "score", "margin"), F.struct("score", "family")).alias("b")).filter("b.score >= b.margin")
    best = stored(best.select(*unit, "b.family", "b.score"), "best")
    sizes = known.groupBy("template").agg(F.count("*").alias("pairs"))
    shares = hits.join(F.broadcast(known), "pair").groupBy(*unit, "family", "template").agg(F.count("*").alias("n"), F.bool_or("own").alias("own")).join(F.broadcast(sizes), "template").filter("own")
    shares = stored(shares.groupBy(*unit, "family").agg(F.max(F.col("n") / F.col("pairs")).alias("share")).filter(F.col("share") >= confirm), "shares")
    out = [*unit, "family", "score", "share"]
    by_line = best.filter("line >= 0").alias("l").join(shares.alias("r"), same([*unit, "family"])).select("l.*", "r.share").select(*out)
    by_line = stored(by_line, "notices")
    # paragraphs as wholes: a family's own pairs count, and those that no confirmed family has
    sure = shares.filter("line = -1").join(F.broadcast(known.groupBy("family").agg(F.collect_set("pair").alias("own"))), "family")
    every = sure.groupBy(*unit).agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("all"))
    open_ = sure.alias("l").join(every.alias("r"), same(unit)).select("l.*", "r.all").alias("l").join(hits.alias("r"), same(unit))
    open_ = open_.filter(F.array_contains("own", F.col("pair")) | ~F.array_contains("all", F.col("pair"))).select("l.*", "r.pair")
    summed = open_.join(F.broadcast(weights), ["family", "pair"]).groupBy(*unit, "family", "share").agg(F.sum("w").alias("z")).join(F.broadcast(base), "family")
    whole = summed.withColumn("score", F.col("z") + F.col("bias")).filter("score >= margin").select(*out)
    whole = whole.alias("l").join(by_line.alias("r"), same([*para, "family"]), "left_anti").select(*out)
    notices = stored(by_line.unionByName(whole), "notices")
    odd = best.alias("l").join(notices.alias("r"), same(para), "left_anti").groupBy(*para).agg(F.min("line").alias("line"), F.max("score").alias("score"))
    return notices.unionByName(odd.select(*unit, F.lit(UNKNOWN).alias("family"), "score", F.lit(None).cast("double").alias("share")))


def scan_licences(docs: DataFrame, templates: dict = TEMPLATES, confirm: float = CONFIRM) -> DataFrame:
    """doc_id, licences (sorted families), n_notices and best_score for every row of docs (doc_id, text).

    Rows without a notice get an empty array, 0 and null; so do null and empty texts. Rows that share
    a doc_id (null included) are judged together and all get the joint result. Long texts are read
    whole, repeated lines count each, a notice over several lines counts once a paragraph and family;
    `unknown` stands for paragraphs that score as licence text and match no template; an empty table gives an empty result; other columns are ignored.
    """
    found = licence_notices(docs, templates, confirm).groupBy("doc_id").agg(
        F.sort_array(F.collect_set("family")).alias("licences"), F.count("*").alias("n_notices"), F.max("score").alias("best_score"))
    rows = docs.select("doc_id").alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), "left")
    return rows.select("d.doc_id", F.coalesce("licences", F.array().cast("array<string>")).alias("licences"), F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.round("best_score", 6).alias("best_score"))


def op6_licences(spark, sf_dir):
    return scan_licences(table(spark, sf_dir, "documents"))
