r"""License scan by a trained paragraph classifier.

Paragraphs are the lines of a text, and its blocks of adjacent lines that are not
blank, for notices that are wrapped.  Their words (letters, digits, dots within
numbers; lower case) give the word 1- to 4-grams of a multinomial logistic
regression over licence families and ``unknown``; only n-grams with one of
``STEMS`` in a word count, so a paragraph without any is the zero vector and is
unknown by construction, and such paragraphs are dropped before the classifier.

The model is trained by ``pyspark.ml`` on the notices below, whole, cut and
embedded in other words, against sentences that use the same words otherwise and
bounded samples of the corpus's own lines, both without any stem and as they are
scanned, where no template matches.  Calibration: the cutoff on the family's
probability is the smallest one on a grid at which at most ``FALSE_SHARE`` of
held-back unknown paragraphs reach a family, of the scanned ones and of the rest.  A prediction
counts only if it reaches the cutoff and a template of its family confirms it:
at least ``CONFIRM`` of the template's word pairs are in the paragraph.

Everything is DataFrame, SQL and ``pyspark.ml`` work in the JVM.  Defined edge
cases: null and empty texts have no paragraphs; rows with null ids and repeated
rows are scanned like others; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.shared import materialize

#: Usual short notices of licence families.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License", "SPDX-License-Identifier: Apache-2.0", "This project is released under the Apache License 2.0"],
    "mit": ["Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License v3.0", "SPDX-License-Identifier: GPL-3.0-only", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "Released under the GPLv3", "Licensed under the GNU GPL v3"],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only", "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version", "Released under the GPLv2", "Licensed under the GNU GPL v2"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-3.0-or-later", "under the terms of the GNU Lesser General Public License"],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "bsd": ["Released under the BSD 3-Clause License", "Licensed under the BSD License", "Distributed under the terms of the Modified BSD License", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "isc": ["Licensed under the ISC License", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "epl-2.0": ["This program is made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0": ["Dedicated to the public domain under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "proprietary": ["Copyright. All rights reserved", "All rights reserved. No part of this publication may be reproduced without permission of the publisher"],
}
#: Sentences that use such words without granting a licence.
OTHER = [
    "The driver must carry a license at all times", "He lost his fishing license last year", "The board revoked the restaurant's liquor license", "a licensed electrician must do this work",
    "Copyright law was changed in that year", "the lecture is about copyright and its history", "The version of the story differs", "the general public was invited", "a public meeting on the common land",
    "the apache rode over the hill", "a student at MIT wrote the paper", "The warranty ends after two years", "Permission to land was granted", "a creative writer with a common touch", "the foundation published a report on free software",
    "the gnu is a large antelope", "terms of the agreement were not published", "under the terms of the treaty", "she studied the source of the river", "use of the hall is free of charge", "license fees rose", "which license should I choose for my project",
]
#: Parts of words of which one must be in an n-gram that counts.
STEMS = ("licen", "copyright", "eclipse", "unencumbered", "apache", "gnu", "gpl", "bsd", "mozilla", "mpl", "creative", "attribution", "noncommercial", "sharealike", "cc0", "cc", "spdx", "redistribut", "warrant", "permission", "reserved", "domain")
UNKNOWN = "unknown"
FEATURES = 1 << 12
BACKGROUND_LINES = 2000
FALSE_SHARE = 0.01
CONFIRM = 0.6
SEED = 3


def words(text: Column) -> Column:
    """The words of a line, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:\.\p{N}+)*"), F.lit(0))


def _grams(name: str, n: int) -> Column:
    """The n-grams of an array of words, joined by spaces.  By places, as slice() walks the whole array each time."""
    own = ", ".join(f"{name}[i + {k}]" for k in range(n))
    return F.expr(f"IF(size({name}) >= {n}, transform(sequence(0, size({name}) - {n}), i -> concat_ws(' ', {own})), cast(array() AS array<string>))")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is worked out once a row: later filters, which use it often, do not go below the generator."""
    return df.withColumn(name, F.explode_outer(F.array(value)))


def _counted(df: DataFrame) -> DataFrame:
    """Add ``words`` and the n-grams that count, from ``line``."""
    df = _once(df, "words", words(F.col("line")))
    return _once(df, "grams", F.filter(F.concat(*(_grams("words", n) for n in (1, 2, 3, 4))), _stem))


def _stem(gram: Column) -> Column:
    out = gram.contains(STEMS[0])
    for stem in STEMS[1:]:
        out = out | gram.contains(stem)
    return out


def _gate(text: Column) -> Column:
    """Whether a word, and so an n-gram, of a text has a stem; stems hold no word ends.  The text is lowered once."""
    return F.exists(F.array(F.lower(text)), _stem)


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (doc_id, text_hash, block, whole, paragraph, line) of the lines and blocks whose vector is not zero.

    A block is a run of adjacent lines that are not blank, ``block`` its first line's
    number; a whole block, joined by spaces, is a row besides its lines if it has several.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(_gate(F.col("text")))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("lines"))
    rows = rows.withColumn("full", F.transform("lines", lambda x: x.rlike(r"\S")))
    edge = lambda step, end: F.expr(f"filter(sequence(0, size(full) - 1), i -> full[i] AND (i = {end} OR NOT full[i + {step}]))")
    rows = rows.select("doc_id", "text_hash", "lines", F.arrays_zip(edge(-1, "0").alias("a"), edge(1, "size(full) - 1").alias("b")).alias("blocks"))
    piece = "named_struct('block', k.a, 'whole', {}, 'paragraph', {}, 'line', {})"
    whole, line = piece.format("true", "k.a", "array_join(slice(lines, k.a + 1, k.b - k.a + 1), ' ')"), piece.format("false", "i", "lines[i]")
    pieces = F.expr(f"flatten(transform(blocks, k -> concat(transform(if(k.b > k.a, array(0), cast(array() AS array<int>)), z -> {whole}), transform(sequence(k.a, k.b), i -> {line}))))")
    # Outer, as the optimizer would else work out all pieces in the filter on texts, before the gate.
    rows = rows.select("doc_id", "text_hash", F.explode_outer(F.filter(pieces, lambda p: _gate(p["line"]))).alias("p")).where("p IS NOT NULL")
    return rows.select("doc_id", "text_hash", "p.*")


def training_lines(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Return (family, line, scanned, held): notices, altered notices and unknown lines; bounded in size.

    ``scanned`` rows are lines and blocks of the corpus as scan() scores them, of blocks
    that no template matches.
    """
    around = [("", ""), ("the following holds. ", ""), ("", " see the file for details"), ("copy and use of this text: ", " and so on"), ("note: ", ".")]
    rows = [(family, a + t + b) for family, ts in TEMPLATES.items() for t in ts for a, b in around]
    rows += [(UNKNOWN, a + t + b) for t in OTHER for a, b in around]
    fixed = spark.createDataFrame(rows, "family string, line string")
    lines = docs.select(F.explode(F.split(F.col(text_col).cast("string"), "\n")).alias("line")).where(F.length("line").between(1, 2000) & ~_gate(F.col("line")))
    own = lines.withColumn("h", F.xxhash64("line", F.lit(SEED))).where(F.pmod("h", F.lit(64)) == 0).groupBy("line").agg(F.min("h").alias("h")).orderBy("h", "line").limit(BACKGROUND_LINES)
    # A corpus line, also with a sentence of other use before it.
    odd = F.element_at(F.array(*map(F.lit, OTHER)), (F.pmod("h", F.lit(len(OTHER))) + 1).cast("int"))
    both = own.select(F.lit(UNKNOWN).alias("family"), F.explode(F.array(F.col("line"), F.concat_ws(" ", odd, F.substring("line", 1, 200)))).alias("line"))
    # Matched by block, so that pieces of a wrapped notice are not taken for unknown.
    match = F.greatest(*(_share(t) for ts in TEMPLATES.values() for t in ts))
    pieces = _once(paragraphs(docs.withColumn("_id", F.lit(0)), "_id", text_col), "words", words(F.col("line")))
    pieces = _once(pieces, "pairs", _grams("words", 2)).withColumn("match", match)
    pieces = pieces.withColumn("of_block", F.max("match").over(Window.partitionBy("text_hash", "block"))).where(F.col("of_block") < CONFIRM)
    near = pieces.withColumn("h", F.xxhash64("line", F.lit(SEED))).groupBy("line").agg(F.min("h").alias("h")).orderBy("h", "line").limit(BACKGROUND_LINES)
    found = fixed.unionByName(both).withColumn("scanned", F.lit(False)).unionByName(near.select(F.lit(UNKNOWN).alias("family"), "line", F.lit(True).alias("scanned")))
    return found.withColumn("held", (F.col("family") == UNKNOWN) & (F.pmod(F.xxhash64("line"), F.lit(4)) == 0))


class LicenseModel:
    """The classifier, its families and its calibrated cutoff."""

    def __init__(self, spark: SparkSession, docs: DataFrame, text_col: str = "text"):
        self.families = [UNKNOWN, *TEMPLATES]
        self._hash = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="x")
        index = F.array_position(F.array(*map(F.lit, self.families)), F.col("family")).cast("double") - 1
        # Written once, as training reads the few lines again and again, but the corpus is read once.
        rows = _counted(materialize(training_lines(spark, docs, text_col), "lines")).withColumn("label", index)
        self.model: LogisticRegressionModel = LogisticRegression(featuresCol="x", family="multinomial", regParam=1e-4, maxIter=60).fit(self._hash.transform(rows.where("NOT held")))
        held = self.scores(rows.where("held"))
        reach = F.when(F.col("predicted") == UNKNOWN, 0.0).otherwise(F.col("probability"))
        grid = [round(0.5 + 0.01 * k, 2) for k in range(50)]
        counts = held.groupBy("scanned").agg(F.count("*").alias("n"), *(F.count_if(reach >= g).alias(f"g{i}") for i, g in enumerate(grid))).collect()
        self.cutoff = next((g for i, g in enumerate(grid) if all(c[f"g{i}"] <= FALSE_SHARE * c["n"] for c in counts)), 0.999)

    def scores(self, rows: DataFrame) -> DataFrame:
        """Add ``predicted`` and ``probability`` to rows with ``grams``."""
        p = _once(self.model.transform(self._hash.transform(rows)), "p", vector_to_array("probability")).drop("probability", "rawPrediction", "prediction", "x")
        top = F.array_position("p", F.array_max("p")).cast("int")
        return p.withColumn("predicted", F.element_at(F.array(*map(F.lit, self.families)), top)).withColumn("probability", F.array_max("p")).drop("p")


def _word_pairs(template: str) -> list[str]:
    """The distinct word pairs of a template, as the SQL expressions would give them."""
    own = re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", template.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(own, own[1:])))


def _share(template: str) -> Column:
    """The share of a template's word pairs that ``pairs`` has."""
    own = _word_pairs(template)
    return F.size(F.array_intersect(F.array(*map(F.lit, own)), F.col("pairs"))) / len(own)


def _overlap() -> Column:
    """The largest share of a template's word pairs, of the predicted family, that ``pairs`` has."""
    best = F.lit(0.0)
    for family, templates in TEMPLATES.items():
        best = F.when(F.col("predicted") == family, F.greatest(*map(_share, templates))).otherwise(best)
    return best


def _own_pairs(family: Column) -> Column:
    """The word pairs of all templates of a family."""
    out = F.array().cast("array<string>")
    for name, templates in TEMPLATES.items():
        out = F.when(family == name, F.array(*(F.lit(p) for p in dict.fromkeys(p for t in templates for p in _word_pairs(t))))).otherwise(out)
    return out


def scan(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (doc_id, paragraph, family, probability, overlap) of every confirmed licence paragraph.

    A block is reported at its first line, unless a line of it shows the same family.
    A line is not, if its block shows another family by a larger overlap and a template
    of that one has all that the line shares with its own: it is a piece of that notice.
    """
    rows = _once(model.scores(_counted(paragraphs(docs, id_col, text_col))), "pairs", _grams("words", 2))
    rows = rows.where((F.col("predicted") != UNKNOWN) & (F.col("probability") >= model.cutoff)).withColumn("overlap", _overlap())
    # Rows with equal ids and texts show the same, so that they may share a window.
    rows = rows.where(F.col("overlap") >= CONFIRM).withColumn("shared", F.array_intersect("pairs", _own_pairs(F.col("predicted"))))
    block = Window.partitionBy("doc_id", "text_hash", "block")
    rows = rows.withColumn("of_block", F.max(F.when(F.col("whole"), F.struct("overlap", "predicted"))).over(block))
    other = F.col("of_block.predicted")
    piece = ~F.col("whole") & (other != F.col("predicted")) & (F.col("of_block.overlap") > F.col("overlap")) & (F.size(F.array_except("shared", _own_pairs(other))) == 0)
    rows = rows.where(~F.coalesce(piece, F.lit(False)))
    rows = rows.withColumn("of_lines", F.collect_set(F.when(~F.col("whole"), F.col("predicted"))).over(block))
    return rows.where(~F.col("whole") | ~F.array_contains("of_lines", F.col("predicted"))).select("doc_id", "paragraph", F.col("predicted").alias("family"), "probability", "overlap")
