"""Licence notices in paragraphs: a trained n-gram classifier with an unknown class, confirmed against templates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.session import pin

UNKNOWN = "unknown"
#: The sentences by which licences are named and granted, as their texts and common headers have them.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl-2.0": (
        "licensed under the GNU General Public License, version 2",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "gpl-3.0": (
        "licensed under the GNU General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "licensed under the GNU Lesser General Public License",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation, either version 3 of the License",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation, either version 2.1 of the License",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "agpl-3.0": (
        "licensed under the GNU Affero General Public License, version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
        "Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Released under the BSD License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl-2.0": (
        "Licensed under the Mozilla Public License, version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc0": (
        "Released under CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related rights to this work",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "unlicense": (
        "Released under the Unlicense",
        "This is free and unencumbered software released into the public domain",
        "SPDX-License-Identifier: Unlicense",
    ),
}
#: Sentences that have the words of notices and aren't any.
OTHERS = (
    "A driving license is needed to hire a car", "The license plate was found near the road", "He lost his fishing licence in May",
    "All rights reserved", "Copyright by the authors of this page", "Permission to enter was not granted by the school",
    "The museum is open to the public without charge", "Version 2 of the general plan was published by the city",
    "The software was released in version 3 last year", "She has a license to teach and a license to practise medicine",
    "Apache is a county in Arizona", "MIT is a university in Massachusetts", "Mozilla released a new browser version",
    "The Commons debated the creative use of public money", "the terms of the license were not published",
    "This work is not licensed for use in schools", "Please ask the publisher for a license", "see the license for details",
    "Redistribution of wealth and use of force are permitted", "in the public domain of ideas copyright matters",
)
#: What stands before and after a notice where it is used.
BEFORE = ("", "This file is part of the package. ", "Copyright 2020 The Authors. ", "# ", "This program is free software: ", "The text below is ")
AFTER = ("", ".", " (the \"License\").", ". See the file for details.", " as stated above.", ". All rights reserved.")
#: Parts of words one of which any notice has: a paragraph without them has no feature of the classifier.
CUES = (
    "licen", "copyright", "permi", "redistribut", "public domain", "creative commons", "gnu", "gpl", "spdx", "cc by", "cc0",
    "bsd", "apache", "mozilla")
#: Comment markers in letters at the start of lines; the others aren't words.
BORDERS = r"(?m)^[ \t]*(?:[Rr][Ee][Mm]|dnl)\b"
#: Words with these parts make a word n-gram a feature.
MARKS = (
    "licen|unlicen|copyright|permi|redistribut|public|version|commons|gnu|gpl|spdx|cc|bsd|apache|mozilla|unencumbered|attribution|affero|lesser")
#: Most words of an n-gram, features at most, penalty; probability and shared part of a template that confirm a family.
WORDS, FEATURES, PENALTY = 3, 4_096, 1e-3
PROBABILITY, SHARED = 0.5, 0.75
#: Share of a template's words from which another family's template is close: the n-grams it lacks must then be found.
CLOSE = 0.75
#: What the logits may be divided by to calibrate the probabilities.
HEATS = (0.25, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0)


def words(text: Column) -> Column:
    """Lower-case words, numbers with their points."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+[0-9]*(?:-[a-z0-9.]*[a-z0-9])*|[0-9]+(?:\.[0-9]+)*)"), F.lit(1))


def with_grams(rows: DataFrame) -> DataFrame:
    """``rows`` with the distinct n-grams of their text. Words are a column of their own, worked out once."""
    return rows.withColumn("words", words(F.col("text"))).withColumn("grams", grams(F.col("words"))).drop("words")


def grams(column: Column) -> Column:
    """Distinct n-grams of one to ``WORDS`` words that have a marked word."""
    every = []
    for size in range(1, WORDS + 1):
        last = F.size(column) - (size - 1)
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        every.append(F.transform(starts, _joined(column, size)))
    return F.filter(F.array_distinct(F.concat(*every)), lambda g: g.rlike(f"(?:^| |-)(?:{MARKS})"))


def _joined(column: Column, size: int) -> Callable[[Column], Column]:
    return lambda i: F.array_join(F.slice(column, i, size), " ")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, row, paragraph, line, text) of paragraphs that may hold notices and of their lines that may be one.

    Paragraphs end at lines without letters and digits, also those with a comment
    marker only. Line -1 is the whole paragraph; ``row`` tells rows with one doc_id apart.
    """
    has = reduce(lambda a, b: a | b, (F.contains(F.col("low"), F.lit(c)) for c in CUES))
    # Cues of two words may stand on two lines.
    low = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")
    rows = docs.withColumn("low", low).where(has).drop("low")
    parts = F.split("text", r"\n[^\p{L}\p{N}]*\n")
    rows = rows.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(parts).alias("paragraph", "text"))
    rows = rows.withColumn("low", low).where(has).drop("low").withColumn("lines", F.split("text", "\n"))
    several = F.when(F.size("lines") > 1, F.concat(F.array("text"), "lines")).otherwise(F.array("text"))
    rows = rows.select("doc_id", "row", "paragraph", F.posexplode(several).alias("line", "text")).withColumn("line", F.col("line") - 1)
    return rows.withColumn("low", low).where(has).drop("low").withColumn("text", F.regexp_replace("text", BORDERS, " "))


class Scanner:
    """Weights of the n-grams by family, and the templates' n-grams."""

    def __init__(self, spark: SparkSession):
        rows = [(f, f"{b}{t}{a}") for f, texts in TEMPLATES.items() for t in texts for b in BEFORE for a in AFTER]
        rows += [(UNKNOWN, f"{b}{t}{a}") for t in OTHERS for b in BEFORE for a in AFTER]
        examples = with_grams(spark.createDataFrame(rows, "family string, text string"))
        self.families = [*TEMPLATES, UNKNOWN]
        number = F.array_position(F.lit(self.families), F.col("family")) - 1
        examples = examples.withColumn("label", number.cast("double"))
        counter = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=FEATURES, binary=True, minDF=2.0).fit(examples)
        kept = pin(counter.transform(examples).withColumn("held", F.pmod(F.xxhash64("text"), F.lit(5)) == 0), "notices")
        learner = LogisticRegression(family="multinomial", regParam=PENALTY, maxIter=100)
        model = learner.fit(kept.where("NOT held"))
        self.heat = self._heat(model.transform(kept.where("held")))
        weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        self.bias = [float(b) for b in bias]
        table = [(gram, [float(w) for w in weights[:, k]]) for k, gram in enumerate(counter.vocabulary)]
        self.weights = spark.createDataFrame(table, "gram string, weights array<double>")
        texts = [(f, n, t) for f, own in TEMPLATES.items() for n, t in enumerate(own)]
        self.templates = spark.createDataFrame(texts, "family string, template int, text string")
        known = with_grams(self.templates).withColumn("words", words(F.col("text"))).collect()
        rows = [(t.family, t.template, t.grams, _telling(t, known)) for t in known if t.grams]
        self.templates = spark.createDataFrame(rows, "family string, template int, wanted array<string>, needed array<string>")

    @staticmethod
    def _heat(scored: DataFrame) -> float:
        """What logits are divided by so that the held-out examples' probabilities fit best."""
        logits = vector_to_array("rawPrediction")
        own = F.element_at(F.col("z"), (F.col("label") + 1).cast("int")) - F.array_max("z")

        def loss(heat: float) -> Column:
            total = F.aggregate(F.col("z"), F.lit(0.0), lambda s, z: s + F.exp((z - F.array_max("z")) / heat))
            return F.avg(F.log(total) - own / heat).alias(str(heat))

        row = scored.select(logits.alias("z"), "label").agg(*map(loss, HEATS)).first().asDict()
        return float(min(row, key=lambda k: row[k] if row[k] is not None else float("inf")))

    def scan(self, docs: DataFrame) -> DataFrame:
        """(doc_id, row, paragraph, line, found) of every line and paragraph with a feature.

        ``found`` are (family, probability, matched) of the confirmed families. A family's
        probability is against the unknown class, so that one text can have several;
        one whose n-grams all belong to a surer family's match is left out.
        """
        key = ["doc_id", "row", "paragraph", "line"]
        # Written once: a filter on the n-grams would otherwise be pushed below the words and work them out for each one.
        lines = pin(with_grams(paragraphs(docs)).select(*key, "grams").withColumn("number", F.monotonically_increasing_id()), "notices")
        hits = lines.select("number", F.explode_outer("grams").alias("gram")).join(F.broadcast(self.weights), "gram")
        size = len(self.families)
        sums = [F.sum(F.col("weights")[k]).alias(f"s{k}") for k in range(size)]
        scored = hits.groupBy("number").agg(*sums).join(lines, "number")
        logit = [(F.col(f"s{k}") + F.lit(self.bias[k])) / F.lit(self.heat) for k in range(size)]
        sure = [F.struct(F.lit(f).alias("family"), (1 / (1 + F.exp(logit[-1] - z))).alias("probability")) for f, z in zip(TEMPLATES, logit)]
        good = F.filter(F.array(*sure), lambda f: f["probability"] >= PROBABILITY)
        scored = scored.select(*key, "grams", F.explode_outer(good).alias("own")).select(*key, "grams", "own.*")
        found = scored.join(F.broadcast(self.templates), "family", "left")
        found = found.withColumn("matched", F.array_intersect("grams", "wanted"))
        confirmed = (F.try_divide(F.size("matched"), F.size("wanted")) >= SHARED) & (F.size(F.array_except("needed", "matched")) == 0)
        found = found.groupBy(*key, "family", "probability").agg(
            F.array_distinct(F.flatten(F.collect_list(F.when(confirmed, F.col("matched"))))).alias("matched"))
        own = F.struct(F.size("matched").alias("size"), "probability", "family", "matched")
        found = found.groupBy(*key).agg(F.collect_list(F.when(F.size("matched") > 0, own)).alias("found"))
        surer = lambda f, o: (o["size"] > f["size"]) | ((o["size"] == f["size"]) & (
            (o["probability"] > f["probability"]) | ((o["probability"] == f["probability"]) & (o["family"] < f["family"]))))
        within = lambda f, o: surer(f, o) & (F.size(F.array_except(f["matched"], o["matched"])) == 0)
        return found.withColumn("found", F.filter("found", lambda f: ~F.exists("found", lambda o: within(f, o))))


def _telling(template, known: list) -> list[str]:
    """The n-grams of a template that close templates of other families lack, such as the number of a version."""
    own = set(template.words)
    close = (t for t in known if t.family != template.family and len(own & set(t.words)) >= CLOSE * len(own))
    return sorted(set().union(*(set(template.grams) - set(t.grams) for t in close)))


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_notices, families, probability, other) of every document.

    ``families`` are those of the confirmed notices in its paragraphs, sorted; ``probability``
    is that of the surest, 0 without any. ``n_notices`` counts each family of a line, and
    those of a paragraph that none of its lines has by itself. ``other`` counts paragraphs
    that read like a notice but whose family is unknown or that no template confirms.
    Only DataFrame functions and Spark's own learners run. A null or empty text has no
    notice. Rows with one doc_id each keep their own result, repeated rows are
    repeated, an empty table gives none; columns other than doc_id and text are not read.
    """
    docs = docs.select("doc_id", "text")
    # Repeated rows give the same paragraphs; their result is joined to each of them.
    lines = Scanner(docs.sparkSession).scan(docs.distinct())
    names = lambda which: F.flatten(F.collect_list(F.when(which, F.col("found.family"))))
    found = lines.groupBy("doc_id", "row", "paragraph").agg(
        names(F.col("line") >= 0).alias("single"), names(F.col("line") < 0).alias("whole"),
        F.max(F.array_max("found.probability")).alias("probability"))
    extra = F.array_except("whole", "single")
    found = found.withColumn("own", F.concat("single", extra))
    found = found.groupBy("doc_id", "row").agg(
        F.sum(F.size("own")).cast("long").alias("n_notices"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("families"),
        F.coalesce(F.max("probability"), F.lit(0.0)).alias("probability"), F.count_if(F.size("own") == 0).alias("other"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"))
    same = rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["row"] == found["row"])
    joined = rows.join(found, same, "left").select(rows["doc_id"], "n_notices", "families", "probability", "other")
    return joined.select(
        "doc_id", F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
        F.coalesce("probability", F.lit(0.0)).alias("probability"), F.coalesce("other", F.lit(0).cast("long")).alias("other"))
