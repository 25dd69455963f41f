"""License scans: a trained paragraph classifier over sparse word n-grams, its predictions confirmed against templates.

DataFrame operations of the JVM throughout; n-gram counts and the classifier are Spark's own models, fitted and applied to DataFrames.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dosewise.llm.common import saved

#: Notices of each family, as their authors word them.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "This project is released under the Apache 2.0 license",
        "Apache License Version 2.0, January 2004",
    ],
    "mit": [
        "Released under the MIT License",
        "This software is licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The MIT License (MIT)",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the 3-clause BSD license",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU GPL version 2 or later",
        "Released under the GNU General Public License",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC license"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work", "Released under CC0 1.0 Universal"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}
#: Paragraphs of the unknown class: words of licences in other uses, and other prose.
OTHERS = [
    "All rights reserved.", "Copyright 2019 the authors. All rights reserved.", "You need a driving license to rent a car in this city.", "The license plate was found near the public library.",
    "The general said that the public was free to use the road.", "The software was released in version 2 of the program last year.", "He studied at MIT and later at Stanford.",
    "The Apache are a people of the southwest.", "Apache helicopters flew over the foundation of the work.", "The commission granted permission to the school free of charge.", "A copy of this document is attached to the file.",
    "Modification of the source is not in the terms of the contract.", "Creative work is common among the students of the school.", "The gnu is a large animal of the plains.", "This work is under way, and version 3 is planned for May.",
    "The terms and conditions apply to all users of this site.", "By using this site you agree to the privacy policy and the terms of use.", "Subscribe to our newsletter for free.", "Click here to accept all cookies.",
    "The library is open to the public from nine to five.", "Source: national statistics office.", "Attribution of the painting is not certain.", "International law permits the use of force in such cases.",
    "The binary star was seen in two forms.", "Redistribution of wealth is a question of the age.", "The foundation was free of any debt.", "The license fee was raised by 2.0 percent.", "Any person with a fee waiver can distribute the form.",
    "The Mozilla browser has a new version.", "He is licensed to practise medicine.", "They released the album under a new name.", "The bar was licensed under the old law.", "Released in 2004 under the title of the book.", "Commercial use of the land is not permitted.",
    "The public domain of the king was large.", "This is free for all people who use it.", "Permission is required to copy the key.", "To the extent that it is possible, the author has answered.", "Universal rights are related to the law.", "In the beginning was the word, and the word was with them.",
    "The quick brown fox jumps over the lazy dog.", "It was the best of times, it was the worst of times.", "She sells sea shells by the sea shore.", "There are 4.0 million people in the state.", "Section 3 of the act came into force in January.", "an of the in and to is a that on", "it was with for at by or not be this are",
]
UNKNOWN = "unknown"
#: A template confirms if so much of its word pairs stand in the paragraph.
COVERAGE = 0.8
VOCABULARY = 4000
#: Words that mark a line as a comment; other marks are no words.
MARKS = r"(?i)^[\s&&[^\n]]*(rem|dnl)[\s&&[^\n]]"


def words(text: Column) -> Column:
    return F.split(F.lower(text), "[^a-z0-9]+")


def pairs(w: Column) -> Column:
    """Neighbouring words joined; none for fewer than two."""
    return F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def ngrams(text: Column) -> Column:
    w = words(text)
    return F.concat(w, pairs(w))


def _training(spark: SparkSession) -> DataFrame:
    """(label, text, part): each notice plain, within other words, and without its end; part 1 is kept for calibration."""
    rows = []
    for family, notices in TEMPLATES.items():
        for text in notices:
            cut = " ".join(text.split()[: max(3, len(text.split()) * 4 // 5)])
            around = [OTHERS[(len(rows) + k) % len(OTHERS)] for k in (0, 7)]
            rows += [(family, text, 0), (family, text.upper(), 1), (family, cut if len(text.split()) > 8 else text, 0), (family, f"{around[0]} {text}.", 0), (family, f"{text}. {around[1]}", 1)]
    for i, text in enumerate(OTHERS):
        rows += [(UNKNOWN, text, 0), (UNKNOWN, f"{text} {OTHERS[(i * 5 + 3) % len(OTHERS)]}", i % 2), (UNKNOWN, " ".join(reversed(text.split())), 1 - i % 2)]
    return spark.createDataFrame(rows, "label string, text string, part int").coalesce(1)


@functools.lru_cache(maxsize=4)
def _fit(spark: SparkSession):
    """(classes, n-gram model, classifier, least probability): fitted on the training rows alone.

    The L1 penalty leaves few n-grams with weights. Calibration sets the least probability, on rows that are kept out of the fit: above
    what any of the unknown class among them is given for a family.
    """
    classes = [UNKNOWN, *TEMPLATES]
    labels = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))])
    rows = _training(spark).select(labels[F.col("label")].alias("label"), ngrams(F.col("text")).alias("_ngrams"), "part").cache()
    counts = CountVectorizer(inputCol="_ngrams", outputCol="_features", vocabSize=VOCABULARY, binary=True).fit(rows)
    fit = LogisticRegression(family="multinomial", featuresCol="_features", rawPredictionCol="_raw", probabilityCol="_chances", predictionCol="_class", regParam=0.002, elasticNetParam=0.7, maxIter=60, standardization=False)
    model = fit.fit(counts.transform(rows.where("part = 0")))
    # some dozens of rows of this module
    held = model.transform(counts.transform(rows.where("part = 1"))).where("label = 0").select("_chances").collect()
    least = max(max(map(float, r["_chances"][1:])) for r in held)
    rows.unpersist()
    return classes, counts, model, math.nextafter(least, 1)


def _template_pairs(text: str) -> list[str]:
    w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    return list(dict.fromkeys(map(" ".join, zip(w, w[1:], strict=False))))


@functools.cache
def _telling() -> str:
    """A pattern that any text with COVERAGE of a template's pairs meets: of each template so many long words that their pairs cannot all be missing."""
    found = set()
    for text in (t for ts in TEMPLATES.values() for t in ts):
        tp, some = _template_pairs(text), set()
        spare = len(tp) - math.ceil(COVERAGE * len(tp) - 1e-9)
        for w in sorted({w for p in tp for w in p.split()}, key=lambda w: (-len(w), w)):
            if sum(not some.isdisjoint(p.split()) for p in tp) > spare:
                break
            some.add(w)
        found |= some
    return "|".join(sorted(found))


def _candidates(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose `text`, as a whole and without marks of comments at its lines, has COVERAGE of the word pairs of any template.

    Marks stand in no template, so a line has no fewer pairs without them, and runs of lines, joined without them, have no others: a text that is
    left out has no paragraph that a template can confirm.
    """
    every = [_template_pairs(t) for ts in TEMPLATES.values() for t in ts]
    known = F.array(*map(F.lit, dict.fromkeys(p for tp in every for p in tp)))
    # bound as a lambda's variable, so that the text's pairs are formed once and not for each template
    enough = lambda met: functools.reduce(lambda x, y: x | y, [F.size(F.array_intersect(F.array(*map(F.lit, tp)), met)) >= COVERAGE * len(tp) for tp in every])
    return rows.where(F.lower(text).rlike(_telling())).where(F.exists(F.array(F.array_intersect(known, pairs(words(F.regexp_replace(text, f"(?dm){MARKS}", ""))))), enough))


def _wrapped(rows: DataFrame) -> DataFrame:
    """(key, version, paragraph, last, line): runs of two and more lines of the rows, joined; no line within is blank, or a comment mark alone.

    A run goes on until the lines between its first and its last have as many words as the longest template.
    """
    longest = max(len(re.findall("[a-z0-9]+", t.lower())) for ts in TEMPLATES.values() for t in ts)
    lines = rows.select("key", "version", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", MARKS, "")).withColumn("n", F.size(F.filter(words(F.col("line")), lambda w: w != "")))
    of = W.partitionBy("key", "version").orderBy("paragraph")
    ahead = of.rowsBetween(0, longest + 1)  # a line has a word at least
    # a run that a template confirms has a telling word in one of its lines
    lines = lines.dropDuplicates(["key", "version", "paragraph"]).withColumn("tells", F.bool_or(F.lower("line").rlike(_telling())).over(ahead))
    lines = lines.withColumn("run", F.when(F.col("tells") & (F.col("n") > 0), F.collect_list(F.struct("line", "n")).over(ahead))).where("size(run) > 1")
    runs = lines.select("key", "version", "paragraph", "n", "run", F.explode(F.sequence(F.lit(2), F.size("run"))).alias("k")).withColumn("run", F.slice("run", 1, F.col("k")))
    total = F.aggregate("run", F.lit(0), lambda t, x: t + x["n"])
    runs = runs.where(~F.exists("run", lambda x: x["n"] == 0) & (total - F.col("n") - F.element_at("run", -1)["n"] < longest))
    return runs.select("key", "version", "paragraph", (F.col("paragraph") + F.col("k") - 1).alias("last"), F.array_join("run.line", "\n").alias("line"))


def license_paragraphs(documents: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The `keys` columns with paragraph, family, probability, template and coverage of every paragraph that holds a licence notice.

    Paragraphs are lines, counted from 0, and runs of lines without a blank one between them, as notices are wrapped, numbered by their first line;
    of runs only the shortest that hold a notice of a family count, those that overlap as one, and none around a line that holds it alone. Only texts
    that have COVERAGE of a template in all, with marks of comments (REM, dnl) taken off their lines, are cut into paragraphs, for no paragraph of
    another can have it, and of the paragraphs, too, only those that have it are classified: their n-grams (words and pairs of words) are counted and weighed by the fitted models. A family is reported if it is the likeliest, its probability reaches the calibrated
    least, and COVERAGE of the word pairs of one of its templates stands in the paragraph.
    Null and empty texts have no paragraphs; rows that are equal in keys and text give one result; an empty table an empty one.
    """
    spark = documents.sparkSession
    classes, counts, model, least = _fit(spark)
    rows = documents.where(F.col(text).isNotNull()).select(F.struct(*keys).alias("key"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    rows = saved(_candidates(rows), "candidates")
    family = F.element_at(F.array(*map(F.lit, classes)), F.col("_class").cast("int") + 1)
    notices = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, template string")
    notices = F.broadcast(notices.withColumn("tp", F.array_distinct(pairs(F.filter(words(F.col("template")), lambda w: w != "")))))

    def confirmed(lines: DataFrame) -> DataFrame:
        scored = model.transform(counts.transform(lines.withColumn("_ngrams", ngrams(F.col("line")))))
        likely = scored.select("key", "version", "paragraph", "last", "line", family.alias("family"), F.array_max(vector_to_array("_chances")).alias("probability"))
        likely = likely.where((F.col("family") != UNKNOWN) & (F.col("probability") >= least))
        met = likely.join(notices, "family").withColumn("coverage", F.size(F.array_intersect("tp", pairs(words(F.col("line"))))) / F.size("tp"))
        return met.where(F.col("coverage") >= COVERAGE).select("key", "version", "paragraph", "last", "family", F.struct("coverage", F.length("template"), "template", "family", "probability").alias("b"))

    lines = rows.select("key", "version", F.posexplode(F.split("text", "\n")).alias("paragraph", "line")).withColumn("last", F.col("paragraph"))
    # saved, so that a paragraph is formed once and not again in each expression that reads it
    paragraphs = saved(lines.unionByName(_wrapped(rows)), "paragraphs")
    found = confirmed(saved(_candidates(paragraphs, "line"), "chosen")).groupBy("key", "version", "family", "paragraph", "last").agg(F.max("b").alias("b"))
    of = W.partitionBy("key", "version", "family")
    within = F.min("last").over(of.orderBy(F.desc("paragraph"), "last").rowsBetween(W.unboundedPreceding, -1))
    found = found.withColumn("within", within).where("within is null or within > last")
    found = found.withColumn("new", F.coalesce(F.lag("last").over(of.orderBy("paragraph")) < F.col("paragraph"), F.lit(True)).cast("int"))
    found = found.withColumn("notice", F.sum("new").over(of.orderBy("paragraph")))
    found = found.groupBy("key", "version", "family", "notice").agg(F.min("paragraph").alias("paragraph"), F.max("b").alias("b"))
    best = found.groupBy("key", "paragraph", "family").agg(F.max("b").alias("b"))
    return best.select("key.*", "paragraph", "b.family", "b.probability", "b.template", "b.coverage")


def scan(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, licences, n_notices, probability) of every row: families found, sorted and joined by commas (none: empty), paragraphs that hold
    a notice, and the least probability among them (none: null). Null ids and repeated rows keep rows of their own."""
    rows = documents.select(F.col(id).alias("id"), F.xxhash64(F.col(id), F.col(text)).alias("row"), F.col(text).alias("text"))
    found = license_paragraphs(rows, ["row"]).groupBy("row").agg(F.array_join(F.sort_array(F.collect_set("family")), ",").alias("licences"), F.count("*").alias("n"), F.min("probability").alias("probability"))
    return rows.select("id", "row").join(found, "row", "left").select(F.col("id").alias(id), F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n", F.lit(0)).alias("n_notices"), "probability")
