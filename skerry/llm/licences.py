"""License scans: sparse TF-IDF cosine of lines, runs of lines and whole texts to templates, then inheritance from the nearest ancestor
directory by path joins. DataFrame functions only.

Weights: term frequency times ln((T + 1) / (df + 1)) + 1 over the T templates; a term of no template has df 0. A text
can only reach the threshold if it has one of a template's necessary terms: those that remain when terms are left out,
most frequent in the corpus first, while the squared weights left out stay below threshold**2 of the template's. Lines
and runs without any are skipped, which loses nothing.

A run of lines is as long as a text can be that reaches the threshold and has no term of a template more often than the
template has it: the others' squared weights must stay below (1 / threshold**2 - 1) of the template's. A run that starts
or ends with a line without a template's term is skipped: without that line its cosine is greater.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, stored

#: Names, notice texts and tags of widely used licences; a caller may give a table of others, full texts too.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("Apache-2.0", "BSD-3-Clause", "CC-BY-4.0", "GPL-3.0", "ISC", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")),
]
#: Names of licence files.
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|copyright)(\.[a-z]+)?$"
#: About how many templates are looked for at a time; more are dealt into blocks by hash, each with a pattern and a pass of its own.
TEMPLATES_A_PASS = 5000


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: t != "")


def _runs(hit: DataFrame, pattern: str, known: list[str], most: int) -> DataFrame:
    """(row, line, last, u): each run of two or more consecutive lines, blank ones left out, with at most `most` terms,
    one of them necessary, whose first and last lines have terms of a template."""
    lines = hit.select("row", F.posexplode(F.split("text", "\n")).alias("line", "u")).withColumn("terms", _terms(F.col("u")))
    lines = lines.withColumns({"n": F.size("terms"), "edge": F.arrays_overlap("terms", F.array(*[F.lit(k) for k in known])), "needed": F.col("u").rlike(pattern)}).where("n > 0")
    lines = lines.withColumn("end", F.sum("n").over(Window.partitionBy("row").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.select("row", "line", "edge", "needed", (F.col("end") - F.col("n")).alias("at"), "end", F.when(F.col("n") <= most, F.array_join("terms", " ")).alias("u"))
    by = Window.partitionBy("row").orderBy("at")
    lines = lines.withColumn("close", F.max("needed").over(by.rangeBetween(-most, most))).where("close and u is not null")
    ahead = F.collect_list(F.struct("line", "edge", "needed", "at", "end", "u")).over(by.rangeBetween(0, most - 1))
    starts = lines.withColumn("ahead", ahead).where(F.col("edge") & (F.size("ahead") > 1)).select("row", "line", "at", "ahead")
    runs = starts.select("row", "line", "at", F.explode(F.sequence(F.lit(2), F.size("ahead"))).alias("m"), "ahead").withColumn("stop", F.element_at("ahead", F.col("m")))
    runs = runs.where((F.col("stop.end") - F.col("at") <= most) & F.col("stop.edge")).withColumn("run", F.slice("ahead", F.lit(1), F.col("m")))
    whole = F.aggregate("run", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["at"]) == F.col("stop.end") - F.col("at")
    return runs.where(F.exists("run", lambda x: x["needed"]) & whole).select("row", "line", F.col("stop.line").alias("last"), F.array_join(F.transform("run", lambda x: x["u"]), " ").alias("u"))


def _close(base: DataFrame, ranked: DataFrame, terms: DataFrame, unseen: Column, least: float, threshold: float) -> DataFrame:
    """(row, line, licence, cosine): units that reach the threshold for one of the templates of ranked. terms: all templates' idf."""
    left = Window.partitionBy("t").orderBy(F.desc("count"), "term").rowsBetween(Window.unboundedPreceding, 0)
    square = F.col("w") * F.col("w")
    weighed = ranked.withColumns({"out": F.sum(square).over(left), "all": F.sum(square).over(Window.partitionBy("t"))})
    needed = sorted(r[0] for r in weighed.where(F.col("out") >= F.lit(threshold**2 - 1e-9) * F.col("all")).select("term").distinct().collect())
    pattern = r"(?i)(?<![a-z0-9])(" + "|".join(needed) + r")(?![a-z0-9])" if needed else "(?!)"
    hit = stored(base.where(F.col("text").rlike(pattern)).select("row", "text").dropDuplicates(["row"]), "hit")
    squares = ranked.groupBy("t").agg(F.sum("tf").alias("n"), F.sum(square).alias("sq"))
    most = squares.agg(F.max(F.col("n") + F.floor((1 / threshold**2 - 1) * F.col("sq") / (least * least)))).first()[0] or 0
    known = sorted(r[0] for r in ranked.select("term").distinct().collect())
    units = F.concat(F.array(F.struct(F.lit(-1).alias("line"), F.lit(-1).alias("last"), F.col("text").alias("u"))), F.transform(F.split("text", "\n"), lambda u, i: F.struct(i.alias("line"), i.alias("last"), u.alias("u"))))
    lines = hit.select("row", F.explode(units).alias("x")).select("row", "x.line", "x.last", "x.u").where(F.col("u").rlike(pattern))
    lines = lines.unionByName(_runs(hit, pattern, known, most))
    tf = lines.select("row", "line", "last", F.explode(_terms(F.col("u"))).alias("term")).groupBy("row", "line", "last", "term").agg(F.count("*").alias("n"))
    own = ranked.groupBy("term").agg(F.collect_list(F.struct("licence", "t", "w")).alias("in"))
    per_term = stored(terms.join(own, "term", "left"), "terms")
    tf = tf.join(small_side(per_term), "term", "left").withColumn("v", F.col("n") * F.coalesce("idf", unseen))
    tf = stored(tf.select("row", "line", "last", "v", "in"), "terms")
    norms = tf.groupBy("row", "line", "last").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dots = tf.select("row", "line", "last", "v", F.explode("in").alias("x")).groupBy("row", "line", "last", "x.licence", "x.t").agg(F.sum(F.col("v") * F.col("x.w")).alias("dot"))
    lengths = stored(squares.select("t", F.sqrt("sq").alias("length")), "lengths")
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("length")), 9)
    met = dots.join(norms, ["row", "line", "last"]).join(small_side(lengths), "t")
    return met.select("row", "line", "licence", cosine.alias("cosine")).where(F.col("cosine") >= threshold)


def scan(files: DataFrame, path: Column, templates: DataFrame | None = None, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of files: id, path, licence, how (`file`: its whole text or, in a file named as a licence, a line is
    or a run of lines is one; `line`: such a line or run elsewhere; `inherited`), cosine, from_dir.

    The best licence has the greatest cosine, ties by name. Every line, every run of consecutive lines up to
    the length told above, and the whole text count. A row without one of
    its own inherits that of the licence file in the nearest directory at or above its own (ties: greatest cosine, then
    path); otherwise licence is null. A null text has no terms, a null path no directory. Repeated rows get the same
    result each; equal (id, path, text) count as one licence file.
    """
    spark = files.sparkSession
    if templates is None:
        templates = spark.createDataFrame(TEMPLATES, "licence string, text string")
    templates = stored(templates.select("licence", F.xxhash64("licence", "text").alias("t"), F.explode(_terms(F.col("text"))).alias("term")).groupBy("licence", "t", "term").agg(F.count("*").alias("tf")), "templates")
    size = templates.select("t").distinct().count()
    df = templates.groupBy("term").agg(F.countDistinct("t").alias("df"))
    unseen = F.log(F.lit(float(size + 1))) + 1
    idf = F.log(F.lit(float(size + 1)) / (F.col("df") + 1)) + 1
    weighed = stored(templates.join(df, "term").withColumn("idf", idf).withColumn("w", F.col("tf") * F.col("idf")), "weights")
    base = files.select(F.col(id_col).alias("id"), path.cast("string").alias("path"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.xxhash64("id", "path", "text"))
    terms = stored(weighed.select("term", "idf").distinct(), "idf")
    spoken = base.select(F.explode(F.array_distinct(_terms(F.coalesce("text", F.lit(""))))).alias("term")).join(small_side(terms.select("term")), "term", "left_semi").groupBy("term").count()
    least = weighed.agg(F.min("idf")).first()[0] or 1.0
    ranked = stored(weighed.join(spoken, "term", "left").withColumn("count", F.coalesce("count", F.lit(0))), "spoken")
    passes = max(1, -(-size // TEMPLATES_A_PASS))
    blocks = [_close(base, ranked.where(F.pmod("t", F.lit(passes)) == i), terms, unseen, least, threshold) for i in range(passes)]
    close = reduce(DataFrame.unionByName, blocks)
    by_name = close.groupBy("row", "licence").agg(F.min(-F.col("cosine")).alias("far"), F.max(F.col("line") < 0).alias("whole"))
    own = by_name.groupBy("row").agg(F.min(F.struct("far", "licence", "whole")).alias("x"))
    own = stored(own.select("row", "x.licence", (-F.col("x.far")).alias("cosine"), "x.whole"), "own")
    side = small_side(own)
    rows = base.select("id", "path", "row", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir")).join(side, "row", "left")
    as_file = F.col("licence").isNotNull() & (F.col("whole") | F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False)))
    given = rows.where(as_file & F.col("path").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("far"), "path", "licence")).alias("g")).select("dir", "g.licence", (-F.col("g.far")).alias("cosine"))
    given = stored(given, "given")
    dirs = rows.where("licence is null and path is not null").select("dir").distinct().withColumn("parts", F.split("dir", "/"))
    above = dirs.select(F.col("dir").alias("of"), F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"), "parts").withColumn("dir", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/"))
    nearest = above.join(small_side(given), "dir").groupBy("of").agg(F.max_by(F.struct("licence", "cosine", "dir"), "depth").alias("n"))
    nearest = small_side(stored(nearest.select(F.col("of").alias("dir"), "n"), "nearest"))
    out = rows.join(nearest, "dir", "left")
    how = F.when(as_file, "file").when(F.col("licence").isNotNull(), "line").when(F.col("n").isNotNull() & F.col("path").isNotNull(), "inherited")
    inherited = how == "inherited"
    return out.select(
        F.col("id").alias(id_col), "path", F.coalesce("licence", F.when(inherited, F.col("n.licence"))).alias("licence"), how.alias("how"),
        F.coalesce("cosine", F.when(inherited, F.col("n.cosine"))).alias("cosine"), F.when(inherited, F.col("n.dir")).when(as_file, F.col("dir")).alias("from_dir"),
    )
