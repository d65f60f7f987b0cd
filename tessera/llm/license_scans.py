"""Licence scans: sparse TF-IDF cosine of header lines and licence files to templates, then inheritance from the nearest directory above.

DataFrame functions only. A file's own licence is that of the template nearest to one of its lines, or to all its text if it is a licence file;
a file without one takes over that of the licence file in its directory, or in the nearest directory above that has one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carry, restore, stored
from .decontamination import let

MAX_TERMS, BUCKETS, SCALE = 20_000, 8192, 10_000
#: Licence and the wording of its notices (fixed values).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 terms and conditions for use, reproduction, and distribution"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
TERM_GAP = "[^a-z0-9]+"


def terms(text: Column) -> Column:
    """The terms of a text: runs of a-z, A-Z (lower-cased) and 0-9."""
    return F.split(F.regexp_replace(F.lower(text), "^[^a-z0-9]+|[^a-z0-9]+$", ""), TERM_GAP)


def plain_terms(text: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", text.lower())


def own_licences(files: DataFrame, templates: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    """``of_path, of_text, score, licence``: the best template of each file that has one; ``of_text`` is a hash of the text.

    Each term weighs by the share of files that have it, whether templates have it or not. A line goes on to the exact cosine only if an upper bound
    of it, from a table of fixed size by the terms' hashes, reaches the threshold; distinct lines are then scored once.
    """
    vectors = [(name, Counter(plain_terms(text))) for name, text in templates]
    vocabulary = sorted({t for _, v in vectors for t in v})
    if len(vocabulary) > MAX_TERMS:
        raise ValueError(f"templates hold at most {MAX_TERMS} terms")
    text = F.coalesce(F.col("text"), F.lit(""))
    total = files.count()
    # A term of one file needs no row, for each term of a line is in some file.
    counts = stored(files.select(F.explode(F.array_distinct(terms(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
                    .where((F.col("n") > 1) | F.col("term").isin(vocabulary)), "licence_terms")
    df = {r.term: r.n for r in counts.where(F.col("term").isin(vocabulary)).collect()}  # bounded by the templates
    log_total = math.log(total + 2)
    weigh = lambda n: math.log((total + 2) / (n + 1)) / log_total
    weight = {t: weigh(df.get(t, 0)) for t in vocabulary}
    rows = [(i, name, t, n * weight[t]) for i, (name, v) in enumerate(vectors) for t, n in v.items()]
    norms = Counter()
    for i, _, _, x in rows:
        norms[i] += x * x
    rows = [(name, i, t, x / math.sqrt(norms[i])) for i, name, t, x in rows if norms[i] > 0]
    spark = files.sparkSession

    # Upper bound: a line's product with a template is at most the sum over its words of weight times largest value in a template, and its
    # norm at least the root of the sum of squared weights; of all terms in a bucket the largest product and the smallest weight count.
    bucket = lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int")
    most, least = [0] * BUCKETS, [1] * BUCKETS
    for r in counts.groupBy(bucket("term").alias("b")).agg(F.max("n").alias("n")).collect():
        least[r.b] = r.n
    place = {r.term: r.b for r in spark.createDataFrame([(t,) for t in vocabulary], "term string").select("term", bucket("term").alias("b")).collect()}
    for _, _, t, value in rows:
        most[place[t]] = max(most[place[t]], math.ceil(SCALE * weight[t] * value) + 1)
    listed = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    products, squares = listed(most), listed([math.floor(SCALE * SCALE * weigh(n) ** 2) for n in least])
    added = lambda words, values: F.aggregate(words, F.lit(0).cast("long"), lambda acc, t: acc + F.get(values, bucket(t))).cast("double")
    enough = threshold * threshold * (1 - 1e-6)  # scores are rounded
    may_reach = lambda words: let(added(words, products), lambda x: (x > 0) & (x * x >= enough * added(words, squares)))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0)
    whole = F.when(F.col("is_licence_file"), F.array(text)).otherwise(F.array().cast("array<string>"))
    unit = files.select("path", F.xxhash64("text").alias("of_text"), F.explode(F.array_distinct(F.concat(lines, whole))).alias("line"))
    # Each of the long expressions stands once in the plan. Lines go into the joins by a hash of 128 bits.
    unit = unit.where(let(terms(F.col("line")), may_reach))
    unit = stored(unit.select("path", "of_text", F.unhex(F.md5("line")).alias("line_key"), "line"), "licence_lines")

    template = spark.createDataFrame(rows, "licence string, template int, term string, value double")
    term = (unit.groupBy("line_key").agg(F.first("line").alias("line")).select(F.col("line_key").alias("line"), F.explode(terms(F.col("line"))).alias("term"))
            .groupBy("line", "term").agg(F.count("*").alias("tf")).join(counts.select(F.col("term").alias("known"), "n"), F.col("term") == F.col("known"), "left")
            .withColumn("x", F.col("tf") * F.log((total + 2) / (F.coalesce("n", F.lit(1)) + 1)) / log_total).select("line", "term", "x"))
    norm = term.groupBy(F.col("line").alias("of_line")).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dot = term.join(template, "term").groupBy("line", "licence", "template").agg(F.sum(F.col("x") * F.col("value")).alias("dot"))
    cosine = dot.join(norm, F.col("line") == F.col("of_line")).withColumn("score", F.round(F.when(F.col("norm") > 0, F.col("dot") / F.col("norm")).otherwise(0.0), 9))
    best = (cosine.where(F.col("score") >= threshold).groupBy("line")
            .agg(F.min_by(F.struct("score", "licence"), F.struct((-F.col("score")).alias("s"), "licence")).alias("best")))
    return (unit.join(best.withColumnRenamed("line", "of_line"), F.col("line_key") == F.col("of_line"))
            .groupBy(F.col("path").alias("of_path"), "of_text")
            .agg(F.min_by("best", F.struct((-F.col("best.score")).alias("s"), "best.licence")).alias("best"))
            .select("of_path", "of_text", "best.score", "best.licence"))


def directory(path: Column) -> Column:
    """All before the last ``/``; the root is ''."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.6) -> DataFrame:
    """``files`` with ``own_licence``, ``score``, ``licence`` and ``inherited_from``; columns of those names are replaced.

    ``files`` has ``path`` (parts joined by ``/``), ``text`` and ``is_licence_file``. Of equal cosines the first licence in alphabetical order is taken, and of
    several licence files in one directory the one with the highest cosine, then the first path. ``licence`` is null where no directory above has one.
    Null and empty texts have no licence of their own and inherit; a null path neither gives nor inherits; a null flag is false. Repeated rows are
    judged alike, an empty table gives an empty result.

    Inheritance is worked out once per directory: its ancestors, at most as many as its depth, are joined with the directories that have a licence file.
    """
    given_columns = files.drop("own_licence", "score", "licence", "inherited_from")
    rows = carry(given_columns, "path", "text", "is_licence_file").withColumn("is_licence_file", F.coalesce("is_licence_file", F.lit(False)))
    own = stored(own_licences(rows, templates, threshold), "licence_own").select("of_path", "of_text", F.col("score"), F.col("licence").alias("own_licence"))
    # The hash is a column of its own, so that texts nobody asks for stay out of the shuffle.
    joined = rows.withColumn("in_folder", directory(F.col("path"))).withColumn("own_text", F.xxhash64("text")).join(
        own, F.col("path").eqNullSafe(F.col("of_path")) & (F.col("own_text") == F.col("of_text")), "left").drop("of_path", "of_text", "own_text")
    small = stored(joined.select("path", "in_folder", "is_licence_file", "own_licence", "score"), "licence_files")
    given = (small.where("is_licence_file and own_licence is not null and path is not null").groupBy(F.col("in_folder").alias("giver"))
             .agg(F.min_by("own_licence", F.struct((-F.col("score")).alias("s"), "path")).alias("given")))
    folders = small.where("path is not null").select("in_folder").distinct()
    parts = F.split("in_folder", "/")
    above = folders.select("in_folder", F.posexplode(F.concat(F.array(F.lit("")), F.when(F.length("in_folder") > 0, F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>")))).alias("depth", "giver"))
    nearest = above.join(given, "giver").groupBy(F.col("in_folder").alias("for_folder")).agg(
        F.max_by(F.struct("giver", "given"), "depth").alias("near"))
    out = joined.join(nearest, (F.col("in_folder") == F.col("for_folder")) & F.col("path").isNotNull(), "left")
    out = out.select(*rows.columns, "own_licence", "score", F.coalesce("own_licence", "near.given").alias("licence"),
                     F.when(F.col("own_licence").isNull(), F.col("near.giver")).alias("inherited_from"))
    return restore(out, given_columns, "path", "text", "is_licence_file", extra=("own_licence", "score", "licence", "inherited_from"))
