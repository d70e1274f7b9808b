"""Licence scan: sparse TF-IDF cosine to templates, then inheritance by directory.

Every line of a file that holds a template term is a sparse vector of its terms
(``[a-z0-9.-]+`` of the lower-cased line, dots and hyphens trimmed), weighted
``tf * (1 + ln((1 + lines) / (1 + occurrences of lines with the term)))``; the counts cover all
lines of all files that hold any term. A line has the licence of the
template with the largest cosine when that reaches ``THRESHOLD``; a file has the
licence of its best line (ties: first name). A file without one inherits from
the nearest ancestor directory whose licence file (base name LICENSE, LICENCE or
COPYING, any extension) has one.

No line is left out by its wording: a first pass counts the lines with each template
term, and a line is scored when the weight of a template that it holds can reach the
threshold at all (the cosine is at most the root of that share). Vectors of those
lines meet templates by an equi-join on terms, aggregated before the shuffle; templates
and their term weights are small, bounded tables, and other terms are counted over
all lines only if such a line holds them. Directories are resolved
once each: every directory that holds files lists its ancestors,
meets the licensed directories by path and keeps the nearest.

Defined results: null or empty texts have no lines, null paths no directory; both
can still be listed without licence. Repeated rows: a path given several times
is one file with all its lines, and each row gets its result. Extra columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bloom_split, stored

TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This work is subject to the terms of the Mozilla Public License, version 2.0.",
}
THRESHOLD = 0.8
#: Of the bound on the cosine: far above the error of its sums.
SLACK = 1e-6
LICENCE_FILE = r"(?i)^(licen[sc]e|copying)(\.[^.]*)?$"


def terms(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9.-]+)"), 1)
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"^[.-]+|[.-]+$", "")), lambda x: x != "")


def _lines(files: DataFrame) -> DataFrame:
    """(path, line) of every distinct line; a row's equal lines count once."""
    return files.where("text is not null").select("path", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))


def _line_counts(lines: DataFrame, found: Column) -> DataFrame:
    """(term, df) of the array ``found`` of each line's distinct terms."""
    return lines.select(F.explode(found).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def own_licences(files: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(path, licence, cosine) of files with a line like a template."""
    spark: SparkSession = files.sparkSession
    templates = TEMPLATES if templates is None else templates
    known = spark.createDataFrame(sorted(templates.items()), "licence string, text string").select(
        "licence", F.explode(terms(F.col("text"))).alias("term")).groupBy("licence", "term").agg(F.count(F.lit(1)).alias("k")).collect()
    every = _lines(files)
    wanted = F.array(*[F.lit(t) for t in sorted({r.term for r in known})]).cast("array<string>")
    held = terms(F.col("line"))
    # the empty term stands for the line itself
    met = {r.term: r.df for r in _line_counts(every, F.when(F.size(held) > 0, F.concat(F.array_intersect(held, wanted), F.array(F.lit(""))))).collect()}
    total = met.pop("", 0)
    weight = {r.term: math.log((1.0 + total) / (1 + met.get(r.term, 0))) + 1 for r in known}
    t = [(r.licence, r.term, r.k * weight[r.term]) for r in known]
    norm: dict[str, float] = {}
    for licence, _, w in t:
        norm[licence] = norm.get(licence, 0.0) + w * w
    least = max(0.0, threshold - SLACK) ** 2

    def reachable(hits: Column) -> Column:
        out = F.lit(False)
        for licence, n in norm.items():
            out = out | (sum((F.when(F.array_contains(hits, term), w * w).otherwise(0.0) for k, term, w in t if k == licence), F.lit(0.0)) >= least * n)
        return out

    # equal lines of many files are one vector: counted by number, scored once
    lines = stored(every.where(F.exists(F.array(F.array_intersect(held, wanted)), lambda hits: (F.size(hits) > 0) & reachable(hits))))
    kinds = lines.select("line").distinct()
    vectors = kinds.select("line", F.explode(held).alias("term")).groupBy("line", "term").agg(F.count(F.lit(1)).alias("tf"))
    counts = spark.createDataFrame(sorted((term, met.get(term, 0)) for term in weight), "term string, df bigint")
    others = stored(vectors.select("term").distinct().where(~F.array_contains(wanted, F.col("term"))))
    if not others.isEmpty():
        may, _ = bloom_split(every.select(F.explode(F.array_except(held, wanted)).alias("term")), "term", others)
        counts = counts.union(others.join(may.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term"))
    all_weights = counts.select("term", (F.log((1.0 + total) / (1 + F.col("df"))) + 1).alias("idf"))
    t = spark.createDataFrame(t, "licence string, term string, tw double")
    t_norm = t.groupBy("licence").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn"))
    v = vectors.join(all_weights, "term").select("line", "term", (F.col("tf") * F.col("idf")).alias("w"))
    v_norm = v.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("ln"))
    dots = v.join(F.broadcast(t), "term").groupBy("line", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("ln") * F.col("tn")), 9)
    scored = dots.join(F.broadcast(t_norm), "licence").join(v_norm, "line").select("line", "licence", cosine.alias("cosine")).where(F.col("cosine") >= threshold)
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b")
    of_line = scored.groupBy("line").agg(best).select("line", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))
    return lines.join(of_line, "line").groupBy("path").agg(best).select("path", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))


def directory(path: Column) -> Column:
    """Directory of a path, '' for the root; null for a null path."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/$", "")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: dict[str, str] | None = None,
         threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, licence, cosine, origin ('own', 'inherited' or null), from_dir: one row a row of ``files``.

    ``keep`` names further columns of ``files`` to carry along.
    """
    extra = [c for c in keep if c not in ("path", "licence", "cosine", "origin", "from_dir")]
    base = files.select(*[F.col(f"`{c}`") for c in extra], F.col(f"`{path_col}`").cast("string").alias("path"), F.col(f"`{text_col}`").cast("string").alias("text"))
    own = own_licences(base.where("path is not null"), templates, threshold)
    name = F.regexp_extract("path", r"[^/]*$", 0)
    licensed = own.where(name.rlike(LICENCE_FILE)).select(directory(F.col("path")).alias("dir"), "licence", "path").groupBy("dir").agg(
        F.min_by("licence", "path").alias("licence"))
    places = base.where("path is not null").select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = F.explode(F.when(F.col("dir") == "", F.array(F.struct(F.lit("").alias("up"), F.lit(0).alias("depth")))).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("up"), k.alias("depth"))))).alias("a")
    near = places.select("dir", above).select("dir", "a.up", "a.depth").join(licensed.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(
        F.max_by(F.struct("up", "licence"), "depth").alias("near")).select("dir", F.col("near.up").alias("from_dir"), F.col("near.licence").alias("dir_licence"))
    return (base.select(*extra, "path", directory(F.col("path")).alias("dir")).join(own, "path", "left").join(near, "dir", "left").select(
        *extra, "path", F.coalesce("licence", "dir_licence").alias("licence"), "cosine",
        F.when(F.col("licence").isNotNull(), "own").when(F.col("dir_licence").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("licence").isNull(), F.col("from_dir")).alias("from_dir")))
