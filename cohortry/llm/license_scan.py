"""License notices in texts, by MinHash bands over overlapping windows, in DataFrame operations.

A text is cut into words (runs of letters and digits, lower case) and these into
overlapping windows of ``WINDOW`` shingles of five words, one every ``STEP``. A window has
one key per band: the least of its shingle hashes under that band's permutation (one row
per band). Templates are cut into windows in the same way, at every place, and their
keys are literal sets: a window that shares a key with a template is retrieved. Then the
shingles of the retrieved windows are compared exactly with those of the templates:
a template is found where at least 0.8 of its shingles occur.

Retrieval is close to certain. A window that shares ``k`` of ``n`` shingles, with a
template window inside it, misses a band with probability at most 1 - k/n. The worst
case is a template of one shingle in unrelated text: two windows of four hold it, and
both miss all 24 bands with probability (2/3)^24 = 6e-5. A template's run of four
shingles or more always fills a whole window, which then has all keys in common.

All is one pass without a shuffle until the retrieved windows, which are few. The
templates are parameters of the query and do not grow with the data; their shingles are
literals or a broadcast of at most ``MAX_TEMPLATE_SHINGLES`` rows.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.registry import documents, query

SHINGLE, WINDOW, STEP, BANDS, SHARE = 5, 4, 2, 24, 0.8
MAX_TEMPLATE_SHINGLES = 100_000
#: Notices by which licenses are commonly granted in a text.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 terms": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL terms": "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT terms": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA terms": "This work is licensed under a Creative Commons Attribution-ShareAlike International License",
}
RESULT = ["license", "containment", "shingles_found", "first_word", "last_word"]


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def permutations() -> list[int]:
    """A fixed 64-bit number per band; hash XOR number orders the hashes anew."""
    return np.random.default_rng(7).integers(-2**63, 2**63, BANDS).tolist()


def word_hashes(text):
    """Hashes of the words of a text column, in order; none for null."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}\p{M}]+", " "))
    return F.when(F.length(spaced) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.split(spaced, " "), lambda w: F.xxhash64(w)))


def windows(hashed: DataFrame, step: int) -> DataFrame:
    """One row per window: ``_at``, its first word, ``_n``, its shingles, and their hashes ``_s0`` to ``_s3``.

    Past the end of the text the first shingle is repeated, which changes no minimum. So no
    hash is null, which keeps the code that Spark generates for the keys small enough to be compiled.
    The shingles are made inside the generator, so that no filter above it hashes them anew.
    """
    n = F.size("_words") - SHINGLE + 1

    def shingle(at):
        return F.xxhash64(*[F.get("_words", at + j) for j in range(SHINGLE)])

    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step)))
    cut = hashed.select("*", F.explode(F.transform(starts, lambda i: F.struct(
        i.alias("at"), F.least(F.lit(WINDOW), n - i).alias("n"),
        *[F.when(i + k < n, shingle(i + k)).otherwise(shingle(i)).alias(f"s{k}") for k in range(WINDOW)]))).alias("_cut"))
    return cut.select(*[c for c in cut.columns if c not in ("_words", "_cut")], F.col("_cut.at").alias("_at"), F.col("_cut.n").alias("_n"),
                      *[F.col(f"_cut.s{k}").alias(f"_s{k}") for k in range(WINDOW)])


def keys() -> list:
    """The band keys of a window row."""
    return [F.least(*[F.col(f"_s{k}").bitwiseXOR(F.lit(p)) for k in range(WINDOW)]) for p in permutations()]


def template_tables(spark: SparkSession, templates: dict[str, str]) -> tuple[DataFrame, list[list[int]]]:
    """(license, shingle, needed) of all templates, and per band the set of their window keys."""
    for name, text in templates.items():
        if len(words_of(text)) < SHINGLE:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
    if sum(len(words_of(t)) for t in templates.values()) > MAX_TEMPLATE_SHINGLES:
        raise ValueError("too many templates for a broadcast")
    rows = spark.createDataFrame(list(templates.items()), "license string, text string")
    cut = windows(rows.select("license", word_hashes(F.col("text")).alias("_words")), 1)
    shingles = cut.groupBy("license").agg(F.collect_set("_s0").alias("s"))
    shingles = shingles.select("license", F.explode("s").alias("_shingle"), F.size("s").alias("_needed"))
    found = cut.select(*[k.alias(f"k{i}") for i, k in enumerate(keys())]).collect()
    return shingles, [sorted({r[i] for r in found}) for i in range(BANDS)]


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, share: float = SHARE,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs`` and template found in it.

    Columns: those of ``docs`` but the text (one with a name of the result is replaced),
    ``license``, ``containment`` (share of the template's shingles in the text),
    ``shingles_found``, and ``first_word`` and ``last_word``, between which they lie
    (counted from 0). Null, empty and very short texts have no shingles and no row.
    Repeated rows are reported each; an empty table gives an empty result. Words that
    differ in case or punctuation are equal. Texts are read whole.
    """
    spark = docs.sparkSession
    shingles, band_keys = template_tables(spark, TEMPLATES if templates is None else templates)
    own = [c for c in docs.columns if c not in [*RESULT, text]]
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("_own")
    cut = windows(docs.select(F.monotonically_increasing_id().alias("_row"), row, word_hashes(F.col(text)).alias("_words")), STEP)
    retrieved = cut.filter(reduce(or_, [k.isin(s) for k, s in zip(keys(), band_keys, strict=True)]))
    places = retrieved.select("_row", "_own", F.explode(F.array(*[
        F.struct(F.when(F.col("_n") > k, F.col("_at") + k).otherwise(F.col("_at")).alias("at"), F.col(f"_s{k}").alias("s"))
        for k in range(WINDOW)])).alias("_p"))
    matched = places.select("_row", "_own", F.col("_p.at").alias("_at"), F.col("_p.s").alias("_shingle")).join(
        F.broadcast(shingles), "_shingle")
    # Places of one row and template: first one per shingle, then one for all.
    each = matched.groupBy("_row", "license", "_shingle").agg(
        F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.first("_own").alias("_own"), F.first("_needed").alias("_needed"))
    found = each.groupBy("_row", "license").agg(
        F.count("*").alias("shingles_found"), F.first("_needed").alias("_needed"), F.min("_first").alias("first_word"),
        (F.max("_last") + SHINGLE - 1).alias("last_word"), F.first("_own").alias("_own"))
    return found.filter(F.col("shingles_found") >= share * F.col("_needed")).select(
        *[F.col(f"_own.`{c}`").alias(c) for c in own], "license", (F.col("shingles_found") / F.col("_needed")).alias("containment"),
        "shingles_found", F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"))


def oracle() -> str:
    """The same by comparing every shingle of every document with every template's."""
    templates = ", ".join("('" + n + "', '" + " ".join(words_of(t)) + "')" for n, t in TEMPLATES.items())
    return rf"""
WITH texts AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{Nd}}\p{{M}}]+', ' ', 'g')), ' ') AS w FROM documents),
s AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM texts)),
t AS (SELECT DISTINCT license, array_to_string(w[i:i + 4], ' ') AS shingle FROM
  (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT license, string_split(x, ' ') AS w FROM (VALUES {templates}) v(license, x)))),
n AS (SELECT license, count(*) AS needed FROM t GROUP BY license),
f AS (SELECT doc_id, license, count(DISTINCT shingle) AS found, min(pos) AS first_word, max(pos) + 4 AS last_word FROM s JOIN t USING (shingle) GROUP BY doc_id, license)
SELECT doc_id, license, found / needed AS containment, found AS shingles_found, first_word, last_word
FROM f JOIN n USING (license) WHERE found >= 0.8 * needed"""


@query("op4_license_scan", oracle())
def _(spark, d):
    return license_scan(documents(spark, d).select("doc_id", "text"))
