"""License scans by MinHash bands over overlapping windows, in DataFrame functions only.

Texts become lower-case words of letters and digits and their shingles of
``SHINGLE`` words.  Windows of ``WIDTH`` shingles, each half a window further,
cover every document, the first one half before its start, so that every
shingle lies in two; template texts are cut the same way from their start on.  Each window has
``BANDS`` MinHash values and each value is a band of its own: windows whose
sets have Jaccard similarity J meet in a band with probability
1 - (1 - J) ** BANDS.  A short template lies whole in one of a document's
windows, and each full window of a longer one shares at least half of its
shingles with some window of a copy.  So J is at least 1/3 for long templates,
3/16 for one of three shingles and 1/16 for one of a single shingle, which
lies in two windows wherever it stands: it is missed with probability 0.0003,
the others with less than 0.000002.  Retrieved pairs are verified: the exact share of the
template's shingles that lie in one stretch of the document, at most as long
as the template and a window on either side, must reach ``MIN_SHARE``.

Windows without any shingle of any template cannot meet one in a band, so
only the others are signed; this leaves out no candidate.  Templates'
shingles are known by a bitmap of fixed size (a shingle that is taken for one
of them costs a signature).

A null text is empty and has no license; an empty table gives no rows.  Texts with fewer words than a
shingle match nothing.  Rows with equal doc_id (null included) and text count
as one document.  Of equal best places the first is reported.  Long texts are
scanned whole.  Extra columns are dropped at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small

SHINGLE, WIDTH, BANDS, MIN_SHARE = 3, 16, 64, 0.8
STEP = WIDTH // 2

# License notices as they are published.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "MIT": "Released under the MIT License",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "GPL": "This work is licensed under the GNU General Public License, version 3",
    "GPL-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "all-rights-reserved": "All rights reserved",
}


#: Leading bits of a hash in the bitmap of the templates' shingles (128 KB).
KNOWN_BITS = 20
#: Templates are a few hundred lines at most; beyond so many band rows they are joined by shuffle.
BROADCAST_BANDS = 500_000


def shingled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and s, the hashes of the text's runs of ``SHINGLE`` words in order (none below ``SHINGLE`` words)."""
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{Nd}]+", " ")
    hashed = rows.select(*keys, F.transform(F.filter(F.split(plain, " "), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("h"))
    # no filter on a computed array: the optimiser would push it down and compute the array again in each lambda call
    return hashed.select(*keys, F.when(F.size("h") >= SHINGLE, F.transform(
        F.sequence(F.lit(0), F.size("h") - SHINGLE),
        lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>")).alias("s"))


def bands(part: Column) -> Column:
    """The band keys of a window's shingles: each MinHash value with its number."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.xxhash64(
        b, F.array_min(F.transform(part, lambda x: F.xxhash64(x, b)))))


def covered(shingles: Column | str, k: Column) -> Column:
    """The shingles of window ``k``; window -1 is the half that lies in the text."""
    start = k * STEP
    return F.slice(shingles, F.greatest(start, F.lit(0)) + 1, F.lit(WIDTH) + F.least(start, F.lit(0)))


def known_bits(hashes: list[int]) -> Column:
    """The bitmap as one array of 64-bit numbers."""
    words = [0] * (1 << KNOWN_BITS - 6)
    for x in hashes:
        at = (x & (1 << 64) - 1) >> 64 - KNOWN_BITS
        words[at >> 6] |= 1 << (at & 63)
    return F.split(F.lit(",".join(str(w - (1 << 64) if w >> 63 else w) for w in words)), ",").cast("array<bigint>")


def may_be_known(x: Column, bits: Column) -> Column:
    at = F.shiftrightunsigned(x, 64 - KNOWN_BITS)
    return F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1


def window_numbers(size: Column) -> Column:
    """0 to the last window that begins inside, the first one always."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((size - 1 - STEP) / STEP).cast("int")))


def template_rows(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, t (distinct shingles), n (shingles in order), s: one row per template of ``SHINGLE`` words or more."""
    rows = spark.createDataFrame(list(templates.items()), "license string, text string")
    return shingled(rows, ["license"]).select("license", F.array_distinct("s").alias("t"), F.size("s").alias("n"), "s").where("n > 0")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, text_hash, license, share and place (word number) of every license found, at its best place."""
    spark = docs.sparkSession
    table = template_rows(spark, templates)
    known = known_bits([r.x for r in table.select(F.explode("t").alias("x")).distinct().collect()])  # as many as the templates' words
    longest = max((len(t.split()) for t in templates.values()), default=0)
    sought = small(table.select("license", "t", "n", F.explode(window_numbers(F.size("s"))).alias("k"), "s")
                   .select("license", "t", "n", F.explode(bands(F.slice("s", F.col("k") * STEP + 1, F.lit(WIDTH)))).alias("band")),
                   BROADCAST_BANDS)

    keys = ["doc_id", "text_hash"]
    rows = shingled(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text"), keys)
    # places of shingles that some template has; most documents have none and end here
    held = rows.select(*keys, "s", F.filter(F.transform("s", lambda x, i: F.when(may_be_known(x, known), i)), lambda i: i.isNotNull()).alias("hits"))
    near = held.select(*keys, "s", F.explode_outer(F.array_distinct(F.flatten(F.transform("hits", lambda i: F.array(
        F.floor(i / STEP).cast("int") - 1, F.floor(i / STEP).cast("int")))))).alias("k")).where("k IS NOT NULL")
    start = F.greatest(F.lit(0), F.col("k") * STEP - longest)
    around = near.select(*keys, "k", start.alias("first"), F.slice("s", start + 1, F.lit(WIDTH + 2 * longest)).alias("part"),
                         bands(covered("s", F.col("k"))).alias("bands"))
    met = around.select(*keys, "k", "first", "part", F.explode_outer("bands").alias("band")).join(sought, "band")
    begin = F.greatest(F.lit(0), F.col("k") * STEP - F.col("n"))
    stretch = met.select(*keys, "license", "t", begin.alias("begin"),
                         F.slice("part", begin - F.col("first") + 1, F.lit(WIDTH) + 2 * F.col("n")).alias("part"))
    checked = stretch.select(*keys, "license", (F.size(F.array_intersect("part", "t")) / F.size("t")).alias("share"),
                             (F.col("begin") + F.array_min(F.filter(F.transform("part", lambda x, i: F.when(F.array_contains("t", x), i)),
                                                                    lambda i: i.isNotNull()))).alias("place")).where(F.col("share") >= min_share)
    best = checked.groupBy(*keys, "license").agg(F.max(F.struct("share", (-F.col("place")).alias("back"))).alias("best"))
    return best.select(*keys, "license", "best.share", (-F.col("best.back")).alias("place"))
