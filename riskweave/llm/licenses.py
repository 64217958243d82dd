"""License scans by MinHash bands over overlapping text windows (operator 7). DataFrame functions only.

Texts and templates are lower-cased and cut into words of letters and digits; shingles have five words (or
all of a shorter text) and are hashed once. Templates fall into classes by length: class W holds those of
more than W / 2 and up to W words, and its windows have 2 * W words, one every W words, so each stretch of
W words lies in one window whole. A window's signature is taken ``REPEATS`` times with different hashes:
the least hash of each of a class's bins, and each bin is a band of its own. Windows that share a band with
a template are candidates, and the template is found if the window contains at least ``percent`` of its
distinct shingles.

``bins`` chooses the bins of a class so that a window with just enough of a template's shingles shares a
band with it but for a probability of ``MISS``.

A template with the needed share of shingles present has one of its anchor words in the text: anchors are
chosen so that more than the rest of its shingles contain one. Texts without any anchor are passed over,
without loss; this is for catalogues of up to ``ANCHORED`` templates, larger ones stay in their table.

Defined results: a null or empty text has no license; equal rows are scanned each; a null doc_id stays
null; templates may be any table of (license, text), of which those without words match nothing.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import saved

SHINGLE, PERCENT, REPEATS, MISS, LEAST = 5, 80, 3, 1e-6, 8
#: Rows of template bands up to which they are broadcast; beyond, a shuffle join does it.
BROADCAST_BANDS = 1_000_000
#: Templates up to which the driver chooses anchor words; with more, every text is cut.
ANCHORED = 2_000

# fixed values: public license notices
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("agpl", "GNU Affero General Public License"),
    ("lgpl", "GNU Lesser General Public License"),
    ("gpl-2.0", "under the terms of the GNU General Public License version 2"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc0-1.0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
]


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES, "license string, text string")


def class_of(words: int) -> int:
    """The least power of two, at least ``LEAST``, that is not below a template's number of words."""
    w = LEAST
    while w < words:
        w *= 2
    return w


def bins(w: int, percent: int = PERCENT) -> int:
    """Bins of class ``w``: the least power of two from 64 at which the weakest match is missed with at most ``MISS``."""
    n, least = 2 * w - SHINGLE + 1, max(1, w // 2 + 1 - SHINGLE + 1)
    k = 64
    while True:
        hit = (1 - (1 - 1 / k) ** n) * k / n  # chance that a shingle is its bin's least among n
        if (1 - hit) ** (REPEATS * ceil(least * percent / 100)) <= MISS or k >= 1 << 20:
            return k
        k *= 2


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def windows(words: Column, w: int) -> Column:
    """The overlapping windows of class ``w``: 2 * w words, one every w words."""
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(words) / F.lit(w)).cast("int") - 2, F.lit(0)))
    return F.transform(steps, lambda s: F.slice(words, s * w + 1, 2 * w))


def shingle_hashes(words: Column) -> Column:
    """Distinct hashes of the shingles of a non-empty array of words."""
    n = F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " "))))


def band_keys(shingles: Column, k: int) -> Column:
    """The bands of a set of shingles: of each repetition, the least hash of each bin. A hash's high bits are its bin, so ascending order groups bins."""
    shift = 64 - (k.bit_length() - 1)

    def least(repetition: int) -> Column:
        hashes = F.array_sort(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(repetition))))
        # bound to a variable, so that the array is made once and not for each of its items
        return F.get(F.transform(F.array(hashes), lambda h: F.filter(h, lambda x, i: (i == 0) | (F.shiftrightunsigned(x, shift) != F.shiftrightunsigned(F.get(h, i - 1), shift)))), 0)

    return F.array_distinct(F.concat(*map(least, range(REPEATS))))


def anchors(texts: list[str], percent: int = PERCENT) -> list[str]:
    """Words, long ones first, of which every text with ``percent`` of a template's shingles holds at least one."""
    chosen: set[str] = set()
    for t in texts:
        words = [w for w in re.sub(r"[\W_]+", " ", t.lower()).split() if w]
        n = max(1, len(words) - SHINGLE + 1)
        grams = {tuple(words[i : i + SHINGLE]) for i in range(n)} if words else set()
        spare = len(grams) - ceil(len(grams) * percent / 100)
        covered = {g for g in grams if chosen & set(g)}
        while words and len(covered) <= spare:
            left = [g for g in grams if g not in covered]
            chosen.add(max({w for g in left for w in g}, key=lambda w: (len(w), sum(w in g for g in left), w)))
            covered = {g for g in grams if chosen & set(g)}
    return sorted(chosen)


def scan(docs: DataFrame, known: DataFrame | None = None, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_licenses, licenses (sorted, by comma) and coverage (of the best match) of each row."""
    spark = docs.sparkSession
    known = known if known is not None else templates(spark)
    few = [r.text for r in known.where("text is not null").select("text").limit(ANCHORED + 1).collect()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("text"))
    low = F.lower("text")
    likely = F.lit(len(few) > ANCHORED)
    for w in anchors(few, percent) if len(few) <= ANCHORED else ():
        likely = likely | F.contains(low, F.lit(w))
    words = rows.where(likely).select("doc_id", "key", word_list(F.col("text")).alias("w")).where("size(w) > 0")
    of = known.where("text is not null").select(F.col("license"), word_list(F.col("text")).alias("w")).where("size(w) > 0").withColumn("items", shingle_hashes(F.col("w")))
    found = None
    for w in sorted({class_of(r.n) for r in of.select(F.size("w").alias("n")).distinct().collect()}):  # lengths of templates, each once
        k = bins(w, percent)
        mine = of.where((F.size("w") <= w) & (F.size("w") > (w // 2 if w > LEAST else 0)))
        mine = mine.select("license", "items", F.explode(band_keys(F.col("items"), k)).alias("band"))
        mine = F.broadcast(mine) if mine.count() <= BROADCAST_BANDS else mine
        win = words.select("doc_id", "key", F.explode(windows(F.col("w"), w)).alias("v")).select("doc_id", "key", shingle_hashes(F.col("v")).alias("v"))
        near = win.select("doc_id", "key", "v", F.explode(band_keys(F.col("v"), k)).alias("band")).join(mine, "band")
        share = F.size(F.array_intersect("v", "items")) / F.size("items")
        hits = near.select("doc_id", "key", "license", share.alias("coverage")).where(F.col("coverage") * 100 >= percent - 1e-9)
        found = hits if found is None else found.unionByName(hits)
    out = rows.select("doc_id", "key")
    if found is None:
        return out.select("doc_id", F.lit(0).cast("long").alias("n_licenses"), F.lit("").alias("licenses"), F.lit(None).cast("double").alias("coverage"))
    best = found.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("license")).alias("l"), F.max("coverage").alias("c"))
    best = saved(best, "doc_id long, key long, l array<string>, c double", "licenses").withColumnsRenamed({"doc_id": "_d", "key": "_k"})
    out = out.join(best, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    return out.select("doc_id", F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join("l", ","), F.lit("")).alias("licenses"), F.round("c", 6).alias("coverage"))


def oracle() -> str:
    """The same rows in DuckDB: shares of each template's shingles by window, without signatures."""
    rows = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in NOTICES)
    cut = "list_filter(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    grams = f"unnest(list_transform(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1), lambda p: {{'p': p, 'g': array_to_string(w[p:p+{SHINGLE - 1}], ' ')}})) AS s"
    return f"""
WITH t0 AS (SELECT license, {cut.format("text")} AS w, row_number() OVER () AS id FROM (VALUES {rows}) v(license, text)),
t1 AS (SELECT *, greatest({LEAST}, (2 ** ceil(log2(len(w))))::INT) AS c FROM t0),
t AS (SELECT DISTINCT id, license, c, s.g AS g FROM (SELECT id, license, c, {grams} FROM t1)),
n AS (SELECT id, count(*) AS n FROM t GROUP BY id),
d0 AS (SELECT rowid AS r, doc_id, {cut.format("text")} AS w FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
d AS (SELECT r, size, s.p AS p, s.g AS g FROM (SELECT r, len(w) AS size, {grams} FROM d0 WHERE len(w) > 0)),
m AS (SELECT r, size, p, t.* FROM d JOIN t USING (g)),
x AS (SELECT *, unnest([(p - 1) // c, (p - 1) // c - 1]) AS k FROM m),
y AS (SELECT r, id, license, k, count(DISTINCT g) AS hit FROM x
      WHERE k >= 0 AND k <= greatest(ceil(size / c::DOUBLE)::INT - 2, 0) AND (p + {SHINGLE - 1} <= k * c + 2 * c OR size < {SHINGLE}) GROUP BY ALL),
z AS (SELECT r, license, hit / n::DOUBLE AS share FROM y JOIN n USING (id) WHERE 100 * hit / n::DOUBLE >= {PERCENT} - 1e-9),
b AS (SELECT r, count(DISTINCT license) AS n_licenses, array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses, max(share) AS coverage FROM z GROUP BY r)
SELECT doc_id, coalesce(n_licenses, 0)::BIGINT AS n_licenses, coalesce(licenses, '') AS licenses, round(coverage, 6) AS coverage FROM d0 LEFT JOIN b USING (r)
"""
