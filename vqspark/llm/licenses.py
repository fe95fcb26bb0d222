"""License notices by min-hash bands over overlapping windows, verified by exact shingle containment.

Text windows have WINDOW five-word shingles and start STEP shingles apart; templates are cut at every shingle. So of any run
of WINDOW + STEP - 1 template shingles that stands in a text, some text window is a template window itself, and all its
bands agree. An edit within a notice breaks four shingles or more, so a notice of ten shingles or more that keeps
CONTAINMENT of them keeps such a run. Shorter notices may not: of a notice with up to SHORT shingles as many as can't all be
missing are looked up by their own hash too, among all shingles of the texts, so that none of these notices is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import table
from .native_text import CORES_SQL, WORDS_SQL, cores, solid_words
from .near_dups import row_key

WINDOW, STEP, BANDS, SHIFT = 4, 2, 8, 6
CONTAINMENT = 0.8
#: Templates up to this number of shingles are also looked up shingle by shingle.
SHORT = 9
#: Shingles of all templates up to which these are broadcast; each gives some BANDS rows of about 60 bytes.
MOST_BROADCAST = 200_000

# Public license notices.
TEMPLATES = [
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT-line", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def with_shingles(df: DataFrame, name: str) -> DataFrame:
    """df with an array in place of `text`: hashes of the five-word shingles of its lower-cased words.

    A shorter text is one shingle. Words are a column of their own first: an expression within a lambda would be worked
    out for every element.
    """
    words = df.withColumn("text", F.transform(cores(solid_words(F.col("text"))), F.lower))
    w = F.col("text")
    many = F.transform(F.sequence(F.lit(0), F.size(w) - T.SHINGLE_WORDS), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(T.SHINGLE_WORDS)]))
    hashes = F.when(F.size(w) >= T.SHINGLE_WORDS, many).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    return words.withColumn(name, hashes).drop("text")


def bands(values: Column, first: Column) -> Column:
    """The window's least hash under each of BANDS shifts; a place beyond the end counts for nothing (`least` skips it).

    A shift by SHIFT bits more compares the mixed hashes by other bits, so the bands' minima are nearly independent; the
    bits that are left name the shingle well enough, as candidates are verified.
    """
    window = [F.get(values, first + k) for k in range(WINDOW)]
    return F.array(*[F.least(*[F.shiftleft(w, SHIFT * band) for w in window]) for band in range(BANDS)])


def scan_licenses(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, license_id, n_matched, n_shingles, containment: notices with CONTAINMENT of their shingles in a text.

    `docs` needs doc_id and text, `templates` license_id and text; other columns are not looked at. Null and empty texts
    match nothing, null or wordless templates and those without license_id are left out. Of equal rows one result stays; a
    doc_id with several texts, or a license_id with several templates, has its best one. Templates of up to MOST_BROADCAST
    shingles (checked) are broadcast, and the documents scanned in one pass, of which candidates alone move. Beyond that,
    windows' hashes are shuffled, without their texts.
    """
    kept = with_shingles(templates.filter("license_id is not null").select("license_id", F.xxhash64("license_id", "text").alias("template"), "text"), "in_order")
    kept = kept.withColumn("t", F.array_distinct("in_order")).filter("size(t) > 0").dropDuplicates(["template"])
    few = (kept.agg(F.sum(F.size("in_order"))).first()[0] or 0) <= MOST_BROADCAST
    held = F.broadcast if few else (lambda df: df)
    # `least` skips what lies beyond a template's end, so short templates have one window.
    cuts = kept.select("template", "in_order", F.explode(F.sequence(F.lit(0), F.greatest(F.size("in_order") - WINDOW, F.lit(0)))).alias("i"))
    wanted = cuts.select("template", F.explode(bands(F.col("in_order"), F.col("i"))).alias("value"))
    enough = F.ceil(F.size("t") * CONTAINMENT - 1e-9)
    single = kept.filter(F.size("t") <= SHORT).select("template", F.explode(F.slice("t", F.lit(1), (F.size("t") - enough + 1).cast("int"))).alias("value"))
    wanted = held(wanted.union(single).distinct())
    texts = with_shingles(docs.select("doc_id", row_key().alias("row_key"), "text"), "s")
    # An outer explode keeps Spark from computing the shingles once more for a filter.
    windows = texts.select("doc_id", "row_key", "s", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("s") - 1, F.lit(0)), F.lit(STEP))).alias("i"))
    # Windows start STEP shingles apart, so their first STEP shingles are all that a text has.
    single = F.array(*[F.get("s", F.col("i") + k) for k in range(STEP)])
    marks = windows.select("doc_id", "row_key", "s", F.explode(F.concat(bands(F.col("s"), F.col("i")), single)).alias("value"))
    if few:
        found = marks.join(wanted, "value").groupBy("doc_id", "row_key", "template").agg(F.first("s").alias("s"))
    else:
        pairs = marks.select("row_key", "value").join(wanted, "value").select("row_key", "template").distinct()
        found = pairs.join(texts.dropDuplicates(["row_key"]), "row_key")
    matched = found.join(held(kept.select("template", "license_id", "t")), "template").select("doc_id", "license_id", F.size(F.array_intersect("t", "s")).cast("long").alias("n_matched"), F.size("t").cast("long").alias("n_shingles"))
    matched = matched.withColumn("containment", F.col("n_matched") / F.col("n_shingles")).filter(F.col("containment") >= CONTAINMENT)
    best = matched.groupBy("doc_id", "license_id").agg(F.max(F.struct("containment", "n_matched", "n_shingles")).alias("best"))
    return best.select("doc_id", "license_id", "best.n_matched", "best.n_shingles", "best.containment")


def known_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license_id string, text string")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"), known_templates(spark))


def _shingles_sql(words: str) -> str:
    return f"CASE WHEN len({words}) >= 5 THEN list_distinct(list_transform(range(1, len({words}) - 3), lambda i: list_aggregate({words}[i:i + 4], 'string_agg', ' '))) WHEN len({words}) > 0 THEN [list_aggregate({words}, 'string_agg', ' ')] ELSE [] END"


OP4_SQL = f"""
WITH notices(license_id, text) AS (VALUES {", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in TEMPLATES)}),
t AS (SELECT license_id, {_shingles_sql("w")} AS s FROM (SELECT license_id, list_transform({CORES_SQL}, lambda x: lower(x)) AS w FROM (SELECT license_id, {WORDS_SQL} AS w FROM notices))),
d AS (SELECT doc_id, {_shingles_sql("w")} AS s FROM (SELECT doc_id, list_transform({CORES_SQL}, lambda x: lower(x)) AS w FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents))),
hits AS (
    SELECT doc_id, license_id, count(*) AS n_matched, any_value(n) AS n_shingles
    FROM (SELECT doc_id, unnest(s) AS e FROM d) JOIN (SELECT license_id, len(s) AS n, unnest(s) AS e FROM t) USING (e) GROUP BY doc_id, license_id)
SELECT doc_id, license_id, CAST(n_matched AS BIGINT) AS n_matched, CAST(n_shingles AS BIGINT) AS n_shingles, n_matched / n_shingles AS containment
FROM hits WHERE n_matched / n_shingles >= {CONTAINMENT}
"""
