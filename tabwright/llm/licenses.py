"""License scans by MinHash bands over overlapping windows, with DataFrame functions only (operator 8).

Texts and templates are sequences of three-word shingles (lower case; words are runs of ASCII letters, digits and non-ASCII characters).
A text is cut into windows of six shingles, three apart, so that a notice of three shingles lies whole in one. Each window has
``len(SEEDS)`` = 8 MinHash values; each is a band of one row. A band of a window that has half of its shingles from a template meets a
template shingle's value with probability 1/2, so such a window is missed by all bands with probability 2^-8; longer notices
fill whole windows, which can't be missed.

Values are looked up in the set of the templates' values, shipped with the plan (the templates are a table with a checked bound). Where a
window meets a template, the text's exact shingles of that template are placed: the best stretch of 1.5 times the template's length is a
match if it holds 3/4 of the template's different shingles.

Null and empty texts match nothing. Equal texts match alike, repeated rows and null ids included. Templates of fewer than three words are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.llm.common import shared_table
from tabwright.llm.decontaminate import BREAKS, text_key

SHINGLE, WINDOW, STEP = 3, 6, 3
CONTAINED = 0.75
#: Values of templates that may travel with the plan.
VALUES = 1 << 17
#: Different leading bits, so that the smallest values of the bands differ.
SEEDS = [((k << 61) ^ (0x9E3779B97F4A7C15 * (k + 1) & ((1 << 61) - 1))) - (1 << 64 if k > 3 else 0) for k in range(8)]

#: Notices of public licences.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((TEMPLATES if templates is None else templates).items()), "license string, text string")


def _words(text: str) -> str:
    pattern = BREAKS.replace("\\", "\\\\")
    return f"coalesce(filter(split(lower({text}), '{pattern}'), w -> w <> ''), cast(array() as array<string>))"


def _shingles(words: str) -> str:
    """Hashes of every three words; none for fewer."""
    gets = ", ".join(f"get({words}, i + {k - 1})" for k in range(SHINGLE))
    return f"if(size({words}) < {SHINGLE}, cast(array() as array<bigint>), transform(sequence(1, size({words}) - {SHINGLE - 1}), i -> xxhash64({gets})))"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is worked out once and not at each use inside a lambda."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def scan(docs: DataFrame, templates: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, license, at, containment): one row per document row and template found, ``at`` the first word (from 0) of its best place."""
    spark = docs.sparkSession
    known = template_table(spark) if templates is None else templates.select("license", "text")
    known = known.where("license is not null and text is not null").select("license", F.expr(_words("text")).alias("words"))
    known = known.select("license", F.explode(F.expr("if(size(words) < 3, array(), transform(sequence(1, size(words) - 2), i -> array_join(slice(words, i, 3), ' ')))")).alias("shingle")).distinct()
    parts = F.split("shingle", " ")
    known = shared_table(known.withColumn("h", F.xxhash64(*[F.get(parts, F.lit(k)) for k in range(SHINGLE)])))
    rows = known.select("license", "shingle", "h").collect() if known.count() * len(SEEDS) <= VALUES else None
    if rows is None:
        raise ValueError("too many templates for one scan: scan them in parts")
    k1, k2 = text_key(F.col("text"))
    texts = docs.select(F.col(text_column).alias("text")).where("text is not null")
    if not rows:
        return docs.select(F.col(id_column).alias("doc_id"), F.lit("").alias("license"), F.lit(0).alias("at"), F.lit(0.0).alias("containment")).where("false")
    values = sorted({r["h"] ^ s for r in rows for s in SEEDS})
    bands = ", ".join(f"array_min(transform(v, x -> x ^ {s}L))" if s > -(1 << 63) else "array_min(transform(v, x -> x ^ (-9223372036854775807L - 1L)))" for s in SEEDS)
    windows = f"flatten(transform(transform(sequence(1, size(sh), {STEP}), s -> slice(sh, s, {WINDOW})), v -> array({bands})))"
    signatures = F.expr(_let("words", _words("text"), _let("sh", _shingles("words"), f"if(size(sh) = 0, sh, {windows})")))
    met = texts.select("text", F.array_distinct(F.filter(signatures, lambda x: x.isin(values))).alias("met")).where("size(met) > 0")
    met = shared_table(met.select(k1.alias("k1"), k2.alias("k2"), F.expr(_words("text")).alias("words"), "met").dropDuplicates(["k1", "k2"]))
    bands_of = known.select("license", F.explode(F.array(*[F.col("h").bitwiseXOR(F.lit(s).cast("long")) for s in SEEDS])).alias("value")).distinct()
    asked = met.select("k1", "k2", F.explode("met").alias("value")).join(F.broadcast(bands_of), "value").select("k1", "k2", "license").distinct()
    own = met.where("size(words) >= 3").select("k1", "k2", F.posexplode(F.expr("transform(sequence(1, size(words) - 2), i -> array_join(slice(words, i, 3), ' '))")).alias("at", "shingle"))
    placed = own.join(F.broadcast(known.select("license", "shingle")), "shingle").join(asked, ["k1", "k2", "license"], "left_semi")
    sizes = known.groupBy("license").agg(F.count(F.lit(1)).alias("n"))
    # a place counts in the windows that start behind its shingle's last place and less than a window before it
    before = F.lag("at").over(Window.partitionBy("k1", "k2", "license", "shingle").orderBy("at"))
    spans = placed.join(F.broadcast(sizes), "license").select("k1", "k2", "license", "n", "at", F.greatest(F.coalesce(before, F.lit(-1)), F.col("at") - F.ceil(1.5 * F.col("n"))).cast("int").alias("low"))
    edges = F.array(F.struct((F.col("low") + 1).alias("pos"), F.lit(1).alias("d"), F.lit(False).alias("place")), F.struct((F.col("at") + 1).alias("pos"), F.lit(-1).alias("d"), F.lit(False).alias("place")),
                    F.struct(F.col("at").alias("pos"), F.lit(0).alias("d"), F.lit(True).alias("place")))
    running = Window.partitionBy("k1", "k2", "license").orderBy("pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = spans.select("k1", "k2", "license", "n", F.explode(edges).alias("e")).select("k1", "k2", "license", "n", "e.*").withColumn("have", F.sum("d").over(running))
    best = counted.where("place").groupBy("k1", "k2", "license", "n").agg(F.max(F.struct("have", (-F.col("pos")).alias("back"))).alias("best")).where(f"best.have >= {CONTAINED} * n")
    found = best.select("k1", "k2", "license", (-F.col("best.back")).alias("at"), (F.col("best.have") / F.col("n")).alias("containment"))
    every = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).where("text is not null").select("doc_id", k1.alias("k1"), k2.alias("k2"))
    return every.join(found, ["k1", "k2"]).select("doc_id", "license", "at", "containment")
