"""Licence scan: normalised lines compared with licence templates by the Dice coefficient over word bigrams, in DataFrame expressions alone.

A Dice of t between sets of a and b bigrams needs t / (2 - t) <= a / b <= (2 - t) / t, so a template is only compared with lines of a size in these bounds: the
index has a row for each template and admissible size, and lines fetch their templates by an equi-join on size. By the same bound a line must hold one of a few anchor
words of the template, so texts and lines without any are left out before they are cut into bigrams.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public licence notices, one line each.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def bigrams(line: Column) -> Column:
    """Distinct word bigrams of a normalised line; fewer than two words: none."""
    words = F.split(F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " ")), " ")

    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.array_distinct(F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda x, y: F.concat_ws(" ", x, y)))

    return F.nullif(F.transform(F.array(words), pairs)[0], F.array().cast("array<string>"))  # the lambda binds the words, so they are split once


def anchors(templates: Sequence[tuple[str, str]], dice: float) -> list[str]:
    """Words of which every matching line holds at least one: a line without a template's anchors lacks so many of its bigrams that the bound on the Dice fails."""
    out = set()
    for _, text in templates:
        words = re.findall(r"[^\W_]+", text.lower())
        pairs = set(zip(words, words[1:]))
        left, most = set(pairs), len(pairs) * dice / (2 - dice)
        for w in sorted(set(words), key=lambda w: (-len(w), w)):
            if len(left) < most:
                break
            out.add(w)
            left = {p for p in left if w not in p}
    return sorted(out)


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, dice: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, license, dice): each line, from 1, with a Dice of at least ``dice`` to a template, and its best licence (ties: smaller name).

    Lines end at a line feed and may have any length. Null and empty texts have no match. Rows that repeat a doc_id are one document. Templates are the caller's list, so
    the index is bounded by it and broadcast; only matches are shuffled. Other columns are not read.
    """
    spark = docs.sparkSession
    entry = [F.struct(F.lit(n).alias("license"), F.lit(t).alias("t")) for n, t in templates]
    index = spark.range(1).select(F.inline(F.array(*entry))).select("license", bigrams(F.col("t")).alias("b")).where("b is not null")
    low, high = dice / (2 - dice), (2 - dice) / dice
    sizes = F.sequence(F.greatest(F.lit(1), F.floor(F.size("b") * low)).cast("int"), F.ceil(F.size("b") * high).cast("int"))
    index = index.select("license", "b", F.explode(sizes).alias("size"))
    near = "|".join(anchors(templates, dice))
    lines = docs.where(F.lower(F.col(text_col)).rlike(near)).select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("line", "raw"))
    lines = lines.where(F.lower("raw").rlike(near)).select("doc_id", (F.col("line") + 1).cast("long").alias("line"), bigrams(F.col("raw")).alias("a")).where("a is not null").withColumn("size", F.size("a"))
    met = lines.join(F.broadcast(index), "size").withColumn("dice", 2.0 * F.size(F.array_intersect("a", "b")) / (F.col("size") + F.size("b")))
    best = met.where(F.col("dice") >= dice).groupBy("doc_id", "line").agg(F.min(F.struct((-F.col("dice")).alias("minus"), "license")).alias("best"))
    return best.select("doc_id", "line", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("dice"))


