"""Licence scan: lines, sentences, paragraphs, whole texts and word windows, normalised, against licence templates by the Dice coefficient of their word bigrams. DataFrame functions only.

Bigrams count with repeats (the second occurrence of a bigram matches only a second one). A segment of n bigrams can reach
a Dice coefficient of t with a template of m only if t/(2-t) m <= n <= (2-t)/t m, and then shares t/(2-t) m bigrams at least;
so it holds one of the template's anchors, as many of its rarer bigrams as leave fewer than that. Texts without an anchor of
any template are dropped by one pattern. In the others segments meet only templates that they fit, by an equi-join on n, and
a window as long as the template slides over all words, wherever in a line or paragraph a notice is. Where each occurrence of
a bigram comes into the window and leaves it is known from its own place and the one before it, so running sums give the
shared bigrams of all windows in one pass; of each run of windows that share the
same number, and more than those beside them, the last is kept.

Segments and windows are places, spans of words with a template. Of places that overlap the best stays (higher coefficient,
then longer, then the name first in order), so a notice counts once and names one licence. n_matches counts the places that stay.
Null and empty texts, and texts without a match, get a row with n_matches 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkscale.llm.common import array_starts, materialise

THRESHOLD = 0.75
PLACES = "array<struct<start:bigint,end:bigint,rank:struct<loss:double,short:bigint,name:string>>>"

#: Public licence notices, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
]


def bigrams(text: str) -> list[str]:
    """Of a template: normalised bigrams, each with its occurrence number."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return [f"{p} {pairs[:i].count(p) + 1}" for i, p in enumerate(pairs)]


def bounds(m: int, threshold: float) -> tuple[int, int]:
    return math.ceil(threshold / (2 - threshold) * m - 1e-9), math.floor((2 - threshold) / threshold * m + 1e-9)


def anchors(pairs: list[str], threshold: float) -> list[str]:
    """Bigrams of a template (by bigrams()) of which any text that can match has one: those of longer words, without numbers."""
    spare = len(pairs) - math.ceil(threshold / (2 - threshold) * len(pairs) - 1e-9) + 1
    counts = Counter(p.rpartition(" ")[0] for p in pairs)
    out = []
    for pair in sorted(counts, key=lambda p: (-min(map(len, p.split())), -len(p), p)):
        if spare <= 0:
            break
        out.append(pair)
        spare -= counts[pair]
    return out


def _pattern(pairs: set[str]) -> str:
    """Any of pairs among words between single spaces; by their first letters, so that most words fail at once."""
    letters = sorted({p[0] for p in pairs})
    return " (?:" + "|".join(f"{x}(?:{'|'.join(sorted(p[1:] for p in pairs if p[0] == x))})" for x in letters) + ") "


def _place(start, end, dice, name) -> Column:
    """A span of words, end exclusive, with what its rank goes by: the smaller, the better."""
    rank = F.struct((-dice).alias("loss"), (F.lit(0) - (end - start)).cast("bigint").alias("short"), name.alias("name"))
    return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), rank.alias("rank"))


def _windows(base: DataFrame, known: list[tuple[str, list[str]]], threshold: float) -> DataFrame:
    """(row, place): where windows as long as a template share enough bigrams for threshold, and more than those on both sides (the last of a run with the same number)."""
    rows = []
    for k, (name, pairs) in enumerate(known):
        first = set(anchors(pairs, threshold))
        rows += [(pair, k, name, len(pairs), i, n, pair in first) for i, (pair, n) in enumerate(Counter(p.rpartition(" ")[0] for p in pairs).items())]
    table = F.broadcast(base.sparkSession.createDataFrame(rows, "pair string, template int, name string, m int, kind int, times int, anchor boolean"))
    words = base.where("flat IS NOT NULL").select("row", F.split(F.trim("flat"), " ").alias("words")).withColumn("last", F.size("words") - 1)
    pairs = words.where("last > 0").select("row", "last", F.posexplode(_bigrams(F.col("words"))).alias("at", "pair"))
    item = F.struct("kind", "at", "times")
    each = pairs.join(table, "pair").groupBy("row", "template").agg(F.first("name").alias("name"), F.first("m").alias("m"), F.first("last").alias("last"), F.max("anchor").alias("anchor"), F.sort_array(F.collect_list(item)).alias("items"))
    need = threshold * F.col("m")
    each = each.where(F.col("anchor") & (F.size("items") >= need) & (F.col("last") >= F.col("m")))

    def change(x: Column, i: Column) -> Column:
        # an occurrence counts in windows that hold it, but not as many before it as the template has
        before = F.get("items", i - x["times"])
        low = F.greatest(F.lit(0), x["at"] - F.col("m") + 1, F.when(before["kind"] == x["kind"], before["at"] + 1))
        return F.array(F.struct(low.alias("start"), F.lit(1).alias("step")), F.struct((x["at"] + 1).alias("start"), F.lit(-1).alias("step")))

    steps = each.select("row", "template", "name", "m", "last", F.explode(F.flatten(F.transform("items", change))).alias("e")).select("row", "template", "name", "m", "last", "e.*")
    own = Window.partitionBy("row", "template").orderBy("start")
    steps = steps.withColumn("shared", F.sum("step").over(own.rangeBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("until", F.lead("start").over(own))
    runs = steps.where((F.col("until").isNull() | (F.col("until") > F.col("start"))) & (F.col("start") <= F.col("last") - F.col("m"))).withColumn("before", F.coalesce(F.lag("shared").over(own), F.lit(0)))
    runs = runs.where(F.col("shared") != F.col("before")).withColumn("after", F.coalesce(F.lead("shared").over(own), F.lit(0))).withColumn("until", F.lead("start").over(own))
    runs = runs.where((F.col("shared") >= need) & (F.col("shared") > F.greatest("before", "after")))
    start = F.least(F.col("until") - 1, F.col("last") - F.col("m"))
    return runs.select("row", _place(start, start + F.col("m") + 1, F.col("shared").cast("double") / F.col("m"), F.col("name")).alias("place"))


def _segments(flat: Column, norm: Column, text: Column) -> Column:
    """(start, segment) of lines, sentences, paragraphs and the whole text, with the number of words before each."""
    tidy = lambda x: F.trim(F.regexp_replace(x, "[ \n]+", " "))
    sentences = F.transform(F.split(F.lower(text), "(?<=[.!?;:])\\s+"), lambda x: F.trim(F.regexp_replace(x, "[^\\p{L}\\p{N}]+", " ")))
    return F.array(F.transform(F.split(norm, "\n"), lambda x: F.trim(x)), sentences, F.transform(F.split(norm, "\n ?\n"), tidy), F.array(F.trim(flat)))


def _best(places: str) -> Column:
    """Of places sorted by start: how many stay, their licences, and the best rank. One pass: a better place that overlaps the one before it is put on top of it; where a place begins after the top's end the stack is settled, from the top down."""
    kept = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<string>").alias("names"), F.lit(None).cast("struct<loss:double,short:bigint,name:string>").alias("rank"), F.array().cast(PLACES).alias("stack"))

    def settle(acc: Column) -> Column:
        top = F.struct(acc["n"].alias("n"), acc["names"].alias("names"), acc["rank"].alias("rank"), F.lit(None).cast("bigint").alias("begin"))

        def keep(out: Column, x: Column) -> Column:
            free = out["begin"].isNull() | (x["end"] <= out["begin"])
            kept = F.struct((out["n"] + 1).alias("n"), F.array_union(out["names"], F.array(x["rank"]["name"])).alias("names"), F.least(out["rank"], x["rank"]).alias("rank"), x["start"].alias("begin"))
            return F.when(free, kept).otherwise(out)

        return F.aggregate(F.reverse(acc["stack"]), top, keep)

    def step(acc: Column, x: Column) -> Column:
        top = F.try_element_at(acc["stack"], F.lit(-1))
        with_stack = lambda own, stack: F.struct(own["n"].alias("n"), own["names"].alias("names"), own["rank"].alias("rank"), stack.alias("stack"))
        after = top.isNotNull() & (x["start"] >= top["end"])
        better = top.isNull() | (x["rank"] < top["rank"])
        return F.when(after, with_stack(settle(acc), F.array(x))).when(better, with_stack(acc, F.concat(acc["stack"], F.array(x)))).otherwise(acc)

    return F.aggregate(places, kept, step, settle)


def _bigrams(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))


def _numbered(pairs: str) -> Column:
    """Each bigram with its occurrence number, as in bigrams(); pairs must be a column, so that it isn't made again for each element."""
    once = F.size(F.array_distinct(pairs)) == F.size(pairs)
    counted = F.transform(pairs, lambda p, i: F.concat_ws(" ", p, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda q: q == p)).cast("string")))
    return F.when(once, F.transform(pairs, lambda p: F.concat(p, F.lit(" 1")))).otherwise(counted)


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document: doc_id, license (of the best place; ties by length, then name), dice, licenses (of all places, by name), n_matches (places, none of which overlap)."""
    known = [(name, bigrams(text)) for name, text in templates or TEMPLATES]
    ranges = [bounds(len(b), threshold) for _, b in known]
    least, most = max(1, min(a for a, _ in ranges)), max(b for _, b in ranges)
    rows = [(n, name, b) for (name, b), (low, high) in zip(known, ranges, strict=True) for n in range(low, high + 1)]
    table = F.broadcast(docs.sparkSession.createDataFrame(rows, "fit int, name string, template array<string>"))  # some thousand rows, fixed by the templates

    norm = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^\\p{L}\\p{N}\\n]+", " ")
    flat = F.concat(F.lit(" "), F.regexp_replace("norm", "[ \n]+", " "), F.lit(" "))
    base = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text", norm.alias("norm")).withColumn("flat", flat)
    pattern = _pattern({a for _, b in known for a in anchors(b, threshold)})
    held = F.col("flat").rlike(pattern)
    base = materialise(base.select("doc_id", "row", *[F.when(held, F.col(c)).alias(c) for c in ("text", "norm", "flat")]), "licensed")
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    df = base.where("flat IS NOT NULL").select("row", F.explode(_segments(F.col("flat"), F.col("norm"), F.col("text"))).alias("pieces"))
    df = df.withColumn("sizes", F.transform("pieces", lambda x: F.when(x == "", 0).otherwise(spaces(x) + 1).cast("bigint"))).withColumn("starts", array_starts(F.col("sizes")))
    df = df.select("row", F.explode(F.arrays_zip("starts", "pieces")).alias("z")).select("row", F.col("z.starts").alias("start"), F.col("z.pieces").alias("segment"))
    df = df.withColumn("fit_n", spaces(F.col("segment"))).where(F.col("fit_n").between(least, most) & F.concat(F.lit(" "), "segment", F.lit(" ")).rlike(pattern))
    df = df.withColumn("plain", _bigrams(F.split("segment", " "))).withColumn("pairs", _numbered("plain"))
    found = df.join(table, df["fit_n"] == table["fit"])
    dice = (2.0 * F.size(F.array_intersect("pairs", "template")) / (F.size("pairs") + F.size("template"))).alias("dice")
    hits = found.select("row", "start", (F.col("start") + F.col("fit_n") + 1).alias("end"), dice, "name").where(F.col("dice") >= threshold)
    places = hits.select("row", _place(F.col("start"), F.col("end"), F.col("dice"), F.col("name")).alias("place")).unionByName(_windows(base, known, threshold))
    sorted_places = places.groupBy("row").agg(F.collect_set("place").alias("places")).withColumn("places", F.sort_array("places"))
    best = sorted_places.select("row", _best("places").alias("best"))
    out = base.select("doc_id", "row").join(best, "row", "left")
    names = F.coalesce(F.array_join(F.array_sort("best.names"), ","), F.lit(""))
    return out.select("doc_id", F.col("best.rank.name").alias("license"), (-F.col("best.rank.loss")).alias("dice"), names.alias("licenses"), F.coalesce("best.n", F.lit(0)).cast("bigint").alias("n_matches"))
