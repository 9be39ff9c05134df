"""Licence scans: Dice coefficient over word bigrams. DataFrame functions only."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public short notices, by identifier.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "All rights reserved.",
}


def normalise(text: str) -> list[str]:
    """Lower-case words of a template: runs of letters and digits."""
    return re.findall(r"[^\W_]+", text.lower())


def bigrams_of(text: str) -> list[str]:
    """Bigrams of a template, repeats kept."""
    words = normalise(text)
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def word_bigrams(words: Column) -> Column:
    """Bigrams of an array of words, joined by a space."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(pairs, lambda p: p.isNotNull())


def _fixed(value: Column) -> Column:
    """`value` computed once for each row: a filter on it is not moved below, where it would be computed again."""
    return F.explode(F.array(value))


def _runs(docs: DataFrame, known: dict[str, Counter], threshold: float) -> DataFrame:
    """(doc_id, licence, dice, n): licences that stand in a run of words of a text, whatever is around them.

    A template of b bigrams matches runs of b * t / (2 - t) to b * (2 - t) / t bigrams that share
    at least the smaller number with it. So a text goes on only if it holds one of as many of the
    template's longest bigrams as cannot all be missing. The best run starts and ends with
    bigrams of the template; from each of them that is followed by enough others within the
    bounds, the run of the largest Dice is taken. n is the number of such runs at or above the
    threshold that do not overlap.
    """
    least = {k: math.ceil(c.total() * threshold / (2 - threshold) - 1e-9) for k, c in known.items()}
    most = {k: math.floor(c.total() * (2 - threshold) / threshold + 1e-9) for k, c in known.items()}
    anchors = set()
    for name, own in known.items():
        missing = own.total() - least[name]
        for gram in sorted(own, key=lambda g: (-len(g), g)):
            anchors.add(gram)
            missing -= own[gram]
            if missing < 0:
                break
    words = docs.where(F.col("text").isNotNull()).select("doc_id", _fixed(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")).alias("_words"))
    grams = words.where(F.size("_words") > 1).select("doc_id", _fixed(word_bigrams(F.col("_words"))).alias("_grams"))
    grams = grams.where(F.arrays_overlap("_grams", F.array(*map(F.lit, sorted(anchors)))))

    def hits(own: Counter) -> Column:
        """Places of the template's bigrams: at, which, times (how often the template has it)."""
        names = sorted(own)
        which = F.transform("_grams", lambda g, at: F.struct(at.alias("at"), F.array_position(F.array(*map(F.lit, names)), g).cast("int").alias("which")))
        times = F.array(*[F.lit(own[n]) for n in names])
        return F.transform(F.filter(which, lambda h: h["which"] > 0), lambda h: F.struct(h["at"].alias("at"), h["which"].alias("which"), F.element_at(times, h["which"]).alias("times")))

    each = F.array(*[F.struct(F.lit(k).alias("licence"), F.lit(c.total()).alias("b"), F.lit(least[k]).alias("least"), F.lit(most[k]).alias("most"), hits(c).alias("hits")) for k, c in known.items()])
    rows = grams.select("doc_id", F.inline(each)).where(F.size("hits") >= F.col("least"))
    most_, b = F.col("most"), F.col("b")

    def numbered(h: Column, i: Column) -> Column:
        """With the number of the hit, and of the one from behind which a run must start for this one to be shared."""
        first = F.greatest(i + 1 - most_, F.lit(1))
        same = F.filter(F.transform(F.slice("hits", first, i + 1 - first), lambda x, o: F.when(x["which"] == h["which"], first + o)), lambda x: x.isNotNull())
        return F.struct(h["at"].alias("at"), (i + 1).alias("number"), F.coalesce(F.try_element_at(same, -h["times"]), F.lit(0)).alias("after"))

    rows = rows.select("doc_id", "licence", "b", "least", "most", _fixed(F.transform("hits", numbered)).alias("hits"))
    enough = lambda h: F.coalesce(F.try_element_at("hits", h["number"] + F.col("least") - 1)["at"] - h["at"] < most_, F.lit(False))

    def best(h: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            shared = s["shared"] + F.when(x["after"] < h["number"], 1).otherwise(0)
            size = x["at"] - h["at"] + 1
            dice = 2.0 * shared / (size + b)
            better = (size <= most_) & (dice > s["dice"])
            return F.struct(shared.alias("shared"), F.when(better, dice).otherwise(s["dice"]).alias("dice"), F.when(better, x["at"]).otherwise(s["end"]).alias("end"))

        run = F.aggregate(F.slice("hits", h["number"], most_), F.struct(F.lit(0).alias("shared"), F.lit(0.0).alias("dice"), F.lit(-1).alias("end")), step)
        return F.transform(F.array(run), lambda r: F.struct(r["end"].alias("end"), h["at"].alias("start"), r["dice"].alias("dice")))[0]

    runs = F.array_sort(F.filter(F.transform(F.filter("hits", enough), best), lambda r: r["dice"] >= threshold))
    rows = rows.select("doc_id", "licence", _fixed(runs).alias("_runs")).where(F.size("_runs") > 0)
    apart = F.aggregate("_runs", F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")), lambda s, r: F.when(r["start"] > s["end"], F.struct((s["n"] + 1).alias("n"), r["end"].alias("end"))).otherwise(s), lambda s: s["n"])
    return rows.select("doc_id", "licence", F.array_max(F.transform("_runs", lambda r: r["dice"])).alias("dice"), apart.alias("n"))


def scan(docs: DataFrame, threshold: float = 0.8, templates: dict[str, str] | None = None) -> DataFrame:
    """Licences found in each document.

    A document's units are its lines, its paragraphs of several lines (blank lines part them)
    and, if it has several lines, the whole text. A unit is cut into lower-case words of letters
    and digits and compared with a template by Dice = 2 * shared / (a + b): a and b are the
    numbers of word bigrams, repeats counted, and shared the number of different bigrams that
    both have. As shared is at most the smaller of a and b, a template of b bigrams can only
    match a unit of b * t / (2 - t) to b * (2 - t) / t bigrams; outside those bounds it is not
    compared, and a unit is cut into no more words than the largest bound needs. A notice that is
    not alone in its unit is found as a run of words of the whole text, by the same measure and
    bounds (_runs()). Templates are a fixed list; units and runs are one pass over the texts
    each, and only matches are grouped.

    Returns doc_id, licence, dice (the best unit's or run's, rounded to 6 places), n_units (units
    at or above `threshold`, or runs that do not overlap if these are more: a notice alone on its
    line is both), one row for each document and licence found. A null, empty or unmatched
    text gives no row. Rows with one doc_id count as one document; rows with a null doc_id count
    together. An empty table gives no rows. Other columns are not read.
    """
    known = {name: Counter(bigrams_of(text)) for name, text in (templates or TEMPLATES).items()}
    low = min(c.total() for c in known.values()) * threshold / (2 - threshold)
    high = max(c.total() for c in known.values()) * (2 - threshold) / threshold
    lines = F.split(F.col("text"), "\n")
    none = F.array().cast("array<string>")
    paragraphs = F.filter(F.split(F.col("text"), r"\n[ \t\r]*\n"), lambda p: p.contains("\n"))
    several = F.when(F.col("text").contains("\n"), F.array_append(F.when(F.col("text").rlike(r"\n[ \t\r]*\n"), paragraphs).otherwise(none), F.col("text"))).otherwise(none)
    units = docs.where(F.col("text").isNotNull()).select("doc_id", F.explode(F.concat(lines, several)).alias("_unit"))
    pieces = units.select("doc_id", _fixed(F.split("_unit", r"[^\p{L}\p{N}]+", int(high) + 4)).alias("_pieces"))
    words = pieces.where((F.size("_pieces") >= low) & (F.size("_pieces") <= high + 3)).select("doc_id", _fixed(F.transform(F.filter("_pieces", lambda w: w != ""), F.lower)).alias("_words"))
    grams = words.where((F.size("_words") - 1 >= low) & (F.size("_words") - 1 <= high)).select("doc_id", _fixed(word_bigrams(F.col("_words"))).alias("_grams"))

    def match(name: str, own: Counter) -> Column:
        n, count = F.size("_grams"), own.total()
        possible = (n >= count * threshold / (2 - threshold)) & (n <= count * (2 - threshold) / threshold)
        times = F.create_map(*[F.lit(x) for pair in sorted(own.items()) for x in pair])
        both = F.array_intersect("_grams", F.array(*map(F.lit, sorted(own))))
        shared = F.aggregate(both, F.lit(0), lambda s, b: s + F.least(F.element_at(times, b), F.size(F.filter("_grams", lambda g: g == b))))
        return F.when(possible, F.struct(F.lit(name).alias("licence"), (F.lit(2.0) * shared / (n + count)).alias("dice")))

    found = grams.select("doc_id", F.inline(F.filter(F.array(*[match(k, c) for k, c in known.items()]), lambda m: m.isNotNull() & (m["dice"] >= threshold))))
    both = found.select("doc_id", "licence", "dice", F.lit(1).alias("_unit"), F.lit(0).alias("_run")).unionByName(_runs(docs, known, threshold).select("doc_id", "licence", "dice", F.lit(0).alias("_unit"), F.col("n").alias("_run")))
    return both.groupBy("doc_id", "licence").agg(F.round(F.max("dice"), 6).alias("dice"), F.greatest(F.sum("_unit"), F.sum("_run")).alias("n_units"))
