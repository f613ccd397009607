"""License scans: Dice coefficient of word bigrams against licence templates.

Units of a text (the whole text, its lines, its sentences) are normalised to
lower-case words and turned into sets of word bigrams.  A template matches a
unit at Dice 2 |A n B| / (|A| + |B|) of ``THRESHOLD`` or more.  That bounds the
unit's size by |B| t / (2 - t) <= |A| <= |B| (2 - t) / t, so templates of other
sizes are never compared, and units that share no bigram with any template are
left at once.  A text whose bigrams cannot reach any template's lower bound is
not cut into units at all.

A notice may be wrapped over lines, commented or inside a longer sentence.  So
paragraphs (the text cut at blank lines) are units too, and for each template
every window of its length over the whole word sequence is compared.
Windows that match and start at most half a window apart are one passage, with
the best Dice of them.

One projection of SQL functions; templates are literals of the plan.

Defined results: null and empty texts match nothing; a unit of one word has no
bigrams and matches nothing; of equal best templates the first name wins;
repeated rows give repeated results.
"""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import LOWER, UPPER, let, text_of

THRESHOLD = 0.8
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PARAGRAPH = r"\n[\x20\x09-\x0D]*\n"

#: Notices of common licences.
TEMPLATES = (
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd-2-clause", "Released under the BSD 2-Clause License."),
    ("bsd-3-clause", "Released under the BSD 3-Clause License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def template_words(text: str) -> list[str]:
    import re

    return [w for w in re.split(SPLIT, "".join(c.lower() if c in UPPER else c for c in text)) if w]


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams, each as two words joined by a blank."""
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can reach the threshold against n bigrams."""
    import math

    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def units_of(text: Column) -> Column:
    """The whole text, its lines and its sentences, each once."""
    sentences = F.split(F.regexp_replace(text, r"([.!?])\x20+", "$1\n"), "\n", -1)
    return F.array_distinct(F.concat(F.array(text), F.split(text, "\n", -1), sentences))


def paragraphs_of(text: Column) -> Column:
    """The text cut at blank lines."""
    return F.split(text, PARAGRAPH, -1)


def bigrams_of(unit: Column) -> Column:
    """All bigrams of a unit, in order."""
    def pairs(w: Column) -> Column:
        n = F.size(w) - 1
        return F.zip_with(F.slice(w, 1, F.greatest(n, F.lit(0))), F.slice(w, 2, F.greatest(n, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))

    return let(F.filter(F.split(F.translate(unit, UPPER, LOWER), SPLIT), lambda x: x != ""), pairs)


def unit_bigrams(unit: Column) -> Column:
    """Distinct bigrams of a unit."""
    return F.array_distinct(bigrams_of(unit))


def _count_in(bigrams: Column, wanted: list[str]) -> Column:
    return F.size(F.filter(bigrams, lambda g: g.isin(wanted)))


def match_unit(unit: Column, threshold: float = THRESHOLD, templates=TEMPLATES) -> Column:
    """array<struct<dice, license>> of the templates that match one unit."""
    grams = [(name, template_bigrams(t)) for name, t in templates]
    every = sorted({g for _, gs in grams for g in gs})
    bounds = [size_bounds(len(gs), threshold) for _, gs in grams]
    none = F.array().cast("array<struct<dice:double,license:string>>")

    def compare(a: Column) -> Column:
        """a: struct of the number of bigrams and those that some template has."""
        def dice(name: str, gs: list[str], low: int, high: int) -> Column:
            # the size bound comes first: beyond it the shared bigrams are not counted
            value = 2.0 * _count_in(a["shared"], gs) / (a["n"] + len(gs))
            return F.when(a["n"].between(low, high), F.when(value >= threshold, F.struct(value.alias("dice"), F.lit(name).alias("license"))))

        found = F.array(*[dice(name, gs, *b) for (name, gs), b in zip(grams, bounds)])
        return F.when(F.size(a["shared"]) == 0, none).otherwise(F.filter(found, lambda x: x.isNotNull()))

    summary = let(unit_bigrams(unit), lambda b: F.struct(F.size(b).alias("n"), F.when(F.size(b) <= max(h for _, h in bounds), F.filter(b, lambda g: g.isin(every))).otherwise(F.array().cast("array<string>")).alias("shared")))
    return let(summary, compare)


def match_windows(bigrams: Column, threshold: float = THRESHOLD, templates=TEMPLATES) -> Column:
    """array<struct<dice, license>> of the passages of a text, given all its bigrams in order.

    Only windows with as many template bigrams as the lower size bound can
    match; they are found from the places of those bigrams, so windows without
    them cost nothing.
    """
    none = F.array().cast("array<struct<dice:double,license:string>>")
    ints = F.array().cast("array<int>")

    def passages(name: str, gs: list[str], size: int) -> Column:
        b, low = len(gs), max(size_bounds(len(gs), threshold)[0], 1)

        def starts(p: Column) -> Column:
            """p: places of the template's bigrams.  All starts of windows with at least `low` places, by the first place in the window."""
            def of(k: Column) -> Column:
                far = F.get(p, k + (low - 1)) - (size - 1)
                ends = F.struct(F.greatest(far, F.coalesce(F.get(p, k - 1) + 1, F.lit(0)), F.lit(0)).alias("lo"), F.least(F.get(p, k), F.size(bigrams) - size).alias("hi"))
                return let(ends, lambda e: F.when(e["lo"] <= e["hi"], F.sequence(e["lo"], e["hi"])).otherwise(ints))

            return F.when(F.size(p) >= low, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - low, F.lit(0))), of))).otherwise(ints)

        def scored(at: Column) -> Column:
            dice = let(F.array_distinct(F.slice(bigrams, at + 1, size)), lambda a: 2.0 * _count_in(a, gs) / (F.size(a) + b))
            return F.struct(at.alias("at"), dice.alias("dice"))

        def joined(m: Column) -> Column:
            heads = F.filter(F.transform(m, lambda x, i: F.when((i == 0) | (2 * (x["at"] - F.get(m, i - 1)["at"]) > size), i)), lambda i: i.isNotNull())
            one = lambda h, i, hs: F.slice(m, h + 1, F.coalesce(F.get(hs, i + 1), F.size(m)) - h)
            return let(heads, lambda hs: F.transform(hs, lambda h, i: F.struct(F.array_max(F.transform(one(h, i, hs), lambda x: x["dice"])).alias("dice"), F.lit(name).alias("license"))))

        places = F.filter(F.transform(bigrams, lambda g, i: F.when(g.isin(gs), i)), lambda i: i.isNotNull())
        return let(F.filter(F.transform(let(places, starts), scored), lambda x: x["dice"] >= threshold), joined)

    grams = [(name, template_bigrams(t), len(template_words(t)) - 1) for name, t in templates]
    grams = [x for x in grams if x[1]]
    if not grams:
        return none
    every = sorted({g for _, gs, _ in grams for g in gs})

    def by_template(shared: Column) -> Column:
        # a template without enough shared bigrams in the whole text has no window
        return F.flatten(F.array(*[F.when(_count_in(shared, gs) >= size_bounds(len(gs), threshold)[0], passages(name, gs, size)).otherwise(none) for name, gs, size in grams]))

    return let(F.filter(F.array_distinct(bigrams), lambda g: g.isin(every)), by_template)


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES, passages: bool = True) -> DataFrame:
    """doc_id and matches: array<struct<dice, license>> over all units and passages of each text.

    Every bigram of a unit or window is one of the whole text, so a text that
    has too few of each template's bigrams has none that matches, and is not
    cut.  Without ``passages``, units are the whole text, lines and sentences.
    """
    grams = [template_bigrams(t) for _, t in templates]
    every = sorted({g for gs in grams for g in gs})
    text = F.col("text")

    def enough(shared: Column) -> Column:
        # Dice reaches t only where the shared bigrams reach the lower size bound
        hits = [_count_in(shared, gs) >= size_bounds(len(gs), threshold)[0] for gs in grams]
        return (F.size(shared) > 0) & reduce(or_, hits, F.lit(False))

    possible = let(F.filter(unit_bigrams(text), lambda g: g.isin(every)), enough)
    units = F.array_distinct(F.concat(units_of(text), paragraphs_of(text))) if passages else units_of(text)
    matches = F.flatten(F.transform(units, lambda u: match_unit(u, threshold, templates)))
    if passages:
        matches = F.concat(matches, let(bigrams_of(text), lambda g: match_windows(g, threshold, templates)))
    none = F.array().cast("array<struct<dice:double,license:string>>")
    return docs.select("doc_id", text_of(docs).alias("text")).select("doc_id", F.when(possible, matches).otherwise(none).alias("matches"))


def summarise(scanned: DataFrame) -> DataFrame:
    """doc_id, n_matches, licenses (distinct names, sorted, comma-joined), best_license, best_dice."""
    best = F.array_sort(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("license"))))
    return scanned.withColumn("best", F.get(best, F.lit(0))).select(
        "doc_id",
        F.size("matches").cast("bigint").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.col("best.license").alias("best_license"),
        (-F.col("best.d")).alias("best_dice"),
    )
