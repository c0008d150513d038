"""Operator 6, license scans: native expressions only.

A text's lines, and its paragraphs of several lines, are compared with license templates by the
Dice coefficient over distinct word bigrams of the normalised texts. A template is a candidate only if
the sizes allow the threshold: with t the threshold, a unit of n bigrams can only reach a template of
m if n is between m * t / (2 - t) and m * (2 - t) / t. A statement inside a longer unit is found by windows of the
template's length that begin with one of its bigrams.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
HITS = "array<struct<license:string,whole:boolean,dice:double>>"
# Wordings of license statements.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ],
    # What the clauses share does not say how many there are.
    "BSD": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software."
    ],
}

#: Of licenses that are worded alike: the words that a statement must hold, and those that make it another license's.
MARKS = {
    "Apache-2.0": ("2", ""), "CC-BY-4.0": ("attribution 4", "noncommercial commercial nc sharealike share sa noderivatives noderivs derivatives nd"), "CC-BY-NC-4.0": ("nc 4", "sa nd"),
    "EPL-2.0": ("2", ""), "GPL-3.0": ("3", "lesser affero library agpl lgpl"), "MPL-2.0": ("2", ""),
}


def marks_of(name: str) -> tuple[list[str], list[str]]:
    """(needed, refused) words of a license."""
    needed, refused = MARKS.get(name, ("", ""))
    return needed.split(), refused.split()


def template_words(text: str) -> list[str]:
    """The normalised words of a wording."""
    return re.findall(r"[^\W_]+", text.lower())


def template_rows(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    """(license, sorted distinct bigrams) of every wording with two words or more."""
    out = []
    for name in sorted(templates):
        for text in templates[name]:
            words = template_words(text)
            pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
            if pairs:
                out.append((name, pairs))
    return out


def signature_words(rows: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold for some template holds one.

    A unit shares at least t / (2 - t) of a template's m bigrams with it; so it shares one of any
    m - ceil(m * t / (2 - t)) + 1 of them. Those with the longest words are chosen, and of each the longest word.
    """
    out = set()
    for _, pairs in rows:
        m = len(pairs)
        spare = m - math.ceil(m * threshold / (2 - threshold) - 1e-9) + 1
        longest = sorted((max(p.split(" "), key=lambda w: (len(w), w)) for p in pairs), key=lambda w: (-len(w), w))
        out.update(longest[:spare])
    return sorted(out)


def normalised(text: Column) -> Column:
    """Lower case, letters and digits in words that one space parts."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan_licenses(
    docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """doc_id, unit_kind ('line' or 'paragraph'), unit_no (from 0), license, dice: one row per unit and license found.

    docs has doc_id and text; other columns are ignored. dice is the best of a license's wordings, for the whole unit
    or, where that does not reach the threshold, for the best window in it; a statement that lacks a license's own words (its version, say) or holds
    those of one worded alike (lesser, noncommercial) is not that license's, however like it is. A paragraph is found by a window only for
    a license that none of its lines has. A null or
    empty text has no row; repeated rows are scanned each; a null doc_id is kept as null. An empty table
    gives an empty result.
    """
    rows = template_rows(templates)
    if not rows:
        raise ValueError("no template has two words")
    lengths = [len(w) for name in sorted(templates) for w in map(template_words, templates[name]) if len(w) > 1]
    strings = lambda words: F.array(*map(F.lit, words)).cast("array<string>")
    marks = lambda name: [strings(w).alias(k) for k, w in zip(("needed", "refused"), marks_of(name), strict=True)]
    known = F.array(
        *[
            F.struct(F.lit(name).alias("license"), F.lit(len(pairs)).alias("m"), F.lit(k - 1).alias("k"), F.array(*map(F.lit, pairs)).alias("pairs"), *marks(name))
            for (name, pairs), k in zip(rows, lengths, strict=True)
        ]
    )
    every = F.array(*map(F.lit, sorted({p for _, pairs in rows for p in pairs})))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    fewest = min(len(p) for _, p in rows) * low
    signs = signature_words(rows, threshold)

    def may_match(c: Column) -> Column:
        low, out = F.lower(c), F.lit(False)
        for w in signs:
            out = out | F.contains(low, F.lit(w))
        return out

    text = F.regexp_replace("text", r"\r\n?", "\n")
    unit = lambda kind, cut, keep: F.filter(
        F.transform(
            F.split(text, cut),
            lambda x, i: F.struct(F.lit(kind).alias("unit_kind"), i.alias("unit_no"), x.alias("x")),
        ),
        keep,
    )
    lines = unit("line", "\n", lambda u: F.length(u["x"]) > 2)
    paragraphs = unit("paragraph", r"\n[ \t]*\n", lambda u: F.contains(F.trim(u["x"]), F.lit("\n")))
    units = docs.filter(F.col("text").isNotNull() & may_match(F.col("text"))).select("doc_id", F.explode(F.concat(lines, paragraphs)).alias("u"))
    words = units.filter(may_match(F.col("u.x"))).select("doc_id", "u.unit_kind", "u.unit_no", "u.x")

    def hits(x: Column) -> Column:
        """License, dice and whole of a unit: of each license the best wording, and whether the whole unit reaches it."""

        def dice(pairs: Column, t: Column) -> Column:
            return 2.0 * F.size(F.array_intersect(pairs, t["pairs"])) / (F.size(pairs) + t["m"])

        def sound(pairs: Column, t: Column, d: Column) -> Column:
            """d, or 0 where it would reach the threshold without the license's own words or with another's."""

            def own(words: Column) -> Column:
                return (F.size(F.array_intersect(words, t["needed"])) == F.size(t["needed"])) & ~F.arrays_overlap(words, t["refused"])

            words = lambda: F.flatten(F.transform(pairs, lambda p: F.split(p, " ")))
            return F.when(d < threshold, d).when(_let(words(), own), d).otherwise(0.0)

        def best_window(b: Column, t: Column) -> Column:
            starts = F.filter(F.transform(b, lambda p, i: F.when(F.array_contains(t["pairs"], p), i + 1)), lambda i: i.isNotNull())
            return F.coalesce(F.array_max(F.transform(starts, lambda i: _let(F.array_distinct(F.slice(b, i, t["k"])), lambda s: _let(dice(s, t), lambda d: sound(s, t, d))))), F.lit(0.0))

        def scored(b: Column, near: Column) -> Column:
            whole = lambda pairs, t: F.when((F.size(pairs) >= t["m"] * F.lit(low)) & (F.size(pairs) <= t["m"] * F.lit(high)), dice(pairs, t)).otherwise(0.0)
            one = lambda t, d: F.struct(t["license"].alias("license"), (d >= threshold).alias("whole"), F.when(d >= threshold, d).otherwise(best_window(b, t)).alias("dice"))
            of_all = _let(F.array_distinct(b), lambda pairs: F.transform(near, lambda t: _let(_let(whole(pairs, t), lambda d: sound(pairs, t, d)), lambda d: one(t, d))))
            return _let(F.filter(of_all, lambda h: h["dice"] >= threshold), first_of_each)

        def first_of_each(some: Column) -> Column:
            better = lambda h, o: (o["license"] == h["license"]) & ((o["whole"] & ~h["whole"]) | ((o["whole"] == h["whole"]) & (o["dice"] > h["dice"])))
            return F.array_distinct(F.filter(some, lambda h: ~F.exists(some, lambda o: better(h, o))))

        def candidates(shared: Column) -> Column:
            return F.filter(known, lambda t: F.size(F.array_intersect(shared, t["pairs"])) >= t["m"] * F.lit(low) - 1e-9)

        def of_bigrams(b: Column) -> Column:
            near = _let(F.array_intersect(b, every), lambda shared: F.when(F.size(shared) >= fewest - 1e-9, candidates(shared)))
            return _let(near, lambda n: F.when(F.size(n) > 0, scored(b, n)))

        def of_words(w: Column) -> Column:
            pairs = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
            return F.when(F.size(w) > int(fewest), _let(pairs, of_bigrams))

        return _let(F.split(normalised(x), " "), of_words)

    # Outer, as else the hits would be worked out once more to filter them.
    found = words.withColumn("h", F.explode_outer(hits(F.col("x")))).filter("h IS NOT NULL")
    # Licenses of a paragraph's lines, where a window is all that was found in it.
    lines = F.flatten(F.transform(F.split("x", "\n"), lambda y: F.when(may_match(y), F.transform(F.coalesce(hits(y), F.array().cast(HITS)), lambda h: h["license"])).otherwise(F.array().cast("array<string>"))))
    own = F.when((F.col("unit_kind") == "line") | F.col("h.whole"), True).otherwise(~F.array_contains(lines, F.col("h.license")))
    return found.filter(own).select("doc_id", "unit_kind", "unit_no", "h.license", "h.dice")
