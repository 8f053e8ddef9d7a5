"""Licence scan [native]: texts compared with licence templates by the Dice coefficient over word bigrams.

A text's units are itself, its paragraphs, its lines and its sentences; a unit is normalised to lower-case words of
letters and digits. A unit matches a template if 2 * shared bigrams / (bigrams of both), with repeats, is at least
``threshold``. Size bounds prune: that can hold only if the unit has between t / (2 - t) and (2 - t) / t times the
template's bigrams, so a unit is compared with the templates of its size alone. Before that, texts are pruned by
anchor words: a unit that matches misses fewer bigrams than the anchors touch, so a text without any anchor word
of a template can't match it. Neither bound loses a match. All of it is built-in expressions on one row each: no
shuffle, no Python.

Edge cases: null and empty texts, and units of under two words, match nothing. Ties between templates go to the
smaller name. Repeated rows each get their row; an empty table gives an empty result. A column called like the result
is kept with ``_input`` after its name.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.llm.common import ascii_lower, free_name, set_aside

THRESHOLD = 0.8
#: Notices by which texts declare a licence, and short licence texts (fixed values, public).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Words too common to serve as anchors (fixed values).
COMMON = set("a an and any are at be by for from in is it of on or that the this to under was with".split())


def normal(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def bigrams(text: str) -> list[str]:
    w = normal(text)
    return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def anchors(template: str, threshold: float) -> list[str]:
    """Words such that every matching unit has one of them: they touch more bigrams than a match may miss."""
    pairs = bigrams(template)
    left, out = list(pairs), []
    need = len(pairs) - math.ceil(len(pairs) * threshold / (2 - threshold) - 1e-9) + 1
    while len(pairs) - len(left) < need:
        words = sorted({w for p in left for w in p.split()}, key=lambda w: (w in COMMON, -sum(w in p.split() for p in left), -len(w), w))
        out.append(words[0])
        left = [p for p in left if words[0] not in p.split()]
    return out


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), "[^a-z0-9]+"), lambda w: w != "")


def units(text: Column) -> Column:
    """The distinct word lists of the text, its paragraphs, lines and sentences."""
    parts = F.concat(F.array(text), F.split(text, r"\n[ \t\r]*\n"), F.split(text, r"[\n\r]+"), F.split(text, r"(?<=[.!?])[ \t\n\f\r]+"), F.split(text, r"[\n\r]+|(?<=[.!?])[ \t\n\f\r]+"))
    return F.array_distinct(F.transform(F.array_distinct(parts), _words))


def _same(p: str):
    return lambda x: x == p


def _dice(unit: Column, pairs: list[str]) -> Column:
    """Of a list of the unit's bigrams and a template's."""
    count = {p: pairs.count(p) for p in dict.fromkeys(pairs)}
    once = [p for p, c in count.items() if c == 1]
    shared = F.size(F.array_intersect(unit, F.array(*map(F.lit, once)))) if once else F.lit(0)
    for p, c in count.items():
        if c > 1:
            shared = shared + F.least(F.size(F.filter(unit, _same(p))), F.lit(c))
    return 2.0 * shared / (F.size(unit) + len(pairs))


def matches(text: Column, templates: dict[str, str], threshold: float) -> Column:
    """array<struct<licence, dice, words>>: a unit's best template each, for units that match one."""
    by = {k: bigrams(t) for k, t in sorted(templates.items())}

    def best(unit: Column) -> Column:
        n = F.size(unit)
        scored = [
            F.struct((-F.when(n.between(math.ceil(len(p) * threshold / (2 - threshold) - 1e-9), math.floor(len(p) * (2 - threshold) / threshold + 1e-9)), _dice(unit, p)).otherwise(0.0)).alias("d"), F.lit(k).alias("licence"))
            for k, p in by.items()
        ]
        return F.array_min(F.array(*scored))

    sizes = [len(p) for p in by.values()]
    low, high = min(sizes) * threshold / (2 - threshold), max(sizes) * (2 - threshold) / threshold
    sized = F.filter(units(text), lambda w: (F.size(w) - 1).between(math.ceil(low - 1e-9), math.floor(high + 1e-9)))
    paired = F.transform(sized, lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b)))
    found = F.transform(paired, lambda u: F.struct(best(u).alias("m"), (F.size(u) + 1).alias("words")))
    kept = F.filter(found, lambda f: -f.m.d >= threshold - 1e-12)
    return F.transform(kept, lambda f: F.struct(f.m.licence.alias("licence"), (-f.m.d).alias("dice"), f.words.alias("words")))


def scan(df: DataFrame, text: str, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, out: str = "licences") -> DataFrame:
    """``df`` with ``out``: array<struct<licence, dice, words>>, by licence, then falling Dice; empty if none."""
    templates = TEMPLATES if templates is None else templates
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold must be in 0.5..1")
    if any(len(bigrams(t)) < 1 for t in templates.values()):
        raise ValueError("a template needs two words at least")
    words = sorted({a for t in templates.values() for a in anchors(t, threshold)})
    none = F.array().cast("array<struct<licence:string,dice:double,words:int>>")
    name = free_name(df, out)
    if not words:
        got = df.withColumn(name, none)
    else:
        # An anchor stands between bytes that normalisation takes for no part of a word.
        maybe = F.col(text).rlike(f"(?i)(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])")
        ordered = F.array_sort(matches(F.col(text), templates, threshold), lambda a, b: F.when(a.licence < b.licence, -1).when(a.licence > b.licence, 1).when(a.dice > b.dice, -1).when(a.dice < b.dice, 1).otherwise(a.words - b.words))
        got = df.withColumn(name, F.when(F.coalesce(maybe, F.lit(False)), ordered).otherwise(none))
    return set_aside(got, out).withColumnRenamed(name, out)
