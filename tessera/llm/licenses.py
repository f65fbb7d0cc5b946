"""License scans in DataFrame operations only: MinHash bands over windows, then exact containment.

Texts are split into words. Templates of like lengths share overlapping windows: each window is half
as long again as the longest of them and starts half of that length after the one before, so that a
template stands whole in some window wherever it stands. Windows whose MinHash bands meet a
template's are compared with it exactly: the share of the template's word shingles that the window
holds.

A window is hashed only if it holds words without which no template can be contained to the
threshold: of every template a few words are named that so many of its shingles hold that the rest
alone would be below it. That skips nearly all texts and loses nothing. The windows of all classes
of templates are cut in one scan of the texts, and meet the bands of their class in one join.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
#: The chance that the bands of a window that contains a template to the threshold all miss it.
MISS = 1e-4
#: Templates of so many characters together are broadcast.
BROADCAST_CHARS = 4 << 20
#: A word of a text.
WORD_BREAK = r"[^\p{L}\p{N}]+"

# Notices of public licenses, and lines that name one.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-2.0-terms": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit-line": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]

    @property
    def k(self) -> int:
        return min(SHINGLE, len(self.words))

    @property
    def shingles(self) -> list[str]:
        return sorted({" ".join(self.words[i : i + self.k]) for i in range(len(self.words) - self.k + 1)})

    @property
    def span(self) -> int:
        """The length of its class: the least of 4, 6, 9, 14 ... that it isn't longer than."""
        n = 4
        while n < len(self.words):
            n += -(-n // 2)
        return n

    def needed(self, containment: float, common: dict[str, int]) -> set[str]:
        """Words without which fewer than containment of the shingles can be there; rarer and longer words first."""
        parts, out, left = [s.split(" ") for s in self.shingles], set(), len(self.shingles)
        allowed = containment * left
        for word in sorted(set(self.words), key=lambda w: (-min(len(w), 7), -common.get(w, 0), w)):
            if left < allowed - 1e-9:
                break
            out.add(word)
            left = sum(1 for p in parts if not out & set(p))
        return out


def template(name: str, text: str) -> Template:
    return Template(name, tuple(w for w in re.split(r"[\W_]+", text.lower()) if w))


def bands_for(similarity: float, miss: float = MISS) -> int:
    """So many single-hash bands that windows of at least this similarity all miss with at most this chance."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - similarity)))


def _shingles(words: Column, k: Column) -> Column:
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>"))


def _minima(shingles: Column, n_bands: Column) -> Column:
    """An array of (band, least hash of the shingles under the band's seed)."""
    return F.transform(F.sequence(F.lit(0), n_bands - 1), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b))).alias("least")))


@dataclass(frozen=True)
class Kind:
    """A class of templates: their shingles have k words, their windows size words, one every stride; n_bands find those of enough similarity; without one of the anchors a window holds none of them."""

    number: int
    templates: tuple[Template, ...]
    anchors: tuple[str, ...]
    k: int
    stride: int
    size: int
    n_bands: int

    @classmethod
    def of(cls, number: int, templates: list[Template], needed: dict[str, set[str]], containment: float) -> Kind:
        k, span = templates[0].k, templates[0].span
        stride = -(-span // 2)
        size = span + stride
        least = min(len(t.shingles) for t in templates)
        similarity = containment * least / (size - k + 1 + (1 - containment) * least)
        return cls(number, tuple(templates), tuple(sorted(set().union(*(needed[t.name] for t in templates)))), k, stride, size, bands_for(similarity))

    def windows(self, words: str) -> Column:
        """The windows that hold an anchor, as (kind, start, words)."""
        anchors = F.array(*map(F.lit, self.anchors))
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(self.stride))
        cut = F.transform(starts, lambda i: F.struct(F.lit(self.number).alias("kind"), i.cast("long").alias("start"), F.slice(words, i + 1, F.lit(self.size)).alias("words")))
        return F.when(F.arrays_overlap(F.col(words), anchors), F.filter(cut, lambda w: F.arrays_overlap(w["words"], anchors)))


def _by_kind(kinds: list[Kind], name: str) -> Column:
    """The value that the row's kind has under this name."""
    return F.element_at(F.array(*[F.lit(getattr(x, name)) for x in kinds]), F.col("kind") + 1)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(key, license, containment, start_word) of each template that a document contains to the threshold: the greatest containment, and the first window that has it.

    Words are runs of letters and digits, lower-cased; shingles have five words, or all of a shorter
    template. Rows with the same key are one document; of windows with the same containment the first
    counts; very long texts are scanned whole; null or empty texts contain nothing; without templates
    or rows there are no results; other columns are ignored, whatever their names.
    """
    known = [t for t in (template(n, x) for n, x in (TEMPLATES if templates is None else templates).items()) if t.words]
    spark = docs.sparkSession
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, license string, containment double, start_word long"
    if not known:
        return spark.createDataFrame([], schema)
    counts: dict[str, int] = {}
    for t in known:
        for w in set(t.words):
            counts[w] = counts.get(w, 0) + 1
    needed = {t.name: t.needed(containment, counts) for t in known}
    classes = sorted({(t.k, t.span) for t in known})
    kinds = [Kind.of(i, [t for t in known if (t.k, t.span) == c], needed, containment) for i, c in enumerate(classes)]
    anchors = sorted(set().union(*needed.values()))
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    hopeful = docs.select(F.col(key).alias("_key"), lower.alias("_text")).where(_contains_any("_text", anchors))
    worded = hopeful.select("_key", F.filter(F.split("_text", WORD_BREAK), lambda w: w != "").alias("_words"))
    cut = worded.select("_key", F.explode(F.flatten(F.array_compact(F.array(*[x.windows("_words") for x in kinds])))).alias("w"))
    windows = cut.select("_key", F.col("w.kind").alias("kind"), F.col("w.start").alias("start_word"), F.col("w.words").alias("_window"))
    hashed = windows.select("_key", "kind", "start_word", _shingles(F.col("_window"), _by_kind(kinds, "k")).alias("_shingles")).where(F.size("_shingles") > 0)
    banded = hashed.select("_key", "kind", "start_word", "_shingles", F.explode(_minima(F.col("_shingles"), _by_kind(kinds, "n_bands"))).alias("b")).select("_key", "kind", "start_word", "_shingles", "b.band", "b.least")
    table = spark.createDataFrame([(x.number, t.name, t.shingles) for x in kinds for t in x.templates], "kind int, license string, _template array<string>")
    table = table.select("kind", "license", "_template", F.explode(_minima(F.col("_template"), _by_kind(kinds, "n_bands"))).alias("b")).select("kind", "license", "_template", "b.band", "b.least")
    small = sum(len(s) * x.n_bands for x in kinds for t in x.templates for s in t.shingles) <= BROADCAST_CHARS
    met = banded.join(F.broadcast(table) if small else table, ["kind", "band", "least"])
    share = F.size(F.array_intersect("_shingles", "_template")) / F.size("_template")
    found = met.select("_key", "license", share.alias("containment"), "start_word").where(F.col("containment") >= containment - 1e-9)
    best = found.groupBy("_key", "license").agg(F.max("containment").alias("containment"), F.max_by("start_word", F.struct("containment", -F.col("start_word"))).alias("start_word"))
    return best.select(F.col("_key").alias(key), "license", "containment", "start_word")


def _contains_any(text: str, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.col(text).contains(w)
    return out
