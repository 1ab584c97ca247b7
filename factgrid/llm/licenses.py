"""License scan: MinHash bands over overlapping word windows retrieve templates, exact shingle containment verifies them.

Shingles are SHINGLE words in lower case without punctuation. A document's windows are three blocks of four shingles, one
block apart, so any four-shingle stretch lies in three windows and any nine shingles lie whole in one. A template (or, if it
is longer than a window, each of its windows at every place) is indexed under BANDS hash functions, one row a band: a window
that holds a template of m shingles has a Jaccard similarity of m / WINDOW or more with it, and so misses it with
probability (1 - m / WINDOW)^BANDS at most: below 1e-5 for templates of three shingles with 40 bands. Shorter ones, which must be there whole, are also looked up by
their first shingle at every place, so none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, mixed, pieces
from .decontaminate import plain
from .pretokens import BASE, INVERSE, HashIndex

SHINGLE, BLOCK, BLOCKS, BANDS = 3, 4, 3, 40
LEAST_BANDED = 3  # shingles from which the bands find a template
WINDOW = BLOCK * BLOCKS
LEAST_CONTAINMENT = 0.9

#: Statements and notices by which texts are put under a license.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    "GPL-3.0": (
        "licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "LGPL": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "AGPL-3.0": ("licensed under the GNU Affero General Public License, version 3.",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.", "All rights reserved. No part of this publication may be reproduced",),
}


@dataclass
class Words:
    """The words of many texts: hashes, bounds of the texts in them, and each word's first and last place in its text."""

    hashes: np.ndarray
    bounds: np.ndarray
    first: np.ndarray
    last: np.ndarray


def words(texts: list[str | None]) -> Words:
    cp, bounds, place = plain(texts)
    letter = cp != 0x20
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    opening = bounds[:-1][bounds[:-1] < len(cp)]
    start[opening] = letter[opening]
    begin = np.flatnonzero(start)
    stop = letter.copy()
    stop[:-1] &= ~letter[1:] | start[1:]
    end = np.flatnonzero(stop)
    n = len(cp)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.append(np.uint64(1), np.full(n, BASE, dtype=np.uint64)), dtype=np.uint64)
        inverse = np.cumprod(np.append(np.uint64(1), np.full(n, INVERSE, dtype=np.uint64)), dtype=np.uint64)
        sums = np.append(np.uint64(0), np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64))
        h = mixed((sums[end + 1] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    return Words(h, np.searchsorted(begin, bounds), place[begin], place[end])


def shingles(h: np.ndarray) -> np.ndarray:
    """Hash of the SHINGLE words from each place on; fewer words are one shingle."""
    if not len(h):
        return h
    size = min(SHINGLE, len(h))
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - size + 1, dtype=np.uint64)
        for k in range(size):
            out = out * np.uint64(BASE) + h[k : len(h) - size + 1 + k]
    return mixed(out, 1)


_FACTORS = mixed(np.arange(BANDS, dtype=np.uint64), 7) | np.uint64(1)


class TemplateIndex:
    def __init__(self, templates: dict[str, tuple[str, ...]]):
        self.names, sets, keys, owners = [], [], [], []
        short: dict[int, list[int]] = {}
        for name, texts in templates.items():
            for t in texts:
                s = shingles(words([t]).hashes)
                self.names.append(name)
                sets.append(s)
                if 0 < len(s) < LEAST_BANDED:
                    short.setdefault(int(s[0]), []).append(len(self.names) - 1)
                for a in range(max(1, len(s) - WINDOW + 1)):
                    with np.errstate(over="ignore"):
                        low = (s[a : a + WINDOW][:, None] * _FACTORS).min(axis=0)
                    keys.append(self.key(low, np.arange(BANDS)))
                    owners.append(np.full(BANDS, len(self.names) - 1))
        self.sets = sets
        self.short = list(short.values())
        self.opening = HashIndex(max(1, len(short)))
        self.opening.add(np.array(list(short), dtype=np.uint64), np.arange(len(short), dtype=np.int32))
        self.length = np.array([len(s) for s in sets])
        key, owner = np.concatenate(keys), np.concatenate(owners)
        pairs = np.unique(np.stack([key.astype(np.uint64), owner.astype(np.uint64)], axis=1), axis=0)
        distinct, self.first, self.count = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        self.owner = pairs[:, 1].astype(np.int64)
        self.index = HashIndex(len(distinct))
        self.index.add(distinct, np.arange(len(distinct), dtype=np.int32))

    @staticmethod
    def key(low: np.ndarray, band: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(low + band.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03), 2)

    def search(self, texts: list[str | None]) -> list[tuple[int, str, int, int, float]]:
        """(text, license, start, end, containment) of each match, by text and start; offsets are code points of the text.

        Of a license's templates that match at overlapping places the one with the most shingles is given.
        """
        w = words(texts)
        each = [shingles(w.hashes[a:b]) for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)]
        blocks = np.array([-(-len(s) // BLOCK) for s in each], dtype=np.int64)
        before = np.cumsum(blocks) - blocks
        total = int(blocks.sum())
        if not total:
            return []
        flat = np.zeros(total * BLOCK, dtype=np.uint64)
        for s, a, n in zip(each, before.tolist(), blocks.tolist(), strict=True):
            flat[a * BLOCK : a * BLOCK + len(s)] = s
            if len(s):
                flat[a * BLOCK + len(s) : (a + n) * BLOCK] = s[-1]  # repeats change no minimum
        candidates: set[tuple[int, int]] = set()
        for band in range(BANDS):
            with np.errstate(over="ignore"):
                low = (flat * _FACTORS[band]).reshape(-1, BLOCK).min(axis=1)
            wide = low.copy()
            for k in range(1, BLOCKS):
                wide[:-k] = np.minimum(wide[:-k], low[k:])
            found = self.index.find(self.key(wide, np.full(len(wide), band)))
            for i in np.flatnonzero(found >= 0).tolist():
                a, n = self.first[found[i]], self.count[found[i]]
                candidates.update((i, int(o)) for o in self.owner[a : a + n])
        found = self.opening.find(flat)
        for i in np.flatnonzero(found >= 0).tolist():
            candidates.update((i // BLOCK, o) for o in self.short[found[i]])
        regions: dict[tuple[int, int], list[list[int]]] = {}
        for i, owner in sorted(candidates):
            for row in {int(np.searchsorted(before, i, side="right")) - 1, int(np.searchsorted(before, min(total - 1, i + BLOCKS - 1), side="right")) - 1}:
                at = (i - int(before[row])) * BLOCK
                reach = int(self.length[owner])
                a, b = max(0, at - reach), min(len(each[row]), at + WINDOW + reach)
                spans = regions.setdefault((row, owner), [])
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                elif a < b:
                    spans.append([a, b])
        matches = []
        for (row, owner), spans in regions.items():
            template = np.unique(self.sets[owner])
            for a, b in spans:
                matches += [(row, owner, x, y, c) for x, y, c in self.verify(each[row][a:b], template, a)]
        return self.chosen(matches, w)

    def verify(self, region: np.ndarray, template: np.ndarray, offset: int) -> Iterator[tuple[int, int, float]]:
        """(first shingle, last shingle, containment) of each stretch of the region that holds enough of the template."""
        hits = np.flatnonzero(np.isin(region, template))
        which = np.searchsorted(template, region[hits]).tolist()
        at, size = hits.tolist(), len(template)
        count, distinct, i, end = [0] * size, 0, 0, 0  # of the hits from i to end, which are at most twice the template apart
        while i < len(at):
            while end < len(at) and at[end] < at[i] + 2 * size:
                distinct += not count[which[end]]
                count[which[end]] += 1
                end += 1
            step = i + 1
            if distinct / size >= LEAST_CONTAINMENT:
                seen: set[int] = set()
                last = i
                for k in range(i, end):
                    if which[k] not in seen:
                        seen.add(which[k])
                        last = k  # where the last new shingle comes
                yield offset + at[i], offset + at[last], distinct / size
                step = last + 1
            for k in range(i, min(step, end)):
                count[which[k]] -= 1
                distinct -= not count[which[k]]
            i = step

    def chosen(self, matches: list[tuple[int, int, int, int, float]], w: Words) -> list[tuple[int, str, int, int, float]]:
        out: list[tuple[int, str, int, int, float]] = []
        taken: dict[tuple[int, str], list[tuple[int, int]]] = {}
        for row, owner, x, y, share in sorted(matches, key=lambda m: (m[0], -len(self.sets[m[1]]), m[2], m[1])):
            spans = taken.setdefault((row, self.names[owner]), [])
            if any(x <= b and a <= y for a, b in spans):
                continue
            spans.append((x, y))
            base, end = int(w.bounds[row]), int(w.bounds[row + 1])
            last = min(end - 1, base + y + SHINGLE - 1)
            out.append((row, self.names[owner], int(w.first[base + x]), int(w.last[last]) + 1, share))
        return sorted(out)


def find_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """A row for each license statement of a document: the key (named as in docs), license, start, end, containment.

    containment is the share of the template's distinct shingles found, LEAST_CONTAINMENT or more. Null and empty texts have
    no rows; repeated rows each have their own; other columns are not read. Templates are given by the caller or the fixed
    ones, and go to every task: more than 10,000 are refused.
    """
    known = TEMPLATES if templates is None else templates
    if sum(map(len, known.values())) > 10_000:
        raise ValueError("more than 10,000 templates")
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(known)
        for batch in batches:
            for part in pieces(batch, "text"):
                found = index.search(part.column("text").to_pylist())
                keys = part.column("key").take(pa.array([f[0] for f in found], type=pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array([f[1] for f in found], type=pa.string()), pa.array([f[2] for f in found], type=pa.int32()), pa.array([f[3] for f in found], type=pa.int32()), pa.array([f[4] for f in found], type=pa.float64())], names=["key", "license", "start", "end", "containment"])

    return map_arrow(source, run, f"key {dict(docs.dtypes)[key]}, license string, start int, end int, containment double").withColumnRenamed("key", key)
