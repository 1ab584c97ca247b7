"""Language identification by rank-order profiles of character n-grams and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, map_arrow, pieces
from .pretokens import LETTER, character_classes, code_points

#: Stands for a word's start or end; the code point isn't a letter's.
BOUNDARY = 1
#: Most frequent n-grams of a profile and of a document, longest n-gram, n-grams that a task gathers before it passes them on.
PROFILE, LONGEST, GATHERED = 400, 3, 1 << 20
MOST_LANGUAGES = 1000
UNKNOWN = "und"


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (n = 1 to 3) of all texts as 64-bit codes, 21 bits a character, and the row of each.

    Texts are lower-cased; every run of characters that aren't letters, and a text's start and end, is one boundary.
    """
    cp, bounds = code_points([t.lower() + "\x01" if t else "\x01" for t in texts])
    letter = character_classes()[cp] == LETTER
    first = np.zeros(len(cp), dtype=bool)
    first[bounds[:-1]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~first[1:]
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))[keep]
    c = np.where(letter, cp, BOUNDARY).astype(np.int64)[keep]
    if not len(c):
        return c, row
    opening = np.concatenate([[True], row[1:] != row[:-1]])
    c = np.insert(c, np.flatnonzero(opening), BOUNDARY)  # the boundary before a text's first letter
    row = np.insert(row, np.flatnonzero(opening), row[opening])
    codes, rows = [c[c != BOUNDARY]], [row[c != BOUNDARY]]
    code, same = c, np.ones(len(c), dtype=bool)
    for n in range(2, LONGEST + 1):
        code = (code[:-1] << 21) | c[n - 1 :]
        same = row[n - 1 :] == row[: len(row) - n + 1]
        inner = same.copy()
        if n == LONGEST:  # a boundary in the middle joins two words
            inner &= c[1:-1] != BOUNDARY
        codes.append(code[inner])
        rows.append(row[n - 1 :][inner])
    return np.concatenate(codes), np.concatenate(rows)


def ranked(codes: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes, in order of frequency, then code."""
    distinct, counts = np.unique(codes, return_counts=True)
    return distinct[np.lexsort((distinct, -counts))[:most]]


def by_text(texts: list[str | None]) -> Iterator[np.ndarray]:
    codes, rows = grams(texts)
    order = np.argsort(rows, kind="stable")
    yield from np.split(codes[order], np.searchsorted(rows[order], np.arange(1, len(texts))))


@dataclass
class Profiles:
    """The ranks of each n-gram (sorted by code) in each language; PROFILE where a language lacks it."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray

    def nearest(self, codes: np.ndarray) -> tuple[str, float]:
        """The language of the least out-of-place distance, and 1 minus its share of the largest possible one."""
        top = ranked(codes)
        if not len(top) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        known = self.codes[at] == top
        ranks = np.where(known[:, None], self.ranks[at], PROFILE)
        places = np.where(ranks == PROFILE, PROFILE, np.abs(ranks - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(places.argmin())
        return self.languages[best], float(1 - places[best] / (PROFILE * len(top)))


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all documents with a text and a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            codes, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return codes, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        def flushed() -> Iterator[pa.RecordBatch]:
            for name, parts in gathered.items():
                codes, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), type=pa.string()), pa.array(codes), pa.array(n)], names=["lang", "gram", "n"])
            gathered.clear()

        for batch in batches:
            for part in pieces(batch, "text"):
                langs = part.column("lang").to_pylist()
                texts: dict[str, list[str]] = {}
                for name, t in zip(langs, part.column("text").to_pylist(), strict=True):
                    texts.setdefault(name, []).append(t)
                for name, some in texts.items():
                    codes, n = np.unique(grams(some)[0], return_counts=True)
                    parts = gathered.setdefault(name, [])
                    parts.append((codes, n))
                    if len(parts) > 8:
                        gathered[name] = [merged(parts)]
                size = sum(len(p[0]) for parts in gathered.values() for p in parts)
                if size > GATHERED:
                    gathered.update({k: [merged(v)] for k, v in gathered.items()})
                    if sum(len(p[0]) for parts in gathered.values() for p in parts) > GATHERED // 2:
                        yield from flushed()
        yield from flushed()

    source = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    return map_arrow(source, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """A profile for each language of the documents, over all of them. The driver gets PROFILE rows a language."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = count_grams(docs, text, lang).withColumn("place", F.row_number().over(order)).where(F.col("place") <= PROFILE)  # in this form groups are cut before the shuffle
    rows = top.select("lang", "gram", (F.col("place") - 1).alias("rank")).limit(PROFILE * MOST_LANGUAGES + 1).collect()
    if len(rows) > PROFILE * MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted({r["lang"] for r in rows})
    codes = np.unique(np.array([r["gram"] for r in rows], dtype=np.int64))
    ranks = np.full((len(codes), len(languages)), PROFILE, dtype=np.int64)
    for r in rows:
        ranks[np.searchsorted(codes, r["gram"]), languages.index(r["lang"])] = r["rank"]
    return Profiles(languages, codes, ranks)


FIELDS = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)]


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1), from the whole text only.

    A null text, or one without a letter, is `und` with score 0, as is every text where no profile was learned; of two
    languages at one distance the first by name is taken. Columns called like the new ones are replaced.
    """

    def run(texts: list) -> list:
        found = [profiles.nearest(codes) for codes in by_text(texts)]
        return [[x[0] for x in found], [x[1] for x in found]]

    return add_columns(docs, text, FIELDS, lambda: run)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0; a null id counts as an empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
