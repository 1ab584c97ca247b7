"""Quality rules: simple counts, and divergence of a document from its language's reference histograms.

A reference has two histograms of all documents of a language: of character classes, and of the common words, which are
those that make up LEAST_SHARE of the language's words or more. Common words are found with a bounded summary of each
partition that can't miss such a word (Misra-Gries), then counted exactly. A document is compared by Jensen-Shannon distance
(the square root of the divergence in bits, 0 to 1).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field as setting

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, map_arrow, pieces, stored, without
from .pretokens import code_points

GAPS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Character classes of the histograms.
CLASSES = ("space", "break", "digit", "upper", "lower", "lower_other", "punctuation", "symbol", "other")


@dataclass(frozen=True)
class Limits:
    """Parameters of the divergence rule."""

    least_share: float = 0.002  # of a language's words, for a common word
    kept_words: int = 2000  # counters of a partition's summary; above 1 / least_share
    least_words: int = 50  # of a document that is compared
    least_reference_words: int = 2000  # of a language that documents are compared to
    class_limit: float = 0.30  # largest distance of character classes
    word_limit: float = 0.18  # largest distance of common words for an endless text ...
    word_noise: float = 2.0  # ... plus this over the square root of the number of words: chance in short texts
    most_languages: int = 1000  # more are refused, as every task gets all references


@dataclass
class Reference:
    classes: np.ndarray
    words: dict[bytes, int] = setting(default_factory=dict)
    shares: np.ndarray = setting(default_factory=lambda: np.ones(1))  # of the words, and of all others together


def _class_of(c: str) -> int:
    if c == " ":
        return 0
    if c in GAPS:
        return 1
    if c.isdigit():
        return 2
    if c.isupper():
        return 3
    if c.islower():
        return 4 if c.isascii() else 5
    if c in ".,;:!?'\"()-":
        return 6
    return 7 if c.isascii() else 8


_CLASS_TABLE: list[np.ndarray] = []


def class_table() -> np.ndarray:
    if not _CLASS_TABLE:
        _CLASS_TABLE.append(np.fromiter((_class_of(chr(i)) for i in range(0x110000)), dtype=np.uint8, count=0x110000))
    return _CLASS_TABLE[0]


def class_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of the character classes, one row for each text."""
    cp, bounds = code_points(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    return np.bincount(row * len(CLASSES) + class_table()[cp], minlength=len(texts) * len(CLASSES)).reshape(len(texts), len(CLASSES))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text; zeros for a null one."""
    if not text:
        return 0, 0, 0, 0, 0
    words = words_of(text)
    chars = len(text) - sum(map(text.count, GAPS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(GAPS)]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        count = Counter(windows)
        covered = bytearray(len(words))
        for i, w in enumerate(windows):
            if count[w] > 1:
                covered[i : i + 3] = b"\1\1\1"
        repeated = sum(covered)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def summarize(counts: Counter, keep: int) -> Counter:
    """The counters reduced to `keep` by Misra-Gries: all lose what the largest dropped one has."""
    if len(counts) <= keep:
        return counts
    least = sorted(counts.values(), reverse=True)[keep]
    return Counter({w: n - least for w, n in counts.items() if n > least})


HIST = "lang string, kind string, word binary, n long"


def _histograms(docs: DataFrame, text: str, lang: str, candidates: dict[str, list[bytes]] | None, limits: Limits) -> DataFrame:
    """Per language the class counts ('c0', ...), the number of words ('n') and either summaries of the words or exact counts of the candidates ('w')."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[str, np.ndarray] = {}
        totals: Counter = Counter()
        found: dict[str, Counter] = {}
        wanted = {k: frozenset(v) for k, v in candidates.items()} if candidates is not None else None
        for batch in batches:
            for part in pieces(batch, "text"):
                langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
                if wanted is None:
                    for name, row in zip(langs, class_counts(texts), strict=True):
                        classes[name] = classes.get(name, 0) + row
                for name, t in zip(langs, texts, strict=True):
                    words = words_of(t.lower())
                    if len(words) < limits.least_words:
                        continue
                    counter = found.setdefault(name, Counter())
                    if wanted is None:
                        totals[name] += len(words)
                        counter.update(words)
                        if len(counter) > 8 * limits.kept_words:
                            found[name] = summarize(counter, limits.kept_words)
                    elif name in wanted:
                        counter.update(filter(wanted[name].__contains__, words))
        rows = [(k, f"c{i}", None, int(n)) for k, row in classes.items() for i, n in enumerate(row)] + [(k, "n", None, n) for k, n in totals.items()]
        rows += [(k, "w", w, n) for k, c in found.items() for w, n in (summarize(c, limits.kept_words) if wanted is None else c).items()]
        yield pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "kind": [r[1] for r in rows], "word": pa.array([r[2] for r in rows], type=pa.binary()), "n": pa.array([r[3] for r in rows], type=pa.int64())})

    source = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    return map_arrow(source, run, HIST).groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))


def fit_references(docs: DataFrame, text: str = "text", lang: str = "lang", limits: Limits = Limits()) -> dict[str, Reference]:
    """A reference for each language with enough words, over all documents with a language and enough words of their own.

    What comes to the driver is bounded: for each language its class counts and fewer than 1 / (least_share - 1 / kept_words)
    words.
    """
    first = _histograms(docs, text, lang, None, limits)
    first = stored(first, "histograms")
    totals = {r["lang"]: r["n"] for r in first.where(f"kind = 'n' and n >= {limits.least_reference_words}").limit(limits.most_languages + 1).collect()}
    if len(totals) > limits.most_languages:
        raise ValueError(f"more than {limits.most_languages} languages")
    if not totals:
        return {}
    out = {name: Reference(np.zeros(len(CLASSES))) for name in totals}
    for r in first.where(F.col("kind").startswith("c") & F.col("lang").isin(list(totals))).collect():
        out[r["lang"]].classes[int(r["kind"][1:])] = r["n"]
    least = limits.least_share - 1 / (limits.kept_words + 1)
    sums = first.where("kind = 'n'").select("lang", F.col("n").alias("total"))
    likely = first.where("kind = 'w'").join(sums, "lang").where((F.col("n") >= least * F.col("total")) & F.col("lang").isin(list(totals)))
    candidates: dict[str, list[bytes]] = {}
    for r in likely.select("lang", "word").collect():
        candidates.setdefault(r["lang"], []).append(bytes(r["word"]))
    exact: dict[str, dict[bytes, int]] = {}
    for r in _histograms(docs, text, lang, candidates, limits).collect():
        exact.setdefault(r["lang"], {})[bytes(r["word"])] = r["n"]
    for name, ref in out.items():
        ref.classes /= ref.classes.sum()
        common = sorted(w for w, n in exact.get(name, {}).items() if n >= limits.least_share * totals[name])
        shares = [exact[name][w] / totals[name] for w in common]
        ref.words = {w: i for i, w in enumerate(common)}
        ref.shares = np.array([*shares, max(0.0, 1 - sum(shares))])
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms that each sum to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return math.sqrt(max(0.0, parts.sum() / 2))


def divergence(text: str, classes: np.ndarray, ref: Reference) -> tuple[float, float]:
    """Distances of the character classes and of the common words."""
    words = words_of(text.lower())
    counts = np.zeros(len(ref.words) + 1)
    other = len(ref.words)
    for i, n in Counter(map(ref.words.get, words)).items():
        counts[other if i is None else i] = n
    return js_distance(classes / classes.sum(), ref.classes), js_distance(counts / len(words), ref.shares)


MEASURES = [T.StructField(n, T.LongType(), False) for n in BASE] + [T.StructField("base_failed", T.BooleanType(), False), T.StructField("class_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()), T.StructField("kept", T.BooleanType(), False)]


def judge(docs: DataFrame, references: dict[str, Reference], text: str = "text", lang: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """docs with the base counts, base_failed, class_distance, word_distance and kept.

    A null text has no words and fails. A text that passes the base rules is compared with its language's reference; without
    a language it is compared with the nearest one, and where there is no reference it is kept with null distances. It is
    kept if both distances are within the limits. Rows are independent; columns with the names of new ones are replaced.
    """
    tagged = docs.withColumn("__both", F.concat(F.coalesce(F.length(lang), F.lit(0)).cast("string"), F.lit(":"), F.coalesce(F.col(lang), F.lit("")), F.coalesce(F.col(text), F.lit(""))))

    def run(values: list) -> list:
        parts = [(v[at + 1 : (end := at + 1 + int(v[:at]))], v[end:]) for v in values for at in (v.index(":"),)]  # the language's length comes first
        langs, texts = zip(*parts, strict=True)
        out: list[list] = [[] for _ in MEASURES]
        for name, t, classes in zip(langs, texts, class_counts(list(texts)), strict=True):
            base = base_counts(t)
            failed = base[0] < limits.least_words or 100 * base[4] > 50 * base[0]
            refs = [references[name]] if name in references else list(references.values()) if not name else []
            near: tuple[float | None, float | None] = (None, None)
            kept = not failed
            if kept and refs:
                near = min((divergence(t, classes, r) for r in refs), key=sum)
                kept = near[0] <= limits.class_limit and near[1] <= limits.word_limit + limits.word_noise / math.sqrt(base[0])
            for column, x in zip(out, (*base, failed, *near, kept), strict=True):
                column.append(x)
        return out

    judged = add_columns(tagged, "__both", MEASURES, lambda: run)
    return without(judged, ["__both"])
