"""Benchmark decontamination by the q-gram lemma, overlapping diagonal bands and banded alignment.

Texts are compared in a plain form: lower case, letters and digits, one space for anything between. Every benchmark item is
cut into overlapping windows, so many that each stretch of Budget.least_leak characters holds a whole one. A document leaks a window if one of its substrings is within the window's edit budget. By the
q-gram lemma such a substring shares at least len - q + 1 - q * budget q-grams with the window, and all of them lie on
diagonals (place in the document minus place in the window) that differ by at most the budget. So hits are counted in bands
of diagonals that overlap by the budget, and the bands that reach the bound are aligned.

Windows of one text are searched for once. Of q-grams that many windows have, hits are written out only for windows that
reach the bound by such q-grams alone; any other must share some of its rarer ones, by as many as its common ones fall short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import kept, map_arrow, pieces, ranges, sent_if_few, stored
from .pretokens import LETTER, NUMBER, HashIndex, character_classes, code_points, powers


@dataclass(frozen=True)
class Budget:
    """Parameters. A window is the whole item where that is shorter; an item with fewer than q characters is leaked by documents
    that are equal to it in plain form. common and most_pairs change the work, not the result.

    Items of up to two windows are searched for whole, too, as they may have more edits than a window. Of two adjacent
    windows one has at most half of their edits, so a leak of both within the rate shows in one of them.
    """

    q: int = 12
    window: int = 60
    stride: int = 15
    edit_rate: float = 0.05
    band: int = 16
    block_chars: int = 8 << 20  # of benchmark text that is searched for in one pass over the documents
    common: int = 64  # places in windows from which on a q-gram is common
    most_pairs: int = 2 << 20  # of hits and windows that are held at a time

    @property
    def least_leak(self) -> int:
        """Plain characters of an item from which an excerpt with at most a window's edits is always found."""
        return self.window + self.stride - 1

    def starts(self, length: int) -> list[int]:
        """Places of the windows in an item; the last two are adjacent."""
        last = max(0, length - self.window)
        return sorted({*range(0, last + 1, self.stride), last, max(0, last - self.window)})

    def edits(self, length: int) -> int:
        return int(length * self.edit_rate)

    def least(self, length: int) -> int:
        """The q-gram bound, at least 1."""
        return max(1, length - self.q + 1 - self.q * self.edits(length))


@kept(1)
def _lower() -> np.ndarray:
    out = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        if len(c := chr(i).lower()) == 1:
            out[i] = ord(c)
    return out


def plain(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Plain code points of all texts, the texts' bounds in them, and each one's place in its own text."""
    cp, bounds = code_points(texts)
    kind = character_classes()[cp]
    word = (kind == LETTER) | (kind == NUMBER)
    first = np.zeros(len(cp) + 1, dtype=bool)
    first[bounds] = True
    keep = word.copy()
    keep[1:] |= word[:-1] & ~first[1:-1]
    at = np.flatnonzero(keep)
    out = np.where(word[at], _lower()[cp[at]], 0x20).astype(np.uint32)
    new = np.searchsorted(at, bounds)
    return out, new, at - np.repeat(bounds[:-1], np.diff(new))


def qgram_hashes(cp: np.ndarray, q: int) -> np.ndarray:
    n = len(cp)
    if n < q:
        return np.empty(0, dtype=np.uint64)
    power, inverse = powers(n)
    with np.errstate(over="ignore"):
        sums = np.append(np.uint64(0), np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64))
        h = (sums[q:] - sums[:-q]) * inverse[: n - q + 1]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.where(h == np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0), h)


class WindowIndex:
    """Windows of benchmark items (each text once) and the places of their q-grams."""

    def __init__(self, items: list[tuple[object, str | None]], budget: Budget):
        self.budget = budget
        cp, bounds, _ = plain([t for _, t in items])
        self.text: list[np.ndarray] = []
        #: For each window (item, place in the item, whether it is a whole item searched for beside its windows).
        self.owners: list[list[tuple[int, int, bool]]] = []
        self.short: dict[bytes, list[int]] = {}
        number: dict[bytes, int] = {}
        for k in range(len(items)):
            whole = cp[bounds[k] : bounds[k + 1]]
            if len(whole) and whole[-1] == 0x20:
                whole = whole[:-1]
            if 0 < len(whole) < budget.q:
                self.short.setdefault(whole.tobytes(), []).append(k)
                continue
            parts = [(a, whole[a : a + budget.window], False) for a in budget.starts(len(whole))]
            if budget.window < len(whole) <= 2 * budget.window:
                parts.append((0, whole, True))
            for a, part, extra in parts if len(whole) else ():
                w = number.setdefault(part.tobytes(), len(self.text))
                if w == len(self.text):
                    self.text.append(part)
                    self.owners.append([])
                self.owners[w].append((k, a, extra))
        self.length = np.array([len(t) for t in self.text], dtype=np.int64)
        self.least = np.array([budget.least(n) for n in self.length], dtype=np.int64)
        self.edits = np.array([budget.edits(n) for n in self.length], dtype=np.int64)
        self.reach = int(self.length.max(initial=0))
        grams = [qgram_hashes(t, budget.q) for t in self.text]
        keys = np.concatenate([np.empty(0, dtype=np.uint64), *grams])
        window = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.empty(0, dtype=np.int64), *[np.arange(len(g)) for g in grams]]).astype(np.int64)
        distinct, gram, count = np.unique(keys, return_inverse=True, return_counts=True)
        often = (count > budget.common)[gram]
        ordinary = np.bincount(window[often], minlength=len(grams)) < self.least  # those that common q-grams alone don't suffice for
        self.bound = np.where(ordinary, self.least - np.bincount(window[often], minlength=len(grams)), self.least)
        keep = ~(often & ordinary[window]) if len(window) else often
        order = np.flatnonzero(keep)[np.argsort(gram[keep], kind="stable")]
        self.window, self.place = window[order], place[order]
        self.count = np.bincount(gram[order], minlength=len(distinct))
        self.first = np.cumsum(self.count) - self.count
        self.index = HashIndex(max(1, len(distinct)))
        self.index.add(distinct, np.arange(len(distinct), dtype=np.int32))
        self.matrix = np.zeros((len(self.text), self.reach), dtype=np.uint32)
        for row, t in zip(self.matrix, self.text, strict=True):
            row[: len(t)] = t

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, place of the window in the item, start and end in the text, edits) of each window that a text leaks.

        Of the alignments of a window in a text the one with the fewest edits is given, of equal ones the first. Where a whole
        item leaks, it stands for its first window.
        """
        cp, bounds, original = plain(texts)
        out: dict[tuple[int, int, int], tuple[int, int, int]] = {}
        found = self.best(cp, bounds)
        for late in (False, True):  # a whole item comes after its windows
            for (r, w), (d, a, b) in found.items():
                for item, offset, extra in self.owners[w]:
                    if extra == late:
                        out[r, item, offset] = int(original[bounds[r] + a]), int(original[bounds[r] + b - 1]) + 1, d
        size = np.diff(bounds)
        for r in np.flatnonzero((size > 0) & (size <= self.budget.q)).tolist() if self.short else ():
            whole = cp[bounds[r] : bounds[r + 1]]
            a, b = int(whole[0] == 0x20), len(whole) - int(whole[-1] == 0x20)
            for item in self.short.get(whole[a:b].tobytes(), ()):
                out[r, item, 0] = int(original[bounds[r] + a]), int(original[bounds[r] + b - 1]) + 1, 0
        return sorted(k + v for k, v in out.items())

    def best(self, cp: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """The best alignment (edits, start, end) of each text and window that it leaks."""
        q = self.budget.q
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        if not len(self.text) or len(cp) < q:
            return found
        hit = self.index.find(qgram_hashes(cp, q))
        at = np.flatnonzero(hit >= 0)
        row = np.searchsorted(bounds, at, side="right") - 1
        inside = (at + q <= bounds[row + 1]) & (self.count[hit[at]] > 0)
        at, row = at[inside], row[inside]
        pairs = np.cumsum(self.count[hit[at]])
        overlap = self.reach + int(self.edits.max())  # a leak's hits lie within so many places
        i = 0
        while i < len(at):
            stop = int(np.searchsorted(pairs, (pairs[i - 1] if i else 0) + self.budget.most_pairs, side="right"))
            stop = max(stop, int(np.searchsorted(at, at[i] + 2 * overlap)))
            self.count_bands(cp, bounds, at[i:stop], row[i:stop], hit[at[i:stop]], found)
            i = stop if stop == len(at) else int(np.searchsorted(at, at[stop] - overlap))
        return found

    def count_bands(self, cp: np.ndarray, bounds: np.ndarray, at: np.ndarray, row: np.ndarray, gram: np.ndarray, found: dict[tuple[int, int], tuple[int, int, int]]) -> None:
        n = self.count[gram]
        spot = ranges(self.first[gram], n)
        at, row, window, place = np.repeat(at, n), np.repeat(row, n), self.window[spot], self.place[spot]
        diagonal = at - bounds[row] - place + self.reach  # not negative
        band = diagonal // self.budget.band
        also = np.flatnonzero((diagonal % self.budget.band < self.edits[window]) & (band > 0))
        row, window, band = (np.concatenate([x, y[also]]) for x, y in ((row, row), (window, window), (band, band - 1)))
        bands = int(np.diff(bounds).max() + 2 * self.reach) // self.budget.band + 2
        key, shared = np.unique((row * len(self.text) + window) * bands + band, return_counts=True)
        window = key // bands % len(self.text)
        enough = shared >= self.bound[window]
        key, window = key[enough], window[enough]
        row, low = key // bands // len(self.text), key % bands * self.budget.band - self.reach
        for i in range(0, len(key), 4096):
            part = slice(i, i + 4096)
            edits, start, end = self.align(cp, bounds, row[part], window[part], low[part])
            for k in np.flatnonzero(edits <= self.edits[window[part]]).tolist():
                pair, new = (int(row[i + k]), int(window[i + k])), (int(edits[k]), int(start[k]), int(end[k]))
                found[pair] = min(found.get(pair, new), new)

    def align(self, cp: np.ndarray, bounds: np.ndarray, row: np.ndarray, window: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edits, start and end (in the plain text) of each window's best substring on the band of diagonals from `low`.

        Cell o of row j is the end low + j + o in the text after j characters of the window. All candidates advance together.
        """
        n, width = len(row), self.budget.band + int(self.edits.max())
        far = np.int32(1 << 20)
        begin, size = bounds[row][:, None], np.diff(bounds)[row][:, None]
        end = low[:, None] + np.arange(width)
        cost = np.where((end >= 0) & (end <= size), np.int32(0), far)
        start = np.where(cost == 0, end, 0)
        edits, first, last = np.full(n, far), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for j in range(1, int(self.length[window].max()) + 1):
            end = end + 1
            ok = (end >= 1) & (end <= size)
            here = cp[np.clip(begin + end - 1, 0, len(cp) - 1)]
            step = np.where(ok, cost + (here != self.matrix[window, j - 1][:, None]), far)
            gone = np.full_like(cost, far)
            gone[:, :-1] = cost[:, 1:] + 1  # a window character is missing in the text
            better = (gone < step) & (end >= 0) & (end <= size)
            moved = np.zeros_like(start)
            moved[:, :-1] = start[:, 1:]
            cost, start = np.where(better, gone, step).astype(np.int32), np.where(better, moved, start)
            for o in range(1, width):  # one more character in the text
                more = (cost[:, o - 1] + 1 < cost[:, o]) & ok[:, o]
                cost[more, o], start[more, o] = cost[more, o - 1] + 1, start[more, o - 1]
            done = np.flatnonzero(self.length[window] == j)
            if len(done):
                at = cost[done].argmin(axis=1)
                edits[done], first[done], last[done] = cost[done, at], start[done, at], end[done, at]
        return edits, first, np.maximum(last, first + 1)


LEAK = "key {key}, item {item}, item_start int, start int, end int, edits int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", budget: Budget = Budget()) -> DataFrame:
    """A row for each document and benchmark window that it leaks: the key and item (named as in the tables), item_start (the
    window's place in the plain item), start and end in the document's text (code points, end exclusive), and edits.

    An excerpt of budget.least_leak plain characters of an item is always found if it has no more edits than a window may.
    Null or empty texts leak nothing, and items without plain characters aren't leaked; repeated rows each have their own
    results. The benchmark is read to the driver in blocks of at most block_chars characters (or one item, if that is longer),
    one at a time; each block is a pass over all documents. Where there are several, each one's rows are written to the shared
    folder before the next is read. Other columns are not read. An empty table gives an empty result.
    """
    schema = LEAK.format(key=dict(docs.dtypes)[key], item=dict(benchmark.dtypes)[item])
    item_type = to_arrow_type(benchmark.schema[item].dataType)
    spark = docs.sparkSession
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")

    def search_block(items: list[tuple[object, str | None]], last: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = WindowIndex(shared.value, budget)
            for batch in batches:
                for part in pieces(batch, "text"):
                    found = index.search(part.column("text").to_pylist())
                    keys = part.column("key").take(pa.array([f[0] for f in found], type=pa.int64()))
                    ids = pa.array([shared.value[f[1]][0] for f in found], type=item_type)
                    yield pa.RecordBatch.from_arrays([keys, ids, *[pa.array([f[i] for f in found], type=pa.int32()) for i in range(2, 6)]], names=["key", "item", "item_start", "start", "end", "edits"])

        rows = map_arrow(source, run, schema)
        if not last:
            rows = stored(rows, "leaks")
            shared.destroy()
        return rows

    # Not an empty list as rows: Spark reads one through Python workers of another kind, which stay beside the others.
    found = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema).fields])
    block: list[tuple[object, str | None]] = []
    size = 0
    for r in benchmark.select(F.col(item).alias("i"), F.col(item_text).alias("t")).where("t is not null").toLocalIterator():
        if block and size + len(r["t"]) > budget.block_chars:
            found = found.unionByName(search_block(block, last=False))
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    if block:
        found = found.unionByName(search_block(block, last=True))
    return found.withColumnsRenamed({"key": key, "item": item})


def drop_leaking(docs: DataFrame, leaks: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the rows whose key has a leak; rows with a null key stay."""
    gone = stored(leaks.select(key).distinct(), "leaking")
    return docs.join(sent_if_few(gone), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
