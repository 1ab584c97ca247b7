"""Splits texts into the pieces that byte-level BPE merges, and numbers distinct pieces; whole chunks at a time in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

from .common import kept, ranges

#: Fixed value: the public split pattern that SPLITS below is written for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE, LETTER, NUMBER, OTHER = range(4)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd base of the rolling hash, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Powers that are kept for the next chunk, as many as a chunk of common size takes.
KEPT_POWERS = (1 << 20) + (1 << 17)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n, or to a larger number, of the base and of its inverse."""
    return _kept_powers() if n <= KEPT_POWERS else _powers(n)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        each = [np.full(n + 1, x, dtype=np.uint64) for x in (BASE, INVERSE)]
        for x in each:
            x[0] = 1
            np.cumprod(x, out=x)
    return tuple(each)


@kept(1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(KEPT_POWERS)


@kept(1)
def character_classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = np.where((np.arange(a, b + 1) >= 0xD800) & (np.arange(a, b + 1) < 0xE000), out[a : b + 1], kind)
    return out


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one text after another, and the texts' bounds in them."""
    bounds = np.concatenate([[0], np.cumsum([len(t) if t else 0 for t in texts])]).astype(np.int64)
    return np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), bounds


def piece_starts(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the matches of PATTERN start, as a sorted array of places in cp.

    Runs of one class are pieces. A space right before a run of letters, numbers or other characters belongs to it; what
    else is white space before it is a piece without its last character, and that one a piece of its own. An apostrophe
    that starts a piece takes the letters of a contraction with it.
    """
    n = len(cp)
    if not n:
        return np.empty(0, dtype=np.int64)
    kind = character_classes()[cp]
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    first = first[:n]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    white = kind == SPACE
    start = run.copy()
    before = np.zeros(n, dtype=bool)  # the last white character before another one of the same text
    before[:-1] = white[:-1] & ~white[1:] & ~first[1:]
    start |= before
    taken = np.zeros(n, dtype=bool)  # runs that a space before them starts
    taken[1:] = before[:-1] & (cp[:-1] == 0x20)
    start &= ~taken
    quote = np.flatnonzero((cp == 0x27) & start)
    if len(quote):
        ends = bounds[np.searchsorted(bounds, quote, side="right")]
        at = lambda k: np.where(quote + k < ends, cp[np.minimum(quote + k, n - 1)], 0)
        a, b = at(1), at(2)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for hit, k in ((one, 1), (two, 2)):
            q = quote[hit]
            start[q + 1] = False
            rest = q + 1 + k
            start[rest[rest < n]] = True
    return np.flatnonzero(start)


class HashIndex:
    """Open addressing in arrays: values of 64-bit keys, added and looked up many at a time."""

    def __init__(self, expected: int):
        self.bits = max(6, (2 * expected).bit_length())
        self.keys = np.full(1 << self.bits, EMPTY, dtype=np.uint64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int32)
        self.depth = 0

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """The keys are distinct and not there yet."""
        todo, slots, depth, mask = np.arange(len(keys)), self.slot(keys), 0, (1 << self.bits) - 1
        while len(todo):
            at = (slots[todo] + depth) & mask
            free = np.flatnonzero(self.keys[at] == EMPTY)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.values[at[won]] = keys[todo[won]], values[todo[won]]
            todo = np.delete(todo, won)
            depth += 1
        self.depth = max(self.depth, depth)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where a key isn't there."""
        out = np.full(len(keys), -1, dtype=np.int32)
        todo, at, mask = np.arange(len(keys)), self.slot(keys), (1 << self.bits) - 1
        for _ in range(self.depth):
            if not len(todo):
                break
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            more = np.flatnonzero(~hit & (found != EMPTY))
            todo, at = todo[more], (at[more] + 1) & mask
        return out


class PieceStore:
    """Ids of the pieces met so far, up to a bound; new pieces are encoded together.

    encode(flat, starts, lengths) gives the ids of the byte slices, slice after slice, and their counts. Pieces are looked up
    by hash and then compared byte by byte with what is stored.
    """

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], bound: int = 400_000):
        self.encode_new, self.bound = encode, bound
        self.forget()

    def forget(self) -> None:
        self.index = HashIndex(2 * self.bound)
        self.n = 0
        self.bytes, self.size = np.empty(0, dtype=np.uint8), np.empty(0, dtype=np.int64)
        self.ids, self.count = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)

    def hashes(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        n = len(flat)
        power, inverse = powers(n)
        with np.errstate(over="ignore"):
            terms = flat.astype(np.uint64)
            terms += np.uint64(1)
            terms *= power[:n]
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(terms, out=sums[1:])
            out = (sums[starts + lengths] - sums[starts]) * inverse[starts] ^ lengths.astype(np.uint64)
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
        return np.where(out == EMPTY, np.uint64(0), out)

    def encode(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.n > self.bound:
            self.forget()
        keys = self.hashes(flat, starts, lengths)
        number = self.index.find(keys)
        new = np.flatnonzero(number < 0)
        if len(new):
            distinct, first = np.unique(keys[new], return_index=True)
            pick = new[first]
            ids, count = self.encode_new(flat, starts[pick], lengths[pick])
            self.bytes = np.concatenate([self.bytes, flat[ranges(starts[pick], lengths[pick])]])
            self.size = np.concatenate([self.size, lengths[pick]])
            self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, count])
            if self.n + len(pick) > 2 * self.bound:  # one chunk with very many distinct pieces
                self.index = HashIndex(2 * (self.n + len(pick)))
                self.index.add(self.hashes(self.bytes, np.cumsum(self.size) - self.size, self.size), np.arange(len(self.size), dtype=np.int32))
            else:
                self.index.add(distinct, np.arange(self.n, self.n + len(pick), dtype=np.int32))
            self.n += len(pick)
            number[new] = self.index.find(keys[new])
        begin = np.cumsum(self.size) - self.size
        tiled = len(starts) and starts[0] == 0 and lengths.sum() == len(flat) and (starts[1:] == starts[:-1] + lengths[:-1]).all()
        if (self.size[number] != lengths).any() or (self.bytes[ranges(begin[number], lengths)] != (flat if tiled else flat[ranges(starts, lengths)])).any():
            return self.encode_new(flat, starts, lengths)  # two pieces of one hash: without the store
        n = self.count[number]
        return self.ids[ranges((np.cumsum(self.count) - self.count)[number], n)], n


class TextEncoder:
    """Ids of whole texts, with a PieceStore."""

    def __init__(self, store: PieceStore, pattern: str = PATTERN):
        self.store, self.find = store, None if pattern == PATTERN else regex.compile(pattern).finditer

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and the number of ids of each text; a null text is empty."""
        cp, bounds = code_points(texts)
        flat = np.frombuffer("".join(t for t in texts if t).encode("utf-8", "surrogatepass"), dtype=np.uint8)
        place = np.concatenate([[0], np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF))]).astype(np.int64)
        if self.find is None:
            start = piece_starts(cp, bounds)
            stop = np.append(start[1:], len(cp))[: len(start)]
        else:  # what no match covers is left out
            spans = [(a + m.start(), a + m.end()) for t, a in zip(texts, bounds.tolist(), strict=False) if t for m in self.find(t)]
            start, stop = np.array(spans, dtype=np.int64).reshape(-1, 2).T
        ids, count = self.store.encode(flat, place[start], place[stop] - place[start])
        ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        return ids, np.diff(ends[np.searchsorted(start, bounds)])
