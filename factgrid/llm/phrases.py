"""Phrases whose words occur together more often than apart, by partitioned mining (SON).

Each task's documents belong to one of a few shards. A phrase that occurs `least` times in all occurs at least
ceil(least / shards) times in one of the shards, so the phrases that are locally frequent in any of them are candidates enough.
Shards are mined completely and level by level: words, then longer phrases whose two halves (all but the last word, all but the
first) are candidates. In a shard, phrases are counted by a 64-bit number that their words make, which can only
add candidates. Then all occurrences of candidates are counted exactly, by their words, over all documents.

Words of a chunk of text get numbers by exact comparison, and pairs of numbers get numbers again, so that all counting within a
task is on integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, binary_array, kept, map_arrow, mixed, pieces, ranges, text_bytes
from .pretokens import PieceStore

#: What ends a piece, and what only parts its words.
BREAKS, GAPS = b".,;:!?\n\v\f\r", b" \t"
#: Bytes of text whose words are numbered together; a task's arrays take about 80 times as much.
CHUNK = 2 << 20
#: Rows (number, count) that a task adds up before it hands them on.
BUFFERED = 1 << 21
#: Bits of the filter of candidates that all tasks get at most (32 MB), and bits for each candidate.
MOST_BITS, BITS_EACH = 1 << 28, 16

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(GAPS)], _KIND[list(BREAKS)] = 1, 2
_LOW = np.arange(256, dtype=np.uint8)
_LOW[ord("A") : ord("Z") + 1] += 32


@kept(1)
def _hasher() -> PieceStore:
    return PieceStore(lambda *_: None, 1)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the number of each key among them, and how often each occurs."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(keys), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return order[first], number, np.diff(np.append(first, len(keys)))


class Chunk:
    """The phrases of some texts: for each length, a number and a count of each distinct phrase and where one of them stands."""

    def __init__(self, texts: pa.Array, langs: list[str]):
        flat, bounds = text_bytes(texts)
        flat = _LOW[flat]
        kind = _KIND[flat]
        word = kind == 0
        edge = np.zeros(len(flat) + 1, dtype=bool)
        edge[bounds] = True
        inside = word[1:] & word[:-1] & ~edge[1:-1] if len(flat) else word[:0]
        first, last = word.copy(), word.copy()
        first[1:] &= ~inside
        last[:-1] &= ~inside
        self.flat, self.start = flat, np.flatnonzero(first)
        self.stop = np.flatnonzero(last) + 1
        breaks = np.cumsum((kind == 2) | edge[:-1])
        self.piece = breaks[self.start]
        self.langs = sorted(set(langs))
        names = {x: i for i, x in enumerate(self.langs)}
        self.lang = np.repeat(np.array([names[x] for x in langs], dtype=np.int64), np.diff(np.searchsorted(self.start, bounds)))
        self.seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs] or [0], dtype=np.uint64)
        with np.errstate(over="ignore"):
            hashes = mixed(_hasher().hashes(flat, self.start, self.stop - self.start) ^ self.seeds[self.lang])
        pick, number, counts = _numbered(hashes)
        length = self.stop - self.start
        same = (length == length[pick][number]).all() and (flat[ranges(self.start, length)] == flat[ranges(self.start[pick[number]], length)]).all() and (self.lang == self.lang[pick][number]).all()
        if not same:  # two words of one hash: by their bytes
            data = flat.tobytes()
            seen: dict[tuple, int] = {}
            keys = np.array([seen.setdefault((g, data[a:b]), len(seen)) for g, a, b in zip(self.lang.tolist(), self.start.tolist(), self.stop.tolist(), strict=True)], dtype=np.int64)
            pick, number, counts = _numbered(keys)
        self.words = number  # of each word, its number
        self.word_hash = hashes[pick]
        self._level(1, np.arange(len(number)), number, pick, counts, self.word_hash)

    def _level(self, size: int, at: np.ndarray, number: np.ndarray, pick: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> None:
        """at: first words of all phrases of the size; number: of each; pick: one of at, counts and hashes, of each number."""
        self.size, self.at, self.number, self.pick, self.counts, self.hashes = size, at, number, pick, counts, hashes

    def longer(self, good: np.ndarray) -> None:
        """Goes on to phrases of one word more, whose two halves are good (a bool for each number of the present length)."""
        ok = np.zeros(len(self.words) + 1, dtype=bool)
        here = np.full(len(self.words) + 1, -1, dtype=np.int64)
        ok[self.at] = good[self.number]
        here[self.at] = self.number
        end = self.at + self.size
        inside = end < len(self.words)
        at = self.at[inside]
        at = at[ok[at] & ok[at + 1] & (self.piece[at] == self.piece[at + self.size])]
        head, tail = here[at], self.words[at + self.size]
        pick, number, counts = _numbered(head * np.int64(max(1, len(self.word_hash))) + tail)
        with np.errstate(over="ignore"):
            hashes = mixed(self.hashes[head[pick]] * np.uint64(0x9E3779B97F4A7C15) + self.word_hash[tail[pick]], self.size)
        self._level(self.size + 1, at, number, at[pick], counts, hashes)

    def phrases(self, which: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Language and words (joined by a space) of the numbers of the present length."""
        first = self.pick[which]
        words = first[:, None] + np.arange(self.size)
        length = self.stop[words] - self.start[words]
        bounds = np.concatenate([[0], np.cumsum(length.sum(axis=1) + self.size - 1)])
        out = np.full(int(bounds[-1]), ord(" "), dtype=np.uint8)
        to = bounds[:-1].copy()
        for k in range(self.size):
            out[ranges(to, length[:, k])] = self.flat[ranges(self.start[words[:, k]], length[:, k])]
            to += length[:, k] + 1
        return pa.array(self.langs, pa.string()).take(pa.array(self.lang[first])), pc.cast(binary_array(out, bounds), pa.string())


class Filter:
    """A set of 64-bit numbers as one bit each; says yes to some others, too."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # uint8, a power of two of them

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(2)) & np.uint64(8 * len(self.bits) - 1)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def make_filter(candidates: DataFrame, n: int) -> np.ndarray:
    """The filter's bytes of n numbers; each task sets the bits of one range of words, so the driver gets at most MOST_BITS."""
    size = 1 << min(MOST_BITS.bit_length() - 1, max(10, (n * BITS_EACH - 1).bit_length()))
    bit = F.shiftrightunsigned("number", 2).bitwiseAND(F.lit(size - 1))
    words = candidates.select(F.shiftright(bit, 6).alias("word"), bit.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    out = np.zeros(size // 64, dtype=np.int64)
    got = words.toArrow()
    out[got["word"].to_numpy()] = got["mask"].to_numpy()
    return out.view(np.uint8)


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Text and language of the documents that have any word, and the shard of the task that reads them."""
    return docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.spark_partition_id().alias("place")).where("text is not null")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, int]]:
    for batch in batches:
        for part in pieces(batch, "text", CHUNK):
            yield Chunk(part.column("text"), part.column("lang").to_pylist()), part.column("place")[0].as_py()


def _grown(chunk: Chunk, size: int, filters: list[Filter]) -> None:
    """Takes the chunk from words to phrases of the size; filters[k] knows the candidates of k + 1 words."""
    for k in range(1, size):
        chunk.longer(filters[k - 1].has(chunk.hashes))


def _mined(rows: DataFrame, size: int, filters: list[Broadcast], shards: int, support: int) -> DataFrame:
    """Numbers of the phrases of the size that occur `support` times or more in a shard; their two lowest bits are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Filter(np.frombuffer(f.value, dtype=np.uint8)) for f in filters]
        keys, counts, held = [], [], 0

        def added() -> pa.RecordBatch:
            key, n = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(np.add.reduceat(n[order], first))], names=["key", "n"])

        for chunk, place in _chunks(batches):
            _grown(chunk, size, known)
            if not len(chunk.counts):
                continue
            keys.append((chunk.hashes & np.uint64(0xFFFFFFFFFFFFFFFC)) | np.uint64(place % shards))
            counts.append(chunk.counts)
            held += len(chunk.counts)
            if held > BUFFERED:
                whole = added()
                yield whole
                keys, counts, held = [], [], 0
        if held:
            yield added()

    frequent = map_arrow(rows, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
    return frequent.select(F.col("key").bitwiseAND(F.lit(-4)).alias("number")).distinct()


def count_phrases(docs: DataFrame, longest: int = 3, least: int = 10, shards: int = 4, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, size, phrase, n) of all phrases of 1 to `longest` words that occur at least `least` times in their language, and
    for each language the number of all its words as the phrase '' of size 0. Exact, for any number of shards up to four.

    Letters A to Z count as small ones. A null text has no words; a null language is `und`. Texts are taken whole, in memory of
    one text or chunk. Repeated rows count each time. Other columns are ignored. An empty table gives an empty one.
    """
    if not 1 <= shards <= 4:
        raise ValueError("1 to 4 shards")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = _rows(docs, text, lang)
    support = -(-least // shards)
    filters: list[Broadcast] = []
    for size in range(1, longest + 1):
        found = scratch.stored(_mined(rows, size, filters, shards, support), f"mined{size}")
        filters.append(spark.sparkContext.broadcast(make_filter(found, found.count()).tobytes()))
        scratch.drop(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Filter(np.frombuffer(f.value, dtype=np.uint8)) for f in filters]
        for chunk, _ in _chunks(batches):
            total = np.bincount(chunk.lang, minlength=len(chunk.langs))
            langs, phrases = [pa.array(chunk.langs, pa.string())], [pa.array([""] * len(chunk.langs), pa.string())]
            sizes, counts = [np.zeros(len(chunk.langs), dtype=np.int32)], [total]
            for size in range(1, longest + 1):
                if size > 1:
                    chunk.longer(good)
                good = known[size - 1].has(chunk.hashes)
                which = np.flatnonzero(good)
                names, words = chunk.phrases(which)
                langs.append(names), sizes.append(np.full(len(which), size, dtype=np.int32)), phrases.append(words), counts.append(chunk.counts[which])
            columns = [pa.concat_arrays(langs), pa.array(np.concatenate(sizes)), pa.concat_arrays(phrases), pa.array(np.concatenate(counts).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "size", "phrase", "n"])

    counted = map_arrow(rows, run, "lang string, size int, phrase string, n long").groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= least) | (F.col("size") == 0))


def _exact(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def score_phrases(counts: DataFrame, least: int = 10, share: int = 50) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more in a table as count_phrases gives it, without those
    that lie in a longer one which occurs at least `share` of 100 times as often.

    A phrase is cut after each of its words; the cut of the lowest score counts, the first of equal ones. Parts occur at least
    as often as the phrase, so they are in the table, and each cut finds its two by equality. Scores are exact while a phrase
    occurs less than 10^16 times.
    """
    words = F.split("phrase", " ")
    candidates = counts.where((F.col("size") >= 2) & (F.col("n") >= least)).select("lang", "size", "phrase", F.col("n").alias("a"), words.alias("words"))
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    known = counts.where("size > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    cuts = cuts.join(known.toDF("lang", "left", "l"), ["lang", "left"]).join(known.toDF("lang", "right", "r"), ["lang", "right"])
    score = F.expr("cast(1000000 as decimal(7,0)) * cast(a as decimal(16,0)) * cast(a as decimal(16,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    # every shorter candidate inside of a phrase: its starts and lengths
    inner = candidates.where("size > 2").select("lang", "a", "words", "size", F.explode(F.expr("sequence(2, size - 1)")).alias("m"))
    inner = inner.select("lang", "a", "words", "m", F.explode(F.expr("sequence(1, size - m + 1)")).alias("i"))
    longer = inner.groupBy("lang", F.array_join(F.slice("words", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("longest"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (_exact(F.lit(100)) * _exact(F.col("longest")) < _exact(F.lit(share)) * _exact(F.col("a"))))
    totals = counts.where("size = 0").select("lang", "n")
    return kept.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def top_phrases(docs: DataFrame, first: int = 2000, **options: int | str) -> DataFrame:
    """The first phrases of each language by score, then a, both descending, then phrase (by bytes), with their rank. A report:
    tasks hand on as many rows of a language as it has at most. See count_phrases for nulls, empty tables and odd texts."""
    scratch = Scratch(docs.sparkSession)
    counts = scratch.stored(count_phrases(docs, **options), "phrases")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = score_phrases(counts, int(options.get("least", 10))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The query's rows in SQL.
ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d
), g AS (
  SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM w, (VALUES (1), (2), (3)) AS s(k)
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL
), t AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10
), s AS (
  SELECT c.lang, c.k, c.phrase, c.a, j.j, l.a AS l, r.a AS r, (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM c JOIN (VALUES (1), (2)) AS j(j) ON j.j < c.k JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j.j], ' ') JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j.j + 1:c.k], ' ')
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), o AS (
  SELECT lang, phrase, max(a) AS a FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, t.n, CAST(score AS BIGINT) AS score
FROM b JOIN t ON t.lang = b.lang LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * b.a
QUALIFY rank <= 2000"""
