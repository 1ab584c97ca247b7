"""Token ids in length-delimited binary record files, with a separate offset index for shuffled reads.

A file is a sequence of frames; all integers are little-endian:

    uint64 length | uint32 masked CRC-32C of the length's 8 bytes | payload | uint32 masked CRC-32C of the payload | 0x0A

A payload is int64 doc_id | uint8 flags (1: doc_id is null) | uint8 bytes per id (2 or 4) | ids. The checksum is masked as
((crc >> 15) | (crc << 17)) + 0xA282EAD8 modulo 2^32. The last byte separates frames: Spark's text writer, whose commit
protocol survives lost executors and writes to any file system, puts it there. Files part-00000..., read in the order of
their numbers, hold the documents in ascending order of doc_id. The index has each record's file, place, offset and length;
readers take records from the offsets that they are given, without walking through the rest of a file.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .bpe import MAX_VOCABULARY_BYTES
from .common import binary_array, kept, map_arrow, pieces, plain_text, ranges
from .pretokens import PieceStore, TextEncoder

MASK = 0xA282EAD8
#: Bytes of frames around a payload, and of a payload before its ids.
HEAD, TAIL, LEAD = 12, 5, 10
#: Text bytes that one file is made of; a file is read as one value, so it must stay well below an executor's memory.
FILE_BYTES = 24 << 20
#: Bytes of frames whose checksums are computed at a time, and rows of an index that is sent to all tasks at most.
CHECK_BYTES, BROADCAST_ROWS = 1 << 20, 500_000


@functools.lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1).astype(np.uint32)
    return table


BLOCK = 256


@functools.lru_cache(maxsize=64)
def _zeros_operator(power: int) -> np.ndarray:
    """Tables [4][256] that advance a CRC register over 2^power zero bytes."""
    if power == 0:
        x = np.arange(256, dtype=np.uint32)
        columns = [x << np.uint32(8 * k) for k in range(4)]
        table = _crc_table()
        return np.stack([table[c & 0xFF] ^ (c >> np.uint32(8)) for c in columns])
    half = _zeros_operator(power - 1)
    return np.stack([_advance(row, half) for row in half])


def _advance(crc: np.ndarray, op: np.ndarray) -> np.ndarray:
    return op[0][crc & 0xFF] ^ op[1][(crc >> 8) & 0xFF] ^ op[2][(crc >> 16) & 0xFF] ^ op[3][crc >> 24]


def crc32c(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of the slices flat[start : start + length] (uint8), all at once.

    Leading zeros don't change a register of zero, so every slice is padded in front to whole blocks; the blocks advance
    side by side, then each slice's blocks are joined pairwise. The register's start value is added at the end.
    """
    table = _crc_table()
    out = np.zeros(len(lengths), dtype=np.uint32)
    blocks = np.maximum(1, -(-lengths // BLOCK))
    pad = blocks * BLOCK - lengths
    first = np.cumsum(blocks) - blocks
    cells = np.zeros(int(blocks.sum()) * BLOCK, dtype=np.uint8)
    cells[ranges(first * BLOCK + pad, lengths)] = flat[ranges(starts, lengths)]
    rows = np.ascontiguousarray(cells.reshape(-1, BLOCK).T)
    crc = np.zeros(rows.shape[1], dtype=np.uint32)
    for column in rows:
        crc = table[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
    power, count = BLOCK.bit_length() - 1, blocks
    while len(count) and count.max() > 1:
        odd = count % 2
        wide = np.zeros(int((count + odd).sum()), dtype=np.uint32)
        begin = np.cumsum(count + odd) - (count + odd)
        wide[ranges(begin + odd, count)] = crc
        crc = _advance(wide[0::2], _zeros_operator(power)) ^ wide[1::2]
        count, power = (count + odd) // 2, power + 1
    out[:] = crc
    start = np.full(len(lengths), 0xFFFFFFFF, dtype=np.uint32)
    for bit in range(int(lengths.max()).bit_length() if len(lengths) else 0):
        on = (lengths >> bit) & 1 == 1
        start[on] = _advance(start[on], _zeros_operator(bit))
    return out ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def frames(doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The frames (without the byte that separates them) of documents, and the bounds of each in the bytes."""
    n = len(doc_ids)
    data = np.ascontiguousarray(ids.astype(f"<u{width}")).view(np.uint8)
    payload = LEAD + counts * width
    size = HEAD + payload + TAIL - 1
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    out = np.zeros(int(bounds[-1]), dtype=np.uint8)
    at = bounds[:-1]
    head = np.zeros((n, HEAD), dtype=np.uint8)
    head[:, :8] = payload.astype("<u8").view(np.uint8).reshape(n, 8)
    head[:, 8:] = masked(crc32c(head.ravel(), np.arange(n) * HEAD, np.full(n, 8))).astype("<u4").view(np.uint8).reshape(n, 4)
    lead = np.zeros((n, LEAD), dtype=np.uint8)
    lead[:, :8] = np.array([d or 0 for d in doc_ids], dtype="<i8").view(np.uint8).reshape(n, 8)
    lead[:, 8], lead[:, 9] = [d is None for d in doc_ids], width
    out[(at[:, None] + np.arange(HEAD)).ravel()] = head.ravel()
    out[(at[:, None] + HEAD + np.arange(LEAD)).ravel()] = lead.ravel()
    out[ranges(at + HEAD + LEAD, counts * width)] = data
    tail = masked(crc32c(out, at + HEAD, payload)).astype("<u4").view(np.uint8)
    out[ranges(at + HEAD + payload, np.full(n, 4))] = tail
    return out, bounds


#: Pieces that go to the library at a time.
GROUP = 500


@kept(2)
def text_encoder(definition: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """A function from texts to all their ids and the count of each, by a tokenizer of the tokenizers library.

    Where the tokenizer splits texts by the public byte-level pattern and does nothing else to them, the ids of a text are
    those of its pieces one after another, so only pieces that weren't met yet go to the library. Else whole texts do, as do
    texts that hold an added token as written, which the library makes one id.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    parts = json.loads(definition)
    split = parts.get("pre_tokenizer") or {}

    def whole(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(each), dtype=np.int32), np.array([len(ids) for ids in each], dtype=np.int64)

    plain_tokens = all(t.get("special") for t in parts.get("added_tokens") or ())
    if parts.get("normalizer") or not plain_tokens or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space"):
        return whole

    # pieces go to the library in groups and aren't split again; as every id stands for as many bytes as its token has
    # characters, the bytes tell where a group's pieces end
    split["use_regex"] = False
    grouped = Tokenizer.from_str(json.dumps(parts))
    grouped.no_truncation()
    grouped.no_padding()
    vocabulary = grouped.get_vocab()
    width = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
    width[list(vocabulary.values())] = [len(t) for t in vocabulary]

    def new(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = flat.tobytes()
        each = [data[a : a + n].decode("utf-8", "surrogatepass") for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
        groups = [each[i : i + GROUP] for i in range(0, len(each), GROUP)]
        ids = np.concatenate([np.empty(0, dtype=np.int32), *[np.array(x.ids, dtype=np.int32) for x in grouped.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False)]])
        ends, until = np.cumsum(lengths), np.cumsum(width[ids])
        last = np.searchsorted(until, ends)
        if len(ends) and (last[-1] + 1 != len(ids) or (until[last] != ends).any()):
            return whole(each)  # a vocabulary without some bytes
        return ids, np.diff(last + 1, prepend=0)

    cached = TextEncoder(PieceStore(new)).encode
    added = [t["content"] for t in parts.get("added_tokens") or ()]

    def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        odd = [i for i, t in enumerate(texts) if t and any(a in t for a in added)]
        if not odd:
            return cached(texts)
        ids, counts = cached([None if i in odd else t for i, t in enumerate(texts)])
        each = np.split(ids, np.cumsum(counts)[:-1])
        for i in odd:
            each[i] = whole([texts[i]])[0]
        return np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)

    return encode


def write_documents(docs: DataFrame, path: str, tokenizer_path: str, text: str = "text", end_id: int = 0, key: str = "doc_id") -> int:
    """Writes the token ids of all documents to record files in `path`, in ascending order of the key; returns the number of files at most.

    A null text is empty; every document ends with end_id. A null key comes first; documents of one key are ordered by the
    crc32 of their texts, equal ones by their place in docs. Other columns of docs are not written. An empty table gives files
    without frames. Only the key and the text are shuffled, once, by ranges of the key, crc32 and place. For each time that its
    text is as long as the mean, a document is joined by a row without text, which goes after the shuffle: so ranges are even
    in bytes and in rows, wherever long texts lie, and equal rows fill more than one.
    """
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(definition) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{tokenizer_path}: larger than {MAX_VOCABULARY_BYTES} characters")
    width = 2 if max(Tokenizer.from_str(definition).get_vocab_size(), end_id) <= 0x10000 else 4
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(definition)
    rows = docs.select(F.col(key).cast("long").alias("key"), plain_text(text).alias("text")).withColumns({"crc": F.crc32("text"), "place": F.monotonically_increasing_id()})
    total, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    files = max(spark.sparkContext.defaultParallelism, math.ceil(total / FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = text_encoder(shared.value)
        for batch in batches:
            for part in pieces(batch.filter(pc.equal(batch.column("weight"), 0)), "text"):
                ids, counts = encode(part.column("text").to_pylist())
                ids = np.insert(ids, np.cumsum(counts), end_id)
                out, bounds = frames(part.column("key").to_pylist(), ids, counts + 1, width)
                yield pa.RecordBatch.from_arrays([binary_array(out, bounds)], names=["value"])

    weights = F.sequence(F.lit(0), F.floor(F.octet_length("text") / F.lit(max(1.0, total / max(1, n)))).cast("int"))
    weighed = rows.select("key", "text", "crc", "place", F.explode(weights).alias("weight")).withColumn("text", F.when(F.col("weight") == 0, F.col("text")))
    order = [F.col("key").asc_nulls_first(), "crc", "place"]
    ordered = weighed.repartitionByRange(files, *order).sortWithinPartitions(*order).select("key", "text", "weight")  # a filter here would move before the shuffle
    map_arrow(ordered, run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").text(path)
    return files


def walk(content: bytes, check: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the payloads in a file. A broken frame is an error."""
    starts, at, end = [], 0, len(content)
    lengths = []
    while at < end:
        if at + HEAD > end:
            raise ValueError(f"a frame is cut off at byte {at}")
        (n,) = struct.unpack_from("<Q", content, at)
        if n < LEAD or at + HEAD + n + TAIL > end:
            raise ValueError(f"a frame is cut off at byte {at}")
        starts.append(at + HEAD)
        lengths.append(n)
        at += HEAD + n + TAIL
    start, length = np.array(starts, dtype=np.int64), np.array(lengths, dtype=np.int64)
    if check:
        verify(content, start, length)
    return start, length


def verify(content: bytes, start: np.ndarray, length: np.ndarray) -> None:
    """Compares the lengths and checksums of the frames of these payloads with what the file holds."""
    flat = np.frombuffer(content, dtype=np.uint8)
    stored = lambda where, n, kind: flat[ranges(where, np.full(len(where), n))].copy().view(kind)
    if len(start) and (start.min() < HEAD or (start + length).max() + TAIL > len(flat)):
        raise ValueError("a record lies outside its file")
    done = np.cumsum(length)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + CHECK_BYTES, side="right")))
        s, n = start[at:stop], length[at:stop]
        if (stored(s - HEAD, 8, "<i8") != n).any() or (masked(crc32c(flat, s - HEAD, np.full(len(s), 8))) != stored(s - 4, 4, "<u4")).any() or (masked(crc32c(flat, s, n)) != stored(s + n, 4, "<u4")).any():
            raise ValueError("a checksum doesn't match")
        at = stop


def _records(content: bytes, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int | None, bytes]]:
    """doc_id and the ids as little-endian unsigned 32-bit integers."""
    for at, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        key, null, width = struct.unpack_from("<qBB", content, at)
        ids = np.frombuffer(content, dtype=f"<u{width}", count=(n - LEAD) // width, offset=at + LEAD)
        yield None if null else key, ids.astype("<u4").tobytes()


INDEX = "file string, ordinal long, doc_id long, offset long, length long, n_tokens long"


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the record files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the files in `path`: INDEX (offset and length are the payload's). All checksums are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = content.as_py()
                starts, lengths = walk(content)
                heads = [struct.unpack_from("<qBB", content, at) for at in starts.tolist()]
                widths = np.array([h[2] for h in heads], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(starts), type=pa.string()), pa.array(range(len(starts)), type=pa.int64()), pa.array([None if h[1] else h[0] for h in heads], type=pa.int64()), pa.array(starts), pa.array(lengths), pa.array((lengths - LEAD) // np.maximum(widths, 1))],
                    names=["file", "ordinal", "doc_id", "offset", "length", "n_tokens"],
                )

    return map_arrow(_files(spark, path), run, INDEX)


def write_index(spark: SparkSession, path: str, index_path: str) -> None:
    """Writes the offset index of the record files as Parquet: INDEX."""
    scan_records(spark, path).write.parquet(index_path)


def read_records(spark: SparkSession, path: str, index: DataFrame, mark: str) -> DataFrame:
    """doc_id, `mark` (a long column of the index that is passed on) and ids (little-endian unsigned 32-bit integers) of the
    records that the index has rows for, taken from their offsets; their checksums are verified, other records aren't looked at.

    The rows of a file's records go to where the file is read, as one array: no more than a file's worth. Without contents,
    they are sent to all tasks while there are at most BROADCAST_ROWS of them, else both are shuffled by file.
    """
    entries = index.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("offset", "length", F.col(mark).alias("mark")))).alias("entries"))
    entries = entries.select("file", *[F.col(f"entries.{c}").alias(c) for c in ("offset", "length", "mark")])
    if index.count() <= BROADCAST_ROWS:
        entries = F.broadcast(entries)
    found = _files(spark, path).join(entries, "file").select("content", "offset", "length", "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(0)[i].as_py()
                starts, lengths, marks = (batch.column(k)[i].values.to_numpy() for k in (1, 2, 3))
                verify(content, starts, lengths)
                for at in range(0, len(starts), 1000):
                    rows = list(_records(content, starts[at : at + 1000], lengths[at : at + 1000]))
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=pa.int64()), pa.array(marks[at : at + 1000]), pa.array([r[1] for r in rows], type=pa.binary())], names=["doc_id", mark, "ids"])

    return map_arrow(found, run, f"doc_id long, {mark} long, ids binary")


def read_shuffled(spark: SparkSession, path: str, index_path: str, seed: int) -> DataFrame:
    """All records in a random order that the seed decides: position (random key), doc_id, ids. The order is drawn over the index."""
    order = spark.read.schema(INDEX).parquet(index_path).withColumn("position", F.xxhash64(F.lit(seed), "file", "ordinal"))
    return read_records(spark, path, order, "position").select("position", "doc_id", "ids").orderBy("position", "doc_id")


def placed(index: DataFrame) -> DataFrame:
    """The index with start, the number of ids in all records before.

    Within a file the sums follow its ordinals; the files' totals, one row each, are summed in one window, by the files' numbers
    (a name has five digits at least, and more from the 100,000th file on).
    """
    number = F.regexp_extract("file", "part-([0-9]+)", 1).cast("long")
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = index.groupBy("file").agg(F.sum("n_tokens").alias("n_tokens")).select("file", before.alias("base"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return index.withColumn("inside", inside).join(bases, "file").withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside")


def digests(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of all records, read through the index."""
    ids = read_records(spark, path, placed(spark.read.schema(INDEX).parquet(index_path)), "start")
    return ids.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
