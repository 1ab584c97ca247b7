"""Byte-level BPE encoding and decoding with numpy, for whole tables of documents.

Pieces of text (the matches of the split pattern) are merged together in matrices: pieces of like length share a matrix
with one row each, and in each round every row merges its leftmost pair of the lowest rank. Ranks of pairs come from a hash
table in arrays; a merged row is compacted to the left, and rows without a further pair leave the matrix.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, add_columns, binary_array, field, kept, ranges
from .pretokens import EMPTY, HashIndex, PieceStore, TextEncoder

NO_PAIR = np.int32(np.iinfo(np.int32).max)
#: Row lengths of the matrices. Longer pieces are merged one by one with a heap, which gives the same ids.
BUCKETS = (2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 128, 256)
#: Cells of a matrix.
CELLS = 1 << 20
#: A vocabulary file above this is refused: its bytes go to every task.
MAX_VOCABULARY_BYTES = 64 << 20


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, read on the driver; its size is checked, as every task gets it."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: larger than {MAX_VOCABULARY_BYTES} bytes")
    return data


class PairTable:
    """Ranks of byte strings, and of the pairs that merge into one."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no rank for the bytes {missing}")
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.token_length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        pairs = [(a << 32 | b, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        self.index = HashIndex(2 * len(pairs))
        self.index.add(np.array([k for k, _ in pairs], dtype=np.uint64), np.array([r for _, r in pairs], dtype=np.int32))

    @functools.cached_property
    def pairs(self) -> dict[int, int]:
        """Ranks by left << 32 | right, made for the first piece that is merged with a heap."""
        used = self.index.keys != EMPTY
        return dict(zip(self.index.keys[used].tolist(), self.index.values[used].tolist(), strict=True))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_PAIR where it doesn't merge; a negative id is no token."""
        out = np.full(left.shape, NO_PAIR, dtype=np.int32)
        real = np.flatnonzero((left >= 0) & (right >= 0))
        found = self.index.find((left[real].astype(np.uint64) << np.uint64(32)) | right[real].astype(np.uint64))
        out[real] = np.where(found < 0, NO_PAIR, found)
        return out

    def merge_rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rows: ids, one piece a row, padded with -1. Returns the merged rows and their lengths."""
        n, width = rows.shape
        done, lengths = np.full_like(rows, -1), np.zeros(n, dtype=np.int64)
        index = np.arange(n)
        ranks = self.rank(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(n, width - 1)
        length = (rows >= 0).sum(axis=1)
        columns = np.arange(width)
        while len(index):
            best = ranks.argmin(axis=1)
            lowest = ranks[np.arange(len(index)), best]
            over = lowest == NO_PAIR
            if over.any():
                gone = index[over]
                done[gone, : rows.shape[1]], lengths[gone] = rows[over], length[over]
                stay = np.flatnonzero(~over)
                if not len(stay):
                    break
                width = int(length[stay].max())
                index, rows, ranks, length, best, lowest = index[stay], rows[stay, :width], ranks[stay, : width - 1], length[stay], best[stay], lowest[stay]
                columns = columns[:width]
            here = np.arange(len(index))
            behind = columns[None, :] > best[:, None]
            moved = np.concatenate([rows[:, 1:], np.full((len(index), 1), -1, dtype=rows.dtype)], axis=1)
            rows = np.where(behind, moved, rows)
            rows[here, best] = lowest
            moved = np.concatenate([ranks[:, 1:], np.full((len(index), 1), NO_PAIR, dtype=ranks.dtype)], axis=1)
            ranks = np.where(behind[:, :-1], moved, ranks)
            after = best + 1
            ranks[here, np.minimum(best, width - 2)] = np.where(best < width - 1, self.rank(lowest, np.where(after < width, rows[here, np.minimum(after, width - 1)], -1)), NO_PAIR)
            inner = np.flatnonzero(best > 0)
            ranks[inner, best[inner] - 1] = self.rank(rows[inner, best[inner] - 1], lowest[inner])
            length = length - 1
        return done, lengths

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges for one long piece, with a heap of (rank, place)."""
        ids, pairs = list(ids), self.pairs
        n = len(ids)
        before, after, gone = list(range(-1, n - 1)), list(range(1, n + 1)), bytearray(n)
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or pairs.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], gone[j], after[i] = rank, 1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := pairs.get(rank << 32 | ids[after[j]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := pairs.get(ids[before[i]] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [x for x, out in zip(ids, gone, strict=True) if not out]

    def encode_pieces(self, content: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slices of the bytes, piece after piece, and the number of ids of each piece."""
        flat = self.of_byte[content]
        counts = np.ones(len(size), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        whole = np.flatnonzero(size <= 1)
        parts.append((whole, flat[start[whole]] if len(whole) else flat[:0], size[whole]))
        low = 1
        for width in BUCKETS:
            rows = np.flatnonzero((size > low) & (size <= width))
            low = width
            for at in range(0, len(rows), max(1, CELLS // width)):
                some = rows[at : at + max(1, CELLS // width)]
                cells = start[some, None] + np.arange(width)
                inside = np.arange(width) < size[some, None]
                merged, n = self.merge_rows(np.where(inside, flat[np.minimum(cells, len(flat) - 1)], np.int32(-1)))
                parts.append((some, merged[np.arange(width) < n[:, None]], n))
        for i in np.flatnonzero(size > low):
            ids = np.array(self.merge_long(flat[start[i] : start[i] + size[i]].tolist()), dtype=np.int32)
            parts.append((np.array([i]), ids, np.array([len(ids)])))
        for rows, _, n in parts:
            counts[rows] = n
        out = np.empty(int(counts.sum()), dtype=np.int32)
        begin = np.cumsum(counts) - counts
        for rows, ids, n in parts:
            out[ranges(begin[rows], n)] = ids
        return out, counts

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and the number of bytes of each id."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.token_length)):
            raise ValueError("an id is outside the vocabulary")
        n = self.token_length[ids]
        return self.token_bytes[ranges(self.token_start[ids], n)], n


@kept(2)
def _table(data: bytes) -> PairTable:
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}
    return PairTable(ranks)


@kept(2)
def _encoder(data: bytes, pattern: str) -> TextEncoder:
    """Kept for all tasks of a worker: what it has met before is known already."""
    return TextEncoder(PieceStore(_table(data).encode_pieces), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the column `ids`: the text's token ids as little-endian unsigned 32-bit integers (binary), and, if
    `decoded` names a column, the bytes that those ids decode to (binary).

    A null or empty text gives empty binary values. A text of any length is encoded whole; its pieces may have any length.
    Rows are independent: repeated rows give repeated results, an empty table an empty one. Columns of docs that are called
    like a new one are replaced; all other columns are kept.
    """
    data = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    fields = [field(ids, "binary", False), *([field(decoded, "binary", False)] if decoded else [])]

    def make():
        table = _table(data.value)
        encoder = _encoder(data.value, pattern)

        def run(texts: list) -> list:
            flat, counts = encoder.encode(texts)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            out: list[pa.Array] = [binary_array(flat.astype("<u4"), bounds * 4)]
            if decoded:
                content, sizes = table.decode(flat)
                out.append(binary_array(content, np.concatenate([[0], np.cumsum(sizes)])[bounds]))
            return out

        return run

    return add_columns(docs, text, fields, make, most=CHUNK_BYTES // 2)


def decode_documents(rows: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """rows with the column `decoded` (binary): the bytes of the ids in the binary column `ids`; null ids give empty bytes.

    An id outside the vocabulary, or a value that isn't whole 32-bit integers, is an error.
    """
    data = rows.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        table = _table(data.value)

        def run(values: list) -> list:
            each = [np.frombuffer(v or b"", dtype="<u4").astype(np.int64) for v in values]
            content, sizes = table.decode(np.concatenate(each))
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
            return [binary_array(content, np.concatenate([[0], np.cumsum(sizes)])[bounds])]

        return run

    return add_columns(rows, ids, [field(decoded, "binary", False)], make)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the two digests of rows with the columns ids and decoded."""
    return encoded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
