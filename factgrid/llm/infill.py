"""Fill-in-the-middle: a document is cut at two random units, and its parts are put in another order between sentinels.

A unit is a run of ASCII letters, or any other single character. Texts lie in blocks of a fixed number of bytes; a Fenwick tree
over a document's blocks holds their units and code points. A cut's block is found by binary lifting down the tree, which gives
the code points before the block on the way; only that block is then searched for the unit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, map_arrow, pieces, text_bytes, without

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)


@dataclass(frozen=True)
class Rates:
    """Numbers from 0 to 99: from the first on a document stays plain; of the others, below the second the suffix comes first."""

    plain_from: int = 90
    spm_below: int = 20


class BlockTrees:
    """Fenwick trees over the blocks of many texts, one tree a text, in flat arrays."""

    def __init__(self, flat: np.ndarray, bounds: np.ndarray, block: int = 512):
        """flat: UTF-8 bytes of all texts (uint8), text i from bounds[i] to bounds[i+1]."""
        self.block, self.bounds = block, bounds
        size = np.diff(bounds)
        letter = ((flat | 0x20) >= 0x61) & ((flat | 0x20) <= 0x7A)
        self.point = (flat & 0xC0) != 0x80
        after_letter = np.zeros(len(flat), dtype=bool)
        after_letter[1:] = letter[:-1]
        after_letter[bounds[:-1][size > 0]] = False
        self.unit = self.point & ~(letter & after_letter)
        self.blocks = -(-size // block)
        self.first = np.cumsum(self.blocks) - self.blocks  # of each text's blocks, in all blocks
        begin = np.repeat(bounds[:-1], self.blocks) + block * (np.arange(int(self.blocks.sum())) - np.repeat(self.first, self.blocks))
        self.units, self.total_units = self._tree(self.unit, begin)
        self.points, self.total_points = self._tree(self.point, begin)

    def _tree(self, marks: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node k of a text (from 1) holds the marks of the lowbit(k) blocks up to block k. Also the marks of each text."""
        sums = np.add.reduceat(marks, begin, dtype=np.int64) if len(begin) else np.empty(0, dtype=np.int64)
        upto = np.concatenate([[0], np.cumsum(sums)])
        node = np.arange(len(begin)) - np.repeat(self.first, self.blocks) + 1
        here = np.repeat(self.first, self.blocks) + node
        return upto[here] - upto[here - (node & -node)], upto[self.first + self.blocks] - upto[self.first]

    def cut(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, the bytes and the code points of its first so many units (0 to all of them)."""
        at, rest, points = np.zeros(len(units), dtype=np.int64), units.astype(np.int64), np.zeros(len(units), dtype=np.int64)
        step = 1 << max(0, int(self.blocks.max(initial=0)).bit_length() - 1)
        while step:
            node = at + step
            inside = np.flatnonzero(node <= self.blocks)
            where = self.first[inside] + node[inside] - 1
            go = self.units[where] <= rest[inside]
            down, where = inside[go], where[go]
            at[down], rest[down], points[down] = node[down], rest[down] - self.units[where], points[down] + self.points[where]
            step >>= 1
        size = np.diff(self.bounds)
        whole = units >= self.total_units
        offset = np.where(whole, size, at * self.block)
        for i in np.flatnonzero(~whole).tolist():  # the unit that starts behind the cut is in block at[i]
            a = self.bounds[i] + offset[i]
            b = min(a + self.block, self.bounds[i + 1])
            place = int(np.flatnonzero(self.unit[a:b])[rest[i]])
            offset[i] += place
            points[i] += int(np.count_nonzero(self.point[a : a + place]))
        return offset, np.where(whole, self.total_points, points)


def random_numbers(doc_id: int | None) -> tuple[int, int, int, int]:
    """Two numbers that place the cuts and two that choose the form, from the id alone; a null id counts as an empty one."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))


def rearrange(doc_ids: list[int | None], flat: np.ndarray, bounds: np.ndarray, rates: Rates) -> tuple[list[int], list[str], list[int | None], list[int | None], list[bytes]]:
    """Units, form, code points of prefix and middle (None where plain), and the output, of each text."""
    trees = BlockTrees(flat, bounds)
    total = trees.total_units
    h = np.array([random_numbers(d) for d in doc_ids], dtype=np.int64).reshape(-1, 4)
    first, second = h[:, 0] % (total + 1), h[:, 1] % (total + 1)
    low, low_points = trees.cut(np.minimum(first, second))
    high, high_points = trees.cut(np.maximum(first, second))
    data = flat.tobytes()
    forms, prefixes, middles, outputs = [], [], [], []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        whole = data[a:b]
        if not whole or h[i, 2] % 100 >= rates.plain_from or any(s in whole for s in SENTINELS):
            forms.append("plain"), prefixes.append(None), middles.append(None), outputs.append(whole)
            continue
        p, m, s = whole[: low[i]], whole[low[i] : high[i]], whole[high[i] :]
        spm = h[i, 3] % 100 < rates.spm_below
        forms.append("spm" if spm else "psm"), prefixes.append(int(low_points[i])), middles.append(int(high_points[i] - low_points[i]))
        outputs.append(b"".join([SUFFIX, s, PREFIX, p, MIDDLE, m] if spm else [PREFIX, p, SUFFIX, s, MIDDLE, m]))
    return total.tolist(), forms, prefixes, middles, outputs


def fill_in_middle(docs: DataFrame, rates: Rates = Rates(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n (units of the text), form (plain, psm, spm), prefix_chars, middle_chars (code points) and output.

    A null or empty text stays plain, with an empty output; so does one that holds a sentinel, as it couldn't be rebuilt. A text
    of any length is cut whole, in memory by its length. Cuts and form follow the id, so repeated rows give repeated results; a
    null id counts as an empty one. Columns of docs with the name of a new one are replaced; an empty table gives an empty one.
    """
    new = [field("n", "long", False), field("form", "string", False), field("prefix_chars", "long"), field("middle_chars", "long"), field("output", "string", False)]
    kept = without(docs, [f.name for f in new])
    schema = T.StructType([*kept.schema.fields, *new])
    names, width = schema.fieldNames(), len(kept.columns)
    source = docs.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(f"`{doc_id}`").cast("long").alias("__id"), F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text"):
                flat, bounds = text_bytes(part.column("__text"))
                n, form, prefix, middle, output = rearrange(part.column("__id").to_pylist(), flat, bounds, rates)
                made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pc.cast(pa.array(output, pa.binary()), pa.string())]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(width)], *made], names=names)

    return map_arrow(source, run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; a null output or form gives null."""
    parts = F.split(output, "|".join(s.decode() for s in SENTINELS), -1)  # parts[0] is empty
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1]))


def digests(cut: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and digests of the output and of the text rebuilt from it."""
    hexed = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hexed(F.col("output")).alias("output_sha256"), hexed(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: The query's rows in SQL; units are matched by a regular expression, and prefix and middle are joined units.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), k AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || substr(h, 1 + 8 * i, 8) AS BIGINT) FOR i IN range(4)] AS h FROM d
), c AS (
  SELECT doc_id, t, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k
), p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""
