"""Rows from whole texts: functions of one text that give tuples, run over tables in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch that goes back to Spark, at most.
ROWS = 1 << 16


def each_text(df: DataFrame, keys: list[str], text: str, function: Callable[..., Iterable[tuple]], columns: str, also: list[str | Column] | None = None) -> DataFrame:
    """The keys of every row with a text, once for each tuple that function(text, *also) gives; columns is their schema as DDL.

    A null text gives no rows. A text is handled whole, its rows leave in batches. Rows are handled one by one, so repeated ones
    give repeated results. Other columns of df are ignored, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    source = df.where(F.col(text).isNotNull()).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(text).alias("__text"), *[(F.col(c) if isinstance(c, str) else c).alias(f"__a{i}") for i, c in enumerate(also or [])])
    given = df.select(*keys).schema.fields
    schema = T.StructType([*given, *T.StructType.fromDDL(columns).fields])
    arrow, width, extra = to_arrow_schema(schema), len(keys), len(also or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            places: list[int] = []
            more = [batch.column(f"__a{i}").to_pylist() for i in range(extra)]
            for i, values in enumerate(zip(batch.column("__text").to_pylist(), *more, strict=True)):
                for row in function(*values):
                    found.append(row)
                    places.append(i)
                    if len(found) == ROWS:
                        yield made(batch, found, places)
                        found, places = [], []
            if found:
                yield made(batch, found, places)

    def made(batch: pa.RecordBatch, found: list[tuple], places: list[int]) -> pa.RecordBatch:
        at = pa.array(places, pa.int64())
        new = [pa.array(c, type=arrow.field(width + i).type) for i, c in enumerate(zip(*found, strict=True))]
        return pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(width)), *new], names=arrow.names)

    return source.mapInArrow(run, schema)


def matches(df: DataFrame, keys: list[str], text: str, pattern: str, group: int = 0) -> DataFrame:
    """The keys with `start`, `end` (code points, end exclusive) and `found` of each match of a pattern, a Python one.

    Spark's own functions give what a pattern matches, but not where.
    """
    compiled = re.compile(pattern)

    def function(value: str) -> Iterator[tuple]:
        return ((m.start(group), m.end(group), m[group]) for m in compiled.finditer(value))

    return each_text(df, keys, text, function, "start long, end long, found string")


def line_starts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The keys with `line` (from 1) and `line_start` (code points) of each line of the text; an empty text has one."""

    def function(value: str) -> Iterator[tuple]:
        at, line = 0, 1
        while True:
            yield line, at
            at = value.find("\n", at) + 1
            line += 1
            if not at:
                return

    return each_text(df, keys, text, function, "line long, line_start long")
