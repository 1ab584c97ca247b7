"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text handed to one call of a Python function at a time, so that memory doesn't follow Arrow's batch size.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 4 << 20

#: `[^\x20\x09-\x0D]+`: what lies between these six ASCII characters is a word. bytes.split() splits at just these.
WORD_GAP = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where none is set (local mode only)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="factgrid-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Keys that are sent to all tasks at most, 16 MB of numbers; where there are more, both sides of a join are shuffled.
MOST_KEYS = 1 << 20


def sent_if_few(keys: DataFrame) -> DataFrame:
    """The keys (a column of short values), to be broadcast if a count finds no more than MOST_KEYS of them."""
    return F.broadcast(keys) if keys.count() <= MOST_KEYS else keys


class Scratch:
    """Tables of one computation in the shared folder, each removed after its last use."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.kept: list[tuple[DataFrame, str]] = []
        self.names: dict[str, str] = {}

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """df written and read again."""
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((out, path))
        return out

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """df written in buckets of the key, one for each shuffle partition, and read again: joins on the key don't shuffle it."""
        path = fresh_path(self.spark, name)
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.names[path] = path.rsplit("/", 1)[1].replace("-", "_")
        df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(self.names[path])
        out = self.spark.table(self.names[path])
        self.kept.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes these tables; what isn't one of this computation's is left alone."""
        for df, path in self.kept:
            if any(df is t for t in tables):
                if path in self.names:
                    self.spark.sql(f"DROP TABLE {self.names.pop(path)}")
                delete(self.spark, path)
        self.kept = [x for x in self.kept if all(x[0] is not t for t in tables)]

    def drop_others(self, *keep: DataFrame) -> None:
        self.drop(*[df for df, _ in self.kept if all(df is not k for k in keep)])


def plain_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns of these names, whatever their case."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def pieces(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of that column; a longer value is a slice of its own."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def add_columns(df: DataFrame, column: str, fields: list[T.StructField], make: Callable[[], Callable[[list], list]], most: int = CHUNK_BYTES) -> DataFrame:
    """df with more columns, computed in Python from the string column, in chunks of about `most` bytes.

    make() runs once per task and returns the function from a list of texts (None where null) to one Arrow array or list
    per field. Columns of df with the name of a new one are replaced; all others pass through.
    """
    names = [f.name for f in fields]
    kept = without(df, names)
    schema = T.StructType([*kept.schema.fields, *fields])
    source = df.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(f"`{column}`").alias("__text"))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, width, all_names = to_arrow_schema(schema), len(kept.columns), schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for part in pieces(batch, "__text", most):
                new = function(part.column("__text").to_pylist())
                old = [part.column(i) for i in range(width)]
                cols = [x if isinstance(x, pa.Array) else pa.array(x, type=arrow.field(width + i).type) for i, x in enumerate(new)]
                yield pa.RecordBatch.from_arrays([*old, *cols], names=all_names)

    return map_arrow(source, run, schema)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with batches of about BATCH_BYTES, if the session still has the larger default. Workers serve one task after
    another, so what a task has freed goes back to the system at its end."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "67108864b":
        conf.set(key, f"{BATCH_BYTES}b")

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(trimmed, schema)


#: Functions whose results workers keep from task to task, with the calls that each had when the last task ended.
_KEPT: dict[Callable, int] = {}


def kept(most: int) -> Callable[[Callable], Callable]:
    """lru_cache for what tasks of one kind share: a task that doesn't ask for it makes the worker forget it."""

    def wrap(function: Callable) -> Callable:
        cached = functools.lru_cache(maxsize=most)(function)
        _KEPT[cached] = 0
        return cached

    return wrap


def give_back() -> None:
    """Forgets what the task that ends didn't use, and returns memory that Arrow and the C library hold but don't use; a C library
    without malloc_trim keeps its own."""
    for cached, before in _KEPT.items():
        info = cached.cache_info()
        _KEPT[cached] = info.hits + info.misses
        if _KEPT[cached] == before and info.currsize:
            cached.cache_clear()
            _KEPT[cached] = 0
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def field(name: str, kind: str, nullable: bool = True) -> T.StructField:
    return T.StructField(name, T.DataType.fromDDL(kind), nullable)


def binary_array(flat: bytes | memoryview, offsets: np.ndarray) -> pa.Array:
    """A binary Arrow array whose value i is flat[offsets[i]:offsets[i+1]]."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int32)), pa.py_buffer(flat)])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings of an Arrow column, one after another, and their bounds; a null one is empty."""
    column = pc.cast(pc.fill_null(column, ""), pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of every range, one range after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser over uint64 values (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
