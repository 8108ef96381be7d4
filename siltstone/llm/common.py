"""What the training-data operators share: shared-folder tables, word splitting, plain hashing.

Everything that has to outlive a task goes to the folder named by ``spark.checkpoint.dir``; only where the
session has none (a local test) is a temporary one set.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts: \x20 and \x09-\x0D. ``bytes.split()`` without arguments uses the same set.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a session without a cluster may do without the setting."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        found = tempfile.mkdtemp(prefix="siltstone-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: Spark removes its files once the frame is out of use."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone already; nothing depends on this
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when this process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends, columns can be pruned."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._siltstone_path = path
    return back


def drop(written: DataFrame) -> None:
    """Remove the files of a ``table`` that nothing will read again."""
    _remove(written.sparkSession, written._siltstone_path)


def join_hot(rows: DataFrame, found: DataFrame, key: str, how: str = "inner", hot: int = 256) -> DataFrame:
    """``rows`` joined to ``found``, which holds each ``key`` once, where a key may hold a third of ``rows``.

    The ``hot`` most frequent keys have their row of ``found`` broadcast, ``hot`` rows at most, and their rows stay where
    they lie; only the rest is dealt out by key. Both frames are read twice, so they should be written ones.
    """
    often = rows.groupBy(key).agg(F.count("*").alias("_c")).where("_c > 1").orderBy(F.desc("_c"), key).limit(hot).select(key)
    top = found.join(F.broadcast(often), key).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(top), key, "left")
    rest = marked.where("_hot is null").select(*rows.columns).join(found, key, how)
    return marked.where("_hot").select(*rest.columns).unionByName(rest)


def words(text: Column) -> Column:
    """The words of a text as an array, native; null has none."""
    blank = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(blank, " "), "")


def split_number(key: Column, parts: int) -> Column:
    """crc32 of a key written as text, modulo ``parts``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts


def in_remainder(key: str | None, parts: int) -> int:
    """The same in Python."""
    return zlib.crc32((key or "").encode()) % parts


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each value without making Python strings; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    valid, offsets, data = column.buffers()[:3]
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    nulls = column.is_null().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield b"" if nulls and nulls[i] else bytes(view[at[i] : at[i + 1]])


class WordHash(dict):
    """64-bit xxHash of a word, remembered; forgets all when it holds ``most`` words, so memory is bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of strings and binaries in a slice that is handled at once; one longer value is a slice of its own.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, rows: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``most`` bytes, one row at least."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            size += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    end, start = np.cumsum(size), 0
    while start < batch.num_rows:
        held = int(end[start - 1]) if start else 0
        stop = max(start + 1, min(start + rows, int(np.searchsorted(end, held + most, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


def per_batch(df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema, rows: int = 256) -> DataFrame:
    """``mapInArrow`` over slices of ``rows`` rows at most. ``work()`` is called once a task and returns what handles a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = work()
        for batch in batches:
            for part in slices(batch, rows):
                yield handle(part)

    return df.mapInArrow(run, schema)
