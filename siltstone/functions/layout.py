"""Arithmetic of shards and buckets. Parallelism is a parameter, so a layout does not depend on the machine."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import StoreFormatError

TARGET_BYTES, LEAST_BYTES, TASKS_PER_CPU = 128 * 1024, 4096, 4
#: What the writer aims at instead: files that suit a distributed file system.
FILE_BYTES = 64 << 20
ITEMS_PER_BUCKET, MOST_BUCKETS = 2000, 1024
#: Folders of a vector until those are of FILE_BYTES: each costs the driver time, however small its files are.
MOST_FOLDERS = 64


def items_per_shard(n: int, average_bytes: int, cpus: int = 8, target: int = TARGET_BYTES, least: int = LEAST_BYTES) -> int:
    """Items of a shard: the smaller of the size goal and an even share of the tasks, but no tiny shards."""
    a = max(average_bytes, 1)
    size = min(max(target // a, 1), max(n // (TASKS_PER_CPU * cpus), 1))
    return size if size * a >= least else max(least // a, 1)


def num_buckets(n: int) -> int:
    return 0 if n == 0 else min(max(n // ITEMS_PER_BUCKET, 1), MOST_BUCKETS)


def runs(n: int, size: int) -> list[tuple[int, int]]:
    """(item_count, repeat) of the shards of n items."""
    if size < 1:
        raise StoreFormatError("a shard holds one item at least")
    full, rest = divmod(n, size)
    return [(size, full)] * (full > 0) + [(rest, 1)] * (rest > 0)


def shards_per_folder(shards: int, size: int, average_bytes: int = 256) -> int:
    """Neighbouring shards that share a folder: one while there are few, else as many as keep the folders few, to the size goal."""
    return max(1, min(-(-shards // MOST_FOLDERS), FILE_BYTES // max(average_bytes * size, 1)))


def collapse(sizes: Iterable[int]) -> list[tuple[int, int]]:
    """Run-length code of any shard sizes."""
    out: list[tuple[int, int]] = []
    for size in sizes:
        if out and out[-1][0] == size:
            out[-1] = (size, out[-1][1] + 1)
        else:
            out.append((size, 1))
    return out


def locate(index: int, table: list[tuple[int, int]]) -> tuple[int, int]:
    """(shard, place in it) of a position; raises where there is none."""
    shard, rest = 0, index
    if index >= 0:
        for items, repeat in table:
            if rest < items * repeat:
                return shard + rest // items, rest % items
            rest -= items * repeat
            shard += repeat
    raise StoreFormatError(f"index {index} is out of range")


def bucket(key: Column, buckets: int) -> Column:
    """The bucket of a key; with a literal key it folds to a constant, which prunes partitions."""
    return F.pmod(F.xxhash64(key), F.lit(max(buckets, 1)).cast("long")).cast("int")


def shard_index(pos: Column, size: int) -> Column:
    return F.floor(pos / size).cast("long")
