"""Sharding by a two-pass external shuffle, native.

Pass one scatters whole records by a seeded hash into buckets that fit into memory. Pass two orders each bucket by that
hash, permutes it with Spark's Fisher-Yates ``shuffle`` and gives every record its place in the whole: the bucket's
offset plus its place in the bucket. Shards are contiguous ranges of places, so their row counts differ by one at
most (law ``rows``), slots have no gaps, and a bucket is written by one task into one or two shards. The query writes
the shards and reports what it finds in them.

A record's identity is its id, size, CRC and a hash of all its columns. Equal records are counted and told apart by a
copy number, so a repeated row, a null id or a text with thousands of copies is scattered like any other. Neither the
partitioning of the input nor the order of its rows matters to the result: the records of a bucket are sorted before
they are permuted, and the permutation's seed is used on a fixed number of partitions in bucket order.

Defined results: null text has size 1 and the CRC of nothing; an empty table gives an empty result; all columns are
carried along, and have to be of types that Spark can order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import checkpoint, scratch, table

SEED = 7
#: Text of a bucket; a task holds ``BUCKETS_A_TASK`` of them, 64 MB. No more than ``MOST_BUCKETS`` are made; they are
#: then larger.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 8 << 20, 256, 1 << 20
BUCKETS_A_TASK = 8
#: Up to so many different repeated records are broadcast to be found; more are joined.
MOST_BROADCAST = 100_000
IDENTITY = ["_id", "_size", "_crc", "_all"]


def scatter(rows: DataFrame, identity: list[str], n_rows: int, seed: int, bucket_rows: int) -> tuple[DataFrame, int]:
    """Pass one: adds ``_hash`` and ``_bucket``, and deals rows out by bucket."""
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-n_rows // bucket_rows)))
    hashed = rows.withColumn("_hash", F.xxhash64(F.lit(seed), *[F.col(c) for c in identity]))
    return hashed.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_hash")), F.lit(buckets)).cast("int")), buckets


def permute(scattered: DataFrame, buckets: int, seed: int = SEED) -> DataFrame:
    """Pass two: adds ``_place``, 0 to rows - 1, a permutation drawn from the seed."""
    record = F.struct("_hash", *[c for c in scattered.columns if c not in ("_hash", "_bucket")])
    sizes = checkpoint(scattered.groupBy("_bucket").agg(F.count("*").alias("_n")))
    # one row per bucket, MOST_BUCKETS at most
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    width = max(1, buckets // BUCKETS_A_TASK)  # from the number of rows alone: permutations don't depend on the cluster
    full = scattered.repartition(width, "_bucket").groupBy("_bucket").agg(F.array_sort(F.collect_list(record)).alias("_all"))
    # Spark's Fisher-Yates draws from the seed and the partition's number, a bucket of a partition after the other
    mixed = full.sortWithinPartitions("_bucket").select("_bucket", F.shuffle("_all", F.lit(seed)).alias("_all"))
    each = mixed.join(F.broadcast(offsets), "_bucket").select("_offset", F.posexplode("_all").alias("_i", "_rec"))
    return each.select("_rec.*", (F.col("_offset") + F.col("_i")).alias("_place")).drop("_hash")


def into_ranges(placed: DataFrame, n_rows: int, shards: int) -> DataFrame:
    """``_place`` to shard and slot: the first n mod shards shards hold one row more."""
    small, more = divmod(n_rows, shards)
    edge = more * (small + 1)
    p = F.col("_place")
    shard = F.when(p < edge, F.floor(p / (small + 1))).otherwise(more + F.floor((p - edge) / max(small, 1))).cast("int")
    return placed.withColumn("shard", shard).withColumn("slot", (p - F.when(F.col("shard") < more, F.col("shard") * (small + 1)).otherwise(edge + (F.col("shard") - more) * small)).cast("long")).drop("_place")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_copy``: 1, or 1 to n for the n equal records of an identity."""
    repeated = checkpoint(rows.groupBy(*IDENTITY).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(c).alias(f"{c}_") for c in IDENTITY], "_n"))
    different = repeated.count()
    if not different:
        return rows.withColumn("_copy", F.lit(1))
    found = F.broadcast(repeated) if different <= MOST_BROADCAST else repeated
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in IDENTITY]
    # equal records are interchangeable: one is drawn before the shuffle and put out again n times
    once = rows.join(found, same, "left_semi").groupBy(*IDENTITY).agg(F.first("record").alias("record"), F.count("*").alias("_n"))
    copies = once.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(*rows.columns, "_copy")
    return rows.join(found, same, "left_anti").withColumn("_copy", F.lit(1)).union(copies)


def measures(id_col: Column, text_col: Column) -> list[Column]:
    """Id, size and CRC of a record."""
    body = F.encode(F.coalesce(text_col, F.lit("")), "UTF-8")
    return [id_col, (F.octet_length(body) + 1).cast("long"), F.crc32(body)]


def write_shards(df: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the whole records, shuffled, to ``path``/shard=k; read back in order of ``slot``.

    Buckets are sized by the bytes of text. The records are written out with their identities first: an input that is
    computed anew may differ.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    own = [*measures(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.xxhash64(F.lit(seed + 2), F.struct(*[F.isnull(c) for c in columns]), *columns)]
    rows = table(df.select(*[c.alias(k) for c, k in zip(own, IDENTITY, strict=True)], F.struct(*columns).alias("record")), "identified", compression="zstd")
    n_rows, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("_size") + 64), F.lit(0))).first()
    per_bucket = max(1, n_rows * bucket_bytes // max(n_bytes, 1))
    scattered, buckets = scatter(numbered(rows), [*IDENTITY, "_copy"], n_rows, seed, per_bucket)
    placed = into_ranges(permute(scattered.drop(*IDENTITY), buckets, seed), n_rows, shards)
    placed.select("record", "shard", "slot").write.partitionBy("shard").mode("overwrite").option("compression", "zstd").parquet(path)


def assign_shards(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """One row per record of the written shards: doc_id, size, text_crc32, shard, slot."""
    path = scratch(df.sparkSession, "shards")
    write_shards(df, path, shards, id_col, text_col, seed)
    form = StructType([StructField("record", StructType(df.schema.fields)), StructField("slot", LongType()), StructField("shard", IntegerType())])
    done = df.sparkSession.read.schema(form).parquet(path)
    own = measures(F.col("record").getField(id_col), F.col("record").getField(text_col))
    return done.select(*[c.alias(k) for c, k in zip(own, ["doc_id", "size", "text_crc32"], strict=True)], "shard", "slot")


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
