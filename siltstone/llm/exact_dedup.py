"""Exact deduplication by heavy-hitter split, native.

A Misra-Gries style frequent-items sketch (one per input partition, merged in two steps) names digests that may be
frequent; their exact counts are then taken and the verified winners, at most ``slots`` rows, are broadcast: rows of
a winner are decided where they lie. All other digests are shuffled in the ordinary way, and no group among them can
be larger than about rows / slots.

Defined results: null text counts as empty; white-space runs count as one space; of equal texts the row with the
smallest id stays (null ids last), and of repeated rows with that same id exactly one; an empty table gives an empty
result; further columns are carried by ``deduplicate`` and never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE_RE, checkpoint

SLOTS = 1024


def digest(text: Column) -> Column:
    return F.sha2(F.encode(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RE, " "), "UTF-8"), 256)


def frequent(df: DataFrame, key: str, slots: int = SLOTS) -> DataFrame:
    """At most ``slots`` values of ``key``, all that hold more than rows / slots * a small factor among them."""
    parts = df.groupBy((F.spark_partition_id() % 64).alias("_part")).agg(F.expr(f"approx_top_k_accumulate({key}, {slots * 2})").alias("_sketch"))
    # grouped by a constant: a task without rows then has no sketch to merge, which the function can't serialise
    merged = parts.groupBy(F.lit(0).alias("_all")).agg(F.expr(f"approx_top_k_combine(_sketch, {slots * 2})").alias("_sketch"))
    # the second count is an upper bound: keys met once or twice are no candidates
    found = merged.select(F.explode(F.expr(f"approx_top_k_estimate(_sketch, {slots})")).alias("_top"))
    return found.where("_top.count > 1").select(F.col("_top.item").alias(key))


def _keeper(key: str, id_: str, row: str) -> Column:
    return F.min(F.struct(F.col(id_).isNull().alias("_none"), F.col(id_).alias("_id"), F.col(row).alias("_row")))


def decide(rows: DataFrame, key: str, id_: str, row: str, slots: int = SLOTS) -> DataFrame:
    """Adds ``_keep`` (struct _none, _id, _row of the row that stays) and ``_n`` to checkpointed ``rows``."""
    candidates = F.broadcast(frequent(rows.where(F.col(key).isNotNull()), key, slots))
    winners = checkpoint(rows.join(candidates, key).groupBy(key).agg(_keeper(key, id_, row).alias("_keep"), F.count("*").alias("_n")).where("_n > 1"))
    marked = rows.join(F.broadcast(winners), key, "left")  # at most ``slots`` rows
    group = W.partitionBy(key)
    rest = marked.where("_keep is null").drop("_keep", "_n").withColumns({"_keep": _keeper(key, id_, row).over(group), "_n": F.count("*").over(group)})
    return marked.where("_keep is not null").select(*rest.columns).unionByName(rest)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = checkpoint(df.select(F.col(id_col).alias("_doc"), digest(F.col(text_col)).alias("_sha"), F.monotonically_increasing_id().alias("_row")))
    done = decide(rows, "_sha", "_doc", "_row", slots)
    return done.select(
        F.col("_doc").alias("doc_id"), F.col("_keep._id").alias("keep_id"), F.col("_n").alias("group_size"),
        (F.col("_row") == F.col("_keep._row")).alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """The kept records with all their columns. Whole records are shuffled only for texts that are no winners.

    Among records of the smallest id the one whose columns have the smallest hash stays, so reruns agree.
    """
    names = df.columns
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()])
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_rec"), F.col(id_col).alias("_doc"), digest(F.col(text_col)).alias("_sha"), tie.alias("_tie"))
    rows = checkpoint(whole.select("_doc", "_sha"))
    candidates = F.broadcast(frequent(rows, "_sha", slots))
    order = F.struct(F.col("_doc").isNull().alias("_none"), F.col("_doc").alias("_id"))
    winners = checkpoint(rows.join(candidates, "_sha").groupBy("_sha").agg(F.min(order).alias("_keep"), F.count("*").alias("_n")).where("_n > 1"))
    marked = whole.join(F.broadcast(winners.drop("_n")), "_sha", "left")
    # of a winner's rows only those with the smallest id pass the map side; repeats of it then meet, combined before
    heavy = marked.where(F.col("_keep").isNotNull() & F.col("_doc").eqNullSafe(F.col("_keep._id"))).groupBy("_sha").agg(F.min_by("_rec", "_tie").alias("_rec"))
    rest = marked.where("_keep is null").withColumn("_k", F.row_number().over(W.partitionBy("_sha").orderBy(F.col("_doc").asc_nulls_last(), "_tie"))).where("_k = 1")
    return heavy.select("_rec").unionByName(rest.select("_rec")).select("_rec.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256 FROM d
"""
