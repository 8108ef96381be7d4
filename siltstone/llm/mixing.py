"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks, native.

Each source is a stream of words: its documents in an order drawn from seeded MD5 keys, cut into blocks of equal
length; in a source of fewer than ``FINE`` such blocks they shrink, down to a word, so that small sources meet their
targets too. The blocks of the mix are apportioned to sources by the Sainte-Lague method, for each output shard: its
highest quotients t/1, t/3, t/5, ... down to a divisor are exactly those of round(t / divisor) seats, so with the block
length as the divisor no list of quotients is sorted. The first j shards have round(target * j / shards / block) seats
of a source, and ``quotas`` holds the integer quota of each shard; they add up to the source's seats. The seats of a
source are numbered shard by shard, and seat k takes the block that a seeded permutation puts at place k modulo the
number of blocks, so no block is taken more than once oftener than another. What the pipeline puts out of a document
are the words of its chosen blocks, ``taken`` words in all.

The prefix sums of a stream are taken in buckets of the seeded key (a window for each source and bucket, over about
256 documents), so no source, however large, meets in one task. Equal rows are counted first and told apart by a
copy number; null ids and repeated rows need no special care.

Defined results: null or blank text has size 0 and is taken 0 times; the null source is a source and comes last; an
empty table gives an empty result. The table of sources is one row per distinct source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpoint, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: A prime above every number of blocks; times b modulo the number of blocks it permutes the blocks.
PRIME = 2147483647
LEAST_BLOCK, BLOCKS, FINE = 64, 1 << 20, 128
SHARDS = 16
SEED = 11


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) to those and weight, target: shares by weight, none above ``most`` sizes, excess reshared.

    Capping and resharing until none is above ends at target = min(level * weight, cap). With sources sorted by
    cap / weight, the level follows from prefix sums, without rounds.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w.cast("long")).withColumn("_cap", F.col("source_size") * most)
    s = s.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    order = W.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    s = s.withColumn("_level", (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    s = s.withColumn("_free", F.when(F.col("_level") < F.col("_ratio"), F.col("_ratio")))
    s = s.withColumn("_at", F.min(F.struct("_free", F.when(F.col("_free").isNotNull(), F.col("_level")).alias("_level"))).over(every))
    first = F.min(F.when(F.col("_free").isNotNull(), F.struct("_free", "_level"))).over(every)
    s = s.withColumn("_first", first)
    target = F.when(F.col("_first").isNull() | (F.col("_ratio") < F.col("_first._free")), F.col("_cap").cast("double")).otherwise(F.col("_first._level") * F.col("weight"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def plan(sizes: DataFrame, seed: int = SEED, shards: int = SHARDS) -> DataFrame:
    """The sources with block length, number of blocks, the quotas of all shards, their sum and the seeded offset of the selection.

    ``edges`` holds where the seats of each shard begin, and last the number of all.
    """
    common = F.greatest(F.lit(LEAST_BLOCK), F.floor(F.sum("source_size").over(W.partitionBy()) / BLOCKS))
    t = targets(sizes).withColumn("block", F.greatest(F.lit(1), F.least(common, F.floor(F.col("source_size") / FINE))).cast("long"))
    t = t.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    edge = lambda j: F.least(F.floor(F.col("target") * j / shards / F.col("block") + 0.5).cast("long"), F.col("n_blocks") * MOST)
    t = t.withColumn("edges", F.transform(F.sequence(F.lit(0), F.lit(shards)), edge))
    t = t.withColumn("quotas", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.get("edges", j + 1) - F.get("edges", j)))
    t = t.withColumn("seats", F.aggregate("quotas", F.lit(0).cast("long"), lambda acc, q: acc + q))
    name = F.concat_ws("|", F.lit(str(seed)), F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source"))))
    return t.withColumn("offset", F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"))


def _spread(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> tuple[DataFrame, bool]:
    """Every row's id, source, size, copy number, whole takes ``_times`` and passages ``_runs`` taken once more.

    A passage (``at``, ``n``) is a run of chosen blocks within the document, in words. ``_parts`` has the words that each
    seat takes of the document, with the seat's shard. With it goes whether any rows agree in id, source and size.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"))
    grouped = checkpoint(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_n")))
    planned = checkpoint(plan(grouped.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")), seed))
    total = grouped.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    digits = next(d for d in range(1, 7) if total / 16**d <= 256 or d == 6)
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("n")), F.col("size"), F.col("_copy")))
    each = grouped.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy"))
    each = each.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, digits))
    tagged = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    each = checkpoint(each.withColumn("_src", tagged))
    before = W.partitionBy("_src").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = each.groupBy("_src", "_bucket").agg(F.sum("size").alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    inside = W.partitionBy("_src", "_bucket").orderBy("_key", "doc_id", "size", "_copy").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = each.withColumn("_end", F.sum("size").over(inside)).join(buckets.drop("_sum"), ["_src", "_bucket"]).drop("source")
    placed = placed.join(planned.withColumn("_src", tagged), "_src")
    start, end = F.col("_base") + F.col("_end") - F.col("size"), F.col("_base") + F.col("_end")
    placed = placed.withColumns({"_start": start, "_stop": end})
    block = F.col("block")
    place = lambda b: (b * PRIME + F.col("offset")) % F.col("n_blocks")
    extra = lambda b: place(b) < F.col("seats") % F.col("n_blocks")
    first, last = F.floor(F.col("_start") / block), F.floor((F.col("_stop") - 1) / block)
    spans = F.sequence(first, last)
    opens = F.filter(spans, lambda b: extra(b) & ((b == first) | ~extra(b - 1)))
    ends = F.filter(spans, lambda b: extra(b) & ((b == last) | ~extra(b + 1)))

    def run(b, e):
        at = F.greatest(F.col("_start"), b * block)
        return F.struct((at - F.col("_start")).alias("at"), (F.least(F.col("_stop"), (e + 1) * block) - at).alias("n"))

    def seats_of(b):
        """A seat for each time that the block is taken: its shard, and the words that lie in the document."""
        n = F.least(F.col("_stop"), (b + 1) * block) - F.greatest(F.col("_start"), b * block)
        shard = lambda seat: (F.size(F.filter("edges", lambda e: e <= seat)) - 1).cast("int")
        turns = F.filter(F.transform(F.sequence(F.lit(0), F.lit(MOST)), lambda m: place(b) + m * F.col("n_blocks")), lambda seat: seat < F.col("seats"))
        return F.transform(turns, lambda seat: F.struct(shard(seat).alias("shard"), n.alias("n")))

    some = F.col("size") > 0
    times = F.when(some, F.floor(F.col("seats") / F.col("n_blocks")).cast("int")).otherwise(0)
    runs = F.when(some, F.zip_with(opens, ends, run)).otherwise(F.expr("cast(array() as array<struct<at: bigint, n: bigint>>)"))
    parts = F.when(some, F.flatten(F.transform(spans, seats_of))).otherwise(F.expr("cast(array() as array<struct<shard: int, n: bigint>>)"))
    return placed.select("doc_id", "source", "size", "source_size", "target", "_copy", times.alias("_times"), runs.alias("_runs"), parts.alias("_parts")), not grouped.where("_n > 1").isEmpty()


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, copies and parts.

    ``taken`` counts the words that the seats take of the document, ``parts`` has them by seat with the seat's shard, and
    ``copies`` counts the records of ``take`` that hold them.
    """
    spread, _ = _spread(df, id_col, text_col, source_col, seed)
    taken = F.aggregate("_parts", F.lit(0).cast("long"), lambda acc, p: acc + p["n"])
    copies = (F.col("_times") + (F.size("_runs") > 0).cast("int")).cast("long")
    return spread.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"), F.col("_parts").alias("parts"))


def take(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The mix: records of ``df``, all columns, whose texts hold just the ``taken`` words of each document.

    A document comes whole as often as all its blocks are chosen; the passages chosen once more make one further
    record, each passage from a new line on, white space within passages as it was. Other columns are carried along as they are.
    """
    spread, repeated = _spread(df, id_col, text_col, source_col, seed)
    chosen = spread.where((F.col("_times") > 0) | (F.size("_runs") > 0)).select(F.col("doc_id").alias("_k1"), F.col("source").alias("_k2"), F.col("size").alias("_k3"), F.col("_copy").alias("_k4"), "_times", "_runs")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_rec"), F.col(id_col).alias("_d1"), F.col(source_col).alias("_d2"), F.size(words(F.col(text_col))).cast("long").alias("_d3"))
    text = F.col("_rec").getField(text_col)
    number = F.row_number().over(W.partitionBy("_d1", "_d2", "_d3").orderBy(F.xxhash64(text))) if repeated else F.lit(1)
    rows = rows.withColumn("_d4", number)
    joined = rows.join(chosen, [F.col(f"_d{k}").eqNullSafe(F.col(f"_k{k}")) for k in (1, 2, 3, 4)])
    each = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # every word with the white space before it
    passages = F.transform("_runs", lambda r: F.array_join(F.slice(each, (r["at"] + 1).cast("int"), r["n"].cast("int")), ""))
    once = F.when(F.size("_runs") == 0, F.expr("cast(array() as array<string>)")).when(F.col("_runs")[0]["n"] == F.col("_d3"), F.array(text)).otherwise(F.array(F.array_join(passages, "\n")))
    out = joined.select("_rec", F.explode(F.concat(F.array_repeat(text, F.col("_times")), once)).alias("_text"))
    return out.select(F.col("_rec").withField(f"`{text_col}`", F.col("_text")).alias("_rec")).select("_rec.*")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS copy FROM d),
k AS (SELECT *, md5(concat_ws('|', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), 'n'), CAST(size AS VARCHAR), CAST(copy AS VARCHAR))) AS key FROM c),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w, 2 * source_size AS cap FROM s0),
s2 AS (SELECT *, CAST(cap AS DOUBLE) / CAST(w AS DOUBLE) AS ratio FROM s1),
s3 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) - CAST(coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev FROM s2),
f AS (SELECT ratio AS fr, lev AS fl FROM s3 WHERE lev < ratio ORDER BY 1, 2 LIMIT 1),
s4 AS (SELECT source, source_size, CASE WHEN fr IS NULL OR ratio < fr THEN CAST(cap AS DOUBLE) ELSE fl * CAST(w AS DOUBLE) END AS target,
         greatest(1, least(greatest({LEAST_BLOCK}, CAST(sum(source_size) OVER () AS BIGINT) // {BLOCKS}), source_size // {FINE})) AS block FROM s3 LEFT JOIN f ON true),
s5 AS (SELECT *, CAST(ceil(source_size / block) AS BIGINT) AS nb,
         CAST(('0x' || substr(md5(concat_ws('|', '{SEED}', CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END)), 1, 8)) AS BIGINT) AS off FROM s4),
s6 AS (SELECT *, least(CAST(floor(target / block + 0.5) AS BIGINT), 2 * nb) AS seats FROM s5),
p AS (SELECT k.doc_id, k.size, s6.source_size, s6.target, block, nb, off, seats,
        CAST(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, k.size, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stop
      FROM k JOIN s6 ON k.source IS NOT DISTINCT FROM s6.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE list_sum(list_transform(range((stop - size) // block, (stop - 1) // block + 1),
  lambda b: (seats // nb + CASE WHEN (b * {PRIME} + off) % nb < seats % nb THEN 1 ELSE 0 END) * (least(stop, (b + 1) * block) - greatest(stop - size, b * block)))) END AS BIGINT) AS taken
FROM p
"""
