"""Quality rules by a hashed n-gram log-likelihood ratio, native.

Words and pairs of words are hashed into ``BUCKETS`` cells. Two multinomials are counted with add-``ALPHA`` smoothing:
one over the trusted texts, one over the whole raw corpus. A text's score is the mean, over its words and pairs, of
log(trusted / raw); it passes if that mean is at least ``THRESHOLD``, the same fixed number for every text. The counts
of the raw corpus cover all documents; the trusted texts are those of at most ``MOST_TRUSTED`` labelled good rows,
taken in order of a hash of their id, so that their ids can be broadcast (160 kB).

Texts are handled within their row: no text is ever spread over rows except to count cells, which are combined before
they are shuffled, 2 * BUCKETS rows a task.

Defined results: null, empty or blank text has no words, fails the base rules and scores 0; an empty table gives an
empty result; without any trusted text every ratio is that of the smoothing alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, words

BUCKETS = 8192
ALPHA = 1.0
MOST_TRUSTED = 20_000
THRESHOLD = -0.08


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _pairs(h: Column, n: Column) -> Column:
    at = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)))


def cells(h: Column) -> Column:
    """The cells of all words and pairs of words."""
    return F.transform(F.concat(h, _pairs(h, F.size(h))), lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))


def repeat_words(h: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Windows are 64-bit hashes, of which 48 bits are compared in texts below 65,536 words and one less for each doubling:
    a text of 20,000 words that has a repeated window gets a false one with probability 7e-7. Where all differ there is nothing to do. Otherwise windows are sorted by hash with their
    place in the low bits; equal neighbours give the places, and each place stands for up to three words.
    """
    n = F.size(h)
    at = F.sequence(F.lit(0), n - 3)
    windows = F.transform(at, lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
    bits = F.greatest(F.lit(16), F.ceil(F.log2(n.cast("double") + 1)).cast("int"))

    def covered(win: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        keyed = F.array_sort(F.transform(win, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))

        def places(k: Column) -> Column:
            same = lambda a, b: F.coalesce(F.call_function("shiftright", F.get(k, a), bits) == F.call_function("shiftright", F.get(k, b), bits), F.lit(False))
            return F.transform(F.filter(at, lambda j: same(j, j + 1) | same(j, j - 1)), lambda j: F.get(k, j).bitwiseAND(low))

        return F.size(F.array_distinct(F.flatten(F.transform(F.transform(F.array(keyed), places)[0], lambda p: F.array(p, p + 1, p + 2)))))

    once = lambda win: F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(covered(win))
    return F.when(n < 4, F.lit(0)).otherwise(F.transform(F.array(windows), once)[0]).cast("long")


def features(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return {
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long"),
    }


def ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log(trusted / raw) of each cell. Only BUCKETS rows reach the driver."""
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_good")).where("_good is not null").distinct()
    good = good.orderBy(F.xxhash64("_good"), "_good").limit(MOST_TRUSTED).withColumn("_trusted", F.lit(1))
    marked = docs.select("doc_id", word_hashes(F.col("text")).alias("_h")).join(F.broadcast(good), F.col("doc_id") == F.col("_good"), "left")
    each = marked.select("_trusted", F.explode(cells(F.col("_h"))).alias("cell"))
    counted = each.groupBy("cell").agg(F.count("*").alias("raw"), F.count("_trusted").alias("trusted")).collect()
    raw, trusted = [ALPHA] * BUCKETS, [ALPHA] * BUCKETS
    for r in counted:
        raw[r.cell] += r.raw
        trusted[r.cell] += r.trusted
    all_raw, all_trusted = sum(raw), sum(trusted)
    return [math.log(t / all_trusted) - math.log(r / all_raw) for t, r in zip(trusted, raw, strict=True)]


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the base counts, base_failed, llr (per word or pair) and kept."""
    llr = F.lit(ratios(docs, labels))
    # a generator of one row: filters on the result don't pass it, so the hashes are never written out in their place
    rows = docs.select("doc_id", F.explode(F.array(word_hashes(F.col("text")))).alias("_h"), *[c.alias(k) for k, c in features(F.col("text")).items()])
    n = F.size("_h").cast("long")
    total = F.aggregate(cells(F.col("_h")), F.lit(0.0), lambda acc, c: acc + F.get(llr, c))
    rows = rows.select("doc_id", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeat_words(F.col("_h")).alias("n_repeat_words"), F.when(n > 0, F.round(total / (2 * n - 1), 9)).otherwise(0.0).alias("llr"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    done = quality(docs.select("doc_id", "text"), labels)
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
