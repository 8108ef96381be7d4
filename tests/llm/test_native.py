"""Quality rules, mixing and sharding against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from conftest import write_tables
from pyspark.sql import functions as F
from siltstone.llm import mixing, quality, sharding
from siltstone.llm.common import words as words_of

SPACE = re.compile("[\x20\x09-\x0d]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


# --- quality ---


def base(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {x for x, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, x in enumerate(windows) if x in often for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n = len(covered)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), n, len(w) < 50 or 100 * n > 50 * len(w))


@pytest.fixture(scope="module")
def labels(spark, odd):
    ids = sorted({r.doc_id for r in odd.select("doc_id").collect()} - {None})
    return spark.createDataFrame([(i, int(k % 3 > 0), 0) for k, i in enumerate(ids[:90])] + [(None, 1, 1), (ids[0], 1, 0)], "doc_id bigint, quality int, toxic int")


def test_quality(spark, odd, labels):
    rows = spark.createDataFrame([(9000 + k, t) for k, t in enumerate(["a b c a b c", "a a a a", "a b a b a", "x y z " * 30, "p q r s " * 5 + " ".join(map(str, range(60))), "a\n a\na\n\n\nb", "a b\tc\x0bd\x0ce\rf"])], "doc_id bigint, text string")
    docs = odd.select("doc_id", "text").union(rows)
    got = quality.quality(docs, labels)
    want = Counter((r.doc_id, *base(r.text)) for r in docs.collect())
    out = got.collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    assert all(r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD) for r in out)


def test_quality_ratio(spark):
    """The ratio from plain counts of the same cells."""
    docs = spark.createDataFrame([(1, "good words here"), (2, "bad words there"), (3, "good good text"), (4, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    cells = {r.doc_id: r.c for r in docs.select("doc_id", quality.cells(quality.word_hashes(docs.text)).alias("c")).collect()}
    raw, good = Counter(c for x in cells.values() for c in x), Counter(c for k in (1, 3) for c in cells[k])
    n_raw, n_good = (sum(x.values()) + quality.BUCKETS for x in (raw, good))
    for r in quality.quality(docs, labels).collect():
        want = sum(math.log((good[c] + 1) / n_good) - math.log((raw[c] + 1) / n_raw) for c in cells[r.doc_id]) / max(1, len(cells[r.doc_id]))
        assert abs(r.llr - want) < 1e-8


def test_quality_empty(spark, empty, labels):
    assert quality.quality(empty, labels).count() == 0
    none = spark.createDataFrame([], labels.schema)
    assert quality.quality(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), none).first().base_failed


def test_quality_on_tables(spark):
    """Rows labelled good have the higher mean ratio."""
    d = "/root/testdata/sf0.01"
    got = quality.op8_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    rate = {r.quality: r.rate for r in got.groupBy("quality").agg({"llr": "avg"}).withColumnRenamed("avg(llr)", "rate").collect()}
    assert rate[1] > rate[0]


# --- mixing ---


def targets(sizes):
    """By rounds: cap, reshare, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        share = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if share * weight[s] > 2 * sizes[s]]
        if not over:
            return fixed | {s: share * weight[s] for s in free}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mix(odd):
    got = mixing.mix(odd).collect()
    rows = odd.collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((r.doc_id, r.source, len(words(r.text))) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(words(r.text))
    want = targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 2 * mixing.LEAST_BLOCK for s in want)
    assert Counter(map(repr, mixing.mix(odd.repartition(3)).collect())) == Counter(map(repr, got))


def test_quotas_are_the_highest_quotients(spark):
    sizes = spark.createDataFrame([("a", 50_000), ("b", 20_000), ("c", 30_000), (None, 9_000)], "source string, source_size long")
    planned = mixing.plan(sizes).collect()
    block, t = {r.block for r in planned}, {r.source: r.target for r in planned}
    assert block == {mixing.LEAST_BLOCK}
    for upto in (1, 5, mixing.SHARDS):  # the house of the first shards, by the quotients of their share of the targets
        seats = {r.source: sum(r.quotas[:upto]) for r in planned}
        house = sorted(((t[s] * upto / mixing.SHARDS / (2 * k + 1), s) for s in t for k in range(3000)), key=lambda x: -x[0])[: sum(seats.values())]
        assert Counter(s for _, s in house) == {s: n for s, n in seats.items() if n}
    assert all(r.edges[-1] == r.seats == sum(r.quotas) for r in planned)


def test_small_sources_and_shards(spark):
    """A source of ten words gets its twenty, and every shard takes its quota of every source."""
    rng = __import__("random").Random(6)
    rows = [(k, " ".join("w" for _ in range(rng.randrange(1, 400))), "abc"[k % 3]) for k in range(300)] + [(1000, "one two three four five six", None), (1001, "seven eight nine ten", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(df).collect()
    taken, by_shard = Counter(), Counter()
    for r in got:
        taken[r.source] += r.taken
        for p in r.parts:
            by_shard[r.source, p.shard] += p.n
    planned = {r.source: r for r in mixing.plan(spark.createDataFrame([(r.source, r.source_size) for r in got], "source string, source_size long").distinct()).collect()}
    assert planned[None].target == 20 and taken[None] == 20
    assert all(abs(taken[s] - r.target) <= 0.02 * r.target for s, r in planned.items())
    for s, r in planned.items():
        for j, q in enumerate(r.quotas):
            short = r.n_blocks * r.block - r.source_size  # the last block may hold fewer words
            assert q * r.block - 2 * short <= by_shard[s, j] <= q * r.block


def test_mix_empty(empty):
    assert mixing.mix(empty).count() == 0


def test_take_puts_out_what_is_taken(spark, odd, empty):
    """The words put out of each document are those that the query counts, long documents and few of them included."""
    few = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20_000)), "a"), (2, " v\n ".join(f"u{k}" for k in range(900)), "b")], "doc_id bigint, text string, source string")
    for df in (odd, few):
        got, want, held = mixing.take(df), Counter(), Counter()
        assert got.columns == df.columns
        sizes, targets_by = Counter(), {}
        for r in mixing.mix(df).collect():
            want[r.doc_id, r.source] += r.taken
            targets_by[r.source] = r.target
        for r in got.collect():
            held[r.doc_id, r.source] += len(words(r.text))
            sizes[r.source] += len(words(r.text))
        assert held == +want
        assert all(abs(sizes[k] - t) <= 2 * mixing.LEAST_BLOCK for k, t in targets_by.items())
    whole = {r.doc_id: r.text for r in few.collect()}
    assert all(line in whole[r.doc_id] for r in mixing.take(few).where("doc_id = 1").collect() for line in r.text.split("\n"))
    assert mixing.take(empty).count() == 0


def test_mix_sql(spark, odd, tmp_path):
    d = write_tables(spark, tmp_path, odd.where("doc_id is not null"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    want = con.sql(f"SELECT {','.join(columns)} FROM ({mixing.OP9_SQL})").fetchall()
    assert Counter(map(tuple, mixing.op9_mix_sources(spark, d).select(*columns).collect())) == Counter(want)


# --- sharding ---


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards(spark, odd, shards):
    got = sharding.assign_shards(odd, shards).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(shards))
    sizes = [len(slots[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_do_not_depend_on_the_layout(spark, odd):
    before = Counter(map(tuple, sharding.assign_shards(odd).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 5)
        assert Counter(map(tuple, sharding.assign_shards(odd.repartition(9)).collect())) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert Counter(map(tuple, sharding.assign_shards(odd, seed=8).collect())) != before


def test_shards_mix_the_input(spark):
    """Places follow neither the order nor the groups of the input."""
    df = spark.range(8000).selectExpr("id as doc_id", "case when id < 4000 then 'copy' else cast(id as string) end as text")
    got = sharding.assign_shards(df, 8).toPandas()
    share = (got.assign(low=got.doc_id < 4000).groupby("shard").low.mean() - 0.5).abs().max()
    assert share < 0.06 and abs(got[["doc_id"]].assign(place=got.shard * 1000 + got.slot).corr().iloc[0, 1]) < 0.05


def test_write_shards(spark, odd, empty, tmp_path):
    sharding.write_shards(odd, f"{tmp_path}/out", 4)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.select("record.*").columns == odd.columns
    assert Counter(map(tuple, got.select("record.*").collect())) == Counter(map(tuple, odd.collect()))
    sharding.write_shards(empty, f"{tmp_path}/none", 4)
    assert sharding.assign_shards(empty).count() == 0


def test_query_reports_what_write_shards_wrote(spark, odd, tmp_path):
    """The same places from both, and from any layout of the input, for records that differ in other columns only too."""
    docs = odd.union(odd.where("doc_id = 2003").withColumn("lang", F.lit("de")))
    found = []
    for k, df in enumerate((docs, docs.repartition(7))):
        sharding.write_shards(df, f"{tmp_path}/out{k}", 4)
        found.append(Counter(map(tuple, spark.read.parquet(f"{tmp_path}/out{k}").select("record.*", "shard", "slot").collect())))
    assert found[0] == found[1]
    at = {(r[-2], r[-1]): (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in found[0]}
    said = {(r.shard, r.slot): (r.doc_id, r["size"], r.text_crc32) for r in sharding.assign_shards(docs, 4).collect()}
    assert said == at


def test_query_writes_the_records(spark, odd, tmp_path, monkeypatch):
    d, calls = write_tables(spark, tmp_path, odd), []
    write = sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda df, path, *a, **k: (calls.append(path), write(df, path, *a, **k)))
    got = sharding.op10_shard(spark, d)
    assert Counter(map(tuple, spark.read.parquet(calls[0]).select("record.*").collect())) == Counter(map(tuple, odd.collect()))
    assert got.count() == odd.count()


def test_words(spark):
    rows = [(None,), ("",), (" a  b\x0b\x1fc d e \x85f ",), ("\ta\n",)]
    got = [r.w for r in spark.createDataFrame(rows, "text string").coalesce(1).select(words_of(F.col("text")).alias("w")).collect()]
    assert got == [words(t) for (t,) in rows]
