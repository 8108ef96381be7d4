"""Exact and near duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import sentence
from siltstone.llm import exact_dedup, near_dedup

SPACE = re.compile("[\x20\x09-\x0d]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def low(text):
    return (text or "").encode().lower().decode()


def as_key(x):
    return (x is None, x if x is not None else 0)


# --- exact ---


def exact_brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[hashlib.sha256(SPACE.sub(" ", text or "").encode()).hexdigest()].append(doc)
    out = []
    for sha, ids in groups.items():
        keep = min(ids, key=as_key)
        n_kept = 0
        for doc in ids:
            kept = doc == keep and not n_kept
            n_kept += kept
            out.append((doc, keep, len(ids), kept, sha))
    return Counter(out)


@pytest.mark.parametrize("slots", [4, 1024])
def test_exact(odd, slots):
    got = exact_dedup.exact_dedup(odd, slots=slots)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == exact_brute([(r.doc_id, r.text) for r in odd.collect()])


def test_exact_deduplicate(odd):
    got = exact_dedup.deduplicate(odd, slots=16)
    assert got.columns == odd.columns
    want = Counter((k[0], k[4]) for k, n in exact_brute([(r.doc_id, r.text) for r in odd.collect()]).items() for _ in range(n) if k[3])
    assert Counter((r.doc_id, hashlib.sha256(SPACE.sub(" ", r.text or "").encode()).hexdigest()) for r in got.collect()) == want


def test_exact_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0


def test_exact_hot(spark):
    """A third of all rows in one group, and more groups of copies than slots."""
    rows = [(i, "hot text") for i in range(400)] + [(1000 + i, f"pair {i // 2}") for i in range(400)] + [(5000 + i, f"single {i}") for i in range(400)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert Counter(tuple(r) for r in exact_dedup.exact_dedup(df, slots=8).collect()) == exact_brute(rows)


# --- near ---


def shingles(text):
    w = words(low(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3)))


def near_brute(rows):
    """(doc, size, component, stays at all) of rows, by comparing all pairs of distinct sets."""
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    distinct = defaultdict(list)
    for i, s in enumerate(sets):
        if s:
            distinct[s].append(i)
    for same in distinct.values():
        for i in same[1:]:
            top[find(i)] = find(same[0])
    each = list(distinct)
    for x in range(len(each)):
        for y in range(x):
            both = len(each[x] & each[y])
            if 100 * both >= 80 * (len(each[x]) + len(each[y]) - both):
                top[find(distinct[each[x]][0])] = find(distinct[each[y]][0])
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return Counter((rows[i][0], len(sets[i]), min(groups[find(i)], key=as_key)) for i in range(len(rows))), len(groups)


def check_near(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = near_dedup.near_duplicates(df).collect()
    want, groups = near_brute(rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert sum(r.stays for r in got) == groups


def test_near_odd(odd):
    check_near(odd)


def test_near_empty(empty):
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.deduplicate(empty).count() == 0


def family(rng, n_words, copies, most):
    base = sentence(rng, n_words).split()
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(most + 1)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("leaf", [8, 64])
def test_near_families(spark, monkeypatch, leaf):
    """Families around the border of similarity, one large family, one chain, and passages that many texts share."""
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    monkeypatch.setattr(near_dedup, "BLOCK", 2 * leaf)
    rng = random.Random(leaf)
    texts = []
    for _ in range(60):
        texts += family(rng, rng.choice([40, 120]), 4, rng.choice([1, 2, 5]))
    texts += family(rng, 200, 150, 3)  # larger than a leaf
    passage = sentence(rng, 100)
    texts += [f"{sentence(rng, 40)} {passage} {sentence(rng, 40)}" for _ in range(150)]  # alike by half: no links
    chain = [f"c{i}" for i in range(260)]
    texts += [" ".join(chain[i * 5 : i * 5 + 100]) for i in range(30)]  # each like the next, the ends not alike
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    check_near(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6))


def test_near_border(spark):
    """Exactly 80 per cent is linked, just below is not: 8 of 10 and 7 of 9 shingles shared."""
    a = [f"a{i}" for i in range(12)]  # 9 shingles
    rows = [(1, " ".join(a)), (2, " ".join([*a[:-1], "x"])), (10, " ".join(f"b{i}" for i in range(11))), (11, " ".join(f"b{i}" for i in range(9)) + " y z"), (12, " ".join(f"b{i}" for i in range(10)))]
    check_near(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_near_deduplicate(odd):
    got = near_dedup.deduplicate(odd)
    assert got.columns == odd.columns
    _, groups = near_brute([(r.doc_id, r.text) for r in odd.collect()])
    assert got.count() == groups
    kept = [r.text for r in got.collect() if r.text]
    assert len(set(kept)) == len(kept)


def test_near_deduplicate_takes_five_words(spark):
    """0.822 alike on 4-word shingles, 0.780 on 5-word ones: linked by the query, kept by the stage."""
    a = [f"a{i}" for i in range(85)]
    b = [f"x{i}" if i in (25, 55) else w for i, w in enumerate(a)]
    five = [frozenset(tuple(x[i : i + 5]) for i in range(81)) for x in (a, b)]
    assert 71 == len(five[0] & five[1]) and 91 == len(five[0] | five[1])
    close = [*a[:50], "y", *a[51:]]  # 76 of 86
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(close))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.component_id for r in near_dedup.near_duplicates(df).where("doc_id < 3").collect()} == {1}
    assert {r.doc_id for r in near_dedup.deduplicate(df).collect()} == {1, 2}


def test_near_deduplicate_against_brute_force(spark, monkeypatch):
    """The stage, on five words, with large nodes too."""
    monkeypatch.setattr(near_dedup, "LEAF", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(5)
    texts = [t for _ in range(30) for t in family(rng, 85, 4, 3)] + family(rng, 200, 60, 6)
    rows = list(enumerate(texts))
    sets = [frozenset(zip(*(words(low(t))[k:] for k in range(5)), strict=False)) for t in texts]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                top[b] = a
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted(r.doc_id for r in near_dedup.deduplicate(df).collect()) == sorted({find(x) for x in top})


def test_near_sql(spark, tmp_path):
    """The query's own columns."""
    spark.createDataFrame([(1, "a b c d e"), (2, "A B C D E"), (3, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in near_dedup.op1_near_dedup(spark, str(tmp_path)).collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_tokens_estimate_similarity():
    """Agreement of tokens is close to the similarity of the sets."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    y = np.concatenate([x[:889], rng.integers(0, 1 << 63, 111).astype(np.uint64)])  # 0.8
    rate = np.mean([(near_dedup.tokens_of(np.sort(x ^ np.uint64(k))) == near_dedup.tokens_of(np.sort(y ^ np.uint64(k)))).mean() for k in rng.integers(0, 1 << 62, 60)])
    assert abs(rate - 0.8) < 0.03


def test_few_links_are_joined_in_few_jobs(spark):
    rng = random.Random(9)
    names = [k * 7 + 1 for k in range(300)]
    rng.shuffle(names)
    pairs = [(a, b) for a, b in zip(names[:60], names[1:60]) if names.index(b) % 8] + [(names[200], x) for x in names[201:280]]
    top = {x: x for pair in pairs for x in pair}
    for _ in top:
        for a, b in pairs:
            top[a] = top[b] = min(top[a], top[b])
    edges = near_dedup.table(spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long").repartition(4), "test")
    context = spark.sparkContext
    context.setJobGroup("few-links", "")
    got = near_dedup.components(edges)
    context._jsc.clearJobGroup()
    assert len(context.statusTracker().getJobIdsForGroup("few-links")) <= 5
    assert dict(tuple(r) for r in got.collect()) == top
    assert dict(tuple(r) for r in near_dedup.components(edges, alone=0).collect()) == top
    for alone in (0, 10):
        assert near_dedup.components(edges.limit(0), alone).collect() == []
