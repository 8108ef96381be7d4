"""Toxicity, language, n-gram scores: gradients, held-out accuracy, brute force, odd rows."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from conftest import sentence
from siltstone.llm import language, ngram, toxicity
from siltstone.llm.common import mix

DIR = "/root/testdata/sf0.01"


def remainder(doc, parts):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % parts


# --- toxicity ---


def test_toxicity_learns(spark):
    """Recall and precision on held-out rows."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels)
    known = labels.where("toxic is not null").select("doc_id", "toxic")
    rows = got.join(known, "doc_id").where("held_out").collect()
    hit, said, true = (sum(f(r) for r in rows) for f in (lambda r: r.predicted and r.toxic, lambda r: r.predicted, lambda r: r.toxic))
    assert true > 100 and hit / true >= 0.8 and hit / said >= 0.85
    out = got.collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (remainder(r.doc_id, 3) == 1) for r in out)


def test_toxicity_gradients():
    """Backpropagation against differences, for every kind of parameter and texts shorter than a filter."""
    model, rng = toxicity.Model(), np.random.default_rng(8)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    batch = [(rng.integers(0, 40, n), rng.integers(0, 40, n), float(n % 2)) for n in (0, 1, 2, 9, 12)]

    def loss():
        total = 0.0
        for ids, stems, y in batch:
            x = model.p["e"][ids] + model.p["e"][stems]
            logit = model.p["c"][0]
            for j, w in enumerate(toxicity.WIDTHS):
                n = len(ids) - w + 1
                if n > 0:
                    z = sum(x[o : o + n] @ model.p[f"w{w}"][o] for o in range(w)) + model.p["b"][j]
                    logit += (np.maximum(z.max(axis=0), 0) * model.p["v"][j]).sum()
            total += np.log1p(np.exp(-logit)) if y else np.log1p(np.exp(logit))
        return total

    grads, rows, g = model.gradients(batch)
    grads["e"] = np.zeros_like(model.p["e"])
    grads["e"][rows] = g
    for k, v in model.p.items():
        for _ in range(8):
            at = tuple(rng.integers(0, n) for n in (v.shape if k != "e" else (40, v.shape[1])))
            old = v[at]
            v[at] = old + 1e-6
            up = loss()
            v[at] = old - 1e-6
            down = loss()
            v[at] = old
            assert abs((up - down) / 2e-6 - grads[k][at]) < 1e-4, k


def test_toxicity_training_holds_the_sample_once(monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 1)
    rng = np.random.default_rng(3)
    rows = [rng.integers(0, toxicity.WORDS**2, 40_000).astype(np.uint32) for _ in range(200)]  # 32 MB
    wide = [r.astype(np.int64) for r in rows[:40]]
    labels = np.arange(len(rows)) % 2
    tracemalloc.start()
    model = toxicity.Model()
    model.train(rows, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
    one, other = toxicity.Model(), toxicity.Model()
    one.train(rows[:40], labels[:40])
    other.train(wide, labels[:40])
    assert all((one.p[k] == other.p[k]).all() for k in one.p)


def test_toxicity_does_not_depend_on_order(spark):
    """Shuffled, repeated and conflicting labels and repeated documents give equal scores and thresholds."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 400")
    docs = docs.union(docs.where("doc_id < 20").withColumn("text", docs.text.substr(1, 300)))
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/labels.parquet").where("doc_id < 400").select("doc_id", "toxic").collect()]
    rows += [(d, 1 - t) for d, t in rows[:30]] + rows[:10]
    found = []
    for k in range(2):
        __import__("random").Random(k).shuffle(rows)
        labels = spark.createDataFrame(rows, "doc_id bigint, toxic int").repartition(3 + k)
        found.append(Counter(map(tuple, toxicity.toxicity(docs.repartition(2 + 3 * k), labels).select("doc_id", "score", "lang_threshold").collect())))
    assert found[0] == found[1]


def test_thresholds_by_language_are_fitted(spark):
    """Every language of the table has a threshold of its own, and its held-back rows are told apart by it."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    _, cuts = toxicity.fit(docs, labels)
    langs = {r.lang for r in docs.select("lang").distinct().collect()} - {None}
    assert set(cuts) == langs | {None} and all(0 < c < 1 for c in cuts.values())


def test_toxicity_ignores_held_out_labels(spark):
    """Turning the labels of the held-out rows around changes no score."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 300")
    labels = spark.read.parquet(f"{DIR}/labels.parquet").where("doc_id < 300")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    a, b = ({(r.doc_id, r.score) for r in toxicity.toxicity(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_toxicity_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(odd, none).collect()} == {0.0}
    assert toxicity.clean(odd, none).columns == odd.columns and toxicity.clean(odd, none).count() == odd.count()
    ids = [r.doc_id for r in odd.select("doc_id").where("doc_id is not null").distinct().orderBy("doc_id").limit(60).collect()]
    some = spark.createDataFrame([(i, 0, k % 2) for k, i in enumerate(ids)] + [(None, 1, 1), (ids[0], 1, None), (ids[1], 0, 0)], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(odd, some).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(empty, some).count() == 0 and toxicity.clean(empty, some).count() == 0


def test_clean_uses_thresholds_by_language(spark, monkeypatch):
    """A row stays or goes by its own language's threshold; null and unlisted languages by the common one."""

    class Fixed:
        def score(self, ids):
            return 0.5 if len(ids) < 4 else 0.8

    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: (Fixed(), {None: 0.7, "fr": 0.4, "en": 0.9}))
    few, many = "ab", "ab cd ef gh ij kl mn op"
    assert len(toxicity.WordRows().of(few.encode())) < 4 <= len(toxicity.WordRows().of(many.encode()))
    rows = [(k, text, lang) for k, (text, lang) in enumerate((t, x) for t in (few, many) for x in ("fr", "en", "de", None))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = {r.doc_id for r in toxicity.clean(docs, None).collect()}
    flags = {r.doc_id for r in toxicity.toxicity(docs, None).where("not lang_flag").collect()}
    assert kept == flags == {1, 2, 3, 5}


def test_toxicity_model_over_pieces():
    """The folded, piecewise logit equals the plain network over the whole text."""
    model = toxicity.Model()
    model.fold()
    ids = np.random.default_rng(0).integers(0, toxicity.WORDS**2, 70_000)
    x = model.p["e"][ids % toxicity.WORDS] + model.p["e"][ids // toxicity.WORDS]
    total = model.p["c"][0]
    for j, w in enumerate(toxicity.WIDTHS):
        z = sum(x[o : o + len(ids) - w + 1] @ model.p[f"w{w}"][o] for o in range(w)) + model.p["b"][j]
        total += (np.maximum(z.max(axis=0), 0) * model.p["v"][j]).sum()
    assert math.isclose(model.logit(ids), total, rel_tol=1e-3, abs_tol=1e-3)
    assert model.logit(np.zeros(0, np.int64)) == model.p["c"][0]


# --- language ---


def test_gru_gradients():
    """Backpropagation through time against differences, NUL bytes at the ends included."""
    model = language.BiGru(["a", "b", "c"])
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x = np.array([list(b"ab de"), list(b"\0\0xy\0"), list(b"ab z\0")], np.uint8)
    live, want = x > 0, np.eye(3)

    def loss():
        p = model.forward(x)[0]
        return -(np.log(p) * want[None] * live.T[:, :, None]).sum() / live.sum()

    g = model.gradients(x, live, want)
    rng = np.random.default_rng(1)
    for k, v in model.p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in v.shape) if k[0] != "x" else (int(x[rng.integers(3), 0]), rng.integers(0, v.shape[1]))
            old = v[at]
            v[at] = old + 1e-4
            up = loss()
            v[at] = old - 1e-4
            down = loss()
            v[at] = old
            assert abs((up - down) / 2e-4 - g[k][at]) < 2e-3, k


def test_labels_are_those_of_the_whole_text(monkeypatch):
    """The fast run equals the plain one; windows with overlap pool nearly as one run over the whole text does, and every
    byte is counted once."""
    model, rng = language.BiGru(["a", "b", "c"], seed=2), np.random.default_rng(3)
    x = rng.integers(0, 256, (40, 7)).astype(np.uint8)
    assert np.allclose(model.label(x), model.forward(x.T)[0], atol=1e-5)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 255, 256, 257, 1000, 3000)]
    got = model.predict(texts)
    for text, (lang, score) in zip(texts, got, strict=True):
        whole = np.frombuffer(b"\0" * language.OVERLAP + text + b"\0" * language.OVERLAP, np.uint8)[None]
        mean = model.forward(whole)[0][language.OVERLAP : -language.OVERLAP, 0].mean(axis=0)
        assert lang == model.langs[int(mean.argmax())] and abs(score - mean.max()) < 2e-3
    monkeypatch.setattr(language, "TOGETHER", 2)
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 for a, b in zip(model.predict(texts), got, strict=True))


def test_language_learns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    rows = [r for r in docs.where("lang is not null").collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in rows) / len(rows) > 0.95
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got.values())


def test_language_odd(spark, odd, empty):
    out = [r for r in language.identify(odd).collect()]
    assert len(out) == odd.count() and {r.lang_pred for r in out} <= {"en", "fr", "und"}
    und = Counter((r.doc_id, r.score) for r in out if r.lang_pred == "und")
    assert und[(4000, 0.0)] == und[(4001, 0.0)] == und[(4002, 0.0)] == 1
    assert language.identify(empty).count() == 0
    nothing = spark.createDataFrame([(1, "some text", None), (2, "12 34 !?", "en")], "doc_id bigint, text string, lang string")
    assert {r.lang_pred for r in language.identify(nothing).collect()} == {"und"}


# --- n-grams ---


def plain(rows):
    """Base columns, by counting in Python."""
    tokens = {k: [*t.encode().lower().split(), None] for k, (_, t) in enumerate((d, t or "") for d, t in rows)}
    count = Counter(w for k, (d, _) in enumerate(rows) if remainder(d, 7) != 2 for w in tokens[k])
    n, v = sum(count.values()), len(count)
    return Counter((d, remainder(d, 7) == 2, len(tokens[k]), sum(count[w] > 0 for w in tokens[k]), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens[k]), 6)) for k, (d, _) in enumerate(rows))


def check_base(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = ngram.score_texts(df.select("doc_id", "text")).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == plain(rows)
    return got


def test_ngram_base(odd, empty):
    check_base(odd)
    assert ngram.score_texts(empty.select("doc_id", "text")).count() == 0


def test_ngram_no_training_rows(spark):
    only = next(i for i in range(100) if remainder(i, 7) == 2)
    check_base(spark.createDataFrame([(only, "a b c")], "doc_id bigint, text string"))


def test_ngram_beats_base(spark):
    got = check_base(spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 400"))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def trigrams(rows, shards=ngram.LEAST_SHARDS):
    """log10 probabilities of all rows by the model's formula, with plain counters."""
    train = [["<s>", "<s>", *t.encode().lower().split(), ngram.END] for d, t in rows if remainder(d, 7) != 2]
    one = Counter(w for seq in train for w in seq[2:])
    n, v = sum(one.values()), len(one)
    number = {w: k for k, w in enumerate(sorted(one, key=xxhash.xxh64_intdigest))} | {"<s>": v + 1}
    low = lambda w: (one[w] + 1) / (n + v + 1)

    def context(u, w):
        classes = max(1, -(-one[w] * shards // n)) if w != "<s>" else 1
        return w, int(mix(np.array([number.get(u, v)], np.uint64))[0]) % classes if classes > 1 else 0

    two, three, in_context, in_history = Counter(), Counter(), Counter(), Counter()
    for seq in train:
        for u, m, w in zip(seq, seq[1:], seq[2:], strict=False):
            c = context(u, m)
            two[c, w] += 1
            three[c, u, w] += 1
            in_context[c] += 1
            in_history[c, u] += 1
    after_context, after_history = Counter(c for c, _ in two), Counter((c, u) for c, u, _ in three)

    def p(u, m, w):
        c = context(u, m)
        out = low(w)
        if in_context[c]:
            out = max(two[c, w] - ngram.DISCOUNT, 0) / in_context[c] + ngram.DISCOUNT * after_context[c] / in_context[c] * out
        if in_history[c, u]:
            out = max(three[c, u, w] - ngram.DISCOUNT, 0) / in_history[c, u] + ngram.DISCOUNT * after_history[c, u] / in_history[c, u] * out
        return out

    return [sum(math.log10(p(u, m, w)) for u, m, w in zip(seq, seq[1:], seq[2:], strict=False)) for seq in (["<s>", "<s>", *t.encode().lower().split(), ngram.END] for _, t in rows)]


@pytest.mark.parametrize("chunk", [200, 1_000_000])
def test_ngram_full_model(spark, monkeypatch, chunk):
    """Scores against the formula in plain Python, with hot words that are split into classes, over many and over few chunks."""
    monkeypatch.setattr(ngram, "CHUNK", chunk)
    rng = __import__("random").Random(4)
    rows = [(i, " ".join("hot" if rng.random() < 0.4 else w for w in sentence(rng, rng.randrange(1, 60)).split())) for i in range(150)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000 + i, "never seen " + rows[i][1]) for i in range(20)] + [(3000, "")]
    want = dict(zip((d for d, _ in rows), trigrams(rows), strict=True))
    got = {r.doc_id: r for r in ngram.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert set(got) == set(want)
    assert all(abs(got[d].score - w) < 0.03 * got[d].n_tokens for d, w in want.items())
    assert abs(sum(got[d].score - w for d, w in want.items())) < 0.006 * sum(r.n_tokens for r in got.values())


def test_ngram_tells_seen_texts_apart(spark):
    """Of held-out texts, those with a copy in training score far above the others, token by token."""
    rng = __import__("random").Random(9)
    held, other = ([i for i in range(2000) if (remainder(i, 7) == 2) == x] for x in (True, False))
    texts = [sentence(rng, 80) for _ in range(400)]
    rows = list(zip(other, texts, strict=False)) + [(held[k], texts[k]) for k in range(40)] + [(held[40 + k], sentence(rng, 80)) for k in range(40)]
    got = {r.doc_id: r.score / r.n_tokens for r in ngram.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert min(got[held[k]] for k in range(40)) > max(got[held[40 + k]] for k in range(40))


@pytest.mark.parametrize("n", [0, 1, 5000, 12_345])
def test_sequences(n):
    """Elias-Fano: every value found and taken back, absent ones not."""
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, 1 << int(rng.integers(20, 60)), n).astype(np.uint64))
    data = np.frombuffer(ngram.pack(values), np.uint8)
    seq = ngram.Sequence(data, 0)
    assert seq.n == len(values)
    if len(values):
        assert (seq.find(values) == np.arange(len(values))).all() and (seq.take(np.arange(len(values))) == values).all()
        absent = np.setdiff1d(values + np.uint64(1), values)
        assert (seq.find(absent) == -1).all()


def test_sequence_with_repeats():
    values = np.repeat(np.arange(3000, dtype=np.uint64), 5)
    seq = ngram.Sequence(np.frombuffer(ngram.pack(values), np.uint8), 0)
    assert (seq.take(np.arange(len(values))) == values).all()


def test_sequence_of_wide_values():
    """Over all 64 bits, with clusters, so that blocks of every width occur."""
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2), *(np.uint64(k) + rng.integers(0, 1 << w, 300).astype(np.uint64) for k, w in zip(rng.integers(0, 1 << 62, 40), range(1, 41), strict=True))]
    values = np.unique(np.concatenate(parts))
    seq = ngram.Sequence(np.frombuffer(ngram.pack(values), np.uint8), 0)
    assert (seq.find(values) == np.arange(len(values))).all() and (seq.take(np.arange(len(values))) == values).all()


def test_probabilities_sum_to_one():
    """Over all words and one unknown, for each history, at the widths of real contexts and numbers."""
    rng = np.random.default_rng(2)
    numbers = np.unique(rng.integers(0, 1 << 40, 300)).astype(np.int64)
    rows = np.stack([rng.integers(0, 12, 3000) * ((1 << 56) // 13) + 5, numbers[rng.integers(0, 20, 3000)], numbers[rng.integers(0, len(numbers), 3000)]], axis=1)
    rows, counts = np.unique(rows, axis=0, return_counts=True)
    trie = ngram.Shard(np.frombuffer(ngram.build(rows[:, 0].astype(np.uint64), rows[:, 1], rows[:, 2], counts), np.uint8))
    once = rng.integers(1, 50, len(numbers))
    low = np.append((once + 1) / (once.sum() + len(numbers) + 1), 1 / (once.sum() + len(numbers) + 1))
    names = np.append(numbers, 1 << 40)  # the last one is unknown
    for c, u in [*np.unique(rows[:, :2], axis=0)[::17].tolist(), [int(rows[0, 0]), 1 << 40], [7, 7]]:
        p = 10 ** trie.log10(np.full(len(names), c, np.uint64), np.full(len(names), u), names, low)
        assert abs(p.sum() - 1) < 0.05


def test_counts_are_exact_where_numbers_are_close():
    """N-grams whose numbers differ in their last bit alone keep their own counts."""
    n = 1 << 30
    context, u = np.array([5, 5, 5, 6], np.uint64), np.array([n, n, n + 1, n])
    w, counts = np.array([n, n + 1, n, n]), np.array([8, 2, 5, 1])
    trie = ngram.Shard(np.frombuffer(ngram.build(context, u, w, counts), np.uint8))
    got = 10 ** trie.log10(context, u, w, np.zeros(4))
    d = ngram.DISCOUNT
    after = {n: (13 - d) / 15, n + 1: (2 - d) / 15}
    want = [(8 - d) / 10 + 2 * d / 10 * after[n], (2 - d) / 10 + 2 * d / 10 * after[n + 1], (5 - d) / 5 + d / 5 * after[n], (1 - d) + d * (1 - d)]
    assert np.allclose(got, want, rtol=0.06)


def shipped(rng, chunks, contexts, each):
    """What the chunks ship to one shard: ``each`` n-grams of every context, many of which other chunks have as well."""
    keys, rows = np.sort(rng.integers(0, 1 << 60, contexts).astype(np.uint64)), []
    for chunk in range(chunks):
        u, w = (np.sort(rng.integers(0, most, (contexts, each)), axis=1).ravel() for most in (40, 1 << 33))
        w = np.where(rng.random(len(w)) < 0.5, w % 50, w)
        planes = [ngram._planes(x, 5) for x in (np.full(contexts, each), u, w, rng.integers(0, 3, len(u)))]
        raw = np.array([len(u), contexts], np.int64).tobytes() + ngram._planes(keys, 8) + b"".join(planes)
        rows.append({"shard": 0, "chunk": chunk, "data": zstandard.compress(raw, 1)})
    return pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())]))


def answers(batch, folder):
    out = ngram._answer(ngram.Words(str(folder), 4, {}), False)(iter([batch]))
    return {r["chunk"]: zstandard.decompress(r["data"]) for b in out for r in b.to_pylist()}


def test_memory_of_a_large_shard(tmp_path):
    """A shard of several times the mean, as where frequent contexts meet, is handled in pieces: under 100 bytes an n-gram."""
    batch = shipped(np.random.default_rng(6), 50, 50, 1000)
    tracemalloc.start()
    try:
        got = answers(batch, tmp_path)
        assert tracemalloc.get_traced_memory()[1] < 250e6
    finally:
        tracemalloc.stop()
    assert sum(map(len, got.values())) == 2 * 50 * 50 * 1000


@pytest.mark.parametrize("piece", [700, 5000])
def test_pieces_change_no_answer(tmp_path, monkeypatch, piece):
    """Pieces of several contexts, of one, and contexts that are merged in several goes."""
    batch = shipped(np.random.default_rng(7), 12, 9, 100)
    whole = answers(batch, tmp_path)
    monkeypatch.setattr(ngram, "PIECE", piece)
    assert answers(batch, tmp_path) == whole and len({*whole.values()}) == 12


def test_unknown_words_are_dealt_out(tmp_path):
    """N-grams after unknown words do not meet in one shard."""
    flat = np.random.default_rng(8).integers(1, 1 << 63, 20_000).astype(np.uint64)
    edges = ngram.chunk_grams(flat, np.full(100, 200), np.zeros(100, bool), ngram.Words(str(tmp_path), 4, {}), 16)[2]
    assert np.diff(edges).max() < 0.25 * len(flat)
