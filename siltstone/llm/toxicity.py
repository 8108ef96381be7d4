"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (lower-cased, outer punctuation removed) is hashed to one of ``WORDS`` rows of an embedding table, its first
``STEM`` characters to another, and its embedding is the sum of the two, so that inflected forms share one. Filters of
``WIDTHS`` words run over the whole text, each is max-pooled over all positions, and a logistic layer turns the pooled
values into a score. For scoring, table times filter is multiplied out once, so a position costs a few row additions.

Training uses at most ``MOST_EACH`` labelled rows of each class, in order of a hash of their id, from those with
crc32(doc_id) mod 3 not 1; of each language and class the first and then every ``BACK``-th row is held back for
calibration: the logits are shifted so that the best threshold is ``CUT`` for all texts, and for each language a
threshold of its own is taken from the held-back rows of that language (the common one where a class has fewer than
``LEAST_LANG`` of them). The score itself sees only the text.

Defined results: an id that is labelled more than once is toxic if any of its labels says so, and the order of label
rows and of repeated documents changes nothing; null, empty or blank text pools to zeros and gets the score of that; without labelled rows of both
classes every score is 0; a null language has the common threshold; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, raw_texts, split_number

WORDS, DIM, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 8
MOST_EACH, EPOCHS, LEAST_STEPS, RATE = 2500, 5, 500, 0.01
LEAST_TEXTS = 4  # words in fewer training texts than this share the zero row: they say nothing, and can't be learnt by heart
STEM = 4
CUT, LEAST_LANG, BACK = 0.7, 5, 5
PARTS, OUT = 3, 1
_TRIM = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


class WordRows(dict):
    """Rows of the embedding table for a raw word: its own, and its stem's times ``WORDS``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        bare = word.strip(_TRIM)
        stem = bare.decode("utf-8", "replace")[:STEM]
        value = self[word] = xxhash.xxh64_intdigest(bare) % WORDS + WORDS * (xxhash.xxh64_intdigest(f"^{stem}") % WORDS)
        return value

    def of(self, text: bytes) -> np.ndarray:
        found = text.lower().split()
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


class Model:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.1, (WORDS, DIM)).astype(np.float32), "b": np.full((len(WIDTHS), FILTERS), 0.0, np.float32), "v": rng.normal(0, 0.3, (len(WIDTHS), FILTERS)).astype(np.float32), "c": np.zeros(1, np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32)
        self.scale, self.shift = 1.0, 0.0

    def gradients(self, batch: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Of the summed logistic loss of (word rows, stem rows, label): dense ones by name, then touched table rows and theirs.

        Only the positions of the maxima carry gradients.
        """
        p = self.p
        grads = {k: np.zeros_like(x) for k, x in p.items() if k != "e"}
        touched, pulled = [np.zeros(0, np.int64)], [np.zeros((0, DIM), np.float32)]
        for ids, stems, label in batch:
            x = p["e"][ids] + p["e"][stems]
            pooled, where = np.zeros((len(WIDTHS), FILTERS), p["e"].dtype), []
            for j, w in enumerate(WIDTHS):
                n = len(ids) - w + 1
                where.append(None)
                if n > 0:
                    z = sum(x[o : o + n] @ p[f"w{w}"][o] for o in range(w)) + p["b"][j]
                    at = z.argmax(axis=0)
                    pooled[j] = np.maximum(z[at, range(FILTERS)], 0)
                    where[j] = at
            logit = float((pooled * p["v"]).sum() + p["c"][0])
            d = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label
            grads["c"] += d
            grads["v"] += d * pooled
            dz = d * p["v"] * (pooled > 0)
            for j, w in enumerate(WIDTHS):
                if where[j] is not None:
                    grads["b"][j] += dz[j]
                    for o in range(w):
                        hit = where[j] + o
                        grads[f"w{w}"][o] += x[hit].T * dz[j]
                        touched += [ids[hit], stems[hit]]
                        pulled += [p[f"w{w}"][o].T * dz[j][:, None]] * 2
        rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
        g = np.zeros((len(rows), DIM), p["e"].dtype)
        np.add.at(g, inverse, np.concatenate(pulled))
        return grads, rows, g

    def train(self, rows: list[np.ndarray], labels: np.ndarray, seed: int = 6) -> None:
        """Adam on logistic loss. Word and stem rows are told apart a text at a time: the sample is in the driver's memory once."""
        rng, p = np.random.default_rng(seed), self.p
        held = np.zeros(WORDS, np.int64)
        for r in rows:
            held[np.unique(np.concatenate([r % WORDS, r // WORDS]))] += 1
        rare = held < min(LEAST_TEXTS, 1 + len(rows) // 100)
        p["e"][rare] = 0
        m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
        step = 0
        for _ in range(max(EPOCHS, -(-LEAST_STEPS * 32 // max(len(rows), 1)))):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), 32):
                grads, hit, g = self.gradients([(rows[k] % WORDS, rows[k] // WORDS, labels[k]) for k in order[lo : lo + 32].tolist()])
                step += 1
                rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, d in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    p[k] -= (rate * m[k] / (np.sqrt(v[k]) + 1e-6)).astype(np.float32)
                hit, g = hit[~rare[hit]], g[~rare[hit]]
                m["e"][hit] = 0.9 * m["e"][hit] + 0.1 * g
                v["e"][hit] = 0.999 * v["e"][hit] + 0.001 * g * g
                p["e"][hit] -= rate * m["e"][hit] / (np.sqrt(v["e"][hit]) + 1e-6)
        self.fold()

    def fold(self) -> None:
        """Multiply table and filters out: (WORDS, FILTERS) for each width and place."""
        self.tables = [[self.p["e"] @ self.p[f"w{w}"][o] for o in range(w)] for w in WIDTHS]

    def logit(self, ids: np.ndarray) -> float:
        """Over the whole text, in pieces so that memory stays bounded."""
        pooled = np.zeros((len(WIDTHS), FILTERS), np.float32)
        ids, stems = ids % WORDS, ids // WORDS
        for j, w in enumerate(WIDTHS):
            for lo in range(0, len(ids) - w + 1, 65_536):
                n = min(65_536, len(ids) - w + 1 - lo)
                z = self.tables[j][0][ids[lo : lo + n]] + self.tables[j][0][stems[lo : lo + n]]
                for o in range(1, w):
                    z += self.tables[j][o][ids[lo + o : lo + o + n]]
                    z += self.tables[j][o][stems[lo + o : lo + o + n]]
                np.maximum(pooled[j], z.max(axis=0) + self.p["b"][j], out=pooled[j])
        return float((pooled * self.p["v"]).sum() + self.p["c"][0])

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.logit(ids) + self.shift, -30, 30))))


def _best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest gap among the thresholds with the fewest errors."""
    order = np.argsort(logits)
    x, y = logits[order], labels[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([[(1 - y).sum()], (1 - y).sum() - np.cumsum(1 - y)])
    edges = np.concatenate([[x[0] - 2], x, [x[-1] + 2]])
    gaps = np.where(errors == errors.min(), np.diff(edges), -1)
    k = int(gaps.argmax())
    return float((edges[k] + edges[k + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model | None, dict[str | None, float]]:
    """Model and thresholds by language (None: common) from a bounded sample of labelled rows."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(split_number(F.col("doc_id"), PARTS) != OUT)
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = known.where("toxic = 1").orderBy(*order).limit(MOST_EACH).union(known.where("toxic = 0").orderBy(*order).limit(MOST_EACH))
    sample = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")  # 2 * MOST_EACH rows

    def work():
        words = WordRows()

        def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = pa.array([words.of(t).astype(np.uint32).tobytes() for t in raw_texts(batch.column("text"))], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("toxic"), ids], names=["doc_id", "lang", "toxic", "ids"])

        return handle

    found = per_batch(sample.selectExpr("cast(doc_id as string) doc_id", "text", "lang", "cast(toxic as int) toxic"), work, "doc_id string, lang string, toxic int, ids binary", 256).collect()
    found.sort(key=lambda r: (xxhash.xxh64_intdigest(r.doc_id), r.doc_id, r.ids, r.lang or ""))
    rows = [np.frombuffer(r.ids, np.uint32) for r in found]  # views
    y = np.array([float(r.toxic) for r in found])
    if not len(y) or y.min() == y.max():
        return None, {None: CUT}
    kept, nth = np.zeros(len(rows), bool), Counter()
    for k, r in enumerate(found):
        kept[k] = nth[r.lang, r.toxic] % BACK == 0
        nth[r.lang, r.toxic] += 1
    if y[kept].min() == y[kept].max():
        kept[:] = True
    model = Model()
    teach = np.nonzero(~kept)[0] if not kept.all() else np.arange(len(rows))
    model.train([rows[k] for k in teach], y[teach])
    held = np.nonzero(kept)[0]
    logits = np.array([model.logit(rows[k]) for k in held])
    model.shift = float(np.log(CUT / (1 - CUT))) - model.scale * _best_cut(logits, y[held])
    scores = np.array([model.score(rows[k]) for k in held])
    cuts: dict[str | None, float] = {None: CUT}
    langs = np.array([found[k].lang or "" for k in held])
    for lang in sorted(set(langs.tolist()) - {""}):
        own = langs == lang
        if min(y[held][own].sum(), (1 - y[held][own]).sum()) >= LEAST_LANG:
            cuts[lang] = float(np.clip(1 / (1 + np.exp(-_best_cut(np.log(scores[own] / (1 - scores[own])), y[held][own]))), 0.05, 0.95))
    return model, cuts


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, lang_threshold, lang_flag for every row of ``docs``."""
    model, cuts = fit(docs, labels)

    def work():
        words = WordRows()

        def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = [model.score(words.of(t)) if model else 0.0 for t in raw_texts(batch.column("text"))]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(scores, pa.float64())], names=["doc_id", "lang", "score"])

        return handle

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = per_batch(docs.selectExpr("doc_id", "cast(lang as string) lang", "cast(text as string) text"), work, f"doc_id {kind}, lang string, score double", 512)
    own = F.coalesce(*[F.when(F.col("lang") == k, F.lit(c)) for k, c in sorted(cuts.items(), key=str) if k is not None], F.lit(cuts[None]))
    return scored.select("doc_id", (split_number(F.col("doc_id"), PARTS) == OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), own.alias("lang_threshold"), (F.col("score") >= own).alias("lang_flag"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` below their language's threshold, with all their columns, in one pass without a shuffle.

    Null languages and those without a threshold of their own have the common one.
    """
    model, cuts = fit(docs, labels)
    at, lang = docs.columns.index("text"), docs.columns.index("lang")

    def work():
        words = WordRows()

        def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs = batch.column(lang).to_pylist()
            good = [not model or model.score(words.of(t)) < cuts.get(k, cuts[None]) for k, t in zip(langs, raw_texts(batch.column(at)), strict=True)]
            return batch.filter(pa.array(good, pa.bool_()))

        return handle

    # columns go by number: names may hold dots or be the same but for case
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return per_batch(plain, work, plain.schema, 512).toDF(*docs.columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs, labels)
