"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

Both directions of the network run over the UTF-8 bytes of the running text, lower-cased in ASCII, spaces, digits and
punctuation included, and every byte position is labelled with a distribution over languages. A document's probabilities
are the mean of those of all its positions.

A text is thought to stand between NUL bytes. It is run in windows of ``WINDOW`` bytes, each with ``OVERLAP`` bytes of
what is beside it on either side, over which the states of both directions form; the labels of these belong to the
neighbouring window. So the work is in proportion to the bytes, memory is bounded, and no byte is left out.

Training is backpropagation through time on windows of ``SPAN`` bytes, labelled with the language of their document:
``DRAWN`` windows at seeded places over the whole text of each of at most ``MOST_EACH`` documents of each language, in
order of a hash of their id, from those with crc32(doc_id) mod 4 not 2. Languages are drawn equally often.

Defined results: null text, or text without a letter, is ``und`` with score 0; without any learnt language every text
is ``und``; repeated rows have equal predictions; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import per_batch, raw_texts, split_number

HIDDEN, WINDOW, OVERLAP, TOGETHER = 6, 256, 16, 1024
SPAN, DRAWN, MOST_EACH, STEPS, BATCH, RATE = 48, 64, 150, 450, 96, 0.02
PARTS, OUT = 4, 2
_LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BiGru:
    """h' = z * h + (1 - z) * tanh(a + r * (U h)), forwards and backwards; softmax over both states at each byte."""

    def __init__(self, langs: list[str], seed: int = 3):
        rng, self.langs = np.random.default_rng(seed), langs
        self.p: dict[str, np.ndarray] = {"o": rng.normal(0, 0.3, (2 * HIDDEN, len(langs))), "c": np.zeros(len(langs))}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * HIDDEN))
            self.p[f"u{d}"] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, d: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States (time, window, HIDDEN) of one direction."""
        h, out, kept = np.zeros((x.shape[0], HIDDEN), np.float32), [], []
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            a, u = self.p[f"x{d}"][x[:, t]], h @ self.p[f"u{d}"]
            z, r = np.split(_sigmoid(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]), 2, axis=1)
            n = np.tanh(a[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            kept.append((t, h, z, r, n, u[:, 2 * HIDDEN :]))
            h = z * h + (1 - z) * n
            out.append(h)
        return np.stack(out if d == "f" else out[::-1]), kept

    def forward(self, x: np.ndarray):
        f, kf = self._run("f", x)
        b, kb = self._run("b", x)
        both = np.concatenate([f, b], axis=2)
        logits = both @ self.p["o"] + self.p["c"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True), both, kf, kb

    def gradients(self, x: np.ndarray, live: np.ndarray, want: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss over the positions ``live``, by backpropagation through time; ``want`` has a row for each window."""
        prob, both, kf, kb = self.forward(x)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d = (prob - want[None]) * live.T[:, :, None] / np.float32(max(live.sum(), 1))
        g["o"], g["c"] = np.einsum("tbh,tbl->hl", both, d), d.sum(axis=(0, 1))
        dh_all = d @ self.p["o"].T
        for way, kept, part in (("f", kf, slice(0, HIDDEN)), ("b", kb, slice(HIDDEN, None))):
            dh, pulled = np.zeros((x.shape[0], HIDDEN), np.float32), []
            for t, h, z, r, n, un in reversed(kept):
                dh = dh + dh_all[t][:, part]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                pre = np.concatenate([dz, dr, dn], axis=1)
                rec = np.concatenate([dz, dr, dn * r], axis=1)
                pulled.append((x[:, t], pre))
                g[f"u{way}"] += h.T @ rec
                dh = dh * z + rec @ self.p[f"u{way}"].T
            at = np.concatenate([b for b, _ in pulled])
            order = np.argsort(at, kind="stable")
            seen, first = np.unique(at[order], return_index=True)
            g[f"x{way}"][seen] = np.add.reduceat(np.concatenate([p for _, p in pulled])[order], first, axis=0)
        return g

    def train(self, windows: list[np.ndarray], seed: int = 4) -> None:
        """Adam. ``windows`` has an array (number, SPAN) for each language; NUL bytes are no positions of a text."""
        rng = np.random.default_rng(seed)
        m, v = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}
        each = np.eye(len(windows), dtype=np.float32)
        for step in range(1, STEPS + 1):
            lang = rng.integers(0, len(windows), BATCH)
            x = np.stack([windows[k][rng.integers(0, len(windows[k]))] for k in lang.tolist()])
            rate = RATE * (1 - step / (STEPS + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in self.gradients(x, x > 0, each[lang]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= (rate * m[k] / (np.sqrt(v[k]) + 1e-7)).astype(np.float32)

    def _states(self, d: str, x: np.ndarray) -> np.ndarray:
        """Their part of the logits (time, window, language), in the order of the run. ``x`` is (time, window).

        A sigmoid is half a hyperbolic tangent of half its argument; the halves are in the weights.
        """
        half = np.repeat(np.float32([0.5, 1]), [2 * HIDDEN, HIDDEN])
        table, weights = self.p[f"x{d}"] * half, self.p[f"u{d}"] * half
        exit_ = self.p["o"][:HIDDEN] if d == "f" else self.p["o"][HIDDEN:]
        n = x.shape[1]
        h, a, u = np.zeros((n, HIDDEN), np.float32), np.empty((n, 3 * HIDDEN), np.float32), np.empty((n, 3 * HIDDEN), np.float32)
        g, new, out = np.empty((n, 2 * HIDDEN), np.float32), np.empty((n, HIDDEN), np.float32), np.empty((len(x), n, len(self.langs)), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            np.take(table, x[t], axis=0, out=a)
            np.matmul(h, weights, out=u)
            np.add(a[:, : 2 * HIDDEN], u[:, : 2 * HIDDEN], out=g)
            np.tanh(g, out=g)
            g *= np.float32(0.5)
            g += np.float32(0.5)
            np.multiply(g[:, HIDDEN:], u[:, 2 * HIDDEN :], out=new)
            new += a[:, 2 * HIDDEN :]
            np.tanh(new, out=new)
            h -= new
            h *= g[:, :HIDDEN]
            h += new
            np.matmul(h, exit_, out=out[t])
        return out

    def label(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (time, window, language) of every position. ``x`` is (time, window)."""
        logits = self._states("f", x)
        logits += self._states("b", x)
        logits += self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """Language and pooled probability of each text."""
        ask = [k for k, t in enumerate(texts) if _LETTER.search(t.decode("utf-8", "ignore"))]
        out = [("und", 0.0)] * len(texts)
        if not ask:
            return out
        size = np.array([len(texts[k]) for k in ask])
        windows = -(-size // WINDOW)
        # each text is laid out in whole windows, with the overlap of NUL bytes in front and behind
        room = windows * WINDOW + 2 * OVERLAP
        laid = np.frombuffer(b"".join([b"\0" * OVERLAP + texts[k].lower().ljust(int(n) - OVERLAP, b"\0") for k, n in zip(ask, room, strict=True)]), np.uint8)
        owner = np.repeat(np.arange(len(ask)), windows)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = np.repeat(np.cumsum(room) - room, windows) + place * WINDOW
        live = np.minimum(WINDOW, size[owner] - place * WINDOW)
        total = np.zeros((len(ask), len(self.langs)))
        for lo in range(0, len(owner), TOGETHER):
            part = slice(lo, lo + TOGETHER)
            prob = self.label(laid[np.arange(WINDOW + 2 * OVERLAP)[:, None] + start[part]])[OVERLAP : OVERLAP + WINDOW]
            prob *= (np.arange(WINDOW)[:, None] < live[part])[:, :, None]
            np.add.at(total, owner[part], prob.sum(axis=0))
        best = total.argmax(axis=1)
        for k, b, n, t in zip(ask, best.tolist(), size.tolist(), total, strict=True):
            out[k] = self.langs[b], float(min(1.0, t[b] / n))
        return out


def draw(doc: str, text: bytes) -> np.ndarray:
    """Windows of a training text, at places that its id and length alone decide; some reach over its ends."""
    laid = np.frombuffer(b"\0" * OVERLAP + text.lower() + b"\0" * (OVERLAP + SPAN), np.uint8)
    rng = np.random.default_rng(xxhash.xxh64_intdigest(f"{len(text)}|{doc}"))
    at = rng.integers(0, len(text) + 2 * OVERLAP - min(SPAN, len(text)), min(DRAWN, max(1, len(text) // 8)))
    return laid[np.minimum(at[:, None] + np.arange(SPAN), len(laid) - 1)]


def fit(docs: DataFrame) -> BiGru | None:
    known = docs.where("lang is not null and doc_id is not null and text is not null").where(split_number(F.col("doc_id"), PARTS) != OUT)
    # ids of at most MOST_EACH rows of each language, picked by hash without gathering a language in one task
    ranked = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("_h"))
    local = W.partitionBy("lang", "_part").orderBy("_h", "doc_id")
    ranked = ranked.withColumn("_part", F.pmod("_h", F.lit(64))).withColumn("_k", F.row_number().over(local)).where(F.col("_k") <= MOST_EACH)
    chosen = ranked.withColumn("_k", F.row_number().over(W.partitionBy("lang").orderBy("_h", "doc_id"))).where(F.col("_k") <= MOST_EACH).select("doc_id").distinct()
    rows = known.join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")

    def work():
        def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
            some = [draw(d, t).tobytes() if _LETTER.search(t.decode("utf-8", "ignore")) else b"" for d, t in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text")), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(some, pa.binary())], names=["doc_id", "lang", "windows"])

        return handle

    # DRAWN * SPAN bytes for each of MOST_EACH documents of a language
    found = per_batch(rows, work, "doc_id string, lang string, windows binary", 256).collect()
    found.sort(key=lambda r: (r.lang, r.doc_id, bytes(r.windows)))
    by_lang: dict[str, list[bytes]] = {}
    for r in found:
        if r.windows:
            by_lang.setdefault(r.lang, []).append(bytes(r.windows))
    if not by_lang:
        return None
    model = BiGru(sorted(by_lang))
    model.train([np.frombuffer(b"".join(by_lang[k]), np.uint8).reshape(-1, SPAN) for k in model.langs])
    return model


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``; learns from its labelled part."""
    model = fit(docs)

    def work():
        def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = list(raw_texts(batch.column("text")))
            found = model.predict(texts) if model else [("und", 0.0)] * len(texts)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

        return handle

    kind = docs.schema["doc_id"].dataType.simpleString()
    done = per_batch(docs.selectExpr("doc_id", "cast(text as string) text"), work, f"doc_id {kind}, lang_pred string, score double", 512)
    return done.select("doc_id", (split_number(F.col("doc_id"), PARTS) == OUT).alias("held_out"), "lang_pred", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
