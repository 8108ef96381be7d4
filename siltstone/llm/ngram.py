"""Language-model scoring with an Elias-Fano n-gram trie of three levels.

Tokens are words lower-cased in ASCII, and one end token for each text; each is known by 64 bits of its hash. It takes two
passes over the texts and two shuffles of n-grams, none of which brings back anything that grows to the driver:

1. Words of the training texts are counted in shards by the leading bits of their hash. A shard's file has the hashes
   (ascending, Elias-Fano) and exact counts; a word's number is its place in all shards.
2. Every text is cut into (u, v, w): a token w with the two before it. Texts are handled in chunks of about ``CHUNK``
   tokens, and each different (u, v, w) of a chunk is shipped once, with its number of training occurrences, to the
   shard of v; so an n-gram that a third of all texts hold is one row a chunk. A shard's task takes its contexts in
   pieces of ``PIECE`` n-grams, merges a piece's n-grams, builds their trie, writes it and maps it into memory, and looks
   up all n-grams of all chunks in it, in ascending order, so every block is decoded once. A context with more n-grams is
   a piece of its own and is merged in several goes. Answers go back by chunk and are summed up for each text.

The trie of a piece has, for each level, monotone pointers to where the children of a node begin and keys in which the
rank of the parent comes first, both Elias-Fano, and values quantised to ``LEVELS`` steps:

* contexts v, with pointers to both levels below and the back-off weight;
* (v, w): the discounted probability of w after v;  (v, u): histories, with pointers and back-off weight;
* ((v, u), w): the discounted probability of w after u v.

A node's children are searched relative to it, between its two pointers. Ranks and numbers are exact: no two n-grams
share a key. Every n-gram is kept, also one met once.

p(w | u v) = max(count(u v w) - D, 0) / count(u v) + b(u v) * p(w | v), p(w | v) likewise from pairs with b(v) * p(w), and
p(w) = (count(w) + 1) / (N + V + 1); b is the mass not given to successors, so the probabilities of a context sum to one
but for quantisation, one unknown token included. Where v holds more than a shard's share of all tokens, it is split
into as many classes of the word before it, and (v, class of u) is the context of the middle level: a hot word has
several contexts, each with its own counts, and none has more than a shard's share. Unknown words have no counts, so
their n-grams may go anywhere and are dealt out by the hash of the word.

Answers are log10 in steps of ``STEP``. Sequences are cut into blocks of ``BLOCK`` values: low parts in whole bytes, high
parts in unary, and a directory of first values.

Defined results: null text is empty and has its end token; without training texts N and V are 0; an empty table gives
an empty result. A frame that a recomputation may change has to be written before it is scored.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, in_remainder, mix, raw_texts, scratch, split_number

PARTS, OUT = 7, 2
BLOCK, AT_ONCE, LEVELS, DISCOUNT, CHUNK = 128, 2048, 255, 0.75, 1_000_000
FLOOR = -9.0  # log10 of the smallest probability and back-off weight that is told apart
STEP, LOWEST = 24 / 65535, 65535  # of answers: log10 in 16 bits, from 0 to -24
#: Bytes of text for a shard of words and one of n-grams, and n-grams that a task handles at once. A task holds the n-grams
#: of its shard in 15 bytes each, several times the mean where frequent contexts meet, and about 300 bytes for each at once.
WORD_BYTES, LEAST_WORDS, MOST_WORDS = 32 << 20, 4, 1 << 16
SHARD_BYTES, LEAST_SHARDS, MOST_SHARDS, PIECE = 8 << 20, 16, 1 << 20, 1 << 18
MOST_CLASSES = 1 << 16
END = b" end"  # no word holds a space


# --- Elias-Fano sequences -------------------------------------------------------------------------------------------


def _block(v: np.ndarray) -> bytes:
    rest = v - v[0]
    span = int(rest[-1]) // len(v)
    width = min(7, (span.bit_length() + 7) // 8)  # rounded up: the unary part takes about two bits a value
    high = (rest >> np.uint64(8 * width)).astype(np.int64)
    bits = np.zeros(int(high[-1]) + len(v), np.uint8)
    bits[high + np.arange(len(v))] = 1
    return bytes([width]) + rest.view(np.uint8).reshape(-1, 8)[:, :width].tobytes() + np.packbits(bits).tobytes()


def pack(values: np.ndarray) -> bytes:
    """An ascending sequence: number, directory (first value and place of each block), blocks. Whole blocks are made together."""
    values = values.astype(np.uint64)
    n = len(values) // BLOCK
    v = values[: n * BLOCK].reshape(n, BLOCK)
    rest = v - v[:, :1]
    span = rest[:, -1] // np.uint64(BLOCK)
    width = np.minimum(7, sum((span >= np.uint64(1 << (8 * k))).astype(np.int64) for k in range(8)))
    high = (rest >> (np.uint64(8) * width.astype(np.uint64))[:, None]).astype(np.int64)
    unary = (high[:, -1] + BLOCK + 7) // 8 if n else np.zeros(0, np.int64)
    size = 1 + BLOCK * width + unary
    place = np.cumsum(size) - size
    tail = [_block(values[n * BLOCK :])] if len(values) % BLOCK else []
    out = np.zeros(int(size.sum()), np.uint8)
    out[place] = width
    begin = np.cumsum(unary) - unary
    bits = np.zeros(8 * int(unary.sum()), np.uint8)
    bits[8 * begin[:, None] + high + np.arange(BLOCK)] = 1
    out[np.repeat(place + 1 + BLOCK * width - begin, unary) + np.arange(int(unary.sum()))] = np.packbits(bits)
    for w in np.unique(width[width > 0]).tolist():
        pick = np.nonzero(width == w)[0]
        low = np.ascontiguousarray(rest[pick]).view(np.uint8).reshape(len(pick), BLOCK, 8)[:, :, :w].reshape(len(pick), BLOCK * w)
        out[place[pick, None] + 1 + np.arange(BLOCK * w)] = low
    at = len(out) + sum(map(len, tail))
    places = np.append(place, [len(out)] * len(tail))
    first = values[::BLOCK]
    return b"".join([np.array([len(values), at], np.int64).tobytes(), first.tobytes(), np.append(places, at).astype(np.int64).tobytes(), out.tobytes(), *tail])


class Sequence:
    """A packed sequence within a memory map."""

    def __init__(self, data: np.ndarray, at: int):
        self.n, size = data[at : at + 16].view(np.int64).tolist()
        k = -(-self.n // BLOCK)
        self.first = data[at + 16 : at + 16 + 8 * k].view(np.uint64)
        self.place = data[at + 16 + 8 * k : at + 24 + 16 * k].view(np.int64)
        self.data = data[at + 24 + 16 * k : at + 24 + 16 * k + size]

    def block(self, k: int) -> np.ndarray:
        n = min(BLOCK, self.n - k * BLOCK)
        data = self.data[self.place[k] : self.place[k + 1]]
        width = int(data[0])
        high = np.nonzero(np.unpackbits(data[1 + n * width :]))[0][:n] - np.arange(n)
        out = high.astype(np.uint64) << np.uint64(8 * width)
        for b in range(width):
            out |= data[1 : 1 + n * width].reshape(n, width)[:, b].astype(np.uint64) << np.uint64(8 * b)
        return out + self.first[k]

    def rows(self, ks: np.ndarray) -> np.ndarray:
        """Distinct ascending blocks decoded together, one a row; a short last one is filled up with its last value."""
        out = np.empty((len(ks), BLOCK), np.uint64)
        whole = (ks + 1) * BLOCK <= self.n
        if not whole[-1]:
            last = self.block(int(ks[-1]))
            out[-1, : len(last)], out[-1, len(last) :] = last, last[-1]
        start, stop = self.place[ks], self.place[ks + 1]
        widths = self.data[start]
        for width in np.unique(widths[whole]).tolist():
            pick = np.nonzero(whole & (widths == width))[0]
            low = start[pick] + 1
            high = low + BLOCK * width
            sizes = stop[pick] - high
            begin = np.cumsum(sizes) - sizes
            bits = np.unpackbits(self.data[np.repeat(high - begin, sizes) + np.arange(sizes.sum())])
            ones = np.nonzero(bits)[0].reshape(len(pick), BLOCK) - 8 * begin[:, None] - np.arange(BLOCK)
            value = ones.astype(np.uint64) << np.uint64(8 * width)
            if width:
                parts = np.zeros((len(pick), BLOCK, 8), np.uint8)
                parts[:, :, :width] = self.data[low[:, None] + np.arange(BLOCK * width)].reshape(len(pick), BLOCK, width)
                value |= parts.view(np.uint64)[:, :, 0]
            out[pick] = value + self.first[ks[pick]][:, None]
        return out

    def _spans(self, which: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Ranges of ascending block numbers with their distinct blocks, ``AT_ONCE`` at most."""
        edges = np.append(np.nonzero(np.diff(which, prepend=-1))[0], len(which))
        for k in range(0, len(edges) - 1, AT_ONCE):
            part = edges[k : k + AT_ONCE + 1]
            yield int(part[0]), int(part[-1]), which[part[:-1]]

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of ascending values, -1 where absent; decodes just the blocks they fall into."""
        out = np.full(len(wanted), -1, np.int64)
        if not self.n or not len(wanted):
            return out
        which = np.searchsorted(self.first, wanted, "right") - 1
        before = int(np.searchsorted(which, 0))  # smaller than all
        for lo, hi, ks in self._spans(which[before:]):
            lo, hi = lo + before, hi + before
            values = self.rows(ks).ravel()
            at = np.minimum(np.searchsorted(values, wanted[lo:hi]), len(values) - 1)
            hit = values[at] == wanted[lo:hi]
            out[lo:hi][hit] = ks[at[hit] // BLOCK] * BLOCK + at[hit] % BLOCK
        return out

    def take(self, places: np.ndarray) -> np.ndarray:
        """Values at ascending places."""
        out = np.empty(len(places), np.uint64)
        which = places // BLOCK
        for lo, hi, ks in self._spans(which):
            out[lo:hi] = self.rows(ks)[np.searchsorted(ks, which[lo:hi]), places[lo:hi] % BLOCK]
        return out


def quantise(p: np.ndarray) -> np.ndarray:
    return np.round(np.clip(np.log10(np.maximum(p, 1e-30)) / FLOOR, 0, 1) * LEVELS).astype(np.uint8)


def restore(q: np.ndarray) -> np.ndarray:
    return np.where(q == LEVELS, 0.0, 10 ** (q / LEVELS * FLOOR))


def _join(levels: list[bytes]) -> bytes:
    """Levels in one file, each at a multiple of eight bytes, with a directory in front."""
    at, places = 8 * (len(levels) + 1), []
    for x in levels:
        places.append(at)
        at += len(x) + -len(x) % 8
    return np.array([*places, at], np.int64).tobytes() + b"".join(x + b"\0" * (-len(x) % 8) for x in levels)


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.nonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))[0] if len(sorted_) else np.zeros(0, np.int64)


def _which(sorted_: np.ndarray) -> np.ndarray:
    """The number of the run that each value is in."""
    return np.cumsum(np.concatenate([[False], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


def build(context: np.ndarray, u: np.ndarray, w: np.ndarray, counts: np.ndarray) -> bytes:
    """A piece's file from its different (context, u, w), ascending, each met ``counts`` times, once at least."""
    words = np.unique(np.concatenate([u, w]))
    size = max(len(words), 1)
    ru, rw = np.searchsorted(words, u), np.searchsorted(words, w)
    starts = _runs(context)
    contexts, of = context[starts], np.cumsum(np.bincount(starts, minlength=len(context))) - 1
    history = of * size + ru
    h = _runs(history)
    histories, of_history = history[h], np.cumsum(np.bincount(h, minlength=len(context))) - 1
    in_context = np.add.reduceat(counts, starts) if len(starts) else counts
    in_history = np.add.reduceat(counts, h) if len(h) else counts
    pairs, inverse = np.unique(of * size + rw, return_inverse=True)
    pair_counts = np.bincount(inverse, weights=counts, minlength=len(pairs))
    owner = pairs // size
    p2 = (pair_counts - DISCOUNT) / in_context[owner]
    p3 = (counts - DISCOUNT) / in_history[of_history]
    left2 = DISCOUNT * np.bincount(owner, minlength=len(contexts)) / in_context
    left3 = DISCOUNT * np.bincount(of_history, minlength=len(histories)) / in_history
    point = lambda parents, n: pack(np.searchsorted(parents, np.arange(n + 1)))
    k = len(contexts)
    return _join([pack(words), pack(contexts), quantise(left2).tobytes(), point(owner, k), pack(pairs), quantise(p2).tobytes(),
                  point(histories // size, k), pack(histories), quantise(left3).tobytes(), point(of_history, len(histories)), pack(of_history * size + rw), quantise(p3).tobytes()])


class Shard:
    """A piece's trie within a memory map."""

    def __init__(self, data: np.ndarray):
        at = data[:104].view(np.int64)
        raw = lambda k: data[at[k] : at[k + 1]]
        seq = lambda k: Sequence(data, int(at[k]))
        self.words, self.contexts, self.left2, self.to_pairs, self.pairs, self.p2 = seq(0), seq(1), raw(2), seq(3), seq(4), raw(5)
        self.to_histories, self.histories, self.left3, self.to_last, self.last, self.p3 = seq(6), seq(7), raw(8), seq(9), seq(10), raw(11)
        self.size = max(self.words.n, 1)

    def _below(self, pointers: Sequence, keys: Sequence, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of the children ``word`` of ``parent``, by ranks that ascend together; -1 where absent."""
        out = np.full(len(parent), -1, np.int64)
        pick = np.nonzero((parent >= 0) & (word >= 0))[0]
        if len(pick):
            starts, which = _runs(parent[pick]), _which(parent[pick])
            nodes = parent[pick][starts]
            begin, end = pointers.take(nodes).astype(np.int64)[which], pointers.take(nodes + 1).astype(np.int64)[which]
            some = pick[begin < end]
            at = keys.find((parent[some] * self.size + word[some]).astype(np.uint64))
            inside = (at >= begin[begin < end]) & (at < end[begin < end])
            out[some[inside]] = at[inside]
        return out

    def log10(self, context: np.ndarray, u: np.ndarray, w: np.ndarray, low: np.ndarray) -> np.ndarray:
        """log10 p(w | u, context) of different ascending n-grams; ``low`` has p(w)."""
        names, inverse = np.unique(np.concatenate([u, w]), return_inverse=True)
        rank = self.words.find(names.astype(np.uint64))[inverse]
        ru, rw = rank[: len(u)], rank[len(u) :]
        c = self.contexts.find(context[_runs(context)].astype(np.uint64))[_which(context)]
        pairs, back = np.unique(np.maximum(c, 0) * (self.size + 1) + rw + 1, return_inverse=True)
        place = self._below(self.to_pairs, self.pairs, np.where(pairs % (self.size + 1) > 0, pairs // (self.size + 1), -1), pairs % (self.size + 1) - 1)[back]
        place[c < 0] = -1
        p = _value(self.p2, place, 0.0) + _value(self.left2, c, 1.0) * low
        histories = np.maximum(c, 0) * (self.size + 1) + ru + 1
        h, back = np.unique(histories, return_inverse=True)
        node = self._below(self.to_histories, self.histories, np.where(h % (self.size + 1) > 0, h // (self.size + 1), -1), h % (self.size + 1) - 1)[back]
        node[c < 0] = -1
        last = self._below(self.to_last, self.last, node, rw)  # those found ascend as the n-grams do
        p = _value(self.p3, last, 0.0) + _value(self.left3, node, 1.0) * p
        return np.log10(np.maximum(p, 1e-300))


_RESTORED = restore(np.arange(LEVELS + 1, dtype=np.float64))


def _value(level: np.ndarray, at: np.ndarray, none: float) -> np.ndarray:
    out = np.full(len(at), none)
    hit = at >= 0
    out[hit] = _RESTORED[level[at[hit]]]
    return out


# --- files in the shared folder -------------------------------------------------------------------------------------


def _files(uri: str):
    """(file system, path) of a folder that executors share."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _save(uri: str, name: str, data: bytes) -> None:
    system, folder = _files(uri)
    system.create_dir(folder, recursive=True)
    own = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(own) as f:
        f.write(data)
    system.move(own, f"{folder}/{name}")


def _map(uri: str, name: str) -> np.ndarray:
    """Memory-map a file; one in a remote store is first copied to an unnamed local file."""
    from pyarrow import fs

    system, folder = _files(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(f"{folder}/{name}", np.uint8, "r")
    handle, path = tempfile.mkstemp()
    try:
        with os.fdopen(handle, "wb") as out, system.open_input_stream(f"{folder}/{name}") as f:
            while chunk := f.read(1 << 22):
                out.write(chunk)
        return np.memmap(path, np.uint8, "r")
    finally:
        os.unlink(path)


def _read(uri: str, name: str) -> bytes:
    system, folder = _files(uri)
    with system.open_input_stream(f"{folder}/{name}") as f:
        return f.read()


def _forget(uri: str, name: str) -> None:
    system, folder = _files(uri)
    system.delete_file(f"{folder}/{name}")


# --- words ----------------------------------------------------------------------------------------------------------


def _planes(x: np.ndarray, width: int) -> bytes:
    """Whole numbers in ``width`` bytes, byte by byte: that presses better."""
    return x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplanes(data: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = data[: n * width].reshape(width, n).T
    return out.view(np.uint64).ravel()


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = _runs(keys)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _count(shards: int):
    shift = np.uint64(64 - shards.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        hashes, press = WordHash(), zstandard.ZstdCompressor(level=1)
        end = np.array([hashes[END]], np.uint64)
        held, size = [], 0

        def flush():
            nonlocal held, size
            words, counts = np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
            edges = np.searchsorted(words >> shift, np.arange(shards + 1, dtype=np.uint64)).tolist()
            rows = [(k, press.compress(_planes(words[lo:hi], 8) + _planes(counts[lo:hi], 5))) for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if lo < hi]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "data"])

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text")), strict=True):
                if in_remainder(key, PARTS) != OUT:
                    found = text.lower().split()
                    for lo in range(0, len(found), CHUNK):
                        held.append(hashes.of(found[lo : lo + CHUNK]))
                        size += len(held[-1])
                        if size >= CHUNK:
                            yield flush()
                    held.append(end)
                    size += 1
        if held:
            yield flush()

    return run


def _write_words(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress, shard = zstandard.ZstdDecompressor(), None
        sums: list[tuple[np.ndarray, np.ndarray]] = []

        def close():
            words, counts = _merge(*(np.concatenate([x[i] for x in sums]) for i in (0, 1)))
            sums.clear()
            _save(uri, f"words-{shard:05d}", _join([pack(words), counts.astype(np.int64).tobytes()]))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([int(counts.sum())], pa.int64()), pa.array([len(words)], pa.int64())], names=["shard", "tokens", "types"])

        for batch in batches:
            for s, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if s != shard:
                    if shard is not None:
                        yield close()
                    shard = s
                raw = np.frombuffer(unpress.decompress(data.as_py()), np.uint8)
                n = len(raw) // 13
                sums.append((_unplanes(raw, n, 8), _unplanes(raw[8 * n :], n, 5).astype(np.int64)))
                if len(sums) > 8:  # merge small with small: each key is merged a few times
                    sums.sort(key=lambda x: -len(x[0]))
                    few = [sums.pop() for _ in range(6)]
                    sums.append(_merge(np.concatenate([k for k, _ in few]), np.concatenate([c for _, c in few])))
        if shard is not None:
            yield close()

    return run


class Words:
    """All words of the training texts by number; ``v`` stands for an unknown one, ``v`` + 1 for the start of a text."""

    def __init__(self, uri: str, shards: int, made: dict[int, tuple[int, int]]):
        self.uri, self.shards, self.present = uri, shards, set(made)
        self.shift = np.uint64(64 - shards.bit_length() + 1)
        types = [made.get(k, (0, 0))[1] for k in range(shards)]
        self.first = np.concatenate([[0], np.cumsum(types)]).astype(np.int64)
        self.n, self.v = sum(t for t, _ in made.values()), int(self.first[-1])

    def _open(self, k: int) -> tuple[Sequence, np.ndarray]:
        held = self.__dict__.setdefault("_held", {})
        if k not in held:
            data = _map(self.uri, f"words-{k:05d}")
            at = data[:24].view(np.int64).tolist()
            held[k] = Sequence(data, at[0]), data[at[1] : at[2]].view(np.int64)
        return held[k]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Of ascending hashes."""
        out = np.full(len(hashes), self.v, np.int64)
        edges = np.searchsorted(hashes >> self.shift, np.arange(self.shards + 1, dtype=np.uint64)).tolist()
        for k in self.present:
            if edges[k] < edges[k + 1]:
                at = self._open(k)[0].find(hashes[edges[k] : edges[k + 1]])
                out[edges[k] : edges[k + 1]] = np.where(at >= 0, self.first[k] + at, self.v)
        return out

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Of ascending numbers."""
        out = np.zeros(len(numbers), np.int64)
        edges = np.searchsorted(numbers, self.first).tolist()
        for k in self.present:
            if edges[k] < edges[k + 1]:
                out[edges[k] : edges[k + 1]] = self._open(k)[1][numbers[edges[k] : edges[k + 1]] - self.first[k]]
        return out

    def low(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.n + self.v + 1)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_held"}


def count_words(docs: DataFrame, size: int) -> Words:
    """Counts the words of the training texts; ``size`` has the bytes of all texts."""
    uri = scratch(docs.sparkSession, "trie")
    shards = min(MOST_WORDS, max(LEAST_WORDS, 1 << (size // WORD_BYTES).bit_length()))
    blocks = docs.mapInArrow(_count(shards), "shard int, data binary")
    made = blocks.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_write_words(uri), "shard int, tokens long, types long").collect()  # a row for each shard
    return Words(uri, shards, {r.shard: (r.tokens, r.types) for r in made})


# --- n-grams --------------------------------------------------------------------------------------------------------


def chunk_grams(flat: np.ndarray, lengths: np.ndarray, trained: np.ndarray, words: Words, shards: int):
    """A chunk's n-grams. ``flat`` has the hashes of its texts' tokens, ``lengths`` their numbers, ``trained`` which count.

    Gives n_known and base score of each text; the borders of the shards in the n-grams; context, u, w and training
    count of each different one, ascending within a shard; occurrences of each, and the text of every occurrence.
    """
    names, here = np.unique(flat, return_inverse=True)
    numbers = words.numbers(names)
    counts = _counts_of(words, numbers)
    first = np.cumsum(lengths) - lengths
    base = np.add.reduceat(np.log10(words.low(counts))[here], first)
    known = np.add.reduceat((counts > 0)[here].astype(np.int64), first)
    start = len(names)
    v, u = np.empty_like(here), np.empty_like(here)
    v[1:], u[2:] = here[:-1], here[:-2]
    v[first] = u[first] = start
    u[first[lengths > 1] + 1] = start
    numbers, counts = np.append(numbers, words.v + 1), np.append(counts, 0)
    classes = np.clip(-(-counts * shards // max(words.n, 1)), 1, MOST_CLASSES)
    # contexts of the chunk: a word as it is, and after those the further classes of hot words
    hot = np.nonzero(classes[v] > 1)[0]
    which = (mix(numbers[u[hot]].astype(np.uint64)) % classes[v[hot]].astype(np.uint64)).astype(np.int64)
    further, back = np.unique(v[hot] * MOST_CLASSES + which, return_inverse=True)
    context = v.copy()
    context[hot] = start + 1 + back
    spread = np.append(np.where(numbers[:start] == words.v, mix(names) % np.uint64(MOST_CLASSES), 0).astype(np.int64), 0)
    key = np.concatenate([numbers * MOST_CLASSES + spread, numbers[further // MOST_CLASSES] * MOST_CLASSES + further % MOST_CLASSES]).astype(np.uint64)
    shard = (mix(key) >> np.uint64(64 - shards.bit_length() + 1)).astype(np.int64)
    by = np.argsort(key)
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    by = np.argsort(shard << 40 | place)  # by shard and key
    at = np.empty(len(by), np.int64)
    at[by] = np.arange(len(by))
    text = np.repeat(np.arange(len(lengths)), lengths)
    bits = int(start + 1).bit_length()
    if int(len(by)).bit_length() + 2 * bits <= 63:
        whole = at[context] << (2 * bits) | u << bits | here
        order = np.argsort(whole)
        begin = _runs(whole[order])
    else:
        order = np.lexsort((here, u, at[context]))
        begin = np.nonzero(np.concatenate([[True], np.any([np.diff(x[order]) != 0 for x in (at[context], u, here)], axis=0)]))[0]
    picked, text = order[begin], text[order]
    times = np.add.reduceat(trained[text].astype(np.int64), begin)
    c = context[picked]
    edges = np.searchsorted(shard[c], np.arange(shards + 1))
    return known, base, edges, (key[c], numbers[u[picked]], numbers[here[picked]], times), np.diff(np.append(begin, len(order))), text


def _counts_of(words: Words, numbers: np.ndarray) -> np.ndarray:
    """Counts of numbers in any order, 0 for unknown words."""
    order = np.argsort(numbers)
    out = np.empty(len(numbers), np.int64)
    out[order] = words.counts(numbers[order])
    return out


def _ask(words: Words, shards: int):
    """Texts to rows (shard, chunk, data); what a chunk needs to sum up its answers goes to a file of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        hashes, press = WordHash(), zstandard.ZstdCompressor(level=1)
        end, number = np.array([hashes[END]], np.uint64), TaskContext.get().partitionId() << 32
        held, ids, size = [], [], 0

        def flush():
            nonlocal held, ids, size, number
            lengths = np.array([len(t) for t in held])
            names = pa.concat_arrays(ids)
            trained = np.array([in_remainder(k, PARTS) != OUT for k in names.cast(pa.string()).to_pylist()])
            known, base, edges, (context, u, w, times), occurrences, text = chunk_grams(np.concatenate(held), lengths, trained, words, shards)
            sink = pa.BufferOutputStream()
            rows = pa.RecordBatch.from_arrays([names, pa.array(lengths, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64())], names=["doc_id", "n_tokens", "n_known", "base_score"])
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            _save(words.uri, f"chunk-{number}", _join([sink.getvalue().to_pybytes(), press.compress(_planes(occurrences, 5)), press.compress(_planes(text, 5))]))
            held, ids, size = [], [], 0
            made = []
            for k in np.nonzero(np.diff(edges))[0].tolist():
                part = slice(edges[k], edges[k + 1])
                runs = _runs(context[part])
                n = np.diff(np.append(runs, edges[k + 1] - edges[k]))
                head = np.array([len(u[part]), len(runs)], np.int64).tobytes()
                made.append((k, number, press.compress(head + _planes(context[part][runs], 8) + _planes(n, 5) + b"".join(_planes(x[part], 5) for x in (u, w, times)))))
            number += 1
            for lo in range(0, len(made), 16):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made[lo : lo + 16]], t) for k, t in enumerate([pa.int32(), pa.int64(), pa.binary()])], names=["shard", "chunk", "data"])

        for batch in batches:
            for k, text in enumerate(raw_texts(batch.column("text"))):
                held.append(np.concatenate([hashes.of(text.lower().split()), end]))
                ids.append(batch.column("doc_id").slice(k, 1))
                size += len(held[-1])
                if size >= CHUNK:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _distinct(context: np.ndarray, u: np.ndarray, w: np.ndarray, times: np.ndarray):
    """The different n-grams, ascending, with their counts; and for each one given its place among them."""
    names, of = np.unique(context[_runs(context)], return_inverse=True)
    of = of[_which(context)]
    bits = int(max(u.max(), w.max())).bit_length()
    if len(names).bit_length() + 2 * bits <= 63:
        grams, of = np.unique(of << 2 * bits | u << bits | w, return_inverse=True)
        least = (1 << bits) - 1
        return (names[grams >> 2 * bits], grams >> bits & least, grams & least, np.bincount(of, weights=times, minlength=len(grams))), of
    local = np.unique(np.concatenate([u, w]))
    history, of = np.unique(of * len(local) + np.searchsorted(local, u), return_inverse=True)
    grams, of = np.unique(of * len(local) + np.searchsorted(local, w), return_inverse=True)
    counts = np.bincount(of, weights=times, minlength=len(grams))
    history, w = history[grams // len(local)], local[grams % len(local)]
    return (names[history // len(local)], local[history % len(local)], w, counts), of


def _pieces(contexts: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[tuple[np.uint64, np.uint64]]:
    """First and last contexts of pieces that have ``most`` n-grams at most, or one context alone."""
    names, sizes = _merge(contexts, sizes)
    ends, k = np.cumsum(sizes), 0
    while k < len(names):
        to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most, "right")))
        yield names[k], names[to - 1]
        k = to


def _answer(words: Words, keep: bool):
    """Rows (shard, chunk, data), by shard, to rows (chunk, shard, data) with the answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, unpress, shard = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor(), None
        held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # chunk, contexts, where their n-grams begin, (u, w, count) in 15 bytes

        def add(chunk: int, data: pa.Buffer):
            raw = np.frombuffer(unpress.decompress(data), np.uint8)
            n, m = raw[:16].view(np.int64).tolist()
            sizes = _unplanes(raw[16 + 8 * m :], m, 5).astype(np.int64)
            held.append((chunk, _unplanes(raw[16:], m, 8), np.append(0, np.cumsum(sizes)), np.ascontiguousarray(raw[16 + 13 * m :].reshape(15, n).T)))

        def grams(part: list[tuple[int, int, int]]) -> list[np.ndarray]:
            context = np.concatenate([held[k][1][a:b] for k, a, b in part])
            sizes = np.concatenate([np.diff(held[k][2][a : b + 1]) for k, a, b in part])
            packed = np.concatenate([held[k][3][held[k][2][a] : held[k][2][b]] for k, a, b in part])
            out = np.zeros((3, len(packed), 8), np.uint8)
            out[:, :, :5] = packed.reshape(-1, 3, 5).swapaxes(0, 1)
            return [np.repeat(context, sizes), *out.view(np.int64)[:, :, 0]]

        def look_up(name: str, context: np.ndarray, u: np.ndarray, w: np.ndarray, counts: np.ndarray) -> np.ndarray:
            met = counts > 0
            _save(words.uri, name, built := build(context[met], u[met], w[met], counts[met]))
            trie = Shard(np.frombuffer(built, np.uint8) if "://" in words.uri else _map(words.uri, name))
            seen, which = np.unique(w, return_inverse=True)
            p = trie.log10(context, u, w, words.low(words.counts(seen))[which])
            if not keep:
                _forget(words.uri, name)
            return np.minimum(np.round(p / -STEP), LOWEST).astype(np.uint16)

        def close():
            answers = [np.empty(len(packed), np.uint16) for _, _, _, packed in held]
            contexts, sizes = np.concatenate([x[1] for x in held]), np.concatenate([np.diff(x[2]) for x in held])
            for number, (first, last) in enumerate(_pieces(contexts, sizes, PIECE)):
                parts, size = [], PIECE  # of the chunks, with PIECE n-grams or one chunk each: more than one part only if the piece is one context
                for k, (_, names, at, _) in enumerate(held):
                    a, b = int(names.searchsorted(first)), int(names.searchsorted(last, "right"))
                    if a < b:
                        size += int(at[b] - at[a])
                        if size > PIECE:
                            parts.append([])
                            size = int(at[b] - at[a])
                        parts[-1].append((k, a, b))
                found, of = _distinct(*grams(parts[0]))
                for part in parts[1:]:
                    found, of = _distinct(*(np.concatenate(x) for x in zip(found, grams(part), strict=True)))
                steps = look_up(f"shard-{shard:07d}-{number:05d}", *found)
                for part in parts:
                    if len(parts) > 1:
                        of = _distinct(*(np.concatenate(x) for x in zip(found, grams(part), strict=True)))[1][len(steps) :]
                    done = 0
                    for k, a, b in part:
                        lo, hi = held[k][2][a], held[k][2][b]
                        answers[k][lo:hi] = steps[of[done : done + hi - lo]]
                        done += hi - lo
            rows = [(x[0], shard, press.compress(steps.tobytes())) for x, steps in zip(held, answers, strict=True)]
            held.clear()
            for lo in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[lo : lo + 64]], t) for k, t in enumerate([pa.int64(), pa.int32(), pa.binary()])], names=["chunk", "shard", "data"])

        for batch in batches:
            for s, chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if s != shard:
                    if held:
                        yield from close()
                    shard = s
                add(chunk, data.as_buffer())
        if held:
            yield from close()

    return run


def _sum_up(words: Words):
    """Answers, by chunk and shard, to the rows of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress, chunk, held = zstandard.ZstdDecompressor(), None, []

        def close():
            data = np.frombuffer(_read(words.uri, f"chunk-{chunk}"), np.uint8)
            at = data[:32].view(np.int64).tolist()
            rows = pa.ipc.open_stream(data[at[0] : at[1]].tobytes()).read_all().combine_chunks().to_batches()[0]
            occurrences, text = (np.frombuffer(unpress.decompressobj().decompress(data[at[k] : at[k + 1]].tobytes()), np.uint8) for k in (1, 2))
            occurrences, text = (_unplanes(x, len(x) // 5, 5).astype(np.int64) for x in (occurrences, text))
            p = np.concatenate([np.frombuffer(x, np.uint16) for x in held]) * -STEP
            held.clear()
            score = np.bincount(text, weights=np.repeat(p, occurrences), minlength=rows.num_rows)
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(score, pa.float64())], names=[*rows.schema.names, "score"])

        for batch in batches:
            for c, data in zip(batch.column("chunk").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if c != chunk:
                    if held:
                        yield close()
                    chunk = c
                held.append(unpress.decompress(data))
        if held:
            yield close()

    return run


def score_texts(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    With ``keep``, the files of the trie stay in the shared folder while this process lives.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    words = count_words(docs.selectExpr("cast(doc_id as string) doc_id", "cast(text as string) text"), size)
    shards = min(MOST_SHARDS, max(LEAST_SHARDS, 1 << (size // SHARD_BYTES).bit_length()))
    asked = docs.selectExpr("doc_id", "cast(text as string) text").mapInArrow(_ask(words, shards), "shard int, chunk long, data binary")
    answers = asked.repartition(shards, "shard").sortWithinPartitions("shard", "chunk").mapInArrow(_answer(words, keep), "chunk long, shard int, data binary")
    done = answers.repartition("chunk").sortWithinPartitions("chunk", "shard").mapInArrow(_sum_up(words), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return done.select("doc_id", (split_number(F.col("doc_id"), PARTS) == OUT).alias("held_out"), "n_tokens", "n_known", F.lit(words.n).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
