"""SentencePiece encoding and decoding by suffix-array matching.

The model is a byte-pair vocabulary with byte fallback. A text falls apart, exactly, between any two characters that
stand side by side in no piece; a batch is the set of the distinct runs that remain. Runs are told apart by 64-bit hashes from
prefix sums, and what a hash finds is compared with the run itself, character by character: a run that only shares its
hash with a known one is encoded by itself. For each batch

1. all runs that are new to the task are laid out in one array of code points and a suffix array is built by prefix
   doubling, as deep as the longest piece;
2. every piece finds its range of occurrences in it by binary search, all pieces at once;
3. the occurrences are edges, sorted by their position within a part, and relaxed front to back: the edge with piece q
   extends the encoding of a prefix that ends in piece p if merging p + q in the order of the vocabulary leaves both
   whole. Of the edges that end at a position exactly one does. That test undoes merges from the newest and is
   remembered for each pair.

The result is the same as merging pair by pair. Texts are never cut; a part without spaces may be of any length, and is
indexed whole: such a run takes some 200 bytes of memory a character while it is new. What a worker remembers of runs is
bounded by ``MOST_BYTES``, and goes on to its next tasks.

Defined results: null or empty text has no ids and decodes to an empty text; a space mark U+2581 in a text decodes to
a space, as in any SentencePiece model; an empty table gives an empty result; other columns are carried by no output.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import mix, per_batch

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_END = 0x110000  # sorts after every character and is in no piece
_BETWEEN = "\udfff"  # stands between parts; no valid text holds it
MOST_BYTES = 32 << 20  # of runs that a worker remembers, with their ids
MOST_PAIRS = 200_000  # of pieces whose test a task remembers
GROUP = 400_000  # characters of new runs that are indexed at once
LONG = 2000  # a longer run is relaxed edge by edge: few others have edges at its later offsets
WINDOW = 1 << 20  # characters that are hashed at once
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


class Vocabulary:
    """Pieces by rank: single characters first, then merges from the oldest. Small enough to travel with a task."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        normal = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i) for i in normal}
        self.bytes_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        order = sorted(normal, key=lambda i: (len(text[i]) > 1, -sp.get_score(i)))
        ranked = {text[i]: r for r, i in enumerate(order)}
        left, right, whole = list(range(len(order))), list(range(len(order))), [True] * len(order)
        for r, i in enumerate(order):
            if len(text[i]) > 1:
                symbols = [ranked.get(c, -1) for c in text[i]]
                names = list(text[i])
                while len(names) > 2:
                    options = [(ranked[names[k] + names[k + 1]], k) for k in range(len(names) - 1) if names[k] + names[k + 1] in ranked]
                    if not options:
                        break
                    k = min(options)[1]
                    names[k : k + 2] = [names[k] + names[k + 1]]
                whole[r] = len(names) == 2 and all(n in ranked for n in names) and -1 not in symbols
                if whole[r]:
                    left[r], right[r] = ranked[names[0]], ranked[names[1]]
        self.names = [text[i] for i in order]
        self.ranked, self.left, self.right = ranked, left, right
        self.ids = np.array(order, np.int32)
        use = [r for r in range(len(order)) if whole[r]]
        self.depth = max(len(self.names[r]) for r in use)
        self.rank = np.array(use, np.int32)
        self.length = np.array([len(self.names[r]) for r in use], np.int32)
        self.chars = np.full((len(use), self.depth), -1, np.int32)
        for row, r in enumerate(use):
            self.chars[row, : self.length[row]] = [ord(c) for c in self.names[r]]
        beside = {(a, b) for r in use for a, b in zip(self.names[r], self.names[r][1:], strict=False)}
        held = sorted({c for pair in beside for c in pair})
        self.place = np.zeros(_END + 1, np.uint16)  # of a character among those, 0 for others
        self.place[[ord(c) for c in held]] = range(1, len(held) + 1)
        self.beside = np.zeros((len(held) + 1, len(held) + 1), bool)
        for a, b in beside:
            self.beside[self.place[ord(a)], self.place[ord(b)]] = True
        self.out = [b""] * sp.vocab_size()
        for i in normal:
            self.out[i] = text[i].replace(MARK, " ").encode()
        for b, i in enumerate(self.bytes_ids):
            self.out[i] = bytes([b])
        self.out_bytes = np.frombuffer(b"".join(self.out), np.uint8)
        self.out_size = np.array([len(x) for x in self.out], np.int64)
        self.out_at = np.cumsum(self.out_size) - self.out_size

    def lasting(self, p: int, q: int) -> bool:
        """Whether merging the characters of p + q ends in p, q: no merge across the border comes before theirs."""
        ranked, names, left, right = self.ranked, self.names, self.left, self.right
        before = len(names) + 1  # a merge across the border of a smaller rank would have come first
        while True:
            across = ranked.get(names[p] + names[q])
            if across is not None and across < before:
                return False
            undo_p = p > q
            if undo_p and right[p] == p or not undo_p and left[q] == q:
                undo_p = not undo_p
            if undo_p:
                if right[p] == p:
                    return True
                before, p = p, right[p]
            else:
                if left[q] == q:
                    return True
                before, q = q + 1, left[q]


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``x`` in the order of what follows them, ``depth`` values deep."""
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        after = np.zeros_like(rank)
        after[:-k] = rank[k:] + 1
        key = rank * (len(x) + 1) + after
        order = np.argsort(key)
        k *= 2
        if k >= depth:
            return order
        step = np.empty(len(x), np.int64)
        step[0] = 0
        sorted_key = key[order]
        np.cumsum(sorted_key[1:] != sorted_key[:-1], out=step[1:])
        rank = np.empty_like(rank)
        rank[order] = step
        if step[-1] == len(x) - 1:
            return order


def _points(text: str) -> np.ndarray:
    """Code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)


def _gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[k], ..., starts[k] + counts[k] - 1, for each k."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


class Encoder:
    def __init__(self, vocabulary: Vocabulary, most: int = MOST_BYTES):
        self.v, self.most = vocabulary, most
        self.pairs: dict[int, bool] = {}
        self.up = self.down = np.ones(1, np.uint64)
        self.forget()

    def forget(self) -> None:
        """Known runs: sorted hashes; where in ``ids`` their encodings lie, and in ``text`` their characters."""
        self.hashes, none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.count, self.text_at, self.size = none, none, none, none
        self.ids = self.text = np.zeros(0, np.int32)

    def occurrences(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, row of the piece) of every occurrence of every piece."""
        v = self.v
        order = suffix_array(x, v.depth)
        padded = np.concatenate([x, np.full(v.depth, _END, np.int32)])
        seen = np.unique(x)
        rows = np.nonzero(np.isin(v.chars[:, 0], seen))[0]
        chars, length = v.chars[rows], v.length[rows]

        def bound(upper: bool) -> np.ndarray:
            lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(x), np.int64)
            while True:
                open_ = np.nonzero(lo < hi)[0]
                if not len(open_):
                    return lo
                mid = (lo[open_] + hi[open_]) // 2
                at = order[mid]
                less, even = np.zeros(len(open_), bool), np.ones(len(open_), bool)
                for d in range(v.depth):
                    live = even & (d < length[open_])
                    if not live.any():
                        break
                    a, b = padded[at + d], chars[open_, d]
                    less |= live & (a < b)
                    even &= ~live | (a == b)
                go = less | even if upper else less
                lo[open_[go]] = mid[go] + 1
                hi[open_[~go]] = mid[~go]

        first, last = bound(False), bound(True)
        count = last - first
        total = int(count.sum())
        which = np.repeat(np.arange(len(rows)), count)
        inside = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        return order[np.repeat(first, count) + inside], rows[which]

    def powers(self, n: int) -> None:
        """Powers of the hash base and of its inverse, modulo 2 ** 64."""
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_BACK, k, 1 << 64))])

    def matched(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct runs one after another, and the number of each."""
        ids, counts, size, group = [], [], 0, []

        def close():
            nonlocal size, group
            if group:
                found, each = self.index(group)
                ids.append(found)
                counts.append(each)
            group, size = [], 0

        for run in runs:
            if len(run) > LONG:
                close()
                found = self.index_long(run)
                ids.append(found)
                counts.append(np.array([len(found)]))
            else:
                group.append(run)
                size += len(run)
                if size > GROUP:
                    close()
        close()
        return np.concatenate(ids), np.concatenate(counts)

    def learn(self, hashes: np.ndarray, runs: list[str]) -> None:
        """Encode new distinct runs and remember them."""
        ids, count = self.matched(runs)
        start = len(self.ids) + np.cumsum(count) - count
        size = np.array([len(r) for r in runs], np.int64)
        text_at = len(self.text) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, ids])
        self.text = np.concatenate([self.text, _points("".join(runs))])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        for name, new in (("start", start), ("count", count), ("text_at", text_at), ("size", size)):
            setattr(self, name, np.insert(getattr(self, name), at, new))

    def index_long(self, run: str) -> np.ndarray:
        """The ids of one long run: the same edges, relaxed one after another."""
        v, size = self.v, len(run)
        x = np.append(_points(run), np.int32(_END))
        at, row = self.occurrences(x)
        piece, end = v.rank[row].astype(np.int64), at + v.length[row]
        covered = np.zeros(size + 1, bool)
        covered[at[v.length[row] == 1]] = True
        odd = np.nonzero(~covered[:size])[0]
        at, piece, end = np.concatenate([at, odd]), np.concatenate([piece, np.full(len(odd), -1)]), np.concatenate([end, odd + 1])
        order = np.argsort(at, kind="stable")
        last, back = [-3] * (size + 1), [0] * (size + 1)
        last[0] = -2
        for lo in range(0, len(order), 1 << 16):
            part = order[lo : lo + (1 << 16)]
            for a, q, e in zip(at[part].tolist(), piece[part].tolist(), end[part].tolist(), strict=True):
                p = last[a]
                if p != -3 and (p < 0 or q < 0 or self.pair(p << 16 | q)):
                    last[e], back[e] = q, a
        out, here = [], size
        while here:
            before = back[here]
            out.append([int(v.ids[last[here]])] if last[here] >= 0 else [v.bytes_ids[b] for b in run[before].encode()])
            here = before
        return np.array([i for x in reversed(out) for i in x], np.int32)

    def index(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct runs one after another, and the number of each; all are matched at once."""
        v = self.v
        x = _points(_BETWEEN.join(parts) + _BETWEEN)
        cut = x == ord(_BETWEEN)
        x = np.where(cut, _END, x).astype(np.int32)
        stops = np.nonzero(cut)[0]
        starts = np.concatenate([[0], stops[:-1] + 1])
        sizes = stops - starts
        at, row = self.occurrences(x)
        piece, end = v.rank[row].astype(np.int64), at + v.length[row]
        covered = np.zeros(len(x), bool)
        covered[at[v.length[row] == 1]] = True
        odd = np.nonzero(~covered & (x != _END))[0]  # characters the vocabulary lacks: spelt in bytes, never merged
        at, piece, end = np.concatenate([at, odd]), np.concatenate([piece, np.full(len(odd), -1)]), np.concatenate([end, odd + 1])
        part_of = np.repeat(np.arange(len(parts)), sizes + 1)
        offset = at - starts[part_of[at]]
        order = np.argsort(offset, kind="stable")
        at, piece, end, offset = at[order], piece[order], end[order], offset[order]
        last, back = np.full(len(x) + 1, -3, np.int64), np.zeros(len(x) + 1, np.int64)
        last[starts] = -2
        edges = np.append(np.nonzero(np.diff(offset, prepend=-1))[0], len(offset))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            p, q, a, e = last[at[lo:hi]], piece[lo:hi], at[lo:hi], end[lo:hi]
            good = p != -3
            test = np.nonzero((p >= 0) & (q >= 0))[0]
            if len(test):
                keys, inverse = np.unique(p[test] * 65536 + q[test], return_inverse=True)
                good[test] = np.fromiter(map(self.pair, keys.tolist()), bool, len(keys))[inverse]
            last[e[good]], back[e[good]] = q[good], a[good]
        pieces, owners, steps = [], [], []
        here, owner = starts + sizes, np.arange(len(parts))
        step = 0
        while len(here):
            pieces.append(np.where(last[here] >= 0, last[here], -1 - x[back[here]]))
            owners.append(owner)
            steps.append(np.full(len(here), step))
            here = back[here]
            going = here != starts[owner]
            here, owner, step = here[going], owner[going], step + 1
        pieces, owners, steps = np.concatenate(pieces), np.concatenate(owners), np.concatenate(steps)
        order = np.argsort(owners * (step + 1) + (step - steps))
        pieces, owners = pieces[order], owners[order]
        ids = np.where(pieces >= 0, v.ids[np.maximum(pieces, 0)], pieces).astype(np.int32)
        if (pieces < 0).any():
            spelt = [[t] if t >= 0 else [v.bytes_ids[b] for b in chr(-1 - t).encode()] for t in ids.tolist()]
            owners = np.repeat(owners, [len(x) for x in spelt])
            ids = np.array([i for x in spelt for i in x], np.int32)
        return ids, np.bincount(owners, minlength=len(parts))

    def pair(self, key: int) -> bool:
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > MOST_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.v.lasting(key >> 16, key & 65535)
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not texts:
            return []
        whole = "".join([f" {t}{_BETWEEN}" if t else _BETWEEN for t in texts]).replace(" ", MARK)
        x = _points(whole)
        place = self.v.place[x]
        first = np.ones(len(x), bool)
        first[1:] = ~self.v.beside[place[:-1], place[1:]]
        cuts = np.nonzero(first)[0]
        ends = np.append(cuts[1:], len(x))
        stop = x[cuts] == ord(_BETWEEN)
        text_of = (np.cumsum(stop) - stop)[~stop]
        cuts, ends = cuts[~stop], ends[~stop]
        edges = np.append(np.nonzero(np.diff(cuts // WINDOW, prepend=-1))[0], len(cuts))
        done = [self.runs(x, whole, cuts[lo:hi], ends[lo:hi]) for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        ids = np.concatenate([i for i, _ in done]) if done else np.zeros(0, np.int32)
        count = np.concatenate([c for _, c in done]) if done else np.zeros(0, np.int64)
        each = np.bincount(text_of, weights=count, minlength=len(texts)).astype(np.int64)
        return np.split(ids, np.cumsum(each)[:-1])

    def runs(self, x: np.ndarray, whole: str, cuts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs one after another, and the number of each."""
        if 4 * (len(self.ids) + len(self.text)) + 40 * len(self.hashes) > self.most:
            self.forget()
        base, n = cuts[0], ends - cuts
        part, a, b = x[base : ends[-1]], cuts - cuts[0], ends - cuts[0]
        self.powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.up[: len(part)], out=sums[1:])
        hashes = self.hash((sums[b] - sums[a]) * self.down[a] + n.astype(np.uint64))
        seen, sample, run = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, seen)
        new = np.ones(len(seen), bool)
        new[at < len(self.hashes)] = self.hashes[at[at < len(self.hashes)]] != seen[at < len(self.hashes)]
        if new.any():
            picked = sample[new]
            self.learn(seen[new], [whole[i:j] for i, j in zip(cuts[picked].tolist(), ends[picked].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, seen)
        at = at[run]
        start, count, ids = self.start[at], self.count[at], self.ids
        same = self.size[at] == n
        held = np.nonzero(same)[0]
        differ = part[_gather(a[held], n[held])] != self.text[_gather(self.text_at[at[held]], n[held])]
        if differ.any():
            same[np.repeat(held, n[held])[differ]] = False
        other = np.nonzero(~same)[0]
        if len(other):  # of the hash of another run
            runs = [whole[i:j] for i, j in zip(cuts[other].tolist(), ends[other].tolist(), strict=True)]
            number = {r: k for k, r in enumerate(dict.fromkeys(runs))}
            found, each = self.matched(list(number))
            which = np.array([number[r] for r in runs])
            start[other], count[other] = (len(ids) + np.cumsum(each) - each)[which], each[which]
            ids = np.concatenate([ids, found])
        return ids[_gather(start, count)], count

    hash = staticmethod(mix)

    def decode(self, ids: np.ndarray) -> bytes:
        v = self.v
        text = v.out_bytes[_gather(v.out_at[ids], v.out_size[ids])].tobytes()
        return text[1:] if text[:1] == b" " else text


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, with_ids: bool = True, rows: int = 512) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian int32), text_sha256 of the decoded text, round_trip, ids."""
    vocabulary = Vocabulary(model)

    def work():
        # a reused Python worker goes on with what its earlier tasks have learnt, MOST_BYTES and MOST_PAIRS at most
        import sys

        held = sys.__dict__.setdefault("_siltstone_encoders", {})
        encoder = held.get(model) or held.setdefault(model, Encoder(vocabulary))

        def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = encoder.encode(texts)
            decoded = [encoder.decode(i) for i in ids]
            same = [d == t.replace(MARK, " ").encode() for d, t in zip(decoded, texts, strict=True)]
            columns = [batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids]), pa.array([hashlib.sha256(d).hexdigest() for d in decoded]), pa.array(same, pa.bool_())]
            names = ["doc_id", "n_tokens", "ids_sha256", "text_sha256", "round_trip"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        return handle

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, text_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return per_batch(df.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text"), work, schema, rows)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
