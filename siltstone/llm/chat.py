"""Chat formatting by token-level assembly.

Every role and every text is encoded by itself; control tokens are spliced in as reserved ids, never as text, so no
content can act as one. A conversation is

    <s>  then for each turn  [INST] role [/INST] text </s>

with the four marks as ids beyond the vocabulary. Where content spells a mark, a backslash is put behind its bracket,
and where it already spells an escaped one, one more, so removing one backslash restores every text. The loss mask is
one over assistant texts alone: segment lengths are summed to borders, +1 and -1 are set there, and their prefix sums
are the mask.

Encoding happens where the rows lie. Rows are then dealt out by conversation, sorted by turn, and streamed: a task
holds one chunk of ``CHUNK`` tokens and one turn at a time, however long a conversation is.

Defined results: null role or text is empty; rows of equal turn stand in the order of their tokens, null turns first;
texts may be of any length and of any characters; repeated rows are repeated turns; a null conv_id is a conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MARKS = ("<s>", "</s>", "[INST]", "[/INST]")
BEGIN, END, OPEN, CLOSE = range(50256, 50260)
CHUNK = 8192
#: White space as the pattern's \\s has it.
_WIDE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
_SPELT = re.compile(r"(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\])")


def escape(text: str) -> str:
    return _SPELT.sub(lambda m: (m[1] or m[4]) + "\\" + (m[2] or m[5] or "") + (m[3] or m[6]), text)


def unescape(text: str) -> str:
    return _SPELT.sub(lambda m: (m[1] or m[4]) + (m[2] or m[5] or "")[1:] + (m[3] or m[6]), text)


def tokenizer(path: str = RANKS, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("siltstone", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Coder:
    """Texts of any length to ids.

    White space before more text is one pre-token but for its last character, and at the end of a text one as a whole.
    The tokenizer's pattern takes a stack as deep as that run is long, so long runs are cut out before.
    """

    def __init__(self, path: str = RANKS):
        self.path, self.plain = path, tokenizer(path)
        self.whole = None

    def ids(self, text: str) -> list[int]:
        found, at = [], 0
        for m in _WIDE.finditer(text):
            self.whole = self.whole or tokenizer(self.path, r"(?s).+")
            stop = m.end() - (m.end() < len(text))
            found += self.plain.encode_ordinary(text[at : m.start()])
            found += self.whole.encode_ordinary(text[m.start() : stop])
            at = stop
        return found + self.plain.encode_ordinary(text[at:])


def _encode(path: str):
    def work():
        coder = Coder(path)

        def coded(column: pa.Array) -> pa.Array:
            return pa.array([np.array(coder.ids(escape(t or "")), np.int32).tobytes() for t in column.to_pylist()], pa.binary())

        def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
            reply = pa.array([r == "assistant" for r in batch.column("role").to_pylist()], pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), reply, coded(batch.column("role")), coded(batch.column("text"))], names=["conv_id", "turn", "reply", "role_ids", "text_ids"])

        return handle

    return work


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to chunks (conv_id, part, ids, loss_mask)."""
    held, size, conv, part, begun = [], 0, None, 0, False

    def cut(last: bool):
        nonlocal held, size, part
        lengths = np.array([len(ids) for ids, _ in held], np.int64)
        borders = np.concatenate([[0], np.cumsum(lengths)])
        change = np.zeros(borders[-1] + 1, np.int32)
        learnt = np.array([on for _, on in held], np.int32)
        np.add.at(change, borders[:-1], learnt)
        np.add.at(change, borders[1:], -learnt)
        ids, mask = np.concatenate([ids for ids, _ in held]), np.cumsum(change[:-1]).astype(bool)
        held, size = [], 0
        for start in range(0, len(ids), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([part], pa.int64()), pa.array([ids[start : start + CHUNK]], pa.list_(pa.int32())), pa.array([mask[start : start + CHUNK].tolist()], pa.list_(pa.bool_()))], names=["conv_id", "part", "ids", "loss_mask"])
            part += 1

    for batch in batches:
        for c, reply, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "reply", "role_ids", "text_ids")), strict=True):
            if not begun or c != conv:
                if held:
                    yield from cut(True)
                begun, conv, part = True, c, 0
                held.append((np.array([BEGIN], np.int32), False))
            body = np.frombuffer(text, np.int32)
            held += [(np.array([OPEN], np.int32), False), (np.frombuffer(role, np.int32), False), (np.array([CLOSE], np.int32), False), (body, reply), (np.array([END], np.int32), False)]
            size += len(body) + len(role) // 4 + 3
            if size >= CHUNK:
                yield from cut(False)
    if held:
        yield from cut(True)


def format_conversations(df: DataFrame, path: str = RANKS) -> DataFrame:
    """(conv_id, part, ids, loss_mask): the tokens of each conversation in chunks, in order within a partition."""
    rows = df.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "cast(role as string) role", "cast(text as string) text")
    coded = per_batch(rows, _encode(path), "conv_id long, turn long, reply boolean, role_ids binary, text_ids binary", 2048)
    dealt = coded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role_ids", "text_ids")
    return dealt.mapInArrow(_assemble, "conv_id long, part long, ids array<int>, loss_mask array<boolean>")


def _read_back(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        rows: list[tuple] = []
        state = None

        def close():
            if state:
                rows.append((state["conv"], state["turns"], state["all"].hexdigest(), state["loss"], state["learnt"].hexdigest(), state["chars"]))

        def flush():
            nonlocal rows
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])], names=names)
            rows = []
            return out

        for batch in batches:
            convs, parts, listed, masks = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)
            for k in range(batch.num_rows):
                if parts[k] == 0:
                    close()
                    state = {"conv": convs[k], "turns": 0, "all": hashlib.sha256(), "loss": 0, "learnt": hashlib.sha256(), "chars": 0, "role": "", "ids": [], "on": []}
                ids = listed[k].values.to_numpy()
                mask = masks[k].values.to_numpy(zero_copy_only=False)
                at = 0
                for stop in [*np.nonzero(ids >= BEGIN)[0].tolist(), len(ids)]:
                    state["ids"].append(ids[at:stop])
                    state["on"].append(ids[at:stop][mask[at:stop]])
                    at = stop + 1
                    if stop == len(ids):
                        break
                    text = coder.decode_bytes(np.concatenate(state["ids"]).tolist()).decode()
                    learnt = unescape(coder.decode_bytes(np.concatenate(state["on"]).tolist()).decode())
                    state["ids"], state["on"] = [], []
                    state["chars"] += len(text) + len(MARKS[ids[stop] - BEGIN])
                    state["loss"] += len(learnt)
                    state["learnt"].update(learnt.encode())
                    if ids[stop] == CLOSE:
                        state["role"] = unescape(text)
                    elif ids[stop] == END:
                        state["turns"] += 1
                        state["all"].update(f"{state['role']}\n{unescape(text)}\n".encode())
            if len(rows) > 1000:
                yield flush()
        close()
        yield flush()

    return run


def read_back(formatted: DataFrame, path: str = RANKS) -> DataFrame:
    """The digest of each conversation, from its tokens and mask alone."""
    return formatted.mapInArrow(_read_back(path), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return read_back(format_conversations(rows.unionByName(more)))
