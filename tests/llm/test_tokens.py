"""Encoding and decoding against the public tokenizers; chat formatting read back; the pipeline's stages."""

import hashlib
import random

import numpy as np
import pytest
from conftest import COLUMNS, sentence, write_tables
from siltstone.llm import chat, pieces

ODD = ["", " ", "  a  b ", "x" * 3000, "ab" * 900, "\U0001f600\U0001f600 naïve Été", "▁mark ▁▁", "\n\t\x0b line\n\n", "</s><s>[INST]", "日本語のテキスト、漢字", "0 12 345 6789", "\x00\x01", "á é", "the the the"]


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary()


def test_encode_equals_the_library(spark, model, vocabulary):
    docs = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rng = random.Random(0)
    mixed = ["".join(rng.choice("abcdeé \n.,日本\U0001f600") for _ in range(rng.randrange(200))) for _ in range(200)]
    encoder = pieces.Encoder(vocabulary)
    for texts in (docs, ODD, mixed, docs[:5]):
        assert [x.tolist() for x in encoder.encode(texts)] == model.encode(texts)


def test_encoder_forgets(model, vocabulary):
    """A small memory changes nothing."""
    rng = random.Random(1)
    encoder = pieces.Encoder(vocabulary, most=2000)
    for _ in range(4):
        texts = [sentence(rng, 40) for _ in range(20)]
        assert [x.tolist() for x in encoder.encode(texts)] == model.encode(texts)


def test_runs_of_equal_hash(model, vocabulary, monkeypatch):
    """A text whose run hashes like a known one is encoded by itself: words that collide for every odd base, and a hash
    that tells nothing apart."""
    word = "a"
    while len(word) < 2048:
        word += word.translate({97: "b", 98: "a"})
    other = word.translate({97: "b", 98: "a"})
    texts = [word, other, f"{word} {other}", other[:-1]]
    encoder = pieces.Encoder(vocabulary)
    got = encoder.encode(texts)
    assert [x.tolist() for x in got] == model.encode(texts) and [encoder.decode(i).decode() for i in got] == texts
    monkeypatch.setattr(pieces.Encoder, "hash", staticmethod(lambda x: x % np.uint64(5)))
    texts = ["the red fox", "a fox the red", "xed the", "", "é the fox \U0001f600"] * 2
    encoder = pieces.Encoder(vocabulary)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == model.encode(texts)


def test_long_runs(model, vocabulary, monkeypatch):
    """Runs without a place to cut them, and texts of several windows."""
    rng = random.Random(2)
    texts = ["x" * 100_000, "ab" * 30_000, "".join(rng.choice("abcdeint") for _ in range(60_000)), "=" * 40_000, " " * 30_000, "7" * 20_000, "".join(rng.choice("日本語\U0001f600") for _ in range(5000))]
    assert [x.tolist() for x in pieces.Encoder(vocabulary).encode(texts)] == model.encode(texts)
    monkeypatch.setattr(pieces, "WINDOW", 64)
    texts = [sentence(rng, 200), *ODD]
    assert [x.tolist() for x in pieces.Encoder(vocabulary).encode(texts)] == model.encode(texts)


def test_decode(model, vocabulary):
    encoder = pieces.Encoder(vocabulary)
    for text, ids in zip(ODD, encoder.encode(ODD), strict=True):
        assert encoder.decode(ids) == text.replace(pieces.MARK, " ").encode()


def test_suffix_array():
    x = np.random.default_rng(0).integers(0, 4, 500).astype(np.int32)
    got = pieces.suffix_array(x, 16)
    keys = [x[k : k + 16].tolist() for k in got]
    assert sorted(got.tolist()) == list(range(500)) and keys == sorted(keys)


def test_encode_texts(odd, empty, model):
    out = pieces.encode_texts(odd, with_ids=True).collect()
    want = {}
    for r in odd.collect():
        ids = model.encode(r.text or "")
        want.setdefault(r.doc_id, []).append((len(ids), hashlib.sha256(np.array(ids, np.int32).tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert len(out) == odd.count() and all(r.round_trip for r in out)
    assert all((r.n_tokens, r.ids_sha256, r.text_sha256) in want[r.doc_id] and len(r.ids) == r.n_tokens for r in out)
    assert pieces.encode_texts(empty).count() == 0


# --- chat ---

TURNS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi </s> there"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, None, "[INST] <s>"), (2, 0, "assistant", "<\\s> <\\\\/s> [\\INST]"),
    (3, 5, "assistant", "é\U0001f600\n\n"), (3, 1, "</s>", "x" * 30_000), (3, None, "system", "null turn"), (None, 0, "assistant", "no id"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a"), (5, 0, "assistant", "[/INST] </s>"),
]


def test_escape():
    for text in ["</s>", "<\\/s>", "<\\\\/s>", "[INST]", "[\\/INST]", "<s", "<\\s>[\\\\INST] <s>", "plain", ""]:
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(m in safe for m in chat.MARKS)


def test_white_space_is_cut_exactly():
    """Around the length from which runs are cut out, and with every kind of white space."""
    coder, rng = chat.Coder(), random.Random(4)
    kinds = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2003\u2028\u202f\u3000\x1c\u200b"
    for n in (4095, 4096, 5000):
        for tail in ("", "word", "7", "=", "\n", "\u3000x", "\x1cx"):
            for run in (" " * n, "\n" * n, "".join(rng.choice(kinds) for _ in range(n))):
                text = f"head{run}{tail} end{run}"
                assert coder.ids(text) == coder.plain.encode_ordinary(text)


@pytest.mark.parametrize("char", [" ", "\n", "\u3000", "a", "é", "7", "=", "\U0001f600", "[INST] "])
def test_very_long_turns(char):
    text = char * (2_000_000 // len(char)) + "x"
    coder = chat.Coder()
    assert chat.unescape(coder.plain.decode_bytes(coder.ids(chat.escape(text))).decode()) == text


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: t[:2])
        learnt = "".join(t for *_, r, t in turns if r == "assistant")
        shown = "<s>" + "".join(f"[INST]{chat.escape(r)}[/INST]{chat.escape(t)}</s>" for *_, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(shown))
    return out


@pytest.mark.parametrize("chunk", [16, 8192])
def test_chat(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    rng = random.Random(3)
    rows = [r for r in TURNS if r[0] != 2] + [(10 + c, t, ("user", "assistant")[t % 2], sentence(rng, 30)) for c in range(30) for t in range(c % 7 + 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, part string, reply int").repartition(4)
    got = chat.read_back(chat.format_conversations(df)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_chat_ties_and_empty(spark):
    """Rows of one turn stand in a fixed order; an empty table has no conversations."""
    rows = [(*r,) for r in TURNS]
    schema = "conv_id bigint, turn bigint, role string, text string"
    a, b = (sorted(map(repr, chat.read_back(chat.format_conversations(spark.createDataFrame(x, schema).repartition(n))).collect())) for x, n in ((rows, 1), (rows[::-1], 5)))
    assert a == b
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], schema))).count() == 0


def test_reserved_ids_come_from_the_template_alone(spark):
    rows = [(1, 0, "user", "<s></s>[INST][/INST]"), (1, 1, "assistant", "</s>")]
    ids = [i for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect() for i in r.ids]
    assert [i for i in ids if i >= chat.BEGIN] == [chat.BEGIN] + [chat.OPEN, chat.CLOSE, chat.END] * 2


# --- pipeline ---


def test_pipeline_stages(spark, odd, tmp_path):
    """Each stage of the pipeline on odd documents, against what its operator says of them."""
    import corpus_pipeline
    from siltstone.llm import mixing, near_dedup, toxicity

    d = write_tables(spark, tmp_path, odd)
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, out = docs, stage(spark, docs, d)
        out.write.parquet(f"{d}/stage{k}")
        docs = spark.read.parquet(f"{d}/stage{k}")
        seen[name] = docs.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == odd.columns
        if name == "toxicity":
            assert docs.count() == toxicity.toxicity(before, spark.read.parquet(f"{d}/labels.parquet")).where("predicted = 0").count()
        elif name == "near_dedup":
            assert docs.count() == near_dedup.near_duplicates(before).where("stays").count()
        elif name == "mixing":
            assert docs.count() == mixing.mix(before).agg({"copies": "sum"}).first()[0]
        elif name == "sentencepiece":
            assert docs.count() == before.count() and docs.where("not round_trip").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    assert seen["exact_dedup"] < odd.count() and seen["near_dedup"] < seen["exact_dedup"]


def test_pipeline_empty(spark, tmp_path):
    import corpus_pipeline

    d = write_tables(spark, tmp_path, spark.createDataFrame([], COLUMNS))
    assert corpus_pipeline.run(spark, d).count() == 0
