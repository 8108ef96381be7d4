"""Documents that hold every odd case: nulls, empty and blank texts, copies, repeated rows, clashing columns."""

import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row bigint, rec string, n bigint, grp bigint, `a.b` string"
WORDS = [f"{a}{b}" for a in ("Ka", "lo", "mi", "re", "su", "té") for b in ("nt", "rak", "vel", "dis", "pomo", "q")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows(seed=1, n=60):
    """Rows of COLUMNS, the last five of which clash with names that operators use themselves."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i * 3, sentence(rng, rng.choice([3, 20, 80, 200])), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None])))
    long = sentence(rng, 20_000)
    rows += [(1000, long, "en", "a"), (1001, long.replace("Kant", "kant"), "en", "b"), (1002, long + " more", None, "a")]
    base = sentence(rng, 120)
    rows += [(2000 + i, base, "fr", "hot") for i in range(40)]
    rows += [(3000 + i, " ".join(w if k != i else "changed" for k, w in enumerate(base.split())), "fr", "hot") for i in range(20)]
    rows += [(4000, None, None, None), (4001, "", "en", ""), (4002, " \t\n\x0b\x0c\r ", "en", "a"), (4003, "one", None, "b"), (4004, "One", "fr", "b"), (4005, "one two three", "fr", "b")]
    rows += [(None, base, "fr", "hot"), (None, "some words that have no id at all", "en", None), (None, None, None, None)]
    rows += [rows[0], rows[0], rows[-1], (5, rows[0][1], "en", "a"), (5, rows[1][1], "en", "a")]
    rows += [(5000, "line one\nline two\nline one\n\n \nline one \n# a*b $%", "en", "a"), (5001, "x y  z \U0001f600 naıve Été 42 </s> [INST]", "en", "c")]
    rng.shuffle(rows)
    return [(*r, len(r[1]) if r[1] else None, 7, "rec", 1, None, "dot") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def write_tables(spark, path, docs, labels=None, conversations=None):
    docs.write.parquet(f"{path}/documents.parquet")
    (labels if labels is not None else spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).write.parquet(f"{path}/labels.parquet")
    if conversations is not None:
        conversations.write.parquet(f"{path}/conversations.parquet")
    return str(path)
