"""What the operators share: slices of batches, joins with hot keys, the shared folder."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from siltstone.llm import common


def test_slices_are_bounded_and_whole():
    rng = random.Random(0)
    texts = [None if rng.random() < 0.1 else "x" * rng.choice([0, 1, 10, 500, 5000]) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts, pa.string())], names=["k", "t"]).slice(7, 290)
    parts = list(common.slices(batch, 32, 2000))
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(7, 297))
    for p in parts:
        held = sum(len(t or "") for t in p.column(1).to_pylist())
        assert 0 < p.num_rows <= 32 and (held <= 2000 or p.num_rows == 1)
    assert list(common.slices(batch.slice(0, 0), 32)) == []


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot", [1, 4, 256])
def test_join_hot_is_a_join(spark, how, hot):
    """A third of the rows has one key; keys without a partner, and null keys, are treated as the plain join treats them."""
    rng = random.Random(1)
    rows = spark.createDataFrame([(7 if rng.random() < 0.33 else rng.choice([None, *range(30)]), k) for k in range(600)], "k int, v int").repartition(4)
    found = spark.createDataFrame([(k, f"n{k}") for k in range(0, 40, 2)] + [(7, "n7")], "k int, name string")
    got = common.join_hot(rows, found, "k", how, hot)
    assert Counter(map(tuple, got.select("k", "v", "name").collect())) == Counter(map(tuple, rows.join(found, "k", how).select("k", "v", "name").collect()))


def test_shared_folder(spark, monkeypatch):
    """No silent local folder on a cluster."""

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError):
        common.shared_dir(Session())
    assert common.shared_dir(spark)


def test_tables_can_be_dropped(spark):
    written = common.table(spark.range(5), "five")
    assert written.count() == 5
    common.drop(written)
    assert not spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(written._siltstone_path))
