"""Round trips, lazy reads, pruning, damaged stores."""

import io
import json
import shutil

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone import Builder, Items, Options, Store, StoreCodecError, StoreDecodeError, StoreFormatError, StoreIOError, chunk, inline, keyed_map, load_bytes, record, save, save_sync, serialize, vector, write
from siltstone.functions import layout
from siltstone.functions.codec import CodecTable, HookTable
from siltstone.operators.lazy import ChildrenPromise, CollectionPromise, MapPromise
from siltstone.sources.shared import Files

HEAVY = record("HeavyItem", id=inline("u32"), name=chunk("string"), data=chunk("binary"))
PROFILE = record("Profile", level=inline("u32"), score=inline("bigint"), bio=chunk("string"))
WORLD = record("World", id=inline("bigint"), name=inline("string"), key=inline("binary"), blob=chunk("binary", codec="lz4"), numbers=vector("bigint"), items=vector(HEAVY, codec="none"), users=keyed_map("string", PROFILE, codec="zstd"), plain=keyed_map("bigint", "string"), config=chunk(record("Config", version=inline("int"), text=chunk("string"))))


def values(n=50, users=40):
    return {"id": 7, "name": "w", "key": b"\x01\x02", "blob": b"\xaa" * 1000, "numbers": list(range(0, n * 10, 10)), "items": [{"id": i, "name": f"n{i}", "data": bytes([i]) * 5} for i in range(n)],
            "users": {f"user_{i}": {"level": i % 100, "score": i * 10, "bio": f"bio {i}"} for i in range(users)}, "plain": {i: str(i) for i in range(users)}, "config": {"version": 3, "text": "long"}}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "world")
    save(spark, path, WORLD, values(), Options(shard_items=20, buckets=4))
    return Store.open(spark, path)


def test_round_trip(spark, store):
    assert store.load() == values()


def test_bytes_and_sync(spark, tmp_path):
    data = serialize(spark, WORLD, values(5, 3))
    assert load_bytes(spark, data) == values(5, 3)
    out = io.BytesIO()
    write(spark, out, WORLD, values(5, 3))
    assert Store.open_bytes(spark, out.getvalue()).root().users.get("user_2")["score"] == 20
    save_sync(spark, str(tmp_path / "s"), WORLD, values(5, 3))
    save_sync(spark, str(tmp_path / "s"), WORLD, values(6, 3))  # replaces it
    assert Store.open(spark, str(tmp_path / "s")).load() == values(6, 3)
    Builder().compression(True).shard_items(3).save(spark, str(tmp_path / "b"), WORLD, values(7, 2))
    assert Store.open(spark, str(tmp_path / "b")).load() == values(7, 2)


def test_mirror(store):
    root = store.root()
    assert (root.id, root.name, root.key, root.config.version) == (7, "w", b"\x01\x02", 3)
    assert root.config.text.load() == "long" and root.blob.load() == b"\xaa" * 1000
    with pytest.raises(AttributeError):
        root.nothing  # noqa: B018


def test_vector(store):
    items, numbers = store.root().items, store.root().numbers
    assert len(items) == 50 and not items.is_empty()
    assert items.get(49)["name"] == "n49" and items.get_lazy(25).data.load() == b"\x19" * 5
    assert (items.first().id, items.last().id) == (0, 49)
    assert (numbers.get(3), numbers.get_lazy(3), numbers.first(), numbers.last()) == (30, 30, 0, 490)  # primitives read lazily too
    for bad in (50, -1):
        with pytest.raises(StoreFormatError):
            items.get(bad)
    assert [x["id"] for x in items.iter()] == list(range(50))
    it = items.iter_lazy()
    for i in range(50):
        assert len(it) == 50 - i and next(it).id == i
    assert next(it, None) is None
    assert [r.id for r in items.slice(48, 60).orderBy("pos").collect()] == [48, 49]
    with pytest.raises(StoreFormatError):
        items.slice(48, 60, clamp=False)
    assert {r.pos for r in items.semi_load(items.lazy().where("id % 10 = 3"), "name").collect()} == {3, 13, 23, 33, 43}


def test_map(store):
    users = store.root().users
    assert users.get("user_17") == {"level": 17, "score": 170, "bio": "bio 17"}  # heavy fields of values included
    assert users.get_lazy("user_17").level == 17 and users.get_lazy("user_17").bio.load() == "bio 17"
    assert users.get("admin") is None and users.get_lazy("admin") is None and len(users.load()) == 40
    assert store.root().plain.get(5) == "5" and store.root().plain.get_lazy(5) == "5"


def test_empty(spark, tmp_path):
    save(spark, str(tmp_path / "e"), WORLD, values(0, 0))
    root = Store.open(spark, str(tmp_path / "e")).root()
    assert len(root.items) == 0 and root.items.first() is None and root.items.last() is None and list(root.items.iter_lazy()) == []
    assert root.users.get("x") is None and root.users.load() == {} and Store.open(spark, str(tmp_path / "e")).load() == values(0, 0)


def _rows_read(spark, df):
    """Rows that scans put out, after running the plan."""
    plan = df._jdf.queryExecution()
    df.collect()
    leaves = plan.executedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        for metrics in [leaf.metrics()]:
            if metrics.contains("numOutputRows"):
                total += metrics.apply("numOutputRows").value()
    return total


def test_pruning(spark, store):
    items, users = store.root().items, store.root().users
    scan = items.lazy()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<pos:bigint,id:bigint>" in scan
    explained = items.at(25)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in explained and "PushedFilters: [IsNotNull(pos), EqualTo(pos,25)]" in explained
    explained = users.find("user_1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in explained and "EqualTo(k,user_1)" in explained


def test_rows_read(spark, store):
    """A point read scans one shard or bucket, not the table."""
    items, users = store.root().items, store.root().users
    assert 0 < _rows_read(spark, items.at(25)) <= 20 and _rows_read(spark, items.scan()) == 50
    assert 0 < _rows_read(spark, items.slice(38, 42)) <= 40
    in_bucket = max(store.at["root.users"]["filled"].values())
    assert 0 < _rows_read(spark, users.find("user_1")) <= in_bucket < 40


def test_scans_of_frames_do_not_shuffle(spark):
    c = CollectionPromise.of(spark.range(1000).selectExpr("999 - id as id"), ["id"])
    for df in (c.items(), c.length()):
        assert "rangepartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in c.slice(3, 6).orderBy("pos").collect()] == [3, 4, 5] and c.last_row().first().id == 999 and c.first_row().first().id == 0
    assert [(r.pos, r.id) for r in c.at(7, 2).orderBy("pos").collect()] == [(2, 2), (7, 7)]


def _saved(spark, path, **more):
    save(spark, path, WORLD, values(), Options(shard_items=20, buckets=4, **more))
    return path


def test_root_touches_no_heavy_files(spark, tmp_path):
    path = _saved(spark, str(tmp_path / "w"))
    for name in ("root.blob", "root.items", "root.users", "root.config.text"):
        shutil.rmtree(f"{path}/{name}")
    root = Store.open(spark, path).root()
    assert (root.id, root.name, root.config.version, len(root.items), root.numbers.get(3)) == (7, "w", 3, 50, 30)
    for read in (root.blob.load, root.items.scan, root.config.text.load, lambda: root.users.get("user_1")):
        with pytest.raises(StoreFormatError):
            read()


def test_missing_parts_are_noticed(spark, tmp_path):
    path = _saved(spark, str(tmp_path / "w"))
    assert Store.open(spark, path).verify().where("not ok").isEmpty()
    for f in (tmp_path / "w" / "root.items" / "shard=2").glob("*.parquet"):
        f.unlink()
    store = Store.open(spark, path)
    assert [(r.path, r.part, r.expected, r.found) for r in store.verify().where("not ok").collect()] == [("root.items", 2, 10, 0)]
    with pytest.raises(StoreFormatError):
        store.load()
    shutil.rmtree(f"{path}/root.items/shard=1")
    users = next((tmp_path / "w" / "root.users").glob("bucket=*"))
    shutil.rmtree(users)
    root = Store.open(spark, path).root()
    for read in (root.items.scan, root.items.load, root.users.scan, lambda: store.df("root.items").count()):
        with pytest.raises(StoreFormatError):
            read()


def test_failed_swap_leaves_what_was_there(spark, tmp_path, monkeypatch):
    path, rename = _saved(spark, str(tmp_path / "w")), Files.rename
    monkeypatch.setattr(Files, "rename", lambda self, a, b: rename(self, a, b) if ".new-" not in a else (_ for _ in ()).throw(StoreIOError("no")))
    with pytest.raises(StoreIOError):
        save(spark, path, WORLD, values(5, 3))
    monkeypatch.undo()
    assert Store.open(spark, path).load() == values() and sorted(x.name for x in tmp_path.iterdir()) == ["w"]
    (tmp_path / "w").rename(tmp_path / "w.old-1")  # as if the process had ended between the two renamings
    assert Store.open(spark, path).load() == values()


def test_hooks_decode_and_extent(spark, tmp_path):
    hooks = HookTable()
    hooks.register("upside down", lambda df: df.withColumn("value", -df.value), lambda df: df.withColumn("value", -df.value))
    path = _saved(spark, str(tmp_path / "w"), hooks=hooks, hook_of={"root.numbers": "upside down"})
    with pytest.raises(StoreCodecError):
        Store.open(spark, path)
    store = Store.open(spark, path, hooks=hooks)
    assert store.load() == values() and spark.read.parquet(f"{path}/root.numbers").agg({"value": "min"}).first()[0] == -490
    assert store.decode("root.numbers", "decimal(20,0)").count() == 50 and store.decode("root.items", "id double, name string").columns == ["id", "name"]
    for kind in ("string", "nothing int"):
        with pytest.raises(StoreDecodeError):
            store.decode("root.numbers", kind)
    whole, own = store.extent(store.root_node()), store.extent(store.at["root.items"])
    assert whole["child_count"] == 6 and whole["length"] > own["length"] == own["payload_length"] > 0
    files = store.payload("root.items").collect()
    assert len(files) >= 3 and all(r.length == len(r.content) and bytes(r.content[:4]) == b"PAR1" for r in files)


def test_children(spark):
    rows = ChildrenPromise(spark.createDataFrame([(o, c) for o in range(4) for c in range(o)], "o int, c int"), ["o"], ["c"])
    assert sorted((r.o, r.c, r.pos) for r in rows.at(1).collect()) == [(2, 1, 1), (3, 1, 1)]
    assert sorted((r.o, r.len) for r in rows.lengths(spark.createDataFrame([(o,) for o in range(5)], "o int")).collect()) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 0)]
    with pytest.raises(StoreFormatError):
        rows.at(-1)


def test_skewed_items_and_frames(spark, tmp_path):
    jagged = [f"{i}" for i in range(100)] + ["x" * 1_000_000] + [f"{i}" for i in range(100)]
    spec = record("Jagged", data=vector("string"))
    save(spark, str(tmp_path / "j"), spec, {"data": jagged}, Options(shard_items=50))
    assert Store.open(spark, str(tmp_path / "j")).root().data.load() == jagged
    frame = spark.range(10_000).selectExpr("id * 3 as value")
    save(spark, str(tmp_path / "f"), record("N", data=vector("bigint")), {"data": Items(frame, ["value"])}, Options(shard_items=1000))
    data = Store.open(spark, str(tmp_path / "f")).root().data
    assert data.get(5000) == 15_000 and data.get(9999) == 29_997
    assert layout.collapse([1000] * 10) == [(1000, 10)] == layout.runs(10_000, 1000)


def test_nested_map_in_vector(spark, tmp_path):
    wrapper = record("Wrapper", id=inline("int"), inner=keyed_map("string", record("Blob", payload=chunk("binary"))), tags=vector("string"))
    rows = [{"id": i, "inner": {k: {"payload": bytes([i]) * 10} for k in "ab"}, "tags": [str(i), "t"]} for i in range(3)]
    save(spark, str(tmp_path / "d"), record("Deep", level=vector(wrapper)), {"level": rows})
    level = Store.open(spark, str(tmp_path / "d")).root().level
    assert level.get_lazy(1).inner.get_lazy("b").payload.load() == b"\x01" * 10
    assert level.get_lazy(1).inner.get("zz") is None and level.get_lazy(2).tags.get(1) == "t"
    assert level.load()[2]["inner"]["a"]["payload"] == b"\x02" * 10


def test_inspect(store):
    rows = {r.path: r for r in store.inspect().collect()}
    assert rows["root.items"].kind == "vector" and rows["root.items"].item_count == 50 and json.loads(rows["root.items"].runs) == [[20, 2], [10, 1]]
    assert rows["root.users"].num_buckets == 4 and rows["root.users"].codec_id == 2 and rows["root.blob"].codec_id == 1 and rows["root.items"].codec_id == 0
    assert rows["root"].child_count == 6 and rows["root.config"].parent_id == rows["root"].node_id
    assert "users: map" in store.report() and store.size() > 0
    assert store.child(store.root_node(), 0)["path"] == "root.blob"
    with pytest.raises(StoreFormatError):
        store.child(store.root_node(), 6)


def test_damage(spark, store, tmp_path):
    with pytest.raises(StoreIOError):
        Store.open(spark, str(tmp_path / "none"))
    for name, text in (("empty", ""), ("zeros", "\0" * 100), ("half", json.dumps({"magic": "SILT"})[:5]), ("magic", json.dumps({"magic": "X"})), ("version", json.dumps({"magic": "SILT", "format_version": 5}))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(text)
        with pytest.raises(StoreFormatError):
            Store.open(spark, str(tmp_path / name))
    with pytest.raises(StoreFormatError):
        Store.open_bytes(spark, b"junk")
    with pytest.raises(StoreFormatError):
        save(spark, str(tmp_path / "dup"), record("D", m=keyed_map("int", "int")), {"m": spark.createDataFrame([(1, 2), (1, 3)], "k int, value int")})


def test_codecs(spark, tmp_path):
    with pytest.raises(StoreCodecError):
        save(spark, str(tmp_path / "c"), record("C", x=chunk("int", codec="lzma")), {"x": 1})
    table = CodecTable()
    assert table.resolve("none", "lz4") == (0, "none") and table.resolve(None, "lz4") == (1, "lz4_raw") and table.resolve(None, None) == (0, "none")
    table.register(7, "brief", "snappy")
    save(spark, str(tmp_path / "own"), record("C", x=chunk("int", codec="brief")), {"x": 1}, Options(codecs=table))
    with pytest.raises(StoreCodecError):
        Store.open(spark, str(tmp_path / "own"))
    assert Store.open(spark, str(tmp_path / "own"), table).load() == {"x": 1}


def test_layout():
    assert layout.items_per_shard(100_000, 1, cpus=4) == 6250 and layout.items_per_shard(100_000, 1, cpus=8) == 4096
    assert [layout.num_buckets(n) for n in (0, 1, 3999, 4000, 10**9)] == [0, 1, 1, 2, 1024]
    assert layout.runs(100_000, 6250) == [(6250, 16)] and layout.runs(15_000, 1009) == [(1009, 14), (874, 1)]
    assert layout.locate(7, [(3, 2), (2, 1)]) == (2, 1)
    for bad in (8, -1):
        with pytest.raises(StoreFormatError):
            layout.locate(bad, [(3, 2), (2, 1)])


def test_over_any_frame(spark):
    df = spark.range(1000).selectExpr("999 - id as id")
    c = CollectionPromise.of(df, ["id"])
    assert c.get(10) == {"id": 10} and len(c) == 1000
    assert MapPromise.of(spark.range(5).selectExpr("id", "id * 2 as v"), "id").get(3) == {"v": 6}


def _many_shards(spark, path, n=20_000, size=10, **more):
    rows = Items(spark.range(n).selectExpr("id * 3 as a", "cast(id as string) as b"), ["a"])
    keys = Items(spark.range(n).selectExpr("id * 7 as value"), ["value"])
    save(spark, path, record("M", items=vector(record("I", a=inline("bigint"), b=chunk("string"))), keys=vector("bigint")), {"items": rows, "keys": keys}, Options(shard_items=size, **more))
    return path


def test_many_shards_share_folders(spark, tmp_path):
    """Folders and files don't grow with the number of shards; what is read does not change by it."""
    path = _many_shards(spark, str(tmp_path / "m"))
    assert len([x for x in (tmp_path / "m" / "root.items").iterdir() if x.is_dir()]) <= layout.MOST_FOLDERS
    assert len(list((tmp_path / "m" / "root.items").rglob("*.parquet"))) <= layout.MOST_FOLDERS + 8
    store = Store.open(spark, path)
    items = store.root().items
    assert items.scan().columns == ["pos", "a", "b"] and items.items().columns == ["a", "b"] and items.lazy().columns == ["pos", "shard", "a"]
    assert [tuple(r) for r in items.scan().orderBy("pos").collect()] == [(i, i * 3, str(i)) for i in range(20_000)]
    assert store.df("root.items").columns == items.at(3).columns == ["pos", "a", "b", "shard"] and items.shards().columns == ["pos", "a", "b", "shard", "shard_idx", "local_idx"]
    assert [tuple(r) for r in items.at(12_345).collect()] == [(12_345, 37_035, "12345", 1234)] and {r.shard for r in items.at(0, 9, 19_999).collect()} == {0, 1999}
    assert [r.pos for r in items.slice(315, 335).orderBy("pos").collect()] == list(range(315, 335)) and items.get_lazy(777).b.load() == "777"
    assert {r.b for r in items.semi_load(items.lazy().where("a % 15000 = 3"), "b").collect()} == {"1", "5001", "10001", "15001"}
    assert items.load()[19_999] == {"a": 59_997, "b": "19999"} and store.root().keys.get(15_000) == 105_000 and [store.at["root.items"]["runs"]] == [[[10, 2000]]]
    wide = items.at(12_345)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard_folder" in wide or "PartitionFilters: [shard_folder" in wide
    assert 0 < _rows_read(spark, items.at(12_345)) <= 10 and 0 < _rows_read(spark, items.slice(315, 335)) < 320


def test_missing_parts_among_many(spark, tmp_path):
    path = _many_shards(spark, str(tmp_path / "m"), 1003, 5)
    folders = {int(x.name.rsplit("=", 1)[1]): x for x in (tmp_path / "m" / "root.items").iterdir() if x.is_dir()}
    assert sorted(folders) == list(range(51))
    checked = Store.open(spark, path).verify()
    assert checked.where("not ok").isEmpty() and sorted((r.part, r.expected, r.found) for r in checked.where("path = 'root.items'").collect()) == [(k, 5 if k < 200 else 3, 5 if k < 200 else 3) for k in range(201)]
    for f in folders[2].glob("*.parquet"):
        f.unlink()
    store = Store.open(spark, path)
    assert sorted((r.path, r.part, r.found) for r in store.verify().where("not ok").collect()) == [("root.items", k, 0) for k in range(8, 12)]
    with pytest.raises(StoreFormatError):
        store.root().items.load()
    shutil.rmtree(folders[2])
    with pytest.raises(StoreFormatError):
        Store.open(spark, path).root().items.scan()


def test_verify_lists_no_shards_on_the_driver(spark, tmp_path, monkeypatch):
    store, made, create = Store.open(spark, _many_shards(spark, str(tmp_path / "m"), 2000, 5)), [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: made.append(len(data)) or create(self, data, *a, **k))
    checked = store.verify()
    assert checked.dtypes == [("path", "string"), ("part", "int"), ("expected", "bigint"), ("found", "bigint"), ("ok", "boolean")]
    assert checked.where("ok").count() == 800 and max(made) <= 1


def test_hooked_shards_share_files(spark, tmp_path):
    """A hook that deals rows out anew must not give every task a file in every folder."""
    seen, hooks = [], HookTable()
    order = W.partitionBy("shard").orderBy("pos")
    hooks.register("differences", lambda df: df.withColumns({"value": F.col("value") - F.lag("value", 1, 0).over(order), "shard": F.col("shard").cast("bigint")}), lambda df: seen.append(df.columns) or df.withColumn("value", F.sum("value").over(order)))
    path = _many_shards(spark, str(tmp_path / "h"), 3000, 10, hooks=hooks, hook_of={"root.keys": "differences"})
    keys = Store.open(spark, path, hooks=hooks).root().keys
    assert len(list((tmp_path / "h" / "root.keys").rglob("*.parquet"))) == 60
    assert [(r.pos, r.value) for r in keys.scan().orderBy("pos").collect()] == [(i, i * 7) for i in range(3000)] and keys.get(2999) == 20_993
    assert all(columns == ["pos", "value", "shard"] for columns in seen)  # what the hook had put out


def test_folders_of_shards():
    """One each while few, then few, then as many as the bytes ask for."""
    assert [layout.shards_per_folder(n, 1000) for n in (0, 1, 64, 65, 9000, 54_000, 10**6)] == [1, 1, 1, 2, 141, 262, 262]
    assert layout.shards_per_folder(10**6, 10**6) == 1


def test_keys_of_a_map_are_counted_once(spark, tmp_path):
    """Repeated keys and the sizes of buckets come from one job over the keys, of null and odd keys too."""
    frame = spark.range(5000).selectExpr("if(id = 0, null, if(id = 1, double('nan'), if(id = 2, -0.0, id / 7))) as k", "id as value")
    spark.sparkContext.setJobGroup("keys", "")
    save(spark, str(tmp_path / "k"), record("K", m=keyed_map("double", "bigint")), {"m": frame}, Options(buckets=4))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("keys"))
    spark.sparkContext.setJobGroup("", "")
    store = Store.open(spark, str(tmp_path / "k"))
    assert jobs <= 8 and sum(store.at["root.m"]["filled"].values()) == 5000 and store.verify().where("not ok").isEmpty()
    assert store.root().m.get(1.0) == 7 and store.root().m.get(0.0) == 2 and store.root().m.find(float("nan")).count() == 1
    for again in ("cast(null as double)", "double('nan')", "0.0"):
        with pytest.raises(StoreFormatError):
            save(spark, str(tmp_path / "l"), record("K", m=keyed_map("double", "bigint")), {"m": frame.union(spark.sql(f"select {again}, 1L"))}, Options(buckets=4))
