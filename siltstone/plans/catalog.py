"""The driver's queries: each goes through the promises of this library.

Most read the driver's tables as they are: a table is a vector ordered by its unique key, or a map by it; ``text`` of
documents is a heavy field. The ``store_`` queries first save a record of those tables and read the saved store.
"""

from __future__ import annotations

import atexit
import io
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import HookTable
from ..operators.lazy import ChildrenPromise, CollectionPromise, MapPromise
from ..sources.schema import chunk, inline, keyed_map, record, vector
from ..sources.shared import Files, shared_dir
from ..sources.store import Items, Options, Store, save, write

DOCUMENT = record("Document", doc_id=inline("bigint"), lang=inline("string"), source=inline("string"), n_chars=inline("bigint"), text=chunk("string"))
EVENT = record("Event", user_id=inline("bigint"), event_type=inline("string"), value=chunk("double"))
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str, columns: list[str] = ORDER_COLUMNS) -> CollectionPromise:
    return CollectionPromise.of(_table(spark, sf_dir, "orders").select(*columns), ["o_orderkey"])


def _documents(spark: SparkSession, sf_dir: str) -> CollectionPromise:
    return CollectionPromise(_table(spark, sf_dir, "documents"), DOCUMENT)


def _events(spark: SparkSession, sf_dir: str, *columns: str) -> MapPromise:
    return MapPromise.of(_table(spark, sf_dir, "events").select("event_id", *columns), "event_id")


def vec_load_primitive(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id")
    return CollectionPromise.of(events, ["event_id"]).items()


def vec_load_struct(spark, sf_dir):
    return _orders(spark, sf_dir, [*ORDER_COLUMNS, "o_orderstatus", "o_orderdate", "o_orderpriority"]).items()


def mirror_inline(spark, sf_dir):
    return _documents(spark, sf_dir).lazy()


def promise_load_one(spark, sf_dir):
    return _documents(spark, sf_dir).load_where("doc_id = 42", "text").select("doc_id", "text")


def vec_get(spark, sf_dir):
    return _orders(spark, sf_dir).at(7500)


def vec_get_many(spark, sf_dir):
    return _orders(spark, sf_dir).at(*range(0, 7500, 750))


def vec_len(spark, sf_dir):
    return CollectionPromise(_table(spark, sf_dir, "orders")).length()


def vec_is_empty(spark, sf_dir):
    return CollectionPromise(_table(spark, sf_dir, "orders")).length().select((F.col("len") == 0).alias("is_empty"))


def vec_first(spark, sf_dir):
    return _orders(spark, sf_dir).first_row().select("o_orderkey", "o_totalprice")


def vec_last(spark, sf_dir):
    return _orders(spark, sf_dir).last_row().select("o_orderkey", "o_totalprice")


def iter_order(spark, sf_dir):
    return _orders(spark, sf_dir, ["o_orderkey"]).ordered()


def iter_lazy_filter_load(spark, sf_dir):
    return _documents(spark, sf_dir).load_where("n_chars > 5000", "text").select("doc_id", "n_chars", "text")


def shard_assign(spark, sf_dir):
    return _orders(spark, sf_dir, ["o_orderkey"]).shards(1000).select("shard_idx", "local_idx", "o_orderkey")


def shard_rle(spark, sf_dir):
    return _orders(spark, sf_dir, ["o_orderkey"]).run_table(1009)


def map_load(spark, sf_dir):
    return _events(spark, sf_dir, "user_id", "event_type", "value").scan()


def map_get_hit(spark, sf_dir):
    return _events(spark, sf_dir, "user_id", "event_type", "value").find(4242)


def map_get_miss(spark, sf_dir):
    return _events(spark, sf_dir, "user_id", "event_type", "value").find(-1)


def map_get_many(spark, sf_dir):
    return _events(spark, sf_dir, "value").find(0, 2345, 4690, 7035, 9380)


def map_get_lazy(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), *EVENT.fields)
    return MapPromise(events, EVENT).find(50, heavy=False)


def map_num_shards(spark, sf_dir):
    return MapPromise.of(_table(spark, sf_dir, "events"), "event_id").num_shards()


def deep_path(spark, sf_dir):
    """region.nations[*].customers[20], the twenty-first customer of every nation, in key order."""
    regions = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    nations = ChildrenPromise(_table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").alias("c_nationkey"), "n_name"), ["n_regionkey"], ["c_nationkey"]).of(regions)
    customers = ChildrenPromise(_table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name"), ["c_nationkey"], ["c_custkey"])
    return nations.join(customers.at(20), "c_nationkey").select("r_name", "n_name", "c_custkey", "c_name")


def _embeddings(spark, sf_dir):
    return CollectionPromise(_table(spark, sf_dir, "embeddings"))


def nested_array_get(spark, sf_dir):
    c = _embeddings(spark, sf_dir)
    return c.items().select("vec_id", c.element("embedding", 3).alias("e3"))


def nested_array_len(spark, sf_dir):
    c = _embeddings(spark, sf_dir)
    return c.items().select("vec_id", c.element_count("embedding").alias("n"))


def nested_child_count(spark, sf_dir):
    orders = ChildrenPromise(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), ["c_custkey"], ["o_orderkey"])
    return orders.lengths(_table(spark, sf_dir, "customer")).withColumnRenamed("len", "n_orders")


def lazy_meta_sum(spark, sf_dir):
    return _documents(spark, sf_dir).lazy().where("doc_id in (1, 2)").agg(F.sum("n_chars").alias("s"))


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when this process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            Files(spark).delete(path)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass

    atexit.register(remove)
    return path


def roundtrip_diff(spark, sf_dir):
    """Save orders as a vector, open the store, and count the differences both ways."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    item = record("Order", o_orderkey=inline("bigint"), o_totalprice=chunk("double"))
    path = _folder(spark, "roundtrip")
    save(spark, path, record("Orders", orders=vector(item)), {"orders": Items(orders, ["o_orderkey"])})
    back = Store.open(spark, path).root().orders.scan().drop("pos")
    return orders.exceptAll(back).union(back.exceptAll(orders)).agg(F.count("*").alias("n_diff"))


# --- through a saved store ---

ORDER = record("Order", o_orderkey=inline("bigint"), o_custkey=inline("bigint"), o_totalprice=chunk("double"))
NATION = record("Nation", n_nationkey=inline("int"), n_name=chunk("string"))
REGION = record("Region", r_regionkey=inline("int"), r_name=inline("string"), nations=vector(NATION), by_key=keyed_map("int", "string"))
MARKET = record(
    "Market", title=inline("string"), version=inline("int"), orders=vector(ORDER, codec="zstd"), events=keyed_map("bigint", EVENT, codec="lz4"), documents=vector(DOCUMENT), keys=vector("bigint", codec="none"),
    regions=vector(REGION), config=chunk(record("Config", level=inline("int"), blob=chunk("string", codec="snappy"))), note=chunk("string"),
)
SHARD_ITEMS, BUCKETS = 1000, 8
_saved: dict[tuple[str, str], str] = {}


def _market(spark: SparkSession, sf_dir: str) -> Store:
    """A store of several tables, saved once for each session and folder, opened anew each time."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _saved:
        t = lambda name: _table(spark, sf_dir, name)
        nation = t("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(
            F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("by_key"))
        values = {
            "title": "market", "version": 3, "note": "a heavy note", "config": {"level": 7, "blob": "settings"},
            "orders": Items(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"]), "documents": Items(t("documents").select(*DOCUMENT.fields), ["doc_id"]),
            "keys": Items(t("events").select(F.col("event_id").alias("value")), ["value"]), "events": t("events").select(F.col("event_id").alias("k"), *EVENT.fields),
            "regions": Items(t("region").join(nation, "r_regionkey").select(*REGION.fields), ["r_regionkey"]),
        }
        path = _folder(spark, "market")
        save(spark, path, MARKET, values, Options(shard_items=SHARD_ITEMS, buckets=BUCKETS))
        _saved[at] = path
    return Store.open(spark, _saved[at])


def store_mirror(spark, sf_dir):
    """Inline fields of the root and of a nested record: the manifest alone is read."""
    root = _market(spark, sf_dir).root()
    return spark.createDataFrame([(root.title, root.version, root.config.level)], "title string, version int, level int")


def store_values(spark, sf_dir):
    root = _market(spark, sf_dir).root()
    return spark.createDataFrame([(root.note.load(), root.config.blob.load())], "note string, blob string")


def store_vec_load(spark, sf_dir):
    return _market(spark, sf_dir).root().orders.items()


def store_vec_get(spark, sf_dir):
    return _market(spark, sf_dir).root().orders.at(7500)


def store_vec_get_many(spark, sf_dir):
    return _market(spark, sf_dir).root().orders.at(3, 999, 1000, 1499)


def store_vec_len(spark, sf_dir):
    root = _market(spark, sf_dir).root()
    return spark.createDataFrame([(len(root.orders), len(root.events), root.orders.is_empty())], "orders long, events long, is_empty boolean")


def store_get_lazy(spark, sf_dir):
    """Inline fields of one item, then its heavy field."""
    item = _market(spark, sf_dir).root().orders.get_lazy(1234)
    return spark.createDataFrame([(item.o_orderkey, item.o_custkey, item.o_totalprice.load())], "o_orderkey long, o_custkey long, o_totalprice double")


def store_ends(spark, sf_dir):
    orders = _market(spark, sf_dir).root().orders
    return orders.first_row().unionByName(orders.last_row())


def store_slice(spark, sf_dir):
    return _market(spark, sf_dir).root().orders.slice(990, 1010)


def store_iter(spark, sf_dir):
    """Pulled in order from a vector of primitives."""
    from itertools import islice

    return spark.createDataFrame([(i, v) for i, v in enumerate(islice(_market(spark, sf_dir).root().keys.iter(), 50))], "i long, event_id long")


def store_iter_lazy(spark, sf_dir):
    """Mirrors in order, with nested inline fields at hand; a heavy one is loaded."""
    it = _market(spark, sf_dir).root().regions.iter_lazy()
    return spark.createDataFrame([(left, m.r_name, m.by_key.get(m.r_regionkey)) for left, m in ((len(it), m) for m in it)], "left_over long, r_name string, own string")


def store_filter_load(spark, sf_dir):
    return _market(spark, sf_dir).root().documents.load_where("n_chars > 5000", "text").select("doc_id", "n_chars", "text")


def store_semi_load(spark, sf_dir):
    docs = _market(spark, sf_dir).root().documents
    return docs.semi_load(docs.lazy().where("doc_id % 50 = 7"), "text").select("pos", "text")


def store_map_get(spark, sf_dir):
    return _market(spark, sf_dir).root().events.find(42, 512)


def store_map_miss(spark, sf_dir):
    return _market(spark, sf_dir).root().events.find(-1)


def store_map_lazy(spark, sf_dir):
    value = _market(spark, sf_dir).root().events.get_lazy(50)
    return spark.createDataFrame([(value.user_id, value.event_type, value.value.load())], "user_id long, event_type string, value double")


def store_map_load(spark, sf_dir):
    return _market(spark, sf_dir).root().events.scan()


def store_deep_path(spark, sf_dir):
    """root.regions[2].nations[1].n_name and root.regions[2].by_key[key]."""
    region = _market(spark, sf_dir).root().regions.get_lazy(2)
    nation = region.nations.get_lazy(1)
    name = nation.n_name.load()
    return spark.createDataFrame([(region.r_name, nation.n_nationkey, name, region.by_key.get(nation.n_nationkey) == name)], "r_name string, n_nationkey int, n_name string, same boolean")


def store_inspect(spark, sf_dir):
    return _market(spark, sf_dir).inspect().select("path", "kind", "codec_id", "child_count", "item_count", "num_buckets")


def store_runs(spark, sf_dir):
    """The run-length table of shard sizes, from the manifest."""
    store = _market(spark, sf_dir)
    return spark.createDataFrame([(int(n), int(k)) for n, k in store.at["root.orders"]["runs"]], "item_count long, repeat_n long")


def store_verify(spark, sf_dir):
    return _market(spark, sf_dir).verify().where("path in ('root.orders', 'root.documents', 'root.keys')").select("path", "part", "expected", "found", "ok")


def store_decode(spark, sf_dir):
    """A table as a type of the caller's own: fewer fields, wider numbers."""
    return _market(spark, sf_dir).decode("root.orders", "o_orderkey decimal(20,0), o_totalprice double")


def store_payload(spark, sf_dir):
    """Raw files of a node: all there, and as long as the node says."""
    store = _market(spark, sf_dir)
    n = store.extent(store.at["root.orders"])["payload_length"]
    return store.payload("root.orders").agg((F.sum("length") == F.sum(F.octet_length("content"))).alias("whole"), (F.sum("length") <= F.lit(n)).alias("within"))


def store_bytes(spark, sf_dir):
    """A record as bytes and back, through a writer."""
    out = io.BytesIO()
    item = record("Region", r_regionkey=inline("int"), r_name=chunk("string"))
    write(spark, out, record("Regions", regions=vector(item)), {"regions": Items(_table(spark, sf_dir, "region").select("r_regionkey", "r_name"), ["r_regionkey"])})
    return Store.open_bytes(spark, out.getvalue()).root().regions.scan()


def store_codecs(spark, sf_dir):
    """The same vector under every codec."""
    rows = Items(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("value")), ["value"])
    names = ["none", "lz4", "zstd", "snappy"]
    path = _folder(spark, "codecs")
    save(spark, path, record("C", **{n: vector("bigint", codec=n) for n in names}), {n: rows for n in names})
    root, store = Store.open(spark, path).root(), Store.open(spark, path)
    each = [getattr(root, n).scan().select(F.lit(n).alias("codec"), F.lit(store.at[f"root.{n}"]["codec_id"]).alias("codec_id"), "pos", "value") for n in names]
    return each[0].union(each[1]).union(each[2]).union(each[3])


def store_hooks(spark, sf_dir):
    """An encoder of one's own: differences are written, running sums are read."""
    from pyspark.sql import Window as W

    hooks, order = HookTable(), W.partitionBy("shard").orderBy("pos")
    hooks.register("differences", lambda df: df.withColumn("value", F.col("value") - F.lag("value", 1, 0).over(order)), lambda df: df.withColumn("value", F.sum("value").over(order)))
    path = _folder(spark, "hooks")
    rows = Items(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("value")), ["value"])
    save(spark, path, record("H", keys=vector("bigint")), {"keys": rows}, Options(shard_items=500, hook_of={"root.keys": "differences"}, hooks=hooks))
    return Store.open(spark, path, hooks=hooks).root().keys.scan()


def slice_range(spark, sf_dir):
    return _orders(spark, sf_dir).slice(20, 50)


def slice_clamped(spark, sf_dir):
    return _orders(spark, sf_dir).slice(14990, 15090)


_P = "(SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, o_orderkey, o_custkey, o_totalprice FROM orders) p"
_EVENT = "SELECT event_id AS k, user_id, event_type, value FROM events"

ORACLES = {
    "vec_load_primitive": "SELECT event_id FROM events",
    "vec_load_struct": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders",
    "mirror_inline": "SELECT doc_id, lang, source, n_chars FROM documents",
    "promise_load_one": "SELECT doc_id, text FROM documents WHERE doc_id = 42",
    "vec_get": f"SELECT * FROM {_P} WHERE pos = 7500",
    "vec_get_many": f"SELECT * FROM {_P} WHERE pos % 750 = 0 AND pos < 7500",
    "vec_len": "SELECT CAST(count(*) AS BIGINT) AS len FROM orders",
    "vec_is_empty": "SELECT count(*) = 0 AS is_empty FROM orders",
    "vec_first": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1",
    "vec_last": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 1",
    "iter_order": f"SELECT pos, o_orderkey FROM {_P}",
    "iter_lazy_filter_load": "SELECT doc_id, n_chars, text FROM documents WHERE n_chars > 5000",
    "shard_assign": f"SELECT CAST(floor(pos / 1000) AS BIGINT) AS shard_idx, pos % 1000 AS local_idx, o_orderkey FROM {_P}",
    "shard_rle": f"SELECT item_count, CAST(count(*) AS BIGINT) AS repeat_n FROM (SELECT CAST(floor(pos / 1009) AS BIGINT) AS sh, CAST(count(*) AS BIGINT) AS item_count FROM {_P} GROUP BY 1) t GROUP BY item_count",
    "map_load": _EVENT,
    "map_get_hit": f"{_EVENT} WHERE event_id = 4242",
    "map_get_miss": f"{_EVENT} WHERE event_id = -1",
    "map_get_many": "SELECT event_id AS k, value FROM events WHERE event_id IN (0, 2345, 4690, 7035, 9380)",
    "map_get_lazy": "SELECT event_id AS k, user_id, event_type FROM events WHERE event_id = 50",
    "map_num_shards": "SELECT CAST(CASE WHEN count(*) = 0 THEN 0 ELSE greatest(1, least(1024, floor(count(*) / 2000))) END AS BIGINT) AS num_shards FROM events",
    "deep_path": "SELECT r_name, n_name, c_custkey, c_name FROM (SELECT r_name, n_name, c_custkey, c_name, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) - 1 AS cpos FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey) t WHERE cpos = 20",
    "nested_array_get": "SELECT vec_id, embedding[4] AS e3 FROM embeddings",
    "nested_array_len": "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n FROM embeddings",
    "nested_child_count": "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "lazy_meta_sum": "SELECT CAST(sum(n_chars) AS BIGINT) AS s FROM documents WHERE doc_id IN (1, 2)",
    "roundtrip_diff": "SELECT CAST(count(*) AS BIGINT) AS n_diff FROM (SELECT o_orderkey FROM orders EXCEPT SELECT o_orderkey FROM orders) t",
    "store_mirror": "SELECT 'market' AS title, 3 AS version, 7 AS level",
    "store_values": "SELECT 'a heavy note' AS note, 'settings' AS blob",
    "store_vec_load": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "store_vec_get": f"SELECT *, CAST(7500 // 1000 AS INT) AS shard FROM {_P} WHERE pos = 7500",
    "store_vec_get_many": f"SELECT *, CAST(pos // 1000 AS INT) AS shard FROM {_P} WHERE pos IN (3, 999, 1000, 1499)",
    "store_vec_len": "SELECT (SELECT CAST(count(*) AS BIGINT) FROM orders) AS orders, (SELECT CAST(count(*) AS BIGINT) FROM events) AS events, (SELECT count(*) = 0 FROM orders) AS is_empty",
    "store_get_lazy": f"SELECT o_orderkey, o_custkey, o_totalprice FROM {_P} WHERE pos = 1234",
    "store_ends": f"SELECT o_orderkey, o_custkey, o_totalprice FROM {_P} WHERE pos = 0 OR pos = (SELECT count(*) - 1 FROM orders)",
    "store_slice": f"SELECT * FROM {_P} WHERE pos >= 990 AND pos < 1010",
    "store_iter": "SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS i, event_id FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 50) t",
    "store_iter_lazy": "SELECT CAST(4 - (row_number() OVER (ORDER BY r_regionkey) - 1) AS BIGINT) AS left_over, r_name, (SELECT n_name FROM nation WHERE n_nationkey = r_regionkey AND n_regionkey = r_regionkey) AS own FROM region",
    "store_filter_load": "SELECT doc_id, n_chars, text FROM documents WHERE n_chars > 5000",
    "store_semi_load": "SELECT pos, text FROM (SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS pos, doc_id, text FROM documents) t WHERE doc_id % 50 = 7",
    "store_map_get": f"{_EVENT} WHERE event_id IN (42, 512)",
    "store_map_miss": f"{_EVENT} WHERE event_id = -1",
    "store_map_lazy": "SELECT user_id, event_type, value FROM events WHERE event_id = 50",
    "store_map_load": _EVENT,
    "store_deep_path": "SELECT r_name, n_nationkey, n_name, true AS same FROM (SELECT r_regionkey, r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS rpos FROM region) r JOIN (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS npos FROM nation) n ON n_regionkey = r_regionkey WHERE rpos = 2 AND npos = 1",
    "store_inspect": """SELECT path, kind, CAST(codec_id AS INT) AS codec_id, CAST(child_count AS INT) AS child_count, CAST(item_count AS BIGINT) AS item_count, CAST(num_buckets AS INT) AS num_buckets FROM (VALUES
        ('root', 'record', 0, 7, NULL, NULL), ('root.orders', 'vector', 2, 0, (SELECT count(*) FROM orders), NULL), ('root.events', 'map', 1, 0, (SELECT count(*) FROM events), 8),
        ('root.documents', 'vector', 0, 0, (SELECT count(*) FROM documents), NULL), ('root.keys', 'vector', 0, 0, (SELECT count(*) FROM events), NULL), ('root.regions', 'vector', 0, 0, (SELECT count(*) FROM region), NULL),
        ('root.config', 'record', 0, 1, NULL, NULL), ('root.config.blob', 'value', 3, 0, 1, NULL), ('root.note', 'value', 0, 0, 1, NULL)) t(path, kind, codec_id, child_count, item_count, num_buckets)""",
    "store_runs": "SELECT item_count, CAST(count(*) AS BIGINT) AS repeat_n FROM (SELECT CAST(least(1000, n - 1000 * s) AS BIGINT) AS item_count FROM (SELECT n, unnest(range(0, (n + 999) // 1000)) AS s FROM (SELECT count(*) AS n FROM orders) a) b) c GROUP BY item_count",
    "store_verify": "SELECT path, CAST(s AS INT) AS part, CAST(least(1000, n - 1000 * s) AS BIGINT) AS expected, CAST(least(1000, n - 1000 * s) AS BIGINT) AS found, true AS ok FROM (SELECT path, n, unnest(range(0, (n + 999) // 1000)) AS s FROM (SELECT 'root.orders' AS path, count(*) AS n FROM orders UNION ALL SELECT 'root.documents', count(*) FROM documents UNION ALL SELECT 'root.keys', count(*) FROM events) a) b",
    "store_decode": "SELECT CAST(o_orderkey AS DECIMAL(20,0)) AS o_orderkey, o_totalprice FROM orders",
    "store_payload": "SELECT true AS whole, true AS within",
    "store_bytes": "SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS BIGINT) AS pos, r_regionkey, r_name FROM region",
    "store_codecs": "SELECT codec, CAST(codec_id AS INT) AS codec_id, pos, value FROM (VALUES ('none', 0), ('lz4', 1), ('zstd', 2), ('snappy', 3)) c(codec, codec_id) CROSS JOIN (SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS pos, CAST(n_nationkey AS BIGINT) AS value FROM nation) n",
    "store_hooks": "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, o_orderkey AS value FROM orders",
    "slice_range": f"SELECT * FROM {_P} WHERE pos >= 20 AND pos < 50",
    "slice_clamped": f"SELECT * FROM {_P} WHERE pos >= 14990 AND pos < 15090",
}

QUERIES = {name: globals()[name] for name in ORACLES}
