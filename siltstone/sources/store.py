"""The store: a folder with a manifest and one Parquet table for each vector, map and heavy value.

The manifest is written last and is the commit mark. Saving builds a new folder beside the old one and swaps the two by
renaming; if the second renaming fails the first is undone, and if the process ends between them, ``Store.open`` finds
the old folder and puts it back.
"""

from __future__ import annotations

import base64
import io
import json
import uuid
import zipfile
from collections.abc import Collection
from dataclasses import dataclass, field, replace
from functools import partial
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StoreCodecError, StoreDecodeError, StoreError, StoreFormatError, StoreInternalError, StoreIOError
from ..functions import layout
from ..functions.codec import CodecTable, HookTable
from ..operators.lazy import BUCKET, FOLDER, KEY, POS, SHARD, CollectionPromise, MapPromise, RecordMirror, ValuePromise
from ..operators.lazy import VALUE as VALUE_COLUMN
from ..operators.positions import with_positions
from .schema import INLINE, MAP, RECORD, VALUE, VECTOR, Field, Record, from_json, to_json
from .shared import Files, checkpoint

MAGIC, VERSION, MANIFEST = "SILT", 4, "manifest.json"
MOST_BYTES = 1 << 30  # of a record that is serialised on the driver
PAGE_ROWS = 20_000  # Parquet's own limit


@dataclass(frozen=True)
class Items:
    """A vector's items: any frame and its total order."""

    df: DataFrame
    order_by: list[str | Column]


@dataclass
class Options:
    """How a store is written. ``compression`` is the default of fields that name no codec."""

    compression: str | None = None
    parallel: bool = True
    shard_items: int | None = None
    buckets: int | None = None
    codecs: CodecTable = field(default_factory=CodecTable)
    hook_of: dict[str, str] = field(default_factory=dict)  # path of a table -> name of a hook
    hooks: HookTable = field(default_factory=HookTable)


def _pack(value: Any) -> Any:
    return {"b64": base64.b64encode(bytes(value)).decode()} if isinstance(value, (bytes, bytearray)) else value


def _unpack(value: Any) -> Any:
    return base64.b64decode(value["b64"]) if isinstance(value, dict) and set(value) == {"b64"} else value


class _Plan:
    """The tables of a record, not yet written."""

    def __init__(self, spark: SparkSession, options: Options):
        self.spark, self.options = spark, options
        self.nodes: list[dict] = []
        self.frames: dict[int, DataFrame] = {}

    def add(self, spec: Record, values: dict[str, Any], parent: int | None = None, ordinal: int = 0, path: str = "root", codec: str | None = None) -> int:
        missing = [n for n in spec.fields if n not in values]
        if missing:
            raise StoreFormatError(f"{spec.name}: no value for {', '.join(missing)}")
        me = self.node(parent, ordinal, path, RECORD, codec, inline={n: _pack(values[n]) for n in spec.inline()})
        for k, name in enumerate(spec.heavy()):
            f = spec.fields[name]
            where = f"{path}.{name}"
            if f.kind == RECORD:
                self.add(f.type, values[name], me, k, where, f.codec)
            elif f.kind == VALUE:
                df = self.spark.createDataFrame([(values[name],)], f"{VALUE_COLUMN} {f.spark_type().simpleString()}")
                self.keep(self.node(me, k, where, VALUE, f.codec, item_count=1), df)
            elif f.kind == VECTOR:
                self.vector(f, values[name], me, k, where)
            else:
                self.map(f, values[name], me, k, where)
        return me

    def node(self, parent: int | None, ordinal: int, path: str, kind: str, codec: str | None, **more: Any) -> int:
        codec_id, parquet = self.options.codecs.resolve(codec, self.options.compression)
        self.nodes.append({"node_id": len(self.nodes), "parent_id": parent, "ordinal": ordinal, "path": path, "kind": kind, "codec_id": codec_id, "parquet": parquet, **more})
        return len(self.nodes) - 1

    def keep(self, k: int, df: DataFrame, cut: str | None = None) -> None:
        """A node's frame as it is to be written, its hook applied; ``cut`` names the partition column."""
        node = self.nodes[k]
        hook = self.options.hook_of.get(node["path"])
        if hook:
            df, node["hook"] = self.options.hooks.get(hook)[0](df), hook
            if cut and cut not in df.columns:
                raise StoreFormatError(f"{node['path']}: hook {hook!r} has to keep {cut}")
        node["schema"] = T.StructType([x for x in df.schema if x.name != cut]).json()
        if node["kind"] == VECTOR and FOLDER not in df.columns:
            shards = sum(repeat for _, repeat in node["runs"])
            node["folder_shards"] = layout.shards_per_folder(shards, node["shard_items"])
        self.frames[k] = df

    def vector(self, f: Field, value: Any, me: int, k: int, where: str) -> None:
        if isinstance(value, Items):
            names = value.df.columns
            ordered = with_positions(value.df, value.order_by)
            if not isinstance(f.type, Record) and names != [VALUE_COLUMN]:
                raise StoreDecodeError(f"{where}: a vector of {f.type} has the one column {VALUE_COLUMN}")
        else:
            rows = [(i, *self._cells(f, v)) for i, v in enumerate(value)]
            ordered = self.spark.createDataFrame(rows, self._schema(f, f"{POS} bigint"))
        n = ordered.count()
        size = self.options.shard_items or max(1, layout.items_per_shard(n, 256, target=layout.FILE_BYTES))
        df = ordered.withColumn(SHARD, F.floor(F.col(POS) / size).cast("int"))
        self.keep(self.node(me, k, where, VECTOR, f.codec, item_count=n, shard_items=size, runs=layout.runs(n, size)), df, SHARD)

    def map(self, f: Field, value: Any, me: int, k: int, where: str) -> None:
        if isinstance(value, DataFrame):
            df = checkpoint(value)  # counted, checked and written: an unstable input must not differ between them
            if KEY not in df.columns:
                raise StoreDecodeError(f"{where}: a map has a key column {KEY}")
        else:
            key = Field(INLINE, f.key).spark_type().simpleString()
            df = self.spark.createDataFrame([(a, *self._cells(f, b)) for a, b in value.items()], self._schema(f, f"{KEY} {key}"))
        n = df.count()
        buckets = self.options.buckets if self.options.buckets and n else layout.num_buckets(n)
        keys = df.groupBy(KEY).agg(F.count("*").alias("_n"))
        found = keys.groupBy(layout.bucket(F.col(KEY), buckets).alias(BUCKET)).agg(F.count("*").alias("n"), F.max("_n").alias("most")).collect()  # MOST_BUCKETS rows at most
        if any(r["most"] > 1 for r in found):
            raise StoreFormatError(f"{where}: a key occurs more than once")
        filled = {str(r[BUCKET]): r["n"] for r in found}
        df = df.withColumn(BUCKET, layout.bucket(F.col(KEY), buckets))
        self.keep(self.node(me, k, where, MAP, f.codec, item_count=n, num_buckets=buckets, filled=filled), df, BUCKET)

    def _cells(self, f: Field, v: Any) -> tuple:
        return tuple(v[n] for n in f.type.fields) if isinstance(f.type, Record) else (v,)

    def _schema(self, f: Field, first: str) -> str:
        inner = f.spark_type()
        rest = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in inner) if isinstance(f.type, Record) else f"{VALUE_COLUMN} {inner.simpleString()}"
        return f"{first}, {rest}"


def _cut(node: dict) -> str | None:
    """The partition column of a node's table."""
    return {VECTOR: FOLDER if node.get("folder_shards", 1) > 1 else SHARD, MAP: BUCKET}.get(node["kind"])


def _folders(node: dict) -> Collection[int | str]:
    """The values of the partition column, by the manifest."""
    if node["kind"] == MAP:
        return node["filled"]
    return range(-(-sum(repeat for _, repeat in node["runs"]) // node.get("folder_shards", 1)))


def manifest_of(spec: Record, nodes: list[dict]) -> dict:
    return {"magic": MAGIC, "format_version": VERSION, "schema": to_json(spec), "nodes": nodes}


def save(spark: SparkSession, path: str, spec: Record, values: dict[str, Any], options: Options | None = None) -> None:
    """Write a record; replaces what is at ``path``."""
    options = options or Options()
    plan, files = _Plan(spark, options), Files(spark)
    plan.add(spec, values)
    new = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    try:
        for k, df in plan.frames.items():
            node = plan.nodes[k]
            if not options.parallel:
                df = df.coalesce(1)
            elif node["kind"] == MAP and node["num_buckets"]:
                df = df.repartition(node["num_buckets"], BUCKET)
            cut = _cut(node)
            if cut == FOLDER:
                df = df.withColumn(SHARD, F.col(SHARD).cast("int")).withColumn(FOLDER, F.floor(F.col(SHARD) / node["folder_shards"]).cast("int"))
                if options.parallel and "hook" in node:  # its rows may lie anywhere now: one task and file for each folder
                    df = df.repartitionById(len(_folders(node)), FOLDER)
            order = [c for c in {MAP: [BUCKET, KEY], VECTOR: [cut, POS]}.get(node["kind"], []) if c in df.columns]
            if order:
                df = df.sortWithinPartitions(*order)
            writer = df.write.option("compression", node["parquet"])
            if cut == FOLDER:
                writer = writer.option("parquet.page.row.count.limit", min(node["shard_items"], PAGE_ROWS))  # a point read is to skip other shards
            (writer.partitionBy(cut) if cut else writer).parquet(f"{new}/{node['path']}")
        files.write(f"{new}/{MANIFEST}", json.dumps(manifest_of(spec, plan.nodes)).encode())
    except BaseException:
        files.delete(new)
        raise
    swap(files, new, path.rstrip("/"))


def swap(files: Files, new: str, path: str) -> None:
    """Put ``new`` in the place of ``path``; what was there comes back if that fails."""
    old = f"{path}.old-{uuid.uuid4().hex}"
    had = files.exists(path)
    if had:
        files.rename(path, old)
    try:
        files.rename(new, path)
    except BaseException:
        if had:
            files.rename(old, path)
        files.delete(new)
        raise
    if had:
        files.delete(old)


def recover(files: Files, path: str) -> None:
    """Put an old folder back that a save which ended between its two renamings has left."""
    above, _, name = path.rpartition("/")
    if files.exists(path) or not above:
        return
    for found in sorted(files.names(above)):
        if found.startswith(f"{name}.old-") and files.exists(f"{above}/{found}/{MANIFEST}"):
            files.rename(f"{above}/{found}", path)
            return


def save_sync(spark: SparkSession, path: str, spec: Record, values: dict[str, Any], options: Options | None = None) -> None:
    """The same with one task for each table."""
    options = options or Options()
    save(spark, path, spec, values, replace(options, parallel=False))


def serialize(spark: SparkSession, spec: Record, values: dict[str, Any], options: Options | None = None) -> bytes:
    """A small record as bytes: the manifest and an Arrow stream for each table. Everything passes the driver, so tables of
    more than ``MOST_BYTES`` in all are refused."""
    plan = _Plan(spark, options or Options())
    plan.add(spec, values)
    out, held = io.BytesIO(), 0
    with zipfile.ZipFile(out, "w") as z:
        for k, df in plan.frames.items():
            table, sink = df.toArrow(), io.BytesIO()
            held += table.nbytes
            if held > MOST_BYTES:
                raise StoreFormatError(f"more than {MOST_BYTES} bytes: save it to a path instead")
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            z.writestr(f"{k}.arrow", sink.getvalue())
        z.writestr(MANIFEST, json.dumps(manifest_of(spec, plan.nodes)))
    return out.getvalue()


def write(spark: SparkSession, writer: BinaryIO, spec: Record, values: dict[str, Any], options: Options | None = None) -> None:
    """``serialize`` into anything with ``write``."""
    writer.write(serialize(spark, spec, values, options))


write_sync = write


class Builder:
    """Options step by step."""

    def __init__(self) -> None:
        self.options = Options()

    def compression(self, on: bool | str) -> Builder:
        self.options.compression = on if isinstance(on, str) else "lz4" if on else None
        return self

    def shard_items(self, n: int) -> Builder:
        self.options.shard_items = n
        return self

    def buckets(self, n: int) -> Builder:
        self.options.buckets = n
        return self

    def save(self, spark: SparkSession, path: str, spec: Record, values: dict[str, Any]) -> None:
        save(spark, path, spec, values, self.options)

    def save_sync(self, spark: SparkSession, path: str, spec: Record, values: dict[str, Any]) -> None:
        save_sync(spark, path, spec, values, self.options)

    def write(self, spark: SparkSession, writer: BinaryIO, spec: Record, values: dict[str, Any]) -> None:
        write(spark, writer, spec, values, self.options)

    write_sync = write


class Store:
    """An open store; opening reads the manifest alone."""

    def __init__(self, spark: SparkSession, manifest: dict, tables: dict[int, DataFrame] | None, path: str | None, codecs: CodecTable | None = None, hooks: HookTable | None = None):
        self.spark, self.path, self._tables, self.hooks = spark, path, tables, hooks or HookTable()
        if not isinstance(manifest, dict) or manifest.get("magic") != MAGIC:
            raise StoreFormatError("the magic word is wrong")
        if manifest.get("format_version") != VERSION:
            raise StoreFormatError(f"format version {manifest.get('format_version')} is not {VERSION}")
        try:
            self.spec, self.nodes = from_json(manifest["schema"]), manifest["nodes"]
            self.at = {n["path"]: n for n in self.nodes}
            self.at["root"]
        except (KeyError, TypeError) as e:
            raise StoreFormatError(f"the manifest is incomplete: {e}") from e
        for n in self.nodes:
            (codecs or CodecTable()).get(n["codec_id"])
            if "hook" in n:
                self.hooks.get(n["hook"])

    @classmethod
    def open(cls, spark: SparkSession, path: str, codecs: CodecTable | None = None, hooks: HookTable | None = None) -> Store:
        recover(Files(spark), path.rstrip("/"))
        raw = Files(spark).read(f"{path.rstrip('/')}/{MANIFEST}")
        if not raw:
            raise StoreFormatError("the manifest is empty")
        try:
            manifest = json.loads(raw)
        except ValueError as e:
            raise StoreFormatError(f"the magic word is wrong: {e}") from e
        return cls(spark, manifest, None, path.rstrip("/"), codecs, hooks)

    @classmethod
    def open_bytes(cls, spark: SparkSession, data: bytes, codecs: CodecTable | None = None, hooks: HookTable | None = None) -> Store:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                manifest = json.loads(z.read(MANIFEST))
                tables = {}
                for n in manifest["nodes"]:
                    if f"{n['node_id']}.arrow" in z.namelist():
                        tables[n["node_id"]] = spark.createDataFrame(pa.ipc.open_stream(z.read(f"{n['node_id']}.arrow")).read_all())
        except (zipfile.BadZipFile, KeyError, ValueError, pa.ArrowInvalid) as e:
            raise StoreFormatError(f"no store: {e}") from e
        return cls(spark, manifest, tables, None, codecs, hooks)

    # --- the record ---

    def table(self, node: dict) -> DataFrame:
        """The plan of a node's table: no data is read yet, but its folder is held against the manifest."""
        df = self._tables[node["node_id"]] if self._tables is not None else self._files_of(node)
        return self.hooks.get(node["hook"])[1](df.drop(FOLDER) if _cut(node) == FOLDER else df) if "hook" in node else df

    def _files_of(self, node: dict) -> DataFrame:
        cut = _cut(node)
        schema = T.StructType.fromJson(json.loads(node["schema"]))
        for column in (SHARD, FOLDER) if cut == FOLDER else (cut,) if cut else ():
            schema = schema.add(column, T.IntegerType())
        if not node["item_count"]:
            return self.spark.createDataFrame([], schema)
        where = f"{self.path}/{node['path']}"
        found = set(Files(self.spark).names(where))
        missing = [x for x in _folders(node) if f"{cut}={x}" not in found] if cut else [] if found else [node["path"]]
        if missing:
            raise StoreFormatError(f"{node['path']}: {len(missing)} parts are missing, {missing[0]} the first")
        return self.spark.read.schema(schema).parquet(where)

    def _expected(self, node: dict) -> DataFrame:
        """part, expected: rows of each shard or bucket that has any, by the manifest; shards are not listed on the driver."""
        if node["kind"] != VECTOR:
            return self.spark.createDataFrame([(int(k), n) for k, n in node.get("filled", {"0": 1}).items()], "part int, expected long")
        out, first = self.spark.createDataFrame([], "part int, expected long"), 0
        for items, repeat in node["runs"]:
            run = self.spark.range(first, first + repeat).select(F.col("id").cast("int").alias("part"), F.lit(items).cast("long").alias("expected"))
            out, first = out.union(run) if first else run, first + repeat
        return out

    def verify(self) -> DataFrame:
        """path, part, expected, found, ok: the rows of every shard, bucket and value against the manifest."""
        out = None
        for node in self.nodes:
            if "inline" in node:
                continue
            cut = {VECTOR: SHARD, MAP: BUCKET}.get(node["kind"])
            expected = self._expected(node)
            df = self._tables[node["node_id"]] if self._tables is not None else self._files_of(node)
            counted = df.groupBy((F.col(cut) if cut else F.lit(0)).cast("int").alias("part")).agg(F.count("*").alias("found"))
            both = expected.join(counted, "part", "full").select(F.lit(node["path"]).alias("path"), "part", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
            out = both if out is None else out.unionByName(both)
        if out is None:
            return self.spark.createDataFrame([], "path string, part int, expected long, found long, ok boolean")
        return out.withColumn("ok", F.col("expected") == F.col("found"))

    def decode(self, path: str, kind: str | T.DataType) -> DataFrame:
        """The table at a path as columns of a type of the caller's own; raises where a field has no such column or type.

        ``kind`` is a struct, or one type for the ``value`` column.
        """
        df = self.df(path)
        kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
        want = kind if isinstance(kind, T.StructType) else T.StructType([T.StructField(VALUE_COLUMN, kind)])
        out = []
        for f in want:
            if f.name not in df.columns:
                raise StoreDecodeError(f"{path} has no field {f.name}")
            have = df.schema[f.name].dataType
            if have != f.dataType and not (isinstance(have, T.NumericType) and isinstance(f.dataType, T.NumericType)):
                raise StoreDecodeError(f"{path}.{f.name} is {have.simpleString()}, not {f.dataType.simpleString()}")
            out.append(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name))
        return df.select(*out)

    def root(self) -> RecordMirror:
        return self._mirror(self.spec, "root")

    load_lazy = read_lazy = root

    def _mirror(self, spec: Record, path: str) -> RecordMirror:
        node, promises = self.at[path], {}
        for name in spec.heavy():
            f, below = spec.fields[name], f"{path}.{name}"
            if below not in self.at:
                raise StoreFormatError(f"no node for {below}")
            child = self.at[below]
            inner = f.type if isinstance(f.type, Record) else None
            if f.kind == RECORD:
                promises[name] = self._mirror(f.type, below)
            elif f.kind == VECTOR:
                promises[name] = CollectionPromise(partial(self.table, child), inner, child["item_count"], child["shard_items"], folder_shards=child.get("folder_shards", 1))
            elif f.kind == MAP:
                promises[name] = MapPromise(partial(self.table, child), inner, child["num_buckets"], child["item_count"])
            elif f.kind != VALUE:
                raise StoreInternalError(f"{below} is of no known kind")
            else:
                promises[name] = ValuePromise(lambda child=child: self.table(child).select(VALUE_COLUMN))
        return RecordMirror(spec, {n: _unpack(node["inline"].get(n)) for n in spec.inline()}, promises)

    def load(self) -> dict[str, Any]:
        """Everything, on the driver."""
        return self.root().load()

    def df(self, path: str) -> DataFrame:
        """The table at a path such as ``root.users``: the eager load of a large field."""
        if path not in self.at or "inline" in self.at[path]:
            raise StoreFormatError(f"no table at {path}")
        df = self.table(self.at[path])
        return df.drop(FOLDER) if _cut(self.at[path]) == FOLDER else df

    # --- nodes ---

    def root_node(self) -> dict:
        return self.at["root"]

    def children(self, node: dict) -> list[dict]:
        return sorted((n for n in self.nodes if n["parent_id"] == node["node_id"]), key=lambda n: n["ordinal"])

    def child(self, node: dict, i: int) -> dict:
        found = self.children(node)
        if not 0 <= i < len(found):
            raise StoreFormatError(f"child {i} is out of range")
        return found[i]

    def payload(self, path: str) -> DataFrame:
        """The files of a node as they lie there: path, length and content."""
        if self.path is None or path not in self.at or "inline" in self.at[path]:
            raise StoreFormatError(f"no files at {path}")
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.path}/{path}").select("path", "length", "content")

    def extent(self, node: dict) -> dict[str, int]:
        """Bytes of a node with all below it, of its own table, and the number of its children."""
        below = [n for n in self.nodes if n["path"] == node["path"] or n["path"].startswith(f"{node['path']}.")]
        own = lambda n: Files(self.spark).size(f"{self.path}/{n['path']}") if self.path and "inline" not in n else 0
        return {"length": sum(map(own, below)), "payload_length": own(node), "child_count": len(self.children(node))}

    def size(self) -> int:
        """Bytes of all files."""
        if self.path is None:
            raise StoreIOError("a store in memory has no files")
        return Files(self.spark).size(self.path)

    def inspect(self) -> DataFrame:
        """A row for each node; kinds are stated, not guessed."""
        counts: dict[int, int] = {}
        for n in self.nodes:
            counts[n["parent_id"]] = counts.get(n["parent_id"], 0) + 1
        files = Files(self.spark) if self.path else None
        rows = []
        for n in self.nodes:
            size = files.size(f"{self.path}/{n['path']}") if files and "inline" not in n else len(json.dumps(n.get("inline", {}))) if "inline" in n else None
            rows.append((n["node_id"], n["parent_id"], n["ordinal"], n["path"], n["kind"], n["codec_id"], size, counts.get(n["node_id"], 0), n.get("item_count"), n.get("shard_items"), n.get("num_buckets"), json.dumps(n.get("runs"))))
        return self.spark.createDataFrame(rows, "node_id int, parent_id int, ordinal int, path string, kind string, codec_id int, bytes long, child_count int, item_count long, shard_items long, num_buckets int, runs string")

    def report(self) -> str:
        """The tree as text."""
        info = {r.node_id: r for r in self.inspect().collect()}
        lines: list[str] = []

        def walk(node: dict, depth: int) -> None:
            r = info[node["node_id"]]
            extra = "".join(f", {k} {getattr(r, k)}" for k in ("item_count", "shard_items", "num_buckets") if getattr(r, k) is not None)
            lines.append(f"{'  ' * depth}{node['path'].rsplit('.', 1)[-1]}: {r.kind}, {r.bytes} bytes, codec {r.codec_id}{extra}")
            for c in self.children(node):
                walk(c, depth + 1)

        walk(self.root_node(), 0)
        return "\n".join(lines)


def load(spark: SparkSession, path: str) -> dict[str, Any]:
    return Store.open(spark, path).load()


def load_bytes(spark: SparkSession, data: bytes) -> dict[str, Any]:
    return Store.open_bytes(spark, data).load()


def inspect(spark: SparkSession, path: str) -> DataFrame:
    return Store.open(spark, path).inspect()


def inspect_bytes(spark: SparkSession, data: bytes) -> DataFrame:
    return Store.open_bytes(spark, data).inspect()


__all__ = ["Builder", "Items", "Options", "Store", "StoreCodecError", "StoreError", "inspect", "inspect_bytes", "load", "load_bytes", "save", "save_sync", "serialize", "write", "write_sync"]
