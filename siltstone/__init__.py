"""Lazy, partial reads of large nested records, as Spark plans."""

from .errors import StoreCodecError, StoreDecodeError, StoreError, StoreFormatError, StoreInternalError, StoreIOError
from .functions.codec import CodecTable, HookTable
from .operators.lazy import ChildrenPromise, CollectionPromise, MapPromise, RecordMirror, ValuePromise
from .sources.schema import Record, chunk, inline, keyed_map, record, vector
from .sources.store import Builder, Items, Options, Store, inspect, inspect_bytes, load, load_bytes, save, save_sync, serialize, write, write_sync

__all__ = [
    "Builder", "ChildrenPromise", "CodecTable", "CollectionPromise", "HookTable", "Items", "MapPromise", "Options", "Record", "RecordMirror", "Store", "StoreCodecError", "StoreDecodeError", "StoreError",
    "StoreFormatError", "StoreIOError", "StoreInternalError", "ValuePromise", "chunk", "inline", "inspect", "inspect_bytes", "keyed_map", "load", "load_bytes", "record", "save",
    "save_sync", "serialize", "vector", "write", "write_sync",
]
