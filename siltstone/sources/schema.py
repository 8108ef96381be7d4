"""Record types: which fields are inline, which are heavy, which are keyed maps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..errors import StoreFormatError

INLINE, VALUE, VECTOR, MAP, RECORD = "inline", "value", "vector", "map", "record"
#: Widenings of integer types that Spark lacks.
WIDER = {"u8": "smallint", "u16": "int", "u32": "bigint", "u64": "decimal(20,0)", "i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint", "f32": "float", "f64": "double", "i128": "binary", "u128": "binary", "usize": "bigint", "isize": "bigint"}


@dataclass(frozen=True)
class Field:
    kind: str
    type: str | Record | None = None
    key: str | None = None
    codec: str | None = None

    def spark_type(self) -> T.DataType:
        return self.type.item_type() if isinstance(self.type, Record) else T._parse_datatype_string(WIDER.get(self.type, self.type))


@dataclass(frozen=True)
class Record:
    """A record type; fields are matched by name."""

    name: str
    fields: dict[str, Field] = field(default_factory=dict)

    def item_type(self) -> T.StructType:
        """As an item of a vector or a value of a map: heavy fields are columns too, read only when asked for."""
        out = T.StructType()
        for name, f in self.fields.items():
            kind = f.spark_type()
            if f.kind == VECTOR:
                kind = T.ArrayType(kind)
            elif f.kind == MAP:
                kind = T.MapType(T._parse_datatype_string(WIDER.get(f.key, f.key)), kind)
            out.add(T.StructField(name, kind, True, {"kind": f.kind, "codec": f.codec or ""}))
        return out

    def inline(self) -> list[str]:
        return [n for n, f in self.fields.items() if f.kind == INLINE]

    def heavy(self) -> list[str]:
        return [n for n, f in self.fields.items() if f.kind != INLINE]


def record(name: str, /, **fields: Field) -> Record:
    for key, f in fields.items():
        if not isinstance(f, Field):
            raise StoreFormatError(f"{name}.{key} is no field")
    return Record(name, fields)


def inline(type: str) -> Field:
    return Field(INLINE, type)


def chunk(type: str | Record, codec: str | None = None) -> Field:
    """A heavy value, or a nested record with heavy fields of its own."""
    return Field(RECORD if isinstance(type, Record) else VALUE, type, None, codec)


def vector(item: str | Record, codec: str | None = None) -> Field:
    return Field(VECTOR, item, None, codec)


def keyed_map(key: str, value: str | Record, codec: str | None = None) -> Field:
    return Field(MAP, value, key, codec)


def to_json(spec: Record) -> dict:
    def one(f: Field) -> dict:
        return {"kind": f.kind, "type": to_json(f.type) if isinstance(f.type, Record) else f.type, "key": f.key, "codec": f.codec}

    return {"name": spec.name, "fields": {k: one(f) for k, f in spec.fields.items()}}


def from_json(data: dict) -> Record:
    def one(f: dict) -> Field:
        return Field(f["kind"], from_json(f["type"]) if isinstance(f["type"], dict) else f["type"], f["key"], f["codec"])

    return Record(data["name"], {k: one(f) for k, f in data["fields"].items()})
