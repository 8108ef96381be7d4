"""Mirrors and promises: inline fields are at hand, everything else is a plan until ``load``.

Each promise wraps a DataFrame, so column pruning, filter pushdown and partition pruning decide what is read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import StoreFormatError
from ..functions import layout
from ..sources.schema import INLINE, MAP, RECORD, VECTOR, Field, Record

POS, SHARD, FOLDER, KEY, BUCKET, VALUE = "pos", "shard", "shard_folder", "k", "bucket", "value"


class _Planned:
    """A promise's plan, made when it is first asked for: making a promise touches no file."""

    def __init__(self, df: DataFrame | Callable[[], DataFrame]):
        self._plan = df

    @property
    def df(self) -> DataFrame:
        if not isinstance(self._plan, DataFrame):
            self._plan = self._plan()
        return self._plan


class ValuePromise(_Planned):
    """One heavy value."""

    def load(self) -> Any:
        rows = self.df.take(2)
        if len(rows) != 1:
            raise StoreFormatError(f"a value has one row, not {len(rows)}")
        return rows[0][0]


class RecordMirror:
    """A record whose inline fields have been read; attributes of heavy fields are promises."""

    def __init__(self, spec: Record, values: dict[str, Any], promises: dict[str, Any]):
        self.__dict__.update(_spec=spec, _values=values, _promises=promises)

    def __getattr__(self, name: str) -> Any:
        for where in (self.__dict__["_values"], self.__dict__["_promises"]):
            if name in where:
                return where[name]
        raise AttributeError(name)

    def inline(self) -> dict[str, Any]:
        return dict(self._values)

    def load(self) -> dict[str, Any]:
        """The whole record, nested records, vectors and maps included."""
        return {n: self._values[n] if n in self._values else self._promises[n].load() for n in self._spec.fields}


def mirror_of_row(spec: Record | None, row: Any, heavy: DataFrame) -> Any:
    """A mirror of an item: inline values from ``row``, heavy columns from the one-row plan ``heavy``."""
    if spec is None:
        return row[VALUE]
    promises: dict[str, Any] = {}
    for name, f in spec.fields.items():
        if f.kind == VECTOR:
            exploded = heavy.select(F.posexplode(name).alias(POS, VALUE)).withColumn(POS, F.col(POS).cast("long"))
            promises[name] = CollectionPromise(_spread(exploded, f), _spec(f))
        elif f.kind == MAP:
            promises[name] = MapPromise(_spread(heavy.select(F.explode(name).alias(KEY, VALUE)), f), _spec(f))
        elif f.kind == RECORD:
            promises[name] = mirror_of_row(f.type, row[name], heavy.select(f"{name}.*"))  # its inline fields came with the row
        elif f.kind != INLINE:
            promises[name] = ValuePromise(heavy.select(name))
    return RecordMirror(spec, {n: row[n] for n in spec.inline()}, promises)


def light(spec: Record, of: str = "") -> list[Column]:
    """The inline fields of a record, those of nested records in structs."""
    out = [F.col(f"{of}`{n}`") for n in spec.inline()]
    for name, f in spec.fields.items():
        if f.kind == RECORD:
            inner = light(f.type, f"{of}`{name}`.")
            out.append((F.struct(*inner) if inner else F.lit(None).cast("string")).alias(name))
    return out


def _spec(f: Field) -> Record | None:
    return f.type if isinstance(f.type, Record) else None


def _spread(df: DataFrame, f: Field) -> DataFrame:
    """A struct in ``value`` becomes columns."""
    return df.select(*[c for c in df.columns if c != VALUE], f"{VALUE}.*") if _spec(f) else df


#: Positions below this are found by a bounded top-k; others need the positions of all rows.
NEAR = 10_000


class CollectionPromise(_Planned):
    """An ordered collection: a plan with ``pos``, and ``shard`` where it is stored; where shards share folders, with ``shard_folder``, which is only used to prune."""

    def __init__(self, df: DataFrame | Callable[[], DataFrame], spec: Record | None = None, count: int | None = None, shard_items: int | None = None, raw: DataFrame | None = None, order_by: list[str | Column] = (), folder_shards: int = 1):
        super().__init__(df)
        self.folder_shards = folder_shards
        self.spec, self._count, self.shard_items = spec, count, shard_items
        self._raw, self._order = raw, [F.col(c) if isinstance(c, str) else c for c in order_by]

    @classmethod
    def of(cls, df: DataFrame, order_by: list[str | Column], spec: Record | None = None) -> CollectionPromise:
        """A collection over any frame with a total order. Positions are made for what needs them alone."""
        from .positions import with_positions

        return cls(lambda: with_positions(df, order_by), spec, raw=df, order_by=order_by)

    def _head(self, n: int) -> DataFrame:
        """The first n rows with their positions: n rows of each task at most are sorted together."""
        top = self._raw.orderBy(*self._order).limit(n)
        return top.withColumn(POS, (F.row_number().over(W.orderBy(*self._order)) - 1).cast("long")).select(POS, *self._raw.columns)

    def _plain(self, df: DataFrame) -> DataFrame:
        return df.drop(FOLDER) if self.folder_shards > 1 else df

    def _within(self, df: DataFrame, shards: Column, folders: Column) -> DataFrame:
        """Rows of some shards; the folders they lie in prune partitions."""
        found = df.where(shards)
        return found.where(folders) if self.folder_shards > 1 and FOLDER in df.columns else found

    def _columns(self, heavy: bool) -> list[str]:
        rest = [c for c in self._plain(self.df).columns if c not in (POS, SHARD)]
        return rest if heavy or self.spec is None else [c for c in rest if self.spec.fields[c].kind == INLINE]

    def _light(self) -> list[Column]:
        return light(self.spec) if self.spec is not None else [F.col(c) for c in self._columns(False)]

    def at(self, *positions: int) -> DataFrame:
        """Rows at positions; the shards they lie in prune partitions."""
        wanted = F.col(POS).isin([int(p) for p in positions])
        if self._raw is not None and max(positions) < NEAR:
            return self._head(int(max(positions)) + 1).where(wanted)
        found = self.df.where(F.col(POS).isin([int(p) for p in positions]) if len(positions) > 1 else F.col(POS) == int(positions[0]))
        if self.shard_items:
            shards = sorted({int(p) // self.shard_items for p in positions})
            found = self._within(found, F.col(SHARD).isin(shards), F.col(FOLDER).isin(sorted({s // self.folder_shards for s in shards})))
        return self._plain(found)

    def scan(self) -> DataFrame:
        """All items in full, with positions; a distributed frame, unordered."""
        return self.df.select(POS, *self._columns(True))

    def items(self) -> DataFrame:
        """All items in full, unordered and without positions: a plain scan."""
        return self._raw if self._raw is not None else self.df.select(*self._columns(True))

    def ordered(self) -> DataFrame:
        return self.scan().orderBy(POS)

    def load(self) -> list[Any]:
        """All items on the driver, in order; the number is checked against the manifest."""
        rows = self.ordered().collect()
        if self._count is not None:
            size = self.shard_items or max(self._count, 1)
            found, want = Counter(r[POS] // size for r in rows), layout.runs(self._count, size)
            if sorted(found.values(), reverse=True) != [items for items, n in want for _ in range(n)] or len({r[POS] for r in rows}) != self._count:
                raise StoreFormatError(f"{len(rows)} items in {len(found)} shards, the manifest has {self._count} in {sum(n for _, n in want)}")
        return [r[VALUE] if self.spec is None and VALUE in self.df.columns else {k: v for k, v in r.asDict(True).items() if k != POS} for r in rows]

    def get(self, i: int) -> Any:
        """The item at a position; raises where there is none."""
        if i < 0 or self._count is not None and i >= self._count:
            raise StoreFormatError(f"index {i} is out of range")
        rows = self.at(i).select(*self._columns(True)).take(1)
        if not rows:
            raise StoreFormatError(f"index {i} is out of range")
        return rows[0][VALUE] if self.spec is None and VALUE in self.df.columns else rows[0].asDict(True)

    def get_lazy(self, i: int) -> Any:
        if i < 0 or self._count is not None and i >= self._count:
            raise StoreFormatError(f"index {i} is out of range")
        rows = self.at(i).select(*(self._light() or [POS])).take(1)
        if not rows:
            raise StoreFormatError(f"index {i} is out of range")
        return mirror_of_row(self.spec, rows[0], self.at(i))

    def length(self) -> DataFrame:
        return (self._raw if self._raw is not None else self.df).agg(F.count("*").alias("len"))

    def __len__(self) -> int:
        if self._count is None:
            self._count = (self._raw if self._raw is not None else self.df).count()
        return self._count

    def is_empty(self) -> bool:
        return self._count == 0 if self._count is not None else (self._raw if self._raw is not None else self.df).isEmpty()

    def first_row(self) -> DataFrame:
        if self._raw is not None:
            return self._raw.orderBy(*self._order).limit(1)
        return self.at(0).select(*self._columns(True))

    def last_row(self) -> DataFrame:
        if self._raw is not None:
            return self._raw.orderBy(*[c.desc() for c in self._order]).limit(1)
        if self._count is not None:
            return self.at(max(self._count - 1, 0)).select(*self._columns(True))
        return self.df.orderBy(F.col(POS).desc()).limit(1).select(*self._columns(True))

    def first(self) -> Any:
        return None if self.is_empty() else self.get_lazy(0)

    def last(self) -> Any:
        return None if self.is_empty() else self.get_lazy(len(self) - 1)

    def iter(self) -> Iterator[Any]:
        """Items in order, a partition at a time on the driver."""
        from ..streaming.pull import rows_in_order

        for row in rows_in_order(self.scan(), POS):
            yield row[VALUE] if self.spec is None and VALUE in self.df.columns else {k: v for k, v in row.asDict(True).items() if k != POS}

    def iter_lazy(self) -> LazyIterator:
        return LazyIterator(self)

    def lazy(self) -> DataFrame:
        """Positions and inline fields only."""
        return self.df.select(*[c for c in (POS, SHARD) if c in self.df.columns], *self._light())

    def load_where(self, condition: Column | str, *heavy: str) -> DataFrame:
        """Filter on inline fields, then load heavy ones of what remains: the filter is pushed to the scan."""
        return self.df.where(condition).select(*self._columns(False), *heavy)

    def semi_load(self, keys: DataFrame, *heavy: str) -> DataFrame:
        """Heavy fields at the positions (and shards) of ``keys``, which any plan may have chosen."""
        on = [c for c in (SHARD, POS) if c in keys.columns and c in self.df.columns]
        keys = keys.select(*on).distinct()
        if self.folder_shards > 1 and SHARD in on and FOLDER in self.df.columns:
            on, keys = [FOLDER, *on], keys.withColumn(FOLDER, F.floor(F.col(SHARD) / self.folder_shards).cast("int"))
        return self.df.join(keys, on, "left_semi").select(POS, *heavy)

    def slice(self, start: int, stop: int, clamp: bool = True) -> DataFrame:
        """Extension: items of start <= pos < stop; without clamping, a range beyond the end raises."""
        if start < 0 or stop < start or not clamp and stop > len(self):
            raise StoreFormatError(f"range {start} to {stop} is out of range")
        if self._raw is not None and stop <= NEAR:
            return self._head(stop).where((F.col(POS) >= start) & (F.col(POS) < stop)).select(POS, *[c for c in self._raw.columns])
        found = self.df.where((F.col(POS) >= start) & (F.col(POS) < stop))
        if self.shard_items:
            first, last = start // self.shard_items, max(stop - 1, start) // self.shard_items
            found = self._within(found, F.col(SHARD).between(first, last), F.col(FOLDER).between(first // self.folder_shards, last // self.folder_shards))
        return found.select(POS, *self._columns(True))

    def shards(self, size: int | None = None) -> DataFrame:
        """Shard and place of every position."""
        size = size or self.shard_items or layout.items_per_shard(len(self), 64)
        return self._plain(self.df).select("*", layout.shard_index(F.col(POS), size).alias("shard_idx"), (F.col(POS) % size).alias("local_idx"))

    def element(self, field: str, i: int) -> Column:
        """An element of a nested vector of each item; null beyond its end."""
        return F.get(field, F.lit(i))

    def element_count(self, field: str) -> Column:
        return F.coalesce(F.size(field), F.lit(0)).cast("long")

    def run_table(self, size: int | None = None) -> DataFrame:
        """(item_count, repeat_n): the run-length table of shard sizes."""
        each = self.shards(size).groupBy("shard_idx").agg(F.count("*").alias("item_count"))
        return each.groupBy("item_count").agg(F.count("*").alias("repeat_n"))


class LazyIterator:
    """Mirrors in order, with an exact remaining length."""

    def __init__(self, of: CollectionPromise):
        from ..streaming.pull import rows_in_order

        self.of, self.at, self.rows = of, 0, rows_in_order(of.lazy(), POS)
        self.left = len(of)

    def __iter__(self) -> LazyIterator:
        return self

    def __len__(self) -> int:
        return self.left

    def __next__(self) -> Any:
        if not self.left:
            raise StopIteration
        row = next(self.rows)
        self.left -= 1
        return mirror_of_row(self.of.spec, row, self.of.at(row[POS]))


class ChildrenPromise:
    """Collections within a collection, as child rows with their owner's key: one plan reads them for all owners.

    ``order_by`` is a total order within an owner. Owners may be many or few; a top-k within each owner is cut on the map
    side, so a large owner's rows don't meet in one task.
    """

    def __init__(self, df: DataFrame, owner: list[str], order_by: list[str]):
        self.df, self.owner, self.order_by = df, owner, order_by

    def at(self, i: int) -> DataFrame:
        """The child at a position of every owner that has one."""
        if i < 0:
            raise StoreFormatError(f"index {i} is out of range")
        place = F.row_number().over(W.partitionBy(*self.owner).orderBy(*self.order_by))
        return self.df.withColumn(POS, place).where(F.col(POS) <= i + 1).where(F.col(POS) == i + 1).withColumn(POS, (F.col(POS) - 1).cast("long"))

    def lengths(self, owners: DataFrame) -> DataFrame:
        """The number of children of every row of ``owners``, none included."""
        counted = self.df.groupBy(*self.owner).agg(F.count("*").alias("len"))
        return owners.select(*self.owner).join(counted, self.owner, "left").withColumn("len", F.coalesce("len", F.lit(0)))

    def of(self, owners: DataFrame) -> DataFrame:
        """The children of ``owners``, with the owners' columns: one step of a path."""
        return owners.join(self.df, self.owner)


class MapPromise(_Planned):
    """A keyed collection: a plan with ``k``, and ``bucket`` where it is stored."""

    def __init__(self, df: DataFrame | Callable[[], DataFrame], spec: Record | None = None, buckets: int | None = None, count: int | None = None):
        super().__init__(df)
        self.spec, self.buckets, self._count = spec, buckets, count

    @classmethod
    def of(cls, df: DataFrame, key: str, spec: Record | None = None) -> MapPromise:
        """A map over any frame with a unique key."""
        return cls(df.select(F.col(key).alias(KEY), *[c for c in df.columns if c != key]), spec)

    def _columns(self, heavy: bool = True) -> list[str]:
        rest = [c for c in self.df.columns if c not in (KEY, BUCKET)]
        return rest if heavy or self.spec is None else [c for c in rest if self.spec.fields[c].kind == INLINE]

    def find(self, *keys: Any, heavy: bool = True) -> DataFrame:
        """Rows of keys; their buckets are constants and prune partitions. An empty map has no rows."""
        kind = self.df.schema[KEY].dataType
        wanted = [F.lit(k).cast(kind) for k in keys]
        found = self.df.where(F.col(KEY) == wanted[0] if len(keys) == 1 else F.col(KEY).isin(*wanted))
        if self.buckets:
            places = [layout.bucket(k, self.buckets) for k in wanted]
            found = found.where(F.col(BUCKET) == places[0] if len(keys) == 1 else F.col(BUCKET).isin(*places))
        return found.select(KEY, *self._columns(heavy))

    def scan(self) -> DataFrame:
        return self.df.select(KEY, *self._columns())

    def load(self) -> dict[Any, Any]:
        return {r[KEY]: self._value(r) for r in self.scan().collect()}

    def _value(self, row: Any) -> Any:
        return row[VALUE] if self.spec is None and self._columns() == [VALUE] else {k: v for k, v in row.asDict(True).items() if k != KEY}

    def get(self, key: Any) -> Any:
        """The whole value of a key, or None."""
        rows = self.find(key).take(1)
        return self._value(rows[0]) if rows else None

    def get_lazy(self, key: Any) -> Any:
        """A mirror of a key's value, or None."""
        rows = self.find(key).select(*(light(self.spec) if self.spec is not None else ["*"])).take(1)
        return mirror_of_row(self.spec, rows[0], self.find(key)) if rows else None

    def num_shards(self) -> DataFrame:
        n = F.count("*")
        return self.df.agg(F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(layout.MOST_BUCKETS), F.floor(n / layout.ITEMS_PER_BUCKET)))).cast("long").alias("num_shards"))

    def __len__(self) -> int:
        return self._count if self._count is not None else self.df.count()
