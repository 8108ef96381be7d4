"""Codecs: a numbered table, and the three states of a field: unset, none, or named."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..errors import StoreCodecError

#: id -> (name, Parquet codec); ids 0 to 7 as there are three bits for them.
_BUILT_IN = {0: ("none", "none"), 1: ("lz4", "lz4_raw"), 2: ("zstd", "zstd"), 3: ("snappy", "snappy")}


class CodecTable:
    """The codecs that a store may name. A table given to both writer and reader makes own names work in both."""

    def __init__(self) -> None:
        self._by_id = dict(_BUILT_IN)

    def register(self, codec_id: int, name: str, parquet: str) -> None:
        if not 0 <= codec_id <= 7:
            raise StoreCodecError(f"codec id {codec_id} is not in 0 to 7")
        self._by_id[codec_id] = (name, parquet)

    def get(self, codec_id: int) -> tuple[str, str]:
        if codec_id not in self._by_id:
            raise StoreCodecError(f"no codec has id {codec_id}")
        return self._by_id[codec_id]

    def id_of(self, name: str) -> int:
        for codec_id, (known, _) in self._by_id.items():
            if known == name:
                return codec_id
        raise StoreCodecError(f"unknown codec {name!r}")

    def resolve(self, field: str | None, default: str | None) -> tuple[int, str]:
        """(id, Parquet codec): a field's own choice, "none" included, beats the writer's default."""
        codec_id = self.id_of(field or default or "none")
        return codec_id, self._by_id[codec_id][1]


class HookTable:
    """Layouts and encoders of one's own: a named pair of frame transformations, applied to a field's table when it is
    written and when it is read. Writer and reader are given the same table; the manifest holds the names."""

    def __init__(self) -> None:
        self._by_name: dict[str, tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]] = {}

    def register(self, name: str, encode: Callable[[DataFrame], DataFrame], decode: Callable[[DataFrame], DataFrame]) -> None:
        self._by_name[name] = (encode, decode)

    def get(self, name: str) -> tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
        if name not in self._by_name:
            raise StoreCodecError(f"unknown hook {name!r}")
        return self._by_name[name]
