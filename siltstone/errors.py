"""Exceptions of the store."""


class StoreError(Exception):
    """Base of all of them."""


class StoreIOError(StoreError):
    """A path cannot be read or written."""


class StoreDecodeError(StoreError):
    """Data does not fit the type that is asked for."""


class StoreCodecError(StoreError):
    """A codec that is not registered."""


class StoreFormatError(StoreError):
    """A manifest that is missing or damaged, or a position that does not exist."""


class StoreInternalError(StoreError):
    """Something that cannot happen."""
