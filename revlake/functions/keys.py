"""Byte strings: conversions and the unsigned lexicographic order that BINARY columns already have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf8(text: Column | str) -> Column:
    return F.encode(F.col(text) if isinstance(text, str) else text, "UTF-8")


def text(data: Column | str) -> Column:
    return F.decode(F.col(data) if isinstance(data, str) else data, "UTF-8")


def as_bytes(key: bytes | bytearray | str | None) -> bytes | None:
    return key.encode() if isinstance(key, str) else None if key is None else bytes(key)


def prefix_end(prefix: bytes) -> bytes | None:
    """The smallest key above every key with the prefix; None if there is none (no byte below 0xFF)."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None
