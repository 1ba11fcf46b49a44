"""Half-open key ranges as predicates that reach the Parquet scan, and file pruning by them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlake.functions.keys import as_bytes, prefix_end


@dataclass(frozen=True)
class KeyRange:
    """Keys from start (inclusive) to end (exclusive); None is unbounded. start above end is an error, start at end is empty."""

    start: bytes | None = None
    end: bytes | None = None

    def __post_init__(self):
        if self.start is not None and self.end is not None and self.start > self.end:
            raise ValueError(f"start {self.start!r} is above end {self.end!r}")

    @classmethod
    def all(cls) -> KeyRange:
        return cls()

    @classmethod
    def at_least(cls, start: bytes | str) -> KeyRange:
        return cls(as_bytes(start))

    @classmethod
    def until(cls, end: bytes | str) -> KeyRange:
        return cls(None, as_bytes(end))

    @classmethod
    def between(cls, start: bytes | str, end: bytes | str) -> KeyRange:
        return cls(as_bytes(start), as_bytes(end))

    @classmethod
    def prefix(cls, prefix: bytes | str) -> KeyRange:
        raw = as_bytes(prefix)
        return cls(raw, prefix_end(raw))

    @classmethod
    def from_request(cls, start: bytes | str | None, end: bytes | str | None) -> KeyRange:
        """The public form: None and empty bytes both mean unbounded."""
        return cls(as_bytes(start) or None, as_bytes(end) or None)

    @property
    def empty(self) -> bool:
        return self.end is not None and self.end <= (self.start or b"")

    def includes(self, key: bytes) -> bool:
        return (self.start is None or key >= self.start) and (self.end is None or key < self.end)

    def overlaps(self, low: bytes, high: bytes) -> bool:
        """Whether a file with keys low to high (both inclusive) can hold a key of the range."""
        return not self.empty and (self.start is None or high >= self.start) and (self.end is None or low < self.end)

    def predicate(self, key: str = "key") -> Column:
        """Literal comparisons only, so that row groups are skipped by their statistics."""
        if self.empty:
            return F.lit(False)
        out = F.lit(True)
        if self.start is not None:
            out = out & (F.col(key) >= F.lit(self.start))
        if self.end is not None:
            out = out & (F.col(key) < F.lit(self.end))
        return out
