"""What can go wrong with a store; bad arguments raise ValueError."""


class RevlakeError(Exception):
    """Base of all errors of a store."""


class InvalidRevisionError(RevlakeError):
    """A write is older than its key's latest entry, or differs from it at the same revision."""


class CorruptionError(RevlakeError):
    """Manifest, directory and files do not agree."""


class StoreClosedError(RevlakeError):
    """The store or view was closed."""


class StoreLockedError(RevlakeError):
    """Another writer holds the store."""


class RevisionExpiredError(RevlakeError):
    """Compaction has dropped versions that a view at this revision would need."""
