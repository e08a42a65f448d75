"""Errors of the engine."""


class HistoryError(Exception):
    """Base of all."""


class InvalidQuery(HistoryError):
    """A query that can't be asked: a crossed range, an empty list, a foreign cursor, an unknown aggregation."""


class InvalidRecord(HistoryError):
    """A record that can't be written."""


class InvalidDeclaration(HistoryError):
    """A declaration or configuration that can't hold."""


class SnapshotExpired(HistoryError):
    """A snapshot was read after its time to live."""


class PartialResult(HistoryError):
    """An answer that would not be whole."""


class FrameOverflow(HistoryError):
    """An atomic coalescing frame held more than it may."""


class TableNotFound(HistoryError):
    """A table that a record is routed to does not exist."""


class TransactionSpoilt(HistoryError):
    """A unit of work that must not be published."""
