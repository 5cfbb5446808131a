"""Every error of the engine, under one base class."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all."""


class SchemaError(EngineError):
    """An entity, field or index is declared wrongly, or unknown."""


class DuplicateIndexName(SchemaError):
    """Two indexes of a catalog have one name."""


class TypeValidationError(SchemaError):
    """An index kind does not accept the number or the types of its fields."""


class ConfigurationError(EngineError):
    """Configuration names an unknown entity or index, or fits another kind."""


class PredicateError(EngineError):
    """A comparison that its field does not support."""


class UniqueViolation(EngineError):
    """Rows with different ids share the values of a unique index."""

    def __init__(self, index: str, examples: list):
        super().__init__(f"unique index {index}: {examples}")
        self.index, self.examples = index, examples


class SizeLimitError(EngineError):
    """A key or a value is larger than the store allows."""


class ConcurrentSaveError(EngineError):
    """A save began while another was under way, or lost the race for a snapshot."""


class IndexStateError(EngineError):
    """A transition between index states that is not allowed, or a read of an index that is not readable."""


class ScrubError(EngineError):
    """A check of an index failed more often than it may."""


class MigrationError(EngineError):
    """A migration plan is invalid, or has no path."""
