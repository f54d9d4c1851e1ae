"""What can go wrong, by kind."""


class EngineError(Exception):
    """The root of all errors of this library."""


class ConfigError(EngineError):
    """A setting is missing or not allowed."""


class SourceError(EngineError):
    """An input can't be read."""


class ExtractorUnavailable(SourceError):
    """The format needs a library that isn't installed."""


class IndexError_(EngineError):
    """An index is missing, or its schema isn't the expected one."""


class EmbeddingError(EngineError):
    """An embedder failed, or a vector has the wrong length."""


class QueryError(EngineError):
    """A query string doesn't follow the grammar."""


class ConflictError(EngineError):
    """Another writer has changed what this one has read."""
