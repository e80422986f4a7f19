"""Errors that callers can tell apart."""


class EngineError(ValueError):
    """Base of all errors raised by this package."""


class SchemaError(EngineError):
    """A schema that contradicts itself."""


class BindingError(EngineError):
    """A source that lacks what it is bound to."""


class RequestError(EngineError):
    """A request for something that the universe does not have."""


class ConfigError(EngineError):
    """A causal configuration that cannot be carried out."""
