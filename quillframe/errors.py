"""Errors of the engine."""


class EngineError(Exception):
    """Any error that a statement can raise."""


class SqlSyntaxError(EngineError):
    """The text can't be parsed."""


class AnalysisError(EngineError):
    """Names, types or placement are wrong."""


class ArgumentError(EngineError):
    """A value is wrong for its function or statement."""


class LimitError(EngineError):
    """An opt-in guard rail was exceeded."""


class AssertionFailed(EngineError):
    """An ASSERT does not hold."""
