"""Errors of the engine."""


class ToneError(Exception):
    """Base of all errors raised here."""


class ConfigError(ToneError):
    """A configuration that can't be carried out."""


class LoadError(ToneError):
    """A source that can't be read as asked."""


class ScoreError(ToneError):
    """A scoring step that can't be done."""
