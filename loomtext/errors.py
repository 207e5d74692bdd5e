"""What can go wrong, as exception classes with messages of the form "context - message"."""

from __future__ import annotations


class LoomError(Exception):
    """Base class."""

    kind = "error"

    def __init__(self, context: str, message: str = ""):
        super().__init__(f"{context} - {message}" if message else context)


class InvalidConfig(LoomError, ValueError):
    """A parameter, path or file that the engine doesn't accept."""


class Unsupported(LoomError, NotImplementedError):
    """Something known that isn't available here."""


class InvalidLabel(LoomError, ValueError):
    """A class label that is empty, too long, or has control characters."""


class InvalidData(LoomError, ValueError):
    """A file or model whose content is damaged or inconsistent."""


class EmptyTrainingSet(LoomError, ValueError):
    """No sample to train on."""


class PatternError(LoomError, ValueError):
    """A rule whose pattern doesn't compile."""


class VersionMismatch(LoomError, ValueError):
    """A model written by a version that this one can't read."""


class TooLarge(LoomError, ValueError):
    """An input over one of the size limits."""
