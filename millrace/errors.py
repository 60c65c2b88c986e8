"""Errors with stable exit codes: 0 is success, 1 any other failure, 130 an interruption."""

from __future__ import annotations


class MillraceError(Exception):
    """exit_code is part of the interface; hint says what to do about it, details what it is about."""

    exit_code = 1

    def __init__(self, message: str, hint: str | None = None, **details) -> None:
        super().__init__(message)
        self.hint = hint
        self.details = details


class ConfigError(MillraceError):
    exit_code = 2


class DatasetError(MillraceError):
    exit_code = 3


class DatasetFormatError(DatasetError):
    pass


class DatasetDecodeError(DatasetError):
    pass


class EmptySplitError(DatasetError):
    pass


class VerificationError(DatasetError):
    """Artefacts that don't agree with what their manifest says."""


class CapacityError(MillraceError):
    """Nothing that was asked for fits."""

    exit_code = 4


class CheckpointError(MillraceError):
    exit_code = 5


class RunError(MillraceError):
    exit_code = 6


class ExportError(MillraceError):
    exit_code = 7


INTERRUPTED = 130
