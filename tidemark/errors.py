"""Failures of journals: one class for each kind, with its context."""

from __future__ import annotations


class JournalError(Exception):
    """Base; ``kind`` names the class in rows' ``error.kind``."""

    kind = "Error"

    def __init__(self, message: str, **context):
        super().__init__(message)
        self.message = message
        self.context = {k: v for k, v in context.items() if v is not None}

    def __str__(self) -> str:
        shown = ", ".join(f"{k}={v}" for k, v in self.context.items())
        return f"{self.message} ({shown})" if shown else self.message

    def row(self) -> dict:
        """The ``error`` struct of permissive reads and of reports."""
        out = dict.fromkeys(ERROR_FIELDS)
        return out | {"kind": self.kind, "message": self.message} | {k: (str(v) if k in ("expected", "calculated") else v) for k, v in self.context.items() if k in out}

    def __reduce__(self):
        return _rebuilt, (type(self), self.message, self.context)


def _rebuilt(cls, message, context):
    return cls(message, **context)


class IoFailure(JournalError):
    kind = "Io"


class ChecksumMismatch(JournalError):
    kind = "ChecksumMismatch"


class InvalidFrame(JournalError):
    kind = "InvalidFrame"


class FlatbuffersFailure(JournalError):
    kind = "FlatbuffersError"


class ValidationFailed(JournalError):
    kind = "ValidationFailed"


class MissingPair(JournalError):
    kind = "MissingPair"


class UnexpectedEof(JournalError):
    kind = "UnexpectedEof"


ERROR_FIELDS = ("kind", "message", "declared_len", "buffer_len", "limit", "expected", "calculated", "validator", "reason")
ERROR_TYPE = "struct<kind: string, message: string, declared_len: bigint, buffer_len: bigint, limit: bigint, expected: string, calculated: string, validator: string, reason: string>"

#: Reasons of the bound errors.
TOO_LONG_FOR_HEADER = "payload does not fit the 32-bit length"
FRAME_OVER_LIMIT = "frame is longer than the limit"
PAYLOAD_OVER_LIMIT = "payload is longer than the limit"
