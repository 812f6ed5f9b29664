"""Errors that may be shown or logged: a code, a category and a message key, never contents, paths or addresses."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Categories of errors.
CATEGORIES = ("cancelled", "timeout", "environment", "unsupported", "unverified", "invalid_input", "authentication", "authorization", "rate_limit", "provider", "storage", "internal")
_SHAPES = {"code": r"[A-Z][A-Z0-9_]{2,63}", "message_key": r"[a-z][a-z0-9]*(?:\.[a-z0-9]+)+", "operation_id": r"[a-zA-Z0-9_-]{1,80}"}


@dataclass(frozen=True)
class SafeError:
    code: str
    category: str = "internal"
    message_key: str = "error.internal.failure"
    retryable: bool = False
    operation_id: str | None = None
    retry_after: float | None = None

    def __post_init__(self):
        for name, shape in _SHAPES.items():
            value = getattr(self, name)
            if not (value is None and name == "operation_id") and not re.fullmatch(shape, value or ""):
                raise ValueError(f"{name} is no safe one")
        if self.category not in CATEGORIES or (self.retry_after is not None and not 0 <= self.retry_after < float("inf")):
            raise ValueError("category or delay out of range")


class EngineError(Exception):
    """Carries a safe error; its text is the message key alone."""

    def __init__(self, safe: SafeError):
        super().__init__(safe.message_key)
        self.safe = safe


def to_safe(error: BaseException, fallback: str = "INTERNAL_FAILURE") -> SafeError:
    """What may be told of any error: nothing but the fallback code, unless it is safe already or a cancellation."""
    if isinstance(error, EngineError):
        return error.safe
    if isinstance(error, (KeyboardInterrupt, TimeoutError)):
        return SafeError("OPERATION_CANCELLED", "cancelled", "error.operation.cancelled") if isinstance(error, KeyboardInterrupt) else SafeError("OPERATION_TIMEOUT", "timeout", "error.operation.timeout", True)
    return SafeError(fallback)
