"""Errors with stable codes."""

from __future__ import annotations

CODES = frozenset("INVALID_ARGUMENT INVALID_STATE INVALID_DATA NOT_FOUND ALREADY_EXISTS IO CORRUPT UNSUPPORTED RESOURCE_EXHAUSTED INTERNAL".split())


class EngineError(ValueError):
    """code (one of CODES), the operation that failed, a message and details."""

    def __init__(self, code: str, operation: str, message: str, **details):
        if code not in CODES:
            raise AssertionError(code)
        super().__init__(f"{code} in {operation}: {message}" + "".join(f"; {k}={v}" for k, v in details.items()))
        self.code, self.operation, self.message, self.details = code, operation, message, details


def require(condition, operation: str, message: str, code: str = "INVALID_ARGUMENT", **details) -> None:
    if not condition:
        raise EngineError(code, operation, message, **details)
