"""Errors of calls and pools."""

from __future__ import annotations

import json
from typing import Any


class CancellationError(Exception):
    def __init__(self, message: str = "call cancelled"):
        super().__init__(message)


class TimeoutError(Exception):  # noqa: A001  the name callers look for
    def __init__(self, message: str = "call ran past its deadline"):
        super().__init__(message)


class TerminateError(Exception):
    """The process that ran a call, or its pool, ended."""

    def __init__(self, message: str = "worker terminated", cause: BaseException | None = None):
        super().__init__(message)
        self.cause = cause


class QueueFullError(Exception):
    """The bound on waiting calls is reached."""


class RemoteError(Exception):
    """An exception raised inside a call, with the name, message and stack it had there.

    ``details`` has the exception's own properties (as JSON made them); they can be read as
    attributes too.
    """

    def __init__(self, name: str, message: str, stack: str | None = None, details: str | None = None):
        super().__init__(f"{name}: {message}")
        self.name, self.message, self.stack = name, message, stack
        self.details = json.loads(details) if details else {}

    def __getattr__(self, name: str) -> Any:
        details = self.__dict__.get("details", {})
        if isinstance(details, dict) and name in details:
            return details[name]
        raise AttributeError(name)
