"""Calls over rows of arguments: one row, one call, one Spark job for all."""

from __future__ import annotations

import asyncio
import contextlib
import contextvars
import inspect
import io
import json
import traceback
from collections.abc import Callable
from typing import Any

from pyspark import TaskContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from ..functions.registry import Registry

ERROR = StructType([StructField(n, StringType()) for n in ("name", "message", "stack", "details")])
EVENT = StructType([StructField("seq", IntegerType()), StructField("payload", StringType())])
_call: contextvars.ContextVar[Running | None] = contextvars.ContextVar("call", default=None)


class Running:
    """What a call has told so far, and its line to the driver if there is one."""

    def __init__(self, uplink: Any = None):
        self.events: list[str] = []
        self.uplink = uplink

    def tell(self, payload: Any) -> None:
        self.events.append(json.dumps(payload))
        if self.uplink:
            self.uplink.send(len(self.events) - 1, payload)


class Told(io.StringIO):
    """Output that is kept, and told as an event line by line."""

    def __init__(self, stream: str, running: Running):
        super().__init__()
        self._stream, self._running, self._line = stream, running, ""

    def write(self, text: str) -> int:
        *lines, self._line = (self._line + text).split("\n")
        for line in lines:
            self._running.tell({self._stream: line + "\n"})
        return super().write(text)

    def close(self) -> None:
        if self._line:
            self._running.tell({self._stream: self._line})
            self._line = ""
        super().close()


def is_main_thread() -> bool:
    """Whether this runs on the driver, not inside a call."""
    return TaskContext.get() is None


def emit(payload: Any) -> None:
    """Adds an event to the call that runs; its payload is kept as JSON. A pool delivers it at once."""
    running = _call.get()
    if running is None:
        raise RuntimeError("emit works inside a call only")
    running.tell(payload)


def add_abort_listener(callback: Callable[[], Any]) -> None:
    """Runs in the process of the call when a pool cancels it or its time is up, before the process is ended."""
    running = _call.get()
    if running is None:
        raise RuntimeError("an abort listener is added inside a call only")
    if running.uplink:
        running.uplink.listeners.append(callback)


def settled(function: Callable, args: tuple) -> Any:
    value = function(*args)
    return asyncio.run(_awaited(value)) if inspect.isawaitable(value) else value


async def _awaited(value: Any) -> Any:
    return await value


def properties(error: BaseException) -> str | None:
    """The error's own properties as JSON: what its ``to_json`` gives, else its attributes; null if it has none."""
    own = error.to_json() if callable(getattr(error, "to_json", None)) else {k: v for k, v in vars(error).items() if not k.startswith("_")}
    return json.dumps(own, default=str) if own else None


def enveloped(function: Callable, args: tuple, capture: bool = False, stack: bool = True, uplink: Any = None, live_output: bool = False) -> dict[str, Any]:
    """value or error, events, and what was printed if that is asked for (with ``live_output`` as events instead)."""
    running = Running(uplink)
    token = _call.set(running)
    out, err = (Told("stdout", running), Told("stderr", running)) if live_output else (io.StringIO(), io.StringIO())
    held = capture or live_output
    value = error = None
    try:
        with contextlib.redirect_stdout(out) if held else contextlib.nullcontext(), contextlib.redirect_stderr(err) if held else contextlib.nullcontext():
            value = settled(function, args)
    except Exception as e:
        error = {"name": type(e).__name__, "message": str(e), "stack": traceback.format_exc() if stack else None, "details": properties(e)}
    finally:
        _call.reset(token)
    if live_output:
        out.close(), err.close()
    return {"value": value, "error": error, "events": [{"seq": i, "payload": p} for i, p in enumerate(running.events)], "stdout": out.getvalue() if capture else None, "stderr": err.getvalue() if capture else None}


def _resolved(function: Callable | str, registry: Registry | None, returns: str | DataType | None, vectorised: bool) -> tuple[Callable, str | DataType, bool]:
    if isinstance(function, str):
        if registry is None:
            raise TypeError("a name needs a registry")
        entry = registry.entry(function)
        return entry.function, entry.returns, entry.vectorised
    if not callable(function):
        raise TypeError("a function or the name of one is needed")
    if returns is None:
        raise TypeError("the return type is needed")
    return function, returns, vectorised


def call(function: Callable | str, *columns: Column | str, returns: str | DataType | None = None, vectorised: bool = False, registry: Registry | None = None) -> Column:
    """A column of results. ``vectorised``: the function takes and gives pandas Series; else it is called row by row over Arrow batches."""
    f, kind, series = _resolved(function, registry, returns, vectorised)
    return (F.pandas_udf(f, kind) if series else F.udf(lambda *a: settled(f, a), kind, useArrow=True))(*columns)


def call_safe(function: Callable | str, *columns: Column | str, returns: str | DataType | None = None, capture: bool = False, stack: bool = True, registry: Registry | None = None) -> Column:
    """struct<value, error, events, stdout, stderr> for each row: an exception stays with its row.

    An error is struct<name, message, stack, details>, details being its own properties as
    JSON. Without ``stack`` no traceback is formatted, which is most of a failing call's time.
    """
    f, kind, series = _resolved(function, registry, returns, False)
    if series:
        raise TypeError("an envelope needs a function of single values")
    if isinstance(kind, str):
        kind = DataType.fromDDL(kind)
    envelope = StructType([StructField("value", kind), StructField("error", ERROR), StructField("events", ArrayType(EVENT)), StructField("stdout", StringType()), StructField("stderr", StringType())])
    return F.udf(lambda *a: enveloped(f, a, capture, stack), envelope, useArrow=True)(*columns)
