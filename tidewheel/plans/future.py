"""A result that arrives later, with chaining, cancellation and deadlines."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import Any

from ..errors import CancellationError, TimeoutError


class TaskFuture:
    """Settles once; later settles are ignored. Callbacks run in the thread that settles it."""

    def __init__(self, parent: TaskFuture | None = None):
        self._parent, self._done, self._lock = parent, threading.Event(), threading.RLock()
        self._value: Any = None
        self._error: BaseException | None = None
        self._callbacks: list[Callable[[TaskFuture], None]] = []
        self._timer: threading.Timer | None = None
        self._on_cancel: Callable[[BaseException], None] | None = None
        self._arm: Callable[[float], bool] | None = None
        self._task: Any = None

    @property
    def pending(self) -> bool:
        return not self._done.is_set()

    @property
    def resolved(self) -> bool:
        return self._done.is_set() and self._error is None

    @property
    def rejected(self) -> bool:
        return self._done.is_set() and self._error is not None

    def _settle(self, value: Any, error: BaseException | None) -> bool:
        with self._lock:
            if self._done.is_set():
                return False
            self._value, self._error = value, error
            self._done.set()
            callbacks, self._callbacks = self._callbacks, []
            if self._timer:
                self._timer.cancel()
        for callback in callbacks:
            callback(self)
        return True

    def resolve(self, value: Any = None) -> bool:
        if isinstance(value, TaskFuture):
            value._then(lambda f: self._settle(f._value, f._error))
            return True
        return self._settle(value, None)

    def reject(self, error: BaseException) -> bool:
        return self._settle(None, error)

    def _then(self, callback: Callable[[TaskFuture], None]) -> None:
        with self._lock:
            if not self._done.is_set():
                self._callbacks.append(callback)
                return
        callback(self)

    def then(self, on_value: Callable[[Any], Any] | None = None, on_error: Callable[[BaseException], Any] | None = None) -> TaskFuture:
        child = TaskFuture(self)

        def run(f: TaskFuture) -> None:
            handler, given = (on_value, f._value) if f._error is None else (on_error, f._error)
            if handler is None:
                child._settle(f._value, f._error)
                return
            try:
                child.resolve(handler(given))
            except BaseException as e:
                child.reject(e)

        self._then(run)
        return child

    def catch(self, on_error: Callable[[BaseException], Any]) -> TaskFuture:
        return self.then(None, on_error)

    def always(self, callback: Callable[[Any], Any]) -> TaskFuture:
        """One callback for both outcomes; what it returns replaces them."""
        return self.then(callback, callback)

    def finally_(self, callback: Callable[[], Any] | None) -> TaskFuture:
        """Runs ``callback`` and keeps the outcome; waits for a future that it returns."""
        child = TaskFuture(self)

        def run(f: TaskFuture) -> None:
            try:
                after = callback() if callback else None
            except BaseException as e:
                child.reject(e)
                return
            if isinstance(after, TaskFuture):
                after._then(lambda a: child._settle(f._value, a._error or f._error))
            else:
                child._settle(f._value, f._error)

        self._then(run)
        return child

    def _root(self) -> TaskFuture:
        return self._parent._root() if self._parent else self

    def _stop(self, error: BaseException) -> None:
        stop = self._on_cancel
        if self.pending and stop:
            stop(error)
        self.reject(error)

    def cancel(self) -> TaskFuture:
        self._root()._stop(CancellationError())
        return self

    def timeout(self, ms: float) -> TaskFuture:
        """Rejects with TimeoutError after so many milliseconds; for a call that waits in a queue, from its start on."""
        root = self._root()
        if not (root._arm and root._arm(ms)):
            root.start_timer(ms)
        return self

    def start_timer(self, ms: float) -> None:
        with self._lock:
            if self._done.is_set():
                return
            if self._timer:
                self._timer.cancel()
            self._timer = threading.Timer(ms / 1000, lambda: self._stop(TimeoutError(f"call ran past {ms} ms")))
            self._timer.daemon = True
            self._timer.start()

    def result(self, seconds: float | None = None) -> Any:
        if not self._done.wait(seconds):
            raise TimeoutError(f"no result after {seconds} s")
        if self._error is not None:
            raise self._error
        return self._value


def gather_all(futures: list[TaskFuture]) -> TaskFuture:
    """The values in order; the first rejection rejects; no futures give an empty list."""
    out, left, lock = TaskFuture(), len(futures), threading.Lock()
    values: list[Any] = [None] * len(futures)
    if not futures:
        out.resolve([])

    def settle(i: int, f: TaskFuture) -> None:
        nonlocal left
        if f.rejected:
            out.reject(f._error)
            return
        with lock:
            values[i] = f._value
            left -= 1
            last = left == 0
        if last:
            out.resolve(values)

    for i, f in enumerate(futures):
        f._then(lambda f, i=i: settle(i, f))
    return out


def defer() -> tuple[TaskFuture, Callable[[Any], bool], Callable[[BaseException], bool]]:
    future = TaskFuture()
    return future, future.resolve, future.reject
