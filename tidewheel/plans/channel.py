"""A line between a running call and the driver: events and output go up, a request to clean up comes down.

Spark itself brings nothing from a Python worker to the driver before a task ends. The driver
listens on a socket; a call that has someone to report to connects with the token of its task
and sends JSON lines. Where the line cannot be made, events still arrive with the result.
"""

from __future__ import annotations

import json
import socket
import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession


class Line:
    """The driver's end for one call. Messages have a number, so each is delivered once and in order."""

    def __init__(self, on_event: Callable[[Any], None] | None):
        self.on_event, self.delivered = on_event, 0
        self.closed, self.cleaned = threading.Event(), threading.Event()
        self.clean = False
        self._socket: socket.socket | None = None
        self._lock = threading.RLock()

    def serve(self, connection: socket.socket, lines: Any) -> None:
        with self._lock:
            self._socket = connection
        try:
            for raw in lines:
                message = json.loads(raw)
                if "cleaned" in message:
                    self.clean = message["cleaned"]
                    self.cleaned.set()
                else:
                    self.deliver(message["seq"], message["payload"])
        except (OSError, ValueError):
            pass
        finally:
            self.closed.set()
            self.cleaned.set()

    def deliver(self, seq: int, payload: Any) -> None:
        with self._lock:
            if seq != self.delivered:
                return
            self.delivered += 1
        if self.on_event:
            self.on_event(payload)

    def ask_to_clean(self, seconds: float) -> bool:
        """Whether the call has listeners and all of them ended well within the time."""
        with self._lock:
            if self._socket is None or self.closed.is_set():
                return False
            try:
                self._socket.sendall(b"abort\n")
            except OSError:
                return False
        return self.cleaned.wait(seconds) and self.clean

    def finish(self, events: list[Any], seconds: float = 5.0) -> None:
        """Waits for the call's end of the line and delivers what did not come over it."""
        if self._socket is not None:
            self.closed.wait(seconds)
        for seq, payload in enumerate(events):
            self.deliver(seq, payload)


class Switchboard:
    """The driver's socket; a line for each token."""

    def __init__(self, spark: SparkSession):
        self.host = spark.conf.get("spark.driver.host", None) or socket.gethostname()
        self.lines: dict[str, Line] = {}
        self._server = socket.create_server((spark.conf.get("spark.driver.bindAddress", None) or self.host, 0))
        self.port = self._server.getsockname()[1]
        threading.Thread(target=self._accept, daemon=True).start()

    def _accept(self) -> None:
        while True:
            try:
                connection, _ = self._server.accept()
            except OSError:
                return
            threading.Thread(target=self._serve, args=(connection,), daemon=True).start()

    def _serve(self, connection: socket.socket) -> None:
        with connection, connection.makefile("rb") as lines:
            line = self.lines.get(lines.readline().decode(errors="replace").strip())
            if line:
                line.serve(connection, lines)

    def close(self) -> None:
        self._server.close()


class Uplink:
    """The call's end. Without a connection, ``send`` does nothing."""

    def __init__(self, address: tuple[str, int, str] | None):
        self.listeners: list[Callable[[], Any]] = []
        self._socket, self._lock = None, threading.Lock()
        if address:
            try:
                self._socket = socket.create_connection(address[:2], timeout=5)
                self._socket.settimeout(None)
                self._socket.sendall(f"{address[2]}\n".encode())
                threading.Thread(target=self._listen, daemon=True).start()
            except OSError:
                self._socket = None

    def _listen(self) -> None:
        try:
            with self._socket.makefile("rb") as lines:
                for raw in lines:
                    if raw.strip() == b"abort":
                        self._clean()
        except OSError:
            pass

    def _clean(self) -> None:
        good = bool(self.listeners)
        for listener in self.listeners:
            try:
                listener()
            except Exception:
                good = False
        self.listeners.clear()
        self._write({"cleaned": good})

    def _write(self, message: dict) -> None:
        if self._socket:
            try:
                with self._lock:
                    self._socket.sendall(json.dumps(message).encode() + b"\n")
            except OSError:
                pass

    def send(self, seq: int, payload: Any) -> None:
        self._write({"seq": seq, "payload": payload})

    def close(self) -> None:
        if self._socket:
            try:
                self._socket.shutdown(socket.SHUT_RDWR)
                self._socket.close()
            except OSError:
                pass
