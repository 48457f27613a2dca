"""A client of the streaming replication protocol (public PostgreSQL protocol 3.0) over one socket.

It connects and authenticates, sees to the slot, starts replication and hands out frames; positions
go back to the server on a timer and when it asks. Only what `confirm` was told counts as flushed, so
a server never drops what has not been written. `record` turns frames into parquet files in the layout
of the `walflow_wal` source, which is how a live server reaches Spark: recorded files are the log that
batches and restarts read.
"""

from __future__ import annotations

import hashlib
import os
import re
import socket
import struct
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from walflow.errors import AuthError, ConnectionFailed, ParseError
from walflow.functions import wire

#: Fixed value: version 3.0 of the protocol.
PROTOCOL = 196608


def slot_names(name: str, count: int) -> list[str]:
    return [name] if count == 1 else [f"{name}_{i}" for i in range(count)]


def password_digest(user: str, password: str, salt: bytes) -> str:
    """The MD5 answer to an authentication request."""
    inner = hashlib.md5((password + user).encode()).hexdigest()
    return "md5" + hashlib.md5(inner.encode() + salt).hexdigest()


def error_message(fields: bytes) -> str:
    """Field M of an error response."""
    m = re.search(rb"(?:^|\0)M([^\0]*)", fields)
    return m.group(1).decode("utf-8", "replace") if m else "unknown error"


def format_lsn(lsn: int) -> str:
    return f"{lsn >> 32:X}/{lsn & 0xFFFFFFFF:X}"


def parse_lsn(text: str) -> int:
    m = re.fullmatch(r"0*([0-9A-Fa-f]{1,8})/0*([0-9A-Fa-f]{1,8})", text)
    if not m:
        raise ParseError("bad_lsn", f"not a log position: {text!r}")
    return (int(m[1], 16) << 32) + int(m[2], 16)


class Tracker:
    """Positions written, flushed and applied; none of them moves back."""

    def __init__(self, start: int = 0):
        self.write = self.flush = self.apply = start

    def update(self, write: int = 0, flush: int = 0, apply: int = 0) -> None:
        self.write, self.flush, self.apply = max(self.write, write), max(self.flush, flush), max(self.apply, apply)


@dataclass
class Statistics:
    """What was decoded since the start or the last reset."""

    messages: int = 0
    xlog: int = 0
    keepalives: int = 0
    bytes: int = 0
    errors: int = 0
    nanoseconds: int = 0

    def reset(self) -> "Statistics":
        """The figures so far; counting starts anew."""
        was = Statistics(**vars(self))
        self.__init__()
        return was


def decode_frame(frame: bytes) -> dict:
    """kind (xlog_data or keepalive) and the fields of a replication frame."""
    if not frame:
        raise ParseError("empty_message", "Empty message")
    if frame[:1] == b"w":
        if len(frame) < 25:
            raise ParseError("buffer_underflow", f"xlog data needs 24 bytes, has {len(frame) - 1}")
        start, end, sent = struct.unpack_from(">QQq", frame, 1)
        return {"kind": "xlog_data", "start_lsn": start, "end_lsn": end, "send_time": sent, "payload": frame[25:]}
    if frame[:1] == b"k":
        if len(frame) < 18:
            raise ParseError("buffer_underflow", f"keepalive needs 17 bytes, has {len(frame) - 1}")
        end, sent, reply = struct.unpack_from(">QqB", frame, 1)
        return {"kind": "keepalive", "end_lsn": end, "send_time": sent, "reply_requested": reply == 1}
    raise ParseError("unknown_message_type", f"unknown frame type {frame[0]:#04x}")


@dataclass
class Options:
    slot: str = "walflow"
    publication: str = "walflow"
    start_lsn: int = 0
    create_slot: bool = True
    status_interval: float = 10.0
    reply_to_keepalive: bool = True
    timeout: float = 30.0


class Client:
    """`params` as `walflow.sources.wal.connection` gives them."""

    def __init__(self, params: dict, options: Options | None = None):
        self.params, self.options = params, options or Options()
        self.tracker, self.statistics = Tracker(self.options.start_lsn), Statistics()
        self.socket: socket.socket | None = None
        self.buffer = bytearray()
        self.stopped = False

    # Messages of the protocol: a type byte, a length that counts itself, a body.
    def _send(self, kind: bytes, body: bytes) -> None:
        self.socket.sendall(kind + struct.pack(">i", len(body) + 4) + body)

    def _fill(self, n: int, patience: float | None) -> bool:
        """Reads until n bytes are buffered; False if `patience` ran out first. What has come stays buffered, so no frame is torn."""
        until = None if patience is None else time.monotonic() + patience
        while len(self.buffer) < n:
            left = self.options.timeout if until is None else until - time.monotonic()
            if left <= 0:
                return False
            self.socket.settimeout(left)
            try:
                data = self.socket.recv(1 << 16)
            except TimeoutError:
                if until is None:
                    raise ConnectionFailed(f"no answer within {self.options.timeout} s") from None
                return False
            if not data:
                raise EOFError
            self.buffer += data
        return True

    def _receive(self, patience: float | None = None) -> tuple[bytes, bytes] | None:
        """Type and body of the next message; None if none came within `patience`."""
        if not self._fill(5, patience):
            return None
        size = struct.unpack_from(">i", self.buffer, 1)[0]
        if size < 4:
            raise ConnectionFailed(f"message of impossible length {size}")
        if not self._fill(1 + size, patience):
            return None
        kind, body = bytes(self.buffer[:1]), bytes(self.buffer[5 : 1 + size])
        del self.buffer[: 1 + size]
        return kind, body

    def connect(self) -> "Client":
        """Startup and authentication, up to the server's readiness."""
        p = self.params
        try:
            self.socket = socket.create_connection((p["host"], p["port"]), self.options.timeout)
        except OSError as e:
            raise ConnectionFailed(f"{p['host']}:{p['port']}: {e}") from e
        pairs = (("user", p["user"]), ("database", p["database"]), ("replication", "database"), ("client_encoding", "UTF8"))
        body = struct.pack(">i", PROTOCOL) + b"".join(f"{k}\0{v}\0".encode() for k, v in pairs) + b"\0"
        self.socket.sendall(struct.pack(">i", len(body) + 4) + body)
        while True:
            kind, body = self._next()
            if kind == b"Z":
                return self
            if kind == b"R":
                self._authenticate(body)
            elif kind == b"E":
                raise ConnectionFailed(f"Server error: {error_message(body)}")

    def _next(self) -> tuple[bytes, bytes]:
        try:
            return self._receive()
        except EOFError:
            raise ConnectionFailed("the server closed the connection") from None

    def _authenticate(self, body: bytes) -> None:
        kind = struct.unpack_from(">i", body)[0] if len(body) >= 4 else 0
        password = self.params.get("password")
        if kind == 0:
            return
        if kind in (3, 5) and not password:
            raise AuthError("Password required but not provided")
        if kind == 3:
            self._send(b"p", password.encode() + b"\0")
        elif kind == 5:
            self._send(b"p", password_digest(self.params["user"], password, body[4:8]).encode() + b"\0")
        elif kind == 10:
            raise AuthError("SASL authentication is not supported; use md5 or trust")
        else:
            raise AuthError(f"Unsupported authentication type: {kind}")

    def query(self, sql: str) -> list[list[str | None]]:
        """Rows of a simple query, cells as text."""
        self._send(b"Q", sql.encode() + b"\0")
        rows, failed = [], None
        while True:
            kind, body = self._next()
            if kind == b"D":
                at, row = 2, []
                for _ in range(struct.unpack_from(">H", body)[0]):
                    n = struct.unpack_from(">i", body, at)[0]
                    at += 4
                    row.append(None if n < 0 else body[at : at + n].decode("utf-8", "replace"))
                    at += max(0, n)
                rows.append(row)
            elif kind == b"E":
                failed = error_message(body)
            elif kind == b"Z":
                if failed is not None:
                    raise ConnectionFailed(f"Query failed: {failed}")
                return rows

    def ensure_slot(self) -> bool:
        """Creates the slot if there is none; whether it did."""
        name = self.options.slot
        if not re.fullmatch(r"[a-z0-9_]{1,63}", name):
            raise ConnectionFailed(f"not a slot name: {name!r}")
        if self.query(f"SELECT slot_name FROM pg_replication_slots WHERE slot_name = '{name}'"):
            return False
        if not self.options.create_slot:
            raise ConnectionFailed(f"replication slot {name} does not exist")
        self.query(f"CREATE_REPLICATION_SLOT {name} LOGICAL pgoutput NOEXPORT_SNAPSHOT")
        return True

    def slot_position(self) -> int:
        """The position the slot's consumer has confirmed, 0 if none."""
        rows = self.query(f"SELECT confirmed_flush_lsn FROM pg_replication_slots WHERE slot_name = '{self.options.slot}'")
        return parse_lsn(rows[0][0]) if rows and rows[0] and rows[0][0] else 0

    def start(self) -> int:
        """Starts replication at start_lsn or, where that is 0, at the slot's own position, which it returns."""
        self.ensure_slot()
        at = self.options.start_lsn or self.slot_position()
        self.tracker.update(at, at, at)
        names = self.options.publication.replace("'", "''")
        self._send(b"Q", f"START_REPLICATION SLOT {self.options.slot} LOGICAL {format_lsn(at)} (proto_version '1', publication_names '{names}')\0".encode())
        while True:
            kind, body = self._next()
            if kind == b"W":
                return at
            if kind == b"E":
                raise ConnectionFailed(f"START_REPLICATION failed: {error_message(body)}")
            if kind == b"Z":
                raise ConnectionFailed("the server did not start copying")

    def send_status(self, reply: bool = False) -> None:
        now = (time.time_ns() // 1000) - wire.PG_EPOCH_US
        self._send(b"d", wire.standby_status(self.tracker.write, self.tracker.flush, self.tracker.apply, now, reply))

    def confirm(self, lsn: int) -> None:
        """All up to lsn has been written for good; the next status says so."""
        self.tracker.update(lsn, lsn, lsn)

    def stop(self) -> None:
        self.stopped = True

    def frames(self) -> Iterator[dict | None]:
        """Frames of xlog data as they come; None whenever a status was due, so that a caller can act on time. Ends when the server is done or `stop` was called."""
        due = time.monotonic() + self.options.status_interval
        while not self.stopped:
            try:
                got = self._receive(max(0.0, min(0.2, due - time.monotonic())))
            except EOFError:
                return
            if time.monotonic() >= due:
                self.send_status()
                due = time.monotonic() + self.options.status_interval
                yield None
            if got is None:
                continue
            kind, body = got
            if kind == b"c":
                return
            if kind == b"E":
                raise ConnectionFailed(f"Server error: {error_message(body)}")
            if kind != b"d":
                continue
            began = time.perf_counter_ns()
            self.statistics.messages += 1
            self.statistics.bytes += len(body)
            try:
                frame = decode_frame(body)
            except ParseError:
                self.statistics.errors += 1
                continue
            finally:
                self.statistics.nanoseconds += time.perf_counter_ns() - began
            self.tracker.update(write=frame["end_lsn"])
            if frame["kind"] == "keepalive":
                self.statistics.keepalives += 1
                if frame["reply_requested"] and self.options.reply_to_keepalive:
                    self.send_status()
            else:
                self.statistics.xlog += 1
                yield frame

    def close(self) -> None:
        if self.socket is not None:
            try:
                self._send(b"X", b"")
            except OSError:
                pass
            self.socket.close()
            self.socket = None


@dataclass
class Recorder:
    """Writes frames of one slot as parquet files of up to `rows` rows or `seconds` and confirms them only then."""

    client: Client
    path: str
    rows: int = 10_000
    seconds: float = 0.1
    seq: int = 0
    held: list = field(default_factory=list)

    def flush(self) -> int:
        """Writes what is held under a name that readers take only when the file is whole."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        n = len(self.held)
        if n:
            columns = {c: [r[c] for r in self.held] for c in ("start_lsn", "end_lsn", "send_time", "payload")}
            table = pa.table({
                "slot": pa.array([self.client.options.slot] * n, pa.string()), "seq": pa.array(range(self.seq, self.seq + n), pa.int64()),
                **{c: pa.array(columns[c], pa.int64()) for c in ("start_lsn", "end_lsn", "send_time")}, "payload": pa.array(columns["payload"], pa.binary()),
            })
            os.makedirs(self.path, exist_ok=True)
            name = f"{self.client.options.slot}-{self.seq:020d}.parquet"
            hidden = os.path.join(self.path, f".{name}.tmp")
            pq.write_table(table, hidden, compression="zstd")
            os.replace(hidden, os.path.join(self.path, name))
            self.seq += n
            self.client.confirm(max(columns["end_lsn"]))
            self.held.clear()
        return n

    def run(self) -> int:
        """Records until the stream ends; returns the number of frames written."""
        done, since = 0, time.monotonic()
        for frame in self.client.frames():
            if frame is not None:
                self.held.append(frame)
            if len(self.held) >= self.rows or (self.held and time.monotonic() - since >= self.seconds):
                done += self.flush()
                since = time.monotonic()
        done += self.flush()
        return done


def next_seq(path: str, slot: str) -> int:
    """The first number that recorded files of the slot do not have yet."""
    import pyarrow.parquet as pq

    names = sorted(n for n in (os.listdir(path) if os.path.isdir(path) else []) if n.startswith(f"{slot}-") and n.endswith(".parquet"))
    return int(names[-1][len(slot) + 1 : -8]) + pq.read_metadata(os.path.join(path, names[-1])).num_rows if names else 0
