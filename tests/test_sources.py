"""The live client against a server on a socket, polling, the recorded source, the HTTP sink, metrics, positions, command line."""

import gzip
import json
import socket
import struct
import threading
import urllib.parse
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pyarrow.parquet as pq
import pytest

from walflow import cli
from walflow.config import Config
from walflow.errors import AuthError, ConfigError, ConnectionFailed, ParseError, SinkError
from walflow.functions import wire as w
from walflow.metrics import METRICS, Registry, Throughput
from walflow.operators.positions import PositionStore
from walflow.sources import client as c
from walflow.sources.slot import SlotReader
from walflow.sources.wal import Log, connection, last_offset
from walflow.streaming.http import Buffer, Poster, post_changes


class Server(threading.Thread):
    """A server that speaks just enough: authentication of one kind, catalog queries, one copy stream."""

    def __init__(self, auth=0, frames=(), slot_lsn=None, slots=(), changes=(), password="secret"):
        super().__init__(daemon=True)
        self.listener = socket.create_server(("127.0.0.1", 0))
        self.port = self.listener.getsockname()[1]
        self.auth, self.frames, self.slot_lsn, self.slots, self.changes, self.password = auth, frames, slot_lsn, list(slots), changes, password
        self.queries, self.status, self.startup, self.advanced = [], [], {}, None
        self.start()

    def run(self):
        while True:
            try:
                s, _ = self.listener.accept()
            except OSError:
                return
            threading.Thread(target=self.serve, args=(s,), daemon=True).start()

    def serve(self, s):
        f = s.makefile("rwb")

        def send(kind, body=b""):
            f.write(kind + struct.pack(">i", len(body) + 4) + body)
            f.flush()

        def receive():
            kind = f.read(1)
            return (kind, f.read(struct.unpack(">i", f.read(4))[0] - 4)) if kind else (b"", b"")

        def row(*cells):
            send(b"D", struct.pack(">H", len(cells)) + b"".join(struct.pack(">i", -1) if x is None else struct.pack(">i", len(x)) + x.encode() for x in cells))

        body = f.read(struct.unpack(">i", f.read(4))[0] - 4)
        parts = body[4:].split(b"\0")
        self.startup = {"version": struct.unpack(">i", body[:4])[0], **{k.decode(): v.decode() for k, v in zip(parts[::2], parts[1::2]) if k}}
        if self.auth:
            send(b"R", struct.pack(">i", self.auth) + (b"salt" if self.auth == 5 else b""))
            if self.auth in (3, 5):
                answer = receive()[1].rstrip(b"\0").decode()
                if answer != (self.password if self.auth == 3 else c.password_digest("me", self.password, b"salt")):
                    send(b"E", b"SFATAL\0Mpassword authentication failed\0\0")
                    return s.close()
        send(b"R", struct.pack(">i", 0))
        send(b"S", b"server_version\x0016\0")
        send(b"K", bytes(8))
        send(b"Z", b"I")
        while True:
            kind, body = receive()
            if kind in (b"", b"X"):
                return s.close()
            if kind == b"d":
                self.status.append(struct.unpack(">QQQqB", body[1:]))
                continue
            q = body.rstrip(b"\0").decode()
            self.queries.append(q)
            if "START_REPLICATION" in q:
                send(b"W", b"\0\0\0")
                for frame in self.frames:
                    send(b"d", frame)
                    if frame[:1] == b"k" and frame[17]:
                        self.status.append(struct.unpack(">QQQqB", receive()[1][1:]))
                send(b"c")
                continue
            if "CREATE_REPLICATION_SLOT" in q:
                self.slots.append(q.split()[1])
            elif "SELECT slot_name" in q:
                for name in self.slots:
                    if f"'{name}'" in q:
                        row(name)
            elif "confirmed_flush_lsn" in q:
                row(self.slot_lsn)
            elif "peek_binary" in q:
                if not self.changes:
                    send(b"E", b'SERROR\0Mpublication "p" does not exist\0\0')
                for lsn, data in self.changes:
                    if self.advanced is None or c.parse_lsn(lsn) > c.parse_lsn(self.advanced):
                        row(lsn, "\\x" + data.hex())
            elif "advance" in q:
                self.advanced = q.split("'")[3]
            elif "bad" in q:
                send(b"E", b"SERROR\0Msyntax error\0\0")
            send(b"Z", b"I")

    def client(self, **options):
        return c.Client({"host": "127.0.0.1", "port": self.port, "user": "me", "password": "secret", "database": "db"}, c.Options(**{"slot": "s", "timeout": 5, **options}))


@pytest.mark.parametrize("auth", [0, 3, 5])
def test_handshake_and_authentication(auth):
    server = Server(auth)
    client = server.client().connect()
    assert server.startup == {"version": 196608, "user": "me", "database": "db", "replication": "database", "client_encoding": "UTF8"}
    assert client.query("SELECT confirmed_flush_lsn") == [[None]]
    with pytest.raises(ConnectionFailed, match="syntax error"):
        client.query("bad")
    assert client.query("SELECT confirmed_flush_lsn") == [[None]]  # the connection goes on after an error
    client.close()


def test_refused_logins():
    for auth, text in ((10, "SASL"), (7, "Unsupported")):
        with pytest.raises(AuthError, match=text):
            Server(auth).client().connect()
    with pytest.raises(ConnectionFailed, match="password authentication failed"):
        Server(5, password="other").client().connect()
    client = Server(5).client()
    client.params["password"] = ""
    with pytest.raises(AuthError, match="Password required"):
        client.connect()
    assert c.error_message(b"SERROR\0C42601\0Mwrong\0\0") == "wrong" and c.error_message(b"SERROR\0\0") == "unknown error"
    assert c.password_digest("user", "pass", b"\1\2\3\4") == "md5" + __import__("hashlib").md5(__import__("hashlib").md5(b"passuser").hexdigest().encode() + b"\1\2\3\4").hexdigest()


def test_slot_and_start_position():
    server = Server(slot_lsn="1/A0")
    client = server.client(publication="it's").connect()
    assert client.start() == 0x1000000A0
    assert server.queries[1] == "CREATE_REPLICATION_SLOT s LOGICAL pgoutput NOEXPORT_SNAPSHOT"
    assert server.queries[-1] == "START_REPLICATION SLOT s LOGICAL 1/A0 (proto_version '1', publication_names 'it''s')"
    assert server.client(start_lsn=5).connect().start() == 5 and "LOGICAL 0/5" in server.queries[-1]
    assert sum("CREATE" in q for q in server.queries) == 1
    with pytest.raises(ConnectionFailed, match="does not exist"):
        Server().client(create_slot=False).connect().start()
    with pytest.raises(ConnectionFailed, match="slot name"):
        Server().client(slot="s'; DROP").connect().start()


def test_frames_status_and_recording(tmp_path):
    sent = [w.xlog_data(16, 20, w.begin(1)), b"?odd", b"w12", w.keepalive(40, reply=True), w.xlog_data(24, 44, w.commit(24, 44)), w.keepalive(50)]
    server = Server(frames=sent)
    client = server.client().connect()
    client.start()
    recorder = c.Recorder(client, str(tmp_path / "log"), rows=1, seq=c.next_seq(str(tmp_path / "log"), "s"))
    assert recorder.run() == 2
    assert server.status[0][:3] == (40, 20, 20)  # written as far as the keepalive says, flushed only what is on disk
    assert (client.tracker.write, client.tracker.flush) == (50, 44)
    assert vars(client.statistics.reset()) | {"nanoseconds": 0} == {"messages": 6, "xlog": 2, "keepalives": 2, "bytes": sum(map(len, sent)), "errors": 2, "nanoseconds": 0} and client.statistics.messages == 0
    rows = pq.read_table(str(tmp_path / "log")).to_pylist()
    assert sorted((r["slot"], r["seq"], r["start_lsn"], r["end_lsn"]) for r in rows) == [("s", 0, 16, 20), ("s", 1, 24, 44)]
    assert c.next_seq(str(tmp_path / "log"), "s") == 2
    for bad in (b"", b"w", b"kk", b"z"):
        with pytest.raises(ParseError):
            c.decode_frame(bad)
    with pytest.raises(ParseError):
        c.parse_lsn("1-2")


def test_tracker_never_goes_back():
    t = c.Tracker(10)
    t.update(100, 50, 20)
    t.update(90, 60, 5)
    assert (t.write, t.flush, t.apply) == (100, 60, 20)


def test_polling_acknowledges_after_the_batch():
    changes = [("0/10", w.begin(1)), ("0/18", w.insert(5, ["1"])), ("0/20", w.commit(32, 33))]
    server = Server(changes=changes, slots=["s"])
    reader = SlotReader({"url": f"postgres://me:secret@127.0.0.1:{server.port}/db", "slot": "s"})
    rows, end = reader.read(reader.initialOffset())
    rows = list(rows)
    assert [r[1:3] for r in rows] == [(0, 16), (1, 24), (2, 32)] and end == {"lsn": 32, "seq": 3} and server.advanced is None
    assert list(reader.readBetweenOffsets({"lsn": 0, "seq": 0}, end)) == rows
    assert list(reader.read(end)[0]) == []
    reader.commit(end)
    assert server.advanced == "0/20" and "NULL, 1000" in next(q for q in server.queries if "peek" in q)
    empty, same = SlotReader({"url": f"postgres://me:secret@127.0.0.1:{Server(slots=['s']).port}/db", "slot": "s"}).read(end)
    assert list(empty) == [] and same == end


def test_log_offsets(spark, tmp_path):
    rows = [(s, i, 100 + i, 101 + i, 0, bytes([i])) for i in range(60) for s in ("a", "b") if i % 3 or s == "a"]
    frame = spark.createDataFrame(rows, "slot string, seq long, start_lsn long, end_lsn long, send_time long, payload binary")
    frame.repartition(5, "payload").write.parquet(str(tmp_path / "log"))
    log, at, seen = Log({"path": str(tmp_path / "log")}), {}, []
    while (end := log.ahead(at, 7)) != at:
        ranges = {s: (at.get(s, -1), b) for s, b in end.items() if b > at.get(s, -1)}
        got = [(r["slot"], r["seq"]) for p in log.parts(ranges) for batch in log.rows(p) for r in batch.to_pylist()]
        assert 0 < len(got) <= 8
        seen += got
        at = end
    assert sorted(seen) == sorted((r[0], r[1]) for r in rows)
    assert Log({"path": str(tmp_path / "none")}).ahead({}, 5) == {}
    assert last_offset(str(tmp_path / "none")) == {}
    one = Log({"path": str(tmp_path / "log"), "slot": "b", "start_lsn": "150"})
    assert {r["slot"] for p in one.parts({"b": (-1, 99)}) for x in one.rows(p) for r in x.to_pylist()} == {"b"}


class Sink:
    """An HTTP server that stores what is posted; `answers` are the first statuses it gives."""

    def __init__(self, answers=()):
        self.answers, self.posts = list(answers), []
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = self.rfile.read(int(self.headers.get("Content-Length", 0)))
                body = gzip.decompress(body) if self.headers.get("Content-Encoding") == "gzip" else body
                status = outer.answers.pop(0) if outer.answers else 200
                if status == 200:
                    outer.posts.append((dict(urllib.parse.parse_qsl(self.path.partition("?")[2])), body.decode()))
                self.send_response(status)
                self.end_headers()
                self.wfile.write(b"answer")

            def log_message(self, *args): ...

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}"


def test_http_requests_and_retries():
    sink = Sink([500, 429])
    poster = Poster({"url": sink.url, "database": "d", "table": "t", "user": "u", "backoff": "0"})
    assert poster.insert([{"lsn": 1, "before": None, "data": "é"}], "x-1") == 1 and poster.insert([], "x-2") == 0
    query, body = sink.posts[0]
    assert query == {"query": "INSERT INTO d.t FORMAT JSONEachRow", "user": "u", "insert_deduplication_token": "x-1"} and body == '{"lsn":1,"before":null,"data":"é"}\n'
    assert (poster.stats.batches, poster.stats.events, poster.stats.bytes, poster.stats.errors) == (1, 1, len(body.encode()), 2)
    assert poster.execute("SELECT 1") == "answer"
    poster.create_table()
    assert "CREATE TABLE IF NOT EXISTS d.t" in sink.posts[-1][0]["query"]
    with pytest.raises(SinkError, match="status 400"):
        Poster({"url": Sink([400]).url, "backoff": "0"}).insert([{}], "y")
    with pytest.raises(SinkError):
        Poster({"url": "http://127.0.0.1:9", "backoff": "0", "retries": "1"}).execute("x")


def test_http_buffer():
    sink, now = Sink(), [0.0]
    buffer = Buffer(Poster({"url": sink.url, "batch_size": "3"}), "b", 1.0, lambda: now[0])
    assert buffer.add([{"a": 1}]) == 0 and not buffer.due() and buffer.add([{"a": 2}, {"a": 3}]) == 3 and buffer.flush() == 0
    buffer.add([{"a": 4}])
    now[0] = 2.0
    assert buffer.due() and buffer.flush() == 1 and len(sink.posts) == 2


def test_http_from_spark(spark):
    sink = Sink()
    rows = spark.sql("SELECT id AS lsn, id % 5 AS xid, 'INSERT' AS op, 't' AS `table`, '{}' AS data, CAST(NULL AS STRING) AS before, TIMESTAMP'2024-01-02 03:04:05' AS ts FROM range(50)")
    post_changes(rows, 3, {"url": sink.url, "batch_size": "10"})
    got = [json.loads(line) for _, body in sink.posts for line in body.splitlines()]
    assert sorted(r["lsn"] for r in got) == list(range(50)) and got[0]["ts"] == "2024-01-02 03:04:05" and got[0]["before"] is None
    tokens = {q["insert_deduplication_token"] for q, _ in sink.posts}
    assert len(tokens) == len(sink.posts) and all(t.startswith("batch3-") for t in tokens)
    before = {(q["insert_deduplication_token"], body) for q, body in sink.posts}
    sink.posts.clear()
    post_changes(rows, 3, {"url": sink.url, "batch_size": "10"})
    assert {(q["insert_deduplication_token"], body) for q, body in sink.posts} == before  # again: the same requests


def test_positions_store(tmp_path):
    now = [0.0]
    with PositionStore(str(tmp_path), rows=10, seconds=5, clock=lambda: now[0]) as store:
        assert not store.update("a/é", 100, 4, 1) and store.load("a/é") is None and store.confirmed("a/é") == 100
        assert store.update("a/é", 90, 6, 2) and store.load("a/é") == ("a/é", 100, 10, 2)  # by rows; a position never moves back
        now[0] = 6.0
        assert store.update("b", 1, 0) and not store.update("b", 2, 1) and store.update("b", 3, 1, force=True)
        store.update("b", 4, 1)
        assert store.stats()["pending_rows"] == 1
    again = PositionStore(str(tmp_path))
    assert [x[:3] for x in again.load_all()] == [("a/é", 100, 10), ("b", 4, 3)] and again.confirmed("none") == 0


def test_registry_and_endpoints():
    now = [0.0]
    registry = Registry(lambda: now[0])
    registry.add("events_received_total", 3, slot="s", type="insert")
    registry.set("lag_bytes", 7, slot="s")
    registry.observe("batch_latency_seconds", 0.02, sink="http")
    registry.observe("parse_latency_seconds", 1e-5, message_type="insert")
    text = registry.text()
    assert 'walflow_events_received_total{slot="s",type="insert"} 3' in text and 'walflow_lag_bytes{slot="s"} 7' in text
    assert 'walflow_batch_latency_seconds_bucket{sink="http",le="0.01"} 0' in text and 'walflow_batch_latency_seconds_bucket{sink="http",le="0.025"} 1' in text and 'walflow_batch_latency_seconds_count{sink="http"} 1' in text
    assert len(METRICS) == 12
    rate = Throughput(0.0)
    assert rate.add(10, 0.5) == 0 and rate.add(10, 2.0) == 10 and rate.add(5, 2.5) == 10
    server = cli.serve(0, None, registry)
    get = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}{path}").read().decode()
    assert get("/health") == "OK" and get("/ready") == "Ready" and "lag_bytes" in get("/metrics")
    with pytest.raises(urllib.error.HTTPError):
        get("/other")
    server.shutdown()


def test_config_and_command_line(tmp_path):
    file = tmp_path / "c.toml"
    file.write_text('slot = "a"\nslots = 2\nbatch_size = 5\n')
    config = Config.load(str(file), {"WALFLOW_SLOTS": "3"}, batch_size=7, log_level=None)
    assert (config.slot, config.slots, config.batch_size, config.metrics_port) == ("a", 3, 7, 9090)
    with pytest.raises(ConfigError):
        Config.load(None, {"WALFLOW_SLOTS": "x"})
    file.write_text("nonsense = 1\n")
    with pytest.raises(ConfigError):
        Config.load(str(file), {})
    command, config = cli.parse(["record", "--source-url", "postgres://h/d", "--slot", "z", "--batch-size", "9"])
    assert command == "record" and (config.source_url, config.slot, config.batch_size) == ("postgres://h/d", "z", 9)
    assert connection(config.source_url)["host"] == "h"


def test_record_command(tmp_path, monkeypatch):
    server = Server(auth=5, frames=[w.xlog_data(16, 20, w.begin(1)), w.xlog_data(24, 44, w.commit(24, 44))])
    monkeypatch.setattr(cli, "on_signals", lambda action: None)
    assert cli.main(["record", "--source-url", f"postgres://me:secret@127.0.0.1:{server.port}/db", "--slot", "s", "--source-path", str(tmp_path / "log")]) == 0
    assert pq.read_table(str(tmp_path / "log")).num_rows == 2
