"""python -m walflow.cli run|record|replay|init-table"""

from __future__ import annotations

import argparse
import signal
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from walflow.config import Config
from walflow.metrics import Registry
from walflow.operators.sinks import init_table, to_sink_rows, write_changes
from walflow.sources.client import Client, Options, Recorder, next_seq
from walflow.sources.wal import WalSource, connection
from walflow.streaming.http import Poster, post_changes
from walflow.streaming.stream import replay, start_stream


def serve(port: int, query=None, registry: Registry | None = None) -> ThreadingHTTPServer:
    """/metrics, /health (is the query alive) and /ready (has it made progress)."""
    registry = registry or Registry()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            progress = (query.lastProgress or {}) if query else {}
            alive = query is None or query.isActive
            status, body = {
                "/metrics": (200, registry.text()),
                "/health": (200 if alive else 503, "OK" if alive else "stopped"),
                "/ready": (200 if query is None or progress else 503, "Ready" if query is None or progress else "starting"),
            }.get(self.path, (404, "not found"))
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args): ...

    server = ThreadingHTTPServer(("", port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def on_signals(action) -> None:
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, lambda *_: action())


def record(config: Config) -> int:
    """Records a live server's stream until it ends or a signal comes; what is held then is still written and confirmed."""
    client = Client(connection(config.source_url), Options(slot=config.slot, publication=config.publication, status_interval=config.status_interval_ms / 1000)).connect()
    try:
        client.start()
        on_signals(client.stop)
        n = Recorder(client, config.source_path, config.batch_size, config.batch_timeout_ms / 1000, next_seq(config.source_path, config.slot)).run()
        client.send_status()
        return n
    finally:
        client.close()


def parse(argv=None) -> tuple[str, Config]:
    parser = argparse.ArgumentParser(prog="walflow")
    parser.add_argument("command", choices=("run", "record", "replay", "init-table"))
    parser.add_argument("--config")
    for name in ("source-path", "source-url", "publication", "sink-path", "sink-url", "checkpoint-path", "dead-letter-path", "slot", "tables", "log-level"):
        parser.add_argument(f"--{name}")
    for name in ("slots", "batch-size", "batch-timeout-ms", "status-interval-ms", "metrics-port"):
        parser.add_argument(f"--{name}", type=int)
    args = vars(parser.parse_args(argv))
    command, file = args.pop("command"), args.pop("config")
    return command, Config.load(file, **args)


def main(argv=None) -> int:
    command, config = parse(argv)
    if command == "record":
        record(config)
        return 0
    spark = SparkSession.builder.appName("walflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel(config.log_level.upper())
    if command == "init-table":
        init_table(spark, "walflow_changes", config.sink_path)
        if config.sink_url:
            Poster({"url": config.sink_url}).create_table()
    elif command == "replay":
        write_changes(to_sink_rows(replay(spark.read.parquet(config.source_path)).events), config.sink_path)
    else:
        spark.dataSource.register(WalSource)
        options = {"path": config.source_path, "max_messages": config.batch_size, "checkpoint": config.checkpoint_path} | ({"slot": config.slot, "slots": config.slots} if config.slots > 1 else {})
        frames = spark.readStream.format("walflow_wal").options(**options).load()
        registry = Registry()
        post = (lambda rows, batch_id: post_changes(rows, batch_id, {"url": config.sink_url})) if config.sink_url else None
        query = start_stream(
            spark, frames, config.sink_path, config.checkpoint_path, config.dead_letter_path or None, {"processingTime": f"{config.batch_timeout_ms} milliseconds"},
            [t for t in config.tables.split(",") if t] or None, registry, post,
        )
        server = serve(config.metrics_port, query, registry)
        on_signals(query.stop)
        query.awaitTermination()
        server.shutdown()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
