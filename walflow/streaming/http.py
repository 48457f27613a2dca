"""The `walflow_http` data sink: output rows as JSON lines in INSERT requests over HTTP.

Options: `url`, `database`, `table`, `user`, `password`, `compression` (gzip, on by default), `batch_size` rows a
request, `retries` with doubling waits of `backoff` seconds, `timeout`. Every task posts its rows in turn, so at most
as many requests are under way as there are tasks (see `uploads`). A request carries a token of its batch, task and
number; a server that drops repeated tokens then stores each row once, however often a task runs again.
"""

from __future__ import annotations

import gzip
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from walflow.errors import SinkError

UPLOADS = 4


@dataclass
class Sent(WriterCommitMessage):
    """What a task has sent."""

    batches: int = 0
    events: int = 0
    bytes: int = 0
    errors: int = 0


class Poster:
    """Requests to one table; `stats` counts them."""

    def __init__(self, options: dict):
        self.url = options["url"].rstrip("/") + "/"
        self.into = f"{options.get('database', 'default')}.{options.get('table', 'walflow_changes')}"
        self.login = {k: options[k] for k in ("user", "password") if options.get(k)}
        self.gzip = str(options.get("compression", "true")).lower() != "false"
        self.size, self.retries = int(options.get("batch_size", "10000")), int(options.get("retries", "3"))
        self.backoff, self.timeout = float(options.get("backoff", "0.5")), float(options.get("timeout", "30"))
        self.stats = Sent()

    def execute(self, query: str, body: bytes = b"", token: str | None = None) -> str:
        """Posts a statement, again if the server fails or cannot be reached; its answer."""
        parameters = {"query": query, **self.login, **({"insert_deduplication_token": token} if token else {})}
        data = gzip.compress(body, 1) if self.gzip and body else body
        request = urllib.request.Request(f"{self.url}?{urllib.parse.urlencode(parameters)}", data=data, method="POST")
        if self.gzip and body:
            request.add_header("Content-Encoding", "gzip")
        for turn in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return answer.read().decode("utf-8", "replace")
            except urllib.error.HTTPError as e:
                self.stats.errors += 1
                why = f"status {e.code}: {e.read().decode('utf-8', 'replace')}"
                if e.code < 500 and e.code != 429:  # another try cannot help
                    break
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                self.stats.errors += 1
                why = str(e)
            if turn < self.retries:
                time.sleep(self.backoff * 2**turn)
        raise SinkError(f"Request failed with {why}")

    def insert(self, rows: list[dict], token: str) -> int:
        if not rows:
            return 0
        body = "".join(json.dumps(r, ensure_ascii=False, separators=(",", ":")) + "\n" for r in rows).encode()
        self.execute(f"INSERT INTO {self.into} FORMAT JSONEachRow", body, token)
        self.stats.batches += 1
        self.stats.events += len(rows)
        self.stats.bytes += len(body)
        return len(rows)

    def create_table(self) -> None:
        """The table of the output rows, if there is none."""
        self.execute(
            f"CREATE TABLE IF NOT EXISTS {self.into} (lsn UInt64, xid UInt64, op String, `table` String, data String, before Nullable(String), ts DateTime) "
            "ENGINE = MergeTree ORDER BY (lsn, xid) PARTITION BY toYYYYMM(ts)"
        )


class Buffer:
    """Rows held back until `size` of them have come or `seconds` have passed since the last request."""

    def __init__(self, poster: Poster, name: str, seconds: float = 0.1, clock=time.monotonic):
        self.poster, self.name, self.seconds, self.clock = poster, name, seconds, clock
        self.rows: list[dict] = []
        self.since, self.number = clock(), 0

    def due(self) -> bool:
        return bool(self.rows) and self.clock() - self.since >= self.seconds

    def add(self, rows: list[dict]) -> int:
        """The number of rows sent by now because of them."""
        self.rows += rows
        return self.flush() if len(self.rows) >= self.poster.size or self.due() else 0

    def flush(self) -> int:
        n = self.poster.insert(self.rows, f"{self.name}-{self.number}")
        self.rows, self.since, self.number = [], self.clock(), self.number + (n > 0)
        return n


class _Writer:
    def __init__(self, options, schema):
        self.options, self.names = dict(options), schema.names

    def _write(self, it, name: str) -> Sent:
        from pyspark import TaskContext

        poster = Poster(self.options)
        part = TaskContext.get().partitionId()
        held, number = [], 0
        for row in it:
            held.append({c: row[i].strftime("%Y-%m-%d %H:%M:%S") if c == "ts" and row[i] is not None else row[i] for i, c in enumerate(self.names)})
            if len(held) >= poster.size:
                poster.insert(held, f"{name}-{part}-{number}")
                held, number = [], number + 1
        poster.insert(held, f"{name}-{part}-{number}")
        return poster.stats


class _BatchWriter(_Writer, DataSourceWriter):
    def write(self, iterator):
        return self._write(iterator, self.options.get("batch", "batch"))


class _StreamWriter(_Writer, DataSourceStreamWriter):
    def write(self, iterator):
        return self._write(iterator, self.options.get("batch", "stream"))

    def commit(self, messages, batchId):
        self.sent = total(messages)

    def abort(self, messages, batchId): ...


def total(messages) -> Sent:
    out = Sent()
    for m in messages:
        for k in vars(out):
            setattr(out, k, getattr(out, k) + (getattr(m, k) if m is not None else 0))
    return out


class HttpSink(DataSource):
    @classmethod
    def name(cls):
        return "walflow_http"

    def schema(self):
        return "lsn long, xid long, op string, `table` string, data string, before string, ts timestamp"

    def writer(self, schema, overwrite):
        return _BatchWriter(self.options, schema)

    def streamWriter(self, schema, overwrite):
        return _StreamWriter(self.options, schema)


def post_changes(rows: DataFrame, batch_id: int, options: dict, uploads: int = UPLOADS) -> None:
    """Posts the output rows of a batch in up to `uploads` requests at a time; rows are dealt in a settled order, so a batch that runs again makes the same requests."""
    rows.sparkSession.dataSource.register(HttpSink)
    dealt = rows.repartition(uploads, "lsn", "xid").sortWithinPartitions("lsn", "xid")
    dealt.write.format("walflow_http").options(**options, batch=f"batch{batch_id}").mode("append").save()
