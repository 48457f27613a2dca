"""The `walflow_slot` data source: a stream that polls a replication slot by SQL, for servers that only allow that.

Options: `url` (postgres://...), `slot`, `publication`, `page` (1,000 changes; a page ends with a transaction, so it
may hold more). Pages are peeked at and the slot is moved only in `commit`, after the batch has been written; a batch
that runs again peeks at the same changes. Pages go through the driver, so this suits small streams; larger ones are
recorded (`walflow.sources.client`) and read by `walflow_wal`.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from walflow.errors import ConnectionFailed
from walflow.sources.client import Client, Options, format_lsn, parse_lsn
from walflow.sources.wal import FRAME_SCHEMA, connection


class SlotReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.params = connection(options["url"])
        self.options = Options(slot=options.get("slot", "walflow"), publication=options.get("publication", "walflow"))
        self.page = int(options.get("page", "1000"))

    def _query(self, *statements: str) -> list[list[str | None]]:
        client = Client(self.params, self.options).connect()
        try:
            client.ensure_slot()
            return [client.query(s) for s in statements][-1]
        finally:
            client.close()

    def _peek(self, start: dict, upto: int | None) -> tuple[list[tuple], dict]:
        names = self.options.publication.replace("'", "''")
        until = "NULL" if upto is None else f"'{format_lsn(upto)}'"
        rows = self._query(f"SELECT lsn, data FROM pg_logical_slot_peek_binary_changes('{self.options.slot}', {until}, {self.page if upto is None else 'NULL'}, 'proto_version', '1', 'publication_names', '{names}')")
        found, end = [], dict(start)
        for lsn, data in ((parse_lsn(lsn), data) for lsn, data in rows):
            if lsn > start["lsn"] and (upto is None or lsn <= upto):
                found.append((self.options.slot, end["seq"], lsn, lsn, 0, bytes.fromhex(data.removeprefix("\\x"))))
                end = {"lsn": max(end["lsn"], lsn), "seq": end["seq"] + 1}
        return found, end

    def initialOffset(self):
        return {"lsn": 0, "seq": 0}

    def read(self, start):
        try:
            rows, end = self._peek(start, None)
        except ConnectionFailed as e:
            if "does not exist" not in str(e):
                raise
            rows, end = [], start  # the slot or the publication is to come: asked for again at the next trigger
        return iter(rows), end

    def readBetweenOffsets(self, start, end):
        return iter(self._peek(start, end["lsn"])[0])

    def commit(self, end):
        if end["lsn"]:
            self._query(f"SELECT pg_replication_slot_advance('{self.options.slot}', '{format_lsn(end['lsn'])}')")


class SlotSource(DataSource):
    @classmethod
    def name(cls):
        return "walflow_slot"

    def schema(self):
        return FRAME_SCHEMA

    def simpleStreamReader(self, schema):
        return SlotReader(self.options)
