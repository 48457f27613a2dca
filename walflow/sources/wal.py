"""The `walflow_wal` data source: recorded frames as a batch or a stream.

Option `path`: a folder of parquet files with slot, seq, start_lsn, end_lsn, send_time and payload that the
driver and all executors can read, by a path or a URI that pyarrow knows; `slot`: a base slot name and
`slots`: how many (default: all there are); `start_lsn`: frames before it are left out; `max_messages`:
admission limit of a micro-batch, over all slots; `checkpoint`: the query's checkpoint folder, from which a
restarted reader learns where it stood (the engine does not tell it).

Offsets are {slot: last seq}. A micro-batch may end anywhere: transactions that stay open are state of the
query (`walflow.streaming.stream`), not of the source. Plans come from the files' statistics, read once a
file: neither a trigger nor a plan reads a payload, and the places looked up are those after the last offset.
"""

from __future__ import annotations

import json
from urllib.parse import unquote, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from walflow.sources.client import error_message, password_digest, slot_names  # noqa: F401  (part of this module's interface)

FRAME_SCHEMA = "slot string, seq long, start_lsn long, end_lsn long, send_time long, payload binary"
_COLUMNS = ["slot", "seq", "start_lsn", "end_lsn", "send_time", "payload"]
#: Rows of a partition, roughly: row groups are read whole.
PART_ROWS = 200_000


def connection(url: str) -> dict:
    """Host, port, user, password and database of a postgres URL, with the usual defaults."""
    u = urlsplit(url)
    return {"host": u.hostname or "localhost", "port": u.port or 5432, "user": unquote(u.username or "postgres"), "password": unquote(u.password or ""), "database": u.path.lstrip("/") or "postgres"}


def _store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Part(InputPartition):
    """Row groups (file, number), of which the rows in the ranges {slot: (after, up to)} count."""

    def __init__(self, groups: list[tuple[str, int]], ranges: dict[str, tuple[int, int]]):
        self.groups, self.ranges = groups, ranges


class Log:
    """The recorded files' row groups with their least and greatest seq."""

    def __init__(self, options):
        self.path, self.start = options["path"], int(options.get("start_lsn", "0"))
        self.names = slot_names(options["slot"], int(options.get("slots", "1"))) if options.get("slot") else None
        self.known: dict[str, list[tuple[int, int, int, int]]] = {}

    def groups(self) -> list[tuple[int, int, int, str, int]]:
        """(least seq, greatest seq, rows, file, number) of all row groups there are now; files are looked into once."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        out = []
        for info in found:
            name = info.base_name
            if info.type != fs.FileType.File or not name.endswith(".parquet") or name[0] in "._":
                continue
            if info.path not in self.known:
                with store.open_input_file(info.path) as f:
                    meta = pq.ParquetFile(f).metadata
                    place = meta.schema.names.index("seq")
                    rows = []
                    for g in range(meta.num_row_groups):
                        column = meta.row_group(g).column(place)
                        if meta.row_group(g).num_rows:
                            rows.append((column.statistics.min, column.statistics.max, meta.row_group(g).num_rows, g))
                    self.known[info.path] = rows
            out += [(lo, hi, n, info.path, g) for lo, hi, n, g in self.known[info.path]]
        return sorted(out)

    def heads(self, groups, after: dict[str, int]):
        """{slot: sorted seqs} of row groups, of the slots wanted and later than `after`."""
        import numpy as np
        import pyarrow.parquet as pq

        store, _ = _store(self.path)
        found: dict[str, list] = {}
        for _, _, _, name, g in groups:
            with store.open_input_file(name) as f:
                table = pq.ParquetFile(f).read_row_group(g, columns=["slot", "seq"])
            slots, seqs = table.column("slot").combine_chunks().dictionary_encode(), table.column("seq").to_numpy()
            codes = slots.indices.to_numpy(zero_copy_only=False)
            for k, slot in enumerate(slots.dictionary.to_pylist()):
                if self.names is None or slot in self.names:
                    own = seqs[codes == k]
                    found.setdefault(slot, []).append(own[own > after.get(slot, -1)])
        return {slot: np.sort(np.concatenate(x)) for slot, x in found.items()}

    def ahead(self, at: dict[str, int], most: int) -> dict[str, int]:
        """The offset after up to `most` more frames, in order of seq across the slots."""
        import numpy as np

        least = min((at.get(s, -1) for s in self.names), default=-1) if self.names else -1
        open_ = [g for g in self.groups() if g[1] > least]
        k = total = 0
        while k < len(open_) and total < most:
            total += open_[k][2]
            k += 1
        while True:
            heads = self.heads(open_[:k], at)
            every = np.sort(np.concatenate([*heads.values(), np.zeros(0, np.int64)]))
            border = every[min(most, len(every)) - 1] if len(every) else None
            more = k
            if len(every) < most:
                more = min(len(open_), 2 * k + 1)
            while more < len(open_) and len(every) >= most and open_[more][0] <= border:
                more += 1
            if more == k:
                break
            k = more
        out = dict(at)
        if border is not None:
            for slot, seqs in heads.items():
                upto = seqs[seqs <= border]
                if len(upto):
                    out[slot] = int(upto[-1])
        return out

    def parts(self, ranges: dict[str, tuple[int, int]]) -> list[Part]:
        out, held, rows = [], [], 0
        for lo, hi, n, name, g in self.groups():
            if any(hi > a and lo <= b for a, b in ranges.values()):
                held.append((name, g))
                rows += n
                if rows >= PART_ROWS:
                    out.append(Part(held, ranges))
                    held, rows = [], 0
        return out + ([Part(held, ranges)] if held else [])

    def rows(self, part: Part):
        """Record batches of a partition."""
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        store, _ = _store(self.path)
        schema = pa.schema([("slot", pa.string()), *[(c, pa.int64()) for c in _COLUMNS[1:5]], ("payload", pa.binary())])
        for name, g in part.groups:
            with store.open_input_file(name) as f:
                table = pq.ParquetFile(f).read_row_group(g, columns=_COLUMNS)
            keep = pc.greater_equal(table["start_lsn"], self.start)
            if part.ranges:
                inside = None
                for slot, (a, b) in part.ranges.items():
                    one = pc.and_(pc.equal(table["slot"], slot), pc.and_(pc.greater(table["seq"], a), pc.less_equal(table["seq"], b)))
                    inside = one if inside is None else pc.or_(inside, one)
                keep = pc.and_(keep, inside)
            elif self.names is not None:
                keep = pc.and_(keep, pc.is_in(table["slot"], pa.array(self.names)))
            yield from table.filter(keep).select(_COLUMNS).cast(schema).to_batches(max_chunksize=10_000)


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.log = Log(options)

    def partitions(self):
        out, held, rows = [], [], 0
        for _, _, n, name, g in self.log.groups():
            held.append((name, g))
            rows += n
            if rows >= PART_ROWS:
                out.append(Part(held, {}))
                held, rows = [], 0
        return out + ([Part(held, {})] if held else [])

    def read(self, part: Part):
        return self.log.rows(part)


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.log, self.most = Log(options), int(options.get("max_messages", "100000"))
        self.at: dict[str, int] = last_offset(options["checkpoint"]) if options.get("checkpoint") else {}
        self.acknowledged: dict[str, int] = {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        self.at = self.log.ahead(self.at, self.most)
        return self.at

    def partitions(self, start, end):
        ranges = {slot: (start.get(slot, -1), upto) for slot, upto in end.items() if upto > start.get(slot, -1)}
        return self.log.parts(ranges) if ranges else []

    def read(self, part: Part):
        return self.log.rows(part)

    def commit(self, end):
        """Called once a batch has been written; a recorded log has nobody to tell."""
        self.acknowledged = end


def last_offset(checkpoint: str) -> dict[str, int]:
    """The offset of the last micro-batch that a query with this checkpoint folder planned; empty if none."""
    from pyarrow import fs

    store, root = _store(checkpoint)
    names = [i.path for i in store.get_file_info(fs.FileSelector(f"{root.rstrip('/')}/offsets", allow_not_found=True)) if i.base_name.isdigit()]
    if not names:
        return {}
    with store.open_input_stream(max(names, key=lambda n: int(n.rsplit("/", 1)[-1]))) as f:
        last = f.read().decode().strip().splitlines()[-1]
    return json.loads(last) if last.startswith("{") else {}


class WalSource(DataSource):
    @classmethod
    def name(cls):
        return "walflow_wal"

    def schema(self):
        return FRAME_SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)
