"""Decoding of whole Arrow batches of messages: the bulk column-wise in numpy, what is rare or malformed by `wire.decode`.

Transaction control and row changes are read in lockstep: every step looks at one field (or one cell) of all messages of a
kind at once. A message that fails any check there, or is of another type, goes to the row-wise decoder, which alone knows
the errors, so both ways give the same fields.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from walflow.functions.wire import TAGS, decode

#: Tuples of more cells are decoded row by row, so that one odd message does not widen all of a batch.
WIDEST = 2000
_KEY, _OLD, _NEW = b"KON"
#: Offsets of the fixed-width messages behind the tag: field, offset, bytes. LSNs (8 bytes, named *_lsn) must be below 2**63.
_FIXED = {
    "B": (21, [("final_lsn", 1, 8), ("commit_time", 9, 8), ("xid", 17, 4)]),
    "C": (26, [("flags", 1, 1), ("commit_lsn", 2, 8), ("txn_end_lsn", 10, 8), ("commit_time", 18, 8)]),
    "S": (6, [("xid", 1, 4), ("first_segment", 5, 1)]),
    "E": (1, []),
    "c": (30, [("xid", 1, 4), ("flags", 5, 1), ("commit_lsn", 6, 8), ("txn_end_lsn", 14, 8), ("commit_time", 22, 8)]),
    "A": (9, [("xid", 1, 4), ("subxid", 5, 4)]),
}


def _number(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n big-endian bytes at each place, as signed 64-bit integers."""
    out = np.zeros(len(at), dtype=np.uint64)
    for i in range(n):
        out = (out << np.uint64(8)) | data[at + i].astype(np.uint64)
    return out.view(np.int64)


class _Tuples:
    """One tuple of each of some rows: where it ends, whether it is whole, and its cells in row order."""

    def __init__(self, data: np.ndarray, at: np.ndarray, end: np.ndarray):
        n = len(at)
        self.ok = at + 2 <= end
        count = np.where(self.ok, _number(data, np.where(self.ok, at, 0), 2) if n else 0, 0)
        self.ok &= count <= WIDEST
        count[~self.ok] = 0
        widest = int(count.max(initial=0))
        kinds, starts, lens = np.zeros((n, widest), np.uint8), np.zeros((n, widest), np.int64), np.zeros((n, widest), np.int64)
        self.end = at + 2
        for c in range(widest):
            rows = np.flatnonzero(self.ok & (c < count))
            p = self.end[rows]
            here = p < end[rows]
            kind = data[np.where(here, p, 0)]
            plain = (kind == 0x6E) | (kind == 0x75)  # n, u
            valued = (kind == 0x74) | (kind == 0x62)  # t, b
            sized = here & valued & (p + 5 <= end[rows])
            size = np.where(sized, _number(data, np.where(sized, p + 1, 0), 4), 0)
            good = here & (plain | (sized & (p + 5 + size <= end[rows])))
            self.ok[rows[~good]] = False
            kinds[rows, c], starts[rows, c], lens[rows, c] = kind, p + 5, size
            self.end[rows] = np.where(good, p + np.where(plain, 1, 5 + size), p)
        self.count, self.kinds, self.starts, self.lens = count, kinds, starts, lens

    def cells(self, data: np.ndarray, use: np.ndarray) -> pa.Array:
        """The cells of the rows `use`, as structs of fmt, text and bin."""
        picked = np.arange(self.kinds.shape[1]) < np.where(use, self.count, 0)[:, None]
        kind, start, size = self.kinds[picked], self.starts[picked], self.lens[picked]
        fmt = pa.StringArray.from_buffers(len(kind), pa.py_buffer(np.arange(len(kind) + 1, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(kind)))
        raw = _slices(data, start, size, kind == 0x74)
        try:
            text = raw.cast(pa.string())
        except pa.ArrowInvalid:
            text = pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
        return pa.StructArray.from_arrays([fmt, text, _slices(data, start, size, kind == 0x62)], ["fmt", "text", "bin"])


def _slices(data: np.ndarray, start: np.ndarray, size: np.ndarray, present: np.ndarray) -> pa.Array:
    """The bytes [start, start + size) where `present`, null elsewhere."""
    size = np.where(present, size, 0)
    ends = np.cumsum(size)
    if len(ends) and ends[-1] >= 1 << 31:
        raise ValueError("a batch holds over 2 GB: set spark.sql.execution.arrow.maxRecordsPerBatch")
    offsets = np.concatenate([[0], ends])
    flat = data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    valid = pa.py_buffer(np.packbits(present, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(size), [valid, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])


def _lists(n: int, rows: np.ndarray, tuples: list[tuple[np.ndarray, _Tuples, np.ndarray]], data: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of n rows from the tuples of some of them (null elsewhere)."""
    values, owners, counts = [], [], []
    for at, t, use in tuples:
        values.append(t.cells(data, use))
        owners.append(at[use])
        counts.append(t.count[use])
    if not values:
        return pa.nulls(n, kind)
    owner, count = np.concatenate(owners), np.concatenate(counts)
    packed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.concat_arrays(values)).cast(kind)
    place = np.full(n, -1)
    place[owner] = np.arange(len(owner))
    return packed.take(pa.array(place, pa.int64(), mask=place < 0))


def decode_batch(payloads: pa.Array, schema: pa.Schema) -> list[pa.Array]:
    """The fields of `schema` of each message."""
    payloads = payloads.cast(pa.large_binary())
    n = len(payloads)
    offsets = np.frombuffer(payloads.buffers()[1], np.int64, n + 1, payloads.offset * 8) if n else np.zeros(1, np.int64)
    buffer = payloads.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(1, np.uint8)
    start, end = offsets[:-1], offsets[1:]
    tag = np.where(end > start, data[np.minimum(start, len(data) - 1)], 0)
    if payloads.null_count:
        tag[~payloads.is_valid().to_numpy(zero_copy_only=False)] = 0
    slow = np.ones(n, dtype=bool)
    columns: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def put(name: str, rows: np.ndarray, values: np.ndarray) -> None:
        have, known = columns.setdefault(name, (np.zeros(n, np.int64), np.zeros(n, bool)))
        have[rows], known[rows] = values, True

    for letter, (least, fields) in _FIXED.items():
        rows = np.flatnonzero((tag == ord(letter)) & (end - start >= least))
        values = {name: _number(data, start[rows] + at, size) for name, at, size in fields}
        fits = np.ones(len(rows), dtype=bool)
        for name, x in values.items():
            if name.endswith("_lsn"):
                fits &= x >= 0
        for name, x in values.items():
            put(name, rows[fits], x[fits] == 1 if name == "first_segment" else x[fits])
        slow[rows[fits]] = False
    old, new = [], []
    marker = np.zeros(n, np.uint8)
    change = np.flatnonzero(np.isin(tag, list(b"IUD")) & (end - start >= 6))
    marker[change] = data[start[change] + 5]
    ids = np.zeros(n, np.int64)
    ids[change] = _number(data, start[change] + 1, 4)
    lone = change[((tag[change] != 0x44) & (marker[change] == _NEW)) | ((tag[change] == 0x44) & np.isin(marker[change], [_KEY, _OLD]))]
    both = change[(tag[change] == 0x55) & np.isin(marker[change], [_KEY, _OLD])]
    t = _Tuples(data, start[lone] + 6, end[lone])
    gone = tag[lone] == 0x44
    new.append((lone, t, t.ok & ~gone))
    old.append((lone, t, t.ok & gone))
    done = [lone[t.ok]]
    if len(both):
        first = _Tuples(data, start[both] + 6, end[both])
        more = first.ok & (first.end < end[both])
        more &= data[np.where(more, first.end, 0)] == _NEW
        second = _Tuples(data, np.where(more, first.end + 1, end[both]), end[both])
        whole = more & second.ok
        old.append((both, first, whole))
        new.append((both, second, whole))
        done.append(both[whole])
    done = np.concatenate(done)
    slow[done] = False
    put("relation_id", done, ids[done])
    put("key_only", done[tag[done] == 0x44], marker[done[tag[done] == 0x44]] == _KEY)
    rows_with_old = done[marker[done] != _NEW]
    rest = np.flatnonzero(slow)
    odd = [decode(payloads[int(i)].as_py()) for i in rest]
    fast = np.flatnonzero(~slow)
    order = np.empty(n, np.int64)
    order[fast], order[rest] = np.arange(len(fast)), len(fast) + np.arange(len(rest))
    names = np.array([TAGS.get(chr(i)) for i in range(256)], dtype=object)
    out = []
    for field in schema:
        if field.name in ("old_tuple", "new_tuple"):
            column = _lists(n, fast, old if field.name == "old_tuple" else new, data, field.type)
        elif field.name == "msg_type":
            column = pa.DictionaryArray.from_arrays(pa.array(tag.astype(np.int32)), pa.array(names, pa.string())).cast(field.type)
        elif field.name == "old_kind":
            has = np.zeros(n, bool)
            has[rows_with_old] = True
            column = pa.DictionaryArray.from_arrays(pa.array((marker == _KEY).astype(np.int32), mask=~has), pa.array(["O", "K"])).cast(field.type)
        elif field.name in columns:
            have, known = columns[field.name]
            column = pa.array(have, mask=~known).cast(field.type)
        else:
            column = pa.nulls(n, field.type)
        if len(rest):
            slow_ones = pa.array([r.get(field.name) for r in odd], field.type)
            column = pa.concat_arrays([column.take(pa.array(fast)), slow_ones]).take(pa.array(order))
        out.append(column)
    return out
