"""Monotone positions and lag."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walflow.functions import lsn as L
from walflow.functions.wire import decode_checkpoint, encode_checkpoint


def running(df: DataFrame, columns: list[str], order: str = "seq") -> DataFrame:
    """Replaces each column by the greatest value seen so far in its slot."""
    seen = Window.partitionBy("slot").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.max(c).over(seen) for c in columns})


def positions(messages: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """received and processed per slot from the stream; confirmed from (slot, confirmed_lsn) rows."""
    out = messages.groupBy("slot").agg(F.max("start_lsn").alias("received_lsn"), F.coalesce(F.max("commit_lsn"), F.lit(0).cast("long")).alias("processed_lsn"))
    if confirmed is None:
        return out.withColumn("confirmed_lsn", F.lit(0).cast("long"))
    last = confirmed.groupBy("slot").agg(F.max("confirmed_lsn").alias("confirmed_lsn"))
    return out.join(last, "slot", "left").withColumn("confirmed_lsn", F.coalesce("confirmed_lsn", F.lit(0).cast("long")))


def lag(positions: DataFrame) -> DataFrame:
    return positions.withColumn("lag_bytes", L.minus(F.col("received_lsn"), F.col("confirmed_lsn")))


def tracker(updates: DataFrame) -> DataFrame:
    """write, flush and apply positions per slot; none of them ever moves back."""
    return updates.groupBy("slot").agg(*[F.max(c).alias(c) for c in ("write_lsn", "flush_lsn", "apply_lsn")])


def slot_checkpoints(rows: DataFrame) -> DataFrame:
    """The latest checkpoint of each slot."""
    return rows.groupBy("slot_name").agg(*[F.max_by(c, F.struct("last_flush_time", "confirmed_lsn")).alias(c) for c in ("confirmed_lsn", "flushed_rows", "last_flush_time")])


def confirmed_rows(checkpoints: DataFrame) -> DataFrame:
    """Per slot: all rows confirmed so far, and those of the last flush."""
    return checkpoints.groupBy("slot_name").agg(F.sum("flushed_rows").alias("total_rows"), F.max_by("flushed_rows", F.struct("last_flush_time", "confirmed_lsn")).alias("last_rows"))


class PositionStore:
    """Confirmed positions of slots in a folder: held in memory, written when `rows` have come since or `seconds` passed, or by force.

    A position never moves back. A file is replaced as a whole, so a crash leaves the old or the new one."""

    def __init__(self, path: str, rows: int = 100_000, seconds: float = 1.0, clock=time.monotonic):
        self.path, self.rows, self.seconds, self.clock = path, rows, seconds, clock
        os.makedirs(path, exist_ok=True)
        self.held: dict[str, tuple[int, int, int]] = {slot: (lsn, n, at) for slot, lsn, n, at in self.load_all()}
        self.pending, self.since = 0, clock()

    def _file(self, slot: str) -> str:
        return os.path.join(self.path, slot.encode().hex() + ".checkpoint")

    def confirmed(self, slot: str) -> int:
        return self.held.get(slot, (0, 0, 0))[0]

    def update(self, slot: str, lsn: int, rows: int = 0, at: int = 0, force: bool = False) -> bool:
        """Whether the positions were written."""
        old = self.held.get(slot, (0, 0, 0))
        self.held[slot] = (max(old[0], lsn), old[1] + rows, max(old[2], at))
        self.pending += rows
        if force or self.pending >= self.rows or self.clock() - self.since >= self.seconds:
            self.flush()
            return True
        return False

    def flush(self) -> None:
        for slot, (lsn, rows, at) in self.held.items():
            hidden = self._file(slot) + ".tmp"
            with open(hidden, "wb") as f:
                f.write(encode_checkpoint(slot, lsn, rows, at))
                f.flush()
                os.fsync(f.fileno())
            os.replace(hidden, self._file(slot))
        self.pending, self.since = 0, self.clock()

    def load(self, slot: str) -> tuple[str, int, int, int] | None:
        """(slot, lsn, rows, time) as written."""
        if not os.path.exists(self._file(slot)):
            return None
        with open(self._file(slot), "rb") as f:
            return decode_checkpoint(f.read())

    def load_all(self) -> list[tuple[str, int, int, int]]:
        names = sorted(n for n in os.listdir(self.path) if n.endswith(".checkpoint"))
        return [self.load(bytes.fromhex(n[: -len(".checkpoint")]).decode()) for n in names]

    def stats(self) -> dict:
        return {"slots": len(self.held), "rows": sum(x[1] for x in self.held.values()), "pending_rows": self.pending, "bytes": sum(os.path.getsize(os.path.join(self.path, n)) for n in os.listdir(self.path))}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.flush()
