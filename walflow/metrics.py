"""Metrics as DataFrames and as text exposition."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walflow.operators.parse import message_type

#: Metric names with their kind and labels.
METRICS = {
    "events_received_total": ("counter", ("slot", "type")), "events_flushed_total": ("counter", ("table",)), "transactions_committed_total": ("counter", ("slot",)),
    "confirmed_lsn": ("gauge", ()), "lag_bytes": ("gauge", ("slot",)), "buffer_size": ("gauge", ()), "commit_queue_size": ("gauge", ()), "throughput_rows_per_sec": ("gauge", ()),
    "batch_latency_seconds": ("histogram", ("sink",)), "parse_latency_seconds": ("histogram", ("message_type",)), "active_connections": ("gauge", ("type",)), "errors_total": ("counter", ("type",)),
}
#: Upper bounds of the latency histograms in seconds.
BATCH_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
PARSE_BUCKETS = (0.00001, 0.00005, 0.0001, 0.0005, 0.001, 0.005, 0.01)


def events_received(messages: DataFrame) -> DataFrame:
    return messages.groupBy("slot", F.coalesce("msg_type", F.lit("error")).alias("type")).agg(F.count("*").alias("value"))


def decoder_statistics(frames: DataFrame) -> DataFrame:
    """Messages, bytes and malformed messages (by tag) of each slot."""
    kind = message_type(F.col("payload"))
    return frames.groupBy("slot").agg(F.count("*").alias("messages"), F.sum(F.octet_length("payload")).alias("bytes"), F.count_if(kind.isNull()).alias("errors"))


def histogram(df: DataFrame, value: str, bounds) -> DataFrame:
    """Cumulative counts per upper bound."""
    sums = df.agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("inf"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("inf").alias("n")))
    return sums.select(F.inline(rows))


def throughput(events: DataFrame, width: str = "1 second") -> DataFrame:
    """Rows per tumbling window of commit time."""
    return events.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("rows")).select(F.col("w.start").alias("start"), "rows")


def exposition(values: dict[str, list[tuple[dict, float]]], prefix: str = "walflow") -> str:
    """Text format: name{label="value"} number, with TYPE lines."""
    lines = []
    for name, samples in values.items():
        lines.append(f"# TYPE {prefix}_{name} {METRICS[name][0]}")
        for labels, number in samples:
            inner = ",".join(f'{k}="{v}"' for k, v in labels.items())
            lines.append(f"{prefix}_{name}{'{' + inner + '}' if inner else ''} {number:g}")
    return "\n".join(lines) + "\n"


def flushed_by_table(events: DataFrame) -> DataFrame:
    return events.groupBy("table").agg(F.count("*").alias("value"))


def committed_by_slot(events: DataFrame) -> DataFrame:
    """Transactions with events, per slot."""
    return events.select("slot", "txn_instance", "xid").distinct().groupBy("slot").agg(F.count("*").alias("value"))


class Throughput:
    """Rows per second, recomputed when at least a second has passed."""

    def __init__(self, now: float):
        self.at, self.rows, self.rate = now, 0, 0.0

    def add(self, rows: int, now: float) -> float:
        self.rows += rows
        if now - self.at >= 1:
            self.rate, self.at, self.rows = self.rows / (now - self.at), now, 0
        return self.rate


class Registry:
    """The values of all metrics of this process, fed by micro-batches and by callers; safe to read from other threads."""

    def __init__(self, now=time.time):
        self.lock, self.now = threading.Lock(), now
        self.values: dict[str, dict[tuple, float]] = {name: {} for name in METRICS}
        self.spread: dict[str, dict[tuple, list[float]]] = {name: {} for name, (kind, _) in METRICS.items() if kind == "histogram"}
        self.rate = Throughput(now())

    def add(self, name: str, value: float = 1, **labels) -> None:
        with self.lock:
            key = tuple(labels[x] for x in METRICS[name][1])
            self.values[name][key] = self.values[name].get(key, 0) + value

    def set(self, name: str, value: float, **labels) -> None:
        with self.lock:
            self.values[name][tuple(labels[x] for x in METRICS[name][1])] = value

    def observe(self, name: str, value: float, **labels) -> None:
        """One more value of a histogram."""
        bounds = BATCH_BUCKETS if name == "batch_latency_seconds" else PARSE_BUCKETS
        with self.lock:
            counts = self.spread[name].setdefault(tuple(labels[x] for x in METRICS[name][1]), [0.0] * (len(bounds) + 2))
            for i, b in enumerate(bounds):
                counts[i] += value <= b
            counts[-2] += 1
            counts[-1] += value

    def batch(self, frames: DataFrame, done, summary: list, seconds: float) -> None:
        """What a micro-batch brought, its `summary` by slot and table; a few rows per slot, type and reason reach the driver."""
        typed = frames.withColumn("type", F.coalesce(message_type(F.col("payload")), F.lit("error")))
        reached: dict[str, int] = {}
        for r in typed.groupBy("slot", "type").agg(F.count("*").alias("value"), F.max("start_lsn").alias("lsn")).collect():
            reached[r.slot] = max(reached.get(r.slot, 0), r.lsn or 0)
            self.add("events_received_total", r.value, slot=r.slot, type=r.type)
        confirmed: dict[str, int] = {}
        for r in summary:
            confirmed[r.slot] = max(confirmed.get(r.slot, 0), r.commit_lsn)
            self.add("events_flushed_total", r.rows, table=r.table)
            self.add("transactions_committed_total", r.transactions, slot=r.slot)
        waiting = 0
        for r in done.rejected.select("reason").unionByName(done.open.select(F.lit("open").alias("reason"))).groupBy("reason").count().collect():
            if r.reason == "open":
                waiting = r["count"]
            else:
                self.add("errors_total", r["count"], type=r.reason)
        self.set("buffer_size", waiting)
        self.set("commit_queue_size", 0)  # a batch writes all it has committed
        if confirmed:
            self.set("confirmed_lsn", max([*confirmed.values(), *self.values["confirmed_lsn"].values()]))
        for slot, lsn in reached.items():
            self.set("lag_bytes", max(0, lsn - confirmed[slot]) if slot in confirmed else self.values["lag_bytes"].get((slot,), 0), slot=slot)
        self.set("throughput_rows_per_sec", self.rate.add(sum(r.rows for r in summary), self.now()))
        self.observe("batch_latency_seconds", seconds, sink="parquet")

    def text(self, prefix: str = "walflow") -> str:
        """All values in text format."""
        with self.lock:
            samples = {name: [(dict(zip(METRICS[name][1], key)), v) for key, v in sorted(found.items())] for name, found in self.values.items() if found}
            lines = [exposition(samples, prefix)] if samples else []
            for name, found in self.spread.items():
                bounds = BATCH_BUCKETS if name == "batch_latency_seconds" else PARSE_BUCKETS
                for key, counts in sorted(found.items()):
                    labels = "".join(f'{k}="{v}",' for k, v in zip(METRICS[name][1], key))
                    lines.append(f"# TYPE {prefix}_{name} histogram\n" + "".join(f'{prefix}_{name}_bucket{{{labels}le="{b}"}} {n:g}\n' for b, n in zip([*bounds, "+Inf"], counts)))
                    plain = "{" + labels.rstrip(",") + "}" if labels else ""
                    lines.append(f"{prefix}_{name}_sum{plain} {counts[-1]:g}\n{prefix}_{name}_count{plain} {counts[-2]:g}\n")
        return "".join(lines)
