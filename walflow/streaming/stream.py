"""Structured Streaming: frames in, committed rows out, the batch operators in between.

Micro-batches end anywhere. What a batch leaves open (the changes of open transactions, the control
messages since the oldest of them began, and the relation versions still needed) is written as frames
under the batch's id and read by the next one, so a batch that runs again finds the state it had.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from walflow.metrics import Registry
from walflow.operators.parse import parse_messages
from walflow.operators.relations import publication, relation_history
from walflow.operators.sinks import batch_summary, to_sink_rows, write_changes, write_positions
from walflow.operators.transactions import Assembled, assemble
from walflow.sources.wal import FRAME_SCHEMA
from walflow.storage import exists, remove


def replay(frames: DataFrame) -> Assembled:
    """Batch assembly of frames."""
    return assemble(frames)


def left_open(frames: DataFrame, done: Assembled, history: DataFrame) -> DataFrame:
    """The frames that the assembly of later ones needs."""
    since = done.marks.where("state = 'open' and ended is null").groupBy(F.col("slot").alias("_slot")).agg(F.min("seq").alias("since"))
    tag = F.substring("payload", 1, 1)
    rows = frames.join(F.broadcast(since), F.col("slot") == F.col("_slot"), "left")
    control = rows.where(tag.isin(F.lit(b"B"), F.lit(b"C"), F.lit(b"S"), F.lit(b"c"), F.lit(b"A")) & (F.col("seq") >= F.col("since"))).select(frames.columns)
    versions = history.select(F.col("slot").alias("s"), F.col("seq").alias("q"), "until_seq")
    known = rows.join(versions, (F.col("slot") == F.col("s")) & (F.col("seq") == F.col("q"))).where("until_seq is null or until_seq > since").select(frames.columns)
    changes = frames.join(done.open.select("slot", "seq"), ["slot", "seq"], "left_semi").select(frames.columns)
    return control.unionByName(known).unionByName(changes)


class Batches:
    """The work of one micro-batch, for `foreachBatch`."""

    def __init__(self, path: str, state: str, dead_letters: str | None = None, tables: list[str] | None = None, registry: Registry | None = None, write=None):
        self.path, self.state, self.dead_letters, self.tables, self.registry, self.write = path, state, dead_letters, tables, registry or Registry(), write

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        spark, began = df.sparkSession, time.time()
        frames = df
        if batch_id and exists(spark, before := f"{self.state}/batch_id={batch_id - 1}"):
            frames = spark.read.schema(FRAME_SCHEMA).parquet(before).unionByName(df)
        frames = frames.persist()
        relations = relation_history(parse_messages(frames.where(F.substring("payload", 1, 1) == F.lit(b"R"))).where("error is null")).persist()
        done = assemble(publication(frames, relations, self.tables) if self.tables else frames, relations, keep=True)
        events = done.events.persist()
        try:
            write_changes(to_sink_rows(events), self.path, batch_id)
            if self.write is not None:
                self.write(to_sink_rows(events), batch_id)
            if self.dead_letters:
                done.rejected.coalesce(1).write.mode("overwrite").parquet(f"{self.dead_letters}/batch_id={batch_id}")
            left_open(frames, done, relations).select("slot", "seq", "start_lsn", "end_lsn", "send_time", "payload").write.mode("overwrite").parquet(f"{self.state}/batch_id={batch_id}")
            self.registry.batch(df, done, positions := batch_summary(events).collect(), time.time() - began)
            write_positions(spark, positions, f"{self.path}_positions/batch_id={batch_id}")
        finally:
            for x in (events, relations, frames):
                x.unpersist()
            done.done()
        remove(spark, f"{self.state}/batch_id={batch_id - 2}")


def start_stream(
    spark: SparkSession, frames: DataFrame, path: str, checkpoint: str, dead_letters: str | None = None, trigger: dict | None = None,
    tables: list[str] | None = None, registry: Registry | None = None, write=None,
) -> StreamingQuery:
    """Writes the committed rows of a frame stream, a batch under its id; `trigger` as for writeStream (default: as fast as batches get done)."""
    work = Batches(path, f"{checkpoint}/open_transactions", dead_letters, tables, registry, write)
    return frames.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def drain(query: StreamingQuery) -> list:
    """Lets a query finish all there is, in as many batches as its source makes of it, and stops it; the batches' progress."""
    try:
        query.processAllAvailable()
        return [p for p in query.recentProgress if p.numInputRows]
    finally:
        query.stop()


def with_late_windows(rows: DataFrame, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Event-time counts over committed rows with a watermark."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width), "table").agg(F.count("*").alias("rows"))
