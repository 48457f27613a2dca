"""Output rows and their text forms, partitioned and idempotent writing."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SINK_DDL = "lsn BIGINT, xid BIGINT, op STRING, `table` STRING, data STRING, before STRING, ts TIMESTAMP"


def to_sink_rows(events: DataFrame) -> DataFrame:
    """The seven output columns: images as canonical JSON, ts in seconds."""
    return events.select("lsn", "xid", "op", "table", F.to_json("data").alias("data"), F.to_json("before").alias("before"), F.date_trunc("second", "ts").alias("ts"))


def to_json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object per row, nulls kept."""
    return rows.select(F.to_json(F.struct(*[F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts") if c == "ts" else F.col(c) for c in rows.columns]), {"ignoreNullFields": "false"}).alias("value"))


def to_values_text(rows: DataFrame) -> DataFrame:
    """`(lsn, xid, 'op', ...)` tuples; quotes are doubled, a missing before is NULL."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    parts = [F.col("lsn").cast("string"), F.col("xid").cast("string"), quoted(F.col("op")), quoted(F.col("table")), quoted(F.col("data")), F.coalesce(quoted(F.col("before")), F.lit("NULL")), quoted(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))]
    return rows.select(F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")")).alias("value"))


def event_size(rows: DataFrame) -> DataFrame:
    """Adds the estimated size of each row in bytes."""
    return rows.withColumn("size", F.lit(64) + F.octet_length("table") + F.octet_length("data") + F.coalesce(F.octet_length("before"), F.lit(0)))


def clustered(rows: DataFrame) -> DataFrame:
    """Adds the month that rows are partitioned by and sorts within tasks by (lsn, xid)."""
    return rows.withColumn("yyyymm", F.date_format("ts", "yyyyMM")).sortWithinPartitions("yyyymm", "lsn", "xid")


def write_changes(rows: DataFrame, path: str, batch_id: int = 0, compression: str = "zstd") -> None:
    """Writes a batch under its id; writing the same batch again replaces it, so a replay neither loses nor repeats rows."""
    clustered(rows).write.mode("overwrite").option("compression", compression).partitionBy("yyyymm").parquet(f"{path}/batch_id={batch_id}")


def read_changes(spark, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch_id=*").select("lsn", "xid", "op", "table", "data", "before", "ts")


def init_table(spark, name: str, path: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({SINK_DDL}, batch_id BIGINT, yyyymm STRING) USING parquet PARTITIONED BY (batch_id, yyyymm) LOCATION '{path}'")


def current_state(events: DataFrame) -> DataFrame:
    """The latest image of each key that is not deleted, with keys as canonical JSON; images are rendered for the winners alone."""
    keyed = events.withColumn("key", F.to_json("pk"))
    last = keyed.groupBy("slot", "table", "key").agg(F.max_by(F.struct("op", "data", "lsn"), F.struct("commit_lsn", "seq")).alias("last"))
    return last.where("last.op <> 'DELETE'").select("slot", "table", "key", F.to_json("last.data").alias("data"), "last.lsn")


def batch_stats(events: DataFrame) -> DataFrame:
    """What a batch of events amounts to: events, bytes of its output rows, and the greatest commit position, which may be confirmed once it is written."""
    rows = events.select("commit_lsn", "table", F.to_json("data").alias("data"), F.to_json("before").alias("before"))
    return event_size(rows).agg(F.count("*").alias("events"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.max("commit_lsn").alias("max_commit_lsn"))


def batch_summary(events: DataFrame) -> DataFrame:
    """Per slot and table of a batch: rows, transactions and the greatest commit position."""
    return events.groupBy("slot", "table").agg(F.count("*").alias("rows"), F.count_distinct("txn_instance", "xid").alias("transactions"), F.max("commit_lsn").alias("commit_lsn"))


def write_positions(spark, summary: list, path: str) -> None:
    """slot_name, confirmed_lsn, flushed_rows and last_flush_time (microseconds) of a written batch: what may be confirmed to each slot (see `positions.slot_checkpoints`)."""
    now = time.time_ns() // 1000
    slots: dict[str, tuple[int, int]] = {}
    for r in summary:
        lsn, rows = slots.get(r.slot, (0, 0))
        slots[r.slot] = (max(lsn, r.commit_lsn), rows + r.rows)
    rows = [(slot, lsn, n, now) for slot, (lsn, n) in slots.items()]
    spark.createDataFrame(rows, "slot_name string, confirmed_lsn long, flushed_rows long, last_flush_time long").coalesce(1).write.mode("overwrite").parquet(path)
