"""Commit ordering: ready sets, the next transaction, statistics. Input: transactions with commit_lsn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walflow.functions import lsn as L

ORDER = ("commit_lsn", "slot", "xid")


def pending(txns: DataFrame) -> DataFrame:
    """Committed transactions; others never enter the queue."""
    return txns.where("commit_lsn is not null")


def ready(txns: DataFrame, confirmed: int, gap: int) -> DataFrame:
    """Transactions up to confirmed + gap (saturating), in commit order."""
    return pending(txns).where(F.col("commit_lsn") <= L.plus(F.lit(confirmed).cast("long"), F.lit(gap).cast("long"))).orderBy(*ORDER)


def next_ready(txns: DataFrame, confirmed: int) -> DataFrame:
    """The first transaction, if nothing is confirmed yet or it follows at once."""
    first = pending(txns).orderBy(*ORDER).limit(1)
    return first.where((F.lit(confirmed) == 0) | (F.col("commit_lsn") <= L.plus(F.lit(confirmed).cast("long"), F.lit(1).cast("long"))))


def peek(txns: DataFrame) -> DataFrame:
    return pending(txns).agg(F.min("commit_lsn").alias("next_lsn"))


def drain(txns: DataFrame) -> DataFrame:
    return pending(txns).orderBy(*ORDER)


def commit_order(txns: DataFrame) -> DataFrame:
    """All pending transactions with their `place` from 1 on in commit order. Ranges of commit_lsn are counted and
    numbered apart, so no task holds everything; `txns` is read three times, so it should be stored."""
    rows = pending(txns)
    parts = int(txns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted({int(x) for x in rows.approxQuantile("commit_lsn", [k / parts for k in range(1, parts)], 0.25 / parts)})
    rows = rows.withColumn("_part", F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<long>"), lambda b: b < F.col("commit_lsn"))))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = rows.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_offset") + F.row_number().over(Window.partitionBy("_part").orderBy(*ORDER))
    return rows.join(F.broadcast(offsets), "_part").withColumn("place", place).drop("_part", "_offset")


def queue_stats(txns: DataFrame, confirmed: int) -> DataFrame:
    return pending(txns).agg(
        F.count("*").alias("size"), F.lit(confirmed).cast("long").alias("confirmed_lsn"), F.min("commit_lsn").alias("min_pending_lsn"),
        F.nullif(F.max("commit_lsn"), F.lit(0).cast("long")).alias("max_pending_lsn"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("total_events"),
    )
