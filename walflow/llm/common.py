"""What the operators share: table access, materialising, Arrow iteration."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from walflow.llm import hashing
from walflow.storage import remove, shared_dir

#: Stands for a null doc_id inside the operators; it sorts after every other id.
NULL_ID = (1 << 63) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return small_batches(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def save(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: writes `df` as a table in the shared folder and reads it back; `forget` deletes it."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the table of a saved DataFrame that nothing reads any more; others are left alone."""
    if path := getattr(df, "saved_at", None):
        remove(df.sparkSession, path)


def small_batches(df: DataFrame) -> DataFrame:
    """Arrow's default of 10,000 rows a batch is tens of MB of text on either side; documents go by fewer."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df


def trim() -> None:
    """Gives freed memory and the tables of hashes back to the system: workers live on between tasks."""
    hashing.forget_powers()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(df: DataFrame) -> int:
    """Bytes of text in all rows: sizes the bucket counts of the exchanges."""
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parallel(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(columns: list[str], *names: str) -> list[str]:
    """`names`, each with as many underscores before it as it takes to clash with none of `columns` in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        name = "_" + name
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def doc_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def encoded(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def int64s(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark longs, bit for bit."""
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]]):
    """Lifts a function of one batch to mapInArrow."""

    def run(it):
        for batch in it:
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out
        trim()

    return run
