"""Frames and messages: BINARY to typed columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from walflow.functions.columnar import decode_batch
from walflow.functions.wire import TAGS

_CELLS = "array<struct<fmt:string,text:string,bin:binary>>"
FIELDS = (
    "msg_type string, xid long, subxid long, first_segment boolean, flags int, final_lsn long, commit_lsn long, txn_end_lsn long, commit_time long, "
    "relation_id long, namespace string, name string, replica_identity string, columns array<struct<name:string,flags:int,type_oid:long,type_modifier:int>>, "
    f"key_only boolean, old_kind string, old_tuple {_CELLS}, new_tuple {_CELLS}, type_id long, origin_lsn long, origin_name string, truncate_options int, "
    "relation_ids array<long>, transactional boolean, prefix string, message_lsn long, content binary, error string, error_text string"
)

#: What the assembly needs of control and of change messages.
CONTROL_FIELDS = "msg_type string, xid long, subxid long, first_segment boolean, commit_lsn long, commit_time long, error string"
CHANGE_FIELDS = f"msg_type string, relation_id long, key_only boolean, old_kind string, old_tuple {_CELLS}, new_tuple {_CELLS}, error string"


def _u(name: str, start: int, n: int) -> str:
    return f"cast(conv(hex(substring({name},{start},{n})),16,10) as decimal(20,0))"


def parse_frames(frames: DataFrame, column: str = "frame") -> DataFrame:
    """Replication frames to kind, start_lsn, end_lsn, send_time, reply_requested, payload and frame_error; built-in expressions alone."""
    tag, size = F.substring(column, 1, 1), F.octet_length(column)
    kind = F.when((tag == F.lit(b"w")) & (size >= 25), "xlog_data").when((tag == F.lit(b"k")) & (size >= 18), "keepalive")
    lsn = lambda at: F.expr(f"try_cast({_u(column, at, 8)} as bigint)")
    signed = lambda at: F.expr(f"cast(case when {_u(column, at, 8)} > 9223372036854775807 then {_u(column, at, 8)} - 18446744073709551616 else {_u(column, at, 8)} end as bigint)")
    out = frames.withColumn("kind", kind)
    data, alive = F.col("kind") == "xlog_data", F.col("kind") == "keepalive"
    return out.withColumns({
        "start_lsn": F.when(data, lsn(2)), "end_lsn": F.when(data, lsn(10)).when(alive, lsn(2)), "send_time": F.when(data, signed(18)).when(alive, signed(10)),
        "reply_requested": F.when(alive, F.substring(column, 18, 1) == F.lit(b"\x01")), "payload": F.when(data, F.expr(f"substring({column}, 26)")),
        "frame_error": F.when(F.col("kind").isNull(), F.when(size == 0, "empty_message").when(tag.isin(F.lit(b"w"), F.lit(b"k")), "buffer_underflow").otherwise("unknown_message_type")),
    })


def parse_messages(frames: DataFrame, fields: str = FIELDS) -> DataFrame:
    """Adds the decoded `fields` (all of them, if not said) to frames that have a `payload`; malformed ones get `error`.

    One pass over Arrow batches, column-wise for control and change messages."""
    added = StructType.fromDDL(fields)
    schema = StructType([*frames.schema.fields, *added.fields])
    arrow = to_arrow_schema(added)
    at = frames.columns.index("payload")

    def run(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([*batch.columns, *decode_batch(batch.column(at), arrow)], [*batch.schema.names, *arrow.names])

    return frames.mapInArrow(run, schema)


def message_type(payload):
    """The message type from the tag byte alone (case-sensitive), null if unknown."""
    tag = F.substring(payload, 1, 1)
    return F.coalesce(*[F.when(tag == F.lit(t.encode()), F.lit(name)) for t, name in TAGS.items()])


def is_dml(kind):
    return kind.isin("insert", "update", "delete")


def parse_headers(frames: DataFrame) -> DataFrame:
    """Type, relation, xid and positions of fixed-width messages without Python: a cross-check of `parse_messages`, and enough for counting."""
    kind = F.col("msg_type")
    u = lambda at, n: F.expr(f"try_cast({_u('payload', at, n)} as bigint)")
    return frames.withColumn("msg_type", message_type(F.col("payload"))).withColumns({
        "relation_id": F.when(is_dml(kind) | (kind == "relation"), u(2, 4)),
        "xid": F.when(kind == "begin", u(18, 4)).when(kind.isin("stream_start", "stream_commit", "stream_abort"), u(2, 4)),
        "commit_lsn": F.when(kind == "commit", u(3, 8)).when(kind == "stream_commit", u(7, 8)),
        "commit_time": F.when(kind == "begin", u(10, 8)).when(kind == "commit", u(19, 8)).when(kind == "stream_commit", u(23, 8)),
    })


def dead_letters(messages: DataFrame) -> DataFrame:
    return messages.where("error is not null").select("slot", "seq", "start_lsn", F.col("error").alias("reason"), "payload")
