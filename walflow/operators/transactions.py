"""Grouping changes by transaction: emitted events, open transactions, dead letters, counters.

The reference semantics are a map of open transactions and a cursor that the last begin
left. Only control messages move them, so all changes between two control messages share
one fate. It is worked out on the narrow control rows and carried to the changes, whose
payload is decoded last. No step needs a slot in one task: each slot is cut into ranges of
`seq` (``spans``), windows run within a range, and what a range inherits from the earlier
ones is a small running value, one row a range.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walflow.functions import lsn as L
from walflow.functions.values import row_map, unchanged
from walflow.operators.parse import CHANGE_FIELDS, CONTROL_FIELDS, parse_messages
from walflow.operators.relations import relation_history, with_relation

DML = ("insert", "update", "delete")
CONTROL = ("begin", "commit", "stream_start", "stream_commit", "stream_abort")
#: Messages per range, if `seq` is as gapless as the data model has it; ranges of a slot are equally wide in any case.
ROWS = 50_000


@dataclass
class Assembled:
    """events: emitted rows; rejected: dead letters; open: changes of transactions still open; marks: the control rows with the state they leave."""

    events: DataFrame
    rejected: DataFrame
    open: DataFrame
    marks: DataFrame
    cached: list[DataFrame] = field(default_factory=list)

    def done(self) -> None:
        """Lets go of what `assemble` kept."""
        for df in self.cached:
            df.unpersist()


def spans(frames: DataFrame, rows: int | None = None) -> DataFrame:
    """slot, lo, width, ranges: one row a slot, which is as many as are configured."""
    found = frames.groupBy("slot").agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi")).collect()
    cut = [(r.slot, r.lo, (r.hi - r.lo) // (parts := -(-r.n // (rows or ROWS))) + 1, parts) for r in found if r.lo is not None]
    return frames.sparkSession.createDataFrame(cut, "slot string, lo long, width long, ranges long")


def in_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds `range`, the place of each row's range in its slot."""
    return rows.join(F.broadcast(ranges.select("slot", "lo", "width")), "slot").withColumn("range", F.expr("(seq - lo) div width")).drop("lo", "width")


def latest(rows: DataFrame, value: Column, name: str, ranges: DataFrame) -> DataFrame:
    """Adds `name`: the last `value` that is not null, in the row's slot, up to the row. `rows` have slot, seq and range."""
    here = F.last(value, True).over(Window.partitionBy("slot", "range").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.where(value.isNotNull()).groupBy("slot", "range").agg(F.max_by(value, "seq").alias("_end"))
    every = ranges.select("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ranges") - 1)).alias("range"))
    before = F.last("_end", True).over(Window.partitionBy("slot").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    inherited = every.join(ends, ["slot", "range"], "left").select("slot", "range", before.alias("_before"))
    return rows.withColumn("_here", here).join(inherited, ["slot", "range"]).withColumn(name, F.coalesce("_here", "_before")).drop("_here", "_before")


def mark(control: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of decoded control rows: (marks, intervals).

    marks: the rows with their transaction (`txn_xid`), the `state` they put it in, its `state_before` and how it `ended` after them.
    intervals: for each row (slot, seq), the fate of the changes between it and the next one."""
    kind = F.col("msg_type")
    rows = latest(in_ranges(control, ranges), F.when(kind.isin("begin", "stream_start"), F.col("xid")), "cursor", ranges).drop("range")
    rows = rows.withColumn("cursor", F.coalesce("cursor", F.lit(0).cast("long")))
    state = (
        F.when((kind == "begin") | ((kind == "stream_start") & F.col("first_segment")), "open")
        .when(kind.isin("commit", "stream_commit"), "commit").when(kind == "stream_abort", "abort")
    )
    # Each row stands for itself, in its transaction, and as a probe for what the cursor's transaction is like after it.
    itself = F.struct(F.when(kind == "commit", F.col("cursor")).otherwise(F.col("xid")).alias("txn_xid"), F.lit(False).alias("probe"), state.alias("state"))
    probe = F.struct(F.col("cursor").alias("txn_xid"), F.lit(True).alias("probe"), F.lit(None).cast("string").alias("state"))
    both = rows.withColumn("_as", F.explode(F.array(itself, probe))).select("*", "_as.*").drop("_as", "cursor")
    order = Window.partitionBy("slot", "txn_xid").orderBy("seq", "probe")
    past, future = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    opened = F.when(F.col("state") == "open", F.struct("seq", "send_time", F.coalesce(F.when(kind == "begin", F.col("commit_time")), F.lit(0).cast("long")).alias("begin_time")))
    both = both.withColumns({
        "state_before": F.last("state", True).over(past), "opened": F.last(opened, True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "ended": F.first(F.when(F.col("state").isNotNull(), F.struct("state", "seq", "commit_lsn", "commit_time", "subxid")), True).over(future),
    })
    intervals = both.where("probe").select("slot", "seq", F.struct("txn_xid", "state_before", "ended", F.col("opened.seq").alias("opened_seq"), F.col("opened.begin_time").alias("begin_time")).alias("fate"))
    return both.where("not probe").drop("probe"), intervals


def with_fate(changes: DataFrame, intervals: DataFrame, ranges: DataFrame) -> DataFrame:
    """Change frames (slot, seq, start_lsn, payload) with the `fate` of their transaction; only payloads move, undecoded."""
    rows = changes.select("slot", "seq", "start_lsn", "payload").unionByName(intervals, allowMissingColumns=True)
    return latest(in_ranges(rows, ranges), F.col("fate"), "_fate", ranges).where("payload is not null").select("slot", "seq", "start_lsn", "payload", "_fate.*")


def reason(rows: DataFrame) -> DataFrame:
    """`reason`: null for emitted rows, `open` for open ones, else why the row is a dead letter."""
    ends = F.col("ended.state")
    why = (
        F.when(F.col("rel_columns").isNull(), "unknown_relation")
        .when(F.coalesce(F.col("state_before") != "open", F.lit(True)), "no_open_transaction")
        .when(ends == "commit", F.lit(None)).when((ends == "abort") & (F.col("ended.subxid") != F.col("txn_xid")), "subxact_abort_unresolved")
        .when(ends == "abort", "aborted").when(ends == "open", "replaced").otherwise("open")
    )
    return rows.withColumn("reason", why)


def project(rows: DataFrame) -> DataFrame:
    """Events of changes with their relation: data, before and key by operation."""
    image = lambda cells, keys=False: row_map(F.col("rel_columns"), F.col(cells), keys, F.col("rel_plan"))
    gone = F.col("msg_type") == "delete"
    return rows.select(
        "slot", "seq", F.col("start_lsn").alias("lsn"), F.col("txn_xid").alias("xid"), F.col("ended.commit_lsn").alias("commit_lsn"), F.col("ended.commit_time").alias("commit_time"),
        F.upper("msg_type").alias("op"), F.col("full_name").alias("table"),
        F.when(gone, F.when(F.col("key_only"), image("old_tuple", True)).otherwise(image("old_tuple"))).otherwise(image("new_tuple")).alias("data"),
        F.when(F.col("msg_type") == "update", image("old_tuple")).alias("before"),
        F.when(gone, image("old_tuple", True)).otherwise(image("new_tuple", True)).alias("pk"), L.timestamp(F.col("ended.commit_time")).alias("ts"),
        F.coalesce(unchanged(F.col("rel_columns"), F.coalesce("new_tuple", "old_tuple")), F.array()).alias("unchanged"), "old_kind",
        F.col("opened_seq").alias("txn_instance"), "begin_time",
    )


def assemble(frames: DataFrame, history: DataFrame | None = None, rows: int | None = None, keep: bool = False) -> Assembled:
    """Splits frames into committed events, open changes and dead letters. No change and no malformed message disappears.

    `history`: the versions of the relations, if known from elsewhere; `rows`: messages per range; `keep`: cache the decoded
    messages, where all parts of the result are wanted, until `done` is called."""
    tag = F.coalesce(F.substring("payload", 1, 1), F.lit(b""))
    is_change = tag.isin(F.lit(b"I"), F.lit(b"U"), F.lit(b"D"))
    if history is None:
        history = relation_history(parse_messages(frames.where(tag == F.lit(b"R"))).where("error is null"))
    ranges = spans(frames, rows)
    heads = parse_messages(frames.where(~is_change), CONTROL_FIELDS)
    heads = heads.persist() if keep else heads
    control = heads.where(F.col("error").isNull() & F.col("msg_type").isin(*CONTROL)).drop("payload", "error", "start_lsn", "end_lsn")
    marks, intervals = mark(control, ranges)
    decoded = parse_messages(with_fate(frames.where(is_change), intervals, ranges), CHANGE_FIELDS)
    decoded = decoded.persist() if keep else decoded
    known = reason(with_relation(decoded.where("error is null"), history))
    letters = lambda x, why: x.select("slot", "seq", "start_lsn", F.col(why).alias("reason"), "payload")
    rejected = letters(known.where("reason is not null and reason <> 'open'"), "reason").unionByName(letters(decoded.where("error is not null"), "error")).unionByName(letters(heads.where("error is not null"), "error"))
    return Assembled(project(known.where("reason is null")), rejected, known.where("reason = 'open'"), marks, [heads, decoded] if keep else [])


def transactions(events: DataFrame) -> DataFrame:
    """One row per emitted transaction."""
    return events.groupBy("slot", "txn_instance", "xid").agg(
        F.first("begin_time").alias("begin_time"), F.max("commit_lsn").alias("commit_lsn"), F.max("commit_time").alias("commit_time"), F.lit(True).alias("committed"), F.count("*").alias("event_count")
    )


def with_event_lists(events: DataFrame) -> DataFrame:
    """Transactions with their events as an ordered array; for transactions of bounded size."""
    one = F.struct("seq", "lsn", "op", "table", F.to_json("data").alias("data"), F.to_json("before").alias("before"))
    return events.groupBy("slot", "txn_instance", "xid", "commit_lsn").agg(F.array_sort(F.collect_list(one)).alias("events"))


def buffer_stats(marked: DataFrame) -> DataFrame:
    """Counters per slot: transactions started (by begin), committed (empty ones included), and still buffered."""
    closing = F.col("state").isin("commit", "abort") & (F.col("state_before") == "open")
    last_open = (F.col("state") == "open") & F.col("ended").isNull()
    return marked.groupBy("slot").agg(
        F.count_if(F.col("msg_type") == "begin").alias("started"), F.count_if(closing & (F.col("state") == "commit")).alias("committed"), F.count_if(last_open).alias("buffered")
    )


def open_events(open_rows: DataFrame) -> DataFrame:
    """Per slot: changes in open transactions, and how many transactions hold them."""
    return open_rows.groupBy("slot").agg(F.count("*").alias("total_events"), F.count_distinct("opened_seq").alias("transactions"))


def stale(marked: DataFrame, seconds: int, now: Column | None = None) -> DataFrame:
    """Open transactions whose opening message was sent over `seconds` before `now`: slot, xid, opened_seq, created_at."""
    created = L.timestamp(F.col("send_time"))
    still = marked.where("state = 'open' and ended is null")
    return still.where(created < (F.current_timestamp() if now is None else now) - F.expr(f"interval {int(seconds)} seconds")).select("slot", F.col("txn_xid").alias("xid"), F.col("seq").alias("opened_seq"), created.alias("created_at"))
