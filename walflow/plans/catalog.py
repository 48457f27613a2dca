"""Registered queries: base table -> encoded bytes -> decoded -> operator, and SQL on the base tables that must agree."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walflow import metrics
from walflow.functions import lsn as L
from walflow.functions import wire
from walflow.functions.values import as_text, cell_value, field, is_null, is_unchanged, tuple_length
from walflow.operators import positions as pos
from walflow.operators import queue, sinks
from walflow.operators.parse import message_type, parse_frames, parse_messages
from walflow.operators.relations import by_name, column_count, column_named, has_full_replica_identity, primary_key_columns, publication, relation_history
from walflow.operators.transactions import buffer_stats, open_events, stale, transactions, with_event_lists
from walflow.plans import changelog as cl
from walflow.storage import exists, shared_dir, stored
from walflow.streaming.stream import replay, with_late_windows

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


_LOGS: dict[tuple, DataFrame] = {}


def _log(make, spark, d, *args):
    """A change log as a stored table, as a recorded one would be; recorded once a session and folder."""
    key = (spark.sparkContext.applicationId, shared_dir(spark), make.__name__, d, args)
    if key not in _LOGS or not exists(spark, _LOGS[key].inputFiles()[0]):
        _LOGS[key] = stored(make(spark, d, *args), "changelog")
    return _LOGS[key]


def _orders(spark, d):
    return replay(_log(cl.orders_log, spark, d))


def _events(spark, d, slots=1):
    return replay(_log(cl.events_log, spark, d, slots))


def _ints(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


# Shared SQL of the change logs.
_O = "o AS (SELECT *, (o_orderkey * 7919) % (SELECT count(*) FROM orders) AS p, (SELECT count(*) FROM orders) AS n FROM orders)"
_TX = f"{_O}, tx AS (SELECT 2 * o_orderkey + 1 AS xid, 1020 + 100 * p AS commit_lsn FROM o UNION ALL SELECT 2 * o_orderkey + 2, 1020 + 100 * (n + p) FROM o WHERE o_orderstatus <> 'O')"
_E = "e AS (SELECT *, event_id // 5 AS t, 10000 + 100 * (event_id // 5) AS base, (event_id // 5) % 30 IN (13, 23) AS gone FROM events)"
_T = f"{_E}, t AS (SELECT t, min(base) AS base, any_value(gone) AS gone, max_by(ts, event_id) AS ts FROM e GROUP BY t)"


@query("cdc01_insert_rows", f"WITH {_O} SELECT 1010 + 100 * p AS lsn, 2 * o_orderkey + 1 AS xid, 'INSERT' AS op, 'public.orders' AS \"table\", o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM o")
def insert_rows(spark: SparkSession, d: str) -> DataFrame:
    e = _orders(spark, d).events.where("op = 'INSERT'")
    v = lambda c, k: field(F.col("data"), c, k).alias(c)
    return e.select("lsn", "xid", "op", "table", v("o_orderkey", "bigint"), v("o_custkey", "bigint"), v("o_orderstatus", "string"), v("o_totalprice", "double"), v("o_orderpriority", "string"))


@query("cdc02_update_rows", f"WITH {_O} SELECT 1010 + 100 * (n + p) AS lsn, 2 * o_orderkey + 2 AS xid, o_orderkey, 'P' AS old_status, 'O' AS new_status, o_totalprice AS old_price FROM o WHERE o_orderstatus = 'P'")
def update_rows(spark, d):
    e = _orders(spark, d).events.where("op = 'UPDATE'")
    return e.select("lsn", "xid", field(F.col("pk"), "o_orderkey", "bigint").alias("o_orderkey"), field(F.col("before"), "o_orderstatus", "string").alias("old_status"), field(F.col("data"), "o_orderstatus", "string").alias("new_status"), field(F.col("before"), "o_totalprice", "double").alias("old_price"))


@query("cdc03_delete_full", "SELECT o_orderkey, o_custkey, o_orderstatus, 6 AS fields, true AS before_is_null FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0")
def delete_full(spark, d):
    e = _orders(spark, d).events.where("op = 'DELETE' and old_kind = 'O'")
    return e.select(field(F.col("data"), "o_orderkey", "bigint").alias("o_orderkey"), field(F.col("data"), "o_custkey", "bigint").alias("o_custkey"), field(F.col("data"), "o_orderstatus", "string").alias("o_orderstatus"), F.size("data").alias("fields"), F.col("before").isNull().alias("before_is_null"))


@query("cdc04_delete_key_only", "SELECT o_orderkey, '{\"o_orderkey\":' || o_orderkey || '}' AS data FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 1")
def delete_key_only(spark, d):
    e = _orders(spark, d).events.where("op = 'DELETE' and old_kind = 'K'")
    return e.select(field(F.col("pk"), "o_orderkey", "bigint").alias("o_orderkey"), F.to_json("data").alias("data"))


@query("cdc05_pk_extract", f"WITH {_E} SELECT event_id, user_id, '{{\"user_id\":' || user_id || '}}' AS pk FROM e WHERE NOT gone")
def pk_extract(spark, d):
    e = _events(spark, d).events
    event = (F.floor((F.col("lsn") - 10000) / 100) * 5 + (F.col("lsn") % 100) / 10 - 1).cast("long")
    return e.select(event.alias("event_id"), field(F.col("pk"), "user_id", "bigint").alias("user_id"), F.to_json("pk").alias("pk"))


@query("cdc06_null_unchanged_binary", f"""WITH {_E} SELECT event_id, CASE WHEN event_id % 7 < 2 THEN NULL WHEN event_id % 7 = 2 THEN '\\x' || lower(lpad(to_hex(event_id), 8, '0')) ELSE 'n' || event_id END AS note,
 event_id % 7 = 1 AS is_unchanged FROM e WHERE NOT gone AND event_type <> 'error'""")
def null_unchanged_binary(spark, d):
    e = _events(spark, d).events.where("op <> 'DELETE'")
    event = (F.floor((F.col("lsn") - 10000) / 100) * 5 + (F.col("lsn") % 100) / 10 - 1).cast("long")
    note = F.coalesce(field(F.col("data"), "note", "string"), field(F.col("data"), "remark", "string"))
    return e.select(event.alias("event_id"), note.alias("note"), (F.size("unchanged") > 0).alias("is_unchanged"))


_VALUES = [
    (16, "t", "true"), (16, "1", "true"), (16, "yes", "false"), (16, "f", "false"), (23, "42", "42"), (23, " 42", '" 42"'), (20, "+42", "42"), (20, "abc", '"abc"'), (20, "9223372036854775808", '"9223372036854775808"'),
    (20, "-9223372036854775808", "-9223372036854775808"), (701, "95.5", "95.5"), (701, "1d", '"1d"'), (701, "NaN", None), (701, "Infinity", None), (1700, "1.10", '"1.10"'), (3802, '{"a":1}', '{"a":1}'), (3802, "oops", '"oops"'),
    (2950, "a-b", '"a-b"'), (1007, "{1,2}", '"{1,2}"'), (25, "hello", '"hello"'),
]


@query("cdc07_type_conversion", "SELECT * FROM (VALUES " + ", ".join(f"({o}, '{t}', {'NULL' if v is None else chr(39) + v + chr(39)})" for o, t, v in _VALUES) + ") AS v(oid, text, value)")
def type_conversion(spark, d):
    rows = [("s", i, wire.insert(1, [t])) for i, (_, t, _) in enumerate(_VALUES)]
    oids = F.array(*[F.lit(o) for o, _, _ in _VALUES])
    m = parse_messages(_ints(spark, rows, "slot string, seq long, payload binary"))
    oid = oids[F.col("seq").cast("int")]
    return m.select(oid.alias("oid"), F.col("new_tuple")[0]["text"].alias("text"), F.to_json(cell_value(oid, F.col("new_tuple")[0])).alias("value"))


@query("cdc08_lsn_text", "SELECT o_orderkey, format('{:X}/{:X}', (o_orderkey * 4294967291) >> 32, (o_orderkey * 4294967291) & 4294967295) AS lsn_text, o_orderkey * 4294967291 AS back FROM orders")
def lsn_text(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("lsn_text", L.format_lsn(F.col("o_orderkey") * F.lit(4294967291)))
    return o.select("o_orderkey", "lsn_text", L.parse_lsn(F.col("lsn_text")).alias("back"))


@query("cdc09_pg_timestamp", "SELECT event_id, epoch_us(ts) // 1000000 AS unix_s, (epoch_us(ts) // 1000000 - 946684800) * 1000000 AS pg_us FROM events")
def pg_timestamp(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("unix_s", L.unix_seconds(cl.micros("ts")).cast("long"))
    return e.select("event_id", "unix_s", L.pg_micros(F.col("unix_s")).alias("pg_us"))


def _order_txns(spark, d):
    return transactions(_orders(spark, d).events)


@query("cdc10_commit_order", f"WITH {_TX} SELECT xid, commit_lsn, row_number() OVER (ORDER BY commit_lsn) AS place FROM tx ORDER BY commit_lsn LIMIT 1000")
def commit_order(spark, d):
    from pyspark.sql import Window

    first = queue.drain(_order_txns(spark, d)).limit(1000)  # a top-k report
    return first.select("xid", "commit_lsn", F.row_number().over(Window.orderBy("commit_lsn")).alias("place"))


@query("cdc10b_commit_order_all", f"WITH {_TX} SELECT xid, commit_lsn, row_number() OVER (ORDER BY commit_lsn) AS place FROM tx")
def commit_order_all(spark, d):
    """The place of every transaction; cdc10 and its SQL stop at 1,000."""
    return queue.commit_order(stored(_order_txns(spark, d).select("slot", "xid", "commit_lsn"), "order")).select("xid", "commit_lsn", "place")


@query("cdc11_ready_threshold", f"WITH {_TX} SELECT xid, commit_lsn FROM tx WHERE commit_lsn <= 5000 + 300000")
def ready_threshold(spark, d):
    return queue.ready(_order_txns(spark, d), 5000, 300000).select("xid", "commit_lsn")


@query("cdc12_next_ready", f"WITH {_TX} SELECT xid, commit_lsn FROM tx ORDER BY commit_lsn LIMIT 1")
def next_ready(spark, d):
    return queue.next_ready(_order_txns(spark, d), 0).select("xid", "commit_lsn")


@query("cdc13_queue_stats", f"WITH {_TX} SELECT count(*) AS size, 7 AS confirmed_lsn, min(commit_lsn) AS min_pending_lsn, max(commit_lsn) AS max_pending_lsn, count(*) AS total_events FROM tx")
def queue_stats(spark, d):
    return queue.queue_stats(_order_txns(spark, d), 7)


@query("cdc14_txn_sizes", f"WITH {_E} SELECT 100000 + t AS xid, count(*) AS event_count FROM e WHERE NOT gone GROUP BY t")
def txn_sizes(spark, d):
    return transactions(_events(spark, d).events).select("xid", "event_count")


@query("cdc15_buffer_stats", f"WITH {_T} SELECT 'slot_0' AS slot, sum(CASE WHEN t % 10 <> 3 THEN 1 ELSE 0 END + CASE WHEN t % 25 = 0 THEN 1 ELSE 0 END)::BIGINT AS started, sum(CASE WHEN gone THEN 0 ELSE 1 END + CASE WHEN t % 25 = 0 THEN 1 ELSE 0 END)::BIGINT AS committed, 0::BIGINT AS buffered FROM t")
def buffer_counters(spark, d):
    return buffer_stats(_events(spark, d).marks)


_MSG = f"""{_T}, m AS (
 SELECT t, base + 10 * (1 + event_id % 5) AS lsn, NULL::BIGINT AS c FROM e UNION ALL SELECT t, base, NULL FROM t
 UNION ALL SELECT t, base + x, NULL FROM t, (VALUES (33), (36), (53)) AS v(x) WHERE t % 10 = 3 UNION ALL SELECT t, base + 55, NULL FROM t WHERE t % 50 = 11
 UNION ALL SELECT t, base + 58, NULL FROM t WHERE t % 30 = 23 UNION ALL SELECT t, base + 60, CASE WHEN t % 30 = 13 THEN NULL ELSE base + 60 END FROM t
 UNION ALL SELECT t, base + 75, NULL FROM t WHERE t % 40 = 7 UNION ALL SELECT t, base + 80, NULL FROM t WHERE t % 25 = 0 UNION ALL SELECT t, base + 90, base + 90 FROM t WHERE t % 25 = 0)"""


@query("cdc16_positions", f"WITH {_MSG} SELECT 'slot_' || (t % 3) AS slot, max(lsn) AS received_lsn, max(c) AS processed_lsn FROM m GROUP BY t % 3")
def positions(spark, d):
    m = parse_messages(_log(cl.events_log, spark, d, 3)).where("msg_type <> 'relation'")
    return pos.positions(m).select("slot", "received_lsn", "processed_lsn")


@query("cdc17_lag", f"WITH {_MSG} SELECT 'slot_' || (t % 3) AS slot, greatest(max(lsn) - (max(CASE WHEN t < 100 THEN c END)), 0) AS lag_bytes FROM m GROUP BY t % 3")
def lag(spark, d):
    m = parse_messages(_log(cl.events_log, spark, d, 3)).where("msg_type <> 'relation'")
    confirmed = m.where("commit_lsn < 20000").select("slot", F.col("commit_lsn").alias("confirmed_lsn"))
    return pos.lag(pos.positions(m, confirmed)).select("slot", "lag_bytes")


@query("cdc18_events_by_type", f"""WITH {_T}, k AS (
 SELECT CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS type FROM e UNION ALL SELECT CASE WHEN t % 10 = 3 THEN 'stream_start' ELSE 'begin' END FROM t
 UNION ALL SELECT v.x FROM t, (VALUES ('stream_stop'), ('stream_start'), ('stream_stop')) AS v(x) WHERE t % 10 = 3 UNION ALL SELECT 'insert' FROM t WHERE t % 50 = 11 UNION ALL SELECT 'stream_abort' FROM t WHERE t % 30 = 23
 UNION ALL SELECT CASE WHEN t % 30 = 13 THEN 'stream_abort' WHEN t % 10 = 3 THEN 'stream_commit' ELSE 'commit' END FROM t UNION ALL SELECT 'insert' FROM t WHERE t % 40 = 7
 UNION ALL SELECT v.x FROM t, (VALUES ('begin'), ('commit')) AS v(x) WHERE t % 25 = 0 UNION ALL SELECT 'relation' FROM (VALUES (1), (2)) AS r(x))
 SELECT 'slot_0' AS slot, type, count(*) AS value FROM k GROUP BY type""")
def events_by_type(spark, d):
    return metrics.events_received(_log(cl.events_log, spark, d, 1).withColumn("msg_type", message_type(F.col("payload"))))


@query("cdc19_sink_batch_stats", "SELECT o_orderkey, 64 + 13 + length('{\"o_orderkey\":' || o_orderkey || '}') AS size FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 1")
def sink_sizes(spark, d):
    rows = sinks.event_size(sinks.to_sink_rows(_orders(spark, d).events.where("op = 'DELETE' and old_kind = 'K'")))
    return rows.select(F.get_json_object("data", "$.o_orderkey").cast("long").alias("o_orderkey"), F.col("size").cast("long").alias("size"))


@query("cdc20_aborted_excluded", f"WITH {_E} SELECT base + 10 * (1 + event_id % 5) AS lsn, 100000 + t AS xid, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op FROM e WHERE NOT gone")
def aborted_excluded(spark, d):
    return _events(spark, d).events.select("lsn", "xid", "op")


@query("cdc21_dead_letters", f"""WITH {_T} SELECT reason, start_lsn FROM (
 SELECT CASE WHEN t % 30 = 13 THEN 'aborted' ELSE 'subxact_abort_unresolved' END AS reason, base + 10 * (1 + event_id % 5) AS start_lsn FROM e WHERE gone
 UNION ALL SELECT 'no_open_transaction', base + 75 FROM t WHERE t % 40 = 7 UNION ALL SELECT 'unknown_relation', base + 55 FROM t WHERE t % 50 = 11)""")
def dead_letters(spark, d):
    return _events(spark, d).rejected.select("reason", "start_lsn")


@query("cdc25_relation_versions", f"WITH {_T}, h AS (SELECT 10000 + 100 * (count(*) // 2) - 5 AS cut FROM t) SELECT event_id, CASE WHEN base + 10 * (1 + event_id % 5) < cut THEN 'note' ELSE 'remark' END AS last_column FROM e, h WHERE NOT gone AND event_type <> 'error'")
def relation_versions(spark, d):
    e = _events(spark, d).events.where("op <> 'DELETE'")
    event = (F.floor((F.col("lsn") - 10000) / 100) * 5 + (F.col("lsn") % 100) / 10 - 1).cast("long")
    return e.select(event.alias("event_id"), F.filter(F.map_keys("data"), lambda k: k.isin("note", "remark"))[0].alias("last_column"))


@query("cdc25b_relation_history", "SELECT * FROM (VALUES ('slot_0', 'public.user_state', 'default', 'user_id,event_type,value,props,ts,note', 0), ('slot_0', 'public.user_state', 'default', 'user_id,event_type,value,props,ts,remark', 0)) AS v(slot, full_name, replica_identity, names, key_index)")
def history(spark, d):
    h = relation_history(parse_messages(_log(cl.events_log, spark, d, 1)))
    return h.select("slot", "full_name", "replica_identity", F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("names"), F.col("primary_key_indices")[0].alias("key_index"))


@query("cdc26_truncate_list", "SELECT * FROM (VALUES (0, 1, 1), (0, 1, 2), (1, 0, 7)) AS v(seq, truncate_options, relation_id)")
def truncate_list(spark, d):
    m = parse_messages(_ints(spark, [("s", 0, wire.truncate([1, 2], 1)), ("s", 1, wire.truncate([7]))], "slot string, seq long, payload binary"))
    return m.select("seq", "truncate_options", F.explode("relation_ids").alias("relation_id"))


_BAD = [(b"", "empty_message"), (b"X", "unknown_message_type"), (b"B" + bytes(19), "buffer_underflow"), (wire.insert(1, ["a"])[:-1], "buffer_underflow"), (wire.insert(1, ["a"]).replace(b"N", b"X"), "bad_tuple_marker"), (wire.insert(1, ["a"]).replace(b"t\0", b"z\0"), "bad_tuple_format"), (b"Y\0\0\0\1public", "missing_null_terminator")]


@query("cdc27_malformed", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{r}')" for i, (_, r) in enumerate(_BAD)) + ") AS v(seq, reason)")
def malformed(spark, d):
    m = parse_messages(_ints(spark, [("s", i, p) for i, (p, _) in enumerate(_BAD)], "slot string, seq long, payload binary"))
    return m.select("seq", F.col("error").alias("reason"))


@query("cdc27b_frames", f"WITH {_O} SELECT 1010 + 100 * p AS start_lsn, 1011 + 100 * p AS end_lsn, 'insert' AS msg_type FROM o")
def frames(spark, d):
    log = _log(cl.orders_log, spark, d).where((F.substring("payload", 1, 1) == F.lit(b"I")))
    raw = log.select(F.concat(F.lit(b"w"), cl.be(F.col("start_lsn"), 8), cl.be(F.col("end_lsn"), 8), F.lit(bytes(8)), F.col("payload")).alias("frame"))
    return parse_frames(raw).select("start_lsn", "end_lsn", message_type(F.col("payload")).alias("msg_type"))


@query("cdc28_monthly_partitions", f"WITH {_T} SELECT strftime(t.ts, '%Y%m') AS yyyymm, count(*) AS n FROM e JOIN t USING (t) WHERE NOT e.gone GROUP BY 1")
def monthly_partitions(spark, d):
    rows = _events(spark, d).events.select(F.date_format(F.timestamp_micros(F.col("commit_time") + wire.PG_EPOCH_US), "yyyyMM").alias("yyyymm"))
    return rows.groupBy("yyyymm").agg(F.count("*").alias("n"))


@query("cdc29_multi_slot_union", f"WITH {_E} SELECT 'slot_' || (t % 3) AS slot, count(*) AS n FROM e WHERE NOT gone GROUP BY t % 3")
def multi_slot_union(spark, d):
    return _events(spark, d, 3).events.groupBy("slot").agg(F.count("*").alias("n"))


@query("cdc31_throughput_1s", f"WITH {_T} SELECT epoch_us(date_trunc('second', t.ts)) // 1000000 AS unix_s, count(*) AS n FROM e JOIN t USING (t) WHERE NOT e.gone GROUP BY 1")
def throughput(spark, d):
    e = metrics.throughput(_events(spark, d).events)
    return e.select(F.unix_seconds("start").alias("unix_s"), F.col("rows").alias("n"))


@query("cdc32_latency_histogram", "SELECT v.le::DOUBLE AS le, count(*) FILTER (l_discount <= v.le) AS n FROM lineitem, (VALUES (0.001), (0.005), (0.01), (0.025), (0.05), (0.1), (0.25), (0.5), (1.0)) AS v(le) GROUP BY v.le")
def latency_histogram(spark, d):
    return metrics.histogram(spark.read.parquet(f"{d}/lineitem.parquet"), "l_discount", metrics.BATCH_BUCKETS).where("le < 2")


@query("cdc33_slot_checkpoints", "SELECT 'slot_' || (o_orderkey % 4) AS slot_name, arg_max(o_custkey, o_orderkey) AS confirmed_lsn, arg_max(o_orderkey * 2, o_orderkey) AS flushed_rows, max(o_orderkey) AS last_flush_time FROM orders GROUP BY 1")
def checkpoints(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("slot_"), (F.col("o_orderkey") % 4).cast("string")).alias("slot_name"), F.col("o_custkey").alias("confirmed_lsn"), (F.col("o_orderkey") * 2).alias("flushed_rows"), F.col("o_orderkey").alias("last_flush_time"))
    return pos.slot_checkpoints(o)


@query("cdc34_current_state", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def current_state(spark, d):
    s = sinks.current_state(_orders(spark, d).events)
    get = lambda c: F.get_json_object("data", f"$.{c}")
    return s.select(get("o_orderkey").cast("long").alias("o_orderkey"), get("o_orderstatus").alias("o_orderstatus"), get("o_totalprice").cast("double").alias("o_totalprice"))


@query("cdc35_lineitem_replay", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY l_returnflag")
def lineitem_replay(spark, d):
    e = replay(_log(cl.items_log, spark, d)).events
    v = lambda c, k: field(F.col("data"), c, k)
    return e.groupBy(v("l_returnflag", "string").alias("l_returnflag")).agg(F.count("*").alias("n"), F.sum(v("l_quantity", "double")).alias("quantity"), F.sum(v("l_linenumber", "bigint")).alias("lines"))


@query("cdc30_stream_equals_batch", f"WITH {_E} SELECT base + 10 * (1 + event_id % 5) AS lsn, 100000 + t AS xid, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op FROM e WHERE NOT gone")
def stream_equals_batch(spark, d):
    """The same log through the streaming source in five micro-batches, whose borders cut transactions; written and read back."""
    from walflow.sources.wal import WalSource
    from walflow.streaming.stream import drain, start_stream

    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    log = _log(cl.events_log, spark, d, 1)
    log.repartitionByRange(8, "seq").sortWithinPartitions("seq").write.parquet(f"{where}/frames")
    spark.dataSource.register(WalSource)
    size = -(-spark.read.parquet(f"{where}/frames").count() // 5)  # borders fall within transactions
    stream = spark.readStream.format("walflow_wal").options(path=f"{where}/frames", max_messages=size, checkpoint=f"{where}/checkpoint").load()
    drain(start_stream(spark, stream, f"{where}/out", f"{where}/checkpoint"))
    return sinks.read_changes(spark, f"{where}/out").select("lsn", "xid", "op")


# Message types that carry no row changes, encoded from tables.
def _coded(spark, rows, payload):
    return rows.select(F.lit("s").alias("slot"), F.monotonically_increasing_id().alias("seq"), payload.alias("payload"))


def _z(text):
    return F.concat(text.cast("string").cast("binary"), F.lit(b"\0"))


@query("cdc36_type_messages", "SELECT n_nationkey AS type_id, 'public' AS namespace, n_name AS name FROM nation")
def type_messages(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    return parse_messages(_coded(spark, n, F.concat(F.lit(b"Y"), cl.be(F.col("n_nationkey"), 4), F.lit(b"public\0"), _z(F.col("n_name"))))).select("type_id", "namespace", "name")


@query("cdc37_origin_messages", "SELECT s_suppkey * 1000003 AS origin_lsn, s_name AS origin_name FROM supplier")
def origin_messages(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return parse_messages(_coded(spark, s, F.concat(F.lit(b"O"), cl.be(F.col("s_suppkey") * 1000003, 8), _z(F.col("s_name"))))).select("origin_lsn", "origin_name")


@query("cdc38_logical_messages", "SELECT c_custkey % 2 = 1 AS transactional, c_custkey * 64 AS message_lsn, c_mktsegment AS prefix, c_name AS content FROM customer")
def logical_messages(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    name = F.col("c_name").cast("binary")
    m = parse_messages(_coded(spark, c, F.concat(F.lit(b"M"), cl.be(F.col("c_custkey") % 2, 1), cl.be(F.col("c_custkey") * 64, 8), _z(F.col("c_mktsegment")), cl.be(F.octet_length(name), 4), name)))
    return m.select("transactional", "message_lsn", "prefix", F.col("content").cast("string").alias("content"))


@query("cdc26b_truncate_tables", "SELECT c_nationkey AS truncate_options, count(*) AS n, sum(c_custkey)::BIGINT AS ids FROM customer GROUP BY c_nationkey")
def truncate_tables(spark, d):
    lists = spark.read.parquet(f"{d}/customer.parquet").groupBy("c_nationkey").agg(F.collect_list("c_custkey").alias("ids"))
    ids = F.aggregate(F.transform("ids", lambda i: cl.be(i, 4)), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    m = parse_messages(_coded(spark, lists, F.concat(F.lit(b"T"), cl.be(F.size("ids"), 4), cl.be(F.col("c_nationkey"), 1), ids)))
    return m.select("truncate_options", F.explode("relation_ids").alias("id")).groupBy(F.col("truncate_options").cast("long").alias("truncate_options")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("cdc39_connection_urls", "SELECT c_custkey, 'h' || c_nationkey AS host, CASE WHEN c_custkey % 2 = 0 THEN 5432 ELSE 6000 + c_nationkey END AS port, CASE WHEN c_custkey % 3 = 0 THEN 'postgres' ELSE 'u' || c_custkey END AS \"user\", CASE WHEN c_custkey % 5 = 0 THEN 'postgres' ELSE 'd' || c_custkey END AS \"database\" FROM customer")
def connection_urls(spark, d):
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{d}/customer.parquet")
    user = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("u"), k.cast("string"), F.lit(":p@")))
    port = F.when(k % 2 == 0, "").otherwise(F.concat(F.lit(":"), (F.col("c_nationkey") + 6000).cast("string")))
    url = F.concat(F.lit("postgres://"), user, F.lit("h"), F.col("c_nationkey").cast("string"), port, F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("/d"), k.cast("string"))), F.lit("?sslmode=off"))
    parts = c.select("c_custkey", L.url_parts(url).alias("u")).select("c_custkey", "u.*")
    return parts.withColumn("port", F.col("port").cast("long"))


_KEYED = f"WITH {_O}, k AS (SELECT *, 1010 + 100 * (n + p) AS lsn, 2 * o_orderkey + 2 AS xid, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(n + p), '%Y-%m-%d %H:%M:%S') AS t FROM o WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 1)"


def _key_deletes(spark, d):
    return _orders(spark, d).events.where("op = 'DELETE' and old_kind = 'K'")


@query("cdc40_json_lines", _KEYED + """ SELECT '{"lsn":' || lsn || ',"xid":' || xid || ',"op":"DELETE","table":"public.orders","data":"{\\"o_orderkey\\":' || o_orderkey || '}","before":null,"ts":"' || t || '"}' AS value FROM k""")
def json_lines(spark, d):
    return sinks.to_json_lines(sinks.to_sink_rows(_key_deletes(spark, d)))


@query("cdc41_values_text", _KEYED + """ SELECT '(' || lsn || ', ' || xid || ', ''DELETE'', ''public.orders'', ''{"o_orderkey":' || o_orderkey || '}'', NULL, ' || chr(39) || t || chr(39) || ')' AS value FROM k""")
def values_text(spark, d):
    return sinks.to_values_text(sinks.to_sink_rows(_key_deletes(spark, d)))


@query("cdc42_batch_stats", _KEYED + """ SELECT count(*) AS events, sum(64 + 13 + length('{"o_orderkey":' || o_orderkey || '}'))::BIGINT AS bytes, max(lsn + 10) AS max_commit_lsn FROM k""")
def flushed_batch(spark, d):
    return sinks.batch_stats(_key_deletes(spark, d))


_HEX = "lower(lpad(to_hex({0}), {1}, '0'))"


@query("cdc43_checkpoint_codec", "SELECT o_orderkey, " + _HEX.format("length('slot_' || o_orderkey)", 4) + " || lower(hex('slot_' || o_orderkey)) || " + " || ".join(_HEX.format(x, 16) for x in ("o_orderkey * 4096", "o_custkey", "o_orderkey * 1000000")) + " AS data, 'slot_' || o_orderkey AS slot, o_orderkey * 4096 AS lsn FROM orders")
def checkpoint_codec(spark, d):
    """Encoded and decoded again."""
    import pyarrow as pa

    def run(it):
        for batch in it:
            keys, custs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data = [wire.encode_checkpoint(f"slot_{k}", k * 4096, c, k * 1000000) for k, c in zip(keys, custs)]
            back = [wire.decode_checkpoint(x) for x in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.hex() for x in data]), pa.array([b[0] for b in back]), pa.array([b[1] for b in back], pa.int64())], ["o_orderkey", "data", "slot", "lsn"])

    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_custkey").mapInArrow(run, "o_orderkey long, data string, slot string, lsn long")


@query("cdc44_status_updates", "SELECT l_returnflag AS slot, '72' || " + " || ".join(_HEX.format(x, 16) for x in ("max(l_orderkey)", "max(l_partkey)", "max(l_suppkey)")) + " || repeat('0', 18) AS frame FROM lineitem GROUP BY l_returnflag")
def status_updates(spark, d):
    """The acknowledgement of each slot's furthest write, flush and apply positions."""
    updates = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("slot"), F.col("l_orderkey").alias("write_lsn"), F.col("l_partkey").alias("flush_lsn"), F.col("l_suppkey").alias("apply_lsn"))
    frame = F.concat(F.lit(b"r"), *[cl.be(F.col(c), 8) for c in ("write_lsn", "flush_lsn", "apply_lsn")], F.lit(bytes(9)))
    return pos.tracker(updates).select("slot", F.lower(F.hex(frame)).alias("frame"))


@query("cdc45_event_lists", f"WITH {_E} SELECT 100000 + t AS xid, count(*) AS events, min(base + 10 * (1 + event_id % 5)) AS first_lsn, max(base + 10 * (1 + event_id % 5)) AS last_lsn FROM e WHERE NOT gone GROUP BY t")
def event_lists(spark, d):
    t = with_event_lists(_events(spark, d).events)
    return t.select("xid", F.size("events").cast("long").alias("events"), F.col("events")[0]["lsn"].alias("first_lsn"), F.element_at("events", -1)["lsn"].alias("last_lsn"))


@query("cdc46_running_positions", "SELECT 'slot_' || (event_id % 3) AS slot, event_id AS seq, max(user_id) OVER (PARTITION BY event_id % 3 ORDER BY event_id) AS received_lsn FROM events")
def running_positions(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("slot_"), (F.col("event_id") % 3).cast("string")).alias("slot"), F.col("event_id").alias("seq"), F.col("user_id").alias("received_lsn"))
    return pos.running(e, ["received_lsn"])


@query("cdc47_peek_next", f"WITH {_TX} SELECT min(commit_lsn) AS next_lsn FROM tx")
def peek_next(spark, d):
    return queue.peek(_order_txns(spark, d))


def _unclosed(spark, d):
    """The events log in three slots without the closing messages of every seventh transaction; a message was sent at second `seq` of the year 2000."""
    log = _log(cl.events_log, spark, d, 3)
    place = F.expr("(seq - 10000) div 100")
    lost = (F.col("seq") >= 10000) & (place % 7 == 0) & (F.col("seq") % 100).isin(58, 60)
    return log.where(~lost).withColumn("send_time", F.col("seq") * 1_000_000)


_SEVENTH = f"{_E}, u AS (SELECT t, min(base) AS base, count(*) AS n FROM e WHERE t % 7 = 0 GROUP BY t)"


@query("cdc48_open_events", f"WITH {_SEVENTH} SELECT 'slot_' || (t % 3) AS slot, sum(n + CASE WHEN t % 40 = 7 THEN 1 ELSE 0 END)::BIGINT AS total_events, count(*) AS transactions FROM u GROUP BY t % 3")
def open_changes(spark, d):
    return open_events(replay(_unclosed(spark, d)).open)


@query("cdc49_stale", f"WITH {_SEVENTH} SELECT 'slot_' || (t % 3) AS slot, 100000 + t AS xid, base AS opened_seq FROM u WHERE base < 30000 - 3600")
def stale_transactions(spark, d):
    return stale(replay(_unclosed(spark, d)).marks, 3600, F.lit("2000-01-01 08:20:00").cast("timestamp")).select("slot", "xid", "opened_seq")


@query("cdc50_uncommitted_not_queued", f"WITH {_E} SELECT count(DISTINCT t) AS size, sum(1)::BIGINT AS total_events FROM e WHERE NOT gone AND t % 7 <> 0")
def uncommitted_not_queued(spark, d):
    done = replay(_unclosed(spark, d))
    waiting = done.open.select("slot", F.col("opened_seq").alias("txn_instance"), F.col("txn_xid").alias("xid")).distinct().withColumn("commit_lsn", F.lit(None).cast("long")).withColumn("event_count", F.lit(1).cast("long"))
    both = transactions(done.events).select(waiting.columns).unionByName(waiting)
    return queue.queue_stats(both, 0).select("size", "total_events")


@query("cdc51_flushed_by_table", f"WITH {_O} SELECT 'public.orders' AS \"table\", count(*) + count(*) FILTER (WHERE o_orderstatus <> 'O') AS value FROM o")
def flushed(spark, d):
    return metrics.flushed_by_table(_orders(spark, d).events)


@query("cdc52_commits_by_slot", f"WITH {_E} SELECT 'slot_' || (t % 3) AS slot, count(DISTINCT t) AS value FROM e WHERE NOT gone GROUP BY t % 3")
def commits(spark, d):
    return metrics.committed_by_slot(_events(spark, d, 3).events)


@query("cdc53_confirmed_rows", "SELECT 'slot_' || (o_orderkey % 4) AS slot_name, sum(o_custkey)::BIGINT AS total_rows, arg_max(o_custkey, o_orderkey) AS last_rows FROM orders GROUP BY 1")
def confirmed(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("slot_"), (F.col("o_orderkey") % 4).cast("string")).alias("slot_name"), F.col("o_orderkey").alias("confirmed_lsn"), F.col("o_custkey").alias("flushed_rows"), F.col("o_orderkey").alias("last_flush_time"))
    return pos.confirmed_rows(o)


@query("cdc54_publication", f"WITH {_O} SELECT 'public.orders' AS \"table\", 'INSERT' AS op, count(*) AS n FROM o UNION ALL SELECT 'public.orders', CASE WHEN o_orderstatus = 'P' THEN 'UPDATE' ELSE 'DELETE' END, count(*) FROM o WHERE o_orderstatus <> 'O' GROUP BY 2")
def published(spark, d):
    """Two tables in one log, of which one is published."""
    log = _log(cl.orders_log, spark, d).unionByName(_log(cl.events_log, spark, d, 1).withColumn("slot", F.lit("other")))
    known = relation_history(parse_messages(log.where(F.substring("payload", 1, 1) == F.lit(b"R"))))
    return replay(publication(log, known, ["public.orders"])).events.groupBy("table", "op").agg(F.count("*").alias("n"))


@query("cdc55_relation_by_name", "SELECT 'slot_0' AS slot, 16385 AS relation_id, 'user_id' AS key_columns, false AS is_full, 6 AS n_columns, 701 AS value_oid, true AS no_such_column")
def relation_by_name(spark, d):
    h = relation_history(parse_messages(_log(cl.events_log, spark, d, 1).where(F.substring("payload", 1, 1) == F.lit(b"R"))))
    c = F.col("columns")
    return by_name(h, "public.user_state").select(
        "slot", "relation_id", F.array_join(primary_key_columns(c), ",").alias("key_columns"), has_full_replica_identity(F.col("replica_identity")).alias("is_full"),
        column_count(c).cast("long").alias("n_columns"), column_named(c, "value")["type_oid"].alias("value_oid"), column_named(c, "note").isNull().alias("no_such_column"),
    )


@query("cdc56_tuple_predicates", "SELECT event_id % 7 = 0 AS is_null, event_id % 7 = 1 AS is_unchanged, event_id % 7 > 2 AS has_text, 6 AS cells, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2, 3")
def tuple_predicates(spark, d):
    m = parse_messages(_log(cl.events_log, spark, d, 1)).where("new_tuple is not null and relation_id = 16385 and seq % 100 between 10 and 50")
    last = F.col("new_tuple")[5]
    return m.groupBy(is_null(last).alias("is_null"), is_unchanged(last).alias("is_unchanged"), as_text(last).isNotNull().alias("has_text"), tuple_length(F.col("new_tuple")).cast("long").alias("cells")).agg(F.count("*").alias("n"))


@query("cdc57_keepalives", "SELECT CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'keepalive' END AS kind, CASE WHEN c_custkey % 5 = 0 THEN 'buffer_underflow' END AS frame_error, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 2 = 1 END AS reply_requested, max(CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 16 END) AS furthest, count(*) AS n FROM customer GROUP BY 1, 2, 3")
def keepalives(spark, d):
    """Keepalive frames, every fifth cut short."""
    k = F.col("c_custkey")
    frame = F.concat(F.lit(b"k"), cl.be(k * 16, 8), F.lit(bytes(8)), cl.be(k % 2, 1))
    raw = spark.read.parquet(f"{d}/customer.parquet").select(F.when(k % 5 == 0, F.substring(frame, 1, 12)).otherwise(frame).alias("frame"))
    return parse_frames(raw).groupBy("kind", "frame_error", "reply_requested").agg(F.max("end_lsn").alias("furthest"), F.count("*").alias("n"))


@query("cdc58_decoder_statistics", f"WITH {_MSG}, n AS (SELECT slot, count(*) AS messages FROM (SELECT 'slot_' || (t % 3) AS slot FROM m) GROUP BY slot) SELECT slot, messages + 2 AS messages FROM n")
def decoder_statistics(spark, d):
    return metrics.decoder_statistics(_log(cl.events_log, spark, d, 3)).select("slot", "messages")


@query("cdc59_recorded_source", f"WITH {_MSG} SELECT 'slot_' || (t % 3) AS slot, count(*) AS n, min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM m WHERE lsn >= 20000 AND t % 3 < 2 GROUP BY t % 3")
def recorded_source(spark, d):
    """The data source as a batch: two of three slots, from a start position on."""
    from walflow.sources.wal import WalSource

    where = f"{shared_dir(spark)}/recorded-{uuid.uuid4().hex}"
    _log(cl.events_log, spark, d, 3).where("start_lsn >= 10000").where(F.substring("payload", 1, 1) != F.lit(b"R")).write.parquet(where)
    spark.dataSource.register(WalSource)
    log = spark.read.format("walflow_wal").options(path=where, slot="slot", slots=2, start_lsn=20000).load()
    return log.groupBy("slot").agg(F.count("*").alias("n"), F.min("start_lsn").alias("first_lsn"), F.max("start_lsn").alias("last_lsn"))


@query("cdc60_minute_windows", f"WITH {_T} SELECT epoch_us(date_trunc('minute', t.ts)) // 1000000 AS unix_s, 'public.user_state' AS \"table\", count(*) AS n FROM e JOIN t USING (t) WHERE NOT e.gone GROUP BY 1")
def minute_windows(spark, d):
    w = with_late_windows(_events(spark, d).events.select("ts", "table"))
    return w.select(F.unix_seconds("window.start").alias("unix_s"), "table", F.col("rows").alias("n"))


@query("cdc61_sink_table", "SELECT * FROM (VALUES ('lsn', 'bigint'), ('xid', 'bigint'), ('op', 'string'), ('table', 'string'), ('data', 'string'), ('before', 'string'), ('ts', 'timestamp'), ('batch_id', 'bigint'), ('yyyymm', 'string')) AS v(col_name, data_type)")
def sink_table(spark, d):
    """The table that `init_table` makes, twice without harm."""
    name, path = f"walflow_{uuid.uuid4().hex}", f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    for _ in range(2):
        sinks.init_table(spark, name, path)
    fields = [(f.name, f.dataType.simpleString()) for f in spark.table(name).schema.fields]
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame(fields, "col_name string, data_type string")


@query("cdc62_now", "SELECT r_regionkey, true AS close FROM region")
def now(spark, d):
    """The current time in both directions, to ten seconds."""
    seconds = L.unix_seconds(L.now_pg_micros())
    return spark.read.parquet(f"{d}/region.parquet").select("r_regionkey", (F.abs(seconds - F.unix_timestamp()) <= 10).alias("close"))
