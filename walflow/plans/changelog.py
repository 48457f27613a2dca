"""Deterministic change logs encoded from base tables, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from walflow.functions import wire

PG_2024 = 757_382_400_000_000
ORDERS_REL, STATE_REL, ITEMS_REL, GHOST_REL = 16384, 16385, 16386, 99999
ORDER_COLUMNS = [("o_orderkey", 20, True), ("o_custkey", 20, False), ("o_orderstatus", 25, False), ("o_totalprice", 701, False), ("o_orderdate", 1114, False), ("o_orderpriority", 25, False)]
STATE_COLUMNS = [("user_id", 20, True), ("event_type", 25, False), ("value", 701, False), ("props", 3802, False), ("ts", 1114, False), ("note", 25, False)]
ITEM_COLUMNS = [
    ("r", 20, True), ("l_orderkey", 20, False), ("l_partkey", 20, False), ("l_suppkey", 20, False), ("l_linenumber", 23, False), ("l_quantity", 701, False), ("l_extendedprice", 701, False),
    ("l_discount", 701, False), ("l_tax", 701, False), ("l_returnflag", 25, False), ("l_linestatus", 25, False), ("l_shipdate", 1114, False),
]


def be(x: Column, n: int) -> Column:
    """n big-endian bytes of a number that is not negative."""
    return F.unhex(F.lpad(F.hex(x.cast("long")), 2 * n, "0"))


def num(x: int, n: int) -> Column:
    return F.lit(x.to_bytes(n, "big"))


def cell(text: Column) -> Column:
    data = text.cast("string").cast("binary")
    return F.when(text.isNull(), F.lit(b"n")).otherwise(F.concat(F.lit(b"t"), be(F.octet_length(data), 4), data))


def cells(*parts: Column) -> Column:
    return F.concat(num(len(parts), 2), *parts)


def begin(xid, final_lsn, time):
    return F.concat(F.lit(b"B"), be(final_lsn, 8), be(time, 8), be(xid, 4))


def commit(lsn, end, time):
    return F.concat(F.lit(b"C\0"), be(lsn, 8), be(end, 8), be(time, 8))


def insert(rel, new):
    return F.concat(F.lit(b"I"), num(rel, 4), F.lit(b"N"), new)


def update(rel, new, old=None, kind="O"):
    head = [F.lit(b"U"), num(rel, 4)]
    return F.concat(*head, *([F.lit(kind.encode()), old] if old is not None else []), F.lit(b"N"), new)


def delete(rel, old, kind="O"):
    return F.concat(F.lit(b"D"), num(rel, 4), F.lit(kind.encode()), old)


def micros(ts: Column) -> Column:
    """PG microseconds of a timestamp column without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2000-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def frames(rows: DataFrame, messages: Column, slot: Column) -> DataFrame:
    """Explodes arrays of (start_lsn, payload), null payloads left out; order is that of start_lsn."""
    out = rows.select(slot.alias("slot"), F.explode(messages).alias("m")).where("m.payload is not null")
    return out.select("slot", F.col("m.start_lsn").alias("seq"), F.col("m.start_lsn").alias("start_lsn"), (F.col("m.start_lsn") + 1).alias("end_lsn"), F.lit(0).cast("long").alias("send_time"), F.col("m.payload").alias("payload"))


def at(lsn: Column, payload: Column) -> Column:
    return F.struct(lsn.cast("long").alias("start_lsn"), payload.alias("payload"))


def relation_frames(spark: SparkSession, rows) -> DataFrame:
    """Frames of relation messages: (slot, lsn, payload)."""
    return spark.createDataFrame([(s, lsn, lsn, lsn + 1, 0, p) for s, lsn, p in rows], "slot string, seq long, start_lsn long, end_lsn long, send_time long, payload binary")


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts of all orders in a permuted order, then updates and deletes by status."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = orders.count()
    k = F.col("o_orderkey")
    o = orders.withColumn("p", (k * 7919) % max(n, 1)).withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))

    def row(status):
        return cells(*[cell(x) for x in (k, F.col("o_custkey"), status, F.col("o_totalprice"), F.col("d"), F.col("o_orderpriority"))])

    whole = row(F.col("o_orderstatus"))
    key_only = cells(cell(k), *[F.lit(b"n")] * 5)
    status = F.col("o_orderstatus")
    second = F.when(status == "P", update(ORDERS_REL, row(F.lit("O")), whole)).when((status == "F") & (k % 2 == 0), delete(ORDERS_REL, whole)).when(status == "F", delete(ORDERS_REL, key_only, "K"))
    messages = []
    for turn, place, change in ((1, F.col("p"), insert(ORDERS_REL, whole)), (2, F.col("p") + n, second)):
        base, time = place * 100 + 1000, place * 1_000_000 + PG_2024
        has = F.lit(True) if turn == 1 else second.isNotNull()
        messages += [at(base, F.when(has, begin(k * 2 + turn, base + 20, time))), at(base + 10, change), at(base + 20, F.when(has, commit(base + 20, base + 30, time)))]
    log = frames(o, F.array(*messages), F.lit("slot_0"))
    return log.unionByName(relation_frames(spark, [("slot_0", 500, wire.relation(ORDERS_REL, "public", "orders", "f", ORDER_COLUMNS))]))


def events_log(spark: SparkSession, sf_dir: str, slots: int = 1) -> DataFrame:
    """Five events a transaction: all change kinds, streamed, aborted, empty, orphan and unknown-relation cases."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("us", micros("ts")).withColumn("d", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    i = F.col("event_id")
    ev = ev.withColumn("t", F.floor(i / 5)).withColumn("j", i % 5).withColumn("base", F.col("t") * 100 + 10000)
    note = F.when(i % 7 == 0, F.lit(b"n")).when(i % 7 == 1, F.lit(b"u")).when(i % 7 == 2, F.concat(F.lit(b"b"), num(4, 4), be(i, 4))).otherwise(cell(F.concat(F.lit("n"), i.cast("string"))))

    def row(kind, value):
        return cells(cell(F.col("user_id")), cell(kind), cell(value), cell(F.col("props")), cell(F.col("d")), note)

    new = row(F.col("event_type"), F.col("value"))
    key = cells(cell(F.col("user_id")), *[F.lit(b"n")] * 5)
    kind = F.col("event_type")
    change = (
        F.when(kind == "signup", insert(STATE_REL, new)).when(kind == "view", update(STATE_REL, new)).when(kind == "click", update(STATE_REL, new, key, "K"))
        .when(kind == "purchase", update(STATE_REL, new, row(F.lit("prev"), F.lit("0")))).otherwise(delete(STATE_REL, key, "K"))
    )
    slot = lambda t: F.lit("slot_0") if slots == 1 else F.concat(F.lit("slot_"), (t % slots).cast("string"))
    t = F.col("t")
    changes = frames(ev, F.array(at(F.col("base") + (F.col("j") + 1) * 10, change)), slot(t))
    txn = ev.groupBy("t").agg(F.max_by("us", "event_id").alias("time"), F.first("base").alias("base"))
    base, time, xid = F.col("base"), F.col("time"), t + 100000
    streamed = t % 10 == 3
    tag = lambda c, *parts: F.concat(F.lit(c), *parts)
    s_commit = tag(b"c", be(xid, 4), F.lit(b"\0"), be(base + 60, 8), be(base + 70, 8), be(time, 8))
    abort = lambda sub: tag(b"A", be(xid, 4), be(sub, 4))
    orphan = insert(STATE_REL, cells(*[cell(F.lit(str(x))) for x in ("1", "signup", "0", "{}", "x", "orphan")]))
    messages = F.array(
        at(base, F.when(streamed, tag(b"S", be(xid, 4), F.lit(b"\x01"))).otherwise(begin(xid, base + 60, time))),
        at(base + 33, F.when(streamed, F.lit(b"E"))), at(base + 36, F.when(streamed, tag(b"S", be(xid, 4), F.lit(b"\0")))), at(base + 53, F.when(streamed, F.lit(b"E"))),
        at(base + 55, F.when(t % 50 == 11, insert(GHOST_REL, cells(cell(F.lit("1")))))),
        at(base + 58, F.when(t % 30 == 23, abort(xid + 1_000_000))),
        at(base + 60, F.when(t % 30 == 13, abort(xid)).when(streamed, s_commit).otherwise(commit(base + 60, base + 70, time))),
        at(base + 75, F.when(t % 40 == 7, orphan)),
        at(base + 80, F.when(t % 25 == 0, begin(t + 500000, base + 90, time))), at(base + 90, F.when(t % 25 == 0, commit(base + 90, base + 95, time))),
    )
    n = txn.count()
    renamed = [(c if c != "note" else "remark", o, key) for c, o, key in STATE_COLUMNS]
    relations = [
        (f"slot_{s}", lsn, wire.relation(STATE_REL, "public", "user_state", "d", columns))
        for s in range(slots) for lsn, columns in ((5000, STATE_COLUMNS), (10000 + 100 * (n // 2) - 5, renamed))
    ]
    return changes.unionByName(frames(txn, messages, slot(t))).unionByName(relation_frames(spark, relations))


def items_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts of lineitem, a transaction for each order; the same log however the table is read."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("d", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
    names = [c if c != "l_shipdate" else "d" for c, _, _ in ITEM_COLUMNS[1:]]
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", *[c for c in names if c not in ("l_orderkey", "l_linenumber")]))).alias("lines"))
    base, time = F.col("l_orderkey") * 1000 + 1000, F.lit(PG_2024)

    def line(x, i):
        r = F.col("l_orderkey") * 1000 + i
        return at(base + i + 1, insert(ITEMS_REL, cells(cell(r), *[cell(F.col(c) if c == "l_orderkey" else x[c]) for c in names])))

    end = base + F.size("lines") + 1
    messages = F.concat(F.array(at(base, begin(F.col("l_orderkey"), end, time))), F.transform("lines", line), F.array(at(end, commit(end, end + 1, time))))
    log = frames(lines, messages, F.lit("slot_0"))
    return log.unionByName(relation_frames(spark, [("slot_0", 500, wire.relation(ITEMS_REL, "public", "lineitem", "f", ITEM_COLUMNS))]))
