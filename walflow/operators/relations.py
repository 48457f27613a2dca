"""Table metadata: history, latest versions, and the as-of lookup of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walflow.functions.values import row_plan

#: Histories up to this many versions are broadcast with their validity ranges; longer ones use a window.
BROADCAST_VERSIONS = 10_000


def relation_history(messages: DataFrame) -> DataFrame:
    """Every version of every relation: valid from `seq` until the next one."""
    rows = messages.where("msg_type = 'relation'").select("slot", "seq", "relation_id", "namespace", "name", F.concat_ws(".", "namespace", "name").alias("full_name"), "replica_identity", "columns")
    keys = F.expr("filter(sequence(0, greatest(size(columns), 1) - 1), i -> i < size(columns) and columns[i].flags & 1 = 1)")
    until = F.lead("seq").over(Window.partitionBy("slot", "relation_id").orderBy("seq"))
    return rows.withColumn("primary_key_indices", keys).withColumn("until_seq", until)


def by_name(history: DataFrame, full_name: str) -> DataFrame:
    """The latest version of the relation of that name, if its id has no newer name."""
    return history.where("until_seq is null").where(F.col("full_name") == full_name)


def current_relations(messages: DataFrame) -> DataFrame:
    """The latest version of each relation; a renamed one is known by its new name only."""
    return relation_history(messages).where("until_seq is null").drop("until_seq")


def publication(frames: DataFrame, history: DataFrame, tables: list[str]) -> DataFrame:
    """The frames less the changes of tables that are not in `tables` (full names, as of each change), told by the relation id in the payload, so nothing is decoded for it."""
    change = F.coalesce(F.substring("payload", 1, 1).isin(F.lit(b"I"), F.lit(b"U"), F.lit(b"D")), F.lit(False))
    rows = frames.withColumn("_rel", F.when(change, F.expr("cast(conv(hex(substring(payload, 2, 4)), 16, 10) as bigint)")))
    names = history.select(F.col("slot").alias("_s"), F.col("relation_id").alias("_r"), F.col("seq").alias("_from"), F.col("until_seq").alias("_until"), F.col("full_name").alias("_name"))
    as_of = (F.col("slot") == F.col("_s")) & (F.col("_rel") == F.col("_r")) & (F.col("seq") >= F.col("_from")) & (F.col("_until").isNull() | (F.col("seq") < F.col("_until")))
    other = names.where(~F.col("_name").isin(*tables))
    return rows.join(other, as_of, "left_anti").select(frames.columns)


def primary_key_columns(columns):
    """Names of the key columns."""
    return F.transform(F.filter(columns, lambda c: c["flags"].bitwiseAND(1) == 1), lambda c: c["name"])


def has_full_replica_identity(identity):
    return identity == "full"


def column_count(columns):
    return F.size(columns)


def column_named(columns, name: str):
    """The column of that name (of several the first), null if there is none."""
    return F.try_element_at(F.filter(columns, lambda c: c["name"] == name), F.lit(1))


def is_key(column):
    return column["flags"].bitwiseAND(1) == 1


def with_relation(messages: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Changes with `full_name`, `rel_columns` and `rel_plan` of their relation as of their place in the stream (null: unknown).

    `history` saves a second decoding of the log where relation messages were split off by their tag.
    """
    dml = messages.where(F.col("msg_type").isin("insert", "update", "delete"))
    history = relation_history(messages) if history is None else history
    history = history.select("slot", F.col("relation_id"), F.col("seq").alias("from_seq"), "until_seq", "full_name", F.col("columns").alias("rel_columns"), row_plan(F.col("columns")).alias("rel_plan"))
    if history.limit(BROADCAST_VERSIONS + 1).count() <= BROADCAST_VERSIONS:
        h = F.broadcast(history.withColumnsRenamed({"slot": "_slot", "relation_id": "_rel"}))
        on = (dml["slot"] == h["_slot"]) & (dml["relation_id"] == h["_rel"]) & (dml["seq"] >= h["from_seq"]) & (h["until_seq"].isNull() | (dml["seq"] < h["until_seq"]))
        return dml.join(h, on, "left").drop("_slot", "_rel", "from_seq", "until_seq")
    opened = history.select("slot", "relation_id", F.col("from_seq").alias("seq"), F.lit("relation").alias("msg_type"), F.struct("full_name", "rel_columns", "rel_plan").alias("_own"))
    both = dml.unionByName(opened, allowMissingColumns=True)
    seen = Window.partitionBy("slot", "relation_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_v", F.last("_own", True).over(seen)).where("msg_type <> 'relation'")
    return both.withColumns({"full_name": F.col("_v.full_name"), "rel_columns": F.col("_v.rel_columns"), "rel_plan": F.col("_v.rel_plan")}).drop("_v", "_own")
