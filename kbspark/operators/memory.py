"""Memory tables: facts from JSON payloads, expiry and the active items of an owner."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.text import collapse, let

# Fact types in order, and the limits of a payload.
TYPES = ("task", "constraint", "entity", "open_question")
MOST_PER_TYPE, MOST_FACTS, KEY_CHARS, VALUE_CHARS = 4, 12, 120, 500

_ENTRIES = r"ARRAY<(?:VOID|OBJECT<confidence: (?:BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\s?\d+\)), key: STRING, value: STRING>)>"
_SHAPE = "^OBJECT<" + ", ".join(f"{t}: {_ENTRIES}" for t in sorted(TYPES)) + ">$"


def parse_facts(turns: DataFrame, payload: str) -> DataFrame:
    """turns with memory_type, key, value, confidence, a row for each fact of the payload.

    A payload is one JSON object of exactly the four types, each with at most 4 entries of exactly key, value and
    confidence; key and value are filled strings of at most 120 and 500 characters once white space is collapsed,
    confidence a number from 0 to 1. Of facts of one type whose keys differ in case only the first stays. A payload
    that breaks a rule, or has more than 12 facts, gives no row; so does null.
    """
    entry = "array<struct<key:string,value:string,confidence:double>>"
    raw = F.from_json(payload, "struct<" + ",".join(f"{t}:{entry}" for t in TYPES) + ">")
    rows = turns.withColumn("_shape", F.schema_of_variant(F.try_parse_json(payload))).where(F.col("_shape").rlike(_SHAPE)).withColumn("_raw", raw)

    def facts(kind: str):
        return F.transform(
            F.col(f"_raw.{kind}"),
            lambda e: F.struct(F.lit(kind).alias("memory_type"), collapse(e["key"]).alias("key"), collapse(e["value"]).alias("value"), e["confidence"].alias("confidence")),
        )

    rows = rows.withColumn("_facts", F.concat(*[facts(t) for t in TYPES]))
    right = lambda f: F.coalesce(F.length(f["key"]).between(1, KEY_CHARS) & F.length(f["value"]).between(1, VALUE_CHARS) & f["confidence"].between(0, 1), F.lit(False))
    few = F.lit(True)
    for t in TYPES:
        few = few & (F.size(f"_raw.{t}") <= MOST_PER_TYPE)
    rows = rows.where(few & F.forall("_facts", right))
    identity = lambda f: F.concat_ws(":", f["memory_type"], F.lower(f["key"]))
    once = let(F.transform("_facts", identity), lambda ids: F.filter("_facts", lambda f, i: F.array_position(ids, identity(f)) == i + 1))
    rows = rows.withColumn("_facts", once).where(F.size("_facts") <= MOST_FACTS).withColumn("_fact", F.explode("_facts"))
    return rows.select(*turns.columns, "_fact.memory_type", "_fact.key", "_fact.value", "_fact.confidence")


def expire_due(memories: DataFrame, as_of) -> DataFrame:
    """Active memories whose time has come get the status expired."""
    due = (F.col("status") == "active") & (F.col("expires_at") <= F.lit(as_of).cast("timestamp"))
    return memories.withColumn("status", F.when(due, "expired").otherwise(F.col("status")))


def active_memories(memories: DataFrame, most: int = 5) -> DataFrame:
    """The latest `most` active memories of each owner, with their place; ties by memory_id."""
    place = F.row_number().over(W.partitionBy("owner").orderBy(F.desc("updated_at"), "memory_id"))
    return memories.where("status = 'active'").withColumn("place", place).where(F.col("place") <= most)


def latest_summary(summaries: DataFrame) -> DataFrame:
    """M-02: (session_id, version, summary) of each session's largest version."""
    return summaries.groupBy("session_id").agg(F.max("version").alias("version"), F.max_by("summary", "version").alias("summary"))


def upsert_facts(facts: DataFrame) -> DataFrame:
    """M-05: of facts (session_id, memory_type, key, value, confidence, sort_order, seq) the latest of each session, type and
    key, with place, its rank in the session by sort_order and then by when the key came first."""
    last = facts.groupBy("session_id", "memory_type", "key").agg(F.min("seq").alias("_first"), F.max("seq").alias("seq"), F.max_by(F.struct("value", "confidence", "sort_order"), "seq").alias("l"))
    place = F.row_number().over(W.partitionBy("session_id").orderBy("l.sort_order", "_first"))
    return last.select("session_id", "memory_type", "key", "seq", "l.value", "l.confidence", "l.sort_order", place.alias("place"))


def upsert_memory(memories: DataFrame, sessions: DataFrame, days: int = 90) -> DataFrame:
    """M-10: of memories (owner, session_id, memory_type, key, value, at, ttl_days) the latest of each owner, type and key, with
    expires_at; those whose session is not the owner's (sessions: session_id, owner) don't count."""
    valid = memories.join(sessions.select("session_id", "owner"), ["session_id", "owner"], "left_semi")
    last = valid.groupBy("owner", "memory_type", "key").agg(F.max_by(F.struct("value", "at", "ttl_days"), F.struct("at", "session_id")).alias("m"))
    ttl = F.coalesce("m.ttl_days", F.lit(days)).cast("int")
    return last.select("owner", "memory_type", "key", "m.value", F.expr("m.at").alias("updated_at"), (F.col("m.at") + F.make_dt_interval(ttl)).alias("expires_at"))


def change_memories(memories: DataFrame, changes: DataFrame, most_days: int = 365) -> DataFrame:
    """M-13: memories (memory_id, status, value, updated_at, expires_at) after changes (memory_id, action, new_value, at,
    ttl_days): active ones alone are updated, with a new end at most `most_days` on, or deleted, which keeps the row."""
    both = memories.join(changes, "memory_id", "left")
    live = F.col("status") == "active"
    update, delete = live & (F.col("action") == "update"), live & (F.col("action") == "delete")
    ttl = F.least(F.col("ttl_days"), F.lit(most_days)).cast("int")
    return both.select(
        "memory_id", F.when(delete, "deleted").otherwise(F.col("status")).alias("status"), F.when(update, F.coalesce("new_value", "value")).otherwise(F.col("value")).alias("value"),
        F.when(update | delete, F.col("at")).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(update & ttl.isNotNull(), F.col("at") + F.make_dt_interval(ttl)).otherwise(F.col("expires_at")).alias("expires_at"),
    )
