"""Conversations and their owners: recent messages, listings, authorisation, deletion and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F


def recent_messages(messages: DataFrame, most: int = 12) -> DataFrame:
    """H-01: of messages (conv_id, turn, ...) the last `most` of each conversation, with their place from the oldest."""
    w = W.partitionBy("conv_id")
    last = messages.withColumn("_n", F.row_number().over(w.orderBy(F.desc("turn")))).where(F.col("_n") <= most)
    return last.withColumn("place", F.max("_n").over(w) - F.col("_n") + 1).drop("_n")


def list_conversations(conversations: DataFrame, messages: DataFrame, most: int = 100) -> DataFrame:
    """H-03: conversations (conv_id, owner, updated_at) with message_count and, as title, the first user message; of each
    owner the `most` updated last, ties by conv_id."""
    user = F.col("role") == "user"
    told = messages.groupBy("conv_id").agg(F.count("*").alias("n"), F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("title"))
    place = F.row_number().over(W.partitionBy("owner").orderBy(F.desc("updated_at"), "conv_id"))
    listed = conversations.join(told, "conv_id", "left").withColumn("place", place).where(F.col("place") <= most)
    return listed.withColumn("message_count", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def authorize(requests: DataFrame, users: DataFrame) -> DataFrame:
    """H-04: requests (actor, owner, ...) with allowed and cross_owner. An active user may see what is their own, an
    active admin what is any user's; unknown and inactive actors nothing."""
    actors = users.select(F.col("user_id").alias("actor"), "role", "is_active")
    owners = users.select(F.col("user_id").alias("owner"), F.lit(True).alias("_known"))
    both = requests.join(actors, "actor", "left").join(owners, "owner", "left")
    own = F.col("actor") == F.col("owner")
    allowed = F.coalesce(F.col("is_active") & F.coalesce("_known", F.lit(False)) & (own | (F.col("role") == "admin")), F.lit(False))
    return both.withColumns({"allowed": allowed, "cross_owner": allowed & ~own}).select(*requests.columns, "allowed", "cross_owner")


def owned_sessions(conversations: DataFrame, requests: DataFrame) -> DataFrame:
    """H-05: the asked sessions (actor, conv_id) that the actor owns; admins are no exception."""
    owned = conversations.select("conv_id", F.col("owner").alias("actor"))
    return requests.select("actor", "conv_id").distinct().join(owned, ["conv_id", "actor"])


def delete_conversations(requests: DataFrame, conversations: DataFrame, users: DataFrame) -> DataFrame:
    """H-06: (request_id, conv_id) that may go. All conversations of a request (request_id, actor, conv_id) must exist and
    be owned by its actor, who must be active; else none of them goes. What hangs on them is left_anti-joined by conv_id."""
    active = users.where("is_active").select(F.col("user_id").alias("actor"), F.lit(True).alias("_active"))
    asked = requests.distinct().join(conversations.select("conv_id", "owner"), "conv_id", "left").join(active, "actor", "left")
    good = F.coalesce((F.col("owner") == F.col("actor")) & F.col("_active"), F.lit(False))
    passed = asked.groupBy("request_id").agg(F.bool_and(good).alias("ok")).where("ok").select("request_id")
    return asked.join(passed, "request_id", "left_semi").select("request_id", "conv_id")


def audit_events(requests: DataFrame, users: DataFrame) -> DataFrame:
    """H-07: an event for each allowed request (request_id, actor, owner, action) across owners."""
    return authorize(requests, users).where("cross_owner").select("request_id", "actor", F.concat("action", F.lit(".cross_owner")).alias("action"), "owner")


def list_users(users: DataFrame) -> DataFrame:
    """H-08: users (user_id, username) in the order of username, null last, then of id."""
    return users.select("user_id", "username").orderBy(F.asc_nulls_last("username"), "user_id")


def first_insert_wins(table: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """H-09: table and those incoming rows whose key it does not hold, of equal new keys the first by `order`."""
    first = incoming.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
    return table.unionByName(first.join(table.select(*keys), keys, "left_anti").select(table.columns))
