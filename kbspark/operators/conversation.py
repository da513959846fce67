"""Conversation history: normalised questions, prior turns and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import questions as Q
from ..functions.text import collapse

ANSWER_CHARS = 800


def latest_prior_user(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, prior_turn) for each user message: the latest earlier user message of the conversation whose
    normalised text differs. A run of equal messages shares the prior of its first."""
    users = messages.where("role = 'user'").select("conv_id", "turn", collapse(F.col("text")).alias("norm"))
    w = W.partitionBy("conv_id").orderBy("turn")
    lagged = users.withColumns({"_turn": F.lag("turn").over(w), "_norm": F.lag("norm").over(w)})
    prior = F.when(F.col("_norm").isNotNull() & (F.col("_norm") != F.col("norm")), F.col("_turn"))
    return lagged.select("conv_id", "turn", F.last(prior, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("prior_turn"))


def next_versions(summaries: DataFrame, new: DataFrame) -> DataFrame:
    """New summaries (session_id, seq, summary) numbered on from each session's largest version."""
    last = summaries.groupBy("session_id").agg(F.max("version").alias("last"))
    rn = F.row_number().over(W.partitionBy("session_id").orderBy("seq"))
    return new.withColumn("rn", rn).join(last, "session_id", "left").select("session_id", (F.coalesce("last", F.lit(0)) + F.col("rn")).alias("version"), "summary")


def append_messages(conversations: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H-02: conversations (conv_id, revision, updated_at) after messages (conv_id, seq, at, ...), and the messages with revision, that
    of their conversation once they were appended in the order of seq; new conversations begin with revision 1."""
    news = messages.groupBy("conv_id").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    both = conversations.join(news, "conv_id", "full_outer")
    after = both.select("conv_id", (F.coalesce("revision", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("revision"), F.coalesce("_at", "updated_at").alias("updated_at"))
    number = F.row_number().over(W.partitionBy("conv_id").orderBy("seq"))
    told = messages.withColumn("_k", number).join(conversations.select("conv_id", F.col("revision").alias("_before")), "conv_id", "left")
    return after, told.withColumn("revision", (F.coalesce("_before", F.lit(0)) + F.col("_k")).cast("long")).drop("_k", "_before")


def revisions(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count("*").alias("revision"), F.max("turn").alias("last_turn"))


def prior_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, question, prior_user, prior_answer) for each user message of messages (conv_id, turn, role, text).

    The prior question is the latest earlier filled one that differs once normalised; its answer is the first filled
    assistant message before the next user message, cut to 800 characters. Null texts count as blank. Frames only run
    forward, so a long conversation needs one sorted pass and no buffer.
    """
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = messages.select("conv_id", "turn", "role", collapse(F.coalesce("text", F.lit(""))).alias("norm"))
    rows = rows.withColumn("_segment", F.sum((F.col("role") == "user").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    user, reply = F.col("role") == "user", (F.col("role") == "assistant") & (F.col("norm") != "")
    asked = rows.groupBy("conv_id", "_segment").agg(
        F.max(F.when(user, F.col("turn"))).alias("turn"), F.max(F.when(user, F.col("norm"))).alias("question"),
        F.substring(F.min_by(F.when(reply, F.col("norm")), F.when(reply, F.col("turn"))), 1, ANSWER_CHARS).alias("reply"),
    ).where("turn IS NOT NULL")
    filled = F.col("question") != ""
    last = F.last(F.when(filled, F.struct("question", "reply")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    asked = asked.withColumn("_last", last)
    changed = F.when(filled & (F.col("_last.question") != F.col("question")), F.col("_last"))
    run = F.last(changed, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    asked = asked.withColumn("_prior", F.when(filled, run).otherwise(F.col("_last")))
    return asked.select("conv_id", "turn", "question", F.col("_prior.question").alias("prior_user"), F.col("_prior.reply").alias("prior_answer"))


def rewrite(turns: DataFrame, external: str | None = None) -> DataFrame:
    """turns of prior_turns with mode, query and fallback_used.

    mode is llm for complex questions, which take the rewriting in the named column if it is valid; the others, and
    those without a valid one, get the query made from the prior turn (follow_up) or stay as they are (passthrough).
    """
    made = Q.retrieval_query(F.col("question"), F.col("prior_user"), F.col("prior_answer"))
    given = Q.valid_rewrite(F.col(external)) if external else F.lit(None).cast("string")
    turns = turns.withColumns({"_made": made, "_hard": Q.is_complex(F.col("question"))}).withColumn("_given", F.when(F.col("_hard"), given))
    mode = F.when(F.col("_hard"), "llm").when(F.col("_made") != F.col("question"), "follow_up").otherwise("passthrough")
    return turns.withColumns(
        {"mode": mode, "query": F.coalesce("_given", "_made"), "fallback_used": F.col("_hard") & F.col("_given").isNull()}
    ).drop("_made", "_hard", "_given")


def rewrite_summary(turns: DataFrame) -> DataFrame:
    """Share of questions that call a model and that fall back, and number of each mode."""
    share = lambda c: F.round(F.avg(c.cast("int")), 4)
    return turns.agg(
        F.count("*").alias("questions"), share(F.col("mode") == "llm").alias("llm_call_rate"), share(F.col("fallback_used")).alias("fallback_rate"),
        *[F.count_if(F.col("mode") == m).alias(m) for m in ("passthrough", "follow_up", "llm")],
    )
