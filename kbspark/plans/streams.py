"""Registered queries that stream the given tables through operators with state; SQL says what they come to."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import stateful, sync
from ..streaming.history import _shared
from .more import _stamp
from .queries import _t, query


@query("""SELECT conv_id, turn, role, n - rn + 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn, least(count(*) OVER (PARTITION BY conv_id), 3) AS n FROM conversations) WHERE rn <= 3""")
def recent_history_stream(spark, sf_dir):
    messages = stateful.stream_of(spark, f"{sf_dir}/conversations.parquet")
    return stateful.recent_history_stream(messages, 3).select("conv_id", "turn", "role", F.col("place").cast("long").alias("place"))


# Memories of events: the user's statement under the kind of event, for event_id % 20 + 1 days.
@query("""WITH m AS (SELECT user_id AS owner, event_type AS key, props AS value, ts, ts + INTERVAL 1 DAY * (event_id % 20 + 1) AS ends, max(ts) OVER () AS now FROM events),
 r AS (SELECT *, row_number() OVER (PARTITION BY owner, key ORDER BY ts DESC, value DESC) AS rn FROM m)
 SELECT owner, key, value, CASE WHEN ends <= now THEN 'expired' ELSE 'active' END AS status, ts::VARCHAR AS updated_at, ends::VARCHAR AS expires_at FROM r WHERE rn = 1""")
def memory_ttl_stream(spark, sf_dir):
    e = stateful.stream_of(spark, f"{sf_dir}/events.parquet")
    memories = e.select(F.col("user_id").alias("owner"), F.lit("fact").alias("memory_type"), F.col("event_type").alias("key"), F.col("props").alias("value"), F.col("ts").alias("at"), (F.col("event_id") % 20 + 1).alias("ttl_days"))
    return stateful.memory_ttl_stream(memories).select("owner", "key", "value", "status", _stamp("updated_at"), _stamp("expires_at"))


# Jobs of events: a user's events are what happens to the job of that number; one day without news fails it.
_JOBS = """e AS (SELECT user_id AS job_id, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'parsing' WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status, ts, max(ts) OVER () AS now FROM events),
n AS (SELECT *, status NOT IN ('failed', 'completed') AND coalesce(lead(ts) OVER (PARTITION BY job_id ORDER BY ts, status), now) > ts + INTERVAL 1 DAY AS stale FROM e),
b AS (SELECT *, coalesce(sum(stale::INT) OVER (PARTITION BY job_id ORDER BY ts, status ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS live FROM n),
g AS (SELECT job_id, arg_max({'s': status, 't': ts, 'x': stale}, (ts, status)) FILTER (live) AS l, count(*) FILTER (live AND status = 'failed') AS failed, max(ts) FILTER (live AND status IN ('failed', 'completed')) AS ended, count(*) FILTER (NOT live) AS dropped FROM b GROUP BY 1)"""
_JOBS_SQL = f"""WITH {_JOBS} SELECT job_id, CASE WHEN l.x THEN 'failed' ELSE l.s END AS status, l.t::VARCHAR AS updated_at, (failed + l.x::INT)::INT AS retry_count, CASE WHEN l.x THEN l.t + INTERVAL 1 DAY ELSE ended END::VARCHAR AS finished_at, l.x AS stale, dropped FROM g"""


def _job_events(e):
    kinds = F.create_map(*[F.lit(x) for x in ("click", "running", "view", "parsing", "signup", "queued", "error", "failed", "purchase", "completed")])
    return e.select(F.col("user_id").alias("job_id"), kinds[F.col("event_type")].alias("status"), F.col("ts").alias("at"))


def _job_rows(rows):
    return rows.select("job_id", "status", _stamp("updated_at"), "retry_count", _stamp("finished_at"), "stale", "dropped")


@query(_JOBS_SQL)
def stale_job_stream(spark, sf_dir):
    return _job_rows(stateful.stale_job_stream(_job_events(stateful.stream_of(spark, f"{sf_dir}/events.parquet")), 86_400))


@query(_JOBS_SQL)
def replay_jobs(spark, sf_dir):
    events = _job_events(_t(spark, sf_dir, "events"))
    now = events.agg(F.max("at")).first()[0]  # the time that a user gives
    return _job_rows(stateful.replay_jobs(events, now, 86_400))


@query("""SELECT 'd' || doc_id AS source_key, sha256(CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN text || '!' ELSE text END) AS file_hash FROM documents WHERE doc_id % 5 = 0 OR doc_id % 11 <> 0
 UNION ALL SELECT 'm' || doc_id, sha256(text) FROM documents WHERE doc_id % 22 = 0""")
def sync_stream(spark, sf_dir):
    """Three rounds of changes to the documents: most come; some change and some go; the rest come, some under a new name."""
    docs, n = _t(spark, sf_dir, "documents"), F.col("doc_id")
    key = lambda prefix: F.concat(F.lit(prefix), n.cast("string"))
    row = lambda rows, name, text, seq, deleted=F.lit(False): rows.select(name.alias("source_key"), F.sha2(text, 256).alias("file_hash"), F.lit(seq).alias("seq"), deleted.alias("deleted"))
    text, folder = F.col("text"), f"{_shared(spark)}/changes-{uuid.uuid4().hex}"
    rounds = [
        row(docs.where("doc_id % 5 <> 0"), key("d"), text, 0),
        row(docs.where("doc_id % 3 = 0 OR doc_id % 11 = 0"), key("d"), F.concat(text, F.lit("!")), 1, n % 11 == 0),
        row(docs.where("doc_id % 5 = 0"), key("d"), text, 2).union(row(docs.where("doc_id % 22 = 0"), key("m"), text, 2)),
    ]
    for part in rounds:
        part.write.mode("append").parquet(folder)
    return sync.sync_stream(stateful.stream_of(spark, folder))[0].select("source_key", "file_hash")
