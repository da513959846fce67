"""Streams with state by key: memories that expire, jobs that go stale, and the recent messages of a conversation.

Each keeps its state in RocksDB, writes what a micro-batch changed into a folder of the batch's number (a batch that runs again
overwrites its own), and can be given its home again to go on with new rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .history import _shared

# Job states that wait for news and those that end a job, the seconds that a job may go without news, the
# messages of a conversation that stay, for how long, and the days of a memory without a time of its own.
WAITING = ("queued", "running", "uploading", "parsing", "embedding")
ENDED = ("completed", "failed", "cancelled")
STALE_SECONDS = 1800
RECENT, RECENT_DAYS = 100, 7
MEMORY_DAYS = 90
#: Days after its end for which a job is remembered, so that late events of it are known as late.
KEEP_DAYS = 7

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_DAY = 86_400_000_000


def stream_of(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Rows under a path of parquet files as a stream, by so many files at a time if given."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, as Spark streams no path of a single file


def run_stream(stream: DataFrame, home: str | None, what: str, write: Callable[[DataFrame, int, str], None] | None = None, once: bool = False) -> str:
    """Run the stream over all that is there, with its state and output (home/out/batch=n) under home, which is returned.

    once takes it as one micro-batch: a stream whose state goes by the clock never comes to an end of batches otherwise.
    """
    spark = stream.sparkSession
    home = home or f"{_shared(spark)}/{what}-{uuid.uuid4().hex}"
    write = write or (lambda batch, number, home: batch.write.mode("overwrite").parquet(f"{home}/out/batch={number}"))
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        query = (
            stream.writeStream.outputMode("update").option("checkpointLocation", f"{home}/state")
            .foreachBatch(lambda batch, number: write(batch, number, home)).trigger(**({"once": True} if once else {"availableNow": True})).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    return home


def written(spark: SparkSession, home: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch long").parquet(f"{home}/out")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows (keys, batch, ...) those of each key's last batch."""
    last = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("batch").alias("_batch"))
    same = F.col("batch") == F.col("_batch")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(last, same, "left_semi").drop("batch")


def _rows(batches):
    """Rows of a key in a micro-batch, as tuples."""
    for frame in batches:
        yield from frame.itertuples(index=False)


def _millis(micros: int) -> int:
    return -(-micros // 1000)


class MemoryState(StatefulProcessor):
    """State of a memory while it is active. Its timer, in event time, ends it without any new row."""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value string, at long, ends long")

    def _row(self, key, value, status, at, ends) -> Row:
        return Row(owner=key[0], memory_type=key[1], key=key[2], value=value, status=status, at=at, ends=ends)

    def handleInputRows(self, key, rows, timerValues):
        held = self.held.get()
        timed = held is not None
        for r in rows:
            if held is None or (r.at, r.value or "") >= (held[1], held[0] or ""):
                held = (r.value, int(r.at), int(r.ends))
        if timed:  # only an active memory has one
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if _millis(held[2]) <= timerValues.getCurrentWatermarkInMs():
            self.held.clear()
            yield self._row(key, held[0], "expired", held[1], held[2])
        else:
            self.held.update(held)
            self.handle.registerTimer(_millis(held[2]))
            yield self._row(key, held[0], "active", held[1], held[2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        value, at, ends = self.held.get()
        self.held.clear()
        yield self._row(key, value, "expired", at, ends)

    def close(self) -> None:
        pass


def memory_changes(memories: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """V-04: changes (owner, memory_type, key, value, status, at, ends; times in microseconds) of a stream of memories
    (owner, memory_type, key, value, at: timestamp, ttl_days).

    Of each owner, type and key the latest statement is active, ties by value, until its time ends: then it is expired, in a
    later micro-batch, whether or not its key has new rows, once the watermark has passed it. A statement whose time has
    ended when it comes is expired at once, one that comes more than `delay` late is dropped. Null ttl_days are 90 days.
    Rows without a time are
    left out. State is one row for each active memory and none for the others, so hot owners are spread over their keys.
    """
    ends = F.unix_micros("at") + F.coalesce("ttl_days", F.lit(MEMORY_DAYS)).cast("long") * _DAY
    timed = memories.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay)
    timed = timed.where("at IS NOT NULL").select("owner", "memory_type", "key", "value", F.col("at").alias("time"), F.unix_micros("at").alias("at"), ends.alias("ends"))
    kinds = ", ".join(f"{c} {timed.schema[c].dataType.simpleString()}" for c in ("owner", "memory_type", "key", "value"))
    return timed.groupBy("owner", "memory_type", "key").transformWithState(MemoryState(), f"{kinds}, status string, at long, ends long", "Update", "EventTime")


def memory_ttl_stream(memories: DataFrame, delay: str = "0 seconds", home: str | None = None) -> DataFrame:
    """(owner, memory_type, key, value, status, updated_at, expires_at) after all rows of memory_changes were streamed."""
    changes = memory_changes(memories, delay)
    schema = changes.schema.simpleString()[7:-1].replace(":", " ")
    last = latest(written(memories.sparkSession, run_stream(changes, home, "memories"), schema), ["owner", "memory_type", "key"])
    return last.select("owner", "memory_type", "key", "value", "status", F.timestamp_micros("at").alias("updated_at"), F.timestamp_micros("ends").alias("expires_at"))


class JobState(StatefulProcessor):
    """State of a job. One that waits has a timer at its deadline; one that ended is forgotten some days later."""

    def __init__(self, seconds: int):
        self.limit = seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, at long, retries int, finished long, stale boolean, dropped long")

    def _fail(self, job):
        return ("failed", job[1], job[2] + 1, job[1] + self.limit, True, job[5])

    def _keep(self, key, job) -> pd.DataFrame:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.job.update(job)
        waits = job[0] in WAITING
        self.handle.registerTimer(_millis(job[1] + self.limit) + 1 if waits else _millis(max(job[1], job[3] or 0) + KEEP_DAYS * _DAY))
        finished = pd.Series([job[3]], dtype=object)  # it may be null
        return pd.DataFrame({"job_id": [key[0]], "status": [job[0]], "at": [job[1]], "retry_count": [job[2]], "finished": finished, "stale": [job[4]], "dropped": [job[5]]})

    def handleInputRows(self, key, rows, timerValues):
        job = tuple(self.job.get()) if self.job.exists() else None
        for r in sorted(_rows(rows), key=lambda r: (r.at, r.status)):
            if job and not job[4] and job[0] in WAITING and r.at > job[1] + self.limit:
                job = self._fail(job)
            if job and job[4]:
                job = (*job[:5], job[5] + 1)
                continue
            ended = r.status in ENDED
            retries = (job[2] if job else 0) + (r.status == "failed")
            job = (r.status, int(r.at), int(retries), int(r.at) if ended else job[3] if job else None, False, 0)
        yield self._keep(key, job)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        job = tuple(self.job.get())
        if job[0] in WAITING:
            yield self._keep(key, self._fail(job))
        else:
            self.job.clear()

    def close(self) -> None:
        pass


def job_changes(events: DataFrame, seconds: int = STALE_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """V-05: changes (job_id, status, at, retry_count, finished, stale, dropped; times in microseconds) of a stream of job events
    (job_id, status, at: timestamp).

    A job that waits and has no news for more than `seconds` of event time fails at that deadline, with one retry more, when the
    watermark passes it or its next event shows it, whichever comes first: how rows fall into micro-batches changes nothing.
    Events after that deadline are dropped and counted. Completed, failed and cancelled events set the end time, failed ones count a retry,
    others keep it. Rows without a time are left out. A job is forgotten 7 days after its end or last event.
    """
    timed = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay)
    timed = timed.where("at IS NOT NULL").select("job_id", F.coalesce("status", F.lit("")).alias("status"), F.col("at").alias("time"), F.unix_micros("at").alias("at"))
    kind = timed.schema["job_id"].dataType.simpleString()
    out = f"job_id {kind}, status string, at long, retry_count int, finished long, stale boolean, dropped long"
    return timed.groupBy("job_id").transformWithStateInPandas(JobState(seconds), out, "Update", "EventTime")


def stale_job_stream(events: DataFrame, seconds: int = STALE_SECONDS, delay: str = "0 seconds", home: str | None = None) -> DataFrame:
    """(job_id, status, updated_at, retry_count, finished_at, stale, dropped) after all rows of job_changes were streamed."""
    changes = job_changes(events, seconds, delay)
    schema = changes.schema.simpleString()[7:-1].replace(":", " ")
    last = latest(written(events.sparkSession, run_stream(changes, home, "jobs"), schema), ["job_id"])
    return last.select("job_id", "status", F.timestamp_micros("at").alias("updated_at"), "retry_count", F.timestamp_micros("finished").alias("finished_at"), "stale", "dropped")


def replay_jobs(events: DataFrame, as_of, seconds: int = STALE_SECONDS) -> DataFrame:
    """What stale_job_stream gives when its watermark has come to as_of, from all events (job_id, status, at) at once."""
    w = W.partitionBy("job_id").orderBy("at", "status")
    waits = F.col("status").isin(*WAITING)
    rows = events.where("at IS NOT NULL").select("job_id", F.coalesce("status", F.lit("")).alias("status"), F.col("at").cast("timestamp").alias("at")).withColumn("_next", F.unix_micros(F.coalesce(F.lead("at").over(w), F.lit(as_of).cast("timestamp"))))
    rows = rows.withColumn("_stale", waits & (F.col("_next") - F.unix_micros("at") > seconds * 1_000_000))
    rows = rows.withColumn("_after", F.sum(F.col("_stale").cast("int")).over(w) - F.col("_stale").cast("int"))
    live = F.col("_after") == 0
    last = F.max_by(F.when(live, F.struct("status", "at", "_stale")), F.when(live, F.struct("at", "status")))
    ended = F.max(F.when(live & F.col("status").isin(*ENDED), F.col("at")))
    out = rows.groupBy("job_id").agg(last.alias("l"), F.count_if(live & (F.col("status") == "failed")).alias("failed"), ended.alias("ended"), F.count_if(~live).alias("dropped"))
    stale = F.col("l._stale")
    return out.select(
        "job_id", F.when(stale, "failed").otherwise(F.col("l.status")).alias("status"), F.col("l.at").alias("updated_at"), (F.col("failed") + stale.cast("int")).cast("int").alias("retry_count"),
        F.when(stale, F.timestamp_micros(F.unix_micros("l.at") + seconds * 1_000_000)).otherwise(F.col("ended")).alias("finished_at"), stale.alias("stale"), "dropped",
    )


class RecentState(StatefulProcessor):
    """The last messages of a conversation, in a list that Spark ends after a time without messages."""

    def __init__(self, most: int, days: float):
        self.most, self.millis = most, int(days * 86_400_000)

    def init(self, handle) -> None:
        self.recent = handle.getListState("recent", "turn long, role string, text string", ttlDurationMs=self.millis)

    def handleInputRows(self, key, rows, timerValues):
        held = [tuple(m) for m in self.recent.get()] if self.recent.exists() else []
        turns = {m[0]: m for m in held} | {int(r.turn): (int(r.turn), r.role, r.text) for r in _rows(rows)}
        kept = [turns[t] for t in sorted(turns)[-self.most :]]
        self.recent.put(kept)
        yield pd.DataFrame([(key[0], *m, i + 1) for i, m in enumerate(kept)], columns=["conv_id", "turn", "role", "text", "place"])

    def close(self) -> None:
        pass


def recent_history_stream(messages: DataFrame, most: int = RECENT, days: float = RECENT_DAYS, home: str | None = None) -> DataFrame:
    """V-03: of a stream of messages (conv_id, turn, role, text) the last `most` of each conversation, with their place from
    the oldest, after all rows were streamed. A turn that comes again replaces itself. State is `most` messages for each conversation
    and goes `days` after the last one; a conversation that comes back later starts anew.
    """
    kind = messages.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, turn long, role string, text string, place int"
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    recent = rows.groupBy("conv_id").transformWithStateInPandas(RecentState(most, days), schema, "Update", "ProcessingTime")
    return latest(written(messages.sparkSession, run_stream(recent, home, "recent", once=True), schema), ["conv_id"])
