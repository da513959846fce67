"""Streams in several batches against their batch operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kbspark.operators import corpus, ownership
from kbspark.streaming import stateful, sync

T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


@pytest.fixture(autouse=True)
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


class Folder:
    """A folder that a stream reads, a file for each batch."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self, files=None):
        return stateful.stream_of(self.spark, self.path, files)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


MEMORY = "owner string, memory_type string, key string, value string, at timestamp, ttl_days int"


def test_memories_expire_without_news_of_their_key(spark, tmp_path):
    folder, home = Folder(spark, tmp_path / "in", MEMORY), f"file://{tmp_path}/home"
    run = lambda: {(r.owner, r.memory_type, r.key): (r.value, r.status) for r in stateful.memory_ttl_stream(folder.stream(), home=home).collect()}
    folder.add([("ann", "fact", "tea", "green", at(0), 1), ("ann", "fact", "tea", "black", at(1), 2), ("ann", "rule", "tea", "hot", at(0), None), ("bob", "fact", "tea", None, at(2), 1)])
    first = {("ann", "fact", "tea"): ("black", "active"), ("ann", "rule", "tea"): ("hot", "active"), ("bob", "fact", "tea"): (None, "active")}
    assert run() == first
    # A new start of the stream, with news of another owner alone: bob's memory ends, ann's lasts a day longer.
    folder.add([("cy", "fact", "x", "y", at(30), 1)])
    assert run() == first | {("bob", "fact", "tea"): (None, "expired"), ("cy", "fact", "x"): ("y", "active")}
    # Too late to count, and a memory of the same key after its end.
    folder.add([("ann", "fact", "late", "z", at(3), 90), ("bob", "fact", "tea", "mint", at(31), 90), ("dan", "fact", "far", "w", at(60), 1)])
    got = run()
    assert got[("bob", "fact", "tea")] == ("mint", "active") and ("ann", "fact", "late") not in got
    assert got[("ann", "fact", "tea")] == ("black", "expired") and got[("cy", "fact", "x")] == ("y", "expired") and got[("ann", "rule", "tea")] == ("hot", "active")


def test_memory_that_comes_when_its_time_is_over(spark, tmp_path):
    folder, home = Folder(spark, tmp_path / "in", MEMORY), f"file://{tmp_path}/home"
    folder.add([("a", "t", "k", "v", at(100), 1)])
    stateful.memory_ttl_stream(folder.stream(), "90 hours", home)
    folder.add([("b", "t", "k", "v", at(20), 0), ("c", "t", "k", "v", at(20), 0), ("c", "t", "k", "w", at(21), 9)])
    got = {r.owner: r.status for r in stateful.memory_ttl_stream(folder.stream(), "90 hours", home).collect()}
    assert got == {"a": "active", "b": "active", "c": "active"}  # the watermark is at hour 10
    folder.add([("d", "t", "k", "v", at(140), 9)])
    assert {r.owner: r.status for r in stateful.memory_ttl_stream(folder.stream(), "90 hours", home).collect()} == got | {"b": "expired", "d": "active"}


JOB = "job_id string, status string, at timestamp"
EVENTS = [
    [("ok", "queued", at(0)), ("ok", "running", at(0.4)), ("slow", "running", at(0)), ("quiet", "parsing", at(0.1)), ("bad", "failed", at(0.2)), ("again", "failed", at(0.2)), ("null", None, at(0.3))],
    [("ok", "completed", at(0.8)), ("slow", "running", at(0.9)), ("slow", "completed", at(1)), ("again", "queued", at(0.7)), ("new", "queued", at(1))],
    [("quiet", "completed", at(1.1)), ("again", "embedding", at(1.1)), ("again", "cancelled", at(1.3)), ("new", "running", at(1.45)), ("last", "uploading", at(1.46))],
]


@pytest.mark.parametrize("cuts", [[0], [0, 1, 2]])
def test_stale_jobs_fail_and_late_events_are_counted(spark, tmp_path, cuts):
    folder, home = Folder(spark, tmp_path / "in", JOB), f"file://{tmp_path}/home"
    for i in cuts:
        folder.add(sum(EVENTS, []) if len(cuts) == 1 else EVENTS[i])
        got = stateful.stale_job_stream(folder.stream(), home=home)
    everything = spark.createDataFrame(sum(EVENTS, []), JOB)
    assert tuples(got) == tuples(stateful.replay_jobs(everything, at(1.46)))
    rows = {r.job_id: r for r in got.collect()}
    assert rows["quiet"].status == "failed" and rows["quiet"].dropped == 1 and rows["quiet"].finished_at == at(0.6) and rows["quiet"].retry_count == 1
    assert rows["slow"].status == "failed" and rows["slow"].dropped == 2
    assert rows["ok"].status == "completed" and not rows["ok"].stale and rows["ok"].finished_at == at(0.8)
    assert rows["again"].status == "cancelled" and rows["again"].retry_count == 1 and rows["new"].status == "running" and rows["last"].status == "uploading"


def test_stale_jobs_are_those_that_the_batch_rule_fails(spark, tmp_path):
    """Where no event comes after a deadline, the stream at its watermark is expire_stale_jobs at that time."""
    rows = [(f"j{i}", "running" if i % 3 else "completed", at(i / 40)) for i in range(60)]
    folder = Folder(spark, tmp_path / "in", JOB)
    folder.add(rows)
    got = stateful.stale_job_stream(folder.stream(), home=f"file://{tmp_path}/home").select("job_id", "status", "retry_count")
    jobs = spark.createDataFrame(rows, JOB).select("job_id", "status", F.col("at").alias("updated_at"), (F.col("status") == "running").alias("active"), F.lit(0).alias("retry_count"), F.lit(None).cast("timestamp").alias("finished_at"))
    want = corpus.expire_stale_jobs(jobs, at(59 / 40)).select("job_id", "status", "retry_count")
    assert tuples(got) == tuples(want) and got.where("status = 'failed'").count() > 20


MESSAGE = "conv_id long, turn long, role string, text string"


def test_recent_history_in_two_batches(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 else "assistant", f"{c}-{t}" if t % 5 else None) for c in range(6) for t in range(3 * c + 1)]
    folder, home = Folder(spark, tmp_path / "in", MESSAGE), f"file://{tmp_path}/home"
    for batch in (rows[::2], rows[1::2]):
        folder.add(batch)
        got = stateful.recent_history_stream(folder.stream(), 4, home=home)
    want = ownership.recent_messages(spark.createDataFrame(rows, MESSAGE), 4).select("conv_id", "turn", "role", "text", F.col("place").cast("int").alias("place"))
    assert tuples(got) == tuples(want)
    # State holds no more than the four messages of each conversation.
    state = spark.read.format("statestore").option("path", f"{home}/state").option("stateVarName", "recent").load()
    assert max(r["n"] for r in state.groupBy("key").agg(F.count("*").alias("n")).collect()) <= 4


def test_recent_history_ends_after_its_time(spark, tmp_path):
    folder, home = Folder(spark, tmp_path / "in", MESSAGE), f"file://{tmp_path}/home"
    folder.add([(1, 0, "user", "a"), (2, 0, "user", "b")])
    stateful.recent_history_stream(folder.stream(), 4, 0.00001, home)  # about a second
    folder.add([(1, 1, "user", "c")])
    got = stateful.recent_history_stream(folder.stream(), 4, 0.00001, home)
    assert tuples(got.where("conv_id = 1").select("turn")) == [(1,)]


CHANGE = "source_key string, file_hash string, size int, seq long, deleted boolean"


def test_sync_follows_changes_as_one_snapshot_does(spark, tmp_path):
    rounds = [
        [(f"k{i}", f"h{i}", i, i, False) for i in range(40)] + [("", "x", 0, 0, False), (None, "x", 0, 0, False)],
        [(f"k{i}", f"h{i}" if i % 2 else f"n{i}", i + 1, 100 + i, False) for i in range(0, 20)] + [(f"k{i}", None, None, 200, True) for i in range(20, 25)] + [("moved", "h20", 7, 201, False)],
        [("k1", "p", 0, 300, False), ("k1", "q", 0, 301, False), ("k30", "h30", 30, 302, True), ("k30", "back", 1, 303, False), ("never", None, None, 304, True)],
    ]
    folder, home = Folder(spark, tmp_path / "in", CHANGE), f"file://{tmp_path}/home"
    for part in rounds:
        folder.add(part)
        got, _ = sync.sync_stream(folder.stream(), home, 8)
    # In one go: the last change to each key, as one snapshot after none.
    last = {}
    for row in sorted(sum(rounds, []), key=lambda r: r[3]):
        if row[0]:
            last[row[0]] = row
    now = spark.createDataFrame([r[:3] for r in last.values() if not r[4]], "source_key string, file_hash string, size int")
    none = now.where("false")
    whole = corpus.next_snapshot(none, now, corpus.diff_snapshot(none, now))
    hashes = lambda df: tuples(df.select("source_key", "file_hash"))
    assert hashes(got) == hashes(whole)
    counts = {(r.batch, r.status): r["count"] for r in sync.sync_changes(spark, home).groupBy("batch", "status").count().collect()}
    assert counts == {(0, "added"): 40, (1, "skipped"): 10, (1, "updated"): 10, (1, "deleted"): 4, (1, "moved"): 1, (1, "moved_away"): 1, (2, "updated"): 2}
    # Skipped documents keep their old row; the buckets of the last batch alone have a new version.
    assert got.where("source_key = 'k3'").first()["size"] == 3
    touched = spark.read.parquet(f"{home}/manifest").where("batch = 2").count()
    assert 1 <= touched <= 3
    # The last batch once more, and one that failed before its list of buckets was written, change nothing.
    before = tuples(got)
    schema = "source_key string, file_hash string, size int"
    sync.apply_batch(spark.createDataFrame(rounds[2], CHANGE), 2, home, schema, 8)
    assert tuples(sync.sync_table(spark, home, schema)) == before
    spark.createDataFrame([("k5", "broken", 1, 0)], "source_key string, file_hash string, size int, bucket int").write.partitionBy("bucket").parquet(f"{home}/data/version=3")
    assert tuples(sync.sync_table(spark, home, schema)) == before


def test_a_cluster_without_a_shared_folder_is_an_error():
    """Only in local mode a folder of this machine may stand in for spark.checkpoint.dir."""
    from types import SimpleNamespace

    import pytest
    from kbspark.streaming import history

    unset = SimpleNamespace(get=lambda *_: None)
    session = lambda master: SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, getConf=lambda: unset))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        history._shared(session("spark://somewhere:7077"))
    assert history._shared(session("local[4]")).startswith("file://")


def test_new_memories_ask_for_no_timers():
    """A memory without state has no timer to look for, and rows come and go without a pandas frame for each key."""
    from types import SimpleNamespace

    asked = []
    handle = SimpleNamespace(getValueState=lambda *_: SimpleNamespace(get=lambda: None, update=asked.append, clear=lambda: None), registerTimer=asked.append, listTimers=lambda: asked.append("timers") or iter([]))
    state = stateful.MemoryState()
    state.init(handle)
    rows = iter([SimpleNamespace(value="a", at=1_000_000, ends=5_000_000), SimpleNamespace(value="b", at=2_000_000, ends=6_000_000)])
    got = list(state.handleInputRows((1, "fact", "k"), rows, SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    assert [tuple(r) for r in got] == [(1, "fact", "k", "b", "active", 2_000_000, 6_000_000)] and asked == [("b", 2_000_000, 6_000_000), 6000]
