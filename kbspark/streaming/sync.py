"""A document table that follows a stream of file changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus
from .stateful import run_stream

#: Buckets that a table of documents is kept in; a batch rewrites only those that hold one of its keys.
BUCKETS = 64


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("source_key"), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, home: str, before: int | None = None) -> DataFrame | None:
    """(bucket, version): which version of each bucket counts, of all batches or those before one."""
    try:
        done = spark.read.schema("bucket int, version long").parquet(f"{home}/manifest")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None  # nothing is written yet
        raise
    done = done if before is None else done.where(F.col("version") < before)
    return done.groupBy("bucket").agg(F.max("version").alias("version"))


def sync_table(spark: SparkSession, home: str, schema: str, before: int | None = None) -> DataFrame:
    """The documents (schema) that sync_stream keeps under home, now or before a batch."""
    versions = _versions(spark, home, before)
    if versions is None:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, version long, bucket int").parquet(f"{home}/data")
    # One row for each bucket: a table of fixed size.
    return rows.join(F.broadcast(versions), ["bucket", "version"], "left_semi").drop("bucket", "version")


def apply_batch(batch: DataFrame, number: int, home: str, schema: str, buckets: int = BUCKETS) -> None:
    """Write the next version of the buckets that a batch of changes (schema, seq, deleted) touches.

    The data of a version is written first and the list of its buckets last, so a batch that fails half way changes
    nothing; one that runs again starts from the versions before it and overwrites its own.
    """
    spark = batch.sparkSession
    columns = spark.createDataFrame([], schema).columns
    batch = batch.where("source_key <> ''").persist()
    try:
        last = batch.groupBy("source_key").agg(F.max_by(F.struct(*[c for c in columns if c != "source_key"], "deleted"), "seq").alias("last"))
        keys = last.select("source_key", "last.*")
        touched = keys.select(_bucket(buckets).alias("bucket")).distinct()
        versions = _versions(spark, home, number)
        old = spark.createDataFrame([], schema)
        if versions is not None:
            rows = spark.read.schema(f"{schema}, version long, bucket int").parquet(f"{home}/data").where(F.col("version") < number)
            mine = versions.join(touched, "bucket", "left_semi")
            old = rows.join(F.broadcast(mine), ["bucket", "version"], "left_semi").select(columns)
        incoming = keys.where("NOT deleted").select(columns)
        diff = corpus.diff_snapshot(old.join(keys.select("source_key"), "source_key", "left_semi"), incoming)
        after = corpus.next_snapshot(old, incoming, diff).withColumn("bucket", _bucket(buckets))
        after.write.mode("overwrite").partitionBy("bucket").parquet(f"{home}/data/version={number}")
        diff.select("source_key", "status").write.mode("overwrite").parquet(f"{home}/changes/batch={number}")
        touched.select("bucket", F.lit(number).cast("long").alias("version")).coalesce(1).write.mode("overwrite").parquet(f"{home}/manifest/batch={number}")
    finally:
        batch.unpersist()


def sync_stream(changes: DataFrame, home: str | None = None, buckets: int = BUCKETS) -> tuple[DataFrame, str]:
    """V-01: the documents (source_key, file_hash, ...) after a stream of changes (source_key, file_hash, ..., seq, deleted), and
    the home of the table, which can be given again to go on.

    Of a batch's changes to a key that of largest seq counts; deleted ones take the document away. What a batch does to each key
    (added, updated, skipped, moved, moved_away, deleted) is under home/changes. Empty keys are left out. The table is as
    next_snapshot would make it of all changes at once, however they are cut into batches; a batch costs its own
    rows and the buckets that it touches.
    """
    columns = [c for c in changes.columns if c not in ("seq", "deleted")]
    schema = ", ".join(f"{c} {changes.schema[c].dataType.simpleString()}" for c in columns)
    home = run_stream(changes, home, "sync", lambda batch, number, home: apply_batch(batch, number, home, schema, buckets))
    return sync_table(changes.sparkSession, home, schema), home


def sync_changes(spark: SparkSession, home: str) -> DataFrame:
    """(source_key, status, batch) of all batches of sync_stream."""
    return spark.read.schema("source_key string, status string, batch long").parquet(f"{home}/changes")
