"""Streams over conversation tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def revision_stream(spark: SparkSession, path: str, home: str | None = None) -> DataFrame:
    """(conv_id, revision, last_turn) after all messages under path were streamed.

    Each micro-batch writes the conversations that it changed, so its cost follows the new messages; a batch that is
    run again overwrites its own folder. State and output are under home (by default a new folder in
    spark.checkpoint.dir), which can be given again to go on with new messages.
    """
    home = home or f"{_shared(spark)}/revisions-{uuid.uuid4().hex}"
    messages = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, as Spark streams no path of a single file
    counts = messages.groupBy("conv_id").agg(F.count("*").alias("revision"), F.max("turn").alias("last_turn"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/out/batch={number}")

    stream = counts.writeStream.outputMode("update").option("checkpointLocation", f"{home}/state").foreachBatch(write).trigger(availableNow=True).start()
    stream.awaitTermination()
    written = spark.read.schema(f"{counts.schema.simpleString()[7:-1].replace(':', ' ')}, batch long").parquet(f"{home}/out")
    return written.groupBy("conv_id").agg(F.max_by("revision", "batch").alias("revision"), F.max_by("last_turn", "batch").alias("last_turn"))


def _shared(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named.rstrip("/") if named else f"file://{tempfile.mkdtemp(prefix='kbspark-')}"
