"""Shared helpers: the shared folder, materialised tables, table loading and connected components."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space and the five ASCII controls that end a word, as a Java character class.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, a new local one in local mode only, as
    executors on other machines don't see it: on a cluster that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    local = f"file://{tempfile.mkdtemp(prefix='kbspark-')}"
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def work_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage with a table in the shared folder, which outlives any executor."""
    path = work_dir(df.sparkSession, what)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._made_at = path
    return made


def discard(made: DataFrame) -> None:
    """Delete a table that materialize() wrote and nothing will read again, and the shuffle files of jobs before."""
    spark = made.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made._made_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words(text: Column) -> Column:
    """Array of the words of a text; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return int(df.select(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0)


def parts_for(spark: SparkSession, total: float, each: float, least: int = 1) -> int:
    """Partitions so that each gets about `each` of `total`: the count grows with the data."""
    return max(least, math.ceil(total / each))


def _forest(batches):
    """Replace the edges of a partition by a forest with the same components (roots are least ids)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, find(x)) for x in list(parent)]
    rows = [(x, r) for x, r in rows if x != r]
    for i in range(0, len(rows), 100_000):
        part = rows[i : i + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], ["src", "dst"]
        )


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of an undirected edge table (src, dst: long); component is the least node reachable.

    Edges are first thinned to forests partition by partition. Then large-star and small-star steps alternate, each
    a pair of shuffles over the remaining edges; a star's centre can hold any share of the edges, as its minimum is
    combined before the shuffle and the join back can be split. The table of each round is written to the shared
    folder. Nodes without an edge (self-loops included) are not returned.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst")
    edges = materialize(edges.mapInArrow(_forest, "src long, dst long").distinct(), "edges")

    def sign(df: DataFrame):
        return tuple(df.select(F.count("*"), F.sum(F.xxhash64("src", "dst") % 1_000_000_007)).first())

    last = sign(edges)
    if not last[0]:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    for _ in range(rounds):
        both = edges.union(edges.select("dst", "src"))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = large.where("src <> dst").distinct()
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        small = down.groupBy("src").agg(F.min("dst").alias("m"))
        linked = down.join(small, "src")
        edges = (
            linked.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
            .union(small.select("src", F.col("m").alias("dst")))
            .distinct()
        )
        edges = materialize(edges, "edges")
        now = sign(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and for each text the place in them where its words begin (one more at the end)."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, ends = lists.flatten(), lists.offsets.to_numpy()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), before[ends - ends[0]]
