"""A BM25 index as a table: postings by term bucket, which queries read for the terms that they ask, and statistics of each batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import _POSTED, PACK, _counted, _slices, asked_terms, packed_topk, posting_pack, term_text

#: Buckets of terms: a query reads those of its terms alone.
BUCKETS = 256


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _postings(batches):
    """(chunk_id, dl, term, tf) of texts, each from its own text."""
    for part in _slices(batches):
        terms, chunk, code, tf, dl = _counted(part.column(1))
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(chunk)), pa.array(dl[chunk].astype(np.int32)), terms.cast(pa.string()).take(pa.array(code)), pa.array(tf)], ["chunk_id", "dl", "term", "tf"])


def _packed(batches):
    """Packs of postings (chunk_id, term, tf, dl) that come by chunk."""

    def packs(rows: pa.Table, whole: bool):
        """What is whole of the rows, in packs, and the rest: the last chunk, unless there are no more rows."""
        ids = rows.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(ids))
        n = len(starts) if whole else max(len(starts) - 1, 0) // PACK * PACK
        made = []
        for i in range(0, n, PACK):
            first, last = starts[i], ends[min(i + PACK, n) - 1]
            terms = rows.column(1).slice(first, last - first).combine_chunks().dictionary_encode()
            at = starts[i : min(i + PACK, n)]
            chunk = np.repeat(np.arange(len(at)), ends[i : min(i + PACK, n)] - at)
            made.append(posting_pack(ids[at], rows.column(3).to_numpy()[at], chunk, np.asarray(terms.indices), rows.column(2).to_numpy()[first:last], terms.dictionary))
        return made, rows.slice(ends[n - 1] if n else 0)

    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        made, held = packs(held, False)
        yield from made
    if held is not None and held.num_rows:
        yield from packs(held, True)[0]


def append_index(chunks: DataFrame, path: str, batch: int, buckets: int = BUCKETS) -> None:
    """R-06: add chunks (chunk_id, text) to the index under path, as a batch of that number.

    A batch has postings (term, chunk_id, tf, dl) by bucket of the term, the ids of its chunks, and, written last, its number of
    chunks and terms: a batch without them doesn't count, and one that is written again takes its own place. Chunks that an earlier
    batch has are left out, and of equal ids in a batch one stays. All batches must have the same number of buckets.
    """
    spark = chunks.sparkSession
    new = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["chunk_id"])
    if batch > 0:
        before = spark.read.schema("chunk_id long, batch long").parquet(f"{path}/ids").where(F.col("batch") < batch)
        new = new.join(before, "chunk_id", "left_anti")
    texts = new.select("chunk_id", term_text("text").alias("text"))
    postings = texts.mapInArrow(_postings, "chunk_id long, dl int, term string, tf long").withColumn("bucket", _bucket(buckets))
    # By bucket and chunk, so that a bucket of a frequent term is many tasks' work and still few files.
    postings.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(4))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    sizes = texts.select("chunk_id", F.regexp_count("text", F.lit("[^ ]+")).cast("long").alias("dl"))
    sizes.select("chunk_id").write.mode("overwrite").parquet(f"{path}/ids/batch={batch}")
    sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).write.mode("overwrite").parquet(f"{path}/statistics/batch={batch}")


def indexed_postings(spark: SparkSession, path: str, asked: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Postings (term, chunk_id, tf, dl) of the asked terms: only the files of their buckets are read."""
    done = spark.read.schema("n long, total long, batch long").parquet(f"{path}/statistics")
    wanted = [r[0] for r in asked.select(_bucket(buckets)).distinct().collect()]  # at most `buckets` numbers
    rows = spark.read.schema("chunk_id long, dl int, term string, tf long, batch long, bucket int").parquet(f"{path}/postings").where(F.col("bucket").isin(wanted))
    whole = rows.join(F.broadcast(done.select("batch")), "batch", "left_semi")  # one row a batch
    return whole.join(asked.select("term").distinct(), "term", "left_semi").select("term", "chunk_id", "tf", "dl")


def bm25_topk_indexed(queries: DataFrame, path: str, k: int = 20, buckets: int = BUCKETS) -> DataFrame:
    """(query_id, chunk_id, bm25_score, bm25_rank) of queries (query_id, text) over the index: what bm25_topk gives over its chunks."""
    spark = queries.sparkSession
    asked = asked_terms(queries)
    stats = spark.read.schema("n long, total long, batch long").parquet(f"{path}/statistics").agg(F.lit("").alias("term"), F.sum("n").alias("a"), F.sum("total").alias("b"))
    postings = indexed_postings(spark, path, asked, buckets)
    frequencies = postings.groupBy("term").agg(F.count("*").alias("a"), F.lit(0).cast("long").alias("b")).union(stats)
    packs = postings.repartition("chunk_id").sortWithinPartitions("chunk_id").select("chunk_id", "term", "tf", "dl").mapInArrow(_packed, _POSTED)
    return packed_topk(asked, frequencies, packs, k)
