"""Mixing sources to target weights with hash-threshold histograms, without sorting documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from . import common

#: Hex digits of md5 that place a document, and bits of each histogram level (three levels use all 60 bits).
DIGITS, BITS, LEVELS = 15, 12, 5


def place(key: Column) -> Column:
    """A document's place in [0, 2^60), from its id alone, so that reruns agree; equal ids share a place."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float, share: float = 1.0) -> DataFrame:
    """(source, source_size) -> target added.

    Sources take the weights in turn, by code point, null last. The target of a source is min(most * size, x * weight)
    with x such that the targets sum to share * all sizes: the fixed point of resharing the excess. Works on one row
    per source.
    """
    one = W.partitionBy(F.lit(1))
    listed = sizes.withColumn("rank", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    listed = (
        listed.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("total", F.sum("source_size").over(one) * F.lit(float(share)))
    )
    # A source is at its cap when x reaches cap / weight. In that order, the first source below its cap fixes x.
    by = one.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    after = by.rowsBetween(0, W.unboundedFollowing)
    x = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    listed = listed.withColumn("x", F.when(x * F.col("weight") <= F.col("cap"), x))
    level = F.max("x").over(one)
    return listed.withColumn("target", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))).select(
        "source", "source_size", "target"
    )


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, repeats, below): each document is taken `repeats` times, and once more if its
    place is under `below`.

    Level by level, sizes are summed by source and histogram bucket; running sums find the bucket in which the rest
    of the budget ends, and only that bucket's rows go to the next level. At the last level a bucket is one place;
    it is taken if that brings the sum nearer to the budget. Only sums are shuffled: rows are combined by bucket
    first, so a hot source costs no more than any other.
    """
    spark = sized.sparkSession
    state = goals.withColumn(
        "repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    )
    state = state.select(
        "source", "source_size", "target", "repeats", (F.col("target") - F.col("repeats") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("below")
    )
    for level in range(1, LEVELS + 1):
        shift = DIGITS * 4 - BITS * level
        bucket = F.shiftright("place", shift)
        rows = sized.join(state.select(F.col("source").alias("s"), "below"), F.col("source").eqNullSafe(F.col("s")))
        if level > 1:
            rows = rows.where(F.shiftright("place", shift + BITS) == F.shiftright("below", shift + BITS))
        sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        sums = sums.join(state.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        upto = F.sum("size").over(W.partitionBy("source").orderBy("bucket"))
        sums = sums.withColumn("upto", upto)
        if level < LEVELS:
            fits = F.col("upto") <= F.col("rest")
        else:
            fits = F.col("upto") - F.col("size") / 2 <= F.col("rest")
        # The bucket after the last one that fits is refined; below it everything is taken.
        found = sums.groupBy("source").agg(
            F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("used"),
            F.min(F.when(~fits, F.col("bucket"))).alias("edge"),
            F.max("bucket").alias("last"),
        )
        found = found.select(F.col("source").alias("s"), "used", F.shiftleft(F.coalesce("edge", F.col("last") + 1), shift).alias("edge"))
        state = (
            state.join(found, F.col("source").eqNullSafe(F.col("s")), "left")
            .withColumn("rest", F.col("rest") - F.coalesce("used", F.lit(0)))
            .withColumn("below", F.coalesce("edge", "below"))
            .drop("s", "used", "edge")
        )
        state = common.materialize(state, "mix")
    return state.select("source", "source_size", "target", "repeats", "below")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, share: float = 1.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of docs (doc_id, source, text).

    size counts words, null and empty texts have none and are taken 0 words; repeated doc_ids share one decision;
    an empty table gives an empty one. `copies` is how often the mix takes the document, at most ceil(most).
    The targets are made from one row for each source; Spark broadcasts that table only if its measured size is
    under spark.sql.autoBroadcastJoinThreshold, and else splits a hot source's partition in the join.
    """
    sized = docs.select("doc_id", "source", F.size(common.words(F.col("text"))).cast("long").alias("size"))
    sized = common.materialize(sized.withColumn("place", place(F.col("doc_id"))), "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    state = thresholds(sized, targets(sizes, weights, most, share)).withColumnRenamed("source", "s")
    copies = F.col("repeats") + (F.col("place") < F.col("below")).cast("long")
    return sized.join(state, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "source_size", "target", F.least(copies, F.lit(int(most))).alias("copies"), (F.least(copies, F.lit(int(most))) * F.col("size")).alias("taken")
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its size, its source's size and target, and the words taken. Null and empty texts have size 0,
    repeated ids share one decision, and an empty table gives no row."""
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight,
             (source_size * 3.0)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
x AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM w),
y AS (SELECT source, source_size, least(cap, weight * max(CASE WHEN x * weight <= cap THEN x END) OVER ()) AS target FROM x),
z AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS repeats FROM y),
p AS (SELECT source, place, sum(size) AS size FROM d GROUP BY source, place),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place) AS upto FROM p),
e AS (SELECT c.source, min(c.place) FILTER (WHERE c.upto - c.size / 2 > z.target - z.repeats * z.source_size) AS edge
      FROM c JOIN z ON c.source IS NOT DISTINCT FROM z.source GROUP BY c.source)
SELECT d.doc_id, d.size, z.source_size, z.target,
       (d.size * (z.repeats + CASE WHEN e.edge IS NULL OR d.place < e.edge THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
