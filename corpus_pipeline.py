"""A corpus from raw documents to packed sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import common, mixing, packing, quality, secrets, simhash


def _whole(docs: DataFrame, *columns) -> DataFrame:
    """The columns, and all columns of docs in one, _doc, so that no name of theirs clashes with what a stage adds."""
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio. Null texts have no words and go."""
    labels = common.table(spark, sf_dir, "labels")
    scored = quality.score(_whole(docs, "doc_id", "text"), labels).drop("text")  # _doc has it
    return quality.decide(common.materialize(scored, "scored"), labels).where("kept").select("_doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (Jaccard similarity of five-word shingles 0.8 or more) the one of least doc_id
    (null ones last); of repeated rows one.

    Documents are told apart by doc_id and text, as ids can be null or repeat.
    """
    digest = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), digest.alias("digest"))
    found = simhash.near_copies(docs.select(key.alias("doc_id"), "text")).where(F.col("doc_id") == F.col("component_id"))
    ids = common.materialize(found.groupBy(F.col("doc_id").alias("_key")).agg(F.count("*").alias("n")), "kept")
    kept = _whole(docs, key.alias("_key")).join(ids.hint("merge"), "_key", "left_semi")
    return (kept.dropDuplicates(["_key"]) if ids.where("n > 1").limit(1).count() else kept).select("_doc.*")


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets that look live replaced by a mark."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: rows repeat, and may be left out."""
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("_copies"))
    out = _whole(docs, "doc_id").join(taken, F.col("doc_id").eqNullSafe(F.col("_id"))).where("_copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("_doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences. Null texts are a piece of the end alone."""
    return packing.pack(docs, packing.tokenizer_paths())


STAGES = [("quality", keep_quality), ("simhash", drop_near_copies), ("secrets", remove_secrets), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Fingerprints, groups and tokens can't be expressed in SQL. Tests hold near copies, and the search that redaction uses,
#: against brute force, and the other stages' operators on their own; no test compares the rows of a whole run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each on what its predecessor wrote. An empty table gives no piece."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return docs
