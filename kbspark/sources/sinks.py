"""Reports and snapshots on disk, and digests of what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.corpus import snapshot_revision


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """S-11: rows take the place of the partitions that they fall in; all other partitions stay.

    Rows are written beside the table, and moved into place when every task has ended: a write that fails leaves the table as it was.
    rows must not be read from the partitions that they replace.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_report(path: str, summary: DataFrame, questions: DataFrame, records: DataFrame | None = None) -> None:
    """S-11: a report under path: summary as JSON, questions as CSV with a header, records as JSON lines. Each part is moved into
    place as a whole; an array is joined by `;` in CSV."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    flat = [F.array_join(c, ";").alias(c) if kind.startswith("array") else F.col(c) for c, kind in questions.dtypes]
    questions.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/questions")
    if records is not None:
        records.write.mode("overwrite").json(f"{path}/records")


def source_fingerprint(files: DataFrame, include_images: bool = True, root: str | None = None, kb: str = "default") -> DataFrame:
    """S-12: one row (fingerprint, doc_id) for files (relative, file_hash): equal for equal files, whatever their order, and equal
    settings; root is left out for uploads. doc_id names the request."""
    revision = snapshot_revision(files, ["relative", "file_hash"])
    fingerprint = F.sha2(F.concat_ws("\x1f", F.col("revision"), F.lit(str(include_images)), F.lit(root or "")), 256)
    return revision.select(fingerprint.alias("fingerprint")).withColumn("doc_id", F.substring(F.sha1(F.concat(F.lit(f"{kb}:"), "fingerprint").cast("binary")), 1, 24))
