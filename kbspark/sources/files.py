"""Files as tables: discovery with digests, file types, decoding, and answer records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# File types by MIME type, what is read, and what is left out.
MIME_TYPES = {
    "application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "text/markdown": "md", "text/x-markdown": "md",
    "text/plain": "txt", "image/png": "png", "image/jpeg": "jpg",
}
EXTENSIONS = ("md", "txt", "csv", "tsv", "xlsx", "pdf", "png", "jpg", "jpeg")
IMAGES = ("png", "jpg", "jpeg")
EXCLUDED = r"(?:^|/)tmp/|测试问题集\.md$"
DEFAULT_SCENARIO = "默认知识库"


def resolve_file_type(path: Column, mime: Column) -> Column:
    """The type that the MIME type names, else the extension in lower case."""
    known = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    plain = F.lower(F.trim(F.split(mime, ";")[0]))
    return F.coalesce(F.try_element_at(known, F.coalesce(plain, F.lit(""))), F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)))


def derive_scenario(relative: Column) -> Column:
    """First folder of a relative path (of a file without one its name), without a leading number and underscore."""
    first = F.split(relative, "/")[0]
    cut = F.when(first.rlike(r"^\d\d[^_]*_"), F.regexp_replace(first, "^[^_]*_", "")).otherwise(first)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(DEFAULT_SCENARIO))


def discover_files(spark: SparkSession, root: str, images: bool = True, excluded: str = EXCLUDED, mime_types: DataFrame | None = None) -> DataFrame:
    """S-01: (path, relative, file_type, scenario, file_hash, content) of the readable files under root, by path whatever its case.

    mime_types (relative, mime) may name the type of files whose extension doesn't tell it. Excluded paths and other types are dropped before any
    content is read, as the digest and the content are the only columns that need it: files are ordered before that too.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    files = files.withColumn("relative", F.substring("path", len(base) + 2, 1 << 20))
    files = files.withColumn("mime", F.lit(None).cast("string")) if mime_types is None else files.join(mime_types.select("relative", "mime"), "relative", "left")
    files = files.withColumn("file_type", resolve_file_type(F.col("path"), F.col("mime")))
    kinds = [e for e in EXTENSIONS if images or e not in IMAGES]
    files = files.where(F.col("file_type").isin(kinds) & ~F.col("relative").rlike(excluded))
    return files.select("path", "relative", "file_type", derive_scenario(F.col("relative")).alias("scenario"), F.sha2("content", 256).alias("file_hash"), "content").orderBy(F.lower("path"))


@F.pandas_udf(StringType())
def _gb18030(content: pd.Series) -> pd.Series:
    def decode(raw):
        try:
            return None if raw is None else bytes(raw).decode("gb18030")
        except UnicodeDecodeError:
            return None

    return content.map(decode)


def decode_text(content: Column) -> Column:
    """UTF-8 as it is (a byte-order mark stays); else GB18030; else UTF-8 with replacement characters. Only the rows that
    aren't UTF-8 reach Python with their bytes."""
    valid = F.is_valid_utf8(content.cast("string"))
    return F.when(valid, content.cast("string")).otherwise(F.coalesce(_gb18030(F.when(~valid, content)), F.make_valid_utf8(content.cast("string"))))


def load_answer_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a string id; of one id the last record in the order of files and lines. Blank and broken lines go."""
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("_at"))
    rows = lines.where(F.trim("value") != "").select("_at", F.from_json("value", schema).alias("r")).where("r.id IS NOT NULL")
    return rows.groupBy("r.id").agg(F.max_by("r", "_at").alias("r")).select("r.*")
