"""Question sets in three formats: delimited files with a header, Markdown table rows, and Markdown blocks."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

# The columns of a table row, the fields of a block, and where a history stands, in that order.
ROW_START = "| TQ-"
ROW_FIELDS = ("id", "document", "keyword", "question", "expected", "expected_chunk_id")
BLOCK_FIELDS = {
    "Document": "document", "Keyword": "keyword", "Question": "question", "Expected": "expected", "Expected Chunk ID": "expected_chunk_id", "Expected Chunk IDs": "expected_chunk_ids",
    "History JSON": "History JSON",
}
HISTORY = ("History JSON", "history_json", "history")
FIELDS = ("id", "document", "keyword", "question", "expected", "expected_chunk_id", "expected_chunk_ids")


@F.pandas_udf(ArrayType(MapType(StringType(), StringType())))
def _csv_rows(texts: pd.Series) -> pd.Series:
    def rows(text):
        if text is None:
            return None
        return [{k: (v or "").strip() for k, v in row.items() if k} for row in csv.DictReader(io.StringIO(text.removeprefix("﻿"), newline=""))]

    return texts.map(rows)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _from_csv(files: DataFrame) -> DataFrame:
    return files.select("path", F.lit(0).alias("kind"), F.posexplode(_csv_rows("text")).alias("place", "item"))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("text", r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]", -1)).alias("place", "line"))


def _from_rows(lines: DataFrame) -> DataFrame:
    """Rows of Markdown tables of five cells or more that start as question rows do."""
    cells = F.transform(F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"\|", -1), _trimmed)
    rows = lines.where(F.startswith("line", F.lit(ROW_START))).withColumn("c", cells).where(F.size("c") >= 5)
    pairs = [x for i, f in enumerate(ROW_FIELDS) for x in (F.lit(f), F.coalesce(F.get("c", F.lit(i)), F.lit("")))]
    return rows.select("path", F.lit(1).alias("kind"), "place", F.create_map(*pairs).alias("item"))


def _from_blocks(lines: DataFrame) -> DataFrame:
    """Blocks that begin with a heading of level 2, their id, and go on to the next; of a field that comes twice the last counts."""
    start = F.when(F.startswith("line", F.lit("## ")), F.struct("place", _trimmed(F.substring("line", 4, 1 << 30)).alias("id")))
    lines = lines.withColumn("block", F.last(start, ignorenulls=True).over(W.partitionBy("path").orderBy("place").rowsBetween(W.unboundedPreceding, 0)))
    names = F.create_map(*[F.lit(x) for pair in BLOCK_FIELDS.items() for x in pair])
    field = F.try_element_at(names, _trimmed(F.substring_index("line", ":", 1)))
    said = lines.where("block IS NOT NULL AND line NOT LIKE '## %' AND contains(line, ':')").withColumns({"field": field, "value": _trimmed(F.regexp_extract("line", r"(?s)^[^:]*:(.*)$", 1))})
    last = said.where("field IS NOT NULL").groupBy("path", "block", "field").agg(F.max_by("value", "place").alias("value"))
    made = last.groupBy("path", "block").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("item"))  # seven fields at most
    made = made.where((F.col("block.id") != "") & (F.coalesce(F.try_element_at("item", F.lit("question")), F.lit("")) != ""))
    return made.select("path", F.lit(2).alias("kind"), F.col("block.place").alias("place"), F.map_concat("item", F.create_map(F.lit("id"), F.col("block.id"))).alias("item"))


def parse_history(raw: Column) -> tuple[Column, Column]:
    """The messages (role, content) of a history in JSON, and what is wrong with it: null where it is right or empty."""
    value = F.try_parse_json(raw)
    items = F.try_variant_get(value, "$", "array<variant>")
    text = lambda v, name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING"
    right = F.forall(items, lambda v: F.coalesce(text(v, "role") & text(v, "content"), F.lit(False)))
    error = (
        F.when(F.coalesce(raw, F.lit("")) == "", None).when(value.isNull(), "invalid History JSON").when(~F.schema_of_variant(value).startswith("ARRAY"), "History JSON must be a list")
        .when(~right, "History JSON items require string role and content")
    )
    messages = F.transform(items, lambda v: F.struct(F.try_variant_get(v, "$.role", "string").alias("role"), F.try_variant_get(v, "$.content", "string").alias("content")))
    none = F.array().cast("array<struct<role:string,content:string>>")
    return F.when(error.isNull(), F.coalesce(messages, none)).otherwise(none), error


def parse_question_set(files: DataFrame) -> DataFrame:
    """S-09: (path, kind, place, id, document, keyword, question, expected, expected_chunk_id, expected_chunk_ids, history, error) of
    files (path, text).

    A path that ends in .csv is read with its header (kind 0); every other file gives its Markdown table rows (1) and its blocks
    (2), to be read in the order of kind and place, which counts rows or lines. Missing fields are empty. A history that isn't a list of messages leaves
    it empty and says so in error: rows don't stop the job. Null texts give no row. A file is the unit that one task sorts.
    """
    delimited = F.lower("path").endswith(".csv")
    lines = _lines(files.where(~delimited))
    rows = _from_csv(files.where(delimited)).union(_from_rows(lines)).union(_from_blocks(lines))
    get = lambda name: F.try_element_at("item", F.lit(name))
    history, error = parse_history(F.coalesce(*[get(h) for h in HISTORY]))
    return rows.select("path", "kind", "place", *[F.coalesce(get(f), F.lit("")).alias(f) for f in FIELDS], history.alias("history"), error.alias("error"))
