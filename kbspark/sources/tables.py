"""Tables in files and pages: delimited text, and HTML tables with spans."""

from __future__ import annotations

import csv
import html
import io
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import pages as P
from ..functions.text import collapse

#: Largest spans, as browsers take them.
MOST_COLUMNS, MOST_ROWS = 1000, 65_534

#: What stands between a tag's name and its end: `>` may be in quotes.
_ATTRIBUTES = r"(?:\"[^\"]*\"|'[^']*'|[^>\"'])*"

_ROWS = ArrayType(ArrayType(StringType()))


#: Texts whose cells a worker holds at once.
AT_ONCE = 128


def _parsed(at: int, delimiter: str):
    """Batches with a column more: the rows of the delimited text in column `at` as arrays of trimmed cells, without rows that are
    empty, AT_ONCE texts at a time."""

    def rows(text):
        cells = ([c.strip() for c in row] for row in csv.reader(io.StringIO(text or "", newline=""), delimiter=delimiter))
        return [row for row in cells if any(row)]

    def run(batches):
        for few in (batch.slice(i, AT_ONCE) for batch in batches for i in range(0, batch.num_rows, AT_ONCE)):
            made = pa.array([rows(text) for text in few.column(at).to_pylist()], pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([*few.columns, made], [*few.schema.names, "_rows"])

    return run


def delimited_table(files: DataFrame, delimiter: str = ",") -> DataFrame:
    """S-06: files (path, text, ...) with title, headers, rows and markdown of their delimited text.

    The first row that isn't empty has the headers, the title is the file's name without its extension. Null and empty texts
    have no header and no row, and their markdown is the title alone. Quoted cells may hold delimiters and line ends.
    """
    title = F.regexp_replace(F.regexp_extract("path", r"([^/]*)/*$", 1), r"(?<=.)\.[^.]+$", "")
    none = F.array().cast("array<string>")
    made = files.mapInArrow(_parsed(files.columns.index("text"), delimiter), StructType([*files.schema, StructField("_rows", _ROWS)])).withColumn("title", title)
    made = made.withColumns({"headers": F.coalesce(F.get("_rows", F.lit(0)), none), "rows": F.slice("_rows", 2, F.greatest(F.size("_rows"), F.lit(1)))}).drop("_rows")
    return made.withColumn("markdown", P.markdown_table(F.col("title"), F.col("headers"), F.col("rows")))


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    """Texts with character references; others are null."""
    return texts.map(lambda t: None if t is None else html.unescape(t))


def _cell_text(inner: Column) -> Column:
    """The text of a cell: without tags, references decoded, white space collapsed. Cells without references stay in the JVM."""
    plain = F.regexp_replace(inner, r"(?s)<!--.*?-->|<(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>", "")
    return F.regexp_replace(F.coalesce(_unescaped(F.when(plain.contains("&"), plain)), plain), r"(?U)\s+", " ")


def _span(attributes: Column, name: str, most: int) -> Column:
    number = F.regexp_extract(attributes, rf"(?i)\b{name}\s*=\s*[\"']?\s*(\d+)", 1).try_cast("long")
    return F.least(F.greatest(F.coalesce(number, F.lit(1)), F.lit(1)), F.lit(most)).cast("int")


def html_table_cells(pages: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    """S-08: (key, table, row, cell, tag, rowspan, colspan, text): the cells of the tables of pages, with places from 0.

    A row ends with its end tag, rows without cells don't count, and a cell that another one starts in is lost, as is one that
    never ends. Spans that aren't a number from 1 on are 1. Null pages have no table.
    """
    tables = pages.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(rf"(?is)<table\b{_ATTRIBUTES}>(.*?)</table\s*>"), F.lit(1))).alias("table", "t"))
    rows = tables.select(key, "table", F.regexp_extract_all("t", F.lit(rf"(?is)<tr\b{_ATTRIBUTES}>(.*?)</tr\s*>"), F.lit(1)).alias("rows"))
    cell = rf"(?is)<t[hd]\b{_ATTRIBUTES}>(?:(?!<t[hd]\b).)*?</t[hd]\s*>"
    cells = F.filter(F.transform("rows", lambda r: F.regexp_extract_all(r, F.lit(cell), F.lit(0))), lambda c: F.size(c) > 0)
    each = rows.select(key, "table", F.posexplode(cells).alias("row", "cells")).select(key, "table", "row", F.posexplode("cells").alias("cell", "c"))
    attributes = F.regexp_extract("c", rf"(?is)^<t[hd]\b({_ATTRIBUTES})>", 1)
    inner = F.regexp_extract("c", rf"(?is)^<t[hd]\b{_ATTRIBUTES}>(.*)</t[hd]\s*>$", 1)
    return each.select(
        key, "table", "row", "cell", F.lower(F.substring("c", 2, 2)).alias("tag"), _span(attributes, "rowspan", MOST_ROWS).alias("rowspan"), _span(attributes, "colspan", MOST_COLUMNS).alias("colspan"),
        F.trim(_cell_text(inner)).alias("text"),
    )


def fill_grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """A grid of the texts of rows of cells (text, rowspan, colspan): each cell goes to the first free column and fills its spans, but
    no rows beyond the last."""
    out: list[list[str]] = []
    below: dict[int, tuple[int, str]] = {}  # columns that cells above still fill: for how many rows, with what
    for cells in rows:
        line: dict[int, str] = {c: text for c, (_, text) in below.items()}
        below = {c: (n - 1, text) for c, (n, text) in below.items() if n > 1}
        column = 0
        for text, high, wide in cells:
            while column in line:
                column += 1
            for c in range(column, column + wide):
                if c not in line:
                    line[c] = text
                    if high > 1:
                        below[c] = (high - 1, text)
            column += wide
        out.append([line.get(c, "") for c in range(max(line, default=-1) + 1)])
    return out


@F.pandas_udf(_ROWS)
def _grids(tables: pd.Series) -> pd.Series:
    """Grids of tables, given as JSON of rows of cells."""
    return tables.map(lambda t: fill_grid([[(c["text"], c["rowspan"], c["colspan"]) for c in row] for row in json.loads(t)]))


def html_tables(pages: DataFrame, key: str = "page_id", text: str = "html", title: str = "") -> DataFrame:
    """S-08: (key, table, title, headers, rows, grid) of the tables of pages.

    headers and rows have the texts of cells as they stand; where the first row is one cell over several columns and the next has
    more than one, it is the title, and the next row has the headers. grid has the texts at the places that spans fill, title
    row included. A table is put together by one task.
    """
    cells = html_table_cells(pages, key, text)
    rows = cells.groupBy(key, "table", "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "text", "rowspan", "colspan"))), lambda c: F.struct(c["text"].alias("text"), c["rowspan"].alias("rowspan"), c["colspan"].alias("colspan"))).alias("cells"))
    tables = rows.groupBy(key, "table").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "cells"))), lambda r: r["cells"]).alias("r"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    titled = (F.size("r") > 1) & (F.size(first) == 1) & (F.get(first, F.lit(0))["colspan"] > 1) & (F.size(second) > 1)
    texts = F.transform("r", lambda row: F.transform(row, lambda c: c["text"]))
    made = tables.select(key, "table", F.coalesce(titled, F.lit(False)).alias("_titled"), texts.alias("_texts"), _grids(F.to_json("r")).alias("grid"))
    head = F.col("_titled").cast("int")
    name = F.when(F.col("_titled"), F.nullif(F.get(F.get("_texts", F.lit(0)), F.lit(0)), F.lit("")))
    return made.select(key, "table", F.coalesce(name, F.lit(title)).alias("title"), F.get("_texts", head).alias("headers"), F.slice("_texts", head + 2, F.greatest(F.size("_texts"), F.lit(1))).alias("rows"), "grid")
