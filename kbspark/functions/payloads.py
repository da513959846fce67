"""Column functions on model payloads and labels: JSON objects in texts, query lists, pages and names of chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze

# How many queries a plan may have, and the words that stand for yes and no.
MOST_QUERIES = 3
YES, NO = ("true", "yes", "1"), ("false", "no", "0")


def parse_json_object(text: Column) -> Column:
    """Q-16: the JSON object between the first { and the last } of a text, as text; null where that isn't an object."""
    inner = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.schema_of_variant(F.try_parse_json(inner)).startswith("OBJECT"), inner)


def coerce_bool(text: Column, default: bool) -> Column:
    """Q-16: a truth value from words for yes and no or a number; the default for all else."""
    word = F.lower(F.trim(text))
    number = word.try_cast("double")
    return F.when(word.isin(*YES), True).when(word.isin(*NO), False).when(number.isNotNull(), number != 0).otherwise(F.lit(default))


def normalize_queries(queries: Column, fallback: Column, most: int = MOST_QUERIES) -> Column:
    """Q-15: the first distinct filled queries, trimmed; the fallback where there are none."""
    filled = F.array_distinct(F.filter(F.transform(F.coalesce(queries, F.array().cast("array<string>")), lambda q: F.trim(q)), lambda q: q != ""))
    return F.when(F.size(filled) > 0, F.slice(filled, 1, most)).otherwise(F.array(fallback))


def leading_int(text: Column) -> Column:
    """E-16: the digits that a text begins with, as a number; null where there are none or too many for one."""
    return F.regexp_extract(text, r"^\s*(\d+)", 1).try_cast("long")


def page_from_chunk(page: Column, text: Column) -> Column:
    """E-16: the page of a chunk, by its column if that is a number, else by the first `## Page n` in its text, in any case."""
    return F.coalesce(page.try_cast("long"), F.regexp_extract(text, r"(?i)##\s*Page\s+(\d+)", 1).try_cast("long"))


def basename_key(path: Column) -> Column:
    """E-16: the last name of a path, with either slash, without case and white space; empty for null."""
    return squeeze(F.regexp_extract(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), r"([^/]*)/*$", 1))
