"""Column functions on text: cleaning, rejection rules, digests and overlap. All run in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as page-number line, table-of-contents line and contents heading.
PAGE_NUMBER = r"(?i)^(?:#{1,6}\s*)?(?:page\s*\d+(?:\s*(?:of|/)\s*\d+)?|第\s*\d+\s*页)$"
TOC_LINE = r"^(?:\d+(?:\.\d+)*\s+)?[^\n]{1,100}?\s*(?:\.{2,}|…+)\s*\d+\s*$"
TOC_HEADING = r"(?i)^(?:(?:table\s+of\s+)?contents|目\s*录)$"
GARBLED_SHARE = 0.20


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: what a lambda reads from outside is else computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_whitespace(text: Column) -> Column:
    """LF line ends, single spaces, trimmed lines, at most one blank line, trimmed ends."""
    lf = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+", " ")
    lines = F.array_join(F.transform(F.split(lf, "\n", -1), lambda x: F.trim(x)), "\n")
    return F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    """Compatibility forms composed and case folded; only texts beyond ASCII are handed over, others are null."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def normalize_for_dedup(text: Column) -> Column:
    """C-11: text with compatibility forms composed, case folded and single spaces. ASCII texts stay in the JVM."""
    return collapse(F.coalesce(_folded(F.when(text.rlike(r"[^\x00-\x7F]"), text)), F.lower(text)))


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    """Compatibility forms composed, in lower case; only texts beyond ASCII are handed over, others are null."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower())


def squeeze(text: Column) -> Column:
    """Text with compatibility forms composed, in lower case and without white space. ASCII texts stay in the JVM."""
    return F.regexp_replace(F.coalesce(_composed(F.when(text.rlike(r"[^\x00-\x7F]"), text)), F.lower(text)), r"(?U)\s+", "")


def filled_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def is_toc_line(line: Column) -> Column:
    return line.rlike(PAGE_NUMBER) | line.rlike(TOC_LINE)


def is_title_only(lines: Column) -> Column:
    return (F.size(lines) == 1) & F.coalesce(F.get(lines, F.lit(0)).rlike(r"^#{1,6}\s+.+$"), F.lit(False))


def is_toc_block(lines: Column) -> Column:
    headed = F.exists(lines, lambda x: x.rlike(TOC_HEADING)) & F.exists(lines, is_toc_line)
    return (F.size(lines) > 0) & (F.forall(lines, is_toc_line) | headed)


def garbled_ratio(text: Column) -> Column:
    """Replacement and category C characters among those that aren't white space; 0 where there are none."""
    solid = F.regexp_replace(text, r"\s", "")
    return F.when(F.length(solid) > 0, F.regexp_count(solid, F.lit(r"[\p{C}\x{FFFD}]")) / F.length(solid)).otherwise(0.0)


def rejection_reason(text: Column, content_type: Column) -> Column:
    lines = filled_lines(text)
    return (
        F.when(content_type.isin("table", "table_row"), None)
        .when(is_title_only(lines), "title_only")
        .when(is_toc_block(lines), "table_of_contents")
        .when(garbled_ratio(text) > GARBLED_SHARE, "garbled")
    )


def join_wrapped_lines(text: Column) -> Column:
    """C-05: lines of a paragraph joined by a space; paragraphs stay apart."""
    return F.array_join(F.transform(F.split(text, "\n\n+"), lambda p: F.replace(p, F.lit("\n"), F.lit(" "))), "\n\n")


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def chunk_id(path: Column, page: Column, doc_ix: Column, chunk_ix: Column, text: Column) -> Column:
    page = F.coalesce(page.cast("string"), F.lit("None"))
    return F.substring(F.sha1(F.concat_ws("|", path, page, doc_ix, chunk_ix, F.substring(text, 1, 160)).cast("binary")), 1, 20)


def document_key(kb: Column, file_hash: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", kb, file_hash).cast("binary")), 1, 24)


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ngrams(text: Column, n: int = 3) -> Column:
    """The text's distinct runs of n characters; null for null."""
    parts = lambda cs: F.transform(cs, lambda _, i: F.concat(*[F.get(cs, i + j) for j in range(n)]))
    return let(F.split(text, ""), lambda cs: F.array_distinct(F.array_compact(parts(cs))))


def ngram_recall(expected: Column, actual: Column, n: int = 3) -> Column:
    """E-14: 1 if contained, else the share of the expected text's distinct n-grams that occur in the actual one."""

    def share(wanted: Column) -> Column:
        return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, ngrams(actual, n))) / F.size(wanted)).otherwise(0.0)

    return F.when(F.contains(actual, expected), 1.0).otherwise(let(ngrams(expected, n), share))
