"""Column functions on page profiles and tables: text quality, formulas, routes, table parts. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Marks of wrong decoding, signs and patterns of formulas, thresholds of the routes.
MOJIBAKE = ("\ufffd", "锟斤拷", "ï¿½", "□□", "\x00")
SUSPECT = r"[\p{Cc}\p{Co}\x{FFFD}&&[^\s\x1C-\x1F\x{85}]]"
MATH_SIGNS = "[∑∫√∞≈≠≤≥±×÷∂πθλμσΔΣΩαβγ^=<>]"
MATH_PATTERNS = (r"(?<![\p{L}\p{N}_])[a-zA-Z]\s*[=<>]\s*[-+*/()a-zA-Z0-9]+", r"\\(?:frac|sum|int|sqrt|alpha|beta|gamma|theta|lambda)(?![\p{L}\p{N}_])")
MIN_TEXT, MAX_GARBLED, LOW_IMAGE, HIGH_IMAGE, MANY_DRAWINGS, HIGH_MATH = 200, 0.05, 0.20, 0.45, 40, 0.02
COMPLEX_SHARE = 0.35


def page_text(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t]+\n", "\n"), r"^\s+|\s+$", "")


def _count(text: Column, part: str) -> Column:
    """Characters of text within non-overlapping occurrences of part."""
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


def garbled_score(clean: Column) -> Column:
    marks = F.regexp_count(clean, F.lit(SUSPECT))
    for part in MOJIBAKE:
        marks = marks + _count(clean, part)
    return F.when(F.length(clean) == 0, 1.0).otherwise(F.least(F.lit(1.0), marks / F.length(clean)))


def repeat_score(clean: Column) -> Column:
    """Longest run of one character that isn't white space, as a share of the text."""
    runs = F.transform(F.regexp_extract_all(clean, F.lit(r"((\S)\2+)"), 1), F.length)
    return F.when(F.length(clean) == 0, 0.0).otherwise(F.coalesce(F.array_max(runs), F.lit(1)) / F.length(clean))


def quality_score(clean: Column) -> Column:
    return F.least(F.length(clean) / MIN_TEXT, F.lit(1.0)) * (1 - garbled_score(clean)) * (1 - repeat_score(clean))


def math_score(clean: Column) -> Column:
    hits = F.regexp_count(clean, F.lit(MATH_SIGNS))
    for pattern in MATH_PATTERNS:
        hits = hits + 8 * F.regexp_count(clean, F.lit(pattern))
    return F.when(F.length(clean) == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), hits / F.length(clean)), 4))


def route_page(text_len: Column, garbled: Column, image_ratio: Column, drawings: Column, math: Column) -> Column:
    """Which parser a page needs: the first rule that holds decides."""
    return (
        F.when((text_len < MIN_TEXT) & (image_ratio >= HIGH_IMAGE), "mineru_ocr").when((text_len > 0) & (garbled > MAX_GARBLED), "mineru_ocr")
        .when((drawings >= MANY_DRAWINGS) | (math >= HIGH_MATH) | (image_ratio >= HIGH_IMAGE), "mineru_complex")
        .when((text_len >= MIN_TEXT) & (image_ratio <= LOW_IMAGE), "simple_text").otherwise("mineru_complex")
    )


# Why a page takes its route, by the rule that holds first.
REASONS = (
    "text layer is sparse and image area is high", "text layer appears garbled", "many drawings or line elements suggest tables or layout complexity", "math or formula features are present",
    "large image area suggests complex page layout", "selectable text is sufficient and page image area is low", "page does not meet simple text extraction thresholds",
)


def route_reason(text_len: Column, garbled: Column, image_ratio: Column, drawings: Column, math: Column) -> Column:
    """C-16: why route_page sends a page where it does."""
    rules = (
        (text_len < MIN_TEXT) & (image_ratio >= HIGH_IMAGE), (text_len > 0) & (garbled > MAX_GARBLED), drawings >= MANY_DRAWINGS, math >= HIGH_MATH, image_ratio >= HIGH_IMAGE,
        (text_len >= MIN_TEXT) & (image_ratio <= LOW_IMAGE),
    )
    return F.coalesce(*[F.when(rule, why) for rule, why in zip(rules, REASONS)], F.lit(REASONS[-1]))


def markdown_table(title: Column, headers: Column, rows: Column) -> Column:
    """Title line, blank line, header, rule and rows padded or cut to the header's width; the title alone without headers."""
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.size(headers))), F.lit(1), F.size(headers))
    body = F.transform(rows, lambda r: line(F.transform(fit(r), cell)))
    head = F.array(F.concat(F.lit("### "), title), F.lit(""), line(F.transform(headers, cell)), line(F.transform(headers, lambda _: F.lit("---"))))
    return F.when(F.size(headers) > 0, F.array_join(F.concat(head, body), "\n")).otherwise(F.concat(F.lit("### "), title))


def _table(markdown: Column, use) -> Column:
    """use(t) of a table's lines up to the rule under the header (t.head, null without a table) and filled ones below (t.body)."""
    text = F.regexp_replace(markdown, r"^\s+|\s+$", "")
    lines = F.transform(F.split(text, "\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"\s+$", ""))

    def cut(at: Column, rows: Column) -> Column:
        head = F.when((at > 0) & (at < F.size(rows)), F.slice(rows, F.lit(1), at + 1))
        body = F.filter(F.slice(rows, at + 2, F.size(rows)), lambda x: F.trim(x) != "")
        return F.struct(F.array_join(head, "\n").alias("head"), body.alias("body"))

    start = lambda rows: F.array_position(F.transform(rows, lambda x: F.startswith(F.ltrim(x), F.lit("|"))), True).cast("int")
    return let(lines, lambda rows: let(start(rows), lambda at: let(cut(at, rows), use)))


def table_rows(markdown: Column) -> Column:
    """One part for each row, under the lines of the header; no part without a table."""
    rows = lambda t: F.transform(t["body"], lambda r: F.concat(t["head"], F.lit("\n"), r))
    return _table(markdown, lambda t: F.when(t["head"].isNull(), F.array().cast("array<string>")).otherwise(rows(t)))


def table_parts(markdown: Column, size: int) -> Column:
    """Rows packed in order under a repeated header, each part of at most `size` characters or a single row."""
    blank = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def pack(t: Column) -> Column:
        def step(state: Column, row: Column) -> Column:
            longer = F.concat(state["open"], F.lit("\n"), row)
            full = (state["open"] != "") & (F.length(t["head"]) + F.length(longer) > size)
            return F.struct(
                F.when(full, F.array_append(state["done"], state["open"])).otherwise(state["done"]).alias("done"),
                F.when(full, F.concat(F.lit("\n"), row)).otherwise(longer).alias("open"),
            )

        parts = F.aggregate(t["body"], blank, step, lambda s: F.array_append(s["done"], s["open"]))
        return F.when(t["head"].isNotNull() & (F.size(t["body"]) > 0), F.transform(parts, lambda p: F.concat(t["head"], p)))

    return F.coalesce(_table(markdown, pack), F.array(markdown))
