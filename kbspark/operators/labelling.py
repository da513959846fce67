"""Labels for questions: which chunk of the named document holds the expected evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import text as T
from ..functions.payloads import basename_key, leading_int, page_from_chunk
from .evaluation import AT_ONCE, gram_shares

# What counts as an identifier, the weights of a score's parts, and the score from which a chunk is a match.
IDENTIFIER = r"(?iU)\b[A-Z]-\d{3,}\b|\b[A-Z]{2,}(?:/[A-Z]{2,})*\b|[\w.+-]+@[\w.-]+\.\w+"
WEIGHTS = {"evidence": 0.62, "answer": 0.16, "question": 0.04, "page": 0.10, "identifier": 0.08}
MATCHED = 0.35
PREVIEW_CHARS = 180


def identifiers(*texts: Column) -> Column:
    """E-15: the distinct codes, words of letters and addresses in texts, without case and white space."""
    said = F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts])
    return F.array_distinct(F.transform(F.regexp_extract_all(said, F.lit(IDENTIFIER), F.lit(0)), lambda x: F.regexp_replace(F.lower(x), r"(?U)\s+", "")))


def wanted_grams(expected: Column, n: int = 3) -> Column:
    """What recall looks for in a chunk: the distinct runs of n characters of an expected text, or a short text itself."""
    return F.when(F.length(expected) > n, T.ngrams(expected, n)).when(F.length(expected) > 0, F.array(expected)).otherwise(F.array().cast("array<string>"))


def recall(expected: Column, grams: Column, actual: Column) -> Column:
    """E-14 with the expected text's grams at hand: 1 if the text holds it, else the share of grams that the text holds."""
    share = F.size(F.filter(grams, lambda g: F.contains(actual, g))) / F.size(grams)
    return F.when(F.size(grams) == 0, 0.0).when(F.contains(actual, expected), 1.0).otherwise(share)


@F.pandas_udf(ArrayType(DoubleType()))
def _recalls(texts: pd.Series, *expected: pd.Series) -> pd.Series:
    """`recall` of each expected text in a text. Rows of one text follow each other where questions are sent to the chunks."""
    out = []
    for i in range(0, len(texts), AT_ONCE):
        row, kinds = pd.factorize(texts[i : i + AT_ONCE])
        column, asked = pd.factorize(pd.concat([e[i : i + AT_ONCE] for e in expected]))
        shares = gram_shares(list(kinds), list(asked))
        for q in (q for q, e in enumerate(asked) if len(e) < 3):
            shares[:, q] = [bool(asked[q]) and asked[q] in t for t in kinds]
        out += shares[row, column.reshape(len(expected), -1)].T.tolist()
    return pd.Series(out)


def label_questions(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """E-13: (question_id, status, score, chunk_id, chunk_index, page, preview and the score's parts) for each question.

    questions: question_id, question, answer, evidence, source_document, source_path, source_chunk; chunks: chunk_id, doc_ix, chunk_index,
    source_name, source_path, page, text. A question meets the chunks whose file name, by name or path, is its own, and no
    others. Of them the best counts, ties by doc_ix, chunk_index and chunk_id; it is matched from a score of 0.35 on or
    with an identifier, else low_confidence. A question that meets none is source_not_found, with a score of 0. Null texts are empty.
    A chunk's grams are made once for the questions that follow each other in a pack, and the best is combined before the shuffle.
    """
    said = {c: T.squeeze(F.coalesce(c, F.lit(""))) for c in ("evidence", "answer", "question")}
    name = F.coalesce(F.nullif("source_document", F.lit("")), "source_path")
    asked = questions.select(
        "question_id", basename_key(name).alias("_file"), leading_int(F.coalesce("source_chunk", F.lit(""))).alias("_page"), identifiers(F.col("question"), F.col("answer"), F.col("evidence")).alias("_ids"),
        *[v.alias(f"_{c}") for c, v in said.items()],
    )
    files = F.array_distinct(F.array(basename_key(F.col("source_name")), basename_key(F.col("source_path"))))
    page = page_from_chunk(F.col("page").cast("string"), F.coalesce("text", F.lit("")))
    held = chunks.select(F.explode(files).alias("_file"), "chunk_id", "doc_ix", "chunk_index", page.alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    held = held.join(asked.select("_file").distinct(), "_file", "left_semi")  # before any work on texts
    preview = F.substring(T.collapse(F.col("text")), 1, PREVIEW_CHARS)
    held = held.select("*", T.squeeze(F.col("text")).alias("_text"), preview.alias("preview")).drop("text")
    parts = {c: F.col("_recalls")[i] for i, c in enumerate(said)}
    parts["page"] = F.coalesce((F.col("page") == F.col("_page")).cast("double"), F.lit(0.0))
    parts["identifier"] = F.exists("_ids", lambda x: F.contains(F.col("_text"), x)).cast("double")
    met = held.join(asked, "_file").withColumn("_recalls", _recalls("_text", *[f"_{c}" for c in said]))
    scored = met.select("question_id", "chunk_id", "doc_ix", "chunk_index", "page", "preview", *[v.alias(f"{c}_score") for c, v in parts.items()])
    total = F.lit(0.0)
    for c, w in WEIGHTS.items():
        total = total + w * F.col(f"{c}_score")
    scored = scored.withColumn("score", total)
    kept = F.struct("score", "chunk_id", "chunk_index", "page", "preview", *[f"{c}_score" for c in WEIGHTS])
    best = scored.groupBy("question_id").agg(F.min_by(kept, F.struct((-F.col("score")).alias("s"), "doc_ix", "chunk_index", "chunk_id")).alias("b"))
    sure = (F.col("b.score") >= MATCHED) | (F.col("b.identifier_score") > 0)
    status = F.when(F.col("b").isNull(), "source_not_found").when(sure, "matched").otherwise("low_confidence")
    out = questions.select("question_id").join(best, "question_id", "left")
    return out.select("question_id", status.alias("status"), F.coalesce("b.score", F.lit(0.0)).alias("score"), "b.chunk_id", "b.chunk_index", "b.page", "b.preview", *[f"b.{c}_score" for c in WEIGHTS])


def label_statuses(labels: DataFrame) -> DataFrame:
    """E-13: (status, questions) of labels."""
    return labels.groupBy("status").agg(F.count("*").alias("questions"))
