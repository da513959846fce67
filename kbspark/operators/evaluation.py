"""Ranking metrics over tables of hits and expectations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import _slices, _split

#: Texts whose runs of characters a worker holds at once.
AT_ONCE = 256


def per_question_metrics(hits: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """hits (query_id, chunk_id, rank), expected (query_id, chunk_id): first relevant rank, hit@k, precision@k (by k),
    recall@k (by the size of the expected set) and reciprocal rank, for each question that has an expectation."""
    expected = expected.distinct()
    size = expected.groupBy("query_id").agg(F.count("*").alias("n_expected"))
    found = hits.join(expected, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first_rank"), F.count_if(F.col("rank") <= k).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return size.join(found, "query_id", "left").select(
        "query_id", "first_rank", (n > 0).alias("hit"), (n / k).alias("precision"), (n / F.col("n_expected")).alias("recall"), F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank")
    )


def percentile_nearest_rank(df: DataFrame, by: list[str], value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(by, n, p50, p95, ...): rows of each group and its nearest-rank percentiles; nulls count in n only, and a group of nulls has null
    percentiles. Rows are counted by value before anything is sorted, and a group's values are sorted with spilling, not held."""
    counted = df.groupBy(*by, F.col(value).alias("_value")).agg(F.count("*").alias("_rows"))
    known = F.when(F.col("_value").isNotNull(), F.col("_rows")).otherwise(0)
    group = Window.partitionBy(*by)
    placed = counted.withColumns({"_total": F.sum(known).over(group), "_upto": F.sum(known).over(group.orderBy(F.asc_nulls_first("_value")).rowsBetween(Window.unboundedPreceding, 0))})
    cut = [F.min(F.when(F.col("_upto") >= F.lit(p) * F.col("_total") - F.lit(1e-9), F.col("_value"))).alias(f"p{round(p * 100)}") for p in shares]
    return placed.groupBy(*by).agg(F.sum("_rows").alias("n"), *cut)


def exact_mean(value, digits: int = 4):
    """Mean of numbers at nine decimals, rounded half up: from sums of whole numbers, so no order of rows changes it."""
    total = F.sum(F.round(value.cast("double") * 1_000_000_000).cast("decimal(20,0)")).cast("decimal(30,0)")
    n, unit, scale = F.count(value).cast("decimal(20,0)"), F.lit(1_000_000_000).cast("decimal(10,0)"), 10**digits
    whole = F.floor((F.lit(2).cast("decimal(1,0)") * total * F.lit(scale).cast("decimal(6,0)") + n * unit) / (F.lit(2).cast("decimal(1,0)") * n * unit))
    return F.coalesce(whole.cast("double") / scale, F.lit(0.0))


def summary(metrics: DataFrame) -> DataFrame:
    """E-06 without latencies: means at four decimals and the number of misses; zeros for no question."""
    mean = lambda c: exact_mean(F.col(c).cast("double"))
    return metrics.agg(
        F.count("*").alias("questions"), mean("hit").alias("hit_rate"), mean("precision").alias("mean_precision"), mean("recall").alias("mean_recall"),
        mean("reciprocal_rank").alias("mrr"), F.count_if(F.col("first_rank").isNull()).alias("miss_count"),
    )


def latency_summary(records: DataFrame, by: list[str], value: str = "latency_ms") -> DataFrame:
    """E-06, latencies: mean and nearest-rank percentiles at two decimals of each group."""
    cut = lambda p: F.round(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})"), 2)
    return records.groupBy(*by).agg(exact_mean(F.col(value), 2).alias("mean_ms"), cut(0.5).alias("p50_ms"), cut(0.95).alias("p95_ms"), cut(0.99).alias("p99_ms"))


def sample_questions(questions: DataFrame, limit: int, seed: int | None = None) -> DataFrame:
    """E-01: all questions (query_id) if limit is under 1; the first by id without a seed, else those of least hash."""
    if limit < 1:
        return questions
    order = ["query_id"] if seed is None else [F.xxhash64("query_id", F.lit(seed)), "query_id"]
    return questions.orderBy(*order).limit(limit)


def parse_expected_ids(plural, single):
    """E-02: distinct trimmed ids of the plural column, or where that is blank of the single one, cut at , and ;."""
    text = F.coalesce(F.nullif(F.trim(plural), F.lit("")), single, F.lit(""))
    return F.array_distinct(F.filter(F.transform(F.split(text, "[,;]"), lambda x: F.trim(x)), lambda x: x != ""))


def document_key(name):
    """Letters and digits of a name, in lower case."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def stem(path):
    """The last name of a path without its extension; a name that only begins with a dot has none."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]+$", "")


def document_rank(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """E-04: (query_id, document_rank): least rank of the hits (query_id, name, rank) whose name without folders and
    extension contains the expected one (query_id, document), or lies in it, by letters and digits; null where none does."""
    a, b = document_key(F.col("document")), document_key(stem(F.col("name")))
    match = (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    return expected.join(hits, "query_id", "left").groupBy("query_id").agg(F.min(F.when(match, F.col("rank"))).alias("document_rank"))


def _listed(batches):
    """Rows (id, text) without null texts in packs, as lists."""
    for part in _slices(batches):
        part = part.filter(pc.is_valid(part.column(1)))
        if part.num_rows:
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, part.num_rows], part.column(c)) for c in (0, 1)], ["ids", "texts"])


def _found(run: int):
    """(query_id, chunk_id) of packs of texts and of items, each pair of packs looked through once."""
    powers = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(run)], np.uint64)

    def look(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, texts, asked_ids, asked = (batch.column(c)[i].values for c in range(4))
                words, of = _split(texts)
                code = np.asarray(words.indices, dtype=np.int64).astype(np.uint64)
                rolled = np.zeros(max(len(code) - run + 1, 0), np.uint64)
                for j in range(run):
                    rolled += code[j : j + len(rolled)] * powers[j]
                said, at = _split(asked)
                kinds = pc.fill_null(pc.index_in(said.dictionary, value_set=words.dictionary), -1).to_numpy()[np.asarray(said.indices, dtype=np.int64)]
                starts = np.searchsorted(at, np.arange(len(asked) + 1))
                pairs, wanted = [], {}
                for q in range(len(asked)):
                    if starts[q + 1] - starts[q] < run + 2:
                        pairs += [(q, t) for t in np.flatnonzero(pc.match_substring(texts, asked[q].as_py()))]
                    elif ((part := kinds[starts[q] + 1 : starts[q] + 1 + run]) >= 0).all():
                        wanted.setdefault(int((part.astype(np.uint64) * powers).sum()), []).append(q)
                if wanted:
                    sought = np.sort(np.array(list(wanted), np.uint64))
                    place = np.minimum(np.searchsorted(sought, rolled), len(sought) - 1)
                    met = np.flatnonzero(sought[place] == rolled)
                    for t, h in {*zip(of[met].tolist(), rolled[met].tolist())}:
                        text = texts[t].as_py()
                        pairs += [(q, t) for q in wanted[h] if asked[q].as_py() in text]
                if pairs:
                    q, t = np.array(pairs, np.int64).T
                    yield pa.RecordBatch.from_arrays([asked_ids.take(pa.array(q)), ids.take(pa.array(t))], ["query_id", "chunk_id"])

    return look


def containing(items: DataFrame, chunks: DataFrame, run: int = 6) -> DataFrame:
    """(query_id, chunk_id) of the chunks (chunk_id, text) whose text contains an item's (query_id, text).

    The words of an item but its first and last stand whole in any text that contains it, so items and texts meet at the hash of
    a run of them; what meets is verified. Items of fewer words than that are compared with all texts. Null texts contain nothing.
    Texts are looked through where they lie: Spark sends the packs of items around if they are small.
    """
    q, c = items.select("query_id", "text"), chunks.select("chunk_id", "text")
    packs = [d.mapInArrow(_listed, f"ids array<{d.schema[0].dataType.simpleString()}>, texts array<string>") for d in (q, c)]
    pairs = packs[1].crossJoin(packs[0].select(F.col("ids").alias("qids"), F.col("texts").alias("asked")))  # blocks of the stated query set
    return pairs.mapInArrow(_found(run), q.join(c.select("chunk_id")).select("query_id", "chunk_id").schema)


def online_metrics(hits: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """E-08: hit, recall and reciprocal rank cut at k, and precision at 1, of questions (query_id, expected: array of ids)
    and hits (query_id, chunk_id, rank); all null for a question without expectation."""
    listed = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).alias("top"))
    both = questions.join(listed, "query_id", "left")
    good = F.filter("top", lambda h: F.array_contains("expected", h["chunk_id"]))
    first = F.get(good, F.lit(0))["rank"]
    asked = F.size("expected") > 0
    score = lambda c: F.when(asked, c)
    return both.select(
        "query_id", score(F.coalesce(first.isNotNull().cast("int"), F.lit(0))).alias("hit"), score(F.round(F.coalesce(F.size(good), F.lit(0)) / F.size("expected"), 4)).alias("recall"),
        score(F.round(F.coalesce(1 / first, F.lit(0.0)), 4)).alias("mrr"), score(F.coalesce((first == 1).cast("int"), F.lit(0))).alias("precision_1"),
    )


def metric_report(scores: DataFrame) -> DataFrame:
    """E-11: (metric, mean, valid, coverage, complete) of scores (metric, value): nulls and NaN are not valid."""
    valid = F.when(~F.isnan("value"), F.col("value"))
    n = F.count(valid)
    return scores.groupBy("metric").agg(F.when(n > 0, exact_mean(valid)).alias("mean"), n.alias("valid"), F.round(n / F.count("*"), 4).alias("coverage"), (n == F.count("*")).alias("complete"))


def checkpoint_pending(records: DataFrame, metrics: DataFrame, scored: DataFrame) -> DataFrame:
    """E-12: (record_id, metric) without a score (record_id, metric, value) yet; metrics is a short list of names,
    of a few rows."""
    done = scored.where("value IS NOT NULL AND NOT isnan(value)").select("record_id", "metric")
    return records.select("record_id").crossJoin(F.broadcast(metrics.select("metric"))).join(done, ["record_id", "metric"], "left_anti")


def checkpoint_summary(records: DataFrame, metrics: DataFrame, scored: DataFrame) -> DataFrame:
    """E-12: (metric, mean, valid, coverage, complete) of a short list of metrics over records, for scores (record_id, metric, value) of each."""
    rows = records.select("record_id").crossJoin(F.broadcast(metrics.select("metric"))).join(scored, ["record_id", "metric"], "left")
    return metric_report(rows)


def answer_records(hits: DataFrame, questions: DataFrame, existing: DataFrame) -> DataFrame:
    """E-17: (query_id, source_ids) of the questions without an existing record, ids of their hits by rank."""
    listed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).alias("r"))
    ids = F.coalesce(F.array_join(F.transform("r", lambda x: x["chunk_id"].cast("string")), ","), F.lit(""))
    return questions.join(existing.select("query_id"), "query_id", "left_anti").join(listed, "query_id", "left").select("query_id", ids.alias("source_ids"))


# How much worse a candidate may be.
MOST_DROP, MOST_LLM_RATE, MOST_P95_MS = 0.01, 0.30, 1500


def compare_reports(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(passed, failed_gates, delta_recall, delta_mrr, delta_p95) of two reports of one row (recall, mrr, llm_call_rate, p95_ms)."""
    both = baseline.select(*[F.col(c).alias(f"_{c}") for c in ("recall", "mrr", "p95_ms")]).crossJoin(F.broadcast(candidate))  # one row each
    failed = F.concat_ws(
        ",", F.when(F.col("recall") < F.col("_recall") - MOST_DROP, "recall"), F.when(F.col("mrr") < F.col("_mrr") - MOST_DROP, "MRR"),
        F.when(F.col("llm_call_rate") > MOST_LLM_RATE, "llm_call_rate"), F.when(F.col("p95_ms") > F.col("_p95_ms") + MOST_P95_MS, "P95_ms"),
    )
    delta = lambda c, digits: F.round(F.col(c) - F.col(f"_{c}"), digits)
    made = both.select(failed.alias("failed_gates"), delta("recall", 4).alias("delta_recall"), delta("mrr", 4).alias("delta_mrr"), delta("p95_ms", 2).alias("delta_p95"))
    return made.withColumn("passed", F.col("failed_gates") == "")


def missed_questions(metrics: DataFrame) -> DataFrame:
    """E-10: the questions (query_id) of a report's metrics without a relevant hit, a row each."""
    return metrics.where("first_rank IS NULL").select("query_id")


def _grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """A code of each run of n characters of texts, equal for equal runs alone, and the text that each is of."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    of, code = np.repeat(np.arange(len(texts)), [len(t) for t in texts]), chars
    for j in range(1, n):
        code = np.unique(code, return_inverse=True)[1].astype(np.uint64) if j > 2 else code  # a character has 21 bits
        code = code[:-1] << np.uint64(21) | chars[j:]
    whole = of[: len(code)] == of[n - 1 :][: len(code)]
    return code[whole], of[: len(code)][whole]


def gram_shares(texts: list[str], asked: list[str], n: int = 3, columns: int = 8192) -> np.ndarray:
    """The share of each asked text's distinct runs of n characters that each text holds, by products of the tables of what
    grams each holds; 0 where there are none."""
    code, of = _grams(asked + texts, n)
    kinds = np.unique(code[of < len(asked)])
    total, sizes = np.zeros((len(texts), len(asked)), np.float32), np.zeros(len(asked))
    if len(kinds):
        place = np.minimum(np.searchsorted(kinds, code), len(kinds) - 1)
        known = kinds[place] == code
        place, of = place[known], of[known]
        for low in range(0, len(kinds), columns):
            part = (place >= low) & (place < low + columns)
            held = np.zeros((len(asked) + len(texts), min(columns, len(kinds) - low)), np.float32)
            held[of[part], place[part] - low] = 1
            sizes += held[: len(asked)].sum(1)
            total += held[len(asked) :] @ held[: len(asked)].T  # whole numbers below 2^24 are exact
    return total.astype(np.float64) / np.maximum(sizes, 1)


def _recalls(least: float, n: int):
    """(item_id, doc_id, recall) of packs of texts and of items."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, texts, asked_ids, asked = (batch.column(c)[i].values for c in range(4))
                for at in range(0, len(texts), AT_ONCE):
                    share = gram_shares(texts.slice(at, AT_ONCE).to_pylist(), asked.to_pylist(), n)
                    t, q = np.nonzero((share >= least) & (share > 0))
                    yield pa.RecordBatch.from_arrays([asked_ids.take(pa.array(q)), ids.take(pa.array(t + at)), pa.array(share[t, q])], ["item_id", "doc_id", "recall"])

    return run


def ngram_candidates(items: DataFrame, chunks: DataFrame, least: float = 0.35, n: int = 3) -> DataFrame:
    """E-14 of all items (item_id, expected) against all chunks (doc_id, text), with distinct ids: (item_id, doc_id, recall) of
    the pairs whose recall is `least` (over 0) or more. Packs of texts and of items are multiplied where the texts lie: Spark sends the
    packs of items around if they are small. Null texts and those of fewer than n characters have no pair."""
    q, c = items.select("item_id", "expected"), chunks.select("doc_id", "text")
    packs = [d.mapInArrow(_listed, f"ids array<{d.schema[0].dataType.simpleString()}>, texts array<string>") for d in (q, c)]
    pairs = packs[1].crossJoin(packs[0].select(F.col("ids").alias("qids"), F.col("texts").alias("asked")))  # blocks of all pairs
    return pairs.mapInArrow(_recalls(least, n), q.join(c.select("doc_id")).select("item_id", "doc_id", F.lit(0.0).alias("recall")).schema)
