"""Decisions on retrieved sources: document references, filters, judgements, attempts, digests and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import payloads
from ..functions import questions as Q
from ..functions.text import let

# How often a question is looked up, the characters that a context needs, and the sizes of digests.
MOST_ATTEMPTS = 2
LEAST_CHARS = 8
SNIPPETS, SNIPPET_CHARS = 4, 600
DOCUMENT_SNIPPETS, DOCUMENT_CHARS = 4, 400


def document_key(path: Column = None, name: Column = None) -> Column:
    """The path of a source, or where that is empty its name."""
    path = F.col("source_path") if path is None else path
    return F.coalesce(F.nullif(path, F.lit("")), F.col("source_name") if name is None else name)


def numbered_documents(sources: DataFrame) -> DataFrame:
    """(question_id, document_key, source_name, number): the documents of sources (question_id, pos, source_path, source_name)
    from 1 in the order in which each question meets them, named as in their first source."""
    first = sources.withColumn("document_key", document_key()).groupBy("question_id", "document_key").agg(F.min("pos").alias("pos"), F.min_by("source_name", "pos").alias("source_name"))
    return first.withColumn("number", F.row_number().over(W.partitionBy("question_id").orderBy("pos"))).drop("pos")


def resolve_document_refs(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """R-20: (question_id, document_key, place) that references (question_id, pos, ref) mean, each document once, in order.

    A document goes by its path, its name, its number and D with its number, without case and outer space; where two
    documents share a name the later one has it. Blank and unknown references mean none.
    """
    number = F.col("number").cast("string")
    names = F.array(F.col("document_key"), F.col("source_name"), number, F.concat(F.lit("D"), number))
    aliases = numbered_documents(sources).select("question_id", "document_key", "number", F.posexplode(names).alias("slot", "name"))
    aliases = aliases.where("name <> ''").groupBy("question_id", F.lower(F.trim("name")).alias("alias")).agg(F.max_by("document_key", F.struct("number", "slot")).alias("document_key"))
    asked = refs.where("trim(ref) <> ''").select("question_id", "pos", F.lower(F.trim("ref")).alias("alias"))
    found = asked.join(aliases, ["question_id", "alias"]).groupBy("question_id", "document_key").agg(F.min("pos").alias("pos"))
    return found.withColumn("place", F.row_number().over(W.partitionBy("question_id").orderBy("pos"))).drop("pos")


def resolve_chunk_refs(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """(question_id, document_key) of the chunks that references (question_id, ref) mean: by chunk_id, else by the number of a source."""
    number = F.row_number().over(W.partitionBy("question_id").orderBy("pos")).cast("string")
    known = sources.select("question_id", F.col("chunk_id").cast("string").alias("id"), number.alias("number"), document_key().alias("document_key"))
    asked = refs.select("question_id", F.trim("ref").alias("ref")).where("ref <> ''").distinct()
    by_id = asked.join(known.withColumnRenamed("id", "ref"), ["question_id", "ref"]).select("question_id", "ref", "document_key")
    rest = asked.join(by_id, ["question_id", "ref"], "left_anti").join(known.withColumnRenamed("number", "ref"), ["question_id", "ref"])
    return by_id.select("question_id", "document_key").union(rest.select("question_id", "document_key")).distinct()


def filter_documents(sources: DataFrame, kept: DataFrame, rejected: DataFrame) -> DataFrame:
    """R-21: sources (question_id, ...) with document_key, kept, rejected and decision, after documents (question_id,
    document_key) were kept and rejected.

    Where a question keeps a document, kept ones stay alone (decision kept); where it keeps none and rejects each of its
    documents nothing stays (rejected); else all stay and none is rejected (all). A document both kept and rejected is kept.
    """
    rows = sources.withColumn("document_key", document_key())
    flag = lambda df, name: df.select("question_id", "document_key").distinct().withColumn(name, F.lit(True))
    rows = rows.join(flag(kept, "_kept"), ["question_id", "document_key"], "left").join(flag(rejected, "_rejected"), ["question_id", "document_key"], "left")
    rows = rows.withColumn("_rejected", F.coalesce("_rejected", F.lit(False)) & F.col("_kept").isNull())
    by = rows.groupBy("question_id").agg(F.count("_kept").alias("_n"), F.bool_and("_rejected").alias("_none"))
    decision = F.when(F.col("_n") > 0, "kept").when(F.col("_none"), "rejected").otherwise("all")
    rows = rows.join(by.select("question_id", decision.alias("decision")), "question_id")
    stays = F.when(F.col("decision") == "kept", F.col("_kept").isNotNull()).otherwise(F.col("decision") == "all")
    return rows.withColumns({"kept": stays, "rejected": F.col("_rejected") & (F.col("decision") != "all")}).drop("_kept", "_rejected")


def judge_action(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """Q-10: questions with action, strategy and queries, by the first rule that holds.

    questions: question_id, question, rewritten, attempts, rejected (documents that the filter rejected), tried (queries), judged
    (whether a model judged), sufficient (its word), offered_strategy, offered (its queries); sources: question_id, text.
    Without sources: retry with keywords if some were rejected, else broader. A vague question: clarify. Under 8 characters of
    context: retry rewritten. Else the judgement: generate if sufficient or missing, retry if it offers queries that were not tried.
    A retry that two attempts rule out is evidence_limited_answer, with no strategy and no query.
    """
    size = sources.groupBy("question_id").agg(F.count("*").alias("_n"), F.sum(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""))).alias("_chars"))
    rows = questions.join(size, "question_id", "left")
    can, none = F.coalesce("attempts", F.lit(0)) < MOST_ATTEMPTS, F.array().cast("array<string>")
    empty, vague, short = F.col("_n").isNull(), Q.is_vague(F.col("question")), F.col("_chars") < LEAST_CHARS
    fallback = F.coalesce(F.nullif("rewritten", F.lit("")), "question")
    enough = ~F.coalesce("judged", F.lit(False)) | payloads.coerce_bool(F.col("sufficient"), True)
    rule = F.when(empty, F.when(F.col("rejected") > 0, "keyword").otherwise("broaden")).when(vague, "vague").when(short, "query_rewrite").when(enough, "enough").otherwise("model")
    tried = F.coalesce("tried", none)
    rows = rows.withColumns({"_rule": rule, "_can": can})
    built = Q.retry_queries(F.col("_rule"), fallback, F.col("question"), tried)
    offered = Q.exclude(payloads.normalize_queries(F.col("offered"), fallback), tried)
    own = F.col("_rule").isin("keyword", "broaden", "query_rewrite")
    queries = F.when(F.col("_can") & own, built).when(F.col("_can") & (F.col("_rule") == "model"), offered).otherwise(none)
    rows = rows.withColumn("queries", queries)
    limited = "evidence_limited_answer"
    action = (
        F.when(own, F.when(F.col("_can"), "retry").otherwise(limited)).when(F.col("_rule") == "vague", "clarify").when(F.col("_rule") == "enough", "generate")
        .otherwise(F.when(F.col("_can") & (F.size("queries") > 0), "retry").otherwise(limited))
    )
    strategy = F.when(~F.col("_can"), "none").when(own, F.col("_rule")).when(F.col("_rule") == "model", F.coalesce(F.nullif("offered_strategy", F.lit("")), F.lit("query_rewrite"))).otherwise("none")
    return rows.withColumns({"action": action, "strategy": strategy}).drop("_n", "_chars", "_rule", "_can")


def verification_action(supported: Column, n_sources: Column, attempts: Column, answer_retries: Column) -> Column:
    """Q-10: whether an answer is looked up once more: it isn't supported, there were sources, and neither limit is reached."""
    again = ~payloads.coerce_bool(supported, True) & (n_sources > 0) & (F.coalesce(attempts, F.lit(0)) < MOST_ATTEMPTS) & (F.coalesce(answer_retries, F.lit(0)) == 0)
    return F.when(again, "retry").otherwise("end")


def attempt_log(attempts: DataFrame) -> DataFrame:
    """Q-17: attempts (question_id, attempt, pos, ...): of each number the last, with place, its rank by pos in the question."""
    last = attempts.groupBy("question_id", "attempt").agg(F.max("pos").alias("pos"))
    kept = attempts.join(last, ["question_id", "attempt", "pos"], "left_semi")
    return kept.withColumn("place", F.row_number().over(W.partitionBy("question_id").orderBy("pos")))


def attempted_queries(attempts: DataFrame) -> DataFrame:
    """Q-17: (question_id, query, place): all filled queries of attempts (question_id, pos, queries), those replaced later too,
    each once, in the order in which they came."""
    each = attempts.select("question_id", "pos", F.posexplode("queries").alias("n", "query")).withColumn("query", F.trim("query")).where("query <> ''")
    first = each.groupBy("question_id", "query").agg(F.min(F.struct("pos", "n")).alias("first"))
    return first.withColumn("place", F.row_number().over(W.partitionBy("question_id").orderBy("first"))).drop("first")


def source_snippets(sources: DataFrame, most: int = SNIPPETS, chars: int = SNIPPET_CHARS) -> DataFrame:
    """R-19: (question_id, snippets) of the first sources (question_id, pos, chunk_id, source_name, text) of each question, cut."""
    first = sources.withColumn("n", F.row_number().over(W.partitionBy("question_id").orderBy("pos"))).where(F.col("n") <= most)
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] chunk_id="), F.col("chunk_id").cast("string"), F.lit(" source="), F.coalesce("source_name", F.lit("")), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, chars))
    listed = first.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))).alias("l"))
    return listed.select("question_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("snippets"))


def document_snippets(sources: DataFrame, most: int = DOCUMENT_SNIPPETS, chars: int = DOCUMENT_CHARS) -> DataFrame:
    """R-19: (question_id, document_key, number, snippet): a digest of each document, labelled D1 on in the order in which they are met,
    with its first chunks, cut."""
    rows = sources.withColumn("document_key", document_key())
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("question_id", "document_key").orderBy("pos"))).where(F.col("n") <= most)
    line = F.concat(F.lit("- chunk_id="), F.col("chunk_id").cast("string"), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, chars))
    listed = rows.groupBy("question_id", "document_key").agg(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))).alias("l"))
    both = numbered_documents(sources).join(listed, ["question_id", "document_key"])
    head = F.concat(F.lit("[D"), F.col("number").cast("string"), F.lit("] source_path="), "document_key", F.lit(" source_name="), F.coalesce("source_name", F.lit("")))
    return both.select("question_id", "document_key", "number", F.concat(head, F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("snippet"))


def selection_telemetry(candidates: DataFrame, selected: DataFrame, most: int = 8, ratio: float = 0.5) -> DataFrame:
    """R-15: (query_id, candidates, selected, dropped, strategy, score_cutoff, used_chars) of candidates (query_id, rank, n_chars,
    rerank_score) and those that select_context kept of them, with the same most and ratio."""
    capped = F.col("rank") <= most
    all_of = candidates.groupBy("query_id").agg(
        F.count("*").alias("candidates"), (F.count_if(capped) == F.count(F.when(capped, F.col("rerank_score")))).alias("_scored"), F.min_by("rerank_score", "rank").alias("_first")
    )
    some = selected.groupBy("query_id").agg(F.count("*").alias("selected"), F.sum("n_chars").alias("used_chars"))
    n = F.coalesce("selected", F.lit(0))
    return all_of.join(some, "query_id", "left").select(
        "query_id", "candidates", n.alias("selected"), (F.col("candidates") - n).alias("dropped"), F.when(F.col("_scored"), "rerank_ratio_and_char_budget").otherwise("char_budget").alias("strategy"),
        F.when(F.col("_scored"), F.col("_first") * ratio).alias("score_cutoff"), F.coalesce("used_chars", F.lit(0)).alias("used_chars"),
    )


def subqueries(plan: Column, fallback: Column, most: int = payloads.MOST_QUERIES) -> Column:
    """Q-15: the plan's parts as an array of (id, question, purpose), from a JSON object with `subqueries`, a list of objects or strings.

    Blank and repeated questions are left out; a part without an id is q with its place in the list. A plan without one gives
    its `queries`, or the fallback, numbered from q1.
    """
    item = lambda v, name: F.nullif(F.trim(F.try_variant_get(v, name, "string")), F.lit(""))
    parsed = F.try_parse_json(plan)
    listed = F.coalesce(F.try_variant_get(parsed, "$.subqueries", "array<variant>"), F.array().cast("array<variant>"))
    purpose = F.lit("retrieve evidence")

    def part(v: Column, i: Column) -> Column:
        kind, number = F.schema_of_variant(v), F.concat(F.lit("q"), (i + 1).cast("string"))
        of_object = F.struct(F.coalesce(item(v, "$.id"), number).alias("id"), item(v, "$.question").alias("question"), F.coalesce(item(v, "$.purpose"), purpose).alias("purpose"))
        of_text = F.struct(number.alias("id"), F.nullif(F.trim(F.try_variant_get(v, "$", "string")), F.lit("")).alias("question"), purpose.alias("purpose"))
        return F.when(kind.startswith("OBJECT"), of_object).when(kind == "STRING", of_text)

    filled = F.filter(F.transform(listed, part), lambda p: p["question"].isNotNull())
    once = let(filled, lambda ps: F.filter(ps, lambda p, i: F.array_position(F.transform(ps, lambda x: x["question"]), p["question"]) == i + 1))
    offered = F.try_variant_get(parsed, "$.queries", "array<string>")
    plain = F.transform(payloads.normalize_queries(offered, fallback, most), lambda q, i: F.struct(F.concat(F.lit("q"), (i + 1).cast("string")).alias("id"), q.alias("question"), purpose.alias("purpose")))
    return let(once, lambda found: F.when(F.size(found) > 0, F.slice(found, 1, most)).otherwise(plain))
