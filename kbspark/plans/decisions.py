"""Registered queries on labels for questions and on decisions about retrieved sources, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agentic, labelling, retrieval
from .more import _RANKED, _ranked
from .queries import _t, query

# Questions are the benchmark items, of which every tenth names no document; files hold every fortieth document, by name or path.
_QA = r"""qa AS (SELECT item_id AS question_id, substr(text, 1, 40) AS question, right(text, 60) AS answer, CASE WHEN item_id % 4 = 0 THEN substr(text, 20, 150) ELSE text END AS evidence,
  CASE WHEN item_id % 10 = 9 THEN 'none.md' ELSE 'file' || (item_id % 40) || '.md' END AS file, item_id % 9 AS pg FROM benchmark),
ck AS (SELECT doc_id AS chunk_id, 'file' || (doc_id % 40) || '.md' AS file, doc_id // 40 AS doc_ix, doc_id % 7 AS chunk_index, CASE WHEN doc_id % 2 = 0 THEN doc_id % 9 END AS pg, text FROM documents)"""
_SQUEEZE = r"regexp_replace(lower({0}), '\s+', '', 'g')"
_GRAMS3 = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)))"


def _recall(expected: str) -> str:
    grams = _GRAMS3.format(expected)
    return f"CASE WHEN {expected} = '' THEN 0 WHEN contains(t, {expected}) THEN 1 WHEN length({expected}) <= 3 THEN 0 ELSE len(list_filter({grams}, lambda g: contains(t, g))) / len({grams}) END"


_LABELS = rf"""WITH {_QA}, q AS (SELECT *, {_SQUEEZE.format('evidence')} AS e, {_SQUEEZE.format('answer')} AS a, {_SQUEEZE.format('question')} AS n,
 list_distinct(list_transform(regexp_extract_all(regexp_replace(question || ' ' || answer || ' ' || evidence, '[^\x00-\x7F]', '_', 'g'), '(?i)\b[A-Z]-\d{{3,}}\b|\b[A-Z]{{2,}}(?:/[A-Z]{{2,}})*\b|[\w.+-]+@[\w.-]+\.\w+'), lambda x: lower(x))) AS ids FROM qa),
 c AS (SELECT *, {_SQUEEZE.format('text')} AS t FROM ck),
 p AS (SELECT question_id, chunk_id, doc_ix, chunk_index, c.pg AS page, text, {_recall('e')} AS es, {_recall('a')} AS ans, {_recall('n')} AS ns, coalesce((c.pg = q.pg)::INT, 0) AS ps, (len(list_filter(ids, lambda x: contains(t, x))) > 0)::INT AS ids FROM q JOIN c USING (file)),
 s AS (SELECT *, 0.62 * es + 0.16 * ans + 0.04 * ns + 0.10 * ps + 0.08 * ids AS score FROM p),
 r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_ix, chunk_index, chunk_id) = 1)
 SELECT question_id, CASE WHEN chunk_id IS NULL THEN 'source_not_found' WHEN score >= 0.35 OR ids > 0 THEN 'matched' ELSE 'low_confidence' END AS status, round(coalesce(score, 0), 6) AS score, chunk_id, chunk_index, page,
 md5(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 180)) AS preview_md5, round(es, 6) AS evidence_score, round(ans, 6) AS answer_score FROM qa LEFT JOIN r USING (question_id)"""


def _labels(spark, sf_dir):
    i, text, n = F.col("item_id"), F.col("text"), F.col("doc_id")
    questions = _t(spark, sf_dir, "benchmark").select(
        i.alias("question_id"), F.substring("text", 1, 40).alias("question"), F.expr("right(text, 60)").alias("answer"), F.when(i % 4 == 0, F.substring("text", 20, 150)).otherwise(text).alias("evidence"),
        F.when(i % 2 == 0, F.when(i % 10 == 9, "none.md").otherwise(F.concat(F.lit("File"), (i % 40).cast("string"), F.lit(".MD")))).alias("source_document"),
        F.when(i % 10 == 9, "x\\none.md").otherwise(F.concat(F.lit("C:\\in\\ file"), (i % 40).cast("string"), F.lit(".md"))).alias("source_path"), F.concat((i % 9).cast("string"), F.lit(" p")).alias("source_chunk"),
    )
    file = F.concat(F.lit("file"), (n % 40).cast("string"), F.lit(".md"))
    chunks = _t(spark, sf_dir, "documents").select(
        n.alias("chunk_id"), F.floor(n / 40).alias("doc_ix"), (n % 7).alias("chunk_index"), F.when(n % 3 == 0, file).otherwise("other").alias("source_name"), F.concat(F.lit("/data/"), file).alias("source_path"),
        F.when(n % 2 == 0, n % 9).alias("page"), "text",
    )
    return labelling.label_questions(questions, chunks)


@query(_LABELS)
def label_questions(spark, sf_dir):
    """Each question against all chunks of its file."""
    rounded = [F.round(c, 6).alias(c) for c in ("score", "evidence_score", "answer_score")]
    return _labels(spark, sf_dir).select("question_id", "status", "chunk_id", "chunk_index", "page", F.md5(F.col("preview").cast("binary")).alias("preview_md5"), *rounded)


@query(f"SELECT status, count(*) AS questions FROM ({_LABELS}) GROUP BY 1")
def label_statuses(spark, sf_dir):
    return labelling.label_statuses(_labels(spark, sf_dir))


# Sources: the events of a user by value; signups have no path, clicks and views share a name.
_SOURCES = f"""{_RANKED}, src AS (SELECT query_id AS question_id, chunk_id, rank AS pos, CASE event_type WHEN 'signup' THEN '' ELSE 'p/' || event_type END AS path, CASE WHEN event_type IN ('click', 'view') THEN 'Shared' ELSE event_type END AS name FROM hits),
sk AS (SELECT *, CASE WHEN path <> '' THEN path ELSE name END AS document_key FROM src)"""


def _sources(spark, sf_dir):
    kind = F.col("event_type")
    path = F.when(kind == "signup", "").otherwise(F.concat(F.lit("p/"), kind))
    return _ranked(spark, sf_dir).select(F.col("query_id").alias("question_id"), "chunk_id", F.col("rank").alias("pos"), path.alias("source_path"), F.when(kind.isin("click", "view"), "Shared").otherwise(kind).alias("source_name"))


@query(f"""WITH {_SOURCES}, d AS (SELECT question_id, document_key, arg_min(name, pos) AS name, row_number() OVER (PARTITION BY question_id ORDER BY min(pos)) AS i FROM sk GROUP BY 1, 2),
 a AS (SELECT question_id, document_key, i * 10 + 1 AS o, document_key AS a FROM d UNION ALL SELECT question_id, document_key, i * 10 + 2, name FROM d UNION ALL SELECT question_id, document_key, i * 10 + 3, i::VARCHAR FROM d UNION ALL SELECT question_id, document_key, i * 10 + 4, 'D' || i FROM d),
 w AS (SELECT question_id, lower(a) AS a, arg_max(document_key, o) AS document_key FROM a GROUP BY 1, 2),
 r AS (SELECT DISTINCT question_id, unnest([1, 2, 3, 4, 5, 6]) AS pos, unnest(['d' || (question_id % 3 + 1), ' SHARED ', '2', 'P/Error', 'nope', 'D1']) AS ref FROM src)
 SELECT question_id, document_key, row_number() OVER (PARTITION BY question_id ORDER BY min(pos)) AS place FROM r JOIN w USING (question_id) WHERE lower(trim(ref)) = a GROUP BY 1, 2""")
def resolve_document_refs(spark, sf_dir):
    sources = _sources(spark, sf_dir)
    said = F.array(F.concat(F.lit("d"), (F.col("question_id") % 3 + 1).cast("string")), F.lit(" SHARED "), F.lit("2"), F.lit("P/Error"), F.lit("nope"), F.lit("D1"))
    refs = sources.select("question_id").distinct().select("question_id", F.posexplode(said).alias("pos", "ref"))
    return agentic.resolve_document_refs(refs, sources).select("question_id", "document_key", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_SOURCES}, k AS (SELECT *, question_id % 4 = 0 AND document_key = 'p/click' OR question_id % 4 = 1 AND document_key IN ('p/view', 'p/error') AND chunk_id % 2 = 0 AS keep,
  CASE question_id % 4 WHEN 0 THEN document_key IN ('p/click', 'signup') WHEN 1 THEN false WHEN 2 THEN true ELSE document_key = 'p/view' END AS drop FROM sk),
 d AS (SELECT question_id, document_key, bool_or(keep) AS keep, bool_or(drop) AND NOT bool_or(keep) AS drop FROM k GROUP BY 1, 2),
 q AS (SELECT question_id, CASE WHEN bool_or(keep) THEN 'kept' WHEN bool_and(drop) THEN 'rejected' ELSE 'all' END AS decision FROM d GROUP BY 1)
 SELECT question_id, chunk_id, decision, CASE decision WHEN 'kept' THEN d.keep ELSE decision = 'all' END AS kept, d.drop AND decision <> 'all' AS rejected FROM sk JOIN d USING (question_id, document_key) JOIN q USING (question_id)""")
def filter_documents(spark, sf_dir):
    """Some questions keep documents by name, some by chunks, some reject all, and some one of several."""
    sources, kind = _sources(spark, sf_dir), F.col("question_id") % 4
    named = sources.withColumn("document_key", agentic.document_key())
    refs = named.where((kind == 1) & F.col("document_key").isin("p/view", "p/error") & (F.col("chunk_id") % 2 == 0)).select("question_id", F.concat(F.lit(" "), F.col("chunk_id").cast("string")).alias("ref"))
    kept = named.where((kind == 0) & (F.col("document_key") == "p/click")).select("question_id", "document_key").union(agentic.resolve_chunk_refs(refs, sources))
    rejected = named.where((kind == 0) & F.col("document_key").isin("p/click", "signup") | (kind == 2) | (kind == 3) & (F.col("document_key") == "p/view")).select("question_id", "document_key")
    return agentic.filter_documents(sources, kept, rejected).select("question_id", "chunk_id", "decision", "kept", "rejected")


@query("""WITH u AS (SELECT user_id AS id, count(*) FILTER (event_id % 3 = 0 AND user_id % 5 <> 0) AS n FROM events GROUP BY 1),
 r AS (SELECT *, id % 3 < 2 AS can, CASE WHEN n = 0 THEN CASE WHEN id % 2 = 1 THEN 'keyword' ELSE 'broaden' END WHEN id % 4 = 0 THEN 'vague' WHEN id % 5 = 1 AND 2 * n < 8 THEN 'query_rewrite' WHEN id % 7 = 0 OR id % 11 < 4 THEN 'enough' ELSE 'model' END AS rule FROM u)
 SELECT id AS question_id, CASE WHEN rule IN ('keyword', 'broaden', 'query_rewrite') THEN CASE WHEN can THEN 'retry' ELSE 'evidence_limited_answer' END WHEN rule = 'vague' THEN 'clarify' WHEN rule = 'enough' THEN 'generate'
   WHEN can AND id % 2 = 0 THEN 'retry' ELSE 'evidence_limited_answer' END AS action,
  CASE WHEN NOT can THEN 'none' WHEN rule IN ('keyword', 'broaden', 'query_rewrite') THEN rule WHEN rule = 'model' THEN CASE WHEN id % 3 = 0 THEN 'narrow' ELSE 'query_rewrite' END ELSE 'none' END AS strategy,
  CASE WHEN rule = 'model' AND can THEN CASE WHEN id % 2 = 0 THEN 'next ' || id ELSE '' END END AS offered,
  CASE WHEN id % 11 >= 4 AND n > 0 AND can AND id % 13 <> 0 THEN 'retry' ELSE 'end' END AS after_answer FROM r""")
def judge_action(spark, sf_dir):
    """Users are questions, every third event of theirs is a source of two characters and more; one user in five has none."""
    e, i = _t(spark, sf_dir, "events"), F.col("question_id")
    sources = e.where("event_id % 3 = 0 AND user_id % 5 <> 0").select(F.col("user_id").alias("question_id"), F.when(F.col("user_id") % 5 == 1, " ab\n").otherwise(F.concat("props", F.lit(" and more"))).alias("text"))
    word = F.when(i % 11 < 4, F.when(i % 2 == 0, " YES ").otherwise("maybe")).otherwise(F.when(i % 2 == 0, "no").otherwise("0"))
    n = sources.groupBy("question_id").agg(F.count("*").alias("n_sources"))
    questions = e.select(F.col("user_id").alias("question_id")).distinct().join(n, "question_id", "left").withColumns(
        {
            "question": F.when(i % 4 == 0, "怎么处理").otherwise(F.concat(F.lit("how does order work "), i.cast("string"))), "rewritten": F.lit(""), "attempts": i % 3, "rejected": i % 2, "judged": i % 7 != 0, "sufficient": word,
            "offered_strategy": F.when(i % 3 == 0, "narrow").otherwise(""), "offered": F.array(F.lit(" tried "), F.when(i % 2 == 0, F.concat(F.lit("next "), i.cast("string"))).otherwise("")), "tried": F.array(F.lit("Tried")),
        }
    )
    judged = agentic.judge_action(questions, sources)
    model = (F.col("n_sources").isNotNull()) & (i % 4 != 0) & ~((i % 5 == 1) & (2 * F.col("n_sources") < 8)) & (i % 7 != 0) & (i % 11 >= 4) & (F.col("attempts") < 2)
    after = agentic.verification_action(F.col("sufficient"), F.coalesce("n_sources", F.lit(0)), F.col("attempts"), (i % 13 == 0).cast("int"))
    return judged.select("question_id", "action", "strategy", F.when(model, F.array_join("queries", ",")).alias("offered"), after.alias("after_answer"))


@query("""WITH l AS (SELECT user_id, event_type, max(event_id) AS pos FROM events GROUP BY 1, 2) SELECT user_id AS question_id, event_type AS attempt, pos, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS place FROM l""")
def attempt_log(spark, sf_dir):
    attempts = _t(spark, sf_dir, "events").select(F.col("user_id").alias("question_id"), F.col("event_type").alias("attempt"), F.col("event_id").alias("pos"))
    return agentic.attempt_log(attempts).select("question_id", "attempt", "pos", F.col("place").cast("long").alias("place"))


@query("""WITH e AS (SELECT user_id, event_id * 10 + 1 AS pos, event_type AS q FROM events UNION ALL SELECT user_id, event_id * 10 + 2, props FROM events WHERE event_id % 4 <> 0)
 SELECT user_id AS question_id, q AS query, row_number() OVER (PARTITION BY user_id ORDER BY min(pos)) AS place FROM e GROUP BY 1, 2""")
def attempted_queries(spark, sf_dir):
    asked = F.array(F.lit(" "), F.concat(F.lit(" "), "event_type"), F.when(F.col("event_id") % 4 != 0, F.col("props")), F.col("event_type"))
    attempts = _t(spark, sf_dir, "events").select(F.col("user_id").alias("question_id"), F.col("event_id").alias("pos"), asked.alias("queries"))
    return agentic.attempted_queries(attempts).select("question_id", "query", F.col("place").cast("long").alias("place"))


def _read(spark, sf_dir):
    n = F.col("doc_id")
    return _t(spark, sf_dir, "documents").select(F.col("source").alias("question_id"), n.alias("pos"), n.alias("chunk_id"), F.concat(F.lit("doc/"), F.floor(n / 90).cast("string")).alias("source_path"), F.col("lang").alias("source_name"), "text")


@query("""WITH r AS (SELECT source, doc_id, lang, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
 SELECT source AS question_id, md5(string_agg('[' || n || '] chunk_id=' || doc_id || ' source=' || coalesce(lang, '') || ': ' || substr(text, 1, 600), chr(10) || chr(10) ORDER BY n)) AS snippets_md5 FROM r WHERE n <= 4 GROUP BY 1""")
def source_snippets(spark, sf_dir):
    return agentic.source_snippets(_read(spark, sf_dir)).select("question_id", F.md5(F.col("snippets").cast("binary")).alias("snippets_md5"))


@query("""WITH r AS (SELECT source, 'doc/' || (doc_id // 90) AS k, doc_id, lang, text, row_number() OVER (PARTITION BY source, doc_id // 90 ORDER BY doc_id) AS n FROM documents),
 d AS (SELECT source, k, arg_min(lang, doc_id) AS name, row_number() OVER (PARTITION BY source ORDER BY min(doc_id)) AS number FROM r GROUP BY 1, 2),
 l AS (SELECT source, k, string_agg('- chunk_id=' || doc_id || ': ' || substr(text, 1, 400), chr(10) ORDER BY n) AS lines FROM r WHERE n <= 4 GROUP BY 1, 2)
 SELECT source AS question_id, k AS document_key, number, md5('[D' || number || '] source_path=' || k || ' source_name=' || coalesce(name, '') || chr(10) || lines) AS snippet_md5 FROM d JOIN l USING (source, k)""")
def document_snippets(spark, sf_dir):
    made = agentic.document_snippets(_read(spark, sf_dir))
    return made.select("question_id", "document_key", F.col("number").cast("long").alias("number"), F.md5(F.col("snippet").cast("binary")).alias("snippet_md5"))


@query(f"""WITH {_RANKED}, c AS (SELECT query_id, rank, 300 + chunk_id % 1500 AS n_chars, CASE WHEN query_id % 3 > 0 AND NOT (query_id % 3 = 1 AND rank = 9) AND NOT (query_id % 5 = 0 AND rank = 4) THEN value END AS s FROM hits WHERE rank <= 12),
 k AS (SELECT *, count(s) OVER w = count(*) OVER w AS scored, arg_min(s, rank) OVER w AS top, sum(n_chars) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM c WHERE rank <= 8 WINDOW w AS (PARTITION BY query_id)),
 f AS (SELECT *, min(CASE WHEN rank > 2 AND (upto > 7200 OR scored AND s < top * 0.5) THEN rank END) OVER (PARTITION BY query_id) AS stop FROM k),
 g AS (SELECT query_id, count(*) FILTER (stop IS NULL OR rank < stop) AS selected, (sum(n_chars) FILTER (stop IS NULL OR rank < stop))::BIGINT AS used_chars, bool_and(scored) AS scored, any_value(top) AS top FROM f GROUP BY 1)
 SELECT query_id, n AS candidates, selected, n - selected AS dropped, CASE WHEN scored THEN 'rerank_ratio_and_char_budget' ELSE 'char_budget' END AS strategy, CASE WHEN scored THEN top * 0.5 END AS score_cutoff, used_chars
 FROM g JOIN (SELECT query_id, count(*) AS n FROM c GROUP BY 1) USING (query_id)""")
def selection_telemetry(spark, sf_dir):
    """Context selection with scores: all of a question's, all but one, or none."""
    q, rank = F.col("query_id"), F.col("rank")
    score = F.when((q % 3 > 0) & ~((q % 3 == 1) & (rank == 9)) & ~((q % 5 == 0) & (rank == 4)), F.col("value"))
    rows = _ranked(spark, sf_dir).where("rank <= 12").select("query_id", "rank", (300 + F.col("chunk_id") % 1500).alias("n_chars"), score.alias("rerank_score"))
    return agentic.selection_telemetry(rows, retrieval.select_context(rows))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'x=first ' || event_id || '=why|q2=second=retrieve evidence|q5=q' || event_id || '=retrieve evidence'
  WHEN 1 THEN 'q1=b ' || event_id || '=retrieve evidence|q2=c=retrieve evidence' ELSE 'q1=all of ' || event_id || '=retrieve evidence' END AS parts FROM events""")
def subqueries(spark, sf_dir):
    k = F.col("event_id").cast("string")
    plan = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"subqueries": [{"id": "x", "question": " first '), k, F.lit(' ", "purpose": "why"}, " second", {"question": "second"}, {"id": "e", "question": " "}, {"id": "", "question": "q'), k, F.lit('"}, 5, "fourth"]}')))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit('{"subqueries": [" ", 7], "queries": ["b '), k, F.lit('", " b '), k, F.lit('", "", "c"]}'))).when(F.col("event_id") % 5 == 2, '{"subqueries": "none"}').when(F.col("event_id") % 5 == 3, "no plan")
    )
    made = agentic.subqueries(plan, F.concat(F.lit("all of "), k))
    return _t(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(made, lambda p: F.concat_ws("=", p["id"], p["question"], p["purpose"])), "|").alias("parts"))
