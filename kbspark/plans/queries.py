"""Registered queries of the core library over the given tables, each with the SQL that defines its result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import questions as Q
from ..functions import text as T
from ..operators import bm25_table, conversation, corpus, evaluation, memory, retrieval
from ..streaming import history

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), chr(10)),
 '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS clean_md5 FROM documents""")
def clean_whitespace(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_whitespace(F.col("text")).cast("binary")).alias("clean_md5"))


_LINES = r"""l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM
 (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(trim(x), '[.!?:;]+$', '')) AS ls FROM documents))"""


@query(f"""WITH {_LINES}, c AS (SELECT *, trim(line) AS t, trim(line) <> '' AND length(trim(line)) <= 80 AND NOT regexp_matches(trim(line), '[.!?:;]$')
 AND NOT starts_with(trim(line), '#') AND NOT contains(line, '|') AS cand FROM l),
 r AS (SELECT doc_id, t FROM c WHERE cand GROUP BY 1, 2 HAVING count(*) > 1)
 SELECT c.doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM c LEFT JOIN r ON c.cand AND c.doc_id = r.doc_id AND c.t = r.t WHERE r.t IS NULL GROUP BY 1""")
def drop_margin_lines(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.transform(F.split("text", "\n", -1), lambda x: F.regexp_replace(F.trim(x), "[.!?:;]+$", ""))).alias("pos", "line"))
    return corpus.drop_recurring_margin_lines(lines).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))


@query(r"""WITH d AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'Contents' || chr(10) || 'Part one .... 3' || chr(10) || text WHEN 1 THEN '## ' || replace(text, chr(10), ' ')
   WHEN 2 THEN replace(text, 'e', chr(65533)) WHEN 3 THEN '1.2 Part two ..... 12' || chr(10) || text ELSE text END AS t FROM documents),
 l AS (SELECT *, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM d),
 f AS (SELECT *, list_transform(lines, lambda x: regexp_matches(x, '(?i)^(#{1,6}\s*)?(page\s*\d+(\s*(of|/)\s*\d+)?|第\s*\d+\s*页)$') OR regexp_matches(x, '^(\d+(\.\d+)*\s+)?[^\n]{1,100}?\s*(\.{2,}|…+)\s*\d+\s*$')) AS toc,
  list_transform(lines, lambda x: regexp_matches(x, '(?i)^((table\s+of\s+)?contents|目\s*录)$')) AS head FROM l)
 SELECT doc_id, CASE WHEN len(lines) > 0 AND (list_bool_and(toc) OR (list_bool_or(head) AND list_bool_or(toc))) THEN 'table_of_contents' WHEN len(lines) = 1 AND regexp_matches(lines[1], '^#{1,6}\s+.+$') THEN 'title_only'
  WHEN length(regexp_replace(t, '\s', '', 'g')) > 0 AND (length(t) - length(replace(t, chr(65533), ''))) / length(regexp_replace(t, '\s', '', 'g')) > 0.20 THEN 'garbled' END AS reason FROM f""")
def chunk_rejection(spark, sf_dir):
    """Whole texts, with contents lines put before some, some in one line with a heading's mark, some garbled."""
    flat, kind = F.replace("text", F.lit("\n"), F.lit(" ")), F.col("doc_id") % 7
    made = (
        F.when(kind == 0, F.concat(F.lit("Contents\nPart one .... 3\n"), "text")).when(kind == 1, F.concat(F.lit("## "), flat))
        .when(kind == 2, F.replace("text", F.lit("e"), F.lit("�"))).when(kind == 3, F.concat(F.lit("1.2 Part two ..... 12\n"), "text")).otherwise(F.col("text"))
    )
    return _t(spark, sf_dir, "documents").select("doc_id", T.rejection_reason(made, F.lit("text")).alias("reason"))


@query(r"""SELECT min(doc_id) AS doc_id, lang, count(*) AS copies FROM documents
 GROUP BY lang, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))""")
def dedup_exact(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    kept = corpus.dedup_exact(docs, "lang", "doc_id")
    sizes = docs.groupBy("lang", F.sha2(T.normalize_for_dedup(F.col("text")), 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    return kept.select("doc_id", "lang").join(sizes, ["doc_id", "lang"]).select("doc_id", "lang", "copies")


@query(r"""SELECT doc_id, sha256(text) AS chunk_hash, substr(sha1('default:' || sha256(text)), 1, 24) AS document_key,
 substr(sha1('doc/' || doc_id || '|None|' || doc_id || '|0|' || substr(text, 1, 160)), 1, 20) AS chunk_id,
 len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INT AS tokens FROM documents""")
def chunk_identity(spark, sf_dir):
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    return _t(spark, sf_dir, "documents").select(
        "doc_id", F.sha2("text", 256).alias("chunk_hash"), T.document_key(F.lit("default"), F.sha2("text", 256)).alias("document_key"),
        T.chunk_id(path, F.lit(None), F.col("doc_id").cast("string"), F.lit("0"), F.col("text")).alias("chunk_id"), T.token_count(F.col("text")).alias("tokens"),
    )


_OLD = "CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'doc/' || doc_id END"
_SNAP = f"""o AS (SELECT {_OLD} AS k, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 11 <> 0),
n AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'new/' || doc_id ELSE 'doc/' || doc_id END AS k, sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0),
b AS (SELECT coalesce(o.k, n.k) AS source_key, o.h AS old_hash, n.h AS new_hash, CASE WHEN o.h = n.h THEN 'skipped' WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' ELSE 'updated' END AS s FROM o FULL JOIN n ON o.k = n.k),
a AS (SELECT source_key, new_hash AS h, row_number() OVER (PARTITION BY new_hash ORDER BY source_key) AS rn FROM b WHERE s = 'added'),
g AS (SELECT source_key, old_hash AS h, row_number() OVER (PARTITION BY old_hash ORDER BY source_key) AS rn FROM b WHERE s = 'deleted'),
m AS (SELECT a.source_key AS ak, g.source_key AS gk FROM a JOIN g USING (h, rn)),
f AS (SELECT source_key, old_hash, new_hash, CASE WHEN source_key IN (SELECT ak FROM m) THEN 'moved' WHEN source_key IN (SELECT gk FROM m) THEN 'moved_away' ELSE s END AS status FROM b)"""


def _snapshots(spark, sf_dir):
    docs, key = _t(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    old = docs.where("doc_id % 5 <> 0").select(F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.concat(F.lit("doc/"), key)).alias("source_key"), F.sha2("text", 256).alias("file_hash"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    name = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("new/"), key)).otherwise(F.concat(F.lit("doc/"), key))
    new = docs.select(F.when(F.col("doc_id") % 11 == 0, "").otherwise(name).alias("source_key"), F.sha2(text, 256).alias("file_hash"))
    return old, new


@query(f"WITH {_SNAP} SELECT * FROM f")
def diff_snapshot(spark, sf_dir):
    return corpus.diff_snapshot(*_snapshots(spark, sf_dir))


@query(f"""WITH {_SNAP}, c AS (SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'skipped') AS skipped,
 count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status = 'moved') AS moved FROM f) SELECT *, added + updated + deleted + moved AS changed FROM c""")
def change_counts(spark, sf_dir):
    return corpus.change_counts(corpus.diff_snapshot(*_snapshots(spark, sf_dir)))


@query("""WITH e AS (SELECT sha256(text) AS h FROM documents WHERE doc_id % 4 = 0), i AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 4 <> 0)
 SELECT min(doc_id) AS doc_id, h AS file_hash FROM i WHERE h NOT IN (SELECT h FROM e) GROUP BY h""")
def append_uploads(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    return corpus.append_uploads(docs.where("doc_id % 4 = 0"), docs.where("doc_id % 4 <> 0"), "doc_id").select("doc_id", "file_hash")


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NOT NULL THEN b.quality ELSE a.quality END AS quality, coalesce(b.toxic, a.toxic) AS toxic
 FROM (SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 3 <> 0) a FULL JOIN
 (SELECT doc_id, 1 - quality AS quality, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE toxic END AS toxic FROM labels WHERE doc_id % 2 = 0 OR doc_id % 3 = 0) b ON a.doc_id = b.doc_id""")
def upsert_labels(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    new = labels.where("doc_id % 2 = 0 OR doc_id % 3 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"), F.when(F.col("doc_id") % 2 != 0, F.col("toxic")).alias("toxic"))
    return corpus.upsert(labels.where("doc_id % 3 <> 0"), new, ["doc_id"], ("toxic",))


@query("""WITH m AS (SELECT max(ts) AS t FROM events), j AS (SELECT event_id, event_type, ts, event_type IN ('click', 'view') AND ts < m.t - INTERVAL 1800 SECOND AS stale FROM events, m)
 SELECT event_id, CASE WHEN stale THEN 'failed' ELSE event_type END AS status, stale::INT AS retry_count FROM j""")
def expire_stale_jobs(spark, sf_dir):
    jobs = _t(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("updated_at"), F.col("event_type").isin("click", "view").alias("active"), F.lit(0).alias("retry_count"), F.lit(None).cast("timestamp").alias("finished_at")
    )
    return corpus.expire_stale_jobs(jobs, jobs.agg(F.max("updated_at")).first()[0]).select("event_id", "status", "retry_count")


@query("SELECT source, min(doc_id) AS first_id, count(*) AS n_chunks FROM documents GROUP BY source")
def document_listing(spark, sf_dir):
    chunks = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("chunk_id"), F.lit("").alias("source_path"), F.col("source").alias("source_name"), F.col("doc_id").cast("string").alias("file_type"), F.lit("").alias("scenario"))
    return corpus.document_listing(chunks).select(F.col("key").alias("source"), F.col("file_type").cast("long").alias("first_id"), F.col("chunk_count").alias("n_chunks"))


_TERMS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_BM25 = f"""q AS (SELECT item_id AS query_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
c AS (SELECT doc_id AS chunk_id, {_TERMS} AS ts FROM documents), s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM c),
p AS (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM c), tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS bm25_score FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id) AS bm25_rank FROM sc QUALIFY bm25_rank <= 20)"""


def _asked(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


@query(f"WITH {_BM25} SELECT query_id, chunk_id, bm25_rank FROM b")
def bm25_topk(spark, sf_dir):
    return retrieval.bm25_topk(*_asked(spark, sf_dir)).select("query_id", "chunk_id", "bm25_rank")


@query(f"WITH {_BM25} SELECT query_id, chunk_id, bm25_rank FROM b")
def bm25_topk_indexed(spark, sf_dir):
    """The same from an index that is written in two batches."""
    queries, chunks = _asked(spark, sf_dir)
    path = f"{history._shared(spark)}/bm25-{uuid.uuid4().hex}"
    bm25_table.append_index(chunks.where("chunk_id % 3 <> 0"), path, 0, 32)
    bm25_table.append_index(chunks, path, 1, 32)
    return bm25_table.bm25_topk_indexed(queries, path, buckets=32).select("query_id", "chunk_id", "bm25_rank")


def _embed(src: str, key: str, name: str) -> str:
    return rf"""{name}t AS (SELECT {key} AS k, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS t FROM {src}),
{name}d AS (SELECT k, count(*) AS n, sha256(t) AS d FROM {name}t GROUP BY k, t),
{name}s AS (SELECT k, (('0x' || substr(d, 1, 8))::BIGINT % 128)::INT AS ix, sum(CASE WHEN ('0x' || substr(d, 9, 2))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END * n)::DOUBLE AS v FROM {name}d GROUP BY 1, 2 HAVING v <> 0),
{name} AS (SELECT k, ix, v / sqrt(sum(v * v) OVER (PARTITION BY k)) AS value FROM {name}s)"""


@query(f"WITH {_embed('documents', 'doc_id', 'e')} SELECT k AS chunk_id, ix, round(value, 9) AS value FROM e")
def hash_embed(spark, sf_dir):
    return retrieval.hash_embed(_asked(spark, sf_dir)[1], "chunk_id").select("chunk_id", "ix", F.round("value", 9).alias("value"))


_HYBRID = f"""{_BM25}, {_embed('benchmark', 'item_id', 'qe')}, {_embed('documents', 'doc_id', 'ce')},
dd AS (SELECT qe.k AS query_id, ce.k AS chunk_id, round(sum(qe.value * ce.value), 6) AS dense_score FROM qe JOIN ce USING (ix) GROUP BY 1, 2),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id) AS dense_rank FROM dd QUALIFY dense_rank <= 20),
u AS (SELECT query_id, chunk_id, dense_rank AS rank FROM dr UNION ALL SELECT query_id, chunk_id, bm25_rank FROM b),
h AS (SELECT query_id, chunk_id, round(sum(1 / (60.0 + rank)), 9) AS rrf_score FROM u GROUP BY 1, 2),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rrf_rank FROM h QUALIFY rrf_rank <= 8)"""


@query(f"""WITH {_HYBRID} SELECT query_id, chunk_id, rrf_rank, dense_rank, bm25_rank FROM hr LEFT JOIN dr USING (query_id, chunk_id) LEFT JOIN b USING (query_id, chunk_id)""")
def hybrid_search(spark, sf_dir):
    return retrieval.hybrid_search(*_asked(spark, sf_dir)).select("query_id", "chunk_id", "rrf_rank", "dense_rank", "bm25_rank")


@query("""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e FROM n WHERE vec_id % 100 = 0),
 s AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(q.e, n.e), 9) AS s FROM q, n)
 SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS dense_rank FROM s QUALIFY dense_rank <= 20""")
def dense_topk(spark, sf_dir):
    vectors = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    queries = vectors.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    return retrieval.dense_topk(queries, vectors).select("query_id", "chunk_id", "dense_rank")


_METRICS = f"""{_HYBRID}, x AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)),
xs AS (SELECT query_id, count(*) AS ne FROM x GROUP BY 1), xf AS (SELECT query_id, min(rrf_rank) AS first_rank, count(*) FILTER (rrf_rank <= 5) AS n FROM hr JOIN x USING (query_id, chunk_id) GROUP BY 1),
mm AS (SELECT query_id, first_rank, coalesce(n, 0) > 0 AS hit, coalesce(n, 0) / 5 AS precision, coalesce(n, 0) / ne AS recall, coalesce(1 / first_rank, 0) AS reciprocal_rank FROM xs LEFT JOIN xf USING (query_id))"""


def _metrics(spark, sf_dir):
    queries, chunks = _asked(spark, sf_dir)
    hits = retrieval.hybrid_search(queries, chunks).select("query_id", "chunk_id", F.col("rrf_rank").alias("rank"))
    return evaluation.per_question_metrics(hits, evaluation.containing(queries, chunks))


@query(f"WITH {_METRICS} SELECT * FROM mm")
def question_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


def _mean(c: str) -> str:
    """Mean at four decimals, rounded half up, from whole numbers of billionths."""
    return f"((2 * sum(round({c} * 1000000000)::HUGEINT) * 10000 + count(*) * 1000000000::HUGEINT) // (2 * count(*) * 1000000000::HUGEINT))::DOUBLE / 10000"


@query(f"""WITH {_METRICS} SELECT count(*) AS questions, {_mean('hit::INT')} AS hit_rate, {_mean('precision')} AS mean_precision, {_mean('recall')} AS mean_recall,
 {_mean('reciprocal_rank')} AS mrr, count(*) FILTER (first_rank IS NULL) AS miss_count FROM mm""")
def retrieval_summary(spark, sf_dir):
    return evaluation.summary(_metrics(spark, sf_dir))


@query("""SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    return evaluation.percentile_nearest_rank(_t(spark, sf_dir, "events"), ["event_type"], "value")


@query("""WITH s AS (SELECT doc_id AS query_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, source FROM documents),
 c AS (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY rank) AS upto FROM s WHERE rank <= 8),
 f AS (SELECT *, min(CASE WHEN rank > 2 AND upto > 7200 THEN rank END) OVER (PARTITION BY source) AS first FROM c) SELECT source, rank, n_chars FROM f WHERE first IS NULL OR rank < first""")
def select_context(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = _t(spark, sf_dir, "documents").select(
        F.col("source").alias("query_id"), "n_chars", F.row_number().over(W.partitionBy("source").orderBy("doc_id")).alias("rank"), F.lit(None).cast("double").alias("rerank_score")
    )
    return retrieval.select_context(rows).select(F.col("query_id").alias("source"), "rank", "n_chars")


@query(r"""WITH u AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS norm FROM conversations WHERE role = 'user')
 SELECT a.conv_id, a.turn, max(b.turn) AS prior_turn FROM u a LEFT JOIN u b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.norm <> a.norm GROUP BY 1, 2""")
def prior_turn(spark, sf_dir):
    return conversation.latest_prior_user(_t(spark, sf_dir, "conversations"))


@query("SELECT conv_id, count(*) AS revision, max(turn) AS last_turn FROM conversations GROUP BY 1")
def conversation_revisions(spark, sf_dir):
    return conversation.revisions(_t(spark, sf_dir, "conversations"))


@query("""WITH o AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'system' GROUP BY 1), n AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'assistant')
 SELECT n.conv_id AS session_id, coalesce(o.last, 0) + rn AS version, text AS summary FROM n LEFT JOIN o ON n.conv_id = o.conv_id""")
def summary_versions(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations")
    old = turns.where("role = 'system'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("version"))
    new = turns.where("role = 'assistant'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("text").alias("summary"))
    return conversation.next_versions(old, new)


_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substr({0}, i, 3)))"


@query(f"""WITH w AS (SELECT item_id, len(g) AS n, unnest(g) AS gram FROM (SELECT item_id, {_GRAMS.format('text')} AS g FROM benchmark)), h AS (SELECT doc_id, unnest({_GRAMS.format('text')}) AS gram FROM documents)
 SELECT item_id, doc_id, round(count(*) / any_value(n), 9) AS recall FROM h JOIN w USING (gram) GROUP BY 1, 2 HAVING count(*) / any_value(n) >= 0.35""")
def trigram_recall(spark, sf_dir):
    """All benchmark items against all documents, from the recall on that labelling takes for a match."""
    items = _t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("expected"))
    found = evaluation.ngram_candidates(items, _t(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("item_id", "doc_id", F.round("recall", 9).alias("recall"))


# What the questions' SQL looks for, spelled out here so that a fault in the operators' own lists shows.
_ANSWER_REFERENCE = r"(?i)\b(?:first|second|third|previous|former|latter)\s+(?:step|option|approach|plan)\b"
_FOLLOW_UP = r"(?i)^(?:and\s+then|then|what\s+about|how\s+about|continue|tell\s+me\s+more)\b"
_COMPARISON = r"(?i)(?:区别|对比|比较|优缺点|\bvs\.?\b|\bversus\b|\bcompare\b)"
_MULTI_CONSTRAINT = r"(?i)(?:在.*情况下|当.*时|同时|分别|以及|并且|\bwhen\b.*\b(?:and|or)\b|\bwith\b.*\b(?:and|or)\b)"
_DIAGNOSTIC_ORDER = r"(?i)(?:排查.*(?:顺序|步骤)|先.*再|\b(?:diagnos|troubleshoot|investigat)\w*\b.*\b(?:order|step)\b)"
_STOP_WORDS = ("what", "when", "where", "which", "how", "does", "the", "and", "for")
_WEAK_TERMS = ("exact", "specific", "detailed", "current", "first step", "具体", "详细", "当前", "第一步", "这个", "那个")

_ASKED = r"""m AS (SELECT conv_id, turn, role, trim(regexp_replace(CASE WHEN role <> 'user' THEN '' WHEN (conv_id + turn) % 4 = 0 THEN 'Then ' WHEN (conv_id + turn) % 4 = 1 THEN 'What about '
  WHEN (conv_id + turn) % 4 = 2 THEN 'the second option ' WHEN conv_id % 3 = 0 THEN 'compare ' ELSE '' END || text, '\s+', ' ', 'g')) AS norm FROM conversations),
u AS (SELECT conv_id, turn, norm FROM m WHERE role = 'user'), w AS (SELECT a.conv_id, a.turn, a.norm, max(b.turn) AS pt FROM u a LEFT JOIN u b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.norm <> '' AND b.norm <> a.norm GROUP BY 1, 2, 3),
r AS (SELECT w.conv_id, w.turn, arg_min(m.norm, m.turn) AS answer FROM w JOIN m ON w.conv_id = m.conv_id AND m.role = 'assistant' AND m.norm <> '' AND m.turn > w.pt
  WHERE NOT EXISTS (SELECT 1 FROM u x WHERE x.conv_id = w.conv_id AND x.turn > w.pt AND x.turn < m.turn) GROUP BY 1, 2),
p AS (SELECT w.conv_id, w.turn, w.norm AS question, b.norm AS prior_user, substr(answer, 1, 800) AS prior_answer FROM w LEFT JOIN u b ON b.conv_id = w.conv_id AND b.turn = w.pt LEFT JOIN r ON r.conv_id = w.conv_id AND r.turn = w.turn)"""
_REF = rf"regexp_matches(question, '{_ANSWER_REFERENCE}')"
_FLAGS = rf"""{_ASKED}, f AS (SELECT *, {_REF} AS refers, {_REF} OR regexp_matches(question, '{_FOLLOW_UP}') AS follow_up,
 regexp_matches(question, '{_COMPARISON}') OR regexp_matches(question, '{_MULTI_CONSTRAINT}') OR regexp_matches(question, '{_DIAGNOSTIC_ORDER}') AS hard FROM p)"""
_REWRITTEN = rf"""{_FLAGS}, g AS (SELECT *, CASE WHEN prior_user IS NOT NULL AND follow_up THEN 'Previous user question: ' || prior_user || chr(10) || CASE WHEN refers AND prior_answer IS NOT NULL THEN 'Previous assistant answer: ' || prior_answer || chr(10) ELSE '' END
  || 'Current follow-up: ' || question ELSE question END AS made,
 CASE WHEN hard THEN CASE turn % 4 WHEN 0 THEN substr(question, 9, 200) WHEN 1 THEN '["x"]' WHEN 2 THEN '- ' || substr(question, 1, 50) ELSE NULL END END AS offered FROM f),
v AS (SELECT *, CASE WHEN turn % 4 = 0 AND length(trim(offered)) >= 2 THEN trim(offered) END AS given FROM g),
t AS (SELECT conv_id, turn, CASE WHEN hard THEN 'llm' WHEN made <> question THEN 'follow_up' ELSE 'passthrough' END AS mode, coalesce(given, made) AS query, hard AND given IS NULL AS fallback_used FROM v)"""


def _turns(spark, sf_dir):
    kind = (F.col("conv_id") + F.col("turn")) % 4
    prefix = (
        F.when(F.col("role") != "user", "").when(kind == 0, "Then ").when(kind == 1, "What about ").when(kind == 2, "the second option ")
        .when(F.col("conv_id") % 3 == 0, "compare ").otherwise("")
    )
    return conversation.prior_turns(_t(spark, sf_dir, "conversations").withColumn("text", F.concat(prefix, "text")))


def _rewritten(spark, sf_dir):
    # What a model would have given: valid, JSON, a list item or nothing.
    kind = F.col("turn") % 4
    offered = F.when(kind == 0, F.substring("question", 9, 200)).when(kind == 1, '["x"]').when(kind == 2, F.concat(F.lit("- "), F.substring("question", 1, 50)))
    return conversation.rewrite(_turns(spark, sf_dir).withColumn("offered", offered), "offered")


@query(f"WITH {_FLAGS} SELECT conv_id, turn, prior_user, prior_answer, refers AS references_answer, follow_up AS is_follow_up, hard AS is_complex FROM f")
def question_kinds(spark, sf_dir):
    q = F.col("question")
    return _turns(spark, sf_dir).select(
        "conv_id", "turn", "prior_user", "prior_answer", Q.references_answer(q).alias("references_answer"), Q.is_follow_up(q).alias("is_follow_up"), Q.is_complex(q).alias("is_complex")
    )


@query(f"WITH {_REWRITTEN} SELECT conv_id, turn, mode, query, length(query)::INT AS query_chars, fallback_used FROM t")
def question_rewrite(spark, sf_dir):
    return _rewritten(spark, sf_dir).select("conv_id", "turn", "mode", "query", F.length("query").alias("query_chars"), "fallback_used")


@query(f"""WITH {_REWRITTEN} SELECT count(*) AS questions, round(avg((mode = 'llm')::INT), 4) AS llm_call_rate, round(avg(fallback_used::INT), 4) AS fallback_rate,
 count(*) FILTER (mode = 'passthrough') AS passthrough, count(*) FILTER (mode = 'follow_up') AS follow_up, count(*) FILTER (mode = 'llm') AS llm FROM t""")
def rewrite_summary(spark, sf_dir):
    return conversation.rewrite_summary(_rewritten(spark, sf_dir))


def _unique(items: str) -> str:
    return f"list_filter({items}, lambda x, i: trim(x) <> '' AND list_position(list_transform({items}, lambda y: lower(trim(y))), lower(trim(x))) = i)"


_STOP = ", ".join(f"'{w}'" for w in _STOP_WORDS)
_EDGE = r"^[.:;；：()（）\[\]【】]+|[.:;；：()（）\[\]【】]+$"
_KEYWORDS = rf"""k0 AS (SELECT conv_id, turn, norm AS question, list_filter(list_transform(regexp_split_to_array(regexp_replace(norm, '[?？,，]', ' ', 'g'), '\s+'), lambda t: regexp_replace(t, '{_EDGE}', '', 'g')),
  lambda t: length(t) >= 2 AND lower(t) NOT IN ({_STOP})) AS ts FROM u), k AS (SELECT conv_id, turn, question, {_unique('ts')} AS ks FROM k0)"""


@query(f"WITH {_ASKED}, {_KEYWORDS} SELECT conv_id, turn, array_to_string(ks, ',') AS keywords, len(ks)::INT AS n FROM k")
def question_keywords(spark, sf_dir):
    return _turns(spark, sf_dir).withColumn("ks", Q.keywords(F.col("question"))).select("conv_id", "turn", F.array_join("ks", ",").alias("keywords"), F.size("ks").alias("n"))


def _weak(text: str) -> str:
    made = text
    for term in _WEAK_TERMS:
        made = f"replace({made}, '{term}', ' ')"
    return rf"coalesce(nullif(trim(regexp_replace({made}, '\s+', ' ', 'g')), ''), {text})"


def _head(text: str, n: int) -> str:
    return rf"CASE WHEN len(string_split({text}, ' ')) > {n} THEN array_to_string(list_slice(string_split({text}, ' '), 1, {n}), ' ') END"


_TRIED = "CASE WHEN turn % 2 = 0 THEN ['  ' || question] ELSE []::VARCHAR[] END"


@query(rf"""WITH {_ASKED}, {_KEYWORDS}, a AS (SELECT *, 'specific ' || question AS rw FROM k), b AS (SELECT *, {_weak('rw')} AS s1, {_weak('question')} AS s2 FROM a),
 c AS (SELECT *, conv_id % 3 AS s, CASE conv_id % 3 WHEN 0 THEN list_filter([s1, {_head('s1', 3)}, {_head('s1', 2)}, s2, {_head('s2', 3)}, {_head('s2', 2)}], lambda x: x IS NOT NULL)
  WHEN 1 THEN [rw, question || ' process conditions steps requirements', rw || ' process conditions steps requirements']
  ELSE list_filter([array_to_string(list_slice(['specific'] || list_filter(ks, lambda x: lower(x) <> 'specific'), 1, 4), ' '),
    CASE WHEN len(ks) >= 2 THEN array_to_string(['specific', ks[1], ks[-1]], ' ') END, CASE WHEN len(ks) >= 1 THEN array_to_string(['specific', ks[1], 'process', 'requirements'], ' ') END], lambda x: x IS NOT NULL) END AS q0 FROM b),
 d AS (SELECT conv_id, turn, question, s, {_unique('q0')} AS q1 FROM c)
 SELECT conv_id, turn, CASE s WHEN 0 THEN 'broaden' WHEN 1 THEN 'query_rewrite' ELSE 'keyword' END AS strategy,
 array_to_string(list_slice(list_filter(q1, lambda x: NOT list_contains(list_transform({_TRIED}, lambda y: lower(trim(y))), lower(trim(x)))), 1, 3), chr(10)) AS queries FROM d""")
def retry_queries(spark, sf_dir):
    strategy = F.element_at(F.array(F.lit("broaden"), F.lit("query_rewrite"), F.lit("keyword")), (F.col("conv_id") % 3 + 1).cast("int"))
    tried = F.when(F.col("turn") % 2 == 0, F.array(F.concat(F.lit("  "), "question"))).otherwise(F.array().cast("array<string>"))
    turns = _turns(spark, sf_dir).withColumns({"strategy": strategy, "rw": F.concat(F.lit("specific "), "question"), "tried": tried})
    made = Q.retry_queries(F.col("strategy"), F.col("rw"), F.col("question"), F.col("tried"))
    return turns.select("conv_id", "turn", "strategy", F.array_join(made, "\n").alias("queries"))


_CLEAN = r"""c AS (SELECT doc_id, source, regexp_replace(regexp_replace(CASE WHEN doc_id % 5 = 0 THEN replace(text, 'e', chr(65533)) ELSE text END, '[ \t]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents),
h AS (SELECT doc_id, unnest(string_split(t, '')) AS ch, unnest(range(length(t))) AS pos FROM c), i AS (SELECT doc_id, ch, pos - row_number() OVER (PARTITION BY doc_id, ch ORDER BY pos) AS g FROM h WHERE NOT regexp_matches(ch, '\s')),
j AS (SELECT doc_id, max(n) AS run FROM (SELECT doc_id, count(*) AS n FROM i GROUP BY doc_id, ch, g) GROUP BY 1),
e AS (SELECT doc_id, source, t, length(t) AS n, coalesce(run, 1) / length(t) AS rep, least(1, (length(regexp_replace(regexp_replace(t, '[^\p{Cc}\p{Co}\x{FFFD}]', '', 'g'), '\s', '', 'g')) + length(regexp_replace(t, '[^\x{FFFD}]', '', 'g'))
  + length(t) - length(replace(t, 'ï¿½', '')) + length(t) - length(replace(t, '□□', ''))) / length(t)) AS garbled,
 round(least(1, (length(regexp_replace(t, '[^∑∫√∞≈≠≤≥±×÷∂πθλμσΔΣΩαβγ^=<>]', '', 'g')) + 8 * len(regexp_extract_all(t, '(?:^|[^\p{L}\p{N}_])[a-zA-Z]\s*[=<>]\s*[-+*/()a-zA-Z0-9]+'))
  + 8 * len(regexp_extract_all(t, '\\(?:frac|sum|int|sqrt|alpha|beta|gamma|theta|lambda)\b'))) / length(t)), 4) AS math FROM c LEFT JOIN j USING (doc_id)),
y AS (SELECT *, (doc_id % 10) / 10 AS img, doc_id % 50 AS dr FROM e),
z AS (SELECT *, CASE WHEN n < 200 AND img >= 0.45 THEN 'mineru_ocr' WHEN n > 0 AND garbled > 0.05 THEN 'mineru_ocr' WHEN dr >= 40 OR math >= 0.02 OR img >= 0.45 THEN 'mineru_complex' WHEN n >= 200 AND img <= 0.20 THEN 'simple_text' ELSE 'mineru_complex' END AS route FROM y)"""


def _profiles(spark, sf_dir):
    text = F.when(F.col("doc_id") % 5 == 0, F.replace("text", F.lit("e"), F.lit("�"))).otherwise(F.col("text"))
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", P.page_text(text).alias("t"))
    c = F.col("t")
    pages = docs.select("doc_id", "source", F.length("t").alias("text_len"), P.garbled_score(c).alias("garbled"), P.repeat_score(c).alias("repeated"), P.quality_score(c).alias("quality"), P.math_score(c).alias("math"))
    image = (F.col("doc_id") % 10) / 10
    figures = (F.col("text_len"), F.col("garbled"), image, F.col("doc_id") % 50, F.col("math"))
    return pages.withColumns({"route": P.route_page(*figures), "reason": P.route_reason(*figures)})


@query(f"""WITH {_CLEAN} SELECT doc_id, n::INT AS text_len, round(garbled, 6) AS garbled, round(rep, 6) AS repeated, round(least(n / 200, 1) * (1 - garbled) * (1 - rep), 6) AS quality, math, route, CASE WHEN n < 200 AND img >= 0.45 THEN 'text layer is sparse and image area is high' WHEN n > 0 AND garbled > 0.05 THEN 'text layer appears garbled'
 WHEN dr >= 40 THEN 'many drawings or line elements suggest tables or layout complexity' WHEN math >= 0.02 THEN 'math or formula features are present' WHEN img >= 0.45 THEN 'large image area suggests complex page layout'
 WHEN n >= 200 AND img <= 0.20 THEN 'selectable text is sufficient and page image area is low' ELSE 'page does not meet simple text extraction thresholds' END AS reason FROM z""")
def page_routes(spark, sf_dir):
    pages = _profiles(spark, sf_dir)
    return pages.select("doc_id", "text_len", *[F.round(c, 6).alias(c) for c in ("garbled", "repeated", "quality")], "math", "route", "reason")


_ROUTES = f"""WITH {_CLEAN}, r AS (SELECT source, count(*) AS pages, count(*) FILTER (route <> 'simple_text') AS complex_pages, CASE WHEN avg((route <> 'simple_text')::INT) > 0.35 THEN 'complex' ELSE 'fast' END AS parser FROM z GROUP BY 1)"""


@query(f"{_ROUTES} SELECT * FROM r")
def document_routes(spark, sf_dir):
    return corpus.document_routes(_profiles(spark, sf_dir), "source")


@query(f"""WITH {_CLEAN}, d AS (SELECT doc_id % 200 AS doc, route FROM z WHERE doc_id % 5 <> 0), r AS (SELECT doc, count(*) AS pages, count(*) FILTER (route <> 'simple_text') AS complex_pages, avg((route <> 'simple_text')::INT) > 0.35 AS hard FROM d GROUP BY 1)
 SELECT doc, pages, complex_pages, NOT hard AND doc % 3 = 0 AS fallback_used, CASE WHEN hard OR doc % 3 = 0 THEN 'complex' ELSE 'fast' END AS parser FROM r""")
def document_fallbacks(spark, sf_dir):
    """Pages as documents of up to a few pages, every third of which the fast parser reads badly."""
    pages = _profiles(spark, sf_dir).where("doc_id % 5 <> 0").withColumn("doc", F.col("doc_id") % 200)
    quality = pages.select("doc").distinct().where("doc % 7 <> 0 OR doc % 3 = 0").withColumn("quality", F.when(F.col("doc") % 3 == 0, 0.59).otherwise(0.6))
    return corpus.document_routes(pages, "doc", quality)


@query(f"""WITH {_HYBRID.replace('FROM documents', "FROM (SELECT * FROM documents WHERE lang = 'en' AND doc_id % 3 <> 2)").replace('QUALIFY rrf_rank <= 8', 'QUALIFY rrf_rank <= 20')},
 sc2 AS (SELECT query_id, chunk_id, rrf_rank, CASE WHEN query_id % 3 > 0 AND chunk_id % 5 <> 0 THEN (chunk_id * 37 % 101 + 1) / 101 END AS s FROM hr),
 ok AS (SELECT *, count(s) OVER (PARTITION BY query_id) > 0 AS scored FROM sc2), pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, rrf_rank) AS rank FROM ok WHERE NOT scored OR s IS NOT NULL QUALIFY rank <= 8),
 sz AS (SELECT pl.*, length(text) AS n_chars FROM pl JOIN documents ON doc_id = chunk_id), up AS (SELECT *, sum(n_chars) OVER (PARTITION BY query_id ORDER BY rank) AS upto, count(s) OVER w = count(*) OVER w AS whole, arg_min(s, rank) OVER w AS top FROM sz WINDOW w AS (PARTITION BY query_id)),
 st AS (SELECT *, min(CASE WHEN rank > 2 AND (upto > 7200 OR whole AND s < top * 0.5) THEN rank END) OVER (PARTITION BY query_id) AS stop FROM up)
 SELECT query_id, chunk_id, rank, round(s, 9) AS rerank_score, n_chars::INT AS n_chars FROM st WHERE stop IS NULL OR rank < stop""")
def scoped_search(spark, sf_dir):
    """Questions to one base, some with scores of a reranker, down to what is read."""
    queries, n = _asked(spark, sf_dir)[0], F.col("doc_id")
    chunks = _t(spark, sf_dir, "documents").select(n.alias("chunk_id"), F.col("lang").alias("kb_id"), F.when(n % 3 == 2, "old").otherwise("new").alias("version"), "text")
    c = F.col("chunk_id")
    reranker = lambda hits: hits.where("query_id % 3 > 0 AND chunk_id % 5 <> 0").select("query_id", "chunk_id", ((c * 37 % 101 + 1) / 101).alias("rerank_score"))
    found = retrieval.scoped_search(queries, chunks, "en", "new", reranker=reranker)
    return found.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("rerank_score", 9).alias("rerank_score"), "n_chars")


_TABLE = r"""l0 AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM l0),
b AS (SELECT doc_id, pos, '| ' || pos || ' | ' || replace(line, '|', '\|') || ' |' AS row, '### Lines of ' || doc_id || chr(10) || chr(10) || '| n | line |' || chr(10) || '| --- | --- |' AS head FROM l)"""


def _tables(spark, sf_dir):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = F.transform(lines, lambda x, i: F.array((i + 1).cast("string"), x))
    title = F.concat(F.lit("Lines of "), F.col("doc_id").cast("string"))
    return _t(spark, sf_dir, "documents").select("doc_id", P.markdown_table(title, F.array(F.lit("n"), F.lit("line")), rows).alias("md"))


@query(f"WITH {_TABLE} SELECT doc_id, pos::INT AS part, md5(head || chr(10) || row) AS part_md5 FROM b")
def table_rows(spark, sf_dir):
    return _tables(spark, sf_dir).select("doc_id", F.posexplode(P.table_rows(F.col("md"))).alias("p", "t")).select("doc_id", (F.col("p") + 1).alias("part"), F.md5(F.col("t").cast("binary")).alias("part_md5"))


@query(rf"""WITH RECURSIVE {_TABLE}, g AS (SELECT doc_id, pos, 1 AS part, length(head) + 1 + length(row) AS used FROM b WHERE pos = 1 UNION ALL
 SELECT b.doc_id, b.pos, CASE WHEN g.used + 1 + length(row) > 900 THEN g.part + 1 ELSE g.part END, CASE WHEN g.used + 1 + length(row) > 900 THEN length(head) + 1 + length(row) ELSE g.used + 1 + length(row) END
 FROM g JOIN b ON b.doc_id = g.doc_id AND b.pos = g.pos + 1)
 SELECT doc_id, part::INT AS part, count(*)::INT AS n_rows, md5(any_value(head) || chr(10) || string_agg(row, chr(10) ORDER BY pos)) AS part_md5 FROM g JOIN b USING (doc_id, pos) GROUP BY 1, 2""")
def table_parts(spark, sf_dir):
    parts = _tables(spark, sf_dir).select("doc_id", F.posexplode(P.table_parts(F.col("md"), 900)).alias("p", "t")).where(F.size(F.split("t", "\n")) > 4)
    return parts.select("doc_id", (F.col("p") + 1).alias("part"), (F.size(F.split("t", "\n")) - 4).alias("n_rows"), F.md5(F.col("t").cast("binary")).alias("part_md5"))


_RERANKED = f"""{_HYBRID}, ask AS (SELECT item_id AS query_id, list_distinct({_TERMS}) AS qs FROM benchmark),
rr AS (SELECT query_id, chunk_id, rrf_rank, round(len(list_intersect(qs, ts)) / len(qs), 9) AS rerank_score FROM hr JOIN ask USING (query_id) JOIN c USING (chunk_id) WHERE query_id % 3 <> 0 AND chunk_id % 7 <> 0),
ra AS (SELECT hr.query_id, hr.chunk_id, hr.rrf_rank, rerank_score, count(rerank_score) OVER (PARTITION BY hr.query_id) > 0 AS scored FROM hr LEFT JOIN rr USING (query_id, chunk_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, rrf_rank) AS place FROM ra WHERE NOT scored OR rerank_score IS NOT NULL)"""


@query(f"WITH {_RERANKED} SELECT query_id, chunk_id, rrf_rank, rerank_score, CASE WHEN scored THEN place END AS rerank_rank FROM rk WHERE place <= 5")
def rerank(spark, sf_dir):
    queries, chunks = _asked(spark, sf_dir)
    hits = retrieval.hybrid_search(queries, chunks).select("query_id", "chunk_id", F.col("rrf_rank").alias("rank"))
    # Some queries and some chunks go without a score.
    scores = retrieval.lexical_scores(queries, hits, chunks).where("query_id % 3 <> 0 AND chunk_id % 7 <> 0")
    return retrieval.apply_rerank(hits, scores, 5).withColumnRenamed("rank", "rrf_rank").select("query_id", "chunk_id", "rrf_rank", "rerank_score", "rerank_rank")


@query(f"""WITH {_HYBRID}, x0 AS (SELECT query_id, chunk_id, 0 AS leg, bm25_rank AS rank FROM b WHERE bm25_rank <= 5 UNION ALL SELECT query_id, chunk_id, 1, dense_rank FROM dr WHERE dense_rank <= 5),
 x1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY leg, rank) AS n FROM x0)
 SELECT query_id, chunk_id, leg, rank, row_number() OVER (PARTITION BY query_id ORDER BY leg, rank, chunk_id) AS place FROM x1 WHERE n = 1""")
def multi_query_union(spark, sf_dir):
    queries, chunks = _asked(spark, sf_dir)
    sparse = retrieval.bm25_topk(queries, chunks, 5).select("query_id", "chunk_id", F.lit(0).alias("leg"), F.col("bm25_rank").alias("rank"))
    dense = retrieval.hash_dense_topk(queries, chunks, 5).select("query_id", "chunk_id", F.lit(1).alias("leg"), F.col("dense_rank").alias("rank"))
    return retrieval.multi_query_union(sparse.union(dense))


@query("""WITH s AS (SELECT doc_id, source, lang, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 4)
 SELECT source, md5(string_agg('[' || rank || '] 来源: ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ', 页码: ' || (doc_id % 9) ELSE '' END || ', 场景: ' || lang || chr(10) || substr(text, 1, 400), chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM s GROUP BY 1""")
def format_context(spark, sf_dir):
    from pyspark.sql import Window as W

    # The feature: four snippets of 400 characters for each group.
    rows = _t(spark, sf_dir, "documents").withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).where("rank <= 4").select(
        F.col("source").alias("query_id"), "rank", F.col("doc_id").cast("string").alias("name"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 9).alias("page"),
        F.lit(None).cast("string").alias("section"), F.col("lang").alias("scenario"), F.substring("text", 1, 400).alias("text"),
    )
    return retrieval.format_context(rows).select(F.col("query_id").alias("source"), F.md5(F.col("context").cast("binary")).alias("context_md5"))


_PAYLOAD = """n AS (SELECT conv_id, turn, text, substr(text, 1, 30) AS k FROM conversations WHERE role = 'user' AND trim(text) <> '' AND trim(substr(text, 1, 30)) <> '')"""


@query(rf"""WITH {_PAYLOAD}, f AS (SELECT *, trim(regexp_replace(k, '\s+', ' ', 'g')) AS key, trim(regexp_replace(substr(text, 1, 100), '\s+', ' ', 'g')) AS value FROM n WHERE conv_id % 6 = 0)
 SELECT conv_id, turn, 'task' AS memory_type, key, value, (conv_id % 10) / 10 AS confidence FROM f UNION ALL SELECT conv_id, turn, 'entity', key, value, 1.0 FROM f""")
def memory_facts(spark, sf_dir):
    """Payloads of one conversation in six are valid; each other kind breaks one rule."""
    turns = _t(spark, sf_dir, "conversations").where("role = 'user' AND trim(text) <> '' AND trim(substr(text, 1, 30)) <> ''")
    key, value, kind = F.substring("text", 1, 30), F.substring("text", 1, 100), F.col("conv_id") % 6
    fact = lambda c: F.struct(F.when(kind != 2, key).alias("key"), value.alias("value"), c.alias("confidence"))
    sure = F.when(kind == 3, 2.0).otherwise((F.col("conv_id") % 10) / 10)
    none = F.array().cast("array<struct<key:string,value:string,confidence:double>>")
    fields = [F.array(fact(sure), fact(F.lit(0.5))).alias("task"), F.when(kind != 1, none).alias("constraint"), F.array(fact(F.lit(1.0))).alias("entity"), none.alias("open_question")]
    made = F.to_json(F.struct(*fields))
    payload = F.when(kind == 4, F.concat(F.lit("note: "), made)).when(kind == 5, F.replace(made, F.lit('"confidence"'), F.lit('"more":true,"confidence"'))).otherwise(made)
    return memory.parse_facts(turns.select("conv_id", "turn", payload.alias("payload")), "payload").select("conv_id", "turn", "memory_type", "key", "value", "confidence")


@query("""WITH m AS (SELECT user_id, event_id, ts, ts + to_days((event_id % 20 + 1)::INT) AS ends FROM events WHERE event_id % 9 <> 0), a AS (SELECT max(ts) AS t FROM events)
 SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM m, a WHERE ends > t QUALIFY place <= 5""")
def active_memories(spark, sf_dir):
    events = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = events.select(
        F.col("user_id").alias("owner"), F.col("event_id").alias("memory_id"), F.col("ts").alias("updated_at"), (F.col("ts") + F.make_dt_interval(F.col("event_id") % 20 + 1)).alias("expires_at"),
        F.when(F.col("event_id") % 9 == 0, "deleted").otherwise("active").alias("status"),
    )
    live = memory.active_memories(memory.expire_due(rows, events.agg(F.max("ts")).first()[0]))
    return live.select(F.col("owner").alias("user_id"), F.col("memory_id").alias("event_id"), "place")


@query("""SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type IN ('click', 'view') GROUP BY 1""")
def active_job(spark, sf_dir):
    jobs = _t(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "event_id", F.col("ts").alias("created_at"), F.col("event_type").isin("click", "view").alias("active"))
    return corpus.active_job(jobs, "event_id").select(F.col("doc_id").alias("user_id"), "event_id")


@query("""SELECT 'duplicate_hash' AS rule, count(*) AS violations FROM (SELECT 1 FROM documents GROUP BY source, sha256(text) HAVING count(*) > 1)
 UNION ALL SELECT 'orphan', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)
 UNION ALL SELECT 'range', count(*) FROM documents WHERE n_chars < 100 OR n_chars IS NULL""")
def constraint_violations(spark, sf_dir):
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    parts = [
        corpus.duplicate_keys(docs.withColumn("h", F.sha2("text", 256)), ["source", "h"], "duplicate_hash"),
        corpus.orphans(labels, docs.where("doc_id % 3 <> 0"), "doc_id", "orphan"), corpus.failing(docs, F.col("n_chars") >= 100, "range"),
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query("""WITH c AS (SELECT source, count(*) AS chunks, count(*) FILTER (doc_id % 50 <> 0) AS vectors, count(*) FILTER (n_chars < 20) AS failed FROM documents GROUP BY 1)
 SELECT source, chunks, vectors, chunks = vectors AND failed = 0 AS ok FROM c""")
def index_consistency(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("status", F.when(F.col("n_chars") < 20, "failed").otherwise("ready"))
    return corpus.consistency(docs, docs.where("doc_id % 50 <> 0"), "source")


@query("SELECT conv_id, count(*) AS revision, max(turn) AS last_turn FROM conversations GROUP BY 1")
def revision_stream(spark, sf_dir):
    return history.revision_stream(spark, f"{sf_dir}/conversations.parquet")


@query(f"""WITH {_METRICS}, f2 AS (SELECT query_id, min(bm25_rank) AS first_rank, count(*) FILTER (bm25_rank <= 5) AS n FROM b JOIN x USING (query_id, chunk_id) WHERE bm25_rank <= 8 GROUP BY 1),
 m2 AS (SELECT coalesce(n, 0) / ne AS recall, coalesce(1 / first_rank, 0) AS reciprocal_rank FROM xs LEFT JOIN f2 USING (query_id)),
 s1 AS (SELECT {_mean('recall')} AS r, {_mean('reciprocal_rank')} AS m FROM mm), s2 AS (SELECT {_mean('recall')} AS r, {_mean('reciprocal_rank')} AS m FROM m2),
 l AS (SELECT quantile_disc(value, 0.95) FILTER (event_type = 'click') AS p1, quantile_disc(value, 0.95) FILTER (event_type = 'view') AS p2 FROM events),
 o AS (SELECT round(s2.r - s1.r, 4) AS delta_recall, round(s2.m - s1.m, 4) AS delta_mrr, round(p2 - p1, 2) AS delta_p95, concat_ws(',', CASE WHEN s2.r < s1.r - 0.01 THEN 'recall' END, CASE WHEN s2.m < s1.m - 0.01 THEN 'MRR' END,
  'llm_call_rate', CASE WHEN p2 > p1 + 1500 THEN 'P95_ms' END) AS failed_gates FROM s1, s2, l) SELECT *, failed_gates = '' AS passed FROM o""")
def compare_reports(spark, sf_dir):
    """Hybrid search against its term leg alone; latencies are those of two kinds of events, the call rate is given."""
    queries, chunks = _asked(spark, sf_dir)
    labels = evaluation.containing(queries, chunks)
    sparse = retrieval.bm25_topk(queries, chunks, 8).select("query_id", "chunk_id", F.col("bm25_rank").alias("rank"))

    def report(metrics: DataFrame, kind: str, rate: float) -> DataFrame:
        slow = _t(spark, sf_dir, "events").where(F.col("event_type") == kind).agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95_ms"))
        means = evaluation.summary(metrics).select(F.col("mean_recall").alias("recall"), "mrr", F.lit(rate).alias("llm_call_rate"))
        return means.crossJoin(F.broadcast(slow))  # one row each

    return evaluation.compare_reports(report(_metrics(spark, sf_dir), "click", 0.0), report(evaluation.per_question_metrics(sparse, labels), "view", 0.31))


@query(f"WITH {_METRICS} SELECT query_id FROM mm WHERE first_rank IS NULL")
def missed_questions(spark, sf_dir):
    return evaluation.missed_questions(_metrics(spark, sf_dir))


from . import decisions, more, streams, tables  # noqa: E402,F401  (they register their queries with the same tables)
