"""Registered queries on chunks, ownership, memories and evaluation; each with its SQL, but for splitting by size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import payloads
from ..operators import chunking, conversation, corpus, evaluation, memory, ownership, retrieval
from .queries import QUERIES, _t, query


def _headed(spark, sf_dir) -> DataFrame:
    """All documents, in which every fourth line, by document, is a heading of level 1 to 3, and every ninth a level 2."""
    def line(x, i):
        level = F.when((F.col("doc_id") + i) % 9 == 0, 2).when((F.col("doc_id") + i) % 4 == 0, i % 3 + 1).otherwise(0)
        return F.when((level > 0) & (F.trim(x) != ""), F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), x)).otherwise(x)

    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))


_HEADED = r"""hd AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, j: CASE WHEN trim(x) <> '' AND (doc_id + j - 1) % 9 = 0 THEN '## ' || x
 WHEN trim(x) <> '' AND (doc_id + j - 1) % 4 = 0 THEN repeat('#', ((j - 1) % 3 + 1)::INT) || ' ' || x ELSE x END), chr(10)) AS text FROM documents)"""


@query(rf"""WITH {_HEADED}, l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM hd)),
h AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM l), g AS (SELECT *, regexp_matches(t, '^#{{1,6}}\s+\S') AS is_head FROM h),
b AS (SELECT *, sum(is_head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM g),
k AS (SELECT doc_id, block, max(CASE WHEN is_head THEN t END) AS raw, max(CASE WHEN is_head THEN length(regexp_extract(t, '^#+')) END) AS level, bool_or(NOT is_head AND t <> '') AS filled,
 string_agg(CASE WHEN NOT is_head THEN line END, chr(10) ORDER BY pos) AS own FROM b GROUP BY 1, 2),
s AS (SELECT k.*, (SELECT list_reduce(list(list_value({{'l': a.level, 'r': a.raw}}) ORDER BY a.block), lambda x, y: list_concat(x[1:y[1].l - 1], y)) FROM k a WHERE a.doc_id = k.doc_id AND a.block <= k.block AND a.raw IS NOT NULL) AS st FROM k)
SELECT doc_id, block::BIGINT AS block, array_to_string(list_transform(st, lambda e: regexp_replace(regexp_replace(e.r, '^#+\s+', ''), '\s*#*\s*$', '')), ' / ') AS section,
 md5(regexp_replace(coalesce(array_to_string(list_transform(st[1:-2], lambda e: e.r || chr(10) || chr(10)), ''), '') || concat_ws(chr(10), raw, own), '^\s+|\s+$', '', 'g')) AS text_md5
FROM s WHERE coalesce(filled, false)
UNION ALL SELECT doc_id, 0, nullif(trim(regexp_replace(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x), '#'))[1], '^\s*#+', '')), ''), md5(regexp_replace(text, '^\s+|\s+$', '', 'g'))
FROM hd WHERE trim(text) <> '' AND doc_id NOT IN (SELECT doc_id FROM k WHERE filled)""")
def heading_blocks(spark, sf_dir):
    blocks = chunking.heading_blocks(_headed(spark, sf_dir))
    return blocks.select("doc_id", "block", "section", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(rf"WITH {_HEADED} SELECT doc_id, nullif(trim(regexp_replace(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x), '#'))[1], '^\s*#+', '')), '') AS section FROM hd")
def sections(spark, sf_dir):
    return _headed(spark, sf_dir).select("doc_id", chunking.infer_section(F.col("text")).alias("section"))


def recursive_chunks(spark, sf_dir):
    """Parts of all documents by size; the splitter is tested on hand-worked rows, as SQL can't express it."""
    return chunking.recursive_split(_t(spark, sf_dir, "documents")).select("doc_id", "part", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def document_chunks(spark, sf_dir):
    """The chunk table of all documents, of which every fifth is a table of its lines; four in a row are of one source."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    table = P.markdown_table(F.concat(F.lit("Lines of "), F.col("doc_id").cast("string")), F.array(F.lit("n"), F.lit("line")), F.transform(lines, lambda x, i: F.array((i + 1).cast("string"), x)))
    kind, path = F.when(F.col("doc_id") % 5 == 0, "table"), F.concat(F.lit("doc/"), F.floor(F.col("doc_id") / 4).cast("string"))
    docs = _t(spark, sf_dir, "documents").select("doc_id", path.alias("source_path"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 9).alias("page"), kind.alias("content_type"), F.when(kind.isNotNull(), table).otherwise(F.col("text")).alias("text"))
    return chunking.build_chunks(docs).select("doc_id", "chunk_index", "content_type", "chunk_id", "section", F.md5(F.col("text").cast("binary")).alias("text_md5"))


QUERIES |= {f.__name__: f for f in (recursive_chunks, document_chunks)}


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace('Contents' || chr(10) || 'Part one .... 3' || chr(10) || 'same' || chr(10) || text || chr(10) || ' same ' || chr(10) || 'Page 3 of 9', '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), chr(10)),
  '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS x FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d WHERE doc_id % 2 = 0)),
k AS (SELECT * FROM l WHERE NOT (regexp_matches(x, '(?i)^(#{1,6}\s*)?(page\s*\d+(\s*(of|/)\s*\d+)?|第\s*\d+\s*页)$') OR regexp_matches(x, '^(\d+(\.\d+)*\s+)?[^\n]{1,100}?\s*(\.{2,}|…+)\s*\d+\s*$') OR regexp_matches(x, '(?i)^((table\s+of\s+)?contents|目\s*录)$'))),
c AS (SELECT *, x <> '' AND length(x) <= 80 AND NOT regexp_matches(x, '[.!?:;]$') AND NOT starts_with(x, '#') AND NOT contains(x, '|') AS cand FROM k), m AS (SELECT doc_id, x FROM c WHERE cand GROUP BY 1, 2 HAVING count(*) > 1),
n AS (SELECT *, sum((x = '')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS par FROM k WHERE (doc_id, x) NOT IN (SELECT doc_id, x FROM m)),
p AS (SELECT doc_id, par, string_agg(x, ' ' ORDER BY pos) AS x FROM n WHERE x <> '' GROUP BY 1, 2), j AS (SELECT doc_id, string_agg(x, chr(10) || chr(10) ORDER BY par) AS t FROM p GROUP BY 1)
SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN coalesce(j.t, '') ELSE d.t END) AS text_md5 FROM d LEFT JOIN j USING (doc_id)""")
def clean_extracted(spark, sf_dir):
    """All documents with a contents part, a line that recurs and a page number around them, every second one as a pdf."""
    made = F.concat(F.lit("Contents\nPart one .... 3\nsame\n"), "text", F.lit("\n same \nPage 3 of 9"))
    kind = F.when(F.col("doc_id") % 2 == 0, "pdf").otherwise("txt")
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(chunking.clean_extracted_text(made, kind).cast("binary")).alias("text_md5"))


@query(r"""WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, trim(regexp_replace(replace(lower(unnest(ls)), 'ß', 'ss'), '\s+', ' ', 'g')) AS norm FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
f AS (SELECT doc_id, list_reduce(list(list_value({'p': pos, 'n': norm}) ORDER BY pos), lambda a, x: CASE WHEN len(list_filter(a, lambda k: contains(k.n, x[1].n) OR contains(x[1].n, k.n))) > 0 THEN a ELSE list_concat(a, x) END) AS kept FROM l GROUP BY 1)
SELECT doc_id, unnest(list_transform(kept, lambda k: k.p))::INT AS pos FROM f""")
def dedup_containment(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    return chunking.dedup_containment(lines, "doc_id", "pos").select("doc_id", "pos")


# Conversations have no owners: user conv_id % 7 owns them, 0 is an admin, 3 inactive; updated_at is a number from the id.
_OWNED = """us AS (SELECT range AS user_id, CASE range WHEN 0 THEN 'admin' ELSE 'user' END AS role, range <> 3 AS is_active, CASE WHEN range <> 5 THEN 'name' || (9 - range) END AS username FROM range(7)),
cv AS (SELECT DISTINCT conv_id, conv_id % 7 AS owner, (conv_id * 7919) % 1009 AS updated_at FROM conversations),
rq AS (SELECT conv_id AS request_id, conv_id, conv_id % 5 AS actor, owner, 'conversation.read' AS action FROM cv)"""


def _owned(spark, sf_dir):
    users = spark.range(7).select(F.col("id").alias("user_id"), F.when(F.col("id") == 0, "admin").otherwise("user").alias("role"), (F.col("id") != 3).alias("is_active"), F.when(F.col("id") != 5, F.concat(F.lit("name"), (9 - F.col("id")).cast("string"))).alias("username"))
    convs = _t(spark, sf_dir, "conversations").select("conv_id").distinct().withColumns({"owner": F.col("conv_id") % 7, "updated_at": F.col("conv_id") * 7919 % 1009})
    return users, convs, convs.select(F.col("conv_id").alias("request_id"), "conv_id", (F.col("conv_id") % 5).alias("actor"), "owner", F.lit("conversation.read").alias("action"))


@query("""SELECT conv_id, turn, role, n - rn + 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn, least(count(*) OVER (PARTITION BY conv_id), 4) AS n FROM conversations) WHERE rn <= 4""")
def recent_messages(spark, sf_dir):
    return ownership.recent_messages(_t(spark, sf_dir, "conversations"), 4).select("conv_id", "turn", "role", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_OWNED} SELECT c.conv_id, owner, place, n AS message_count, title FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY updated_at DESC, conv_id) AS place FROM cv) c
 JOIN (SELECT conv_id, count(*) AS n, arg_min(text, turn) FILTER (role = 'user') AS title FROM conversations GROUP BY 1) m USING (conv_id) WHERE place <= 100""")
def list_conversations(spark, sf_dir):
    return ownership.list_conversations(_owned(spark, sf_dir)[1], _t(spark, sf_dir, "conversations")).select("conv_id", "owner", F.col("place").cast("long").alias("place"), "message_count", "title")


@query(f"""WITH {_OWNED} SELECT request_id, u.is_active AND (actor = owner OR u.role = 'admin') AS allowed, u.is_active AND actor <> owner AND u.role = 'admin' AS cross_owner FROM rq JOIN us u ON u.user_id = actor""")
def authorize(spark, sf_dir):
    users, _, requests = _owned(spark, sf_dir)
    return ownership.authorize(requests, users).select("request_id", "allowed", "cross_owner")


@query(f"WITH {_OWNED} SELECT actor, conv_id FROM rq WHERE actor = owner")
def owned_sessions(spark, sf_dir):
    _, convs, requests = _owned(spark, sf_dir)
    return ownership.owned_sessions(convs, requests).select("actor", "conv_id")


@query(f"""WITH {_OWNED}, a AS (SELECT conv_id % 11 + (conv_id % 7) * 100 AS request_id, conv_id, (conv_id + CASE WHEN conv_id % 22 = 1 THEN 1 ELSE 0 END) % 7 AS actor, owner FROM cv)
SELECT request_id, conv_id FROM a WHERE request_id NOT IN (SELECT request_id FROM a WHERE actor <> owner OR actor = 3)""")
def delete_conversations(spark, sf_dir):
    users, convs, _ = _owned(spark, sf_dir)
    asked = convs.select((F.col("conv_id") % 11 + F.col("conv_id") % 7 * 100).alias("request_id"), "conv_id", ((F.col("conv_id") + (F.col("conv_id") % 22 == 1).cast("long")) % 7).alias("actor"))
    return ownership.delete_conversations(asked, convs, users)


@query(f"WITH {_OWNED} SELECT request_id, actor, 'conversation.read.cross_owner' AS action, owner FROM rq WHERE actor = 0 AND owner <> 0")
def audit_events(spark, sf_dir):
    users, _, requests = _owned(spark, sf_dir)
    return ownership.audit_events(requests, users)


@query("SELECT DISTINCT user_id, CASE WHEN user_id % 5 <> 0 THEN 'u' || (user_id % 13) END AS username FROM events")
def list_users(spark, sf_dir):
    users = _t(spark, sf_dir, "events").select("user_id", F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("u"), (F.col("user_id") % 13).cast("string"))).alias("username")).distinct()
    return ownership.list_users(users)


@query("""WITH t AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click') SELECT user_id, -1 AS event_id FROM t
 UNION ALL SELECT user_id, min(event_id) FROM events WHERE user_id NOT IN (SELECT user_id FROM t) GROUP BY 1""")
def first_insert_wins(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    there = events.where("event_type = 'click'").select("user_id").distinct().withColumn("event_id", F.lit(-1).cast("long"))
    return ownership.first_insert_wins(there, events.select("user_id", "event_id"), ["user_id"], "event_id")


# Memories: an event is a statement of its user under the key event_type; the value is told by its number.
@query("SELECT user_id AS session_id, event_type AS key, max(event_id) AS version, arg_max(props, event_id) AS summary FROM events GROUP BY 1, 2")
def latest_summaries(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select(F.struct("user_id", "event_type").alias("session_id"), F.col("event_id").alias("version"), F.col("props").alias("summary"))
    return memory.latest_summary(events).select(F.col("session_id.user_id").alias("session_id"), F.col("session_id.event_type").alias("key"), "version", "summary")


@query("""WITH f AS (SELECT user_id AS session_id, event_type AS key, min(event_id) AS first, max(event_id) AS seq, arg_max(props, event_id) AS value, arg_max(event_id % 10 / 10, event_id) AS confidence,
 arg_max(event_id % 3, event_id) AS sort_order FROM events GROUP BY 1, 2)
 SELECT session_id, key, seq, value, confidence, sort_order, row_number() OVER (PARTITION BY session_id ORDER BY sort_order, first) AS place FROM f""")
def upsert_facts(spark, sf_dir):
    n = F.col("event_id")
    facts = _t(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.lit("task").alias("memory_type"), F.col("event_type").alias("key"), F.col("props").alias("value"), (n % 10 / 10).alias("confidence"), (n % 3).alias("sort_order"), n.alias("seq")
    )
    return memory.upsert_facts(facts).select("session_id", "key", "seq", "value", "confidence", "sort_order", F.col("place").cast("long").alias("place"))


@query("""WITH m AS (SELECT user_id AS owner, user_id + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS session_id, CASE WHEN event_id % 3 = 0 THEN 'profile' ELSE 'fact' END AS memory_type, event_type AS key, props AS value, ts AS t,
  CASE WHEN event_id % 2 = 0 THEN event_id % 300 + 1 END AS ttl FROM events),
 r AS (SELECT *, row_number() OVER (PARTITION BY owner, memory_type, key ORDER BY t DESC, session_id DESC) AS rn FROM m WHERE session_id = owner)
 SELECT owner, memory_type, key, value, t::VARCHAR AS updated_at, (t + INTERVAL 1 DAY * coalesce(ttl, 90))::VARCHAR AS expires_at FROM r WHERE rn = 1""")
def upsert_memory(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    made = e.select(
        F.col("user_id").alias("owner"), (F.col("user_id") + (F.col("event_id") % 4 == 0).cast("long")).alias("session_id"), F.when(F.col("event_id") % 3 == 0, "profile").otherwise("fact").alias("memory_type"),
        F.col("event_type").alias("key"), F.col("props").alias("value"), F.col("ts").alias("at"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 300 + 1).alias("ttl_days"),
    )
    sessions = e.select(F.col("user_id").alias("session_id"), F.col("user_id").alias("owner")).distinct()
    return memory.upsert_memory(made, sessions).select("owner", "memory_type", "key", "value", _stamp("updated_at"), _stamp("expires_at"))


def _stamp(name):
    """A time as DuckDB prints it: without trailing zeros of the fraction."""
    return F.col(name).cast("timestamp_ntz").cast("string").alias(name)


@query("""WITH m AS (SELECT event_id AS memory_id, CASE WHEN event_type = 'error' THEN 'expired' ELSE 'active' END AS status, props AS value, event_id % 4 AS a, ts FROM events)
 SELECT memory_id, CASE WHEN status = 'active' AND a = 1 THEN 'deleted' ELSE status END AS status, CASE WHEN status = 'active' AND a = 0 THEN 'new' ELSE value END AS value,
 CASE WHEN status = 'active' AND a < 2 THEN ts + INTERVAL 1 DAY ELSE ts END::VARCHAR AS updated_at, CASE WHEN status = 'active' AND a = 0 THEN ts + INTERVAL 366 DAY ELSE ts + INTERVAL 90 DAY END::VARCHAR AS expires_at FROM m""")
def change_memories(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    day = lambda n: F.col("ts") + F.make_dt_interval(F.lit(n))
    made = e.select(F.col("event_id").alias("memory_id"), F.when(F.col("event_type") == "error", "expired").otherwise("active").alias("status"), F.col("props").alias("value"), F.col("ts").alias("updated_at"), day(90).alias("expires_at"))
    changes = e.where("event_id % 4 < 2").select(F.col("event_id").alias("memory_id"), F.when(F.col("event_id") % 4 == 0, "update").otherwise("delete").alias("action"), F.lit("new").alias("new_value"), day(1).alias("at"), F.lit(400).alias("ttl_days"))
    return memory.change_memories(made, changes).select("memory_id", "status", "value", _stamp("updated_at"), _stamp("expires_at"))


# Snapshots: a document is a chunk of kb lang, version doc_id % 3, deleted if doc_id % 10 = 9; 1 is active.
def _chunks(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    versions = docs.select(F.col("lang").alias("kb_id"), (F.col("doc_id") % 3).alias("version")).distinct().withColumn("status", F.when(F.col("version") == 1, "active").otherwise("superseded"))
    return docs.select(F.col("lang").alias("kb_id"), (F.col("doc_id") % 3).alias("version"), F.when(F.col("doc_id") % 10 == 9, F.lit("gone")).alias("deleted_at"), F.col("doc_id").alias("chunk_id"), "source", "text"), versions


@query("SELECT doc_id AS chunk_id, lang AS kb_id FROM documents WHERE doc_id % 3 = 1 AND doc_id % 10 <> 9 AND lang IS NOT NULL")
def active_snapshot(spark, sf_dir):
    return corpus.active_snapshot(*_chunks(spark, sf_dir)).select("chunk_id", "kb_id")


@query("SELECT doc_id AS chunk_id FROM documents WHERE lang = 'en' AND doc_id % 3 = 2 AND source = (SELECT min(source) FROM documents)")
def scope_filter(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)[0].withColumnRenamed("source", "scenario")
    least = chunks.agg(F.min("scenario").alias("scenario"))
    inside = retrieval.scope_filter(chunks, "en", 2)
    return inside.join(least, "scenario").select("chunk_id")


@query("SELECT DISTINCT source AS scenario FROM documents WHERE source <> ''")
def scenarios(spark, sf_dir):
    return corpus.scenarios(_t(spark, sf_dir, "documents").withColumnRenamed("source", "scenario"))


@query("""WITH c AS (SELECT doc_id, source FROM documents WHERE lang = 'en') SELECT doc_id AS chunk_id, source AS name, (SELECT count(*) FROM c) AS total FROM c ORDER BY source NULLS FIRST, doc_id % 50, doc_id LIMIT 40 OFFSET 20""")
def chunk_listing(spark, sf_dir):
    chunks = _t(spark, sf_dir, "documents").select(F.col("source").alias("name"), F.nullif(F.col("doc_id") % 50, F.lit(0)).alias("chunk_index"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("scenario"))
    page, total = corpus.chunk_listing(chunks, 40, 20, scenario="en")
    return page.select("chunk_id", "name").crossJoin(F.broadcast(total))  # one row


@query("""WITH c AS (SELECT doc_id, lang, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'p/' || source || '/' || doc_id % 3 END AS path, CASE WHEN doc_id % 8 = 0 THEN '' ELSE upper(source) END AS name FROM documents),
 k AS (SELECT *, coalesce(nullif(path, ''), nullif(name, ''), doc_id::VARCHAR) AS key FROM c)
 SELECT key, arg_min(path, doc_id) AS source_path, coalesce(arg_min(nullif(name, ''), doc_id), key) AS source_name, arg_min(coalesce(lang, ''), doc_id) AS scenario, count(*) AS chunk_count FROM k WHERE name <> '' OR path = '' GROUP BY 1""")
def source_listing(spark, sf_dir):
    n = F.col("doc_id")
    path = F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("p/"), "source", F.lit("/"), (n % 3).cast("string")))
    chunks = _t(spark, sf_dir, "documents").select(n.alias("pos"), n.alias("chunk_id"), path.alias("source_path"), F.when(n % 8 == 0, "").otherwise(F.upper("source")).alias("source_name"), F.lit(None).cast("string").alias("file_type"), F.col("lang").alias("scenario"))
    return corpus.document_listing(chunks).select("key", "source_path", "source_name", "scenario", "chunk_count")


@query("""SELECT event_id AS job_id, CASE event_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'completed' WHEN 2 THEN 'indexing' ELSE 'queued' END AS status, (event_id % 4 = 0)::INT AS retry_count,
 CASE WHEN event_id % 4 < 2 THEN ts WHEN event_id % 8 >= 4 THEN ts - INTERVAL 1 DAY END::VARCHAR AS finished_at FROM events""")
def advance_job(spark, sf_dir):
    """Half of the jobs have ended once before."""
    e, at = _t(spark, sf_dir, "events"), F.col("ts").cast("timestamp_ntz")
    ended = F.when(F.col("event_id") % 8 >= 4, at - F.make_dt_interval(F.lit(1)))
    jobs = e.select(F.col("event_id").alias("job_id"), F.lit("queued").alias("status"), F.lit(0).alias("retry_count"), ended.alias("finished_at"))
    new = F.element_at(F.array(F.lit("failed"), F.lit("completed"), F.lit("indexing")), (F.col("event_id") % 4 + 1).cast("int"))
    changes = e.where("event_id % 4 < 3").select(F.col("event_id").alias("job_id"), new.alias("new_status"), at.alias("at"))
    return corpus.advance_job(jobs, changes).select("job_id", "status", "retry_count", _stamp("finished_at"))


@query("""WITH d AS (SELECT source, doc_id FROM documents) SELECT count(*) FILTER (source IS NOT DISTINCT FROM m) AS deleted, count(DISTINCT source) FILTER (source <> m) AS remaining_documents FROM d, (SELECT min(source) AS m FROM documents)""")
def delete_document(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("source").alias("source_key"), "doc_id")
    least = docs.agg(F.min("source_key")).first()[0]  # the name that a user gives
    return corpus.delete_document(docs, least)[1]


@query("SELECT source AS source_root, source <> (SELECT min(source) FROM documents) AS found FROM documents WHERE source <> '' GROUP BY 1")
def retained_source_roots(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("source").alias("source_root"))
    least = docs.agg(F.min("source_root").alias("source_root"))
    return corpus.retained_source_roots(docs, docs.distinct().join(least, "source_root", "left_anti"))


@query("SELECT event_type || ' ' || user_id % 9 AS notice, min(event_id) AS first_pos FROM events WHERE event_id % 3 <> 0 GROUP BY 1")
def ingest_notices(spark, sf_dir):
    notice = F.when(F.col("event_id") % 3 != 0, F.concat_ws(" ", "event_type", (F.col("user_id") % 9).cast("string"))).otherwise(" ")
    return corpus.ingest_notices(_t(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), notice.alias("notice")))


_NEXT = """o AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'd' || doc_id END AS k, CASE WHEN doc_id % 13 = 0 THEN 'other' ELSE 'root' END AS r, text FROM documents WHERE doc_id % 5 <> 0),
n AS (SELECT doc_id, 'd' || doc_id AS k, CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0)"""


@query(f"""WITH {_NEXT} SELECT doc_id, k AS source_key, sha256(o.text) AS file_hash FROM o WHERE k = '' OR r = 'other' OR EXISTS (SELECT 1 FROM n WHERE n.k = o.k AND n.text = o.text)
 UNION ALL SELECT doc_id, k, sha256(n.text) FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k = n.k AND o.r = 'root' AND o.text = n.text)""")
def next_snapshot(spark, sf_dir):
    docs, key = _t(spark, sf_dir, "documents"), F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    old = docs.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 11 == 0, "").otherwise(key).alias("source_key"), F.when(F.col("doc_id") % 13 == 0, "other").otherwise("root").alias("source_root"), F.sha2("text", 256).alias("file_hash"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = docs.where("doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0").select("doc_id", key.alias("source_key"), F.lit("root").alias("source_root"), F.sha2(text, 256).alias("file_hash"))
    diff = corpus.diff_snapshot(old.where("source_root = 'root'"), new)
    return corpus.next_snapshot(old, new, diff, "root").select("doc_id", "source_key", "file_hash")


# Rankings of events: a user is a question, its events by value are the hits, clicks are expected.
_RANKED = "hits AS (SELECT user_id AS query_id, event_id AS chunk_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)"


def _ranked(spark, sf_dir):
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return _t(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"), "event_type", "value", rank.alias("rank"))


@query(f"""WITH {_RANKED}, x AS (SELECT query_id, count(*) FILTER (event_type = 'click' AND chunk_id % 5 = 0) AS n, count(*) FILTER (event_type = 'click' AND chunk_id % 5 = 0 AND rank <= 5) AS g,
 min(rank) FILTER (event_type = 'click' AND chunk_id % 5 = 0 AND rank <= 5) AS f FROM hits GROUP BY 1)
 SELECT query_id, CASE WHEN n > 0 THEN (g > 0)::INT END AS hit, CASE WHEN n > 0 THEN round(g / n, 4) END AS recall, CASE WHEN n > 0 THEN coalesce(round(1 / f, 4), 0) END AS mrr, CASE WHEN n > 0 THEN coalesce((f = 1)::INT, 0) END AS precision_1 FROM x""")
def online_metrics(spark, sf_dir):
    hits = _ranked(spark, sf_dir)
    expected = hits.groupBy("query_id").agg(F.collect_list(F.when((F.col("event_type") == "click") & (F.col("chunk_id") % 5 == 0), F.col("chunk_id"))).alias("expected"))
    return evaluation.online_metrics(hits.select("query_id", "chunk_id", "rank"), expected)


@query(f"WITH {_RANKED} SELECT query_id, sha256('q' || query_id) AS query_hash, 'bm25' AS backend, 3 AS top_k, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS result_ids FROM hits WHERE rank <= 3 GROUP BY 1")
def retrieval_log(spark, sf_dir):
    hits = _ranked(spark, sf_dir)
    questions = hits.select("query_id").distinct().withColumn("text", F.concat(F.lit("q"), F.col("query_id").cast("string")))
    return corpus.retrieval_log(hits, questions, "bm25", 3)


@query("SELECT event_type AS metric, round(avg(v), 4) AS mean, count(v) AS valid, round(count(v) / count(*), 4) AS coverage, count(v) = count(*) AS complete FROM (SELECT *, CASE WHEN event_id % 6 < 2 AND event_type <> 'view' THEN NULL ELSE event_id % 101 END AS v FROM events) GROUP BY 1")
def metric_report(spark, sf_dir):
    gap = (F.col("event_type") != "view") & (F.col("event_id") % 6 < 2)
    value = F.when(gap & (F.col("event_id") % 6 == 0), None).when(gap, float("nan")).otherwise((F.col("event_id") % 101).cast("double"))
    return evaluation.metric_report(_t(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), value.alias("value")))


@query("""SELECT m AS metric, CASE WHEN m = 'recall' THEN round(((2 * sum(doc_id % 7) FILTER (doc_id % 3 = 0) * 10000 + count(*) FILTER (doc_id % 3 = 0)) // (2 * count(*) FILTER (doc_id % 3 = 0)))::DOUBLE / 10000, 4) END AS mean,
 CASE WHEN m = 'recall' THEN count(*) FILTER (doc_id % 3 = 0) ELSE 0 END AS valid, CASE WHEN m = 'recall' THEN round(count(*) FILTER (doc_id % 3 = 0) / count(*), 4) ELSE 0 END AS coverage, false AS complete FROM documents, (VALUES ('faithfulness'), ('recall')) v(m) GROUP BY 1""")
def checkpoint_summary(spark, sf_dir):
    records = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"))
    metrics = spark.range(2).select(F.element_at(F.array(F.lit("faithfulness"), F.lit("recall")), (F.col("id") + 1).cast("int")).alias("metric"))
    scored = records.select("record_id", F.lit("recall").alias("metric"), F.when(F.col("record_id") % 3 == 0, (F.col("record_id") % 7).cast("double")).otherwise(float("nan")).alias("value"))
    return evaluation.checkpoint_summary(records, metrics, scored)


@query("""WITH c AS (SELECT conv_id, count(*) FILTER (turn % 2 = 0) AS old, count(*) AS n, max(turn) FILTER (turn % 2 = 1) AS newest FROM conversations GROUP BY 1),
 m AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE turn % 2 = 1)
 SELECT m.conv_id, turn, CASE WHEN m.conv_id % 5 = 0 THEN 0 ELSE old END + k AS revision, CASE WHEN m.conv_id % 5 = 0 THEN n - old ELSE n END AS after, newest AS updated_at FROM m JOIN c USING (conv_id)""")
def append_messages(spark, sf_dir):
    """The odd turns come to conversations of the even ones, of which every fifth isn't there yet."""
    turns = _t(spark, sf_dir, "conversations")
    there = turns.where("turn % 2 = 0 AND conv_id % 5 <> 0").groupBy("conv_id").agg(F.count("*").alias("revision"), F.lit(-1).cast("long").alias("updated_at"))
    after, told = conversation.append_messages(there, turns.where("turn % 2 = 1").select("conv_id", F.col("turn").alias("seq"), F.col("turn").alias("at")))
    return told.select("conv_id", F.col("seq").alias("turn"), "revision").join(after.select("conv_id", F.col("revision").alias("after"), "updated_at"), "conv_id")


@query(r"""WITH t AS (SELECT doc_id, sha256(unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[.,]', ' ', 'g'), '\s+'), lambda x: x <> ''))) AS d FROM documents),
 s AS (SELECT doc_id, (('0x' || substr(d, 1, 2))::INT % 16) AS ix, sum(CASE WHEN ('0x' || substr(d, 3, 2))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM t GROUP BY 1, 2 HAVING v <> 0)
 SELECT doc_id, ix, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 9) AS value FROM s""")
def hash_embed_small(spark, sf_dir):
    return retrieval.hash_embed_small(_t(spark, sf_dir, "documents"), "doc_id").select("doc_id", "ix", F.round("value", 9).alias("value"))


@query("""WITH d AS (SELECT doc_id, source, lang, md5(text) AS h FROM documents) SELECT * FROM (
 SELECT 'live_hash' AS rule, (SELECT count(*) FROM (SELECT 1 FROM d WHERE doc_id % 10 <> 9 GROUP BY lang, h HAVING count(*) > 1)) AS violations UNION ALL
 SELECT 'active_version', (SELECT count(*) FROM (SELECT 1 FROM d WHERE doc_id % 4 = 0 AND doc_id % 3 = 1 GROUP BY lang HAVING count(*) > 1)) UNION ALL SELECT 'version_status', (SELECT count(*) FROM d WHERE doc_id % 4 = 0 AND doc_id % 3 = 0) UNION ALL
 SELECT 'chunk_position', (SELECT count(*) FROM (SELECT 1 FROM d GROUP BY doc_id // 2, doc_id % 4 HAVING count(*) > 1)) UNION ALL SELECT 'waiting_job', (SELECT count(*) FROM (SELECT 1 FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id HAVING count(*) > 1)) UNION ALL
 SELECT 'active_fact', (SELECT count(*) FROM (SELECT 1 FROM events WHERE event_id % 7 = 0 GROUP BY user_id, event_type HAVING count(*) > 1)) UNION ALL
 SELECT 'active_memory', (SELECT count(*) FROM (SELECT 1 FROM events WHERE event_id % 11 = 0 GROUP BY user_id, event_type HAVING count(*) > 1)) UNION ALL SELECT 'chunk_document', (SELECT count(*) FROM d WHERE doc_id // 2 NOT IN (SELECT doc_id FROM d)))""")
def table_violations(spark, sf_dir):
    docs, e, n = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "events"), F.col("doc_id")
    documents = docs.select("doc_id", F.col("lang").alias("kb_id"), F.md5(F.col("text").cast("binary")).alias("file_hash"), F.when(n % 10 == 9, 1).alias("deleted_at"))
    versions = docs.where("doc_id % 4 = 0").select(F.col("lang").alias("kb_id"), n.alias("version"), F.element_at(F.array(F.lit("unknown"), F.lit("active"), F.lit("superseded")), (n % 3 + 1).cast("int")).alias("status"))
    chunks = docs.select(F.floor(n / 2).alias("doc_id"), F.lit(1).alias("version"), (n % 4).alias("position"))
    kinds = F.create_map(*[F.lit(x) for x in ("click", "queued", "view", "parsing")])
    jobs = e.select(F.col("user_id").alias("doc_id"), F.coalesce(kinds[F.col("event_type")], F.lit("failed")).alias("status"))
    facts = e.select(F.col("user_id").alias("session_id"), F.lit("task").alias("memory_type"), F.col("event_type").alias("key"), (F.col("event_id") % 7 == 0).alias("is_active"))
    memories = e.select(F.col("user_id").alias("owner"), F.lit("fact").alias("memory_type"), F.col("event_type").alias("key"), F.when(F.col("event_id") % 11 == 0, "active").otherwise("deleted").alias("status"))
    return corpus.table_violations(documents, versions, chunks, jobs, facts, memories)


@query("SELECT doc_id AS record_id, m AS metric FROM documents, (VALUES ('faithfulness'), ('recall')) v(m) WHERE NOT (doc_id % 3 = 0 AND m = 'recall')")
def checkpoint_pending(spark, sf_dir):
    records = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"))
    metrics = spark.range(2).select(F.element_at(F.array(F.lit("faithfulness"), F.lit("recall")), (F.col("id") + 1).cast("int")).alias("metric"))
    scored = records.select("record_id", F.lit("recall").alias("metric"), F.when(F.col("record_id") % 3 == 0, 1.0).otherwise(float("nan")).alias("value"))
    return evaluation.checkpoint_pending(records, metrics, scored)


@query(f"WITH {_RANKED} SELECT query_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS source_ids FROM hits WHERE query_id % 4 <> 0 AND rank <= 6 GROUP BY 1")
def answer_records(spark, sf_dir):
    hits = _ranked(spark, sf_dir).where("rank <= 6")
    questions = hits.select("query_id").distinct()
    return evaluation.answer_records(hits, questions, questions.where("query_id % 4 = 0"))


@query(f"""WITH {_RANKED} SELECT query_id, min(rank) FILTER (event_type = 'click' AND query_id % 2 = 1 OR event_type = 'view' AND query_id % 2 = 0 OR event_type = 'signup' AND chunk_id % 3 = 0) AS document_rank FROM hits GROUP BY 1""")
def document_rank(spark, sf_dir):
    """Names in folders and with extensions: a longer name, the expected one in capitals, a part of it, and one that only its extension or folder would match."""
    hits, kind = _ranked(spark, sf_dir), F.col("event_type")
    name = (
        F.when(kind == "click", "The Annual-Report 2024 (final).pdf").when(kind == "view", F.when(F.col("query_id") % 2 == 0, "docs/report 2024.v2.PDF").otherwise("annual report 2024/other.pdf"))
        .when(kind == "signup", F.when(F.col("chunk_id") % 3 == 0, "x/y/2024.txt").otherwise("notes.annual report 2024")).otherwise("-")
    )
    named = hits.select("query_id", name.alias("name"), "rank")
    expected = hits.select("query_id").distinct().withColumn("document", F.when(F.col("query_id") % 2 == 0, "Report 2024 v2 annual").otherwise("annual report 2024"))
    return evaluation.document_rank(named, expected)


@query("SELECT event_id, list_distinct(list_filter(list_transform(string_split(replace(CASE WHEN event_id % 2 = 0 THEN ' a1, b2;a1 ;; c' || event_id ELSE 's' || event_id END, ';', ','), ','), lambda x: trim(x)), lambda x: x <> '')).list_sort().array_to_string('|') AS ids FROM events")
def expected_ids(spark, sf_dir):
    key = F.col("event_id").cast("string")
    made = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" a1, b2;a1 ;; c"), key)).otherwise(" ").alias("plural"), F.concat(F.lit("s"), key).alias("single"))
    return made.select("event_id", F.array_join(F.array_sort(evaluation.parse_expected_ids(F.col("plural"), F.col("single"))), "|").alias("ids"))


@query("""WITH s AS (SELECT event_type, sum(round(value * 1000000000)::HUGEINT) AS t, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1)
 SELECT event_type, ((2 * t * 100 + n * 1000000000) // (2 * n * 1000000000))::DOUBLE / 100 AS mean_ms, round(p50, 2) AS p50_ms, round(p95, 2) AS p95_ms, round(p99, 2) AS p99_ms FROM s""")
def latency_summary(spark, sf_dir):
    return evaluation.latency_summary(_t(spark, sf_dir, "events"), ["event_type"], "value")


@query(f"""WITH {_RANKED}, a AS (SELECT query_id, chunk_id, value AS score FROM hits WHERE rank <= 9), b AS (SELECT query_id, chunk_id, (chunk_id % 17)::DOUBLE AS score FROM hits WHERE rank BETWEEN 4 AND 15),
 s AS (SELECT query_id, chunk_id, 0.4 * coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 1) AS x FROM a WINDOW w AS (PARTITION BY query_id)
 UNION ALL SELECT query_id, chunk_id, 0.6 * coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 1) FROM b WINDOW w AS (PARTITION BY query_id))
 SELECT query_id, chunk_id, round(sum(x), 9) AS score FROM s GROUP BY 1, 2""")
def weighted_fuse(spark, sf_dir):
    hits = _ranked(spark, sf_dir)
    dense = hits.where("rank <= 9").select("query_id", "chunk_id", F.col("value").alias("score"))
    sparse = hits.where("rank BETWEEN 4 AND 15").select("query_id", "chunk_id", (F.col("chunk_id") % 17).cast("double").alias("score"))
    return retrieval.weighted_fuse(dense, sparse).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@query(f"WITH {_RANKED} SELECT query_id, h.chunk_id, rank, e.props FROM hits h JOIN events e ON e.event_id = h.chunk_id AND e.event_id % 8 <> 0")
def hydrate(spark, sf_dir):
    chunks = _t(spark, sf_dir, "events").where("event_id % 8 <> 0").select(F.col("event_id").alias("chunk_id"), "props")
    return retrieval.hydrate(_ranked(spark, sf_dir).select("query_id", "chunk_id", "rank"), chunks)


@query(r"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS payload, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN event_id % 8 <> 2 ELSE true END AS flag,
 CASE WHEN event_id % 2 = 0 THEN 'q' || event_id || '|b|c' ELSE 'fallback' END AS queries, CASE WHEN event_id % 5 = 0 THEN event_id % 90 WHEN event_id % 5 = 1 THEN NULL ELSE event_id END AS page FROM events""")
def payloads_parsed(spark, sf_dir):
    e, key = _t(spark, sf_dir, "events"), F.col("event_id").cast("string")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("none { "), "props")).otherwise(F.concat(F.lit("Sure:\n"), "props", F.lit(" as asked")))
    word = F.element_at(F.array(F.lit(" Yes"), F.lit("NO "), F.when(F.col("event_id") % 8 == 2, "0.0").otherwise("2"), F.lit("perhaps")), (F.col("event_id") % 4 + 1).cast("int"))
    asked = F.when(F.col("event_id") % 2 == 0, F.array(F.concat(F.lit(" q"), key), F.lit(""), F.concat(F.lit("q"), key), F.lit("b"), F.lit("c "), F.lit("d")))
    said_page = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x\ny ##pAGE  "), (F.col("event_id") % 90).cast("string"), F.lit("\n## Page 400"))).otherwise("## Page seven")
    number = payloads.leading_int(F.concat(F.lit(" "), key, F.lit(" ff."))).cast("string")
    page = payloads.page_from_chunk(F.when(F.col("event_id") % 5 > 1, number).when(F.col("event_id") % 10 < 5, "iv"), said_page)
    return e.select(
        "event_id", payloads.parse_json_object(said).alias("payload"), payloads.coerce_bool(word, True).alias("flag"),
        F.array_join(payloads.normalize_queries(asked, F.lit("fallback")), "|").alias("queries"), page.alias("page"),
    )
