"""Operators on document and chunk tables: de-duplication, snapshots, versions, jobs and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.pages import COMPLEX_SHARE

# The quality that the fast parser's text must have, states of a waiting job, and states of a version.
LEAST_QUALITY = 0.6
WAITING = ("queued", "running", "uploading", "parsing", "embedding")
VERSION_STATES = ("building", "active", "superseded", "failed")


def drop_recurring_margin_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """lines (key, pos, line) without the short, unpunctuated lines that a document holds twice or more."""
    line = F.trim("line")
    candidate = (line != "") & (F.length(line) <= 80) & ~line.rlike(r"[.!?:;]$") & ~line.startswith("#") & ~F.contains(line, F.lit("|"))
    marked = lines.withColumn("_line", F.when(candidate, line))
    again = marked.where("_line IS NOT NULL").groupBy(key, "_line").count().where("count > 1").select(key, "_line")
    return marked.join(again, [key, "_line"], "left_anti").drop("_line")


def dedup_exact(chunks: DataFrame, source: str, pos: str, text: str = "text") -> DataFrame:
    """Of chunks of a source that are equal once normalised, the first by position. Keyed by digest, so only hashes and
    positions are combined and shuffled before the join back."""
    hashed = chunks.withColumn("_norm", F.sha2(T.normalize_for_dedup(F.col(text)), 256))
    first = hashed.groupBy(source, "_norm").agg(F.min(pos).alias(pos))
    return hashed.join(first, [source, "_norm", pos], "left_semi").drop("_norm")


def document_groups(chunks: DataFrame) -> DataFrame:
    """Y-01: documents (source_root, source_key) of chunks, with their least file_hash and number of chunks."""
    return chunks.groupBy("source_root", "source_key").agg(F.min("file_hash").alias("file_hash"), F.count("*").alias("n_chunks"))


def diff_snapshot(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(source_key, old_hash, new_hash, status) of two document tables (source_key, file_hash) of one root.

    skipped, updated, deleted or added; an added key that takes the hash of a vanished one, paired in key order, is
    moved, and the vanished one moved_away. Rows with an empty key take no part.
    """
    live = lambda df, name: df.where("source_key <> ''").select("source_key", F.col("file_hash").alias(name))
    both = live(existing, "old_hash").join(live(incoming, "new_hash"), "source_key", "full_outer")
    status = (
        F.when(F.col("old_hash") == F.col("new_hash"), "skipped")
        .when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "deleted")
        .otherwise("updated")
    )
    both = both.withColumn("status", status)
    side = lambda name, s: both.where(F.col("status") == s).select(
        F.col("source_key").alias(f"{s}_key"), F.col(name).alias("hash"), F.row_number().over(W.partitionBy(name).orderBy("source_key")).alias("rn")
    )
    moves = side("new_hash", "added").join(side("old_hash", "deleted"), ["hash", "rn"]).select("added_key", "deleted_key")
    moved = moves.select(F.col("added_key").alias("source_key"), F.lit("moved").alias("_s")).union(moves.select("deleted_key", F.lit("moved_away")))
    return both.join(moved, "source_key", "left").select("source_key", "old_hash", "new_hash", F.coalesce("_s", "status").alias("status"))


def next_snapshot(chunks: DataFrame, incoming: DataFrame, diff: DataFrame, root: str | None = None) -> DataFrame:
    """Y-04: old chunks (source_key, and source_root where `root` is given) that stay, and new chunks of what came. What is
    outside the root, or has an empty or null key, is untouched; inside it, chunks of skipped documents stay."""
    gone = diff.where("status NOT IN ('skipped', 'added', 'moved')").select("source_key")
    fresh = diff.where("status IN ('added', 'moved', 'updated')").select("source_key")
    inside = F.coalesce(F.col("source_key") != "", F.lit(False))
    if root is not None:
        inside = inside & F.coalesce(F.col("source_root") == root, F.lit(False))
    stay = chunks.where(~inside).unionByName(chunks.where(inside).join(gone, "source_key", "left_anti").select(chunks.columns))
    return stay.unionByName(incoming.join(fresh, "source_key", "left_semi").select(incoming.columns))


def delete_document(chunks: DataFrame, source: str, key: str = "source_key") -> tuple[DataFrame, DataFrame]:
    """Y-07: chunks without a source, and one row (deleted, remaining_documents); reading that row is an error where no chunk has
    the source."""
    hit = F.col(key).eqNullSafe(F.lit(source))
    counts = chunks.agg(F.count_if(hit).alias("deleted"), F.count_distinct(F.when(~hit, F.col(key))).alias("remaining_documents"))
    unknown = F.raise_error(F.lit(f"no chunk of {source!r}")).cast("long")
    return chunks.where(~hit), counts.withColumn("deleted", F.when(F.col("deleted") == 0, unknown).otherwise(F.col("deleted")))


def retained_source_roots(chunks: DataFrame, available: DataFrame) -> DataFrame:
    """Y-08: (source_root, found) of the distinct filled roots of chunks: all must be among those available."""
    roots = chunks.where("source_root <> ''").select("source_root").distinct()
    there = available.select("source_root", F.lit(True).alias("found")).distinct()
    return roots.join(there, "source_root", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def ingest_notices(notices: DataFrame) -> DataFrame:
    """Y-09: (notice, first_pos) of notices (pos, notice): distinct filled ones, to be read in the order of first_pos."""
    return notices.where("trim(notice) <> ''").groupBy("notice").agg(F.min("pos").alias("first_pos"))


def active_snapshot(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """T-04: chunks (kb_id, version, deleted_at, ...) of the active version of each kb (versions: kb_id, version, status)."""
    active = versions.where("status = 'active'").select("kb_id", "version")
    return chunks.where("deleted_at IS NULL").join(active, ["kb_id", "version"], "left_semi")


def advance_job(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """T-08: jobs (job_id, status, retry_count, finished_at) after changes (job_id, new_status, at): completed, failed and
    cancelled ones get the time as their end, all others keep the end that they have; one retry more for a failed one."""
    ended = F.col("new_status").isin("completed", "failed", "cancelled")
    both = jobs.join(changes, "job_id", "left")
    return both.select(
        "job_id", F.coalesce("new_status", "status").alias("status"), (F.col("retry_count") + F.coalesce((F.col("new_status") == "failed").cast("int"), F.lit(0))).alias("retry_count"),
        F.when(ended, F.col("at")).otherwise(F.col("finished_at")).alias("finished_at"),
    )


def chunk_listing(chunks: DataFrame, limit: int, offset: int = 0, scenario: str | None = None, source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """T-10: a page of chunks (name, chunk_index, chunk_id, ...) by name, index (null as 0) and id, a top-k report, and one row
    (total) of all of them; of one scenario or source_path if given."""
    for column, value in (("scenario", scenario), ("source_path", source)):
        chunks = chunks.where(F.col(column) == value) if value else chunks
    return chunks.orderBy("name", F.coalesce("chunk_index", F.lit(0)), "chunk_id").offset(offset).limit(limit), chunks.agg(F.count("*").alias("total"))


def scenarios(chunks: DataFrame) -> DataFrame:
    """T-11: the distinct filled scenarios."""
    return chunks.where("scenario <> ''").select("scenario").distinct()


def retrieval_log(hits: DataFrame, questions: DataFrame, backend: str, top_k: int) -> DataFrame:
    """T-12: one row (query_id, query_hash, backend, top_k, result_ids) for each question (query_id, text), with the ids of
    its hits (query_id, chunk_id, rank) in the order of their rank."""
    listed = hits.where(F.col("rank") <= top_k).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).alias("r"))
    ids = F.coalesce(F.array_join(F.transform("r", lambda x: x["chunk_id"].cast("string")), ","), F.lit(""))
    return questions.join(listed, "query_id", "left").select("query_id", F.sha2("text", 256).alias("query_hash"), F.lit(backend).alias("backend"), F.lit(top_k).alias("top_k"), ids.alias("result_ids"))


def parser_cache_key(file_hash, parser, version):
    """K-10: digest of the canonical JSON of what a parser's result depends on."""
    return F.sha2(F.to_json(F.struct(F.col(file_hash).alias("file_hash"), F.col(parser).alias("parser"), F.col(version).alias("version"))), 256)


def change_counts(diff: DataFrame) -> DataFrame:
    names = ("added", "updated", "skipped", "deleted", "moved")
    counts = diff.agg(*[F.count_if(F.col("status") == n).alias(n) for n in names])
    return counts.withColumn("changed", F.col("added") + F.col("updated") + F.col("deleted") + F.col("moved"))


def append_uploads(existing: DataFrame, incoming: DataFrame, pos: str) -> DataFrame:
    """Incoming documents whose hash is neither there already nor earlier in the batch."""
    first = incoming.groupBy("file_hash").agg(F.min(pos).alias(pos))
    return incoming.join(existing.select("file_hash"), "file_hash", "left_anti").join(first, ["file_hash", pos], "left_semi")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], keep_old_if_null: tuple[str, ...] = (), as_of=None) -> DataFrame:
    """T-01, T-02: target with rows of updates put in its place by key; in the named columns a null keeps the old value.

    With as_of, rows that are put in are live and fresh: their deleted_at is null and their updated_at is as_of, and updates need neither.
    """
    if as_of is not None:
        stamp = F.lit(as_of).cast(target.schema["updated_at"].dataType)
        updates = updates.withColumns({"deleted_at": F.lit(None).cast(target.schema["deleted_at"].dataType), "updated_at": stamp})
    rest = [c for c in target.columns if c not in keys]
    new = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in rest], F.lit(True).alias("_hit"))
    value = lambda c: F.coalesce(f"_new_{c}", c) if c in keep_old_if_null else F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c))
    return target.join(new, keys, "full_outer").select(*keys, *[value(c).alias(c) for c in rest])


def activate_version(versions: DataFrame, version: str, kb: str | None = None) -> DataFrame:
    """T-03: `version` becomes active, what was active before superseded; the rest, also of other bases where `kb` is given,
    stays as it is."""
    ours = F.lit(True) if kb is None else F.col("kb_id").eqNullSafe(F.lit(kb))
    status = F.when(F.col("version") == version, "active").when(F.col("status") == "active", "superseded").otherwise(F.col("status"))
    return versions.withColumn("status", F.when(ours, status).otherwise(F.col("status")))


def expire_stale_jobs(jobs: DataFrame, as_of, seconds: int = 1800) -> DataFrame:
    """Active jobs without an update for `seconds` fail, with one retry more and an end time."""
    as_of = F.lit(as_of).cast("timestamp")
    stale = F.col("active") & (F.unix_micros("updated_at") < F.unix_micros(as_of) - seconds * 1_000_000)
    return jobs.withColumns(
        {
            "status": F.when(stale, "failed").otherwise(F.col("status")),
            "retry_count": F.col("retry_count") + stale.cast("int"),
            "finished_at": F.when(stale, as_of).otherwise(F.col("finished_at")),
        }
    )


def document_listing(chunks: DataFrame, scenario: str | None = None, name: str | None = None) -> DataFrame:
    """T-09: (key, source_path, source_name, file_type, scenario, chunk_count), a row for each source of chunks (pos, chunk_id, source_path,
    source_name, file_type, scenario), by name and path whatever their case.

    A source is told by its path, without one by its name, without either by the chunk's id; the other columns are those of its first chunk by pos, and
    the name that key where it is empty. scenario keeps the chunks of one scenario, name the sources whose name holds it in any case.
    """
    filled = lambda c: F.coalesce(c, F.lit(""))
    rows = chunks if not scenario else chunks.where(F.col("scenario") == scenario)
    key = F.coalesce(F.nullif("source_path", F.lit("")), F.nullif("source_name", F.lit("")), F.col("chunk_id").cast("string"))
    first = F.struct(filled("source_path").alias("source_path"), F.nullif(filled("source_name"), F.lit("")).alias("source_name"), filled("file_type").alias("file_type"), filled("scenario").alias("scenario"))
    listed = rows.withColumn("key", key).groupBy("key").agg(F.min_by(first, F.struct("pos", "chunk_id")).alias("f"), F.count("*").alias("chunk_count"))
    listed = listed.select("key", "f.source_path", F.coalesce("f.source_name", "key").alias("source_name"), "f.file_type", "f.scenario", "chunk_count")
    listed = listed if not name else listed.where(F.contains(F.lower("source_name"), F.lit(name.lower())))
    return listed.orderBy(F.lower("source_name"), F.lower("source_path"))


def snapshot_revision(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """K-09: one digest of all rows, whatever their order: row digests are folded by two hex digits, then over the folds."""
    row = chunks.select(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]), 256).alias("d"))
    # Sums of 60-bit pieces are order-independent and combine before the shuffle: no row ever holds all digests.
    piece = lambda i: F.sum(F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    folds = row.groupBy(F.substring("d", 1, 2).alias("b")).agg(F.concat_ws(".", *[piece(i) for i in range(8)]).alias("f"))
    return folds.agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "b", "f")))), 256).alias("revision"))


def document_routes(pages: DataFrame, key: str, quality: DataFrame | None = None, fallback: bool = True) -> DataFrame:
    """C-17: (key, pages, complex_pages, parser) of page routes: over 35% of pages that aren't simple need the complex parser.

    With quality (key, quality) of the text that the fast parser gives: fallback_used says that this is under 0.6, and if fallback is on, parser is complex then.
    """
    hard = F.col("route") != "simple_text"
    share = F.avg(hard.cast("int"))
    routes = pages.groupBy(key).agg(F.count("*").alias("pages"), F.count_if(hard).alias("complex_pages"), F.when(share > COMPLEX_SHARE, "complex").otherwise("fast").alias("parser"))
    if quality is None:
        return routes
    low = (F.col("parser") == "fast") & F.coalesce(F.col("quality") < LEAST_QUALITY, F.lit(False)) & F.lit(fallback)
    routes = routes.join(quality.select(key, "quality"), key, "left").withColumn("fallback_used", low)
    return routes.withColumn("parser", F.when(F.col("fallback_used"), "complex").otherwise(F.col("parser"))).drop("quality")


def active_job(jobs: DataFrame, job_id: str) -> DataFrame:
    """(doc_id, job) of the earliest active job of each document, ties by id."""
    return jobs.where("active").groupBy("doc_id").agg(F.min(F.struct("created_at", job_id)).alias("_job")).select("doc_id", f"_job.{job_id}")


def consistency(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(key, chunks, vectors, ok): ok where both sides hold as many rows and no document failed or is in work."""
    bad = F.count_if(F.col("status").isin("failed", "parsing", "indexing"))
    left = chunks.groupBy(key).agg(F.count("*").alias("chunks"), bad.alias("_bad"))
    both = left.join(vectors.groupBy(key).agg(F.count("*").alias("vectors")), key, "full_outer").na.fill(0, ["chunks", "vectors", "_bad"])
    return both.select(key, "chunks", "vectors", ((F.col("chunks") == F.col("vectors")) & (F.col("_bad") == 0)).alias("ok"))


def _violations(rows: DataFrame, rule: str) -> DataFrame:
    return rows.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def duplicate_keys(rows: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Number of keys that more than one row has."""
    return _violations(rows.groupBy(*keys).count().where("count > 1"), rule)


def orphans(rows: DataFrame, parents: DataFrame, key: str, rule: str) -> DataFrame:
    return _violations(rows.join(parents.select(key), key, "left_anti"), rule)


def failing(rows: DataFrame, check, rule: str) -> DataFrame:
    """Number of rows for which a check is false or null."""
    return _violations(rows.where(~F.coalesce(check, F.lit(False))), rule)


def table_violations(documents: DataFrame, versions: DataFrame, chunks: DataFrame, jobs: DataFrame, facts: DataFrame, memories: DataFrame) -> DataFrame:
    """T-14: (rule, violations) of the tables' rules: one live document (kb_id, file_hash, deleted_at) for each hash of a base, one active version
    (kb_id, version, status) of a base and known states, one chunk (doc_id, version, position) for each place, one waiting job (doc_id, status) of a
    document, one active fact (session_id, memory_type, key, is_active) and memory (owner, memory_type, key, status) for each key, and a document for each chunk."""
    waiting = jobs.where(F.col("status").isin(*WAITING))
    parts = [
        duplicate_keys(documents.where("deleted_at IS NULL"), ["kb_id", "file_hash"], "live_hash"), duplicate_keys(versions.where("status = 'active'"), ["kb_id"], "active_version"),
        failing(versions, F.col("status").isin(*VERSION_STATES), "version_status"), duplicate_keys(chunks, ["doc_id", "version", "position"], "chunk_position"), duplicate_keys(waiting, ["doc_id"], "waiting_job"),
        duplicate_keys(facts.where("is_active"), ["session_id", "memory_type", "key"], "active_fact"), duplicate_keys(memories.where("status = 'active'"), ["owner", "memory_type", "key"], "active_memory"),
        orphans(chunks, documents, "doc_id", "chunk_document"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def memo_join(requests: DataFrame, memo: DataFrame, as_of, seconds: int) -> tuple[DataFrame, DataFrame]:
    """Requests (digest, revision) answered by a memo (digest, revision, created_at, result) of the same revision and of
    less than `seconds` of age, and those that none answers."""
    fresh = memo.where(F.unix_micros("created_at") > F.unix_micros(F.lit(as_of).cast("timestamp")) - seconds * 1_000_000)
    latest = fresh.groupBy("digest", "revision").agg(F.max_by("result", "created_at").alias("result"))
    return requests.join(latest, ["digest", "revision"]), requests.join(latest, ["digest", "revision"], "left_anti")
