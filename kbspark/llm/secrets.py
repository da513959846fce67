"""Secret scans with corpus-wide ownership frequency of the candidates found."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Kinds in the order in which spans at one start are listed; each pattern, the group to measure and its least length.
KINDS = (
    ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),  # a run found from its first character is found whole
)
ORDER = [k for k, *_ in KINDS] + ["reused"]
#: What can be another copy of a candidate: runs of its alphabet and their pieces between these signs, trimmed of signs at
#: both ends, of the least length that a base value has.
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
PIECE = re.compile(r"[A-Za-z0-9+_-]{6,}")
SIGNS, LEAST = "+/_.=-", 6
#: Bits of the map of candidates (4 MB, whatever the data): a run is looked up only if its bit is set.
MARKS = 1 << 25

_SPAN = "struct<kind:string,start:long,end:long,hash:string,wordlike:boolean>"


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the fixed patterns: per kind leftmost, non-overlapping, failing matches dropped."""
    found = []
    for kind, pattern, group, least in KINDS:
        found += [(kind, m.start(), m.end(), m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found, key=lambda s: (s[1], ORDER.index(s[0])))


def _bare(value: str) -> str:
    """Values that differ in signs at their ends alone, such as a full stop, are one."""
    return value.strip(SIGNS) or value


def _digest(value: str) -> str:
    return hashlib.sha256(_bare(value).encode()).hexdigest()[:32]


def _mark(value: str) -> int:
    return zlib.crc32(value.encode()) % MARKS


def runs(text: str, marks: bytes | None = None) -> list[tuple[int, int, str]]:
    """(start, end, value) of the runs that can be bare copies of a candidate, and of their pieces, without repeats.

    With marks, a map of bits, only those whose bit is set.
    """
    found = []
    for m in TOKEN.finditer(text):
        at, whole = m.start(), m[0]
        spots = (m.span(),) if whole.isalnum() else dict.fromkeys([m.span(), *((at + p.start(), at + p.end()) for p in PIECE.finditer(whole))])
        for a, b in spots:
            value = text[a:b]
            a += len(value) - len(value.lstrip(SIGNS))
            value = value.strip(SIGNS)
            if len(value) < LEAST or (a, a + len(value), value) in found[-1:]:
                continue
            if marks is None or marks[(bit := _mark(value)) >> 3] >> (bit & 7) & 1:
                found.append((a, a + len(value), value))
    return found


def _marked(batches):
    """The bits of the base values of a partition, each once."""
    bits = set()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            bits.update(_mark(v) for *_, value in base_spans(text or "") if len(v := _bare(value)) >= LEAST)
    bits = list(bits)
    for i in range(0, len(bits), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(bits[i : i + 100_000], pa.int64())], ["bit"])


def marks(docs: DataFrame) -> bytes:
    """The map of bits of all candidates of docs (text): of fixed size, as it may let through runs that are none."""
    bits = docs.select("text").mapInArrow(_marked, "bit long")
    pages = bits.groupBy(F.shiftright("bit", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767).cast("long"))).alias("map"))
    out = bytearray(MARKS // 8)
    for r in pages.collect():  # at most MARKS / 32768 rows of 4096 bytes
        out[r["page"] * 4096 : (r["page"] + 1) * 4096] = r["map"]
    return bytes(out)


def _scan(marks: bytes):
    """For each document its base spans, and the other runs that could be copies of a candidate."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string()), ("wordlike", pa.bool_())])

    def row(kind: str, a: int, b: int, value: str) -> dict:
        value = _bare(value)
        wordlike = len(value) < 8 or value.isalpha() or not any(c.isalpha() for c in value)
        return {"kind": kind, "start": a, "end": b, "hash": _digest(value), "wordlike": wordlike}

    def run(batches):
        for batch in batches:
            spans, others = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans.append([row(*s) for s in base])
                # The base spans overlap a run if one that starts before its end reaches beyond its start.
                starts, reach = [a for _, a, _, _ in base], list(accumulate((b for _, _, b, _ in base), max))
                free = ((a, b, v) for a, b, v in runs(text, marks) if not (i := bisect_left(starts, b)) or reach[i - 1] <= a)
                others.append([row("reused", *s) for s in free])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(range(len(spans)), pa.int64()), pa.array(spans, pa.list_(span)), pa.array(others, pa.list_(span))],
                ["doc_id", "owner", "n", "base", "others"],
            )

    return run


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, repositories, owners) of candidates (hash, doc_id, owner): distinct documents and sources that hold it.

    Distinct pairs are made first, with partial aggregation, so a candidate copied into a third of all rows is summed
    where it lies; no group is gathered.
    """
    repos = candidates.groupBy("hash", "doc_id").agg(F.min("owner").alias("owner"))
    repos = repos.groupBy("hash").agg(F.count("*").alias("repositories"))
    owners = candidates.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    return repos.join(owners, "hash")


def find_secrets(docs: DataFrame, example_owners: int = 3, example_repositories: int = 100) -> DataFrame:
    """(row_id, doc_id, base, spans) for every row of docs (doc_id, source, text).

    base and spans are arrays of (kind, start, end, hash, repositories, owners, verdict). Of each candidate's hash the
    distinct repositories (documents) and owners (sources; a null one is an owner of its own) are counted over the
    corpus, where a pattern of `KINDS` finds it. A candidate with `example_owners` or more owners is a widely copied
    "example", any other "live": specific to few owners. A value that could be a word (under 8 characters, or without a
    digit or a letter) is an example also if all its copies, bare ones too, have so many owners or stand in
    `example_repositories` or more documents: so frequency tells words and credentials apart. The method adds, as kind
    "reused", all runs elsewhere, or pieces of runs between `.`, `/` and `=`, that equal a live candidate's value of 6
    characters or more without a pattern of their own around them (signs at the ends don't count); base spans always
    stay. Null and empty texts have no span, and repeated rows are kept apart. Only spans and hashes leave the scan,
    never texts: of the runs, those whose bit is set in the map of candidates, which are then joined by hash.
    """
    ids = docs.select("doc_id", "text", F.col("source").alias("owner"))
    schema = ids.select("doc_id", "owner").schema
    scanned = docs.sparkSession.createDataFrame([], schema).withColumn("n", F.lit(0).cast("long"))
    scanned = scanned.withColumn("base", F.lit(None).cast(f"array<{_SPAN}>")).withColumn("others", F.lit(None).cast(f"array<{_SPAN}>"))
    scanned = ids.mapInArrow(_scan(marks(docs)), scanned.schema)
    scanned = scanned.withColumn("row_id", F.concat_ws("-", F.spark_partition_id(), F.monotonically_increasing_id(), "n")).drop("n")
    scanned = common.materialize(scanned, "scan")

    def spread(column: str) -> DataFrame:
        return scanned.select("row_id", "doc_id", F.coalesce("owner", F.lit("\0")).alias("owner"), F.explode(column).alias("s")).select("row_id", "doc_id", "owner", "s.*")

    base, others = spread("base"), spread("others")
    owned = ownership(base.select("hash", "doc_id", "owner"))
    words = base.unionByName(others).where("wordlike").select("hash", "doc_id", "owner")
    held = ownership(words).select("hash", F.col("repositories").alias("held_by"), F.col("owners").alias("held_in"))
    owned = owned.join(held, "hash", "left")
    common_word = (F.col("held_in") >= example_owners) | (F.col("held_by") >= example_repositories)
    verdict = F.when((F.col("owners") >= example_owners) | F.coalesce(common_word, F.lit(False)), "example").otherwise("live")
    owned = common.materialize(owned.select("hash", "repositories", "owners", verdict.alias("verdict")), "owned")
    known = base.join(owned, "hash")
    added = others.join(owned.where("verdict = 'live'"), "hash")
    spans = known.withColumn("is_base", F.lit(True)).unionByName(added.withColumn("is_base", F.lit(False)))
    place = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("kind"))
    item = F.struct("start", place.alias("place"), "end", "kind", "hash", "repositories", "owners", "verdict", "is_base")
    per_row = spans.groupBy("row_id").agg(F.sort_array(F.collect_list(item)).alias("all"))
    none = F.array().cast(per_row.schema["all"].dataType)
    out = scanned.select("row_id", "doc_id").join(per_row, "row_id", "left").withColumn("spans", F.coalesce("all", none))
    return out.select("row_id", "doc_id", F.filter("spans", lambda s: s["is_base"]).alias("base"), "spans")


def listed(spans) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """docs with every live span replaced by `mark` (and n_chars counted anew where there is such a column).

    Overlapping spans are replaced as one. Widely copied examples stay, as do documents without a live span. Texts are
    found again by 128 bits of hash of the row, so equal rows are treated alike, and no copy of the texts is written; the
    places to cut are a written table, which Spark broadcasts only if its size is below the session's bound. Null texts
    stay null; extra columns of any name stay as they are.
    """
    row, cuts = (next(n for k in range(len(docs.columns) + 1) if (n := f"{c}{k}") not in docs.columns) for c in ("row", "cuts"))
    parts = [p for c in ("doc_id", "source", "text") for p in (F.col(c).isNull(), F.col(c))]
    tagged = docs.withColumn(row, F.concat_ws(":", F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)))
    spans = find_secrets(tagged.select(F.col(row).alias("doc_id"), "source", "text"))
    live = F.filter("spans", lambda s: s["verdict"] == "live")
    live = F.transform(live, lambda s: F.struct(s["start"], s["end"]))
    hits = spans.select(F.col("doc_id").alias(row), live.alias(cuts)).where(F.size(cuts) > 0).dropDuplicates([row])
    hits = common.materialize(hits, "cuts")

    def run(batches):
        for batch in batches:
            names = batch.schema.names[:-1]
            texts, found = batch.column(names.index("text")).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            sizes = batch.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
            for i, places in enumerate(found):
                if not places:
                    continue
                out, upto = [], 0
                for cut in places:
                    a, b = cut["start"], cut["end"]
                    if a >= upto:
                        out += [texts[i][upto:a], mark]
                    upto = max(upto, b)
                texts[i] = "".join(out) + texts[i][upto:]
                if sizes:
                    sizes[i] = len(texts[i])
            columns = batch.columns[:-1]
            columns[names.index("text")] = pa.array(texts, pa.string())
            if sizes is not None:
                columns[names.index("n_chars")] = pa.array(sizes, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return tagged.join(hits, row, "left").drop(row).select(*docs.columns, cuts).mapInArrow(run, docs.schema)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its base spans counted by kind and digested, and all spans. Null and empty texts have
    none, repeated rows and null ids a row each, and an empty table no row."""
    found = find_secrets(common.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
