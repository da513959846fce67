"""WARC archives with a two-level capture index: reversed-host keys in sorted, compressed blocks under a directory."""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import math
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

REVISIT_BYTES = 1000
BLOCK_LINES = 1000
#: Closes a record of 16 MB or more, whose own last byte (the top of its size) isn't zero.
_EMPTY = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
_ID = "urn:page:"


def surt(url: Column) -> Column:
    """Sort key of a URL: host labels reversed and comma-joined, then `)` and the path and query; no scheme, port,
    user, fragment or leading www."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^[^@]*@|:\d*$|^www\.", "")
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.concat(labels, F.lit(")"), F.regexp_replace(rest, r"^[^/?]*", ""))


def capture_key(url: Column, page_id: Column) -> Column:
    """surt, then the page: what captures are sorted by."""
    return F.concat_ws(" ", F.regexp_replace(surt(url), r"\s", "%20"), F.coalesce(F.lpad(page_id.cast("string"), 20, "0"), F.lit("~")))


def _packed(batches):
    """Size, digest and compressed payload of each page. Of pages of a batch with one payload, only that with the largest
    page_id can be the response: the others go on without it."""
    for batch in batches:
        ids, urls, htmls = (batch.column(i).to_pylist() for i in range(3))
        payloads = [(h or "").encode() for h in htmls]
        digests = [hashlib.sha1(p).hexdigest() for p in payloads]
        first: dict[str, int] = {}
        for i, d in zip(ids, digests):
            if i is not None:
                first[d] = max(i, first.get(d, i))
        need = [len(p) < REVISIT_BYTES or d not in first or i == first[d] for i, p, d in zip(ids, payloads, digests)]
        packed = [zlib.compress(p, 1) if n else None for p, n in zip(payloads, need)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(map(len, payloads), pa.int64()), pa.array(digests, pa.string()), pa.array(packed, pa.binary())],
            ["page_id", "url", "size", "digest", "packed"],
        )


def _members(batches):
    """Each record as a gzip member of its own, without its last byte, a zero, which the writer adds."""
    for batch in batches:
        out = []
        for page_id, url, size, digest, packed, first in zip(*(c.to_pylist() for c in batch.columns)):
            revisit = first is not None and page_id != first
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
            block = http if revisit else http + zlib.decompress(packed)
            head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>"]
            head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {re.sub(r'[\s]', '%20', url or '')}", f"WARC-Payload-Digest: sha1:{digest}"]
            if revisit:
                head += [f"WARC-Refers-To: <{_ID}{first}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
            head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
            member = gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", 6, mtime=0)
            out.append((member if member[-1] == 0 else member + _EMPTY)[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of pages (page_id, url, html) under path, one for each partition, by Spark's own writer, so lost tasks
    leave no half-written file. Every record is a gzip member, so that it can be read by its range.

    Payloads travel compressed to the join that finds what they revisit; a payload that many pages share is dropped
    before it, but for one page of each batch.
    """
    packed = pages.select("page_id", "url", "html").mapInArrow(_packed, "page_id long, url string, size long, digest string, packed binary")
    digests = pages.select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).where(F.octet_length("payload") >= REVISIT_BYTES)
    same = digests.groupBy(F.sha1("payload").alias("digest")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    joined = packed.join(same.drop("n"), "digest", "left").select("page_id", "url", "size", "digest", "packed", "first")
    joined.mapInArrow(_members, "record binary").select(F.col("record").cast("string")).write.option("lineSep", "\0").text(path)


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return system.open_input_file(inner)


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return dict(x.split(": ", 1) for x in lines[1:] if ": " in x)


def _page(value: str | None) -> int | None:
    number = (value or "").removeprefix(f"<{_ID}").removesuffix(">")
    return int(number) if number else None


_CAPTURE = "page_id long, url string, type string, digest string, refers long, path string, offset long, length long"


def _member(read, at: int, keep: int) -> tuple[bytes, int]:
    """(first `keep` bytes of the record that begins at `at`, place after it); read(place, size) gives compressed bytes.

    A record is a member, and may be followed by an empty one."""
    inflate, head, place, data = zlib.decompressobj(31), [], at, b""
    size = 0
    while not inflate.eof:
        if not data:
            data = read(place, 1 << 16)
            place += len(data)
        piece = inflate.decompress(data, 1 << 20)
        data = inflate.unconsumed_tail
        if size < keep:
            head.append(piece[: keep - size])
        size += len(piece)
    end = place - len(inflate.unused_data)
    if read(end, len(_EMPTY)) == _EMPTY:
        end += len(_EMPTY)
    return b"".join(head), end


def _captures(batches):
    """What an archive holds, from its headers; a file is read in pieces of bounded size."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with _open(path) as f:
                size, rows, at, held = f.size(), [], 0, (0, b"")

                def read(place: int, n: int) -> bytes:
                    nonlocal held
                    start, data = held
                    if not start <= place or place + min(n, size - place) > start + len(data):
                        held = start, data = place, f.read_at(min(max(n, 1 << 20), size - place), place)
                    return data[place - start : place - start + n]

                while at < size:
                    keep = 1 << 14
                    while (end := (head := _member(read, at, keep))[0].find(b"\r\n\r\n")) < 0:
                        keep *= 4
                    fields = parse_head(head[0][:end])
                    rows.append(
                        {"page_id": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "type": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers": _page(fields.get("WARC-Refers-To")), "path": path, "offset": at, "length": head[1] - at}
                    )
                    at = head[1]
                    if len(rows) == 5000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(n, kinds[t]) for n, t in (x.split() for x in _CAPTURE.split(", "))]))


def captures(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    n = max(1, files.count())
    return files.select("path").repartition(min(n, 10_000), "path").mapInArrow(_captures, _CAPTURE)


def _blocks(batches):
    """Sorted captures in compressed blocks of lines, each with its first and last key."""

    def pack(lines, no):
        data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
        return pa.RecordBatch.from_pylist([{"no": no, "first": lines[0][0], "last": lines[-1][0], "data": data}], pa.schema([("no", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("data", pa.binary())]))

    lines, no = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            lines.append(row)
            if len(lines) == BLOCK_LINES:
                yield pack(lines, no)
                lines, no = [], no + 1
    if lines:
        yield pack(lines, no)


def build_index(found: DataFrame, path: str) -> None:
    """Blocks (part, no, first, last, data) under path, partitioned by range of the key.

    Parts and the lines of a part both grow with the square root of the captures (from 16 blocks a part on), so neither
    the top of the directory nor a part's own directory is ever large.
    """
    n = found.count()
    parts = max(1, n // max(16 * BLOCK_LINES, 4 * math.isqrt(n)))
    keyed = found.select(capture_key(F.col("url"), F.col("page_id")).alias("key"), "page_id", "type", "digest", "refers", "path", "offset", "length")
    keyed = keyed.repartitionByRange(parts, "key").sortWithinPartitions("key")
    keyed.mapInArrow(_blocks, "no int, first string, last string, data binary").withColumn("part", F.spark_partition_id()).write.parquet(path)


def _search(key, wanted: pa.Table, blocks: pa.Table) -> pa.Table:
    """Captures with the wanted keys: binary search in the part's directory, then in the blocks that it names."""
    rows: list[dict] = []
    order = sorted(blocks.select(["no", "first", "last", "data"]).to_pylist(), key=lambda b: b["no"])
    lasts = [b["last"] for b in order]
    opened: dict[int, list] = {}
    for want in sorted(set(wanted.column("key").to_pylist())):
        i = bisect.bisect_left(lasts, want)
        while i < len(order) and order[i]["first"] <= want:
            if i not in opened:
                opened = {i: [json.loads(x) for x in zlib.decompress(order[i]["data"]).decode().split("\n")]}
            lines = opened[i]
            j = bisect.bisect_left(lines, want, key=lambda x: x[0])
            while j < len(lines) and lines[j][0] == want:
                rows.append(dict(zip(("url", "page_id", "type", "digest", "refers", "path", "offset", "length"), lines[j])))
                j += 1
            i += 1
    return pa.Table.from_batches([_batch(rows)])


def lookup(keys: DataFrame, index: str) -> DataFrame:
    """Captures (url holds the key) of the index whose key is in keys (key).

    The top of the directory, the last key of each part, goes to every task: its entries are at most a quarter of the
    square root of the captures. A part brings its block directory and compressed blocks.
    """
    spark = keys.sparkSession
    blocks = spark.read.parquet(index)
    tops = {r["part"]: r["last"] for r in sorted(blocks.groupBy("part").agg(F.max("last").alias("last")).collect())}  # bounded, see above

    def place(batches):
        numbers, lasts = list(tops), list(tops.values())
        for batch in batches:
            found = batch.column(0).to_pylist()
            at = [bisect.bisect_left(lasts, k) for k in found]
            keep = [i for i, a in enumerate(at) if a < len(lasts)]
            yield pa.RecordBatch.from_arrays([pa.array([found[i] for i in keep], pa.string()), pa.array([numbers[at[i]] for i in keep], pa.int32())], ["key", "part"])

    if not tops:
        return spark.createDataFrame([], _CAPTURE)
    placed = keys.select("key").mapInArrow(place, "key string, part int")
    return placed.groupBy("part").cogroup(blocks.groupBy("part")).applyInArrow(_search, _CAPTURE)


def _read(batches):
    """Payload size and digest of the records at the given ranges."""
    files: dict = {}
    for batch in batches:
        rows = []
        for page_id, digest, path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
            if path not in files:
                for f in files.values():
                    f.close()
                files = {path: _open(path)}
            record = gzip.decompress(files[path].read_at(length, offset))
            start = record.index(b"\r\n\r\n") + 4
            body = record.index(b"\r\n\r\n", start) + 4
            payload = record[body:-4]
            if (found := hashlib.sha1(payload).hexdigest()) != digest:
                raise ValueError(f"{path} at {offset}: the payload does not have the recorded digest")
            rows.append((page_id, len(payload), found))
        ids, sizes, digests = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["page_id", "payload_bytes", "payload_digest"])


def read_back(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of captures, by range reads of the responses;
    a revisit takes the payload's figures from the response it refers to."""
    found = common.materialize(found, "captures")
    responses = found.where("type = 'response'")
    parts = max(1, min(10_000, responses.select("path").distinct().count()))
    ranges = responses.select("page_id", "digest", "path", "offset", "length").repartition(parts, "path").sortWithinPartitions("path", "offset")
    read = common.materialize(ranges.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string"), "read")
    first = read.groupBy("page_id", "payload_digest").agg(F.first("payload_bytes").alias("payload_bytes")).withColumnsRenamed({"page_id": "refers"})
    revisits = found.where("type = 'revisit'").select("page_id", "refers", F.col("digest").alias("payload_digest"))
    revisits = revisits.join(first, ["refers", "payload_digest"])
    none = F.lit(None).cast("long")
    return read.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), none.alias("refers_to")).union(
        revisits.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit"), "refers")
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write pages (page_id: integer, url, html) to archives, index them, look every page up and read it back.

    Null html is an empty payload, null url an empty key; a null page_id is archived with an empty id. Repeated rows
    are records of their own and all come back. An empty table writes no record and gives no row.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    root = common.work_dir(spark, "warc")
    write_archives(pages, f"{root}/archives")
    build_index(captures(spark, f"{root}/archives"), f"{root}/index")
    return read_back(lookup(pages.select(capture_key(F.col("url"), F.col("page_id")).alias("key")), f"{root}/index"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each page: what its record in the archives, found through the index, says of it."""
    return archive_pages(common.table(spark, sf_dir, "pages"))


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f
"""
