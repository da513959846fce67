"""Repeated strings found with suffix arrays that are built by two-stage sorting, block by block.

Every window of `length` bytes picks an anchor: its k-gram of least hash. Equal windows pick equal anchors, so all
places of a repeated string meet at one anchor, and only text around shared anchors is sorted. There, suffixes that
are smaller than their successors are sorted directly, the others are induced by scans over the buckets, and adjacent
common prefixes tell the windows that occur twice. Hashes only save comparisons: bytes decide.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

GRAM = 32
BASE = 0x9E3779B97F4A7C15
_M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64."""
    up, down = np.full(n + 1, BASE, np.uint64), np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class _Hasher:
    """Hashes of all strings of one buffer, from prefix sums; equal strings hash alike wherever they stand."""

    up = down = np.zeros(0, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(_Hasher.up) <= n:
            _Hasher.up, _Hasher.down = _powers(max(2 * n, 1 << 16))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def all(self, size: int) -> np.ndarray:
        h = (self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def anchored(data: np.ndarray, length: int, chunk: int = 1 << 21) -> tuple[np.ndarray, ...]:
    """(anchor, key, start, size) of the segments of a text: runs of windows that pick one anchor, with all bytes of
    those windows; key is a 64-bit XXH3 of the segment's bytes, seeded with the anchor's place in it. Each window is in one segment."""
    out, width = [], length - GRAM + 1
    for at in range(0, len(data) - length + 1, chunk):
        part = data[at : at + chunk + length - 1]
        hasher, n = _Hasher(part), len(part) - length + 1
        grams = hasher.all(GRAM)
        keyed = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
        tiles = np.concatenate([keyed, np.full(-len(keyed) % width, _M64)]).reshape(-1, width)
        first = np.minimum.accumulate(tiles, 1).ravel()
        last = np.minimum.accumulate(tiles[:, ::-1], 1)[:, ::-1].ravel()
        pick = (np.minimum(last[:n], first[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
        end = np.concatenate([start[1:], [n]]) + length - 1
        raw = memoryview(part)
        spots = zip(start.tolist(), end.tolist(), (pick[start] - start).tolist())
        key = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b], place) for a, b, place in spots), np.uint64, len(start))
        out.append((grams[pick[start]], key, start + at, end - start))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))


ITEMS = "u1 long, u2 long, anchor long, key long, n long, start long, size long, starts array<long>"


def _items(length: int, most: int = 1_000_000):
    """One row for each text of the partition and segment of it; texts seen before only raise the count n."""

    def emit(seen):
        for i in range(0, len(seen), 2000):
            part = list(seen.items())[i : i + 2000]
            n = np.array([len(x[0]) for _, (_, x) in part])
            u = np.repeat(np.array([u for u, _ in part], np.int64).reshape(-1, 2), n, axis=0)
            copies = np.repeat(np.array([c for _, (c, _) in part]), n)
            anchor, key, size = (np.concatenate([x[j] for _, (_, x) in part]) for j in (0, 1, 2))
            counts = np.concatenate([x[3] for _, (_, x) in part])
            starts = np.concatenate([x[4] for _, (_, x) in part])
            ends = np.concatenate([[0], np.cumsum(counts)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (u[:, 0], u[:, 1], anchor.view(np.int64), key.view(np.int64), copies * counts, starts[ends[:-1]] if len(counts) else starts, size)]
                + [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(starts))],
                ["u1", "u2", "anchor", "key", "n", "start", "size", "starts"],
            )

    def run(batches):
        seen, rows = {}, 0
        for batch in batches:
            for u1, u2, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (old := seen.get((u1, u2))) is not None:
                    old[0] += 1
                    continue
                anchor, key, start, size = anchored(np.frombuffer(text, np.uint8), length)
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                of = order[first]
                seen[u1, u2] = [1, (anchor[of], key[first], size[of], np.diff(np.append(first, len(key))), start[order])]
                rows += len(key)
                if rows > most:
                    yield from emit(seen)
                    seen, rows = {}, 0
        yield from emit(seen)

    return run


def _prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int, block: int = 1 << 22) -> np.ndarray:
    """Common prefix, up to `length` bytes, of the texts from each a and from its b.

    Pairs with one distance lie on one diagonal; where they are close to each other there, their bytes are compared once
    for all of them, and a prefix ends at the next unequal byte.
    """
    out = np.zeros(len(a), np.int64)
    if not len(a):
        return out
    by = np.lexsort((a, b - a))
    a, far = a[by], (b - a)[by]
    first = np.flatnonzero(np.concatenate([[True], (far[1:] != far[:-1]) | (np.diff(a) > length)]))
    ends = np.append(first[1:], len(a))
    sizes = a[ends - 1] - a[first] + length
    done, total = 0, np.cumsum(sizes)
    while done < len(first):
        upto = max(done + 1, int(np.searchsorted(total, total[done] - sizes[done] + block, "right")))
        size, begin, pairs = sizes[done:upto], first[done:upto], slice(first[done], ends[upto - 1])
        shift = np.cumsum(size) - size - a[begin]
        at = np.arange(int(size.sum())) - np.repeat(shift, size)
        unequal = np.flatnonzero(text[at] != text[at + np.repeat(far[begin], size)])
        at = a[pairs] + np.repeat(shift, ends[done:upto] - begin)
        stop = np.append(unequal, len(text) * 2 + int(size.sum()))[np.searchsorted(unequal, at)]
        out[by[pairs]] = np.minimum(stop - at, length)
        done = upto
    return out


def _sort_direct(at: np.ndarray, words, left: np.ndarray, same: np.ndarray | None, length: int) -> np.ndarray:
    """Places `at` ordered by the text that begins there, up to `length` bytes or the segment's end.

    Groups of ties are sorted by eight more bytes each round. `same` is a hash of the next `length` bytes: a group in
    which it is one and the same needs no more rounds (None: all rounds are made). left: bytes until the segment's end.
    """
    order = at[np.argsort(words(at, 0), kind="stable")]
    key = words(order, 0)
    group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))
    slots, depth = np.arange(len(order)), 8
    while True:
        # Keep groups of two or more that are not one string and not at their end.
        here = order[slots]
        new = np.concatenate([[True], group[1:] != group[:-1]])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(group)))
        done = size < 2
        if same is not None:
            alike = (same[here] == np.repeat(same[here[first]], size)) & (left[here] >= length)
            done |= np.logical_and.reduceat(alike, first)
        keep = ~np.repeat(done, size)
        slots, group, here = slots[keep], group[keep], here[keep]
        if not len(slots) or depth >= length:
            return order
        key = words(here, depth)
        by = np.lexsort((key, group))
        order[slots], key = here[by], key[by]
        cut = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(np.concatenate([[0], cut.astype(np.int64)]))
        depth += 8


def suffix_array(segments: list[bytes], length: int, hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, repeated, starts): the window starts of the segments in suffix order up to `length` bytes; whether the
    common prefix with a neighbour has `length` bytes; where each segment starts in the joined buffer.

    Segments are joined with a separator below all bytes (bytes are below 0xFF, as in UTF-8). Suffixes are in two
    classes: S, smaller than the next suffix, and L. S suffixes are sorted directly. Then buckets of first bytes are
    scanned in order: a suffix found there puts the L suffix before it at the end of its bucket's L part. Common prefixes
    are computed where hashes are equal, as others fall short for certain. If one of these falls short as well, hashes
    of different strings are equal and may have ended a sort too early: all is sorted again without them.
    """
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    text = np.zeros(int(sizes.sum()) + len(segments) + 8, np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text[: int(sizes.sum()) + len(segments)] = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8) + np.uint8(1)
    n = int(sizes.sum()) + len(segments)
    ends = np.repeat(starts + sizes, sizes + 1)
    left = ends - np.arange(n)
    # S or L: by the first unequal byte; inside a run of equal bytes as at its end.
    t = text[:n].astype(np.int16)
    diff = np.sign(t[1:] - t[:-1])
    step = np.flatnonzero(diff)
    nearest = np.searchsorted(step, np.arange(n - 1))
    rising = np.zeros(n, bool)
    rising[: n - 1] = diff[step[np.minimum(nearest, len(step) - 1)]] > 0
    direct = rising | (left == 0)
    # Windows, and after them what they are induced from: up to the first direct place.
    window = left >= length
    after = np.flatnonzero(direct)
    close = after[np.minimum(np.searchsorted(after, starts + np.maximum(sizes - length + 1, 0)), len(after) - 1)]
    used = np.arange(n) <= np.repeat(close, sizes + 1)
    packed = np.lib.stride_tricks.as_strided(text, (n, 8), (1, 1))

    def words(at: np.ndarray, depth: int) -> np.ndarray:
        more = left[at] - depth
        place = np.where(more > 0, at + depth, 0)
        w = np.ascontiguousarray(packed[place]).view(">u8").ravel().astype(np.uint64)
        cut = np.clip(8 - more, 0, 8).astype(np.uint64) * np.uint64(8)
        return np.where(more <= 0, np.uint64(0), (w >> np.minimum(cut, np.uint64(63))) << np.minimum(cut, np.uint64(63)))

    hasher = _Hasher(text[:n])
    whole = np.minimum(np.arange(n) + length, n)
    same = hasher.of(np.arange(n), whole)
    order = _sort_direct(np.flatnonzero(direct & used & (left > 0)), words, left, same if hashed else None, length)
    induced = used & ~direct
    heads = np.searchsorted(text[order], np.arange(258, dtype=np.int16))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []

    def induce(scan: np.ndarray) -> None:
        before = scan[scan > 0] - 1
        before = before[induced[before]]
        if len(before):
            first = text[before]
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            for a, b in zip(cuts, np.append(cuts[1:], len(first))):
                waiting[first[a]].append(before[a:b])

    induce(np.flatnonzero(used & (left == 0)))
    for c in range(1, 257):
        while waiting[c]:
            front = np.concatenate(waiting[c])
            waiting[c] = []
            out.append(front)
            induce(front)
        if heads[c] < heads[c + 1]:
            out.append(order[heads[c] : heads[c + 1]])
            induce(out[-1])
    found = np.concatenate(out) if out else np.zeros(0, np.int64)
    found = found[window[found]]
    equal = same[found[1:]] == same[found[:-1]]
    near = np.flatnonzero(equal)
    equal[near] = _prefixes(text, found[near], found[near + 1], length) >= length
    if hashed and not equal[near].all():
        return suffix_array(segments, length, hashed=False)
    edge = np.zeros(min(1, len(found)), bool)
    return found, np.concatenate([edge, equal]) | np.concatenate([equal, edge]), starts


def _runs(places: np.ndarray, length: int) -> np.ndarray:
    """[start, end, start, end, ...] of the bytes covered by windows at the sorted places."""
    if not len(places):
        return np.zeros(0, np.int64)
    cut = np.flatnonzero(np.diff(places) > length)
    return np.stack([places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)] + length], 1).ravel()


def _repeats(length: int):
    """For the segments of a partition, by anchor: the runs of bytes that also start elsewhere among them."""

    def block(rows):
        found, hit, starts = suffix_array([r[2] for r in rows], length)
        places = np.sort(found[hit])
        of = np.searchsorted(starts, places, "right") - 1
        cuts = np.searchsorted(of, np.arange(len(rows) + 1))
        runs = [_runs(places[a:b] - starts[i], length).tolist() for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        keep = [i for i, r in enumerate(runs) if r]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][0] for i in keep], pa.int64()), pa.array([rows[i][1] for i in keep], pa.int64()), pa.array([runs[i] for i in keep], pa.list_(pa.int64()))],
            ["anchor", "key", "runs"],
        )

    def run(batches):
        rows, size = {}, 0
        for batch in batches:
            for anchor, key, data in zip(*(c.to_pylist() for c in batch.columns)):
                if size > 1 << 21 and anchor != last:  # anchors come one after the other
                    yield block(list(rows.values()))
                    rows, size = {}, 0
                if (anchor, key) not in rows:
                    rows[anchor, key] = (anchor, key, data)
                    size += len(data)
                last = anchor
        if rows:
            yield block(list(rows.values()))

    return run


def _cut_out(batches):
    """The bytes of the wanted segments; copies of a text come one after the other and count once."""
    last = None
    for batch in batches:
        out = []
        for u1, u2, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            if (u1, u2) != last:
                out += [(w["anchor"], w["key"], text[w["start"] : w["start"] + w["size"]]) for w in wanted]
            last = (u1, u2)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], ["anchor", "key", "data"]
        )


PIECES = "anchor long, key long, at long, lo long, hi long, sub long, subkey long, data binary"


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _halves(length: int):
    """Each segment in two: windows that begin at most `mid` bytes before the anchor, and the others up to `hi`.

    All windows of a half that begin lo to hi bytes before the anchor hold the bytes from lo before it to length - hi
    behind that place: `sub` stands for these, so equal windows meet again. subkey stands for the half's bytes.
    """

    def run(batches):
        for batch in batches:
            out = []
            for anchor, key, at, lo, hi, data in zip(*(c.to_pylist() for c in batch.columns)):
                grams = _Hasher(np.frombuffer(data, np.uint8)).all(GRAM) & np.uint64(0xFFFFFFFFFF000000)
                spare = len(data) - length  # the anchor is the first least gram among those that all windows hold
                place = spare + int(np.argmin(grams[spare : length - GRAM + 1]))
                mid = (lo + hi) // 2
                for a, b in ((lo, mid), (mid + 1, hi)):
                    least, most = max(a, place - spare), min(b, place)
                    if least > most:
                        continue
                    start, end = place - most, place - least + length
                    sub = xxhash.xxh3_64_intdigest(data[place - a : place - b + length], (a << 32) + b)
                    subkey = xxhash.xxh3_64_intdigest(data[start:end], most)
                    out.append((anchor, key, at + start, a, b, _signed(sub), _signed(subkey), data[start:end]))
            for i in range(0, len(out), 5000):
                columns = list(zip(*out[i : i + 5000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.binary())], ["anchor", "key", "at", "lo", "hi", "sub", "subkey", "data"]
                )

    return run


def _crowded(data: DataFrame, length: int, crowd: int, block_mb: float) -> DataFrame:
    """(anchor, key, runs) of segments at anchors with more than `crowd` distinct ones, which are split by the bytes
    around the anchor, in halves of halves, until no more than `crowd` distinct pieces share them; these are sorted.

    A piece of one window is that window's bytes, so the halves end after as many rounds as the logarithm of `length`.
    """
    level = data.select(
        "anchor", "key", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("lo"), F.lit(length - GRAM).cast("long").alias("hi"), "data"
    )
    out = []
    while level is not None:
        pieces = common.materialize(level.mapInArrow(_halves(length), PIECES), "pieces")
        # A segment can have been cut out twice; bytes take no part in telling.
        places = pieces.select("anchor", "key", "at", "sub", "subkey", F.octet_length("data").cast("long").alias("size")).distinct()
        each = places.groupBy("sub", "subkey").agg(F.count("*").alias("n"), F.max("size").alias("size"))
        each = common.materialize(each, "each")
        subs = common.materialize(each.groupBy("sub").agg(F.count("*").alias("kinds"), F.sum("size").alias("bytes")), "subs")
        sortable = subs.where((F.col("kinds") > 1) & (F.col("kinds") <= crowd))
        rest = subs.where(F.col("kinds") > crowd)
        runs = each.where("n > 1").select("sub", "subkey", F.array(F.lit(0).cast("long"), F.col("size")).alias("runs"))
        total = sortable.agg(F.sum("bytes")).first()[0]
        if total:
            blocks = common.parts_for(data.sparkSession, total, block_mb * 1e6, 12)
            chosen = pieces.join(sortable.select("sub"), "sub", "left_semi").groupBy("sub", "subkey").agg(F.first("data").alias("data"))
            found = chosen.repartition(blocks, "sub").sortWithinPartitions("sub").mapInArrow(_repeats(length), "anchor long, key long, runs array<long>")
            runs = runs.union(found.toDF("sub", "subkey", "runs"))
        runs = places.drop("size").join(runs, ["sub", "subkey"])
        out.append(runs.select("anchor", "key", F.transform("runs", lambda r: r + F.col("at")).alias("runs")))
        more = rest.limit(1).count() > 0
        level = pieces.where("lo < hi").join(rest.select("sub"), "sub", "left_semi").select("anchor", "key", "at", "lo", "hi", "data") if more else None
        if more and level.limit(1).count() == 0:
            raise RuntimeError("pieces of one window have different bytes")  # two cores with one 64-bit hash
    covered = out[0]
    for runs in out[1:]:
        covered = covered.union(runs)
    return covered


def _remove(batches):
    for batch in batches:
        sizes, removed, spans, digests, cuts = [], [], [], [], []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data, runs = np.frombuffer(text or b"", np.uint8), []
            for (start, runs_of) in {(w["key"], s): (s, w["runs"]) for w in found or () for s in w["starts"]}.values():
                runs += [(start + a, start + b) for a, b in zip(runs_of[::2], runs_of[1::2])]
            steps = np.zeros(len(data) + 1, np.int32)
            if runs:
                ends = np.array(runs)
                np.add.at(steps, ends[:, 0], 1)
                np.add.at(steps, ends[:, 1], -1)
            gone = np.cumsum(steps[:-1]) > 0
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            sizes.append(len(data))
            removed.append(int(gone.sum()))
            spans.append(int((edge == 1).sum()))
            cuts.append(np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).ravel().tolist())
            digests.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(cuts, pa.list_(pa.int64()))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def repeated_spans(docs: DataFrame, length: int = 400, crowd: int = 20_000, block_mb: float = 6.0) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row of docs (doc_id, text).

    spans lists start and end of the maximal byte runs covered by strings of `length` bytes that also start anywhere
    else, in this or any other document. Null and empty texts have no bytes; repeated rows repeat each other whole.
    A segment with an equal elsewhere is covered whole without sorting; of each distinct segment at an anchor with
    several, one copy is cut out and sorted. An anchor with more than `crowd` distinct segments (some 12 MB, or 6 seconds of
    one task) is split by the bytes around it, so no task holds an unbounded anchor. Texts are told apart by 128 bits of hash, segments of an anchor by 64.
    """
    spark = docs.sparkSession
    named = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    named = named.withColumns({"u1": F.xxhash64("text"), "u2": F.xxhash64(F.lit(1), "text")})
    items = named.where(F.octet_length("text") >= length).select("u1", "u2", "text").mapInArrow(_items(length), ITEMS)
    items = common.materialize(items, "items")
    segments = items.groupBy("anchor", "key").agg(
        F.sum("n").alias("n"), F.first("u1").alias("u1"), F.first("u2").alias("u2"), F.first("start").alias("start"), F.first("size").alias("size")
    )
    segments = common.materialize(segments, "segments")
    shared = segments.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("size").alias("bytes")).where("kinds > 1")
    shared = common.materialize(shared, "shared")
    crowded, total = shared.select(F.max("kinds"), F.sum("bytes")).first()
    covered = segments.where("n > 1").select("anchor", "key", F.array(F.lit(0).cast("long"), F.col("size")).alias("runs"))
    if total:
        wanted = segments.join(shared, "anchor").groupBy("u1", "u2").agg(F.collect_list(F.struct("anchor", "key", "start", "size")).alias("wanted"))
        data = named.select("u1", "u2", "text").join(wanted, ["u1", "u2"]).select("u1", "u2", "text", "wanted").mapInArrow(_cut_out, "anchor long, key long, data binary")
        if crowded > crowd:
            data = common.materialize(data, "cut")
            busy = shared.where(F.col("kinds") > crowd).select("anchor")
            hits = _crowded(data.join(busy, "anchor", "left_semi"), length, crowd, block_mb)
            data = data.join(busy, "anchor", "left_anti")
        blocks = common.parts_for(spark, total, block_mb * 1e6, 12)
        sorted_ = data.repartition(blocks, "anchor").sortWithinPartitions("anchor").mapInArrow(_repeats(length), "anchor long, key long, runs array<long>")
        single = segments.where("n = 1").select("anchor", "key")
        if crowded > crowd:
            sorted_ = sorted_.union(hits)
        covered = covered.union(sorted_.join(single, ["anchor", "key"], "left_semi"))
    covered = common.materialize(covered, "covered")
    found = items.join(covered, ["anchor", "key"]).select("u1", "u2", F.struct(F.xxhash64("key", "runs").alias("key"), "starts", "runs").alias("w"))
    found = found.groupBy("u1", "u2").agg(F.collect_list("w").alias("found"))
    full = named.join(found, ["u1", "u2"], "left").select("doc_id", "text", "found")
    schema = docs.select(
        "doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")], F.lit("").alias("kept_sha256"), F.array(F.lit(0).cast("long")).alias("spans")
    ).schema
    return full.mapInArrow(_remove, schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: the bytes removed, their runs and a digest of what is left. Null and empty texts have 0 bytes,
    repeated rows remove each other, and an empty table gives no row."""
    return repeated_spans(common.table(spark, sf_dir, "documents")).drop("spans")
