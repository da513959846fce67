"""Best-fit packing by linear grouping: plan over the histogram of lengths, then number the pieces into the plan."""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from . import common

#: The id that ends each document.
END = 2
#: What both tokenizer libraries split alike beyond doubt: Latin letters and common marks, no special token.
PLAIN = re.compile("[\u0000-ɏ‐-‧€]*")
SPECIAL = "<|endoftext|>"


class _Encoder:
    """Ids of the byte-level vocabulary; texts out of the plain range go to the slower library, which defines them."""

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast and SPECIAL not in text and PLAIN.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


_encoders: dict[tuple, _Encoder] = {}


def _cut(json_path: str, ranks_path: str | None, pattern: str | None, capacity: int):
    def run(batches):
        encoders = globals().setdefault("_encoders", {})
        known = (json_path, ranks_path, pattern)
        if known not in encoders:
            encoders[known] = _Encoder(*known)
        encode = encoders[known]
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), END], dtype="<u4")
                ends = list(range(len(ids), 0, -capacity))[::-1]
                starts = [0, *ends[:-1]]
                for piece, (a, b) in enumerate(zip(starts, ends)):
                    rows.append(i)
                    out.append((piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64())))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Few sizes, many items each: patterns and how often to use them, by linear programming over the patterns with
    columns from a knapsack, rounded down (what is then left is less than one bin for each size)."""
    m = len(sizes)
    basis = np.diag(np.maximum(1, capacity // sizes)).astype(float)
    for _ in range(50 * m):
        use = np.linalg.solve(basis, demand.astype(float))
        price = np.linalg.solve(basis.T, np.ones(m))
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for j in np.flatnonzero(price > 1e-12).tolist():
            size = int(sizes[j])
            for _ in range(capacity // size):  # one more of the size in each round
                value = best[:-size] + price[j]
                better = np.flatnonzero(value > best[size:] + 1e-12)
                if not len(better):
                    break
                best[size + better], last[size + better] = value[better], j
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(m), capacity
        while room > 0:
            if last[room] < 0:
                room -= 1
            else:
                column[last[room]] += 1
                room -= sizes[last[room]]
        step = np.linalg.solve(basis, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, use / step, np.inf)
        basis[:, int(ratio.argmin())] = column
    use = np.floor(np.linalg.solve(basis, demand.astype(float)) + 1e-6).astype(int)
    return [(basis[:, i].astype(int), int(use[i])) for i in range(m) if use[i] > 0]


def plan(counts: dict[int, int], capacity: int, groups: int = 96, small: float = 1 / 8, repack: float = 0.5) -> list[tuple[int, list[int]]]:
    """Runs (how many sequences, their lengths) that hold exactly `counts` pieces of each length.

    Large lengths are put in groups of equal cardinality and rounded up to the largest of their group; the few sizes
    are optimised as configurations; actual lengths are put in the slots; small lengths, and what the rounding of
    the program left, go by best fit into the room that remains. Then the emptiest sequences, from a share of `repack` of
    all down, are filled anew by best fit where that saves some. The work depends on the number of lengths alone.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    runs: list[tuple[int, list[int]]] = [(left.pop(capacity), [capacity])] if capacity in left else []
    large = sorted((n for n in left if n > capacity * small), reverse=True)
    total = sum(left[n] for n in large)
    open_runs: dict[int, list[tuple[int, list[int]]]] = {}

    def put(count: int, lengths: list[int]) -> None:
        if count:
            open_runs.setdefault(capacity - sum(lengths), []).append((count, lengths))

    if total:
        # Equal-cardinality groups, as lists of (length, count) in falling order.
        each, members, room = -(-total // groups), [[]], -(-total // groups)
        for n in large:
            c = left[n]
            while c:
                if not room:
                    members.append([])
                    room = each
                take = min(c, room)
                members[-1].append([n, take])
                c, room = c - take, room - take
        sizes, first = np.unique([g[0][0] for g in members], return_inverse=True)
        pools: list[list[list[int]]] = [[] for _ in sizes]
        for i, g in zip(first, members):
            pools[i] += g
        demand = np.array([sum(c for _, c in p) for p in pools])
        for pattern, times in configurations(sizes, demand, capacity):
            slots = [i for i in range(len(sizes) - 1, -1, -1) for _ in range(pattern[i])]
            while times:
                # Slots of one size take lengths one after the other; a run ends where a slot's length does.
                want = {i: slots.count(i) for i in set(slots)}
                step, lengths = times, []
                for i, k in want.items():
                    if not pools[i]:
                        continue
                    if pools[i][0][1] >= k:
                        step = min(step, pools[i][0][1] // k)
                        lengths += [(i, pools[i][0][0], k)]
                    else:
                        step, need, q = 1, k, 0
                        while need and q < len(pools[i]):
                            take = min(need, pools[i][q][1])
                            lengths.append((i, pools[i][q][0], take))
                            need, q = need - take, q + 1
                for i, n, k in lengths:
                    pool = next(p for p in pools[i] if p[0] == n)
                    pool[1] -= k * step
                    pools[i] = [p for p in pools[i] if p[1]]
                if lengths:
                    put(step, [n for _, n, k in lengths for _ in range(k)])
                times -= step
        rest: dict[int, int] = {}
        for pool in pools:
            for n, c in pool:
                rest[n] = rest.get(n, 0) + c
        left = {n: c for n, c in left.items() if n not in set(large)} | rest
    def fill(left: dict[int, int]) -> None:
        for n in sorted(left, reverse=True):
            c = left[n]
            while c:
                fit = min((r for r in open_runs if r >= n), default=None)
                if fit is None:
                    k = capacity // n
                    if c >= k:
                        put(c // k, [n] * k)
                        c %= k
                    else:
                        put(1, [n] * c)
                        c = 0
                    continue
                count, lengths = open_runs[fit].pop()
                if not open_runs[fit]:
                    del open_runs[fit]
                take = min(c, count)
                put(count - take, lengths)
                put(take, [*lengths, n])
                c -= take

    fill(left)
    # The emptiest sequences are taken apart and their pieces put by best fit again, where that saves some.
    total, share = sum(c for rs in open_runs.values() for c, _ in rs), repack
    while share > 1e-3:
        kept, freed, upto = {r: list(rs) for r, rs in open_runs.items()}, {}, int(total * share)
        for r in sorted(open_runs, reverse=True):
            while upto and open_runs.get(r):
                count, lengths = open_runs[r].pop()
                take = min(count, upto)
                upto -= take
                put(count - take, lengths)
                for n in lengths:
                    freed[n] = freed.get(n, 0) + take
            if not open_runs[r]:
                del open_runs[r]
        fill(freed)
        now = sum(c for rs in open_runs.values() for c, _ in rs)
        if now >= total:
            open_runs = kept
        total, share = min(now, total), share / 2
    return runs + [r for rs in open_runs.values() for r in rs]


def slots(runs: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset) of the plan's places."""
    out, used, sequence = [], {}, 0
    for count, lengths in runs:
        at = 0
        for n in lengths:
            rank = used.get(n, 0)
            out.append((n, rank, rank + count, sequence, at))
            used[n] = rank + count
            at += n
        sequence += count
    return out


def tokenizer_paths() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pack(docs: DataFrame, tokenizer: tuple[str, str | None, str | None], capacity: int = 1024, each: int = 50_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of docs (doc_id, text).

    tokenizer: path of the tokenizer's file, and (or None) path of its ranks and its pattern for the faster library.
    Null and empty texts are one piece of the end alone. Longer documents are cut from their end, so the first piece
    may be shorter. Repeated rows are packed each. Only the histogram of lengths (at most `capacity` numbers) reaches
    the driver. Pieces of one length get their rank from running counts over hash buckets, whose number grows with the
    data, so a frequent length is not numbered by one task.
    """
    spark = docs.sparkSession
    schema = docs.select("doc_id", F.lit(0).alias("piece"), *[F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32")]).schema
    pieces = docs.select("doc_id", "text").mapInArrow(_cut(*tokenizer, capacity), schema)
    pieces = common.materialize(pieces, "pieces")
    buckets = common.parts_for(spark, pieces.count(), each, 64)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    tally = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity`
    before = F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    tally = tally.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    order = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(order) - 1).join(tally, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    places = spark.createDataFrame(slots(plan(counts, capacity)), "length long, low long, high long, sequence long, offset long")
    # The plan's size depends on capacity and the number of groups, not on the data.
    joined = ranked.join(F.broadcast(places), "length").where("rank >= low and rank < high")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of each document, with its place in a sequence. A null or empty text is one piece of length
    1, repeated rows are packed each, and an empty table has no row."""
    return pack(common.table(spark, sf_dir, "documents"), tokenizer_paths())
