"""Sets of word shingles: hashes, the prefixes in which similar sets must meet, and exact Jaccard similarity of pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Hashes of the lower-cased text's word shingles, repeats included; a shorter text is one shingle, no words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[len(words) - n :].tolist())), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; none: 0."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * total > len(hashes)).tolist()))


#: Columns of a set's parities: bit i of all is set if an odd number of shingle hashes end in i.
PARITIES = ["p0", "p1", "p2", "p3"]
#: The same by at least so many longs in one list, and by a bit or more for each shingle, for the pairs that the columns leave open.
WIDE = 16


def wide_longs(n: int) -> int:
    """A power of two, so that a list of twice the length can be folded."""
    return max(WIDE, 1 << (max(n - 1, 0) >> 6).bit_length())


def parities(kinds: np.ndarray, longs: int = len(PARITIES)) -> np.ndarray:
    odd = np.bincount((kinds & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _most_turned(least: float, n: Column, m: Column) -> Column:
    return (n + m) * F.lit((1 - least) / (1 + least)) + F.lit(1e-6)


def may_reach(least: float, n: Column, m: Column, ours: list[str], others: list[str]) -> Column:
    """False only where two sets of n and m shingles, by their parities, can't have the similarity `least`.

    Each shingle that one of the sets lacks turns one bit, and sets of that similarity lack at most (n + m) * (1 - least)
    / (1 + least) of each other's."""
    turned = sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(ours, others)), F.lit(0))
    return turned <= _most_turned(least, n, m)


def may_reach_wide(least: float, n: Column, m: Column, ours: Column, others: Column) -> Column:
    """The same by the wide parities, of which one list may be twice as long; where lengths differ by more, nothing is ruled out."""
    short, differ = F.least(F.size(ours), F.size(others)), lambda x, y: x.bitwiseXOR(y)
    folded = lambda c: F.when(F.size(c) > short, F.zip_with(F.slice(c, F.lit(1), short), F.slice(c, short + 1, short), differ)).otherwise(c)
    turned = F.aggregate(F.zip_with(folded(ours), folded(others), differ), F.lit(0), lambda s, x: s + F.bit_count(x))
    return (F.greatest(F.size(ours), F.size(others)) > 2 * short) | (turned <= _most_turned(least, n, m))


def _rarest(kinds: np.ndarray, least: float, known: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The n - ceil(least * n) + 1 rarest of n shingles, in the order of rarity: by their count in known (sorted; seen: its counts), then by value."""
    k = len(kinds) - math.ceil(least * len(kinds) - 1e-9) + 1
    at = np.minimum(np.searchsorted(known, kinds), max(len(known) - 1, 0))
    count = np.where(known[at] == kinds, seen[at], 0) if len(known) else np.zeros(len(kinds), np.int64)
    return kinds[np.lexsort((kinds, count))[:k]]


def marks(docs: DataFrame, width: int, least: float, known: np.ndarray, seen: np.ndarray) -> DataFrame:
    """(doc_id, node, n, fp, p0 to p3, wide, t, rare) of docs (doc_id, text): hash and size of its set of shingles, its
    fingerprint, the set's parities, the hash of the text and the set's rarest shingles.

    Two sets of the similarity `least` share one of those, in any one order of all shingles. Equal sets of a partition
    have them once, the others null."""

    def run(batches):
        met: set[int] = set()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                out, wide, rare = [], [], []
                for text in part.column(1).cast(pa.large_binary()).to_pylist():
                    hashes = shingle_hashes(text or b"", width)
                    kinds = np.unique(hashes)
                    node = xxhash.xxh3_64_intdigest(kinds.tobytes())
                    out.append((node, len(kinds), majority(hashes), *parities(kinds), xxhash.xxh3_64_intdigest(text or b"")))
                    wide.append(parities(kinds, wide_longs(len(kinds))).view(np.int64))
                    new = len(kinds) and node not in met and not met.add(node)
                    rare.append(_rarest(kinds.view(np.int64), least, known, seen) if new else None)
                node, n, *more = (np.array(c, np.uint64).view(np.int64) for c in (zip(*out) if out else [()] * len(names)))
                lists = [pa.array(c, pa.list_(pa.int64())) for c in (wide, rare)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node), pa.array(n.astype(np.int32)), *map(pa.array, more), *lists], ["doc_id", *names, "wide", "rare"])

    names = ["node", "n", "fp", *PARITIES, "t"]
    longs = [F.lit(None).cast("array<long>").alias(c) for c in ("wide", "rare")]
    schema = docs.select("doc_id", *[F.lit(0).cast("int" if c == "n" else "long").alias(c) for c in names], *longs).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema)


#: Bits of a map of hashes, of texts whose sets are asked for or of shingles (4 MB, whatever the data).
MARKS = 25


def marked_hashes(hashes: DataFrame) -> np.ndarray:
    """The map of bits of hashes (of one column): of fixed size, so others may have theirs set too."""
    slot = F.col(hashes.columns[0]).bitwiseAND(F.lit((1 << MARKS) - 1))
    pages = hashes.groupBy(F.shiftright(slot, 15).alias("page")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767).cast("long"))).alias("map"))
    out = np.zeros(max(1 << MARKS, 1 << 15) >> 3, np.uint8)
    for r in pages.toLocalIterator():
        out[r["page"] * 4096 : (r["page"] + 1) * 4096] = np.frombuffer(r["map"], np.uint8)
    return out


def _sets(width: int, asked: np.ndarray | None = None):
    """Sets of the texts of a partition, each once; with asked, a map of bits, only of texts whose hash has its bit: of the others no
    shingle is made."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = []
                for text in batch.column(0).slice(i, 500).cast(pa.large_binary()).to_pylist():
                    slot = xxhash.xxh3_64_intdigest(text or b"") & ((1 << MARKS) - 1)
                    if asked is not None and not asked[slot >> 3] >> (slot & 7) & 1:
                        continue
                    kinds = np.unique(shingle_hashes(text or b"", width))
                    node = xxhash.xxh3_64_intdigest(kinds.tobytes())
                    if len(kinds) and node not in seen:
                        seen.add(node)
                        rows.append((node, kinds.view(np.int64)))
                node = np.array([r[0] for r in rows], np.uint64).view(np.int64)
                kinds = [r[1] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(list(map(len, kinds)), pa.int32()), pa.array(kinds, pa.list_(pa.int64()))], ["node", "n", "shingles"])

    return run


def sets(docs: DataFrame, width: int, asked: np.ndarray | None = None) -> DataFrame:
    """(node, n, shingles) of the texts that have words (with asked, a map of bits: and a bit in it for their hash); equal sets of a partition once."""
    return docs.select("text").mapInArrow(_sets(width, asked), "node long, n int, shingles array<long>")


def met_shingles(marked: DataFrame) -> DataFrame:
    """(shingle, node, n, pos) of the rarest shingles of marked sets, with their places in the order of rarity: all that two
    sets hold, and those others whose bit in a map is set by such a one.

    Most are of one set alone; they are counted by themselves and don't leave the worker with their set."""
    lists = marked.where("rare IS NOT NULL").select("node", "n", "rare")
    again = lists.select(F.explode("rare").alias("shingle")).groupBy("shingle").count().where("count > 1").select("shingle")
    met = marked_hashes(again)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                node, n, rare = batch.slice(i, 1000).columns
                times, flat = rare.value_lengths().to_numpy(zero_copy_only=False), rare.flatten().to_numpy()
                slot = flat & ((1 << MARKS) - 1)
                keep = np.flatnonzero(met[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                pos = np.arange(len(flat)) - np.repeat(np.cumsum(times) - times, times)
                of = np.repeat(np.arange(len(node)), times)[keep]
                columns = [flat[keep], node.to_numpy()[of], n.to_numpy()[of], pos[keep].astype(np.int32)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["shingle", "node", "n", "pos"])

    return lists.mapInArrow(run, "shingle long, node long, n int, pos int")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (src, dst) of nodes (node, n, wide, t: the hash of one of its texts) of docs (text) whose similarity is `least`
    at least, by their whole sets.

    Pairs that the wide parities rule out end before any set is made. Only sets of texts whose hash has its bit in the map of what is left
    leave the worker that makes them."""
    ends = [nodes.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "wide")]) for c in ("src", "dst")]
    open_ = pairs.join(ends[0], "src").join(ends[1], "dst")
    fits = F.least("n_src", "n_dst") >= F.lit(least - 1e-9) * F.greatest("n_src", "n_dst")
    open_ = open_.where(fits & may_reach_wide(least, F.col("n_src"), F.col("n_dst"), F.col("wide_src"), F.col("wide_dst")))
    pairs = common.materialize(open_.select("src", "dst"), "open")
    used = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    used = common.materialize(used.join(nodes.select("node", "t"), "node"), "used")
    made = sets(docs, width, marked_hashes(used.select("t"))).join(used, "node", "left_semi").dropDuplicates(["node"])
    a, b = (made.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("shingles").alias(f"s_{c}")) for c in ("src", "dst"))
    both = pairs.join(a, "src").join(b, "dst").withColumn("common", F.size(F.array_intersect("s_src", "s_dst")))
    return both.where(F.col("common") / (F.col("n_src") + F.col("n_dst") - F.col("common")) >= least).select("src", "dst")
