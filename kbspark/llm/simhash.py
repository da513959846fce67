"""SimHash near-duplicates found with a covering code: compare fingerprints only around shared anchors."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles

#: Fingerprint bits are cut in three fields; of 4 differing bits at most 1 lies in one of them.
FIELDS = ((0, 21), (21, 21), (42, 22))
#: Each field is covered by a Hamming code of 15 bits (covering radius 1), the other bits as they are (radius 0).
HAMMING = 15


def fingerprint(text: bytes, width: int) -> int:
    """Bit i is set if it is set in over half of the hashes of the text's word shingles; no words: 0."""
    return shingles.majority(shingles.shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp: long) of docs (doc_id, text), over whole texts; null and empty texts get 0."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", width) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    schema = docs.select("doc_id", F.lit(0).cast("long").alias("fp")).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Position (1 to 15) of the bit by which a 15-bit word misses its codeword; 0 on a codeword."""
    out = np.zeros(len(words), np.int64)
    for i in range(HAMMING):
        out ^= np.where(words >> i & 1, i + 1, 0)
    return out


def _balls(bits: int, reach: int) -> np.ndarray:
    """All masks of `bits` bits with at most `reach` set."""
    return np.array([sum(1 << i for i in c) for r in range(reach + 1) for c in itertools.combinations(range(bits), r)], np.int64)


def anchors(fps: np.ndarray, at: int, bits: int, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint the anchors within covering radius 1 plus `apart` on one field: (row, anchor)."""
    field = (fps.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1)
    coded, free = field & ((1 << HAMMING) - 1), field >> HAMMING
    rows, found = [], []
    masks = _balls(bits, 1 + apart)
    own = _syndrome(coded)
    of_mask = _syndrome(masks & ((1 << HAMMING) - 1))
    for s in range(HAMMING + 1):
        at_s = np.flatnonzero(own == s)
        use = masks[of_mask == s]  # those that lead to a codeword
        rows.append(np.repeat(at_s, len(use)))
        found.append(((free[at_s] << HAMMING | coded[at_s])[:, None] ^ use[None, :]).ravel())
    return np.concatenate(rows), np.concatenate(found)


def home(fps: np.ndarray, at: int, bits: int) -> np.ndarray:
    """The anchor within covering radius 1 to which each fingerprint belongs."""
    field = (fps.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1)
    s = _syndrome(field & ((1 << HAMMING) - 1))
    return field ^ np.where(s > 0, 1 << np.maximum(s - 1, 0), 0)


def _spread(apart: int):
    """One row (anchor, fp, home) for each fingerprint and anchor in reach, for all fields."""

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for i in range(0, len(fps), 20_000):
                part = fps[i : i + 20_000]
                for f, (at, bits) in enumerate(FIELDS):
                    rows, found = anchors(part, at, bits, apart)
                    is_home = home(part, at, bits)[rows] == found
                    keys = found << 2 | f
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array(part[rows]), pa.array(is_home)], ["anchor", "fp", "home"]
                    )

    return run


def _compare(distance: int, block: int = 2048):
    """Edges between the fingerprints that meet at an anchor: a forest for each anchor, not all pairs."""

    def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a[:, None] ^ b[None, :]) <= distance

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("anchor", kind="stable")
        keys, fps, homes = (pdf[c].to_numpy() for c in ("anchor", "fp", "home"))
        fps = fps.view(np.uint64)
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
        src, dst = [], []
        # Small anchors, all at once: each home row against the other rows of its anchor.
        size = ends - starts
        small = np.repeat(size <= 64, size)
        at = np.flatnonzero(homes & small)
        n, first = np.repeat(size, size)[at], np.repeat(starts, size)[at]
        for i in range(0, len(at), 8_000):
            part = slice(i, i + 8_000)
            left = np.repeat(at[part], n[part])
            right = np.arange(len(left)) - np.repeat(np.cumsum(n[part]) - n[part], n[part]) + np.repeat(first[part], n[part])
            ok = (left != right) & (np.bitwise_count(fps[left] ^ fps[right]) <= distance)
            src.append(fps[left[ok]])
            dst.append(fps[right[ok]])
        for a, b in zip(starts[size > 64], ends[size > 64]):
            own, left = fps[a:b], np.ones(b - a, bool)
            is_home = homes[a:b]
            while (todo := np.flatnonzero(left & is_home)).size:
                root, front = todo[0], todo[:1]
                near = left | ~is_home  # a walk doesn't go on from the others, so they stay in reach of each
                near[root] = False
                while front.size:
                    rest = np.flatnonzero(near)
                    hit = np.zeros(len(rest), bool)
                    for i in range(0, len(front), block):
                        for j in range(0, len(rest), block):
                            hit[j : j + block] |= linked(own[front[i : i + block]], own[rest[j : j + block]]).any(0)
                    new = rest[hit]
                    near[new] = False
                    src.append(own[new])
                    dst.append(np.full(len(new), own[root]))
                    front = new[is_home[new]]
                left &= near | ~is_home
        join = lambda x: np.concatenate(x or [np.zeros(0, np.uint64)]).view(np.int64)
        return pd.DataFrame({"src": join(src), "dst": join(dst)})

    return run


def links(fps: DataFrame, distance: int = 4, bucket_rows: float = 4e5) -> DataFrame:
    """Edges (src, dst) that connect all distinct fingerprints (fp) at `distance` or fewer bits.

    A pair at 4 bits differs in at most one bit on one of three fields. There, the first fingerprint lies within the
    covering radius (1) of its anchor, so the second lies within 2 of it: each fingerprint is sent to all anchors in
    that reach, and each home member is compared with all that came. Anchors are dealt over partitions whose number
    grows with the rows; inside an anchor the work is in blocks and the output a forest, with one edge for
    each group of home members and each other fingerprint that it reaches.
    """
    if distance // len(FIELDS) > 1:
        raise ValueError("three fields serve up to 5 differing bits")
    spark = fps.sparkSession
    n = fps.count()
    spread = fps.select("fp").mapInArrow(_spread(distance // len(FIELDS)), "anchor long, fp long, home boolean")
    buckets = common.parts_for(spark, n * 45, bucket_rows, 12)
    spread = spread.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)).cast("int"))
    return spread.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_compare(distance), "src long, dst long")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id: integer, text).

    component_id is the least doc_id whose fingerprint can be reached over links. Equal fingerprints, so also repeated
    rows and all texts without words, are one node. Null doc_ids keep their row and get the component of the others
    with their fingerprint's group (null if there is none).
    """
    marked = common.materialize(fingerprints(docs, width), "fps")
    nodes = common.materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    parts = common.connected_components(links(nodes, distance)).withColumnRenamed("node", "fp")
    nodes = nodes.join(parts, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(least, "root").select("fp", "component_id")
    return marked.join(nodes, "fp").select("doc_id", "fp", "component_id")


def near_copies(docs: DataFrame, width: int = 5, least: float = 0.8, distance: int = 4, sample: int = 4000) -> DataFrame:
    """(doc_id, component_id) for every row of docs (doc_id: of any type with an order, text).

    Documents are linked if the Jaccard similarity of their sets of `width`-word shingles is `least` or more; component_id
    is the least doc_id that can be reached over links. Equal sets, so also all texts without words, are one node.

    Fingerprints within `distance` bits propose a pair a node at most, which are verified by the whole sets. A pair at the bound may
    differ in a fifth of the bits, further than anchors reach, so the rest has an exact way: two sets of that similarity
    share a shingle among the rarest fifth of each. There each node is compared with one, the least that it meets anywhere, and then, where
    components still differ, all nodes with the least at their shingle, with the greatest and at last with each other, unless the places of
    that shingle leave too little to share, or the parities of the sets differ in too many bits. The order of rarity puts the shingles that are frequent in a sample of
    `sample` texts last, which spares pairs and changes no result. Null doc_ids keep their row; other columns are not read.
    """
    texts = docs.select("text")
    every = max(1, docs.count() // sample)
    drawn = shingles.sets(texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0), width).select(F.explode("shingles").alias("shingle"))
    drawn = drawn.groupBy("shingle").count().where("count > 1").orderBy(F.desc("count"), "shingle").limit(200_000).toPandas().sort_values("shingle")
    marked = common.materialize(shingles.marks(docs, width, least, drawn["shingle"].to_numpy(np.int64), drawn["count"].to_numpy(np.int64)), "marked")
    # Equal sets have equal values; of their texts that of least hash stands for the node.
    alike = [F.min(c).alias(c) for c in ("n", "fp", *shingles.PARITIES, "wide", "t")]
    nodes = common.materialize(marked.where("n > 0").groupBy("node").agg(*alike), "nodes")
    of_fp = common.materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fps")
    near = links(of_fp, distance)
    ends = [of_fp.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node")) for c in ("src", "dst")]
    proposed = near.join(ends[0], "src").join(ends[1], "dst").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))
    proposed = proposed.union(nodes.join(of_fp, "fp").where("node <> first").select("first", "node"))
    # Of each node the pair with the least: what that leaves out meets at shingles, below.
    proposed = proposed.groupBy(F.greatest("src", "dst").alias("dst")).agg(F.min(F.least("src", "dst")).alias("src")).select("src", "dst")

    held = shingles.met_shingles(marked)
    shared = held.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    held = common.materialize(held.join(shared.select("shingle", "low"), "shingle").distinct(), "held")
    common.release(docs.sparkSession)
    fits = lambda a, b: (F.col(a) >= F.lit(least - 1e-9) * F.col(b)) & (F.col(b) >= F.lit(least - 1e-9) * F.col(a))
    size = nodes.select(F.col("node").alias("low"), F.col("n").alias("n_low"))
    first = held.where("node > low").select("low", "node", "n").join(size, "low").where(fits("n", "n_low")).groupBy("node").agg(F.min("low").alias("low")).select("low", "node")
    pairs = proposed.union(first).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src < dst").distinct()
    pairs = common.materialize(pairs, "pairs")
    found = common.materialize(shingles.verified(pairs, nodes, texts, width, least), "links")

    # Where components still differ: all nodes with the least at their shingle, with the greatest, then all with each other.
    for step in ("least", "greatest", "all"):
        parts = common.connected_components(found)
        placed = held.select("shingle", "node", "n", "pos").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        placed = common.materialize(placed, "placed")
        mixed = placed.groupBy("shingle").agg(F.min("component").alias("a"), F.max("component").alias("b"), (F.min("node") if step == "least" else F.max("node")).alias("hub")).where("a < b").select("shingle", "hub")
        left = placed.join(mixed, "shingle").join(nodes.select("node", *shingles.PARITIES), "node")
        right = left if step == "all" else left.where("node = hub")
        right = right.select("shingle", F.col("node").alias("other"), F.col("n").alias("m"), F.col("component").alias("part"), F.col("pos").alias("at"), *[F.col(p).alias(f"other_{p}") for p in shingles.PARITIES])
        # Two sets whose first common shingle has these places share it and what follows it at most.
        most = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at"))
        enough = most * (1 + least) + F.lit(1e-6) >= F.lit(least) * (F.col("n") + F.col("m"))
        enough &= shingles.may_reach(least, F.col("n"), F.col("m"), shingles.PARITIES, [f"other_{p}" for p in shingles.PARITIES])
        apart = (F.col("node") < F.col("other") if step == "all" else F.col("node") != F.col("other")) & (F.col("component") != F.col("part"))
        rest = left.join(right.hint("merge"), "shingle").where(apart & fits("n", "m") & enough)
        rest = rest.select(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst")).distinct().join(pairs, ["src", "dst"], "left_anti")
        rest = common.materialize(rest, "rest")
        if rest.isEmpty():
            continue
        found = found.union(common.materialize(shingles.verified(rest, nodes, texts, width, least), "more"))
        pairs = pairs.union(rest)
        common.release(docs.sparkSession)
    parts = common.connected_components(found).withColumnRenamed("component", "root")
    ids = marked.groupBy("node").agg(F.min("doc_id").alias("least")).join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = common.materialize(ids, "ids")
    roots = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.select("doc_id", "node").join(ids.join(roots, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its fingerprint in hexadecimal and the least doc_id that links reach."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
