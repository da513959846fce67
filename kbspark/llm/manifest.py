"""Merkle manifest of a dataset: a SHA-256 tree in which each parent keeps its hash state before every child slot.

A digest as hex text has 64 bytes, which is one block of SHA-256. So the state of a parent before slot i is that after i
whole blocks: eight words, which a table can hold. When a child changes, folding takes the state of its slot, adds the
new digest and the siblings on the right, and never reads those on the left again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Children of a parent.
FANOUT = 16
#: Parents that a task folds at once, with FANOUT leaves each: bounds its memory.
AT_ONCE = 512


def _root_bits(number: int, power: int) -> int:
    """The first 32 bits after the point of a root of the number."""
    scaled = number << (32 * power)
    root = round(scaled ** (1 / power))
    while root**power > scaled:
        root -= 1
    while (root + 1) ** power <= scaled:
        root += 1
    return root & 0xFFFFFFFF


_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, int(p**0.5) + 1))]
_START = np.array([_root_bits(p, 2) for p in _PRIMES[:8]], np.uint32)
_ROUND = [np.uint32(_root_bits(p, 3)) for p in _PRIMES[:64]]


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256's compression of many states (n, 8) with a block (n, 16) of 32-bit words each."""
    w = list(np.ascontiguousarray(block.T))
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))) + w[t - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))))
    before = np.ascontiguousarray(state.T)
    a, b, c, d, e, f, g, h = before
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return (np.stack([a, b, c, d, e, f, g, h]) + before).T


def _end(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 8) of messages of so many whole blocks, from the states after them."""
    last = np.zeros((len(state), 16), np.uint32)
    last[:, 0], last[:, 15] = 0x80000000, 512 * blocks
    return compress(state, last)


_HEX = np.array([list(f"{b:02x}".encode()) for b in range(256)], np.uint8)


def _as_block(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 8) as blocks (n, 16): their hex text."""
    text = _HEX[digests.astype(">u4", order="C").view(np.uint8).reshape(-1, 32)].reshape(-1, 64)
    return np.ascontiguousarray(text).view(">u4").astype(np.uint32)


def _blocks(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (n, FANOUT, 16) of texts of whole blocks, zero where there are none, and how many each has."""
    count = np.array([len(t) // 64 for t in texts], np.int64)
    out = np.zeros((len(texts), FANOUT, 16), np.uint32)
    flat = np.frombuffer("".join(texts).encode(), ">u4").astype(np.uint32).reshape(-1, 16)
    row = np.repeat(np.arange(len(texts)), count)
    out[row, np.arange(len(row)) - (np.cumsum(count) - count)[row]] = flat
    return out, count


def midstates(children: list[str]) -> list[bytes]:
    """For each parent, given its children's digests as one text, the states before each slot and then its digest, 32 bytes each."""
    blocks, count = _blocks(children)
    kept = np.zeros((len(children), FANOUT + 1, 8), np.uint32)
    state = np.tile(_START, (len(children), 1))
    for slot in range(FANOUT):
        kept[:, slot] = state
        on = np.flatnonzero(count > slot)
        if not len(on):
            break
        state[on] = compress(state[on], blocks[on, slot])
    kept[np.arange(len(children)), count] = _end(state, count)
    return [k[: n + 1].astype(">u4").tobytes() for k, n in zip(kept, count)]


def resume(block: np.ndarray, slot: np.ndarray, node: np.ndarray, blocks: np.ndarray, count: np.ndarray, states: np.ndarray) -> np.ndarray:
    """Digests (n, 8) of parents whose child in the slot is replaced by the block (n, 16): from the state before the slot on.

    node says which row of blocks (m, FANOUT, 16), count (m) and states (m, FANOUT, 8) is the parent of each.
    """
    state = compress(states[node, slot], block)
    for right in range(1, FANOUT):
        on = np.flatnonzero(slot + right < count[node])
        if not len(on):
            break
        state[on] = compress(state[on], blocks[node[on], slot[on] + right])
    return _end(state, count[node])


def _states(texts: list) -> np.ndarray:
    out = np.zeros((len(texts), FANOUT, 8), np.uint32)
    for i, t in enumerate(texts):
        got = np.frombuffer(t, ">u4").reshape(-1, 8)[:-1]
        out[i, : len(got)] = got
    return out


_OUT = "doc_id {}, leaf string, subroot string, proof_sha256 string, folded_root string"


def _others(children: str, slot: int) -> str:
    return children[: 64 * slot] + children[64 * (slot + 1) :]


def _fold(batches):
    """Rows of parents of leaves (kids, children, states, path, subroot) to rows of leaves."""
    for batch in batches:
        kind = batch.column(0).type.value_type.field("doc").type.field("doc_id").type
        for i in range(0, max(1, len(batch)), AT_ONCE):
            rows = batch.slice(i, AT_ONCE).to_pylist()
            docs = [(r, n, s, k) for n, r in enumerate(rows) for s, k in enumerate(r["kids"])]
            first = "".join(k["doc"]["altered"] or k["digest"] for *_, k in docs).encode()
            now = np.frombuffer(first, ">u4").astype(np.uint32).reshape(-1, 16)
            node = np.array([n for _, n, _, _ in docs], np.int64)
            own = np.array([s for _, _, s, _ in docs], np.int64)
            # The first step is in the parent of the leaves, if there is one; the others are those of the path.
            steps = [([(None, r["children"], r["states"])] if r["children"] else []) + [(p["slot"], p["children"], p["states"]) for p in r["path"]] for r in rows]
            for level in range(max(map(len, steps), default=0)):
                there = [n for n, s in enumerate(steps) if len(s) > level]
                at = np.full(len(rows), -1, np.int64)
                at[there] = np.arange(len(there))
                on = np.flatnonzero(at[node] >= 0)
                blocks, count = _blocks([steps[n][level][1] for n in there])
                slots = np.array([-1 if (s := steps[n][level][0]) is None else s for n in there], np.int64)[at[node[on]]]
                slots = np.where(slots < 0, own[on], slots)
                now[on] = _as_block(resume(now[on], slots, at[node[on]], blocks, count, _states([steps[n][level][2] for n in there])))
            folded = now.astype(">u4").tobytes().decode()
            above = ["".join(_others(p["children"], p["slot"]) for p in r["path"]).encode() for r in rows]
            proofs = [hashlib.sha256((_others(r["children"], s).encode() if r["children"] else b"") + above[n]).hexdigest() for r, n, s, _ in docs]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k["doc"]["doc_id"] for *_, k in docs], kind), pa.array([k["digest"] for *_, k in docs], pa.string()), pa.array([r["subroot"] for r, *_ in docs], pa.string()),
                    pa.array(proofs, pa.string()), pa.array([folded[64 * j : 64 * j + 64] for j in range(len(docs))], pa.string()),
                ],
                ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"],
            )


def leaf(text: Column = None) -> Column:
    """H of the row's values, each with its length before it; text replaces the document's."""
    values = [F.col(c).cast("string") for c in ("doc_id", "source", "lang", "n_chars")] + [F.col("text") if text is None else text]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows (tree, ...) with place, from 0 in its tree by the order given, and n, the rows of its tree.

    Rows are dealt out by ranges of tree and order, so a tree of any size is spread; places come from the counts of each
    tree in each range, of which there are at most as many as trees and ranges.
    """
    at = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id())
    at = common.materialize(at.withColumn("_part", F.shiftright("_at", 33)), "placed")
    parts = at.groupBy(F.col("tree").alias("_tree"), F.col("_part").alias("_in")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    tree = W.partitionBy("_tree").orderBy("_in")
    parts = parts.withColumn("_before", F.sum("_n").over(tree) - F.col("_n")).withColumn("n", F.sum("_n").over(W.partitionBy("_tree")))
    joined = at.join(parts, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_in")))
    return joined.withColumn("place", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_tree", "_in", "_first", "_before", "_n")


def grow(nodes: DataFrame) -> list[DataFrame]:
    """Levels above the nodes (tree, n, place, digest, doc): of each parent its place, n (the level's nodes in its tree), kids,
    children (their digests as one text), states and digest. A tree ends where one node is left."""
    hashed = F.pandas_udf(lambda c: pd.Series(midstates(c.tolist()), dtype=object), "binary")
    levels = []
    for _ in range(_height(int(nodes.agg(F.max("n")).first()[0] or 0))):
        up = nodes.where("n > 1").groupBy("tree", F.ceil(F.col("n") / FANOUT).cast("long").alias("n"), F.floor(F.col("place") / FANOUT).cast("long").alias("place"))
        kid = F.struct("place", "digest", "doc") if not levels else F.struct("place", "digest")
        up = up.agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        up = up.withColumn("children", F.array_join(F.transform("kids", lambda k: k["digest"]), "")).withColumn("states", hashed("children"))
        up = up.withColumn("digest", F.lower(F.hex(F.substring("states", -32, 32))))
        levels.append(common.materialize(up if not levels else up.drop("kids"), "level"))
        nodes = levels[-1]
    return levels


def _height(n: int) -> int:
    return 0 if n <= 1 else 1 + _height(-(-n // FANOUT))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def hang(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest parents (tree, kids, children, states) with their path, the (slot, children, states) of the parents above
    from below, and subroot. tops has the path and subroot of each tree's last node (tree). A lone leaf is its own row, without children."""
    tops = tops.withColumnRenamed("tree", "_tree")
    down, out = None, None
    for level in reversed(levels):
        out = level.where("n = 1").join(tops, _same("tree", "_tree")).drop("_tree")
        if down is not None:
            out = out.unionByName(level.where("n > 1").join(down, _same("tree", "_tree") & (F.col("place") == F.col("_place"))).drop("_tree", "_place"))
        each = out.select(F.col("tree").alias("_tree"), "place", "children", "states", "path", "subroot", F.explode(F.sequence(F.lit(0), (F.length("children") / 64).cast("int") - 1)).alias("slot"))
        down = each.select("_tree", (F.col("place") * FANOUT + F.col("slot")).alias("_place"), F.concat(F.array(F.struct("slot", "children", "states")), "path").alias("path"), "subroot")
    columns = ("tree", "kids", "children", "states", "path", "subroot")
    lone = nodes.where("n = 1").join(tops, _same("tree", "_tree"))
    lone = lone.withColumns({"kids": F.array(F.struct("place", "digest", "doc")), "children": F.lit(None).cast("string"), "states": F.lit(None).cast("binary")}).select(*columns)
    return lone if out is None else out.select(*columns).unionByName(lone)


def _empty_path() -> Column:
    return F.array().cast("array<struct<slot:int,children:string,states:binary>>")


def manifest(docs: DataFrame, altered: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of docs (doc_id, text, lang, source, n_chars).

    altered is the text to verify in place of a document's own, or null where nothing was changed. Only digests are shuffled,
    never texts. Documents of one source with equal or null ids (null first) stand in the order of their leaves; repeated rows
    are leaves each. Sources are any strings, null among them. An empty table gives no row.
    """
    changed = F.when(altered.isNotNull(), leaf(altered))
    docs = docs.select(F.col("source").alias("tree"), leaf().alias("digest"), F.struct("doc_id", changed.alias("altered")).alias("doc"), F.monotonically_increasing_id().alias("_row"))
    docs = common.materialize(docs.withColumn("_id", F.col("doc.doc_id")), "leaves")
    nodes = common.materialize(placed(docs, "_id", "digest", "_row").select("tree", "n", "place", "digest", "doc"), "nodes")
    levels = grow(nodes)
    ends = [x.where("n = 1").select("tree", "digest") for x in [nodes, *levels]]
    subroots = ends[0]
    for e in ends[1:]:
        subroots = subroots.unionByName(e)
    top = placed(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("_source"), "digest"), "_source")
    top = common.materialize(top.select("tree", "n", "place", "digest", F.struct(F.col("_source").alias("source")).alias("doc")), "top")
    above = grow(top)
    last = (above[-1] if above else top).where("n = 1").select("digest").first()
    root = last[0] if last else None
    hung = hang(top, above, docs.sparkSession.range(1).select(F.lit(0).alias("tree"), _empty_path().alias("path"), F.lit(root).cast("string").alias("subroot")))
    each = hung.select("children", "states", "path", F.posexplode("kids").alias("slot", "kid"))
    path = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat(F.array(F.struct("slot", "children", "states")), "path"))
    tops = common.materialize(each.select(F.col("kid.doc.source").alias("tree"), path.alias("path"), F.col("kid.digest").alias("subroot")), "tops")
    lowest = hang(nodes, levels, tops).select("kids", "children", "states", "path", "subroot")
    folded = lowest.mapInArrow(_fold, _OUT.format(docs.schema["_id"].dataType.simpleString()))
    return folded.withColumn("root", F.lit(root).cast("string")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its leaf, its source's subroot, the root, the hash of its proof, and the root folded from
    the leaf after the tampering of the contract. Null values hash as `-`, null ids are never tampered with and come first, and
    repeated rows are leaves of their own. An empty table gives no row."""
    docs = common.table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = manifest(docs, F.when(hit, lowered))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql(levels: int = 8) -> str:
    """SQL of the result for trees of up to FANOUT ** levels nodes: it hashes whole runs, without states."""
    value = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    hashed = lambda text: "sha256(" + " || ".join([value(c) for c in ("doc_id", "source", "lang", "n_chars")] + [value(text)]) + ")"
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [
        f"d AS (SELECT doc_id, source, {hashed('text')} AS leaf, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {hashed(low)} END AS altered FROM documents)",
        "s0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n, leaf AS digest FROM d)",
    ]
    grown = lambda a, b, key: f"{b} AS (SELECT {key}, place // {FANOUT} AS place, (n + {FANOUT - 1}) // {FANOUT} AS n, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM {a} WHERE n > 1 GROUP BY ALL)"
    out += [grown(f"s{i}", f"s{i + 1}", "source") for i in range(levels)]
    ends = " UNION ALL ".join(f"SELECT source, digest FROM s{i} WHERE n = 1" for i in range(levels + 1))
    out += [f"e AS ({ends})", "t0 AS (SELECT 0 AS one, source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM e)"]
    out += [grown(f"t{i}", f"t{i + 1}", "one") for i in range(levels)]
    out += ["r AS (" + " UNION ALL ".join(f"SELECT digest AS root FROM t{i} WHERE n = 1" for i in range(levels + 1)) + ")"]
    last = "SELECT doc_id, leaf, source, place, coalesce(altered, leaf) AS now, '' AS proof, n FROM s0"
    for tree, key in (("s", "source"), ("t", "one")):
        for i in range(levels):
            run = f"SELECT {key}, place // {FANOUT} AS up, list(digest ORDER BY place) AS run FROM {tree}{i} WHERE n > 1 GROUP BY ALL"
            slot, more = f"f.place % {FANOUT}", "f.n > 1"
            step = f"""SELECT f.* EXCLUDE (place, now, proof, n), CASE WHEN {more} THEN f.place // {FANOUT} ELSE f.place END AS place,
                CASE WHEN {more} THEN sha256(array_to_string(run[1:{slot}] || [now] || run[{slot} + 2:], '')) ELSE now END AS now,
                CASE WHEN {more} THEN proof || array_to_string(run[1:{slot}] || run[{slot} + 2:], '') ELSE proof END AS proof, CASE WHEN {more} THEN (f.n + {FANOUT - 1}) // {FANOUT} ELSE 1 END AS n
                FROM f{tree}{i} f LEFT JOIN ({run}) g ON g.{key} IS NOT DISTINCT FROM f.{key} AND g.up = f.place // {FANOUT} AND {more}"""
            out += [f"f{tree}{i} AS ({last})"]
            last = step
        if tree == "s":
            out += [f"fs AS ({last})"]
            last = "SELECT fs.doc_id, leaf, now, proof, t0.digest AS subroot, t0.place, t0.n, 0 AS one FROM fs JOIN t0 ON t0.source IS NOT DISTINCT FROM fs.source"
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, now AS folded_root, now = root AS verified FROM ({last}), r"


SQL = _sql()
